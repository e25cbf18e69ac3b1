"""Ranks and quantiles with exactly stated rules."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import Scratch


def nearest_rank(df: DataFrame, value: str, by: Sequence[str], quantiles: Sequence[float], count: str = "n_events") -> DataFrame:
    """(by..., count, quantile, value): of n sorted values that at floor((n - 1) q + 0.5); null values don't count.

    Equal values are merged before anything is sorted, so a group's sort is as
    large as its distinct values: places come from running sums of their counts.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("k"))
    group = Window.partitionBy(*by)
    ranked = counts.withColumn("upto", F.sum("k").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))).withColumn(count, F.sum("k").over(group))
    wanted = F.array(*[F.struct(F.lit(float(q)).alias("quantile"), F.floor((F.col(count) - 1) * F.lit(float(q)) + 0.5).alias("place")) for q in quantiles])
    return ranked.withColumn("q", F.explode(wanted)).where((F.col("q.place") < F.col("upto")) & (F.col("q.place") >= F.col("upto") - F.col("k"))).select(*by, count, F.col("q.quantile").alias("quantile"), "value")


#: Parts into which a range of values is cut in each round of a selection.
PARTS = 1024


def part_of(low: Column, high: Column, logarithmic: bool) -> Column:
    """The part of the range from low to high in which v lies; it never falls as v rises. Halves keep differences finite."""
    scale = (lambda c: F.signum(c) * F.log1p(F.abs(c) * 1e6)) if logarithmic else (lambda c: c / 2)
    at = (scale(F.col("v")) - scale(low)) / (scale(high) - scale(low))
    return F.when(scale(high) > scale(low), F.least(F.lit(PARTS - 1), F.floor(at * PARTS))).otherwise(F.lit(0)).cast("int")


def selected(df: DataFrame, value: str, by: Sequence[str], quantiles: Sequence[float], count: str = "n_events") -> DataFrame:
    """The rows of ``nearest_rank``, found by narrowing ranges: for values of which nearly all are distinct.

    Each round counts the values in the parts of every open range and keeps, for
    each place sought, the part that holds it, between its least and greatest
    value. What is moved are counts of parts, however many values there are; the
    driver sees a row for each group and quantile. Ranges are cut by logarithms
    and evenly in turn, so few rounds narrow any of them; a range of one value
    is done.
    """
    by = list(by)
    with Scratch(df.sparkSession, "select") as scratch:
        rows = scratch.save(df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v")), "values")
        sought: list[dict] = []
        for cell in rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect():
            for q in quantiles:
                sought.append({**{c: cell[c] for c in by}, count: cell["n"], "quantile": float(q), "place": int(math.floor((cell["n"] - 1) * float(q) + 0.5)), "low": cell["low"], "high": cell["high"]})
        logarithmic = True
        while wanted := [s for s in sought if s["low"] < s["high"]]:
            ranges = sorted({(*(s[c] for c in by), s["low"], s["high"]) for s in wanted}, key=str)
            number = {r: k for k, r in enumerate(ranges)}
            schema = T.StructType([*[rows.schema[c] for c in by], T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()), T.StructField("range", T.IntegerType())])
            table = df.sparkSession.createDataFrame([(*r, k) for r, k in number.items()], schema).withColumnsRenamed({c: f"of_{c}" for c in by})
            within = (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))
            for c in by:
                within = within & F.col(c).eqNullSafe(F.col(f"of_{c}"))
            parts = rows.join(F.broadcast(table), within).groupBy("range", part_of(F.col("low"), F.col("high"), logarithmic).alias("part")).agg(F.count("*").alias("k"), F.min("v").alias("least"), F.max("v").alias("most"))
            before = F.sum("k").over(Window.partitionBy("range").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
            parts = parts.withColumn("before", F.coalesce(before, F.lit(0)))
            places = df.sparkSession.createDataFrame([(k, number[(*(s[c] for c in by), s["low"], s["high"])], s["place"]) for k, s in enumerate(sought) if s["low"] < s["high"]], "target int, range int, place long")
            for r in parts.join(F.broadcast(places), "range").where("place >= before and place < before + k").select("target", "before", "least", "most").collect():
                s = sought[r["target"]]
                s["place"], s["low"], s["high"] = s["place"] - r["before"], r["least"], r["most"]
            logarithmic = not logarithmic
    out = T.StructType([*[rows.schema[c] for c in by], T.StructField(count, T.LongType()), T.StructField("quantile", T.DoubleType()), T.StructField("value", T.DoubleType())])
    return df.sparkSession.createDataFrame([(*(s[c] for c in by), s[count], s["quantile"], s["low"]) for s in sought], out)


def average_rank(by: Sequence[str], value: str) -> Column:
    """Rank from 1; ties share the mean of their places."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def spearman(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """(by..., n, rho) of rows where both are given.

    Without ties 1 - 6 sum(d^2) / (n (n^2 - 1)), which is exactly 1 on equal
    ranks; with ties the correlation of ranks. Null for n < 2 or no variance.
    Ranks are multiples of a half: all sums are exact whatever their order.
    """
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, a, b)
    ranked = both.select(*by, average_rank(by, a).alias("ra"), average_rank(by, b).alias("rb"))
    s = ranked.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum("ra").alias("sa"),
        F.sum("rb").alias("sb"),
        F.sum(F.col("ra") * F.col("ra")).alias("saa"),
        F.sum(F.col("rb") * F.col("rb")).alias("sbb"),
        F.sum(F.col("ra") * F.col("rb")).alias("sab"),
        F.sum((F.col("ra") - F.col("rb")) * (F.col("ra") - F.col("rb"))).alias("dd"),
        F.count_distinct("ra").alias("na"),
        F.count_distinct("rb").alias("nb"),
    )
    n = F.col("n").cast("double")
    va, vb = n * F.col("saa") - F.col("sa") * F.col("sa"), n * F.col("sbb") - F.col("sb") * F.col("sb")
    tied = (n * F.col("sab") - F.col("sa") * F.col("sb")) / F.sqrt(va * vb)
    rho = F.when((n < 2) | (va == 0) | (vb == 0), None).when((F.col("na") == F.col("n")) & (F.col("nb") == F.col("n")), 1 - F.lit(6.0) * F.col("dd") / (n * (n * n - 1))).otherwise(tied)
    clamped = F.when(rho.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho)))  # greatest and least pass over nulls
    return s.select(*by, "n", clamped.alias("rho"))
