"""What was known when: as-of and latest views, their difference, and checks of the table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BUSINESS_KEY, PRIMARY_KEY

VERSION_ORDER = ("filed", "adsh")


class PrimaryKeyViolation(RuntimeError):
    """Some observations share a primary key."""


def pick_latest(facts: DataFrame, key: Sequence[str] = BUSINESS_KEY, order: Sequence[str] = VERSION_ORDER, columns: Sequence[str] | None = None) -> DataFrame:
    """The whole row, or some columns of it, with the greatest ``order`` of each key; a null value can win."""
    columns = facts.columns if columns is None else columns
    rest = [c for c in columns if c not in key]
    best = facts.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return best.select(*key, "row.*").select(*columns)


def known_by(facts: DataFrame, day: dt.date | Column) -> DataFrame:
    return facts.where(F.col("filed") <= (day if isinstance(day, Column) else F.lit(day)))


def as_of(facts: DataFrame, day: dt.date) -> DataFrame:
    """Each fact as it was known on a day."""
    return pick_latest(known_by(facts, day))


def latest(facts: DataFrame) -> DataFrame:
    """Each fact with all its revisions."""
    return pick_latest(facts)


def diff_worlds(facts: DataFrame, day: dt.date) -> DataFrame:
    """Facts known on a day whose value differs from the latest, null being a value: both versions in one pass over the facts."""
    key = [F.col(c) for c in BUSINESS_KEY]
    complete = facts.where(~F.greatest(*[c.isNull() for c in key]))
    version, order = F.struct("value", "filed", "adsh"), F.struct(*VERSION_ORDER)
    worlds = complete.groupBy(*BUSINESS_KEY).agg(F.max_by(F.when(F.col("filed") <= F.lit(day), version), F.when(F.col("filed") <= F.lit(day), order)).alias("pit"), F.max_by(version, order).alias("rev"))
    differ = worlds.where(F.col("pit").isNotNull() & ~F.col("pit.value").eqNullSafe(F.col("rev.value")))
    return differ.select(*BUSINESS_KEY, *[F.col(f"{w}.{c}").alias(f"{c}_{w}") for w in ("pit", "rev") for c in ("value", "filed", "adsh")])


def key_violations(facts: DataFrame, worst: int = 10) -> DataFrame:
    """The primary keys with most rows among those that have several."""
    return facts.groupBy(*PRIMARY_KEY).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), *PRIMARY_KEY).limit(worst)


def assert_primary_key(facts: DataFrame) -> int:
    """1, the rows of the largest group of a primary key; raises if there is a larger one."""
    bad = key_violations(facts).collect()
    if bad:
        raise PrimaryKeyViolation(f"primary keys with several rows, such as {bad[0].asDict()}")
    return 1


def summary(facts: DataFrame) -> DataFrame:
    """One row: rows, companies, tags, filings, and the first and last of both dates."""
    return facts.agg(
        F.count("*").alias("n_rows"),
        *[F.count_distinct(c).alias(f"n_{c}") for c in ("cik", "tag", "adsh")],
        *[f(c).alias(f"{c}_{n}") for c in ("filed", "ddate") for n, f in (("min", F.min), ("max", F.max))],
    )


def by_form(facts: DataFrame) -> DataFrame:
    return facts.groupBy("form").agg(F.count("*").alias("n_rows"))


def business_keys(facts: DataFrame) -> DataFrame:
    """One row: the number of facts, counted in two steps that any number of executors shares."""
    return facts.select(*BUSINESS_KEY).distinct().agg(F.count("*").alias("n_keys"))


def freeze_first(facts: DataFrame) -> DataFrame:
    """Every value replaced by that of the fact's first row, null included."""
    series = Window.partitionBy(*BUSINESS_KEY).orderBy(*VERSION_ORDER)
    return facts.withColumn("value", F.first("value").over(series))
