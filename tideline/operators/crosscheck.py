"""Agreement with a second source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ratio, relative_delta
from .ingest import agreement

MATCH_KEY = ("cik", "tag", "uom", "ddate", "qtrs", "filed")
TOLERANCE = 1e-9


def sample_companies(facts: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(cik) of n companies, the same for a seed whatever the order of rows."""
    return facts.select("cik").distinct().orderBy(F.md5(F.concat_ws(":", "cik", F.lit(seed)).cast("binary")), "cik").limit(n)


def side(rows: DataFrame, name: str) -> DataFrame:
    """A row for each key: how many rows it has, whether they have one value, null being one, and that value."""
    parts, agree = agreement("value")
    groups = rows.groupBy(*MATCH_KEY).agg(F.count("*").alias(f"{name}_n"), *parts)
    return groups.select(*MATCH_KEY, f"{name}_n", agree.alias(f"{name}_one"), F.col("low").alias(f"{name}_value"))


def both(ours: DataFrame, theirs: DataFrame, how: str) -> DataFrame:
    met = side(ours.where(F.col("value").isNotNull()), "our").join(side(theirs, "their"), list(MATCH_KEY), how)
    return met.withColumn("rel", F.when(F.col("our_one") & F.col("their_one"), relative_delta(F.col("our_value"), F.col("their_value"))))


def conflicts(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Keys that both sources decide, and differently: both values and their relative difference."""
    return both(ours, theirs, "inner").where(F.col("rel") > TOLERANCE).select(*MATCH_KEY, F.col("our_value").alias("value"), F.col("their_value").alias("value_cf"), "rel")


def summary(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """One row: rows and keys of both sources, matches, agreement and the median conflict, from one pass over each."""
    bad = F.col("rel") > TOLERANCE

    def keys(name: str, to: str) -> list[Column]:
        one = F.col(f"{name}_one")
        return [F.coalesce(F.sum(f"{name}_n"), F.lit(0)).alias(f"{to}_rows"), F.count_if(one).alias(f"{to}_unique_keys"), F.count_if(~one).alias(f"{to}_ambiguous_keys")]

    out = both(ours, theirs, "full").agg(
        *keys("our", "our"),
        *keys("their", "companyfacts"),
        F.count_if(F.col("our_one") & F.col("their_one")).alias("matched_observations"),
        F.count_if(bad).alias("n_conflicts"),
        F.coalesce(F.median(F.when(bad, F.col("rel"))), F.lit(0.0)).alias("conflict_rel_median"),
    )
    return out.withColumns(
        {
            "match_rate_of_ours": F.coalesce(ratio(F.col("matched_observations"), F.col("our_unique_keys")), F.lit(0.0)),
            "value_agreement": F.coalesce(1 - ratio(F.col("n_conflicts"), F.col("matched_observations")), F.lit(0.0)),
        }
    )
