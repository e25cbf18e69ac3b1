"""Revision events and the census of facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import scalar
from ..schema import BUSINESS_KEY
from .ingest import same_filing

EVENT_COLUMNS = tuple(
    "cik tag ddate qtrs uom seq v_old v_new abs_delta rel_delta adsh_old adsh_new form_old form_new filed_old filed_new lag_days lag_since_first_days version_old version_new version_changed is_amendment scale_exponent".split()
)


def in_order():
    """A fact's observations, first filed first."""
    return Window.partitionBy(*BUSINESS_KEY).orderBy("filed", "adsh")


def mapped_tags(facts: DataFrame, tag_map: DataFrame | None) -> DataFrame:
    """Tags replaced by their class representative; ``tag_map`` has columns tag, representative."""
    if tag_map is None:
        return facts
    names = tag_map.select(F.col("tag").alias("old"), "representative")
    return facts.join(names, facts["tag"] == names["old"], "left").withColumn("tag", F.coalesce("representative", "tag")).drop("old", "representative")


def valued(facts: DataFrame, tag_map: DataFrame | None = None) -> DataFrame:
    """Observations of a number; with merged tags, one for each filing and fact, and none where the filing contradicts itself."""
    seen = mapped_tags(facts, tag_map).select(*BUSINESS_KEY, "value", "filed", "adsh", "form", "version", "period").where(F.col("value").isNotNull())
    return same_filing(seen) if tag_map is not None else seen


def series(observed: DataFrame) -> DataFrame:
    """Every observation beside the one before it, the changes among them marked."""
    before = {c: F.lag(c).over(in_order()).alias(f"{c}_old") for c in ("value", "adsh", "form", "filed", "version")}
    return observed.select("*", F.first("filed").over(in_order()).alias("filed_first"), *before.values()).withColumn("changed", F.coalesce(F.col("value_old") != F.col("value"), F.lit(False)))


def event_columns(changes: DataFrame) -> DataFrame:
    old, new = F.col("value_old"), F.col("value")
    return changes.withColumn("seq", F.row_number().over(in_order())).select(
        *BUSINESS_KEY,
        "seq",
        old.alias("v_old"),
        new.alias("v_new"),
        (new - old).alias("abs_delta"),
        scalar.relative_delta(old, new).alias("rel_delta"),
        "adsh_old",
        F.col("adsh").alias("adsh_new"),
        "form_old",
        F.col("form").alias("form_new"),
        "filed_old",
        F.col("filed").alias("filed_new"),
        F.datediff("filed", "filed_old").alias("lag_days"),
        F.datediff("filed", "filed_first").alias("lag_since_first_days"),
        "version_old",
        F.col("version").alias("version_new"),
        (F.col("version_old") != F.col("version")).alias("version_changed"),
        scalar.is_amendment(F.col("form")).alias("is_amendment"),
        scalar.scale_exponent(old, new).alias("scale_exponent"),
    )


def events(facts: DataFrame, tag_map: DataFrame | None = None) -> DataFrame:
    """One row for each observation whose value differs from the one before it."""
    return event_columns(series(valued(facts, tag_map)).where("changed"))


def census(facts: DataFrame, config: Config, tag_map: DataFrame | None = None) -> DataFrame:
    """One row for each fact with a value: its life, its censoring, and the flags of its events.

    The flags come out of the same pass as the rest: events and census share
    one distribution of the rows by business key, and one sort. Distinct values
    are counted in the window over a fact's versions, which keeps that sort.
    """
    order = F.struct("filed", "adsh")
    old, new = F.col("value_old"), F.col("value")
    number = F.when(~F.isnan("value"), F.col("value") + 0.0)  # zeros are equal whatever their sign, and so are values that are no number
    distinct = F.size(F.collect_set(number).over(Window.partitionBy(*BUSINESS_KEY)))
    base = series(valued(facts, tag_map)).withColumn("distinct", distinct).groupBy(*BUSINESS_KEY).agg(
        F.count("*").alias("n_obs"),
        (F.max("distinct") + F.max(F.isnan("value").cast("int"))).cast("long").alias("n_distinct_val"),
        F.min_by("value", order).alias("v_first"),
        F.max_by("value", order).alias("v_final"),
        F.min("filed").alias("filed_first"),
        F.max("filed").alias("filed_final"),
        F.min_by("period", order).alias("period_first"),
        F.bool_or(F.col("changed") & scalar.is_amendment(F.col("form"))).alias("ever_amendment"),
        F.bool_or(F.col("changed") & scalar.scale_exponent(old, new).isNotNull()).alias("ever_scale_change"),
    )
    end, cutoff = (F.lit(d).cast("date") for d in (config.window_end, config.left_cutoff))
    out = base.withColumns(
        {
            "revised": F.col("n_distinct_val") >= 2,
            "n_revisions": (F.col("n_distinct_val") - 1).cast("int"),
            "magnitude": scalar.magnitude(F.col("v_first"), F.col("v_final")),
            "from_zero": F.col("v_first") == 0,
            "lag_days": F.datediff("filed_final", "filed_first"),
            "obs_window_days": F.datediff(end, F.col("filed_first")),
            "left_censored_window": F.col("filed_first") < cutoff,
            "first_is_comparative": scalar.first_is_comparative(F.col("ddate"), F.col("period_first")),
        }
    )
    return out.withColumns({"right_censored": F.col("obs_window_days") < config.right_truncation_days, "left_censored": F.col("left_censored_window") | F.col("first_is_comparative")})


def merged_conflicts(facts: DataFrame, tag_map: DataFrame) -> DataFrame:
    """One row: the facts of a filing that contradict each other once tags are merged."""
    seen = mapped_tags(facts, tag_map).where(F.col("value").isNotNull())
    values = seen.groupBy(*BUSINESS_KEY, "adsh").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return values.agg(F.count_if(F.col("low") != F.col("high")).alias("n_conflicts"))
