"""The twelve tables on revision rates, sizes and lags.

The four censoring groups overlap, so each row is tagged with the groups it
belongs to and counted once for each, in one pass over the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import nearest_rank, selected
from ..functions.scalar import lag_bin, ratio
from ..schema import BUSINESS_KEY, LAG_EDGES, LAG_LABELS, MIN_TAG_SAMPLE, QUANTILES, SCALE_EXPONENTS, THRESHOLDS

GROUPS = ("all", "drop_right", "drop_left", "drop_both")
LAGS = (("since_first", "lag_since_first_days"), ("adjacent", "lag_days"))


def with_flags(events: DataFrame, census: DataFrame) -> DataFrame:
    """Events with the observations and censoring of their fact."""
    return events.join(census.select(*BUSINESS_KEY, "n_obs", "right_censored", "left_censored"), list(BUSINESS_KEY), "left")


def by_group(df: DataFrame) -> DataFrame:
    """Each row once for every censoring group that keeps it, the group in ``censoring``."""
    right, left = ~F.col("right_censored"), ~F.col("left_censored")
    labels = F.array(F.lit("all"), F.when(right, "drop_right"), F.when(left, "drop_left"), F.when(right & left, "drop_both"))
    return df.withColumn("censoring", F.explode(F.array_compact(labels)))


def grid(df: DataFrame, **columns: tuple) -> DataFrame:
    """Every combination of the given values, a table of fixed size."""
    out = df.sparkSession.range(1).select()
    for name, values in columns.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def categories(counts: DataFrame, names: tuple[str, ...], count: str, total: Column, share: str) -> DataFrame:
    """One row for each group and counted column, with its share of the total."""
    pairs = F.array(*[F.struct(F.lit(n).alias("category"), F.col(n).alias(count)) for n in names])
    return counts.select("censoring", total.alias("total"), F.explode(pairs).alias("p")).select("censoring", "p.category", f"p.{count}", ratio(F.col(f"p.{count}"), F.col("total")).alias(share))


def full_groups(counts: DataFrame, *zeros: str) -> DataFrame:
    """All four groups, empty ones with zeros."""
    return F.broadcast(grid(counts, censoring=GROUPS)).join(counts, "censoring", "left").fillna(0, list(zeros))


def changed_keys(events: DataFrame) -> DataFrame:
    """The facts that were observed twice and changed: their largest change and censoring, one row each, so that later counts need no distinct facts."""
    return events.where("n_obs >= 2").groupBy(*BUSINESS_KEY).agg(F.max("rel_delta").alias("worst"), *[F.bool_or(c).alias(c) for c in ("right_censored", "left_censored")])


def rate_by_threshold(census: DataFrame, events: DataFrame) -> DataFrame:
    multi = by_group(census.where("n_obs >= 2")).groupBy("censoring").agg(F.count("*").alias("n_keys_multi"))
    # A fact counts once for a threshold: its largest change decides. All cells are counted in one pass over the facts with events.
    over = by_group(changed_keys(events)).groupBy("censoring").agg(*[F.count_if(F.col("worst") > t).alias(f"over_{k}") for k, t in enumerate(THRESHOLDS)])
    over = over.select("censoring", F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"over_{k}").alias("n_keys_revised")) for k, t in enumerate(THRESHOLDS)])).alias("o")).select("censoring", "o.*")
    cells = grid(census, censoring=GROUPS, threshold=THRESHOLDS).join(multi, "censoring", "left").join(over, ["censoring", "threshold"], "left").fillna(0, ["n_keys_multi", "n_keys_revised"])
    return cells.select("censoring", "threshold", "n_keys_multi", "n_keys_revised", ratio(F.col("n_keys_revised"), F.col("n_keys_multi")).alias("rate"))


def all_quantiles(found: DataFrame, count: str, **cells: tuple) -> DataFrame:
    """A row for every cell and quantile; those without values have count 0 and a null value."""
    full = grid(found, **cells, quantile=QUANTILES)
    return full.join(found, [*cells, "quantile"], "left").select(*cells, F.coalesce(count, F.lit(0)).cast("long").alias(count), "quantile", "value")


def magnitude_quantiles(census: DataFrame) -> DataFrame:
    revised = by_group(census.where("revised and not from_zero"))
    scaled = F.array_compact(F.array(F.lit("with_scale"), F.when(~F.col("ever_scale_change"), "without_scale")))
    found = selected(revised.withColumn("scale_filter", F.explode(scaled)), "magnitude", ("censoring", "scale_filter"), QUANTILES, "n_keys")
    return all_quantiles(found, "n_keys", censoring=GROUPS, scale_filter=("with_scale", "without_scale"))


def rel_delta_quantiles(events: DataFrame) -> DataFrame:
    return all_quantiles(selected(by_group(events), "rel_delta", ("censoring",), QUANTILES), "n_events", censoring=GROUPS)


def census_composition(census: DataFrame) -> DataFrame:
    names = ("revised_total", "from_zero", "ever_scale_change", "ever_amendment", "in_magnitude_stats")
    counts = by_group(census.where("revised")).groupBy("censoring").agg(
        F.count("*").alias("revised_total"), *[F.count_if(F.col(c)).alias(c) for c in names[1:4]], F.count_if(~F.col("from_zero")).alias("in_magnitude_stats")
    )
    return categories(full_groups(counts, *names), names, "n_keys", F.col("revised_total"), "share_of_revised")


def left_censoring_sources(census: DataFrame) -> DataFrame:
    counts = census.where("n_obs >= 2").groupBy("left_censored_window", "first_is_comparative").agg(F.count("*").alias("n_keys_multi"), F.count_if("revised").alias("n_keys_revised"))
    return counts.withColumn("rate", ratio(F.col("n_keys_revised"), F.col("n_keys_multi")))


def lag_rows(events: DataFrame) -> DataFrame:
    """Each event once for every group, lag measure, and for all quarters counts together and its own."""
    lags = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(c).alias("lag")) for m, c in LAGS])
    quarters = F.array(F.lit("all"), F.col("qtrs").cast("string"))
    return by_group(events).select("censoring", F.explode(lags).alias("l"), quarters.alias("q")).select("censoring", "l.measure", "l.lag", F.explode("q").alias("qtrs"))


LAG_CELLS = {"censoring": GROUPS, "measure": tuple(m for m, _ in LAGS), "qtrs": ("all", "0", "1", "2", "3", "4")}


def lag_quantiles(events: DataFrame) -> DataFrame:
    found = nearest_rank(lag_rows(events), "lag", tuple(LAG_CELLS), QUANTILES)
    return all_quantiles(found, "n_events", **LAG_CELLS)


def lag_bins(events: DataFrame) -> DataFrame:
    bins = lag_rows(events).withColumn("bin_days", lag_bin(F.col("lag"), LAG_EDGES, LAG_LABELS)).groupBy(*LAG_CELLS, "bin_days").agg(F.count("*").alias("n"))
    full = grid(events, **LAG_CELLS, bin_days=LAG_LABELS).join(bins, [*LAG_CELLS, "bin_days"], "left").withColumn("n_events", F.coalesce("n", F.lit(0)).cast("long"))
    whole = F.sum("n_events").over(Window.partitionBy(*LAG_CELLS))
    return full.select(*LAG_CELLS, "bin_days", "n_events", ratio(F.col("n_events"), whole).alias("share"))


def top_tags(counts: DataFrame, order: list[Column], top: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("censoring").orderBy(*order, "tag"))
    return counts.withColumn("place", place).where(F.col("place") <= top).select("censoring", "tag", "n_keys_multi", "n_keys_revised", "rate")


def rate_by_tag(census: DataFrame, events: DataFrame, top: int = 20) -> DataFrame:
    """The tags with most facts that were observed twice; facts with an event are the revised ones."""
    multi = by_group(census.where("n_obs >= 2")).groupBy("censoring", "tag").agg(F.count("*").alias("n_keys_multi"))
    hit = by_group(changed_keys(events)).groupBy("censoring", "tag").agg(F.count("*").alias("n_keys_revised"))
    counts = multi.join(hit, ["censoring", "tag"], "left").fillna(0, ["n_keys_revised"]).withColumn("rate", ratio(F.col("n_keys_revised"), F.col("n_keys_multi")))
    return top_tags(counts, [F.desc("n_keys_multi")], top)


def rate_by_tag_highest(census: DataFrame, top: int = 20, least: int = MIN_TAG_SAMPLE) -> DataFrame:
    """The tags with the highest rate among those with enough facts."""
    counts = by_group(census.where("n_obs >= 2")).groupBy("censoring", "tag").agg(F.count("*").alias("n_keys_multi"), F.count_if("revised").alias("n_keys_revised"))
    enough = counts.where(F.col("n_keys_multi") >= least).withColumn("rate", ratio(F.col("n_keys_revised"), F.col("n_keys_multi")))
    return top_tags(enough, [F.desc("rate")], top)


def silent_vs_amendment(events: DataFrame) -> DataFrame:
    counts = by_group(events).groupBy("censoring").agg(F.count("*").alias("n"), F.count_if(~F.col("is_amendment")).alias("silent"), F.count_if("is_amendment").alias("amendment"))
    return categories(full_groups(counts, "n", "silent", "amendment"), ("silent", "amendment"), "n_events", F.col("n"), "share")


def version_and_scale_share(events: DataFrame) -> DataFrame:
    scale = F.coalesce(F.col("scale_exponent").cast("int").isin(*SCALE_EXPONENTS), F.lit(False))
    counts = by_group(events).groupBy("censoring").agg(F.count("*").alias("n"), F.count_if("version_changed").alias("version_changed"), F.count_if(scale).alias("scale_change"))
    return categories(full_groups(counts, "n", "version_changed", "scale_change"), ("version_changed", "scale_change"), "n_events", F.col("n"), "share")


def accepted_after_1600_share(facts: DataFrame) -> DataFrame:
    """One row: filings accepted at or after 16:00, those dated the next day, and those that are not."""
    late, rolled = F.hour("accepted") >= 16, F.to_date("accepted") < F.col("filed")
    counts = facts.select("adsh", "filed", "accepted").distinct().agg(
        F.count("*").alias("n_filings"), F.count_if(late).alias("n_after_1600"), F.count_if(rolled).alias("n_rolled_next_day"), F.count_if(late & ~rolled).alias("n_same_day_after_1600")
    )
    return counts.select(
        F.lit("n/a").alias("censoring"),
        "n_filings",
        "n_after_1600",
        ratio(F.col("n_after_1600"), F.col("n_filings")).alias("share_after_1600"),
        "n_rolled_next_day",
        "n_same_day_after_1600",
        ratio(F.col("n_same_day_after_1600"), F.col("n_filings")).alias("share_affected"),
    )


def histogram(census: DataFrame, column: str, width: float, where: str) -> DataFrame:
    """(bin, n): counts of ``column`` in bins of equal width, of the rows that ``where`` keeps."""
    return census.where(where).groupBy(F.floor(F.col(column) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def lag_histogram(tagged: DataFrame, censoring: str = "all", width: int = 15, top: float = 0.995) -> DataFrame:
    """(bin, n): lags since a fact was first filed, up to their ``top`` percentile, in bins of equal width."""
    late = by_group(tagged).where(F.col("censoring") == censoring)
    cut = F.broadcast(late.agg(F.percentile("lag_since_first_days", top).alias("cut")))  # one row
    kept = late.join(cut, F.col("lag_since_first_days") <= F.col("cut"))
    return kept.groupBy(F.floor(F.col("lag_since_first_days") / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def compute(facts: DataFrame, census: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
    """All twelve tables, by name."""
    tagged = with_flags(events, census)
    return {
        "rate_by_threshold": rate_by_threshold(census, tagged),
        "magnitude_quantiles": magnitude_quantiles(census),
        "rel_delta_quantiles": rel_delta_quantiles(tagged),
        "census_composition": census_composition(census),
        "left_censoring_sources": left_censoring_sources(census),
        "lag_quantiles": lag_quantiles(tagged),
        "lag_bins": lag_bins(tagged),
        "rate_by_tag": rate_by_tag(census, tagged),
        "rate_by_tag_highest": rate_by_tag_highest(census),
        "silent_vs_amendment": silent_vs_amendment(tagged),
        "version_and_scale_share": version_and_scale_share(tagged),
        "accepted_after_1600_share": accepted_after_1600_share(facts),
    }
