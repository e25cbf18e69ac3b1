"""The named queries and, for each, the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import scalar
from ..operators import crosscheck, facts, history, ingest, renames, revisions, stats, vintage
from ..schema import FORMS, OBSERVATIONS, QTRS
from ..scratch import Scratch
from ..sources import archive, bridge, companyfacts
from ..sources import observations as observations_
from ..streaming.current import Current
from . import oracle

AS_OF = dt.date(1999, 6, 30)
CONFIG = bridge.CONFIG
DAYS, POINTS = CONFIG.as_of_dates, CONFIG.truncation_points
SIZE = CONFIG.universe_size
#: The test facts have few companies and other years; the counts of the rules are scaled to them, the ratios are not.
RULES = renames.Rules(min_peak=50, recent=(2000, 2002), early=1998, min_shared=20, min_support=10)
TAG_MAP = [("Assets", "StockholdersEquity"), ("StockholdersEquity", "StockholdersEquity")]
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def tag_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TAG_MAP, "tag string, representative string")


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(observations, census, events with flags)."""
    obs = bridge.observations(spark, sf_dir)
    census = revisions.census(obs, CONFIG)
    return obs, census, stats.with_flags(revisions.events(obs), census)


# Ingest.


@query
def raw_facts(spark, d):
    return bridge.raw_facts(spark, d).select(*bridge.RAW_COLUMNS)


@query
def observations(spark, d):
    return bridge.observations(spark, d)


@query
def filter_counts(spark, d):
    return ingest.audited(*bridge.archive_members(spark, d))[1]


@query
def ingested(spark, d):
    kept, _ = ingest.audited(*bridge.archive_members(spark, d))
    return ingest.typed(kept).select("cik", "adsh", "form", "filed", "accepted", "period", "tag", "version", "ddate", F.col("qtrs").cast("int").alias("qtrs"), "uom", "value", "filed_year")


@query
def custom_tag_anti(spark, d):
    _, num, tag = bridge.archive_members(spark, d)
    return ingest.without_custom(num, tag).groupBy("tag", "version").agg(F.count("*").alias("n_rows"))


@query
def qtrs_cast_filter(spark, d):
    _, num, _ = bridge.archive_members(spark, d)
    q = F.col("qtrs").try_cast("int")
    return num.groupBy("qtrs").agg(F.count("*").alias("n_rows"), F.count_if(q.isin(*QTRS)).alias("n_kept"))


@query
def blank_filter(spark, d):
    _, num, _ = bridge.archive_members(spark, d)
    return num.groupBy(scalar.blank(F.col("segments")).alias("no_segments"), scalar.blank(F.col("coreg")).alias("no_coreg")).agg(F.count("*").alias("n_rows"))


# The store.


@query
def pk_violations(spark, d):
    return facts.key_violations(bridge.raw_facts(spark, d).where(F.col("form").isin(*FORMS)))


@query
def summary(spark, d):
    return facts.summary(bridge.observations(spark, d))


@query
def by_form(spark, d):
    return facts.by_form(bridge.observations(spark, d))


@query
def business_key_count(spark, d):
    return facts.business_keys(bridge.observations(spark, d))


@query
def load_filtered(spark, d):
    out = observations_.load(spark, stored(spark, d), [1, 2, 3, 5, 8], ["Assets", "NetIncomeLoss"], AS_OF, 0)
    return out.select(*[c for c in bridge.RAW_COLUMNS if c != "qtrs"], F.col("qtrs").cast("int").alias("qtrs"))


def stored(spark, d):
    """The facts written as a store is, under filed_year, cik_bucket and quarter."""
    config = Config.of("1996q1", Scratch(spark, "store").path)
    obs = bridge.observations(spark, d)
    rows = obs.select(*[(F.col(f.name) if f.name in obs.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in OBSERVATIONS])
    ingest.write(rows.withColumn("filed_year", F.year("filed")), config.observations, "1996q1", config.key_partitions)
    return config


@query
def load_years(spark, d):
    return observations_.load(spark, stored(spark, d), years=[1998, 2000]).groupBy("filed_year", "form").agg(F.count("*").alias("n_rows"), F.sum("value").alias("sum_value"))


@query
def filter_counts_of_files(spark, d):
    """The members of the archives of all quarters, read as one table each, and judged as one quarter."""
    sub, num, tag = archive.members(spark, zipped(spark, d))
    return ingest.counts_of(ingest.judged(sub.drop("quarter"), num.drop("quarter"), tag.drop("quarter").distinct()))


def zipped(spark, d):
    return bridge.archives(spark, d, Scratch(spark, "archives").path)


@query
def archive_counts(spark, d):
    """The filter counts of every quarter's archive, from one scan of all of them."""
    groups, _ = archive.judged(spark, zipped(spark, d), Scratch(spark, "judged"))
    return ingest.counts_of(groups)


@query
def archive_observations(spark, d):
    """What is kept of all archives, beside the quarter it came with."""
    groups, _ = archive.judged(spark, zipped(spark, d), Scratch(spark, "judged"))
    return ingest.typed(ingest.kept_of(groups)).select("quarter", "cik", "adsh", "form", "filed", "accepted", "period", "fy", "tag", "version", "ddate", F.col("qtrs").cast("int").alias("qtrs"), "uom", "value", "filed_year")


@query
def archive_header_drift(spark, d):
    """Of each archive, the filings it lists and the members that don't begin as they should."""
    archives_ = zipped(spark, d)
    drift = archive.scan(spark, archives_, archive.HEADERS).groupBy("quarter").agg(F.count("*").alias("n_drifted"))
    rows = archive.scan(spark, archives_, "sub.txt", ["quarter", "adsh"]).groupBy("quarter").agg(F.count("*").alias("n_filings"))
    return rows.join(drift, "quarter", "left").select("quarter", "n_filings", F.coalesce("n_drifted", F.lit(0)).alias("n_drifted"))


@query
def company_sample(spark, d):
    return crosscheck.sample_companies(bridge.observations(spark, d), 20, seed=7)


@query
def as_of(spark, d):
    return facts.as_of(bridge.observations(spark, d), AS_OF)


@query
def latest(spark, d):
    return facts.latest(bridge.observations(spark, d))


@query
def diff_worlds(spark, d):
    return facts.diff_worlds(bridge.observations(spark, d), AS_OF)


def day_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d,) for d in DAYS], "asof date")


@query
def version_intervals(spark, d):
    """Every version with the days it was known from and to, and the newest value of its fact."""
    out = history.versions(bridge.observations(spark, d))
    return out.select("cik", "tag", "ddate", "qtrs", "uom", "adsh", "value", "known_from", "known_to", F.col("rev.value").alias("value_rev"))


@query
def as_of_days(spark, d):
    """The as-of view of every day of the experiment, from one table of versions."""
    return history.as_of_days(history.versions(bridge.observations(spark, d)), day_table(spark))


@query
def diff_worlds_days(spark, d):
    return history.diff_worlds_days(history.versions(bridge.observations(spark, d)), day_table(spark))


@query
def as_of_stored(spark, d):
    """The as-of view of a day from a stored history, whose other folders stay closed."""
    path = Scratch(spark, "history").path + "/versions"
    history.write(history.versions(bridge.observations(spark, d)), path)
    return history.as_of(history.read(spark, path), AS_OF)


# Events and census.


@query
def events(spark, d):
    return revisions.events(bridge.observations(spark, d))


@query
def event_seq(spark, d):
    return revisions.events(bridge.observations(spark, d)).select("cik", "tag", "ddate", "qtrs", "uom", "adsh_new", "seq")


@query
def event_lags(spark, d):
    return revisions.events(bridge.observations(spark, d)).groupBy("lag_days", "lag_since_first_days").agg(F.count("*").alias("n_events"))


@query
def scale_exponent(spark, d):
    return revisions.events(bridge.observations(spark, d)).groupBy(F.col("scale_exponent").cast("int").alias("scale_exponent")).agg(F.count("*").alias("n_events"))


@query
def census(spark, d):
    return revisions.census(bridge.observations(spark, d), CONFIG)


@query
def census_flags(spark, d):
    flags = ["revised", "from_zero", "ever_amendment", "ever_scale_change", "right_censored", "left_censored_window", "first_is_comparative", "left_censored"]
    return revisions.census(bridge.observations(spark, d), CONFIG).groupBy(*flags).agg(F.count("*").alias("n_keys"))


def arrived(spark, d, table: str) -> DataFrame:
    """A table kept up to date over three arrivals: the first filings of two years, later ones, and those that come late."""
    current = Current(spark, Scratch(spark, "current").path + "/tables", CONFIG)
    obs = Scratch(spark, "arrivals").save(bridge.observations(spark, d), "observations")
    late, first = F.col("adsh").endswith("7"), F.year("filed") < 1999
    for number, batch in enumerate((first & ~late, ~first & ~late, late)):
        current.update(obs.where(batch), number)
    return current.table(table)


@query
def census_of_arrivals(spark, d):
    return arrived(spark, d, "census")


@query
def events_of_arrivals(spark, d):
    return arrived(spark, d, "events")


@query
def freeze_first_filed(spark, d):
    return facts.freeze_first(bridge.observations(spark, d)).select("cik", "tag", "ddate", "qtrs", "uom", "adsh", "value")


@query
def frozen_events(spark, d):
    """By tag, the events of the facts, and those that are left once every fact keeps its first value: none."""
    obs = bridge.observations(spark, d)
    frozen = revisions.events(facts.freeze_first(obs)).groupBy("tag").agg(F.count("*").alias("n_frozen"))
    return revisions.events(obs).groupBy("tag").agg(F.count("*").alias("n_events")).join(frozen, "tag", "left").select("tag", "n_events", F.coalesce("n_frozen", F.lit(0)).alias("n_frozen"))


@query
def frozen_census(spark, d):
    """Every fact is still there once it keeps its first value, and none is revised."""
    frozen = revisions.census(facts.freeze_first(bridge.observations(spark, d)), CONFIG)
    return frozen.groupBy("tag").agg(F.count("*").alias("n_keys"), F.sum("n_obs").alias("n_obs"), F.count_if("revised").alias("n_revised"), F.sum("v_final").alias("sum_final"))


@query
def merged_conflicts(spark, d):
    return revisions.merged_conflicts(bridge.observations(spark, d), tag_map(spark))


@query
def merged_events(spark, d):
    return revisions.events(bridge.observations(spark, d), tag_map(spark)).select("cik", "tag", "ddate", "qtrs", "uom", "seq", "v_old", "v_new", "rel_delta", "adsh_old", "adsh_new", "lag_days", "version_changed")


@query
def merged_census(spark, d):
    return revisions.census(bridge.observations(spark, d), CONFIG, tag_map(spark)).select("cik", "tag", "ddate", "qtrs", "uom", "n_obs", "n_distinct_val", "v_first", "v_final", "revised", "left_censored")


# The twelve tables, and the bins of the figures.


@query
def rate_by_threshold(spark, d):
    _, c, e = tables(spark, d)
    return stats.rate_by_threshold(c, e)


@query
def magnitude_quantiles(spark, d):
    return stats.magnitude_quantiles(tables(spark, d)[1])


@query
def rel_delta_quantiles(spark, d):
    return stats.rel_delta_quantiles(tables(spark, d)[2])


@query
def census_composition(spark, d):
    return stats.census_composition(tables(spark, d)[1])


@query
def left_censoring_sources(spark, d):
    return stats.left_censoring_sources(tables(spark, d)[1])


@query
def lag_quantiles(spark, d):
    return stats.lag_quantiles(tables(spark, d)[2])


@query
def lag_bins(spark, d):
    return stats.lag_bins(tables(spark, d)[2])


@query
def rate_by_tag(spark, d):
    _, c, e = tables(spark, d)
    return stats.rate_by_tag(c, e)


@query
def rate_by_tag_highest(spark, d):
    return stats.rate_by_tag_highest(tables(spark, d)[1], least=100)


@query
def silent_vs_amendment(spark, d):
    return stats.silent_vs_amendment(tables(spark, d)[2])


@query
def version_and_scale_share(spark, d):
    return stats.version_and_scale_share(tables(spark, d)[2])


@query
def accepted_after_1600(spark, d):
    kept, _ = ingest.audited(*bridge.archive_members(spark, d))
    return stats.accepted_after_1600_share(ingest.typed(kept))


@query
def magnitude_histogram(spark, d):
    return stats.histogram(tables(spark, d)[1], "magnitude", 0.005, "revised and not from_zero and not ever_scale_change")


@query
def lag_histogram(spark, d):
    return stats.lag_histogram(tables(spark, d)[2])


# Renames.


@query
def usage_by_year(spark, d):
    return renames.usage(bridge.observations(spark, d))


@query
def dying_tags(spark, d):
    return renames.dying(renames.usage(renamed(spark, d)), RULES)


@query
def rising_tags(spark, d):
    return renames.rising(renames.usage(renamed(spark, d)), RULES)


def renamed(spark, d):
    """The facts that detection reads several times: derived here, so written once; a stored table is read as it is."""
    return Scratch(spark, "renamed").save(bridge.renamed(bridge.observations(spark, d)).select("cik", "adsh", "filed", "tag", "ddate", "qtrs", "uom", "value"), "facts")


def pairs(spark):
    return spark.createDataFrame([("Assets", "AssetsTotal"), ("EquityOther", "AssetsTotal"), ("NetIncomeLoss", "ProfitLoss"), ("Assets", "Absent")], "old_tag string, new_tag string")


@query
def successors(spark, d):
    obs = renamed(spark, d)
    used = renames.usage(obs)
    return renames.successors(obs, renames.dying(used, RULES), renames.rising(used, RULES), RULES)


@query
def agreement(spark, d):
    return renames.agreement(renamed(spark, d), pairs(spark)).withColumn("median_rel_diff", F.round("median_rel_diff", 12))


@query
def cooccurrence(spark, d):
    return renames.cooccurrence(renamed(spark, d), pairs(spark))


@query
def rename_candidates(spark, d):
    return renames.detect(renamed(spark, d), RULES).withColumn("median_rel_diff", F.round("median_rel_diff", 12))


@query
def rename_classes(spark, d):
    return renames.class_table(renames.detect(renamed(spark, d), RULES))


# The vintage experiment.


@query
def newest_period(spark, d):
    return vintage.newest_period(bridge.observations(spark, d).where((F.col("tag") == "Assets") & (F.col("ddate") <= F.lit(AS_OF)))).select("cik", "ddate", "value", "filed", "adsh", "uom")


@query
def universe_topn(spark, d):
    handle = vintage.world_pit(bridge.observations(spark, d), AS_OF)
    return vintage.universe(handle.as_of("Assets", 0, AS_OF), SIZE)


@query
def roe_zscore(spark, d):
    out = vintage.PROGRAM_FUNCTIONS["correct"](vintage.world_rev(bridge.observations(spark, d)), AS_OF, SIZE)
    return out.select("cik", F.round("value", 9).alias("value"))


@query
def programs_one_day(spark, d):
    """Every program as a function of (handle, day, n), on one day."""
    handle, out = vintage.world_rev(bridge.observations(spark, d)), None
    for name, run in vintage.PROGRAM_FUNCTIONS.items():
        part = run(handle, AS_OF, SIZE).select(F.lit(name).alias("program"), "cik", F.round("value", 9).alias("value"))
        out = part if out is None else out.unionAll(part)
    return out


def largest(read):
    """A program that a user might write: the companies with most assets, and how much they have."""
    return vintage.all_days(lambda db, day, n: vintage.universe(read(db, day), n))


#: Programs from outside the experiment: one reads the latest view, one the as-of view, one a year ahead.
USER_PROGRAMS = {
    "largest": largest(lambda db, day: db.latest("Assets", 0, day)),
    "largest_known": largest(lambda db, day: db.as_of("Assets", 0, day)),
    "largest_ahead": largest(lambda db, day: db.latest("Assets", 0, vintage.later(day, 365))),
}


@query
def panel_user(spark, d):
    return vintage.panel_of(USER_PROGRAMS, bridge.observations(spark, d), DAYS, SIZE)


@query
def truncation_user(spark, d):
    return vintage.truncation_of(USER_PROGRAMS, bridge.observations(spark, d), DAYS, POINTS, SIZE)


@query
def lambda_user(spark, d):
    out = vintage.lambdas(vintage.panel_of(USER_PROGRAMS, bridge.observations(spark, d), DAYS, SIZE))
    return out.withColumn("lambda_rank", F.round("lambda_rank", 9))


def panel_of(name: str):
    def run(spark, d):
        rows = vintage.panel(bridge.observations(spark, d), DAYS, SIZE).where(F.col("program") == name)
        return rows.select("world", "asof", "cik", F.round("value", 9).alias("value"))

    return run


for _name in vintage.PROGRAMS:
    QUERIES[f"panel_{_name}"] = panel_of(_name)


def full_panel(spark, d):
    return vintage.panel(bridge.observations(spark, d), DAYS, SIZE)


@query
def lambda_cell(spark, d):
    return vintage.lambdas(full_panel(spark, d)).select("program", "lambda_cell", "n_cells", "n_diff")


@query
def lambda_rank(spark, d):
    return vintage.lambdas(full_panel(spark, d)).select("program", F.round("lambda_rank", 9).alias("lambda_rank"))


@query
def lambda_by_date(spark, d):
    return vintage.lambda_by_date(full_panel(spark, d)).withColumn("lambda_rank", F.round("lambda_rank", 9))


@query
def truncation_check(spark, d):
    return vintage.truncation(bridge.observations(spark, d), DAYS, POINTS, SIZE)


@query
def verdict(spark, d):
    runs = Scratch(spark, "runs").save(vintage.runs(bridge.observations(spark, d), DAYS, POINTS, SIZE), "runs")
    return verdicts_of(runs, vintage.truncation_of_runs(runs, DAYS, POINTS))


def verdicts_of(runs: DataFrame, truncations: DataFrame) -> DataFrame:
    return vintage.verdicts(vintage.lambdas(vintage.panel_of_runs(runs)), truncations).withColumn("lambda_rank", F.round("lambda_rank", 9))


@query
def verdict_user(spark, d):
    """The whole experiment for programs from outside: one set of runs, from which panel and truncation both come."""
    runs = Scratch(spark, "runs").save(vintage.runs_of(USER_PROGRAMS, bridge.observations(spark, d), DAYS, POINTS, SIZE), "runs")
    return verdicts_of(runs, vintage.truncation_of_runs(runs, DAYS, POINTS, "value", list(USER_PROGRAMS)))


@query
def panel_of_functions(spark, d):
    """The built-in programs, run as a user's are: from their functions, over all days at once."""
    out = vintage.panel_of(vintage.PROGRAM_FUNCTIONS, bridge.observations(spark, d), DAYS, SIZE)
    return out.withColumn("value", F.round("value", 9))


@query
def restatement_control(spark, d):
    out = vintage.control(bridge.observations(spark, d), DAYS, SIZE)
    return out.withColumn("lambda_rank", F.round("lambda_rank", 9))


# Dates and the second source.


@query
def month_end(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(F.to_date("o_orderdate").alias("day")).distinct().select("day", scalar.month_end(F.col("day")).alias("month_end"))


@query
def qtrs_from_dates(spark, d):
    start, end = F.to_date("o_orderdate"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 500).cast("int"))
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.when(F.col("o_orderkey") % 5 != 0, start).alias("start"), end.alias("end"))
    return rows.groupBy(scalar.qtrs_between(F.col("start"), F.col("end")).alias("n_qtrs")).agg(F.count("*").alias("n_rows"))


def second_source(spark, d):
    """A copy of the facts with a third of the filings missing, some values off, some missing and some contradictory."""
    obs = bridge.observations(spark, d).where(F.substring("adsh", -1, 1).isin("0", "1", "2", "3", "4", "5", "6"))
    off = F.when(F.col("cik") % 11 == 3, F.col("value") * 1.5).when(F.col("cik") % 13 == 4, None).otherwise(F.col("value"))
    rows = obs.select(*crosscheck.MATCH_KEY, off.alias("value"))
    return rows.unionByName(rows.where("cik % 17 = 5").withColumn("value", F.col("value") + 1))


@query
def crosscheck_summary(spark, d):
    return crosscheck.summary(bridge.observations(spark, d), second_source(spark, d)).withColumn("conflict_rel_median", F.round("conflict_rel_median", 12))


@query
def crosscheck_conflicts(spark, d):
    return crosscheck.conflicts(bridge.observations(spark, d), second_source(spark, d))


@query
def json_flatten(spark, d):
    """Facts written as the second source writes them, one document a company, and read back."""
    return companyfacts.flattened(bridge.documents(bridge.observations(spark, d))).groupBy("cik", "tag", "uom").agg(F.count("*").alias("n_rows"), F.sum("qtrs").alias("sum_qtrs"), F.max("ddate").alias("last_ddate"), F.sum("value").alias("sum_value"))


@query
def json_flatten_whole(spark, d):
    """Every record of the second source's documents, as it comes out."""
    return companyfacts.flattened(bridge.documents(bridge.observations(spark, d))).select("cik", "tag", "uom", "ddate", F.col("qtrs").cast("int").alias("qtrs"), "filed", "value")


ORACLE_SQL: dict[str, str] = oracle.statements(AS_OF, CONFIG, DAYS, POINTS, SIZE, RULES)
