"""The second source: nested JSON, one document a company."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scalar import month_end, qtrs_between
from . import fetched

log = logging.getLogger("tideline")
FACTS_URL = "https://data.sec.gov/api/xbrl/companyfacts/CIK{cik:010d}.json"
SCHEMA = "struct<facts:map<string,map<string,struct<units:map<string,array<struct<start:string,end:string,val:double,filed:string,accn:string,form:string>>>>>>>"


def read(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(cik, json) from files named CIK<digits>.json; what doesn't parse becomes null later on."""
    rows = spark.read.text(paths, wholetext=True)
    return rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"CIK0*(\d+)", 1).try_cast("bigint").alias("cik"), F.col("value").alias("json"))


def flattened(documents: DataFrame) -> DataFrame:
    """(cik, tag, uom, ddate, qtrs, filed, value) of every record; one with an unreadable end is skipped, a null value is kept."""
    parsed = documents.select("cik", F.from_json("json", SCHEMA).alias("j")).select("cik", F.explode(F.col("j.facts")["us-gaap"]).alias("tag", "concept"))
    units = parsed.select("cik", "tag", F.explode("concept.units").alias("uom", "records"))
    records = units.select("cik", "tag", "uom", F.explode("records").alias("r"))
    start, end = F.try_to_date("r.start", "yyyy-MM-dd"), F.try_to_date("r.end", "yyyy-MM-dd")
    rows = records.select("cik", "tag", "uom", start.alias("start"), end.alias("end"), F.try_to_date("r.filed", "yyyy-MM-dd").alias("filed"), F.col("r.val").alias("value"))
    return rows.where(F.col("end").isNotNull()).select("cik", "tag", "uom", month_end(F.col("end")).alias("ddate"), qtrs_between(F.col("start"), F.col("end")).alias("qtrs"), "filed", "value")


def fetch(spark: SparkSession, config: Config, ciks: Sequence[int], url: str = FACTS_URL) -> DataFrame:
    """(cik, json, source, error) of the companies, asked for by the executors where the shared folder doesn't hold them; faults are logged."""
    rate = 1 / config.rate_limit_sleep if config.rate_limit_sleep > 0 else 1000.0
    found = fetched.documents(spark, ciks, url, folder(config), per_second=rate, tries=config.max_retries, user_agent=config.user_agent)
    for r in found.where("error is not null").select("cik", "error").collect():  # this runs the requests; what came is in the folder
        log.warning("company %d: %s", r["cik"], r["error"])
    return found


def folder(config: Config) -> str:
    return config.table("raw", "companyfacts")


def series(documents_: DataFrame, cik: int, tag: str, uom: str, end: dt.date, start: dt.date | None = None) -> DataFrame:
    """(filed, accn, form, value) of every version of one fact as the source tells it, by its exact end, and its start where one is given."""
    parsed = documents_.where(F.col("cik") == cik).select(F.explode(F.from_json("json", SCHEMA)["facts"]["us-gaap"][tag]["units"][uom]).alias("r"))
    at = F.try_to_date("r.end", "yyyy-MM-dd") == F.lit(end)
    if start is not None:
        at = at & (F.try_to_date("r.start", "yyyy-MM-dd") == F.lit(start))
    return parsed.where(at).select(F.try_to_date("r.filed", "yyyy-MM-dd").alias("filed"), "r.accn", "r.form", F.col("r.val").alias("value")).orderBy("filed", "accn")


def known_case(series_: DataFrame, first: float, final: float) -> DataFrame:
    """One row: whether a fact that is known to have been rewritten shows its first and its final value, both kept, and without an amendment."""
    order = F.struct("filed", "accn")
    ends = series_.agg(
        F.count("*").alias("n_versions"),
        F.min_by("value", order).alias("first_value"),
        F.max_by("value", order).alias("final_value"),
        F.count_distinct("value").alias("n_values"),
        F.coalesce(~F.bool_or(F.col("form").endswith("/A")), F.lit(False)).alias("silent"),
        F.date_diff(F.max("filed"), F.min("filed")).alias("lag_days"),
    )
    checks = {"first_as_expected": F.col("first_value") == first, "final_as_expected": F.col("final_value") == final, "both_kept": F.col("n_values") >= 2}
    out = ends.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in checks.items()})
    return out.withColumn("holds", F.col("first_as_expected") & F.col("final_as_expected") & F.col("both_kept") & F.col("silent"))
