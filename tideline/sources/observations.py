"""The observation table on disk."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..schema import OBSERVATION_COLUMNS, OBSERVATIONS
from . import files

STORED = T.StructType([*OBSERVATIONS.fields, T.StructField("cik_bucket", T.IntegerType()), T.StructField("quarter", T.StringType())])


def load(spark: SparkSession, config: Config, ciks: Sequence[int] | None = None, tags: Sequence[str] | None = None, ddate_max: dt.date | None = None, qtrs: int | None = None, years: Sequence[int] | None = None) -> DataFrame:
    """The observations, filtered in the scan. Years, and the buckets that a list of companies names, keep other directories from being opened."""
    if not files.exists(spark, config.observations):
        raise FileNotFoundError(f"no observations in {config.observations}; build them first")
    out = spark.read.schema(STORED).parquet(config.observations)
    if years is not None:
        out = out.where(F.col("filed_year").isin(list(years)))
    if ciks is not None:
        out = out.where(F.col("cik_bucket").isin(sorted({c % config.key_partitions for c in ciks})) & F.col("cik").isin(list(ciks)))
    if tags is not None:
        out = out.where(F.col("tag").isin(list(tags)))
    if ddate_max is not None:
        out = out.where(F.col("ddate") <= F.lit(ddate_max))
    if qtrs is not None:
        out = out.where(F.col("qtrs") == qtrs)
    return out.select(*OBSERVATION_COLUMNS)
