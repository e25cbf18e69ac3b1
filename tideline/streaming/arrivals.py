"""Observations that arrive as files: appended to the table by quarter as a stream, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.facts import pick_latest
from ..operators.ingest import write
from ..schema import OBSERVATIONS


def stream(spark: SparkSession, arrivals: str) -> DataFrame:
    return spark.readStream.schema(OBSERVATIONS).parquet(arrivals)


def append(arriving: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch as a partition of its own; a batch that is run again replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        write(batch, table, f"batch{number}")

    return arriving.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_of(spark: SparkSession, table: str) -> DataFrame:
    """The latest view over all that has arrived."""
    return pick_latest(spark.read.parquet(table).drop("cik_bucket", "quarter"))
