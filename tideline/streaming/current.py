"""Census and events that follow arrivals: what a batch tells about is worked out anew, all else stays.

Observations are kept by the period they are about. A batch of filings speaks
of few periods, so only these folders are read, and of them only the series of
the facts that the batch names; the rows of all other facts are carried over.
Filings that come late, between or before others of a fact, change its series
like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..config import Config
from ..operators import revisions
from ..schema import BUSINESS_KEY
from ..scratch import Scratch
from ..sources import files

#: Folders: the year of the period (0 where there is none) and a part of the companies.
FOLDERS = ("period_year", "part")
PARTS = 16


def placed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"period_year": F.coalesce(F.year("ddate"), F.lit(0)), "part": F.coalesce(F.pmod("cik", F.lit(PARTS)), F.lit(0)).cast("int")})


def same_key(a: DataFrame, b: DataFrame) -> Column:
    """Facts are the same where their keys are, null being a value."""
    same = None
    for c in (*FOLDERS, *BUSINESS_KEY):
        one = a[c].eqNullSafe(b[c])
        same = one if same is None else same & one
    return same


class Current:
    """Tables under ``root`` that are, after each batch, what the batch operators make of all observations so far."""

    def __init__(self, spark: SparkSession, root: str, config: Config) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.makers: dict[str, Callable[[DataFrame], DataFrame]] = {"census": lambda facts: revisions.census(facts, config), "events": revisions.events}

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        reader = self.spark.read.schema(schema)
        return reader.parquet(self._path(name)) if files.exists(self.spark, self._path(name)) else self.spark.createDataFrame([], schema)

    def table(self, name: str) -> DataFrame:
        """"census" or "events", as of the last batch."""
        return self.spark.read.parquet(self._path(name)).drop(*FOLDERS)

    def update(self, batch: DataFrame, number: int) -> None:
        """Take in a batch of observations. One that is run again replaces itself."""
        with Scratch(self.spark, "batch") as scratch:
            batch = scratch.save(placed(batch), "arrived")
            told = scratch.save(batch.select(*FOLDERS, *BUSINESS_KEY).distinct(), "told")
            folders = told.select(*FOLDERS).distinct().collect()  # as many as there are folders
            if not folders:
                return
            here = F.struct(*FOLDERS).isin([F.struct(F.lit(r[0]), F.lit(r[1])) for r in folders]) if len(folders) < 200 else F.col("period_year").isin(sorted({r[0] for r in folders}))
            self._append(batch, number)
            kept = self._read("observations", T.StructType([*batch.schema.fields, T.StructField("batch", T.IntegerType())]))
            kept = kept.where(here).drop("batch")
            series = scratch.save(kept.join(told, same_key(kept, told), "left_semi"), "series").drop(*FOLDERS)
            for name, make in self.makers.items():
                fresh = placed(make(series))
                old = self._read(name, fresh.schema).where(here)
                rest = old.join(told, same_key(old, told), "left_anti")
                # Saved first: a table isn't read and replaced by one job.
                whole = scratch.save(rest.unionByName(fresh), name)
                self._replace(name, whole)

    def _append(self, batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("batch", F.lit(number))
        rows.hint("rebalance", *FOLDERS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*FOLDERS, "batch").parquet(self._path("observations"))

    def _replace(self, name: str, rows: DataFrame) -> None:
        rows.hint("rebalance", *FOLDERS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*FOLDERS).parquet(self._path(name))

    def follow(self, arriving: DataFrame, checkpoint: str) -> StreamingQuery:
        """Update with each micro-batch of a stream of observations."""
        return arriving.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
