"""Observations as a table bucketed for the keys they are grouped by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: What the business key and the primary key have in common: rows dealt by it serve groupings and windows over either.
BUCKET_KEY = ("tag", "ddate", "qtrs", "uom")


def write(observations: DataFrame, name: str, buckets: int, path: str | None = None) -> None:
    """Store observations as table ``name`` in ``buckets`` files by ``BUCKET_KEY``, each in the order of series.

    Events, census, latest and the key check over the table move no rows: a
    bucket holds whole series and whole primary keys. A table that is there is
    replaced. One bucket should fit a task: a few hundred MB.
    """
    # Dealt as the buckets are, so that each is one file.
    dealt = observations.repartition(buckets, *BUCKET_KEY)
    writer = dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, *BUCKET_KEY).sortBy(*BUCKET_KEY, "cik", "filed", "adsh")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def read(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
