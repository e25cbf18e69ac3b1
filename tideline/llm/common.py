"""What the operators share: tables of the corpus, safe column picks, joins by name, places in an order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus; one in fewer pieces than there are cores is dealt out, as its rows cost more than their move."""
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name in ("documents", "pages") and rows.rdd.getNumPartitions() < cores else rows


#: Texts that a task works on at once; Spark bounds the bytes of the batches that these are cut from.
PIECE = 512


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches from Spark in pieces of some hundred rows, as a row is a whole text; no setting of the session is touched."""
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            yield batch.slice(at, PIECE)


def pick(df: DataFrame, name: str, kind: str) -> Column:
    """Column ``name`` as ``kind``, or a typed null where the table has no such column."""
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)


def crc_remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``: fixes the folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(mod)


#: Rows of two numbers that are sent to every executor at most; more are joined by a shuffle.
MAX_BROADCAST_ROWS = 300_000


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it is counted to be small enough."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


def named(docs: DataFrame, names: DataFrame, how: str) -> DataFrame:
    """``docs`` joined with the rows named by (doc_id, text_key) in ``names``, by a semi or an anti join, with all their columns."""
    names = names.select(F.col("doc_id").alias("named_id"), F.col("text_key").alias("named_key"))
    same = docs["doc_id"].cast("long").eqNullSafe(names["named_id"]) & (text_key(docs["text"]) == names["named_key"])
    return docs.join(small(names), same, how)


#: Rows of one key that a join leaves in one task, and the most keys that it takes apart.
SPREAD, MOST_SPREAD = 1024, 20_000


def spread_join(rows: DataFrame, keyed: DataFrame, key: list[str], count: str, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed``, one row for each ``key`` with the ``count`` of its rows, without meeting in one task where a key is frequent.

    Keys of more than SPREAD rows (of more than a MOST_SPREADth of all, if that
    is more) have their row of ``keyed`` copied to several ways, and their rows
    are dealt over the ways by the hash of ``by``. So the frequent keys are
    MOST_SPREAD at most, which bounds what is broadcast. Null keys meet
    nothing; ``keyed`` should be a saved table, as it is read three times.
    """
    least = max(SPREAD, (keyed.agg(F.sum(count)).first()[0] or 0) // MOST_SPREAD)
    ways = F.greatest(F.ceil(F.col(count) / least), F.lit(1)).cast("int")
    frequent = keyed.where(F.col(count) > least).select(*key, ways.alias("ways"))
    copied = keyed.withColumn("way", F.explode(F.sequence(F.lit(0), ways - 1)))
    if frequent.isEmpty():
        return rows.join(keyed, key, how).drop(count)
    way = F.coalesce(F.pmod(F.xxhash64(by), F.col("ways")).cast("int"), F.lit(0))
    return rows.join(F.broadcast(frequent), key, "left").withColumn("way", way).drop("ways").join(copied, [*key, "way"], how).drop("way", count)


def place_in_order(ordered: DataFrame, scratch: Scratch, size: str | None = None) -> DataFrame:
    """``ordered``, saved, with ``before``: the rows, or the sum of ``size``, ahead of a row in its sort order.

    Rows are counted per task of the sort and then shifted by what the tasks
    before hold, so the whole order never meets in one task.
    """
    saved = scratch.save(ordered.withColumn("place", F.monotonically_increasing_id()), "ordered")
    run = F.shiftright("place", 33)
    amount = F.count("*") if size is None else F.sum(size)
    ahead = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = saved.groupBy(run.alias("run")).agg(amount.alias("amount")).select("run", F.coalesce(F.sum("amount").over(ahead), F.lit(0)).alias("run_start"))  # a row for each task
    placed = saved.withColumn("run", run).join(F.broadcast(starts), "run")
    if size is None:
        inside = F.col("place").bitwiseAND((1 << 33) - 1)
    else:
        inside = F.coalesce(F.sum(size).over(Window.partitionBy("run").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("before", F.col("run_start") + inside).drop("run", "run_start", "place")
