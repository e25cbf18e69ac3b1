from pyspark.sql import functions as F

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def tables(spark, d, *names):
    return [spark.read.parquet(f"{d}/{n}.parquet") for n in names]


def DOCS(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def docs_of(spark, rows, extra=False):
    """Documents of (doc_id, text); with ``extra``, columns whose names clash with what the operators make."""
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.char_length("text").cast("long"))
    if extra:
        for c in ("score", "shard", "node", "anchor", "row", "spans", "size", "key", "found_id", "start", "removed_id", "t1"):
            df = df.withColumn(c, F.lit(1))
    return df


def odd_documents(spark):
    """Nulls in any column, an empty and a very long text, ties and repeated rows, and clashing columns."""
    rows = [(1, ""), (2, None), (None, "no id here, at all, in this one"), (None, None), (3, "word"), (3, "word"), (4, "same text, same words " * 20), (5, "same text, same words " * 20), (6, "x" * 300_000), (7, "lorem ipsum " * 40_000), (8, "😀 äöü\n\n\t  ß")]
    df = docs_of(spark, rows, extra=True)
    return df.withColumn("lang", F.when(F.col("doc_id") != 4, F.col("lang"))).withColumn("source", F.when(F.col("doc_id") != 5, F.col("source")))
