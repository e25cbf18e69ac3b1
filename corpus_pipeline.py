"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import minhash, packing, pii, spaced_seeds, toxicity
from tideline.llm.common import Scratch, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score under 0.5, with all columns. Nulls and empty texts stay, very long ones are read whole, repeated rows go or stay together, no rows give none."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least doc_id of each group at 0.8 of five-word shingles, with all columns. Texts without words stay, of repeated rows one stays, no rows give none."""
    return minhash.keep_one(docs)


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that overlap with no item of the benchmark, with all columns. Null and empty texts stay, very long ones are read whole, no rows give none."""
    return spaced_seeds.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by their kinds; n_chars follows the text. Null and empty texts stay as they are, repeated rows too, no rows give none."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document. Null and empty texts are a piece of the end id, long ones several, repeated rows are packed each, no rows give none."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontamination", reject_contaminated),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: The stages train models and assign sequences freely: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; a stage's intermediate tables, and its input, go once its result is written.

    Nulls in any column, empty and very long texts, ties, repeated rows, empty
    tables and further columns have the results that each stage states.
    """
    outer = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with Scratch(spark, name):
            result = outer.save(stage(spark, docs, sf_dir), f"stage-{name}")
        outer.drop(docs)
        docs = result
    return docs
