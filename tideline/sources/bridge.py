"""Facts with a known shape, derived from the order lines of the test tables.

One order is one filing; there are amendments, an excluded form, comparatives,
nulls, zeros, jumps by a thousand, and duplicates and conflicts in one filing.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, quarters_between
from ..schema import MEMBERS
from . import files

#: The quarters in which the derived filings fall.
CONFIG = Config(quarters=quarters_between("1996q2", "2002q1"), universe_size=50)


def raw_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.col("l_orderkey")
    period = F.last_day(F.add_months(F.lit("1996-01-01").cast("date"), ((order * 7) % 24).cast("int") * 3 + 2))
    base = F.when(order % 50 == 0, 0).otherwise(
        1000 + (order % 97) * 13 % 977 + F.when(F.col("l_returnflag") == "A", 5000).when(F.col("l_returnflag") == "N", (order % 97) * 29 % 311).otherwise(0)
    )
    revised = F.when(F.col("l_discount") >= 0.09, F.col("l_quantity").cast("int")).otherwise(0)
    jump = F.when((F.col("l_tax") == 0.08) & (F.col("l_discount") < 0.02), 1000).otherwise(1)
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        (order % 97).cast("bigint").alias("cik"),
        F.lpad(order.cast("string"), 10, "0").alias("adsh"),
        F.when(order % 20 == 0, "10-K/A").when(order % 23 == 0, "10-Q/A").when(order % 4 == 1, "10-K").when(order % 31 == 0, "8-K").otherwise("10-Q").alias("form"),
        F.date_add(period, (30 + order % 30).cast("int")).alias("filed"),
        period.alias("period"),
        F.when(F.col("l_returnflag") == "A", "Assets").when(F.col("l_returnflag") == "N", "NetIncomeLoss").otherwise("StockholdersEquity").alias("tag"),
        F.concat(F.lit("us-gaap/"), (1996 + F.floor(((order * 7) % 24) / 4)).cast("int").cast("string")).alias("version"),
        F.last_day(F.add_months(F.lit("1996-01-01").cast("date"), ((order * 7) % 24).cast("int") * 3 + 2 - 12 * (F.col("l_linenumber") % 3).cast("int"))).alias("ddate"),
        F.when(F.col("l_returnflag") == "N", 4).otherwise(0).alias("qtrs"),
        F.when(F.col("l_linestatus") == "O", "USD").otherwise("shares").alias("uom"),
        F.when(F.col("l_discount") != 0.05, (base + revised) * jump).cast("double").alias("value"),
        F.col("l_partkey"),
        F.col("l_suppkey"),
    )


RAW_COLUMNS = ("cik", "adsh", "form", "filed", "period", "tag", "version", "ddate", "qtrs", "uom", "value")


def archive_members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sub, num, tag) as an archive would hold them: strings, with segments, odd quarters and custom tags among them."""
    raw = raw_facts(spark, sf_dir)
    sub = raw.select(
        "adsh",
        F.col("cik").cast("string").alias("cik"),
        "form",
        F.date_format("period", "yyyyMMdd").alias("period"),
        F.year("period").cast("string").alias("fy"),
        F.lit("FY").alias("fp"),
        F.date_format("filed", "yyyyMMdd").alias("filed"),
        F.concat(F.date_format(F.when(F.col("cik") % 7 == 0, F.date_sub("filed", 1)).otherwise(F.col("filed")), "yyyy-MM-dd"), F.lit(" "), (15 + F.col("cik") % 3).cast("string"), F.lit(":30:00.0")).alias("accepted"),
    ).distinct()
    num = raw.select(
        "adsh",
        "tag",
        "version",
        F.date_format("ddate", "yyyyMMdd").alias("ddate"),
        F.when(F.col("l_partkey") % 37 == 0, "7").when(F.col("l_partkey") % 41 == 0, "4.0").otherwise(F.col("qtrs").cast("string")).alias("qtrs"),
        "uom",
        F.when(F.col("l_suppkey") % 10 == 0, "Axis=Member;").when(F.col("l_suppkey") % 10 == 1, "  ").alias("segments"),
        F.when(F.col("l_suppkey") % 15 == 2, "PARENT").alias("coreg"),
        F.col("value").cast("string").alias("value"),
    )
    tag = raw.select("tag", "version", F.when((F.col("tag") == "StockholdersEquity") & (F.col("version") == "us-gaap/1999"), "1").otherwise("0").alias("custom")).distinct()
    return sub, num, tag


def renamed(observations: DataFrame) -> DataFrame:
    """Facts whose tags end and begin in 1999: one under a new name, one under a new name and with other values, and a new one that has nothing to do with the old ones."""
    new = F.col("filed") >= F.lit("1999-01-01").cast("date")
    tag = F.when(new & (F.col("tag") == "Assets"), "AssetsTotal").when(new & (F.col("tag") == "NetIncomeLoss"), "ProfitLoss").when(new & (F.col("tag") == "StockholdersEquity") & (F.col("cik") % 2 == 0), "EquityOther").otherwise(F.col("tag"))
    value = F.when(new & (F.col("tag") == "NetIncomeLoss"), F.col("value") * 1.75).otherwise(F.col("value"))
    return observations.withColumns({"tag": tag, "value": value})


def quarter_of(day: str) -> Column:
    """The quarter of a day written yyyyMMdd."""
    return F.concat(F.substring(day, 1, 4), F.lit("q"), F.ceil(F.substring(day, 5, 2).cast("int") / 3).cast("string"))


def archived(folder: str):
    """Writes the lines of each quarter, which come sorted by quarter and member, to its ZIP as they come; (quarter, uri)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt, open_, done = TaskContext.get().taskAttemptId(), {}, []

        def close() -> None:
            if open_:
                open_["member"].close()
                open_["zip"].close()
                open_["file"].close()
                files.moved(open_["part"], uri := f"{folder}/{open_['quarter']}.zip")
                done.append((open_["quarter"], uri))
                open_.clear()

        for batch in batches:
            for quarter, member, line in zip(*(c.to_pylist() for c in batch.columns)):
                if open_.get("quarter") != quarter:
                    close()
                    part = f"{folder}/{quarter}.zip.{attempt}"
                    file = files.created(part)
                    open_.update(quarter=quarter, part=part, file=file, zip=zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED, compresslevel=1), name=None)
                if open_["name"] != member:
                    if open_["name"]:
                        open_["member"].close()
                    open_.update(name=member, member=open_["zip"].open(member, "w"))
                    open_["member"].write(("\t".join(MEMBERS[member]) + "\n").encode())
                open_["member"].write((line + "\n").encode())
        close()
        yield pa.record_batch([pa.array(c, pa.string()) for c in list(zip(*done)) or [()] * 2], names=["quarter", "uri"])

    return run


def archives(spark: SparkSession, sf_dir: str, folder: str) -> dict[str, str]:
    """The members as ZIPs, one for each quarter of filing, written by the executors; quarter -> URI."""
    sub, num, tag = archive_members(spark, sf_dir)
    filings = sub.select("adsh", quarter_of("filed").alias("quarter"))
    num = num.join(filings, "adsh")
    by_member = {"sub.txt": sub.withColumn("quarter", quarter_of("filed")), "num.txt": num, "tag.txt": tag.join(num.select("quarter", "tag", "version").distinct(), ["tag", "version"])}
    out = None
    for member, rows in by_member.items():
        line = F.array_join(F.array(*[F.coalesce(F.col(c) if c in rows.columns else F.lit(None), F.lit("")).cast("string") for c in MEMBERS[member]]), "\t")
        part = rows.select("quarter", F.lit(member).alias("member"), line.alias("line"))
        out = part if out is None else out.unionAll(part)
    written = out.repartition("quarter").sortWithinPartitions("quarter", "member").mapInArrow(archived(folder), "quarter string, uri string")
    return {r["quarter"]: r["uri"] for r in written.collect()}  # a row for each quarter


def documents(observations: DataFrame) -> DataFrame:
    """(cik, json): observations in the form that ``flattened`` reads; a company's facts are one document, as at the source. There are few companies here, so documents grow with the data."""
    start = F.when(F.col("qtrs") > 0, F.date_format(F.date_add(F.add_months("ddate", -3 * F.col("qtrs")), 1), "yyyy-MM-dd"))
    record = F.struct(start.alias("start"), F.date_format("ddate", "yyyy-MM-dd").alias("end"), F.col("value").alias("val"), F.date_format("filed", "yyyy-MM-dd").alias("filed"))
    units = observations.select("cik", "tag", "uom", record.alias("r")).groupBy("cik", "tag", "uom").agg(F.collect_list("r").alias("records"))
    concepts = units.groupBy("cik", "tag").agg(F.map_from_entries(F.collect_list(F.struct("uom", "records"))).alias("units"))
    whole = concepts.groupBy("cik").agg(F.map_from_entries(F.collect_list(F.struct("tag", F.struct("units")))).alias("gaap"))
    return whole.select("cik", F.to_json(F.struct(F.create_map(F.lit("us-gaap"), F.col("gaap")).alias("facts"))).alias("json"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept facts: whitelisted forms, one row for a fact in a filing, none where the filing contradicts itself."""
    from ..operators.ingest import same_filing
    from ..schema import FORMS

    return same_filing(raw_facts(spark, sf_dir).select(*RAW_COLUMNS).where(F.col("form").isin(*FORMS)))
