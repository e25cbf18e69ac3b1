"""From archive members to observations, every dropped row accounted for."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import blank
from ..schema import BUCKETS, BUSINESS_KEY, FILING_KEY, FORMS, OBSERVATION_COLUMNS, QTRS

#: Reasons in the order they are tried.
REASONS = ("drop_segments", "drop_qtrs", "drop_form", "drop_custom", "drop_ambiguous", "drop_duplicate", "kept")


class ConservationError(RuntimeError):
    """The rows dropped and kept don't add up to the rows read."""


def agreement(value: str) -> tuple[list[Column], Column]:
    """(aggregates, whether a group's values are one and the same), null being a value; no second pass for distinct values."""
    parts = [F.min(value).alias("low"), F.max(value).alias("high"), F.max(F.col(value).isNull()).alias("gap")]
    # With no null, one value means the least is the greatest; with a null, no other value may be there.
    return parts, F.when(F.col("gap"), F.col("low").isNull()).otherwise(F.col("low") == F.col("high"))


def same_filing(facts: DataFrame) -> DataFrame:
    """One row for each fact of a filing; none where its values differ, null being a value.

    The rows are dealt by business key alone, which serves this aggregation and
    any later window or aggregation over the business key.
    """
    rest = [c for c in ("form", "filed", "period", "version", "value", "accepted", "fy", "fp") if c in facts.columns]
    dealt = facts.repartition(*BUSINESS_KEY)
    parts, agree = agreement("value")
    return dealt.groupBy(*FILING_KEY).agg(*[F.min(c).alias(c) for c in rest], *parts).where(agree).select(*FILING_KEY, *rest)


def custom_tags(tag: DataFrame) -> DataFrame:
    """The tags that filers made up, once each."""
    by = [c for c in ("quarter",) if c in tag.columns]
    return tag.where(F.col("custom") == "1").select(*by, "tag", "version").distinct()


def without_custom(num: DataFrame, tag: DataFrame) -> DataFrame:
    """The rows of ``num`` under tags of the taxonomy."""
    names = custom_tags(tag)
    return num.join(names, names.columns, "left_anti")


CARRIED = ("cik", "form", "period", "fy", "fp", "filed", "accepted", "version")


def judged(sub: DataFrame, num: DataFrame, tag: DataFrame) -> DataFrame:
    """Every row of ``num``, in groups: (reason, the fact's columns, n_rows, n_values).

    A group is a fact of a filing that passes all filters, its reason null, or
    all rows dropped for one reason. Contradictions within a filing are judged
    on the value's text; identical rows take the least version. Filings outside
    ``sub`` or its whitelisted forms are dropped by form. Where the tables have
    a column ``quarter``, each quarter is judged by itself.
    """
    by = [c for c in ("quarter",) if c in num.columns]
    eligible = sub.where(F.col("form").isin(*FORMS)).select(*by, *[c for c in ("adsh", *CARRIED) if c in sub.columns])
    custom = custom_tags(tag).withColumn("custom_tag", F.lit(True))
    rows = num.withColumn("n_qtrs", F.col("qtrs").try_cast("int")).join(eligible.withColumn("eligible", F.lit(True)), [*by, "adsh"], "left").join(custom, [*by, "tag", "version"], "left")
    reason = (
        F.when(~(blank(F.col("segments")) & blank(F.col("coreg"))), "drop_segments")
        .when(~F.coalesce(F.col("n_qtrs").isin(*QTRS), F.lit(False)), "drop_qtrs")
        .when(F.col("eligible").isNull(), "drop_form")
        .when(F.col("custom_tag").isNotNull(), "drop_custom")
    )
    rows = rows.withColumn("reason", reason).drop("qtrs").withColumnRenamed("n_qtrs", "qtrs")
    key = ["adsh", "tag", "ddate", "qtrs", "uom"]
    rows = rows.withColumns({c: F.when(F.col("reason").isNull(), F.col(c)) for c in key})  # dropped rows are only counted
    parts, agree = agreement("value")
    groups = rows.groupBy(*by, "reason", *key).agg(F.count("*").alias("n_rows"), F.min("value").alias("value"), *[F.min(c).alias(c) for c in CARRIED if c in rows.columns], *parts)
    return groups.withColumn("agree", agree).drop("low", "high", "gap")


def counts_of(judged_: DataFrame) -> DataFrame:
    """(reason, n_rows) for every reason, of each quarter if there are quarters; they sum to the rows read."""
    by = [c for c in ("quarter",) if c in judged_.columns]
    rows, passed, agree = F.col("n_rows"), F.col("reason").isNull(), F.col("agree")
    told = {r: F.when(F.col("reason") == r, rows) for r in REASONS} | {
        "drop_ambiguous": F.when(passed & ~agree, rows),
        "drop_duplicate": F.when(passed & agree, rows - 1),
        "kept": F.when(passed & agree, F.lit(1)),
    }
    sums = judged_.groupBy(*by).agg(*[F.sum(c).alias(r) for r, c in told.items()])
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("reason"), F.coalesce(r, F.lit(0)).cast("long").alias("n_rows")) for r in REASONS]))
    return sums.select(*by, each.alias("c")).select(*by, "c.*")


def kept_of(judged_: DataFrame) -> DataFrame:
    return judged_.where(F.col("reason").isNull() & F.col("agree")).drop("reason", "agree", "n_rows")


def audited(sub: DataFrame, num: DataFrame, tag: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows kept, counts): of identical rows one is kept, of contradictory ones none."""
    groups = judged(sub, num, tag)
    return kept_of(groups), counts_of(groups)


def typed(kept: DataFrame) -> DataFrame:
    """The kept rows in the observation table's columns and types; what can't be read is null."""

    def day(c: str) -> Column:
        return F.try_to_date(c, "yyyyMMdd")

    return kept.select(
        F.col("cik").try_cast("bigint").alias("cik"),
        "adsh",
        "form",
        day("filed").alias("filed"),
        F.col("accepted").try_cast("timestamp_ntz").alias("accepted"),
        day("period").alias("period"),
        F.col("fy").try_cast("int").alias("fy"),
        "fp",
        "tag",
        "version",
        day("ddate").alias("ddate"),
        F.col("qtrs").cast("tinyint").alias("qtrs"),
        "uom",
        F.col("value").try_cast("double").alias("value"),
        *[c for c in ("quarter",) if c in kept.columns],
    ).withColumn("filed_year", F.year("filed")).select(*OBSERVATION_COLUMNS, *[c for c in ("quarter",) if c in kept.columns])


def checked_counts(counts: DataFrame, total: Mapping[str, int]) -> dict[str, dict[str, int]]:
    """The counts of each quarter as numbers; raises unless they add up to the rows read of it."""
    got: dict[str, dict[str, int]] = {q: dict.fromkeys(REASONS, 0) for q in total}
    for r in counts.collect():  # a row for each quarter and reason
        got[r["quarter"]][r["reason"]] = r["n_rows"]
    for quarter, told in got.items():
        if sum(told.values()) != total[quarter]:
            raise ConservationError(f"{quarter}: {total[quarter]} rows read, {sum(told.values())} accounted for")
        told["total_in"] = total[quarter]
    return got


#: Beside its folders, how a table of observations is laid out: sorted by company, so that row groups hold few of them, with a Bloom filter of the filings of each row group.
LAYOUT = {"parquet.bloom.filter.enabled#adsh": "true", "parquet.bloom.filter.expected.ndv#adsh": "20000"}
ORDER = ("cik", "tag", "ddate", "filed")


def write(observations: DataFrame, path: str, quarter: str | None = None, buckets: int = BUCKETS, row_group: int | None = None) -> None:
    """Write quarters under filed_year / cik_bucket / quarter; a second run replaces these quarters and nothing else.

    ``quarter`` names all rows; without it they have a column of that name.
    ``row_group`` is the size of row groups in bytes, by default Parquet's own.
    """
    named = observations if quarter is None else observations.withColumn("quarter", F.lit(quarter))
    folders = ("filed_year", "cik_bucket", "quarter")
    out = named.where(F.col("filed").isNotNull()).withColumn("cik_bucket", F.pmod("cik", F.lit(buckets)).cast("int"))
    # Dealt by folder, large folders over several tasks and small ones together, as the sizes turn out.
    out = out.hint("rebalance", *folders).sortWithinPartitions(*folders, *ORDER)
    options = LAYOUT | ({"parquet.block.size": str(row_group)} if row_group else {})
    out.write.mode("overwrite").options(**options).option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)
