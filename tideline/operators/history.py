"""Versions with the days on which each was the one known: as-of views of any days without grouping the facts again.

A version is known from the day it is filed until the day the next version of
its fact is; the newest one has no end. Of versions filed on one day only the
last counts. The table is made by one distribution of the facts by business
key; every view of it after that is a filter or a join by days.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import BUSINESS_KEY

#: The end of what has no end: it compares like any other day, so files and row groups can be skipped by it.
OPEN = dt.date(9999, 12, 31)
SPAN = ("known_from", "known_to")
#: Folders of a stored history: the years in which versions become known and cease to be.
FOLDERS = ("from_year", "to_year")


def versions(facts: DataFrame) -> DataFrame:
    """``facts`` with known_from, known_to and rev, the newest version (value, filed, adsh) of the same fact; without the versions that no day shows."""
    series = Window.partitionBy(*BUSINESS_KEY)
    ordered = series.orderBy("filed", "adsh")
    newest = F.last(F.struct("value", "filed", "adsh")).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    seen = facts.where(F.col("filed").isNotNull()).withColumns({"known_from": F.col("filed"), "known_to": F.coalesce(F.lead("filed").over(ordered), F.lit(OPEN)), "rev": newest})
    return seen.where("known_from < known_to")


def write(versions_: DataFrame, path: str) -> None:
    """Store a history below from_year / to_year, sorted by days within: a view of a day opens the folders that can hold it."""
    out = versions_.withColumns({"from_year": F.year("known_from"), "to_year": F.year("known_to")})
    out.hint("rebalance", *FOLDERS).sortWithinPartitions(*FOLDERS, *SPAN).write.mode("overwrite").partitionBy(*FOLDERS).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def known(day: Column, columns: list[str]) -> Column:
    """Whether a version is known on a day; on the folders' years too, where there are any."""
    inside = (F.col("known_from") <= day) & (day < F.col("known_to"))
    return inside & (F.col("from_year") <= F.year(day)) & (F.year(day) <= F.col("to_year")) if set(FOLDERS) <= set(columns) else inside


def as_of(versions_: DataFrame, day: dt.date) -> DataFrame:
    """Each fact as it was known on a day."""
    return versions_.where(known(F.lit(day), versions_.columns)).drop(*SPAN, *FOLDERS, "rev")


def on_days(versions_: DataFrame, days: DataFrame) -> DataFrame:
    """``versions_`` beside each day, column ``asof`` of ``days``, on which it is known.

    A version meets the days of the years it lasts, of those asked for: a join
    by year. The days go to all executors: there are at most as many as the
    calendar has between the first and the last.
    """
    days = days.select("asof").where("asof is not null").distinct()
    ends = days.agg(F.year(F.min("asof")).alias("first"), F.year(F.max("asof")).alias("last")).first()
    if ends["first"] is None:
        return versions_.crossJoin(days.limit(0)).drop(*FOLDERS)
    first, last = F.greatest(F.year("known_from"), F.lit(ends["first"])), F.least(F.year("known_to"), F.lit(ends["last"]))
    by_year = versions_.where(first <= last).withColumn("in_year", F.explode(F.sequence(first, last)))
    of_year = F.broadcast(days.withColumn("of_year", F.year("asof")))
    met = by_year.join(of_year, (F.col("in_year") == F.col("of_year")) & (F.col("known_from") <= F.col("asof")) & (F.col("asof") < F.col("known_to")))
    return met.drop("in_year", "of_year", *FOLDERS)


def as_of_days(versions_: DataFrame, days: DataFrame) -> DataFrame:
    """Each fact as it was known on each of the days, beside the day."""
    return on_days(versions_, days).drop(*SPAN, "rev")


def diff_worlds_days(versions_: DataFrame, days: DataFrame) -> DataFrame:
    """For each day, the facts known on it whose value differs from the newest, null being a value."""
    complete = versions_.where(~F.greatest(*[F.col(c).isNull() for c in BUSINESS_KEY]) & ~F.col("value").eqNullSafe(F.col("rev.value")))
    return on_days(complete, days).select("asof", *BUSINESS_KEY, *[F.col(c).alias(f"{c}_pit") for c in ("value", "filed", "adsh")], *[F.col(f"rev.{c}").alias(f"{c}_rev") for c in ("value", "filed", "adsh")])
