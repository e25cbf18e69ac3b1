"""Concepts that go on under another name, inferred from the facts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio, relative_delta

SLOT = ("cik", "ddate", "qtrs", "uom")


@dataclass(frozen=True)
class Rules:
    """When a tag is dying or rising, and when a successor is accepted."""

    min_peak: int = 2000
    decay: float = 0.02
    growth: float = 3.0
    recent: tuple[int, int] = (2024, 2026)
    early: int = 2013
    min_agreement: float = 0.20
    max_median: float = 0.20
    min_shared: int = 200
    min_support: int = 50
    top: int = 5


def usage(facts: DataFrame) -> DataFrame:
    """(year, tag, n): observations filed in each year."""
    return facts.groupBy(F.year("filed").alias("year"), "tag").agg(F.count("*").alias("n"))


def recent(rules: Rules):
    return F.coalesce(F.sum(F.when(F.col("year").between(*rules.recent), F.col("n"))), F.lit(0)).alias("recent")


def dying(used: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(tag, peak, recent): once in wide use, now almost gone."""
    return used.groupBy("tag").agg(F.max("n").alias("peak"), recent(rules)).where((F.col("peak") >= rules.min_peak) & (F.col("recent") < rules.decay * F.col("peak")))


def rising(used: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(tag, early, recent): in wide use now, and far more than early on."""
    early = F.coalesce(F.sum(F.when(F.col("year") <= rules.early, F.col("n"))), F.lit(0)).alias("early")
    return used.groupBy("tag").agg(early, recent(rules)).where((F.col("recent") >= rules.min_peak) & (F.col("recent") > rules.growth * F.col("early")))


def successors(facts: DataFrame, old: DataFrame, new: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(old_tag, new_tag, support_ciks): rising tags on a dying tag's slots after its last filing there; the best few of each.

    All dying tags at once. A slot's tags are sorted by their last filing once,
    and each rising one takes the dying ones that ended before it: the facts are
    moved once, and no pair is made that the days rule out. Null parts of a slot match nothing.
    """
    roles = old.select("tag", F.lit(True).alias("ends")).join(new.select("tag", F.lit(True).alias("begins")), "tag", "full_outer")
    ended = facts.dropna(subset=[*SLOT, "filed"]).join(roles, "tag").groupBy("tag", "ends", "begins", *SLOT).agg(F.max("filed").alias("last"))
    before = Window.partitionBy(*SLOT).orderBy(F.unix_date("last")).rangeBetween(Window.unboundedPreceding, -1)
    met = ended.withColumn("old_tag", F.collect_list(F.when(F.col("ends"), F.col("tag"))).over(before)).where("begins")
    met = met.select(F.explode("old_tag").alias("old_tag"), F.col("tag").alias("new_tag"), "cik").where("new_tag <> old_tag")
    support = met.select("old_tag", "new_tag", "cik").distinct().groupBy("old_tag", "new_tag").agg(F.count("*").alias("support_ciks"))
    place = F.row_number().over(Window.partitionBy("old_tag").orderBy(F.desc("support_ciks"), "new_tag"))
    return support.withColumn("place", place).where(F.col("place") <= rules.top).drop("place")


def final_values(facts: DataFrame) -> DataFrame:
    """The latest value of each tag and slot."""
    return facts.groupBy("tag", *SLOT).agg(F.max_by(F.struct("value"), F.struct("filed", "adsh"))["value"].alias("value"))


def agreement(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(old_tag, new_tag, shared_keys, exact_agreement, median_rel_diff) of each pair, over slots where both have a value."""
    values = final_values(facts).where(F.col("value").isNotNull())
    pairs = pairs.select("old_tag", "new_tag").distinct()
    a = values.select(F.col("tag").alias("old_tag"), *SLOT, F.col("value").alias("va")).join(pairs, "old_tag")
    b = values.select(F.col("tag").alias("new_tag"), *SLOT, F.col("value").alias("vb"))
    shared = a.join(b, ["new_tag", *SLOT]).withColumn("rel", relative_delta(F.col("va"), F.col("vb")))
    found = shared.groupBy("old_tag", "new_tag").agg(F.count("*").alias("n"), F.count_if(F.col("rel") < 1e-9).alias("exact"), F.median("rel").alias("median"))
    return pairs.join(found, ["old_tag", "new_tag"], "left").select(
        "old_tag", "new_tag", F.coalesce("n", F.lit(0)).cast("long").alias("shared_keys"), F.coalesce(ratio(F.col("exact"), F.col("n")), F.lit(0.0)).alias("exact_agreement"), F.coalesce("median", F.lit(1.0)).alias("median_rel_diff")
    )


def cooccurrence(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(old_tag, new_tag, cooccurrence): filings with both over filings with the rarer one; 1 if one is absent."""
    pairs = pairs.select("old_tag", "new_tag").distinct()
    named = facts.select("adsh", "tag").distinct()
    counts = named.groupBy("tag").agg(F.count("*").alias("n"))
    both = named.toDF("adsh", "old_tag").join(pairs, "old_tag").join(named.toDF("adsh", "new_tag"), ["adsh", "new_tag"]).groupBy("old_tag", "new_tag").agg(F.count("*").alias("both"))
    out = pairs.join(counts.toDF("old_tag", "n_old"), "old_tag", "left").join(counts.toDF("new_tag", "n_new"), "new_tag", "left").join(both, ["old_tag", "new_tag"], "left")
    rarer = F.when(F.col("n_old").isNotNull() & F.col("n_new").isNotNull(), F.least("n_old", "n_new"))
    return out.select("old_tag", "new_tag", F.coalesce(ratio(F.coalesce("both", F.lit(0)), rarer), F.lit(1.0)).alias("cooccurrence"))


def detect(facts: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The candidate renames with their evidence, and whether each is accepted."""
    used = usage(facts)
    old, new = dying(used, rules), rising(used, rules)
    found = successors(facts, old, new, rules).where(F.col("support_ciks") >= rules.min_support)
    out = found.join(old.toDF("old_tag", "old_peak", "old_recent"), "old_tag").join(agreement(facts, found), ["old_tag", "new_tag"]).join(cooccurrence(facts, found), ["old_tag", "new_tag"])
    ok = (F.col("shared_keys") >= rules.min_shared) & (F.col("exact_agreement") >= rules.min_agreement) & (F.col("median_rel_diff") <= rules.max_median)
    return out.select("old_tag", "new_tag", "old_peak", "old_recent", "support_ciks", "shared_keys", "exact_agreement", "median_rel_diff", "cooccurrence", ok.alias("accepted"))


def classes(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """Tag -> the greatest name of its class, for accepted (old, new) pairs."""
    members: dict[str, set[str]] = {}
    for a, b in pairs:
        joined = members.get(a, {a}) | members.get(b, {b})
        for tag in joined:
            members[tag] = joined
    return {tag: max(group) for tag, group in members.items()}


def class_table(renames: DataFrame) -> DataFrame:
    """(tag, representative) of the accepted pairs, which are few: names of a taxonomy that passed detection."""
    pairs = [(r["old_tag"], r["new_tag"]) for r in renames.where("accepted").select("old_tag", "new_tag").collect()]
    return renames.sparkSession.createDataFrame(sorted(classes(pairs).items()), "tag string, representative string")
