"""Personal data by weak supervision, in DataFrame expressions only.

Base spans follow fixed patterns. Candidates beside them are judged by
labelers (pattern, gazetteer or checksum, context for and against) that vote or
abstain. Expectation-maximisation over the counts of vote patterns estimates
how reliable each labeler is; its posteriors train a logistic classifier of
spans, and the candidates it accepts are added to the base spans. What reaches
the driver are counts of vote and feature patterns: a product of small sets,
however many documents there are.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pick

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "person")

# The base patterns, so written that no start is tried twice within a run and no repeat of a group can exhaust the stack:
# a match starts where no sign of its run precedes it, or where the last match ended, and its greedy parts give nothing back.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# Of a run of digits with single separators, all or nothing: 13 to 19 digits.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

# Candidates beside the base: long keys with digits, phones without a plus, written-out addresses, two capitalised words or a title and a name.
EXTRA = "|".join(
    (
        r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]{20})[A-Za-z_-]*+[0-9][A-Za-z0-9_-]*+",
        r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z0-9-]++)++",
        r"(?<![\p{L}0-9])(?:Mrs?|Ms|Dr|Prof)\.?\x20[A-Z][a-z]++(?:\x20[A-Z][a-z]++)?",
        r"(?<![\p{L}0-9.!?]\x20)(?<![\p{L}0-9])[A-Z][a-z]++\x20[A-Z][a-z]++(?![\p{L}0-9])",
    )
)

# What no text with such a candidate lacks; far cheaper than the candidates themselves.
MAYBE_EXTRA = r"[0-9]|[A-Z][a-z]+\.?\x20[A-Z][a-z]|[(\[]at[)\]]"

# Fixed values of the gazetteers.
TOP_DOMAINS = "com org net edu gov mil int info io co uk de fr es it nl eu ru cn jp br in au ca ch at be se no dk fi pl pt us".split()
GIVEN_NAMES = "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Betty Mark Margaret Paul Sandra Steven Ashley Andrew Emily Joshua Donna Anna Peter Hans Klaus Sabine Monika Pierre Jean Marie Claire Luis Carlos Maria Carmen Jose Ana Pedro".split()
CUES = {
    "email": "mail|contact|write|address",
    "ip": "ip|host|server|address|client",
    "card": "card|visa|mastercard|amex|credit|debit|account",
    "phone": "tel|phone|call|mobile|fax|cell",
    "secret": "token|key|secret|password|passwd|pwd|auth|credential",
    "person": "name|mr|mrs|dr|dear|author|by",
}
AGAINST = "version|order|serial|isbn|page|chapter|figure|build|release|section"

#: Two noncharacters: one marks the ends of matches, the other stands in for it where a text has it.
MARK, UNMARK = "\ufdd0", "\ufdd1"
#: Items that are scanned at once, and code points of a piece of text.
BLOCK, PIECE = 256, 1024
SPANS = "array<struct<place:int,start:int,end:int,kind:string>>"


def scanned(rows: DataFrame, items: str, name: str, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """``rows`` with ``name``: for each item of an array of int, what ``combine`` makes of 0 and all items before it.

    Linear in the items: each block is scanned on its own and then combined
    with what the blocks before it come to.
    """

    def step(acc: Column, x: Column) -> Column:
        return F.struct(combine(acc["all"], x).alias("all"), F.array_append(acc["out"], acc["all"]).alias("out"))

    start = F.struct(F.lit(0).alias("all"), F.array().cast("array<int>").alias("out"))
    last = F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.aggregate(F.slice(F.col(items), k * BLOCK + 1, F.lit(BLOCK)), start, step))
    made = rows.withColumn(f"{name}_blocks", blocks)
    ahead = F.aggregate(F.transform(f"{name}_blocks", lambda b: b["all"]), start, step, lambda acc: acc["out"])
    made = made.withColumn(name, F.flatten(F.zip_with(f"{name}_blocks", ahead, lambda b, a: F.transform(b["out"], lambda v: combine(v, a)))))
    return made.drop(f"{name}_blocks")


def marked(text: Column, pattern: str, maybe: Column) -> Column:
    """The text cut at its matches: stretch, match, stretch, ..., stretch; ``maybe`` is a cheap test that no match fails. The pattern runs once."""
    return F.when(maybe, F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)).otherwise(F.array(text))


def parts_of(pieces: Column, place: int) -> Column:
    """Each stretch with the match that follows it; the last has none."""

    def part(k: Column) -> Column:
        before, value = F.get(pieces, k * 2), F.get(pieces, k * 2 + 1)
        return F.struct(F.lit(place).alias("place"), F.char_length(before).alias("gap"), F.char_length(F.coalesce(value, F.lit(""))).alias("n"), value.alias("value"), F.right(before, F.lit(24)).alias("left"))

    return F.transform(F.sequence(F.lit(0), F.floor(F.size(pieces) / 2).cast("int")), part)


def sum_since_reset(a: Column, b: Column) -> Column:
    """Sums that begin anew: -1 - x stands for a reset followed by x, so the last part of a pattern, -1, sets the next one back to 0."""
    return F.when(b < 0, b).when(a < 0, a - b).otherwise(a + b)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.call_function("luhn_check", digits(value))
    if kind == "phone":
        return F.char_length(digits(value)).between(9, 15)
    return F.lit(True)


def extra_kind(value: Column) -> Column:
    return (
        F.when(value.rlike(r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$"), F.lit("phone"))
        .when(value.rlike(r"[(\[]at[)\]]"), F.lit("email"))
        .when(value.rlike(r"^[A-Z][a-z]+\.?\x20[A-Z][a-z]"), F.lit("person"))
        .otherwise(F.lit("secret"))
    )


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0).cast("int")


def any_kind(kind: Column, tests: dict[str, Column]) -> Column:
    out = F.lit(False)
    for k, test in tests.items():
        out = out | ((kind == k) & test)
    return F.coalesce(out, F.lit(False))


def labelled(s: Column) -> Column:
    """A candidate with its votes and the classifier's features."""
    kind, value, left = s["kind"], s["value"], F.lower(s["left"])
    n = F.char_length(value)
    share = F.char_length(digits(value)) / F.greatest(n, F.lit(1))
    never = F.lit(False)
    pattern = vote(
        any_kind(kind, {"email": value.rlike("@|[(\\[]at[)\\]]"), "ip": F.lit(True), "card": F.lit(True), "phone": F.lit(True), "secret": value.rlike("^(?:[0-9a-f]{32,64}|[A-Za-z0-9_-]{24,})$"), "person": value.rlike(r"^(?:Mrs?|Ms|Dr|Prof)\b")}),
        any_kind(kind, {"secret": value.rlike("^[A-Za-z-]+[0-9]{1,4}$")}),
    )
    gazetteer = vote(
        any_kind(kind, {"email": F.lower(value).rlike(rf"(?:\.|dot[)\]]\x20?)(?:{'|'.join(TOP_DOMAINS)})$"), "ip": valid("ip", value), "card": valid("card", value), "phone": valid("phone", value) | value.rlike(r"^\(?[2-9]"), "person": value.rlike(rf"(?:^|\x20)(?:{'|'.join(GIVEN_NAMES)})\b")}),
        any_kind(kind, {"ip": ~valid("ip", value), "card": ~valid("card", value), "phone": ~valid("phone", value) & value.startswith("+"), "person": ~value.rlike(rf"(?:^|\x20)(?:{'|'.join(GIVEN_NAMES)})\b")}),
    )
    cue = any_kind(kind, {k: left.rlike(rf"(?<![a-z])(?:{words})(?![a-z])") for k, words in CUES.items()})
    against = left.rlike(rf"(?<![a-z])(?:{AGAINST})(?![a-z])")
    return F.struct(
        s["start"].alias("start"),
        s["end"].alias("end"),
        kind.alias("kind"),
        (s["based"] & any_kind(kind, {k: valid(k, value) for k in BASE})).alias("base"),
        F.array(pattern, gazetteer, vote(cue, never), vote(never, against)).alias("votes"),
        F.least(F.floor(F.log2(n.cast("double"))), F.lit(6)).cast("int").alias("size"),
        F.floor(share * 3).cast("int").alias("digits"),
        F.when(F.char_length(left) == 0, 0).when(left.rlike(r"\s$"), 1).when(left.rlike(r"[\"'=:(\[]$"), 2).otherwise(3).cast("int").alias("edge"),
        cue.alias("cue"),
        (pattern > 0).alias("strict"),
        (gazetteer > 0).alias("listed"),
    )


def reliabilities(counts: dict[tuple[str, tuple], float], rounds: int = 50) -> dict[tuple[str, tuple], float]:
    """P(personal | kind, votes) by expectation-maximisation; labelers share their rates over kinds, each kind has its own prior.

    Rates are smoothed towards a labeler that is right four times in five.
    """
    n_labelers = len(next(iter(counts))[1]) if counts else 0
    posterior = {k: min(max(0.5 + 0.2 * sum(k[1]), 0.05), 0.95) for k in counts}
    for _ in range(rounds):
        mass, prior = defaultdict(float), defaultdict(float)
        for (kind, votes), n in counts.items():
            p = posterior[kind, votes]
            prior[kind, 1] += n * p
            prior[kind, 0] += n * (1 - p)
            for j, v in enumerate(votes):
                if v:
                    mass[j, 1, v] += n * p
                    mass[j, 0, v] += n * (1 - p)
        rate = {}
        for j in range(n_labelers):
            for truth in (0, 1):
                good, bad = (1, -1) if truth else (-1, 1)
                total = mass[j, truth, 1] + mass[j, truth, -1]
                rate[j, truth, good] = (mass[j, truth, good] + 8) / (total + 10)
                rate[j, truth, bad] = (mass[j, truth, bad] + 2) / (total + 10)
        for kind, votes in counts:
            half = (prior[kind, 1] + prior[kind, 0]) / 2 + 1  # a prior of 3 to 1 at most: votes outweigh it
            odds = math.log((prior[kind, 1] + half) / (prior[kind, 0] + half))
            odds += sum(math.log(rate[j, 1, v] / rate[j, 0, v]) for j, v in enumerate(votes) if v)
            posterior[kind, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return posterior


def feature_names(kind: str, size: int, digit: int, edge: int, cue: bool, strict: bool, listed: bool) -> list[str]:
    return [f"kind={kind}", f"size={kind}:{size}", f"digits={kind}:{digit}", f"edge={edge}", *["cue"] * cue, *["strict"] * strict, *[f"listed={kind}"] * listed]


def span_classifier(rows: list[tuple[tuple, float, float]], rounds: int = 300, rate: float = 0.5, l2: float = 1e-3) -> tuple[dict[str, float], float]:
    """(weight of each feature, bias) of a logistic regression on (features, weight, soft label) rows, by full gradient steps."""
    weights: dict[str, float] = defaultdict(float)
    bias, total = 0.0, sum(n for _, n, _ in rows) or 1.0
    names = [(feature_names(*f), math.log1p(n), p) for f, n, p in rows]  # dampened: a frequent pattern doesn't drown the others
    total = sum(n for _, n, _ in names) or 1.0
    for _ in range(rounds):
        g: dict[str, float] = defaultdict(float)
        gb = 0.0
        for f, n, p in names:
            x = bias + sum(weights[k] for k in f)
            e = n * (1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) - p)
            gb += e
            for k in f:
                g[k] += e
        bias -= rate * gb / total
        for k, v in g.items():
            weights[k] -= rate * 4 * (v / total + l2 * weights[k])
    return dict(weights), bias


FEATURES = ("size", "digits", "edge", "cue", "strict", "listed")


def candidates(docs: DataFrame) -> DataFrame:
    """(row, text, spans): the whole row, its text, and every base match and extra candidate in order, with votes and features.

    The row is one column, so no column of the documents can clash with ours.
    ``free`` tells whether a candidate meets no base span: none before it
    reaches into it, and the one that follows starts behind it.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    read = docs.select(whole, F.coalesce(pick(docs, "text", "string"), F.lit("")).alias("text"))
    # No pattern tells the two noncharacters apart, so the mark is free.
    read = read.withColumn("unmarked", F.when(F.contains("text", F.lit(MARK)), F.translate("text", MARK, UNMARK)).otherwise(F.col("text")))
    t = F.col("unmarked")
    maybe = {"email": F.contains(t, F.lit("@")), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), "phone": F.contains(t, F.lit("+")), "extra": t.rlike(MAYBE_EXTRA)}
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "extra": EXTRA}
    read = read.select("row", "text", *[marked(t, pattern, maybe[kind]).alias(f"{kind}_pieces") for kind, pattern in patterns.items()])
    parts = F.concat(*[parts_of(F.col(f"{kind}_pieces"), k) for k, kind in enumerate(patterns)])
    read = read.select("row", "text", parts.alias("parts")).withColumn("sizes", F.transform("parts", lambda p: F.when(p["value"].isNull(), -1).otherwise(p["gap"] + p["n"])))
    read = scanned(read, "sizes", "starts", sum_since_reset)

    def span(p: Column, start: Column) -> Column:
        at = F.when(start < 0, -1 - start).otherwise(start) + p["gap"]
        kind = F.when(p["place"] < len(BASE), F.get(F.array(*map(F.lit, BASE)), p["place"])).otherwise(extra_kind(p["value"]))
        return F.when(p["value"].isNotNull(), F.struct(at.alias("start"), (at + p["n"]).alias("end"), kind.alias("kind"), (p["place"] < len(BASE)).alias("based"), p["value"].alias("value"), p["left"].alias("left")))

    read = read.withColumn("found", F.array_compact(F.zip_with("parts", "starts", span)))
    read = read.withColumn("judged", F.array_sort(F.transform("found", labelled))).withColumn("ends", F.transform("judged", lambda x: F.when(x["base"], x["end"]).otherwise(0)))
    read = scanned(read, "ends", "reach", lambda a, b: F.greatest(a, b))

    def free(x: Column, around: Column) -> Column:
        after = around["after"]
        return x.withField("free", (around["reach"] <= x["start"]) & ~F.coalesce(after["base"] & (after["start"] < x["end"]), F.lit(False)))

    # As arguments of zip_with the scan and the shifted array are made once, not for each element.
    following = F.slice(F.col("judged"), F.lit(2), F.greatest(F.size("judged"), F.lit(1)))
    around = F.zip_with("reach", following, lambda r, a: F.struct(r.alias("reach"), a.alias("after")))
    return read.select("row", "text", F.zip_with("judged", around, free).alias("spans"))


def accepted_patterns(table: DataFrame) -> list[tuple]:
    """The feature patterns that the trained classifier accepts, from the candidates of all documents."""
    c = table.select(F.explode("spans").alias("c")).select("c.*")
    counted = c.groupBy("kind", "votes", *FEATURES).agg(F.count("*").alias("n")).collect()  # a row for each pattern that occurs
    by_votes: dict = defaultdict(float)
    for r in sorted(counted, key=str):
        by_votes[r["kind"], tuple(r["votes"])] += r["n"]
    posterior = reliabilities(dict(by_votes))
    by_features: dict = defaultdict(lambda: [0.0, 0.0])
    for r in sorted(counted, key=str):
        cell = by_features[(r["kind"], *[r[f] for f in FEATURES])]
        cell[0] += r["n"]
        cell[1] += r["n"] * posterior[r["kind"], tuple(r["votes"])]
    weights, bias = span_classifier([(k, n, p / n) for k, (n, p) in sorted(by_features.items(), key=str)])
    return [k for k in sorted(by_features, key=str) if bias + sum(weights.get(f, 0.0) for f in feature_names(*k)) >= 0]


def with_accepted(table: DataFrame, accepted: list[tuple]) -> DataFrame:
    """(row, text, base, all): arrays of struct(place of the kind, start, end, kind), by kind and start."""

    def key(x: Column) -> Column:
        return F.concat_ws("|", x["kind"], *[x[f].cast("string") for f in FEATURES])

    good = F.array(*[F.lit("|".join([k[0], *[str(v).lower() for v in k[1:]]])) for k in accepted]).cast("array<string>")
    order = F.array(*[F.lit(k) for k in KINDS])

    def plain(x: Column) -> Column:
        return F.struct(F.array_position(order, x["kind"]).cast("int").alias("place"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))

    chosen = F.filter("spans", lambda x: x["base"] | (x["free"] & F.array_contains(good, key(x))))
    base = F.filter("spans", lambda x: x["base"])
    return table.select("row", "text", F.array_sort(F.transform(base, plain)).cast(SPANS).alias("base"), F.array_sort(F.transform(chosen, plain)).cast(SPANS).alias("all"))


def of_kind(kind: str):
    return lambda x: x["kind"] == kind


def listed(array: str) -> Column:
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: one row per document.

    The counts are of base spans. A null or empty text has none; its hash is
    that of the empty string. Very long texts, and any number of spans in one,
    are read whole, in linear time. Spans of one start go by kind. Repeated rows
    are kept; an empty table gives no rows; columns other than doc_id and text
    are not read.
    """
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    narrow = candidates(docs.select(pick(docs, "doc_id", "long"), pick(docs, "text", "string"))).select(F.struct("row.doc_id").alias("row"), F.lit("").alias("text"), "spans")
    table = Scratch(docs.sparkSession, "pii").save(narrow, "candidates")
    return with_accepted(table, accepted_patterns(table)).select("row.doc_id", *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("all").alias("spans"))


def piece(start: Column, end: Column) -> Column:
    """The code points from start to end, put together from the column ``pieces``."""
    a, b = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    first, last = F.coalesce(F.get("pieces", a), F.lit("")), F.coalesce(F.get("pieces", b), F.lit(""))
    whole = F.array_join(F.slice(F.col("pieces"), a + 2, F.greatest(b - a - 1, F.lit(0))), "")
    return F.when(a == b, F.substring(first, start % PIECE + 1, end - start)).otherwise(F.concat(F.substring(first, start % PIECE + 1, F.lit(PIECE)), whole, F.substring(last, F.lit(1), end % PIECE)))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets; n_chars, where there is one, follows the text.

    Of overlapping spans the one that starts first names the whole stretch; of
    spans of one start the shortest, then the first kind. Null and empty texts
    and texts without spans stay as they are, very long ones are redacted whole
    in linear time; repeated rows are kept; an empty table gives none. All
    columns stay, whatever their names. Texts are scanned once: they are
    written beside their candidates, on which the classifier is trained.
    """
    table = Scratch(docs.sparkSession, "redact").save(candidates(docs).drop("text"), "candidates")  # the row has its text
    table = table.withColumn("text", F.coalesce(F.col("row.text").cast("string"), F.lit("")) if "text" in docs.columns else F.lit(""))
    marked = with_accepted(table, accepted_patterns(table))
    marked = marked.withColumn("order", F.array_sort(F.transform("all", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["place"].alias("place"), x["kind"].alias("kind")))))
    marked = scanned(marked.withColumn("ends", F.transform("order", lambda x: x["end"])), "ends", "reach", lambda a, b: F.greatest(a, b))
    some = F.size("order") > 0
    marked = marked.withColumn("pieces", F.when(some, F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))))

    def put(x: Column, reach: Column) -> Column:
        return F.when(x["start"] >= reach, F.concat(piece(reach, x["start"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise("")

    clean = F.concat(F.array_join(F.zip_with("order", "reach", put), ""), piece(F.array_max("ends"), F.char_length("text")))
    marked = marked.withColumn("clean", F.when(some, clean))
    new = {"text": F.coalesce("clean", "row.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(some, F.char_length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return marked.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
