"""Benchmark decontamination by spaced seeds.

A mask fixes which words of a window count and which are ignored, so a changed
word at an ignored place keeps the hash. Hashes of test windows meet hashes of
training windows in a join; a Bloom filter, sized by the test windows up to a
bound, keeps most training windows that cannot meet any from being moved.
An item's most frequent seeds are left out of the join as far as no overlap can
consist of them alone, so a phrase that many items and documents share makes no
pairs. Around the hits of a pair the item is laid along the document and every
stretch of it is judged word by word. Items too short for a mask are hashed
whole and meet documents of the same words.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import bloom_filter, may_hold
from .common import Scratch, named, pick, pieces, text_key

WORD = re.compile(r"\w+")
#: Which words of a window count; zeros at the end only fill it up.
#: Every stretch with SHORTEST equal words or more at a share of 0.8 meets one of
#: the two. With n equal and m <= n / 4 changed words and no run of four, n <= 3 (m + 1),
#: so n < 13; then the runs number m + 1 and are too few to hold n words unless two
#: neighbours of at least two words are parted by one changed word.
MASKS = ("111100000", "110110000")
SHORTEST = 5
#: Bits of the filter for each test window.
BITS_A_SEED = 64
#: Items that a document is compared with in one row, about.
ITEMS = 64
MEMO = 100_000


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return h


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def word_hashes(text: str, memo: dict) -> np.ndarray:
    return np.array(list(map(memo.__getitem__, words_of(text))), dtype=np.uint64)


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each window under a mask; the mask is part of the hash."""
    n = len(hashes) - len(mask) + 1
    h = np.full(max(n, 0), int(mask, 2), dtype=np.uint64)
    for j, kept in enumerate(mask):
        if kept == "1" and n > 0:
            h = (h ^ hashes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
    return h


def all_seeds(hashes: np.ndarray, masks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(seeds, places) of a text under all masks; a text too short for them has one seed, of all its words."""
    if len(hashes) < SHORTEST:
        return (seeds(hashes, "1" * len(hashes)) ^ np.uint64(len(hashes)), np.zeros(1, np.int64)) if len(hashes) else (hashes, np.zeros(0, np.int64))
    found = [seeds(hashes, mask) for mask in masks]
    return np.concatenate(found), np.concatenate([np.arange(len(h)) for h in found])


@functools.cache
def hit_words(words: int, changed: int) -> float:
    """The fewest words that lie in seeds, of a stretch with so many equal and changed words; infinite where there is no such stretch.

    Runs of four equal words lie in seeds whole. Of shorter ones two words do at
    each end where another run of two or more follows one changed word.
    """

    @functools.cache
    def rest(before: int, run: int, n: int, k: int) -> float:
        """What ``run``, after run ``before``, and n further words parted by k more changed words hold at least."""

        def of(after: int) -> int:
            if run >= 4 or run < 2:
                return run if run >= 4 else 0
            return min(run, 2 * (before >= 2) + 2 * (after >= 2))

        if k == 0:
            return of(0) if n == 0 else float("inf")
        return min(of(after) + rest(run, after, n - after, k - 1) for after in range(n + 1))

    return min(rest(0, run, words - run, changed) for run in range(words + 1))


#: A stretch of 13 equal words or more has at least so many in seeds, and so have two stretches that don't touch.
ENOUGH = 8


def of_stretch(words: int, most_changed: int) -> float:
    """The fewest words in seeds, of a stretch with so many equal words, its share of 0.8 kept."""
    return min(hit_words(words, k) for k in range(min(most_changed, words // 4) + 1))


@functools.cache
def least_in_seeds(words: int) -> int:
    """The fewest words of an item that lie in seeds which a document that overlaps with it has too.

    An overlap is one stretch of 13 equal words, or stretches that cover 0.8 of
    the item. Of these a few suffice of which only neighbours share words: one,
    two, or more, and then the first and the third share none.
    """
    if words < SHORTEST:
        return 1
    covered, least = max(SHORTEST, -(-4 * words // 5)), float(ENOUGH if words >= 10 else words)
    for n in range(covered, min(words, 2 * ENOUGH) + 1):
        least = min(least, of_stretch(n, words - n))
    for a in range(SHORTEST, min(words, 2 * ENOUGH) + 1):
        for b in range(max(SHORTEST, covered - a), min(words, 2 * ENOUGH) + 1):
            one, other = of_stretch(a, a), of_stretch(b, b)
            least = min(least, max(one, other, one + other - (a + b - covered)))
    return int(least)


def indexed(masks: list[str]):
    """The seeds of an item that are joined: all but the most frequent ones, as far as these hold fewer words than any overlap has in seeds.

    So an overlap has a seed among the others, and a phrase of a few words that
    many items and documents share joins none of them.
    """
    kept = {len(m): np.flatnonzero([c == "1" for c in m]) for m in masks}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["frequency", "item_pos", "width"], ascending=[False, True, True])
        words, left = set(), least_in_seeds(int(rows.item_words.iloc[0])) - 1
        out = np.ones(len(rows), dtype=bool)
        for k, (pos, width) in enumerate(zip(rows.item_pos.tolist(), rows.width.tolist())):
            if width not in kept:
                break
            more = words | {pos + int(j) for j in kept[width]}
            if len(more) <= left:
                words, out[k] = more, False
        return rows.loc[out, ["seed", "item_key"]].drop_duplicates()

    return run


def item_seeds(masks: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in pieces(batches):
            columns: list[list] = [[] for _ in range(5)]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes = word_hashes(text or "", memo)
                h, at = all_seeds(hashes, masks)
                widths = np.repeat([len(m) for m in masks], [max(0, len(hashes) - len(m) + 1) for m in masks]) if len(hashes) >= SHORTEST else np.zeros(len(h), np.int64)
                for column, values in zip(columns, (h.view(np.int64).tolist(), [key] * len(h), at.tolist(), widths.tolist(), [len(hashes)] * len(h))):
                    column += values
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["seed", "item_key", "item_pos", "width", "item_words"])

    return run


def candidate_rows(held, masks: list[str]):
    """Documents with a window that the filter lets through, and those windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, memo = held.value, WordHashes()
        for batch in pieces(batches):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                h, at = all_seeds(word_hashes(text, memo), masks)
                ok = may_hold(bloom, h)
                h, at = h[ok], at[ok]
                if len(h):
                    out.append((doc_id, text, [{"seed": s, "doc_pos": p} for s, p in zip(h.view(np.int64).tolist(), at.tolist())]))
            columns = list(zip(*out)) if out else [[]] * 3
            kinds = (pa.int64(), pa.string(), pa.list_(pa.struct([("seed", pa.int64()), ("doc_pos", pa.int32())])))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "text", "hits"])

    return run


def stretches(equal: np.ndarray, need: int, share: Fraction) -> tuple[np.ndarray, int]:
    """(places, most): the equal words inside any stretch with ``need`` equal words at ``share``, and how many the richest such stretch has."""
    at = np.flatnonzero(equal)
    inside = np.zeros(len(equal), bool)
    if len(at) < max(need, 1):
        return inside, 0
    # Stretches that begin and end with an equal word are enough: of i to j, the share holds where start[i] <= end[j].
    rank = np.arange(len(at))
    start = share.denominator * rank - share.numerator * at
    end = share.denominator * (rank + 1) - share.numerator * (at + 1)
    reach = np.maximum.accumulate(end[::-1])[::-1]  # falls, so the farthest end of each start is found by bisection
    last = np.searchsorted(-reach, -start, side="right") - 1
    n = last - rank + 1
    good = n >= need
    if not good.any():
        return inside, 0
    edge = np.zeros(len(at) + 1, dtype=np.int64)
    np.add.at(edge, rank[good], 1)
    np.add.at(edge, last[good] + 1, -1)
    inside[at[np.cumsum(edge[:-1]) > 0]] = True
    return inside, int(n[good].max())


def judged(doc_words: list[str], item_words: list[str], shifts: list[int], min_words: int, share: Fraction) -> tuple[int, int, int] | None:
    """(matched words, first word, end word) if the item laid along the document at the shifts overlaps it."""
    if len(item_words) < SHORTEST:
        return (len(item_words), 0, len(item_words)) if item_words == doc_words else None
    number = {w: k for k, w in enumerate(item_words)}
    item = np.array([number[w] for w in item_words], dtype=np.int64)
    doc = np.array([number.get(w, -1) for w in doc_words], dtype=np.int64)
    covered, best, spans = np.zeros(len(item), bool), 0, []
    for shift in sorted(set(shifts)):
        low, high = max(0, -shift), min(len(item), len(doc) - shift)
        inside, n = stretches(doc[low + shift : high + shift] == item[low:high], SHORTEST, share)
        if n:
            covered[low:high] |= inside
            best = max(best, n)
            at = np.flatnonzero(inside) + low + shift
            spans.append((int(at[0]), int(at[-1]) + 1))
    if best >= min(min_words, len(item)) or covered.sum() >= max(SHORTEST, share * len(item)):
        return int(covered.sum()), min(s for s, _ in spans), max(e for _, e in spans)
    return None


class Shifts:
    """Where items may lie along a document: at the places of the seeds that both have."""

    def __init__(self, doc_words: list[str], masks: list[str], memo: dict):
        self.masks, self.memo = masks, memo
        h, at = all_seeds(self._hashes(doc_words), masks)
        order = np.argsort(h, kind="stable")
        self.seeds, self.places = h[order], at[order]

    def _hashes(self, words: list[str]) -> np.ndarray:
        return np.array(list(map(self.memo.__getitem__, words)), dtype=np.uint64)

    def of(self, item_words: list[str]) -> list[int]:
        h, at = all_seeds(self._hashes(item_words), self.masks)
        first, last = (np.searchsorted(self.seeds, h, side) for side in ("left", "right"))
        found = [np.unique(self.places[a:b] - p) for a, b, p in zip(first.tolist(), last.tolist(), at.tolist()) if b > a]
        return np.unique(np.concatenate(found)).tolist() if found else []


LINKS = "doc_key long, doc_id long, item_id long, matched_words long, item_words long, first_word long, end_word long, text_key long"


def verified(min_words: int, similarity: float, masks: list[str]):
    share = Fraction(str(similarity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in pieces(batches):
            out: list[tuple] = []
            for doc_key, doc_id, text, key, items in zip(*(c.to_pylist() for c in batch.columns)):
                doc_words = words_of(text)
                shifts = Shifts(doc_words, masks, memo)
                for x in items:
                    item_words = words_of(x["item_text"])
                    if found := judged(doc_words, item_words, shifts.of(item_words), min_words, share):
                        out.append((doc_key, doc_id, x["item_id"], found[0], len(item_words), *found[1:], key))
            columns = list(zip(*out)) if out else [[]] * 8
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in LINKS.split(", ")])

    return run


def links(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, similarity: float = 0.8) -> DataFrame:
    """doc_key, doc_id, item_id, matched_words, item_words, first_word, end_word, text_key: one row for each document and item that overlap.

    Words are lower-case runs of letters, digits and underscores. A pair
    overlaps if one stretch has ``min_words`` equal words and a share of
    ``similarity`` of its words equal, or if such stretches together cover that
    share of the item. An item of fewer than five words overlaps a document
    that has those words and no others; null and empty texts match nothing. At
    a ``similarity`` of 0.8 or more no stretch of five equal words is without a
    seed; under it some may be. Very long texts are compared whole. Where
    several shifts match, all count. Repeated documents and items give repeated
    pairs; empty tables give no rows; other columns are not read. doc_key tells
    repeated documents apart.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "seeds")
    items = scratch.save(benchmark.select(F.monotonically_increasing_id().alias("item_key"), pick(benchmark, "item_id", "long"), F.coalesce(pick(benchmark, "text", "string"), F.lit("")).alias("item_text")), "items")
    masks = [m.rstrip("0") for m in MASKS]
    seeds_table = scratch.save(items.select("item_key", "item_text").mapInArrow(item_seeds(masks), "seed long, item_key long, item_pos long, width long, item_words long"), "seeds")
    held = spark.sparkContext.broadcast(bloom_filter(seeds_table.select("seed").distinct(), BITS_A_SEED))  # of bounded size
    kinds = "doc_id long, text string, hits array<struct<seed:long,doc_pos:int>>"
    candidates = docs.select(pick(docs, "doc_id", "long"), pick(docs, "text", "string")).mapInArrow(candidate_rows(held, masks), kinds)
    candidates = scratch.save(candidates.withColumn("doc_key", F.monotonically_increasing_id()), "candidates")
    hits = candidates.select("doc_key", F.explode(F.array_distinct(F.transform("hits", lambda h: h["seed"]))).alias("seed"))
    frequency = hits.groupBy("seed").agg(F.count("*").alias("frequency"))
    index = seeds_table.join(frequency, "seed").groupBy("item_key").applyInPandas(indexed(masks), "seed long, item_key long") if min_words >= 13 and similarity >= 0.8 else seeds_table.select("seed", "item_key")
    pairs = hits.join(scratch.save(index, "index"), "seed").select("doc_key", "item_key").distinct()
    # A document goes once to some ITEMS of its items, not to each.
    chunks = max(1, -(-items.count() // ITEMS))
    met = pairs.join(items, "item_key").groupBy("doc_key", F.pmod(F.xxhash64("item_key"), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("item_id", "item_text")).alias("items"))
    laid = met.join(candidates.select("doc_key", "doc_id", "text"), "doc_key")
    out = laid.select("doc_key", "doc_id", "text", text_key(F.col("text")).alias("text_key"), "items").mapInArrow(verified(min_words, similarity, masks), LINKS)
    return out


def overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, similarity: float = 0.8) -> DataFrame:
    """doc_id, n_items, item_id, matched_words, item_words, first_word, end_word, text_key: one row for each document that overlaps with an item.

    n_items is the number of its links. item_id and the columns after it are of
    the item with most matched words; ties go to the smaller share of unmatched
    words, then to the smaller id. Nulls, empty and very long texts, repeated
    rows, empty tables and further columns are as ``links`` says.
    """
    best = F.struct(F.col("matched_words"), -F.col("item_words"), -F.coalesce("item_id", F.lit(1 << 62)))
    row = F.struct("doc_id", "item_id", "matched_words", "item_words", "first_word", "end_word", "text_key")
    found = links(docs, benchmark, min_words, similarity).groupBy("doc_key").agg(F.count("*").alias("n_items"), F.max_by(row, best).alias("r"))
    return found.select("r.doc_id", "n_items", "r.item_id", "r.matched_words", "r.item_words", "r.first_word", "r.end_word", "r.text_key")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap with no item, with all their columns, whatever their names.

    Documents with a null or empty text stay; a repeated row stays or goes with
    the first; very long texts, ties and empty tables are as ``links`` says.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    with Scratch(docs.sparkSession, "found"):
        found = scratch.save(overlaps(docs, benchmark).select("doc_id", "text_key").distinct(), "overlaps")
    return named(docs, found, "left_anti")
