"""Exact removal of byte strings that occur more than once, by sharded suffix arrays.

Every start of a ``length``-byte string belongs to one anchor: the leftmost
least hash of a shorter window inside that string. The anchor depends on the
string alone, so equal strings have equal anchors, and an anchor that occurs
once in the corpus rules out all its starts. What is left are stretches of text
around repeated anchors, dealt to shards by anchor; where all stretches of an
anchor are one and the same, told by 64 bits beside the anchor's 64, there is
nothing to sort. A shard sorts all suffixes
of its stretches by Larsson-Sadakane refinement, finds common prefixes with
Kasai's method (all stretches in step), and marks starts whose neighbour shares
``length`` bytes. Anchors with too many different stretches for one shard are
split over several, whose sorted runs are then merged by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, Scratch, pick, pieces, spread_join

LENGTH = 200
#: Stretches of one anchor in a shard, and stretches in a shard, about.
CHUNK, SHARD = 512, 2048
BATCH_BYTES = 1 << 19
#: Bits that hold a place within a batch; longer texts are hashed in pieces.
PLACE_BITS = 24
PIECE = 1 << 22


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; ``text`` ends in eight bytes of padding."""
    n = len(text) - 8
    out = np.empty(n, dtype="<u8")
    raw = text.tobytes()
    for o in range(min(8, n)):
        part = out[o::8]
        part[:] = np.frombuffer(raw, "<u8", count=len(part), offset=o)
    return out


def window_hashes(text: np.ndarray, window: int) -> np.ndarray:
    """A hash of each window of ``window`` bytes, a power of two from 8 on."""
    h = words_at(np.concatenate([text, np.zeros(8, np.uint8)]))[: max(len(text) - 7, 0)] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    span = 8
    while span < window:
        h = (h[:-span] * np.uint64(0xD6E8FEB86659FD93) ^ h[span:]) * np.uint64(0x9E3779B97F4A7C15) if len(h) > span else h[:0]
        h ^= h >> np.uint64(32)
        span *= 2
    return h


def anchor_of_starts(hashes: np.ndarray, reach: int) -> np.ndarray:
    """For each start, the place of the leftmost least hash among the next ``reach`` places."""
    low = np.uint64(PLACE_BITS)
    least = (hashes >> low << low) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while span * 2 <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if reach > span:
        least = np.minimum(least[: len(least) - (reach - span)], least[reach - span :])
    return (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)


def anchor_window(length: int) -> int:
    return 1 << max(3, (length // 3).bit_length() - 1)


def anchors(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash of the anchor, first start, number of starts) of each stretch of each text; short texts are hashed together, long ones in pieces."""
    window = anchor_window(length)
    pieces = [(k, at, text[at : at + PIECE + length - 1]) for k, text in enumerate(texts) for at in range(0, max(1, len(text) - length + 1), PIECE)]
    found: list[list[tuple]] = [[] for _ in texts]
    at = 0
    while at < len(pieces):
        group, size = [], 0
        while at < len(pieces) and (not group or size + len(pieces[at][2]) <= BATCH_BYTES):
            group.append(pieces[at])
            size += len(pieces[at][2])
            at += 1
        joined = np.frombuffer(b"".join(p[2] for p in group), dtype=np.uint8)
        if len(joined) < length:
            continue
        hashes = window_hashes(joined, window)
        anchor = anchor_of_starts(hashes, length - window + 1)
        base = 0
        for k, offset, piece in group:
            n = len(piece) - length + 1
            if n > 0:
                own = anchor[base : base + n]
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                found[k].append((hashes[own[first]].view(np.int64), first + offset, np.diff(np.append(first, n))))
            base += len(piece)
    for parts in found:
        yield tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3


def digested(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "t1", "t2", "n_bytes", "sha256", "anchor", "stretch", "place", "again"]
        kinds = [pa.int64(), pa.string(), *[pa.list_(t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.bool_())]]
        for batch in pieces(batches):
            texts = [(t.as_py() or "").encode("utf-8", "replace") for t in batch.column(1)]
            lists: list[list] = [[] for _ in range(4)]
            for text, (anchor, first, count) in zip(texts, anchors(texts, length)):
                where, times = np.unique(anchor, return_inverse=True, return_counts=True)[1:]
                stretch = [xxhash.xxh3_64_intdigest(text[a : a + n + length - 1]) for a, n in zip(first.tolist(), count.tolist())]
                for column, values in zip(lists, (anchor, np.array(stretch, dtype=np.uint64).view(np.int64), first << 8 | count, times[where] > 1)):
                    column.append(values)
            columns = [[len(t) for t in texts], [hashlib.sha256(t).hexdigest() for t in texts], *lists]
            yield pa.record_batch([batch.column(0), batch.column(2), batch.column(3), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=names)

    return run


class Stretches:
    """Byte strings laid one after the other, each followed by eight bytes of padding."""

    def __init__(self, parts: list[bytes]) -> None:
        self.size = np.array([len(p) for p in parts], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size + 8)[:-1]]) if parts else np.zeros(0, np.int64)
        self.text = np.frombuffer(b"".join(p + bytes(8) for p in parts) + bytes(8), dtype=np.uint8)
        self.words = words_at(self.text)
        self.place = np.concatenate([np.arange(s, s + n) for s, n in zip(self.start, self.size)]) if parts else np.zeros(0, np.int64)
        self.owner = np.zeros(len(self.text), dtype=np.int64)
        self.owner[self.place] = np.repeat(np.arange(len(parts)), self.size)
        self.end = (self.start + self.size)[self.owner] if parts else self.owner


def suffix_array(s: Stretches) -> tuple[np.ndarray, np.ndarray]:
    """(places in suffix order, rank of each place). The end of a stretch sorts before every byte, and ends sort by stretch.

    Larsson-Sadakane: groups of suffixes that agree so far are refined by the
    rank of the suffix ``depth`` bytes on, which doubles; sorted ones drop out.
    """
    place, depth = s.place, 7
    n, owners = len(place), len(s.size)
    head = s.words[place].byteswap() >> np.uint64(8)  # seven bytes; padding past the end is zero
    left = np.minimum(s.end[place] - place, 7).astype(np.uint64)
    key = head << np.uint64(3) | left
    order = np.argsort(key, kind="stable")
    sa, key = place[order], key[order]
    rank = np.zeros(len(s.text), dtype=np.int64)
    open_ = np.arange(n)
    while len(open_):
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.flatnonzero(fresh)
        rank[sa[open_]] = open_[group][np.cumsum(fresh) - 1]
        alone = np.diff(np.append(group, len(key))) == 1
        open_ = open_[~alone[np.cumsum(fresh) - 1]]
        items = sa[open_]
        inside = items + depth < s.end[items]
        second = np.where(inside, rank[np.minimum(items + depth, len(rank) - 1)] + owners, s.owner[items])
        key = rank[items] * (n + owners + 1) + second
        order = np.argsort(key, kind="stable")
        sa[open_], key = items[order], key[order]
        depth *= 2
    return sa, rank


def common_prefixes(s: Stretches, sa: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """By rank: the common prefix of a suffix and the one before it, up to ``length``, for suffixes of that length at least.

    Kasai's method for all stretches in step: the next suffix of a stretch
    shares at most one byte less with its own predecessor.
    """
    out = np.zeros(len(sa) + 1, dtype=np.int64)
    lanes = np.flatnonzero(s.size >= length)
    lanes = lanes[np.argsort(-s.size[lanes], kind="stable")]
    h = np.zeros(len(lanes), dtype=np.int64)
    for t in range(int(s.size[lanes[0]]) - length + 1 if len(lanes) else 0):
        live = np.searchsorted(-s.size[lanes], -(t + length), side="right")
        i = s.start[lanes[:live]] + t
        r = rank[i]
        j = sa[np.maximum(r - 1, 0)]
        most = np.minimum(np.where(r > 0, np.minimum(s.end[i] - i, s.end[j] - j), 0), length)
        g = np.minimum(np.maximum(h[:live] - 1, 0), most)
        grow = np.flatnonzero(g < most)
        while len(grow):
            at = g[grow]
            differ = s.words[i[grow] + at] ^ s.words[j[grow] + at]
            equal = np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64)
            g[grow] = np.minimum(at + equal, most[grow])
            grow = grow[(equal == 8) & (g[grow] < most[grow])]
        h[:live] = g
        out[r] = g
    return out


def ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


MARKS = "anchor long, stretch long, first array<int>, end array<int>, part int, chunk int, keys array<binary>, stretches array<long>"


def shard_marks(length: int):
    """Of one shard: a row for each stretch with its marked ranges (part -1), and of split anchors runs (part from 0) of their distinct strings in suffix order.

    A string that the shard has marked needs no more than to be there for other
    shards: its place in a run is -1.
    """

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        s = Stretches(list(shard.bytes))
        sa, rank = suffix_array(s)
        shared = common_prefixes(s, sa, rank, length)
        out: list[tuple] = []
        runs: dict[tuple, list] = {}
        for k, (anchor, stretch, many, chunks, chunk) in enumerate(zip(shard.anchor.tolist(), shard.stretch.tolist(), shard.many.tolist(), shard.chunks.tolist(), shard.chunk.tolist())):
            n = int(s.size[k]) - length + 1
            r = rank[s.start[k] : s.start[k] + n]
            marked = (shared[r] >= length) | (shared[r + 1] >= length) | many
            found = ranges(marked)
            if found:
                out.append((anchor, stretch, [a for a, _ in found], [b for _, b in found], -1, chunk, None, None))
            if chunks > 1:
                text, new = shard.bytes.iloc[k], shared[r] < length  # the first of equal strings in suffix order
                for a in np.flatnonzero(new).tolist():
                    key = text[a : a + length]
                    part = (xxhash.xxh3_64_intdigest(key) >> 20) % chunks
                    runs.setdefault((anchor, part, chunk), []).append((int(r[a]), key, stretch, -1 if marked[a] else a))
        for (anchor, part, chunk), run_ in runs.items():
            _, keys, stretches, first = zip(*sorted(run_))  # by suffix rank
            out.append((anchor, 0, list(first), None, part, chunk, list(keys), list(stretches)))
        return pd.DataFrame(out, columns=["anchor", "stretch", "first", "end", "part", "chunk", "keys", "stretches"])

    return run


def merged_runs(group: pd.DataFrame) -> pd.DataFrame:
    """Starts of one anchor whose string another shard holds too: the shards' suffix-sorted runs are merged, and each run is sought in the merged one by binary search, on the bytes."""
    runs = [(np.array(list(r.keys_), dtype=f"S{len(r.keys_[0])}"), np.array(r.stretches), np.array(r.first)) for r in group.rename(columns={"keys": "keys_"}).itertuples()]
    merged = np.sort(np.concatenate([keys for keys, *_ in runs]), kind="stable")
    found: dict[int, list[int]] = {}
    for keys, stretches, first in runs:
        elsewhere = np.searchsorted(merged, keys, "right") - np.searchsorted(merged, keys, "left") > 1
        new = elsewhere & (first >= 0)
        for stretch, at in zip(stretches[new].tolist(), first[new].tolist()):
            found.setdefault(stretch, []).append(at)
    anchor = int(group.anchor.iloc[0])
    return pd.DataFrame([(anchor, stretch, at, [a + 1 for a in at]) for stretch, at in found.items()], columns=["anchor", "stretch", "first", "end"])


def cleaned(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            removed, spans, digests, texts = [], [], [], []
            for text, firsts, ends in zip(*(c.to_pylist() for c in batch.columns[1:4])):
                data = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
                turn = np.zeros(len(data) + 1, dtype=np.int64)
                np.add.at(turn, firsts, 1)
                np.add.at(turn, np.array(ends) + length - 1, -1)
                gone = np.cumsum(turn)[:-1] > 0
                kept = data[~gone].tobytes()
                removed.append(int(gone.sum()))
                spans.append(len(ranges(gone)))
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept)
            yield pa.record_batch([batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.binary())], names=["row", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def text_ids(text: Column) -> list[Column]:
    """Two hashes that tell texts apart."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")]


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (row, doc_id, t1, t2, ...) with the text of each row. Few wanted rows are sent to the scan, so that no other text moves."""
    text = F.coalesce(pick(docs, "text", "string"), F.lit(""))
    rows = docs.select(pick(docs, "doc_id", "long"), *text_ids(text), text.alias("text"))
    ids = wanted.select(F.col("doc_id").alias("w"), F.col("t1").alias("w1"), F.col("t2").alias("w2"))
    same = rows["t1"].eqNullSafe(ids["w1"]) & (rows["t2"] == ids["w2"]) & rows["doc_id"].eqNullSafe(ids["w"])
    if wanted.count() <= MAX_BROADCAST_ROWS:
        rows = rows.join(F.broadcast(ids), same, "left_semi")
    # The id is part of the key: copies of a text don't meet in one task.
    rows = rows.select(F.col("doc_id").alias("found_id"), F.col("t1").alias("f1"), F.col("t2").alias("f2"), "text")
    return rows.join(wanted, (F.col("f1") == F.col("t1")) & (F.col("f2") == F.col("t2")) & F.col("found_id").eqNullSafe(F.col("doc_id"))).drop("found_id", "f1", "f2")


def repeated_bytes(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_text`` the bytes that stay: one row per document.

    Each byte goes that is covered by a string of ``length`` bytes which also
    starts anywhere else, in the same document or another; overlaps count, and
    all strings are judged on the input. A null text counts as empty; a text
    under ``length`` bytes loses nothing; repeated rows and equal texts of that
    length lose everything; very long texts are read whole. Of equal strings all
    go, so there are no ties. An empty table gives no rows; columns other than
    doc_id and text are not read. ``length`` is from 24 to 255 more than its
    anchor's window.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    text = F.coalesce(pick(docs, "text", "string"), F.lit(""))
    kinds = "doc_id long, t1 long, t2 long, n_bytes long, sha256 string, anchor array<long>, stretch array<long>, place array<long>, again array<boolean>"
    rows = docs.select(pick(docs, "doc_id", "long"), text.alias("text"), *text_ids(text)).mapInArrow(digested(length), kinds)
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    # Equal texts, told by SHA-256, are judged as wholes; one row of each stands for its strings.
    copies = scratch.save(rows.groupBy("sha256").agg(F.count("*").alias("copies"), F.min("row").alias("lead")).where("copies > 1"), "copies")
    sent = F.broadcast(copies) if copies.count() <= MAX_BROADCAST_ROWS else copies
    leads = rows.join(sent, "sha256", "left").where("lead is null or lead = row")
    each = leads.select("row", F.explode(F.arrays_zip("anchor", "stretch", "place", "again")).alias("a")).select("row", "a.*")
    found = each.groupBy("anchor").agg(F.min("row").alias("low"), F.max("row").alias("high"), F.min("stretch").alias("low_stretch"), F.max("stretch").alias("high_stretch"), F.bool_or("again").alias("again"), F.count("*").alias("n"))
    repeated = scratch.save(found.where("again or low <> high").select("anchor", (F.col("low_stretch") != F.col("high_stretch")).alias("varied"), "n"), "repeated")
    seen = scratch.save(spread_join(each.drop("again"), repeated, ["anchor"], "n", "row"), "seen").withColumn("first", F.shiftright("place", 8).cast("int")).withColumn("end", F.col("first") + (F.col("place") % 256).cast("int"))

    # Anchors with one stretch: all its starts occur again. The others' stretches are sorted.
    plain, varied = seen.where("not varied"), seen.where("varied")
    places = varied.groupBy("row").agg(F.collect_list(F.struct("anchor", "stretch", "first", "end")).alias("places"))  # bounded by the text's own length
    ids = rows.select("row", "doc_id", "t1", "t2")
    wanted = scratch.save(places.join(ids, "row"), "varied")
    cut = texts_of(docs, wanted)
    cut = cut.select("row", F.explode("places").alias("p"), F.encode("text", "utf-8").alias("data")).select(
        "row", "p.anchor", "p.stretch", "p.first", F.substring("data", F.col("p.first") + 1, F.col("p.end") - F.col("p.first") + (length - 1)).alias("bytes")
    )
    stretches = scratch.save(cut.groupBy("anchor", "stretch").agg(F.count("*").alias("copies"), F.any_value("bytes").alias("bytes")), "stretches")
    crowd = scratch.save(stretches.groupBy("anchor").agg(F.count("*").alias("n")), "crowd")
    shards = max(1, -(-(crowd.agg(F.sum("n")).first()[0] or 0) // SHARD))
    chunks = F.ceil(F.col("n") / CHUNK)
    crowd = crowd.withColumn("chunks", chunks.cast("int"))
    dealt = spread_join(stretches, crowd, ["anchor"], "n", "stretch").withColumn("chunk", F.pmod("stretch", "chunks").cast("int"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("anchor", "chunk"), F.lit(shards)).cast("int"))
    marks = scratch.save(dealt.select("shard", "anchor", "stretch", (F.col("copies") > 1).alias("many"), "chunks", "chunk", "bytes").groupBy("shard").applyInPandas(shard_marks(length), MARKS), "marks")
    ends = "anchor long, stretch long, first array<int>, end array<int>"
    across = marks.where("part >= 0").groupBy("anchor", "part").applyInPandas(merged_runs, ends)
    inside = marks.where("part < 0").select("anchor", "stretch", "first", "end")
    offsets = inside.union(across).groupBy("anchor", "stretch").agg(F.flatten(F.collect_list("first")).alias("from"), F.flatten(F.collect_list("end")).alias("to"))  # at most the starts of one stretch
    offsets = scratch.save(offsets.join(stretches.select("anchor", "stretch", "copies"), ["anchor", "stretch"]), "offsets")
    moved = spread_join(varied, offsets, ["anchor", "stretch"], "copies", "row").select("row", F.transform("from", lambda x: x + F.col("first")).alias("f"), F.transform("to", lambda x: x + F.col("first")).alias("e"))

    spans = plain.select("row", F.array("first").alias("f"), F.array("end").alias("e")).union(moved)
    marked = spans.groupBy("row").agg(F.flatten(F.collect_list("f")).alias("firsts"), F.flatten(F.collect_list("e")).alias("ends"))  # bounded by the text's own length
    marked = scratch.save(marked.join(rows.select("row", "doc_id", "t1", "t2", "sha256"), "row").join(sent.select("sha256"), "sha256", "left_anti").drop("sha256"), "marked")
    scratch.keep(rows, copies, marked)
    out = texts_of(docs, marked).select("row", "text", "firsts", "ends").mapInArrow(cleaned(length), "row long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    if not with_text:
        out = out.drop("kept")
    joined = rows.select("row", "doc_id", "n_bytes", "sha256").join(sent.select("sha256", "copies"), "sha256", "left").join(out, "row", "left")
    whole = F.col("copies").isNotNull() & (F.col("n_bytes") >= length)
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        *([F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if with_text else []),
    )
