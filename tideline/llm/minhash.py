"""Near-duplicates by MinHash with sequential Bayesian verification.

Documents with the same words in the same order, told by a SHA-256 digest of
them, are one node. Nodes that agree on a band of their signatures are
candidates. A candidate pair's signatures are compared batch by batch, and it
is dropped as soon as the posterior probability that its similarity reaches the
threshold falls under the chosen miss probability; survivors are confirmed on
their full shingle sets. Of each least hash a signature keeps eight bits (b-bit
MinHash): two differing ones agree in 1 of 256 cases, which adds candidates and
loses none, as equal ones agree as before.

Signatures stay where they are until it is known which buckets hold two nodes.
A Bloom filter of these buckets, of bounded size, tells in a pass over the nodes
those that can have a seat; signatures and seats of no others are moved.

A bucket is never expanded into all its pairs. First each member meets only the
bucket's hub, the member that shares most buckets. Then, in buckets that still
hold several components, the stragglers meet the other members in cells of at
most CELL by CELL rows, whatever the size of a bucket; a cell's pairs are never
rows of a table. Signatures go to the cells first, texts only of nodes with a
pair that is still open there.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import bloom_filter, may_hold
from .common import MAX_BROADCAST_ROWS, Scratch, named, pick, pieces, spread_join, text_key
from .components import components

BANDS, ROWS = 24, 5
HASHES = BANDS * ROWS
BATCH = 24
MEMO = 100_000
#: Rows of a side of a cell, and of a shard of cells with signatures and with texts, about.
CELL, SHARD, TEXT_SHARD = 256, 2048, 256
#: Pairs whose signatures are compared at once, and shingles of the sets that a shard holds at once.
STRIDE, HELD = 1 << 14, 400_000
#: Bits of a Bloom filter for each crowded bucket, or text that is wanted.
BITS_A_KEY = 16

_rng = np.random.Generator(np.random.PCG64(20_11))
FACTORS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str) -> list[bytes]:
    """Runs of anything but ASCII white space, with A-Z in lower case."""
    return text.encode("utf-8", "replace").lower().split()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingle_hashes(words: list[bytes], n: int, memo: dict) -> np.ndarray:
    """Distinct 64-bit hashes of the n-word shingles; of the whole sequence where it is shorter; none without words."""
    words = np.array(list(map(memo.__getitem__, words)), dtype=np.uint64)
    if not len(words):
        return words
    n = min(n, len(words))
    h = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for j in range(n):
        h = mix(h + words[j : len(words) - n + 1 + j])
    return np.unique(h)


def signature(h: np.ndarray) -> np.ndarray:
    """Eight bits, the lowest of the upper half, of each of the least values under HASHES linear maps."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(h), 2048):
        np.minimum(low, (np.multiply.outer(FACTORS, h[at : at + 2048]) + TERMS[:, None]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint8)


def buckets_of(signatures: pa.Array) -> np.ndarray:
    """A row of BANDS buckets for each signature: the number of the band before its bytes, so no two bands share a bucket."""
    bands = np.frombuffer(b"".join(signatures.to_pylist()), np.uint8).reshape(-1, BANDS, ROWS).astype(np.int64)
    return (np.arange(BANDS) << (8 * ROWS)) + (bands << (8 * np.arange(ROWS))).sum(axis=2)


def all_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        yield pa.record_batch([pa.array(buckets_of(batch.column("signature")).ravel())], names=["bucket"])


def seated_nodes(held):
    """The nodes with a bucket that the filter lets through, and those buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            buckets = buckets_of(batch.column("signature"))
            ok = may_hold(held.value, buckets.ravel().view(np.uint64)).reshape(buckets.shape)
            some = ok.any(axis=1)
            nodes, ok, buckets = batch.filter(pa.array(some)), ok[some], buckets[some]
            ends = np.concatenate([[0], ok.sum(axis=1).cumsum()])
            seats = pa.StructArray.from_arrays([pa.array(np.nonzero(ok)[1].astype(np.int32)), pa.array(buckets[ok])], names=["band", "bucket"])
            yield pa.record_batch([*nodes.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), seats)], names=[*nodes.schema.names, "seats"])

    return run


def signed(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in pieces(batches):
            sizes, digests, signatures = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py() or "")
                h = shingle_hashes(words, n, memo)
                sizes.append(len(h))
                digests.append(hashlib.sha256(b" ".join(words)).digest())
                signatures.append(signature(h).tobytes() if len(h) else b"")
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())], names=["doc_id", "text_key", "n_shingles", "words", "signature"])

    return run


def sequential_loss(bounds: list[int], similarity: float) -> float:
    """The chance that a pair of that similarity falls under a bound at any of the batches."""
    step = np.array([math.comb(BATCH, k) * similarity**k * (1 - similarity) ** (BATCH - k) for k in range(BATCH + 1)])
    alive = np.ones(1)
    for bound in bounds:
        alive = np.convolve(alive, step)
        alive[:bound] = 0
    return 1 - float(alive.sum())


def least_matches(threshold: float, miss: float) -> list[int]:
    """``posterior_bounds`` whose loss over all batches, of a pair at the threshold, is within ``miss``."""
    each = miss
    while sequential_loss(bounds := posterior_bounds(threshold, each), threshold) > miss:
        each /= 1.1
    return bounds


def posterior_bounds(threshold: float, miss: float) -> list[int]:
    """After each batch, the matches under which P(similarity >= threshold) < miss.

    From a uniform prior, m matches of n leave a Beta(m + 1, n - m + 1)
    posterior, whose mass above t is the chance of at most m successes in n + 1
    trials of probability t.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        mass, m = 0.0, -1
        while mass < miss:
            m += 1
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def surviving(marks: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(places, matches) of the pairs of rows i and j that no batch of their signatures rules out."""
    at, matches = np.arange(len(i)), np.zeros(len(i), dtype=np.int64)
    for k, bound in enumerate(least):
        part = marks[:, k * BATCH : (k + 1) * BATCH]
        matches = matches + (part[i[at]] == part[j[at]]).sum(axis=1)
        ok = matches >= bound
        at, matches = at[ok], matches[ok]
    return at, matches


def open_pairs(shard: pd.DataFrame, least: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(guest rows, member rows, matches) of pairs in the cells of a shard that cross components and that the signatures leave open, some at a time."""
    marks = np.frombuffer(b"".join(shard.signature), dtype=f"<u{len(shard.signature.iloc[0]) // HASHES}").reshape(-1, HASHES)
    owner, part, band, node, root, guest, late = (shard[c].to_numpy() for c in ("owner", "part", "band", "node", "root", "guest", "late"))
    order = np.lexsort((part, owner))
    edges = np.flatnonzero(np.concatenate([[True], (owner[order][1:] != owner[order][:-1]) | (part[order][1:] != part[order][:-1]), [True]]))
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        i, j = (np.concatenate(x) for x in zip(*waiting))
        waiting.clear()
        keep, matches = surviving(marks, i, j, least)
        i, j = i[keep], j[keep]
        # A pair that meets in several buckets belongs to the first band on which it agrees.
        first = (marks[i] == marks[j]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) if len(i) else np.zeros(0, np.int64)
        own = (band[i] < 0) | (band[i] == first)
        if own.any():
            yield i[own], j[own], matches[own]

    for a, b in zip(edges[:-1], edges[1:]):
        rows = order[a:b]
        guests, members = rows[guest[rows]], rows[~guest[rows]]
        for at in range(0, len(guests), 64):
            g = guests[at : at + 64]
            # Two stragglers meet once.
            apart = (root[g, None] != root[members]) & ~(late[members] & (node[members] <= node[g, None]))
            i, j = np.nonzero(apart)
            if len(i):
                waiting.append((g[i], members[j]))
            if sum(len(i) for i, _ in waiting) >= STRIDE:
                yield from flush()
    if waiting:
        yield from flush()


def open_nodes(least: list[int]):
    """Of one shard: the rows of pairs that are still open."""

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        found = [np.union1d(i, j) for i, j, _ in open_pairs(shard, least)]
        rows = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return shard.iloc[rows][["owner", "part", "node", "guest"]].drop_duplicates()

    return run


def shingle_set(text: str, n: int) -> frozenset:
    words = words_of(text)
    n = min(n, len(words))
    return frozenset(zip(*(words[j:] for j in range(n)))) if n else frozenset()


class Sets(dict):
    """Shingle sets of rows, made when asked for; no more than HELD shingles are held."""

    def __init__(self, texts: list[str], n: int) -> None:
        self.texts, self.n, self.held = texts, n, 0

    def __missing__(self, row: int) -> frozenset:
        if self.held > HELD:
            self.clear()
            self.held = 0
        self[row] = out = shingle_set(self.texts[row], self.n)
        self.held += len(out)
        return out


def confirmed_links(least: list[int], n: int, percent: int):
    """Of one shard with texts: links confirmed on full sets, enough of them to join what they join."""

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        node, root, sets, links = shard.node.to_numpy(), shard.root.to_numpy(), Sets(shard.text.tolist(), n), []
        joined: dict[int, int] = {}

        def top(r: int) -> int:
            while r in joined:
                r = joined[r]
            return r

        for i, j, matches in open_pairs(shard, least):
            order = np.lexsort((i, -matches))  # likely links first: they spare others
            for a, b in zip(i[order].tolist(), j[order].tolist()):
                ra, rb = top(int(root[a])), top(int(root[b]))
                if ra != rb:
                    x, y = sets[a], sets[b]
                    common = len(x & y)
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        links.append((int(node[a]), int(node[b])))
                        joined[ra] = rb
        return pd.DataFrame(links, columns=["x", "y"], dtype=np.int64)

    return run


def sifted(held):
    """The documents whose text_key the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(held.value, batch.column("text_key").to_numpy().view(np.uint64))))

    return run


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the nodes (node, first_id, first_key) in ``wanted``; texts move only for these."""
    texts = docs.select(pick(docs, "doc_id", "long"), pick(docs, "text", "string")).withColumn("text_key", text_key(F.col("text")))
    if wanted.count() <= MAX_BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    else:
        held = docs.sparkSession.sparkContext.broadcast(bloom_filter(wanted.select("first_key").distinct(), BITS_A_KEY))
        texts = texts.mapInArrow(sifted(held), "doc_id long, text string, text_key long")
    rows = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key")))
    return rows.groupBy("node").agg(F.any_value("text").alias("text"))  # repeated rows


def dealt(rows: DataFrame, about: int) -> DataFrame:
    """``rows`` with a shard, the same for all rows of a cell, of so many rows about."""
    n = rows.count()
    shards = max(-(-n // about), min(64, -(-n // 64)), 1)
    return rows.withColumn("shard", F.pmod(F.xxhash64("owner", "part"), F.lit(shards)))


def links_of(cells: DataFrame, nodes: DataFrame, docs: DataFrame, least: list[int], n: int, percent: int, scratch: Scratch) -> DataFrame:
    """Confirmed links (x, y) between guests and members of each cell (owner, part), from rows (owner, part, band, node, root, guest, late); ``nodes`` has a row for each of theirs at least."""
    cells = scratch.save(cells, "cells")
    marks = nodes.select("node", "signature")
    needed = dealt(cells, SHARD).join(marks, "node").groupBy("shard").applyInPandas(open_nodes(least), "owner long, part int, node long, guest boolean")
    needed = scratch.save(needed, "needed")
    full = scratch.save(cells.join(needed, ["owner", "part", "node", "guest"], "left_semi"), "open")
    wanted = scratch.save(needed.select("node").distinct().join(nodes.select("node", "first_id", "first_key"), "node"), "wanted")
    # Texts come dealt by node, as this join needs them: they are neither stored nor moved again before it.
    shards = dealt(full, TEXT_SHARD).join(marks, "node").join(texts_of(docs, wanted), "node")
    links = scratch.save(shards.groupBy("shard").applyInPandas(confirmed_links(least, n, percent), "x long, y long"), "links")
    scratch.drop(cells, needed, full, wanted)
    return links


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, miss: float = 1e-3) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key: one row per document; text_key is a hash of its text.

    Words are runs of anything but ASCII white space, A-Z in lower case. Two
    documents are linked if 100 * shared shingles >= percent * all shingles of
    both. component_id is the least doc_id that links reach (null ids do not
    count while there is another); kept marks the row with that id. Null and
    empty texts, and those without words, have no shingle and are linked with
    nothing; fewer words than a shingle make one shingle. Very long texts are
    read whole; a cell holds only some of their sets at a time. Repeated rows are in
    one component, and the ties that they make have no say in it; an empty
    table gives no rows; columns other than doc_id and text are not read. A pair
    at the threshold is missed by the bands with probability (1 - s**5)**24,
    under 1e-4, and by the signatures with ``miss`` at most, over all batches.
    """
    scratch = Scratch(docs.sparkSession, "near")
    least = least_matches(percent / 100, miss)
    read = docs.select(pick(docs, "doc_id", "long"), pick(docs, "text", "string")).withColumn("text_key", text_key(F.col("text")))
    table = scratch.save(read.mapInArrow(signed(words), "doc_id long, text_key long, n_shingles long, words binary, signature binary"), "signed")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")  # null ids come last
    nodes = table.where("n_shingles > 0").groupBy("words").agg(F.min(first).alias("first"), F.any_value("signature").alias("signature"), F.count("*").alias("copies"))
    nodes = scratch.save(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    # Signatures are kept once, with the nodes.
    narrow = scratch.save(table.select("doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("words")).alias("words")), "rows")
    scratch.drop(table)

    # Buckets with at least two nodes, and their hubs.
    crowded = nodes.select("signature").mapInArrow(all_buckets, "bucket long").groupBy("bucket").agg(F.count("*").alias("crowd")).where("crowd > 1")
    crowded = scratch.save(crowded, "crowded")
    held = docs.sparkSession.sparkContext.broadcast(bloom_filter(crowded.select("bucket"), BITS_A_KEY))  # of bounded size
    seated = nodes.select("node", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key"), "signature")
    seated = scratch.save(seated.mapInArrow(seated_nodes(held), "node long, first_id long, first_key long, signature binary, seats array<struct<band:int,bucket:long>>"), "seated")
    banded = seated.select("node", F.inline("seats"))
    seats = scratch.save(spread_join(banded, crowded.withColumn("seats", F.col("crowd")), ["bucket"], "seats", "node"), "seats")
    scratch.drop(crowded)
    central = seats.groupBy("node").agg(F.sum("crowd").alias("central"))
    hubs = scratch.save(seats.join(central, "node").groupBy("bucket").agg(F.max_by("node", F.struct(F.col("central"), -F.col("node"))).alias("hub"), F.count("*").alias("seated")), "hubs")
    placed = spread_join(seats, hubs, ["bucket"], "seated", "node")

    # Every member meets the hubs of its buckets.
    met = scratch.save(placed.where("node <> hub").select("node", "hub").distinct(), "met")
    parts = scratch.save(met.groupBy("hub").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts"), F.count("*").alias("met")), "parts")
    no = F.lit(False)
    guests = parts.select(F.col("hub").alias("owner"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hub").alias("node"), F.lit(True).alias("guest"))
    members = spread_join(met, parts, ["hub"], "met", "node").select(F.col("hub").alias("owner"), F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), "node", no.alias("guest"))
    cells = members.union(guests.select("owner", "part", "node", "guest")).select("owner", "part", F.lit(-1).alias("band"), "node", F.col("node").alias("root"), "guest", no.alias("late"))
    links = links_of(cells, seated, docs, least, words, percent, scratch)
    scratch.drop(met, parts)
    roots = scratch.save(components(links, scratch), "roots")

    # Stragglers of a bucket, members outside its hub's component, meet all members but the hub.
    rooted = scratch.save(placed.where("crowd > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    scratch.drop(seats, hubs)
    hub_root = F.max(F.when(F.col("node") == F.col("hub"), F.col("root")))
    split = scratch.save(rooted.groupBy("bucket").agg(hub_root.alias("hub_root"), F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("rooted")).where("a <> b").select("bucket", "hub_root", "rooted"), "split")
    open_ = scratch.save(spread_join(rooted.where("node <> hub"), split, ["bucket"], "rooted", "node").withColumn("late", F.col("root") != F.col("hub_root")), "open")
    scratch.drop(rooted, split)
    sides = scratch.save(open_.groupBy("bucket").agg(F.count("*").alias("opened"), F.ceil(F.count("*") / CELL).cast("int").alias("across"), F.ceil(F.count_if("late") / CELL).cast("int").alias("down")), "sides")
    sided = spread_join(open_, sides, ["bucket"], "opened", "node")

    def side(rows: DataFrame, guest: bool, own: str, other: str) -> DataFrame:
        mine, theirs = F.pmod(F.xxhash64("node", F.lit(guest)), own).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("theirs")
        part = F.when(F.lit(guest), F.col("mine") * F.col("across") + F.col("theirs")).otherwise(F.col("theirs") * F.col("across") + F.col("mine"))
        return rows.select("*", mine.alias("mine"), theirs).select(F.col("bucket").alias("owner"), part.cast("int").alias("part"), F.col("band").cast("int").alias("band"), "node", "root", F.lit(guest).alias("guest"), "late")

    cells = side(sided, False, "across", "down").union(side(sided.where("late"), True, "down", "across"))
    more = links_of(cells, seated, docs, least, words, percent, scratch)
    if not more.isEmpty():
        roots = scratch.save(components(more.union(roots.toDF("x", "y")), scratch), "roots")

    # Only nodes with copies or links change a row's own id.
    heads = roots.join(nodes.select("node", F.col("first.doc_id").alias("first_id")), "node").groupBy("root").agg(F.min("first_id").alias("head"))
    node_heads = roots.join(heads, "root").select("node", "head")
    first_id = F.col("first.doc_id")
    of_words = nodes.join(node_heads, "node", "left").where("head is not null or copies > 1").select("words", F.coalesce("head", first_id).alias("component_id"), "copies")
    of_words = scratch.save(of_words, "of-words")
    scratch.keep(narrow, of_words)
    # Texts without words have no part in the join.
    linked = spread_join(narrow.where("words is not null"), of_words, ["words"], "copies", "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "text_key")
    out = linked.union(narrow.where("words is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_key"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_key")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with one of each group of near-duplicates: the one with the least doc_id, and of its repeated rows one.

    Null and empty texts, very long ones, ties, repeated rows and empty tables
    are as ``near_duplicates`` says; all columns stay, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    with Scratch(docs.sparkSession, "found"):
        found = scratch.save(near_duplicates(docs, words, percent), "near")
    removed = scratch.save(found.where("not kept").select("doc_id", "text_key").distinct(), "removed")
    # Rows that repeat both id and text are rare; only they are moved.
    repeated = scratch.save(found.where("kept").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    scratch.drop(found)
    kept = named(docs, removed, "left_anti")
    if repeated.isEmpty():
        return kept
    again = named(kept, repeated, "left_semi")
    return named(kept, repeated, "left_anti").unionByName(again.dropDuplicates(["doc_id", "text"]))
