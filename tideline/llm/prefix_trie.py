"""The trie of conversation prefixes, by z-fast tries.

A prefix of d turns is named by a sum of d hashes, one of each turn and its
depth, so the names of a conversation's prefixes are running sums and a long
conversation may be cut anywhere. Each task holds compacted tries: a node spans
a stretch of depths without branches, and stands in a hash table under its
name at the two-fattest depth of the stretch, the one with most trailing zero
digits. Where a conversation leaves the trie is found by a binary search over
depths of that kind. Tries are expanded into a row for each prefix when a task
ends or its tries have grown large, and rows of one prefix are added up by
Spark: no prefix, however common, meets in one task more than once a task.

Sums over subtrees need no walk. A prefix is owned by its least conversation;
what a conversation owns is the lower end of its path. So the sum below a
prefix is what all conversations through it own, less what its own owner has
above it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, pick, place_in_order

DIGEST = 16
MASK = (1 << 60) - 1
#: Prefixes that a task's tries may span before they are expanded.
HELD = 1 << 20
#: Depths of one owner that are summed together.
STRIDE = 1024
#: Prefixes with more children than this, and than a 100,000th of all, are joined by broadcast: there are at most 100,000.
MANY_CHILDREN = 10_000
NO_ENDS = hashlib.sha256(b"").hexdigest()


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] with most trailing zero digits."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class Trie:
    """A compacted trie below one prefix, ``root`` turns deep.

    A node spans the depths (start, end]; ``names[node]`` are their names in
    order. ``handles`` finds a node by (depth, name) at its two-fattest depth,
    ``first`` by the name of its first depth.
    """

    def __init__(self, root: int, name: tuple[int, int]):
        self.root, self.name = root, name
        self.start, self.end, self.parent = [root], [root], [-1]
        self.names: list[list[tuple[int, int]]] = [[]]
        self.sizes: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.handles: dict[tuple[int, tuple[int, int]], int] = {}
        self.first: dict[tuple[int, int], int] = {}
        self.n, self.least, self.tokens, self.leaves = [0], [None], [0], [0]
        self.depths = 0

    def _add(self, start: int, end: int, parent: int, names: list, sizes: np.ndarray) -> int:
        node = len(self.start)
        self.start.append(start)
        self.end.append(end)
        self.parent.append(parent)
        self.names.append(names)
        self.sizes.append(sizes)
        for values, nothing in ((self.n, 0), (self.least, None), (self.tokens, 0), (self.leaves, 0)):
            values.append(nothing)
        self._enter(node)
        return node

    def _handle(self, node: int) -> tuple[int, tuple[int, int]]:
        depth = two_fattest(self.start[node], self.end[node])
        return depth, self.names[node][depth - self.start[node] - 1]

    def _enter(self, node: int) -> None:
        self.handles[self._handle(node)] = node
        self.first[self.names[node][0]] = node

    def exit_node(self, names: list[tuple[int, int]]) -> tuple[int, int]:
        """(node, depth) where a path of names leaves the trie or ends: it shares that many turns with the node."""
        low, high, root, last = self.root, self.root + len(names), self.root, self.root + len(names)
        node = 0
        while low < high:
            depth = two_fattest(low, high)
            found = self.handles.get((depth, names[depth - root - 1]))
            if found is None:
                high = depth - 1
                continue
            node, end = found, self.end[found]
            if end > last or names[end - root - 1] != self.names[found][-1]:
                return node, self._shared(node, depth, names)
            low = end
        if self.end[node] < last and (child := self.first.get(names[self.end[node] - root])) is not None:
            return child, self._shared(child, self.start[child] + 1, names)
        return node, self.end[node]

    def _shared(self, node: int, low: int, names: list[tuple[int, int]]) -> int:
        """The deepest depth of a node, at least ``low``, that a path shares with it."""
        high = min(self.end[node], self.root + len(names))
        while low < high:
            middle = (low + high + 1) // 2
            if self.names[node][middle - self.start[node] - 1] == names[middle - self.root - 1]:
                low = middle
            else:
                high = middle - 1
        return low

    def _split(self, node: int, depth: int) -> int:
        """A new node for what ``node`` spans down to ``depth``; the rest stays with it."""
        del self.handles[self._handle(node)]
        start, cut = self.start[node], depth - self.start[node]
        upper_names, upper_sizes = self.names[node][:cut], self.sizes[node][:cut]
        self.start[node], self.names[node], self.sizes[node] = depth, self.names[node][cut:], self.sizes[node][cut:]
        upper = self._add(start, depth, self.parent[node], upper_names, upper_sizes)
        self.parent[node] = upper
        self._enter(node)
        return upper

    def insert(self, conv_id: int, names: list[tuple[int, int]], sizes: np.ndarray, tokens: int, leaves: int) -> None:
        node, depth = self.exit_node(names)
        if depth < self.end[node]:
            node = self._split(node, depth)
        last = self.root + len(names)
        if depth < last:
            node = self._add(depth, last, node, names[depth - self.root :], sizes[depth - self.root :])
            self.depths += last - depth
        self.n[node] += 1
        self.least[node] = conv_id if self.least[node] is None else min(self.least[node], conv_id)
        self.tokens[node] += tokens
        self.leaves[node] += leaves

    def expand(self) -> Iterator[tuple]:
        """(names, parents, first depth, sizes, n, least, tokens, leaves) of every node: sums of what ends in it or below."""
        for node in sorted(range(1, len(self.start)), key=lambda k: -self.end[k]):
            up = self.parent[node]
            self.n[up] += self.n[node]
            self.least[up] = self.least[node] if self.least[up] is None else min(self.least[up], self.least[node])
            self.tokens[up] += self.tokens[node]
            self.leaves[up] += self.leaves[node]
        for node in range(1, len(self.start)):
            up = self.parent[node]
            above = self.names[up][-1] if self.names[up] else self.name
            yield self.names[node], [above, *self.names[node][:-1]], self.start[node] + 1, self.sizes[node], self.n[node], self.least[node], self.tokens[node], self.leaves[node]
        if self.root == 0:
            yield [self.name], [None], 0, np.zeros(1, np.int64), self.n[0], self.least[0], self.tokens[0], self.leaves[0]


def hashes(digests: bytes, depth: int) -> np.ndarray:
    """[turn, half]: what each turn adds to the names of the prefixes from its own on; the first stands at ``depth``."""
    made = b"".join(hashlib.blake2b(digests[k : k + DIGEST], digest_size=16, salt=(depth + k // DIGEST).to_bytes(16, "little")).digest() for k in range(0, len(digests), DIGEST))
    return np.frombuffer(made, "<u8").reshape(-1, 2) & np.uint64(MASK)


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, first, n, digests, sizes): stretches of turns of one conversation that follow each other in a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        digests, sizes = b"".join(batch.column(2).to_pylist()), batch.column(3).to_numpy().astype("<i8").tobytes()
        begins = np.flatnonzero(np.concatenate([[True], (conv[1:] != conv[:-1]) | (place[1:] != place[:-1] + 1)]))
        ends = np.append(begins[1:], len(conv))
        parts = [[d[a * w : b * w] for a, b in zip(begins.tolist(), ends.tolist())] for d, w in ((digests, DIGEST), (sizes, 8))]
        yield pa.record_batch([pa.array(conv[begins]), pa.array(place[begins]), pa.array(ends - begins), pa.array(parts[0], pa.binary()), pa.array(parts[1], pa.binary())], names=["conv_id", "first", "n", "digests", "sizes"])


def path_pieces(heads: int):
    """Of stretches with their conversation's length and the turns it borrows: (conv_id, at, depth, digests, sizes, last, a, b), depth being that of the turn before the piece, a and b what it adds to names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv_id, at, n, own, digests, sizes, head in zip(*(c.to_pylist() for c in batch.columns)):
                borrowed = zlib.crc32(str(conv_id).encode()) % heads if heads else 0
                head_digests, head_sizes = (b"".join(h[c] for h in head or [])[: borrowed * w] for c, w in (("digests", DIGEST), ("sizes", 8)))
                skipped = min(n, max(0, borrowed - at))
                depth = len(head_digests) // DIGEST + max(at, borrowed) - borrowed
                digests, sizes = digests[skipped * DIGEST :], sizes[skipped * 8 :]
                if at == 0:
                    depth, digests, sizes = 0, head_digests + digests, head_sizes + sizes
                a, b = hashes(digests, depth + 1).sum(axis=0) & np.uint64(MASK)
                out.append((conv_id, at, depth, digests, sizes, at + n == own, int(a), int(b)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.int64(), pa.int64())
            columns = list(zip(*out)) or [()] * 8
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=["conv_id", "at", "depth", "digests", "sizes", "last", "a", "b"])

    return run


PREFIXES = "hi long, lo long, up_hi long, up_lo long, depth long, size long, n long, conv_id long, tokens long, leaves long"


def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefixes of a task's pieces (conv_id, depth, a, b, digests, sizes, tokens, leaves), once each, with sums over the pieces through them."""
    tries: dict[tuple, Trie] = {}

    def expanded() -> Iterator[pa.RecordBatch]:
        for trie in tries.values():
            out: list[list[np.ndarray]] = [[] for _ in range(8)]
            names, parents = [], []
            for own, above, depth, sizes, *sums in trie.expand():
                names += own
                parents += above
                out[0].append(np.arange(depth, depth + len(own)))
                out[1].append(sizes)
                for k, value in enumerate(sums, 2):
                    out[k].append(np.full(len(own), value, dtype=np.int64))
            for at in range(0, len(names), 100_000):
                here = slice(at, at + 100_000)
                keys = [pa.array([name[k] if name else None for name in part[here]], pa.int64()) for part in (names, parents) for k in (0, 1)]
                yield pa.record_batch(keys + [pa.array(np.concatenate(c)[here].astype(np.int64)) for c in out[:6]], names=[c.split()[0] for c in PREFIXES.split(", ")])

    for batch in batches:
        for conv_id, depth, a, b, digests, sizes, tokens, leaves in zip(*(c.to_pylist() for c in batch.columns)):
            sums = (np.cumsum(hashes(digests, depth + 1), axis=0, dtype=np.uint64) + np.array([a, b], dtype=np.uint64)) & np.uint64(MASK)
            key = (depth, a, b)
            if key not in tries:
                tries[key] = Trie(depth, (a, b))
            tries[key].insert(conv_id, list(zip(*sums.T.tolist())), np.frombuffer(sizes, "<i8"), tokens, leaves)
        if sum(t.depths for t in tries.values()) + len(tries) > HELD:
            yield from expanded()
            tries.clear()
    yield from expanded()


def id_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hi, lo, first, ids): the sorted ids of a name, joined as far as a batch holds them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        hi, lo, ids = (c.to_numpy() for c in batch.columns)
        begins = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
        ends = np.append(begins[1:], len(hi))
        texts = list(map(str, ids.tolist()))
        joined = [",".join(texts[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
        yield pa.record_batch([pa.array(hi[begins]), pa.array(lo[begins]), pa.array(ids[begins]), pa.array(joined, pa.string())], names=["hi", "lo", "first", "ids"])


def id_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hi, lo, ends_sha256) of rows sorted by name and first id; a hash goes on from batch to batch, and nothing of a name is held."""
    name, state, out = None, None, []

    def told() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 3
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], names=["hi", "lo", "ends_sha256"])

    for batch in batches:
        for hi, lo, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3))):
            if (hi, lo) == name:
                state.update(b"," + ids.encode())
            else:
                if name is not None:
                    out.append((*name, state.hexdigest()))
                name, state = (hi, lo), hashlib.sha256(ids.encode())
        yield told()
        out = []
    if name is not None:
        out.append((*name, state.hexdigest()))
    yield told()


def ends_of(pieces: DataFrame) -> DataFrame:
    """(hi, lo, ends_sha256) of every prefix in which conversations end. The order of a hash's input is one, so the joined ids of a name meet in one task; they are joined before that, and read there as a stream."""
    total = lambda before, own: (F.col(before) + F.col(own)).bitwiseAND(MASK)
    ends = pieces.where("last").select(total("a0", "a").alias("hi"), total("b0", "b").alias("lo"), "conv_id")
    joined = ends.repartitionByRange("hi", "lo", "conv_id").sortWithinPartitions("hi", "lo", "conv_id").mapInArrow(id_texts, "hi long, lo long, first long, ids string")
    return joined.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "first").mapInArrow(id_hashes, "hi long, lo long, ends_sha256 string")


def paths(conversations: DataFrame, scratch: Scratch, every: int | None, heads: int) -> DataFrame:
    """Pieces of the conversations' paths: (conv_id, depth, digests, sizes, last, a, b, a0, b0); a0 and b0 name the prefix before the piece."""
    role, text = (F.coalesce(pick(conversations, c, "string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, DIGEST)
    turns = conversations.select(pick(conversations, "conv_id", "long"), pick(conversations, "turn", "long"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")).where("conv_id is not null")
    placed = place_in_order(turns.orderBy("conv_id", F.asc_nulls_first("turn"), "role", "digest").drop("turn", "role"), scratch)
    own = Window.partitionBy("conv_id")
    stretches = placed.select("conv_id", "before", "digest", "bytes").mapInArrow(cut, "conv_id long, first long, n long, digests binary, sizes binary")
    stretches = stretches.select("conv_id", (F.col("first") - F.min("first").over(own)).alias("at"), "n", F.sum("n").over(own).alias("own"), "digests", "sizes")
    none = F.lit(None).cast("array<struct<at:bigint,digests:binary,sizes:binary>>").alias("head")
    if every:
        stretches, most = scratch.save(stretches, "stretches"), heads - 1
        begin = F.struct("at", F.substring("digests", 1, DIGEST * most).alias("digests"), F.substring("sizes", 1, 8 * most).alias("sizes"))
        lent = stretches.where((F.col("conv_id") % every == 0) & (F.col("at") < most)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(begin)).alias("head"))
        stretches = stretches.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(lent, "base", "left")
    else:
        stretches, heads = stretches.withColumn("head", none), 0
    pieces = stretches.select("conv_id", "at", "n", "own", "digests", "sizes", "head").mapInArrow(path_pieces(heads), "conv_id long, at long, depth long, digests binary, sizes binary, last boolean, a long, b long")
    ahead = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: (F.coalesce(F.sum(F.col(c).cast("decimal(20,0)")).over(ahead), F.lit(0)) % F.lit(MASK + 1).cast("decimal(20,0)")).cast("long")
    return scratch.save(pieces.select("*", before("a").alias("a0"), before("b").alias("b0")).drop("at"), "pieces")


def through(pieces: DataFrame) -> DataFrame:
    return pieces.select("conv_id", "depth", "a0", "b0", "digests", "sizes", "tokens", "leaves").mapInArrow(prefixes, PREFIXES)


def with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with parent_conv_id. Prefixes with many children are few, and go to the executors; the others hold a bounded part of all."""
    size = nodes.count()
    parents = nodes.where("n_children > 0").select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    many = F.col("siblings") > max(MANY_CHILDREN, size // 100_000)
    crowd, rest = F.broadcast(parents.where(many).drop("siblings")), parents.where(~many).drop("siblings")
    beside = nodes.join(crowd, ["up_hi", "up_lo"], "left")
    found = F.col("parent_conv_id").isNotNull() | F.col("up_hi").isNull()
    return beside.where(found).unionByName(beside.where(~found).drop("parent_conv_id").join(rest, ["up_hi", "up_lo"]))


def trie(conversations: DataFrame, every: int | None = None, heads: int = 9) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each distinct sequence of first turns.

    Turns are (role, text) in the order of turn, nulls first, then of role and
    the text's hash; a null role or text counts as empty. Rows with a null
    conv_id take no part. Repeated rows are turns each. With ``every``, a
    conversation c first borrows: its path is the first h turns of c - c %
    ``every`` (none if there is none), then its own after its first h, h being
    crc32(c) % ``heads``. A conversation without turns ends in the root. An
    empty table gives none. Very long texts count by hash and size only; very
    long conversations are cut into pieces. Columns other than the four are not
    read.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    pieces = paths(conversations, scratch, every, heads)
    plain = pieces.withColumn("tokens", F.lit(0).cast("long")).withColumn("leaves", F.lit(0).cast("long"))
    of_name = lambda c: F.min(c).alias(c)  # noqa: E731  the same in all rows of a name
    nodes = scratch.save(through(plain).groupBy("hi", "lo").agg(*map(of_name, ("up_hi", "up_lo", "depth", "size")), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id")), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["hi", "lo"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    stride, inside = F.floor(F.col("depth") / STRIDE), Window.partitionBy("conv_id", "stride").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumn("stride", stride).withColumn("saved", (F.col("n") - 1) * F.col("size"))
    nodes = scratch.save(nodes.withColumn("above", F.coalesce(F.sum("saved").over(inside), F.lit(0))), "owned")
    strides = nodes.groupBy("conv_id", "stride").agg(F.sum("saved").alias("tokens"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    ahead = Window.partitionBy("conv_id").orderBy("stride").rowsBetween(Window.unboundedPreceding, -1)
    strides = scratch.save(strides.withColumn("higher", F.coalesce(F.sum("tokens").over(ahead), F.lit(0))), "strides")
    owners = strides.groupBy("conv_id").agg(F.sum("tokens").alias("tokens"), F.sum("leaves").alias("leaves"))
    below = through(pieces.join(owners, "conv_id")).groupBy("hi", "lo").agg(F.sum("tokens").alias("tokens"), F.sum("leaves").alias("n_leaves"))
    ends = ends_of(pieces)
    joined = nodes.join(strides.select("conv_id", "stride", "higher"), ["conv_id", "stride"])
    joined = joined.join(below, ["hi", "lo"]).join(ends, ["hi", "lo"], "left")
    full = scratch.save(joined.withColumn("saved_tokens", F.col("tokens") - F.col("above") - F.col("higher")), "full")
    return with_parents(full).select("conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
