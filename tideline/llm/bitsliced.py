"""Exact top-k inner products on a bit-sliced index.

Every component is an integer attribute, stored as bitmaps over the rows of a
block, one for each binary digit. A query's score is the sum of shifted slices,
added with bitmap adders; the best rows are then picked from the most
significant slice of that sum downward, and the rows that tie at the boundary
are resolved by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, pick

SCALE = 256
INDEX = "row_block int, rows int, dims int, width int, ids binary, keys binary, mins binary, slices binary"


def build(ids: np.ndarray, values: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(digits, minimum of each attribute, bitmaps[attribute, digit, word]) of integer rows."""
    mins = values.min(axis=0)
    above = (values - mins).astype(np.uint64)
    width = max(1, int(above.max(initial=0)).bit_length())
    words = -(-len(values) // 64)
    bits = np.zeros((values.shape[1], width, words * 64), dtype=np.uint8)
    for b in range(width):
        bits[:, b, : len(values)] = ((above >> np.uint64(b)) & np.uint64(1)).T
    return width, mins, np.packbits(bits, axis=2, bitorder="little").view(np.uint64)


def add_slices(stacks: list[np.ndarray]) -> list[np.ndarray]:
    """The digits of a sum, from bitmaps stacked by binary weight: carry-save adders, least significant weight first."""
    out, k = [], 0
    stacks = list(stacks)
    while k < len(stacks):
        a = stacks[k]
        while len(a) > 1:
            n = len(a) // 3
            if n:
                x, y, z = a[:n], a[n : 2 * n], a[2 * n : 3 * n]
                half = x ^ y
                kept, carry = half ^ z, (x & y) | (half & z)
                a = np.concatenate([kept, a[3 * n :]]) if len(a) > 3 * n else kept
            else:
                kept, carry = a[:1] ^ a[1:], a[:1] & a[1:]
                a = kept
            if k + 1 == len(stacks):
                stacks.append(carry)
            else:
                stacks[k + 1] = np.concatenate([stacks[k + 1], carry])
        out.append(a[0] if len(a) else None)
        k += 1
    return out


def select(digits: list, valid: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k largest sums: those surely in, then the ones tied at the boundary, in row order."""
    sure, tied = np.zeros_like(valid), valid
    found = 0
    for slice_ in reversed(digits):
        if slice_ is None:
            continue
        high = tied & slice_
        n = found + int(np.bitwise_count(high).sum())
        if n > k:
            tied = high
        else:
            sure, found = sure | high, n
            if n == k:
                return rows_of(sure)
            tied = tied & ~slice_
    return np.concatenate([rows_of(sure), rows_of(tied)[: k - found]])


def rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def signed_digits(q: int) -> list[tuple[int, int]]:
    """(position, +1 or -1) of an integer's non-adjacent form, which has the fewest non-zero digits."""
    out, j = [], 0
    while q:
        if q & 1:
            sign = 2 - (q & 3)
            out.append((j, sign))
            q -= sign
        q >>= 1
        j += 1
    return out


def search(query: np.ndarray, own: int, keys: np.ndarray, mins: np.ndarray, slices: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the k best rows of a block for one query, its own row apart."""
    width = slices.shape[1]
    n = min(len(query), len(mins))
    full = (1 << width) - 1
    parts: list[list[np.ndarray]] = []
    base = 0
    for d in range(n):
        q = int(query[d])
        base += q * int(mins[d])
        for j, sign in signed_digits(q):
            # A negative digit adds the complement of the attribute, so that every term adds.
            digits = slices[d] if sign > 0 else ~slices[d]
            base -= full << j if sign < 0 else 0
            parts += [[] for _ in range(j + width - len(parts))]
            for b in range(width):
                parts[j + b].append(digits[b])
    words = slices.shape[2]
    sums = add_slices([np.stack(p) if p else np.zeros((0, words), np.uint64) for p in parts])
    valid = np.zeros(words * 64, dtype=np.uint8)
    valid[: len(keys)] = 1
    valid[np.flatnonzero(keys == own)] = 0
    rows = select(sums, np.packbits(valid, bitorder="little").view(np.uint64), k)
    scores = np.full(len(rows), base, dtype=np.int64)
    for weight_, digit in enumerate(sums):
        if digit is not None:
            scores += ((digit[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << weight_
    return rows, scores


def padded(vectors: pa.Array, flat: np.ndarray, dims: int) -> np.ndarray:
    """The components ``flat`` of vectors as rows of integers; a shorter vector ends in zeros."""
    out = np.zeros((len(vectors), dims), dtype=np.int64)
    lengths = np.diff(vectors.offsets.to_numpy())
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def quantised(vectors: pa.Array, dims: int) -> np.ndarray:
    """floor(256 x) of each component as integers; a shorter vector ends in zeros."""
    return padded(vectors, np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64), dims)


def pack_rows(dims: int):
    """One index row for each partition: its rows in id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), quantised(b.column(2), dims)) for b in batches if b.num_rows]
        if not held:
            return
        ids, keys, values = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((keys, ids))
        ids, keys, values = ids[order], keys[order], values[order]
        width, mins, slices = build(ids, values)
        row = [TaskContext.get().partitionId(), len(ids), dims, width, ids.astype("<i8").tobytes(), keys.astype("<i8").tobytes(), mins.astype("<i8").tobytes(), slices.tobytes()]
        kinds = [pa.int32()] * 4 + [pa.binary()] * 4
        yield pa.record_batch([pa.array([v], t) for v, t in zip(row, kinds)], names=["row_block", "rows", "dims", "width", "ids", "keys", "mins", "slices"])

    return run


def answer(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.to_pylist():
                ids, keys, mins = (np.frombuffer(cell[c], "<i8") for c in ("ids", "keys", "mins"))
                slices = np.frombuffer(cell["slices"], np.uint64).reshape(cell["dims"], cell["width"], -1)
                out: list[tuple] = []
                for query_id, query_key, vector in zip(cell["query_ids"], cell["query_keys"], np.frombuffer(cell["vectors"], "<i8").reshape(len(cell["query_ids"]), -1)):
                    rows, scores = search(vector, query_key, keys, mins, slices, k)
                    out += zip([query_id] * len(rows), [query_key] * len(rows), ids[rows].tolist(), keys[rows].tolist(), scores.tolist())
                columns = list(zip(*out)) if out else [[]] * 5
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["query_id", "query_key", "vec_id", "vec_key", "score"])

    return run


def query_blocks(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [(b.column(0).to_pylist(), b.column(1).to_pylist(), quantised(b.column(2), dims)) for b in batches if b.num_rows]
        if not held:
            return
        row = [TaskContext.get().partitionId(), sum((h[0] for h in held), []), sum((h[1] for h in held), []), np.concatenate([h[2] for h in held]).astype("<i8").tobytes()]
        yield pa.record_batch([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()))], names=["query_block", "query_ids", "query_keys", "vectors"])

    return run


def top_k(embeddings: DataFrame, every: int = 50, k: int = 5, rows_a_block: int = 32_768, queries_a_block: int = 128) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose vec_id is divisible by ``every``.

    Vectors that are null or hold null or non-finite components take no part,
    nor do rows with a null vec_id. Ties go to the smaller vec_id. A repeated
    row is a candidate, and a query, each time it occurs; a query never finds
    its own row, but it finds its repeats. Vectors of different lengths meet
    as if the shorter one ended in zeros. Fewer than k rows come where there
    are fewer candidates; an empty table gives none. Scores must fit a long.
    """
    ok = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.col("vec_id").isNotNull()
    rows = embeddings.select(pick(embeddings, "vec_id", "long"), pick(embeddings, "embedding", "array<double>")).where(ok).withColumn("key", F.monotonically_increasing_id()).select("vec_id", "key", "embedding")
    rows = Scratch(rows.sparkSession, "vectors").save(rows, "vectors")
    is_query = F.col("vec_id") % every == 0
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dims"), F.count_if(is_query).alias("q")).first()
    # Blocks are smaller where there would be fewer than cores.
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n_rows = max(1, -(-size["n"] // rows_a_block), min(cores, -(-size["n"] // max(1, rows_a_block // 8))))
    n_queries, dims = max(1, -(-size["q"] // queries_a_block)), size["dims"]
    index = rows.repartition(n_rows).mapInArrow(pack_rows(dims), INDEX)
    queries = rows.where(is_query).repartition(n_queries).mapInArrow(query_blocks(dims), "query_block int, query_ids array<long>, query_keys array<long>, vectors binary")
    # The index moves once; what is copied to every block of it are the queries.
    cells = index.join(queries.withColumn("row_block", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)))), "row_block")
    found = cells.mapInArrow(answer(k), "query_id long, query_key long, vec_id long, vec_key long, score long")
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id", "vec_key")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
