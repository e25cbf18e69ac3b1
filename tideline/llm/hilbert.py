"""Sharding by a Hilbert curve over metadata.

Several metadata dimensions are quantised at their global quantiles, the cells
are ordered along a Hilbert curve, and the order is cut into runs of equal row
counts. A shard then covers a compact region of the metadata space, so min/max
or set statistics of its dimensions prune it for most filters.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pick, place_in_order

DIMENSIONS = {"lang": "string", "source": "string", "size": "long"}


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of each column of ``axes`` (dimensions x points), each axis holding ``bits`` bits."""
    x = axes.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections, coarse to fine
        low = q - 1
        for i in range(dims):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(hit, low, 0) ^ swap
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    flips = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flips ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flips
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def quantiles(rows: DataFrame, parts: int, scratch: Scratch) -> dict[str, list[tuple]]:
    """Of each dimension: (value, how many of the parts - 1 quantiles it is), in order; nulls do not count.

    Whole distinct values are counted, sorted over all tasks and summed up, so
    that neither a long common prefix nor a frequent value matters. Numbers are
    padded with zeros so that they sort as strings.
    """
    written = {d: F.col(d) if kind == "string" else F.lpad(F.col(d).cast("string"), 20, "0") for d, kind in DIMENSIONS.items()}
    values = rows.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("value")) for d, v in written.items()])).alias("v")).select("v.*")
    counts = values.where("value is not null").groupBy("dimension", "value").agg(F.count("*").alias("n"))
    summed = place_in_order(counts.orderBy("dimension", "value"), scratch, "n")
    totals = summed.groupBy("dimension").agg(F.sum("n").alias("total"), F.min("before").alias("ahead"))  # a row for each dimension

    def upto(c: str) -> Column:
        return F.least(F.expr(f"({c} - ahead) * {parts} div total"), F.lit(parts - 1))

    cuts = summed.join(F.broadcast(totals), "dimension").select("dimension", "value", (upto("before + n") - upto("before")).alias("times")).where("times > 0").orderBy("dimension", "value").collect()  # parts - 1 rows of a dimension at most
    return {d: [(r["value"] if kind == "string" else int(r["value"]), r["times"]) for r in cuts if r["dimension"] == d] for d, kind in DIMENSIONS.items()}


def cells_of(values: pd.Series, cuts: list[tuple]) -> np.ndarray:
    """0 for null, else 1 plus the number of quantiles below the value; a value that is several counts as often, so frequent values lie far apart."""
    codes, distinct = pd.factorize(values)
    steps = np.concatenate([[0], np.cumsum([n for _, n in cuts])]).astype(np.int64)
    keys = [v for v, _ in cuts]
    of_value = [1 + steps[bisect.bisect_left(keys, v)] for v in distinct.tolist()]
    return np.array([*of_value, 0], dtype=np.int64)[codes]


def shard(docs: DataFrame, n_shards: int = 16, bits: int = 6) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert, and the cell of each dimension.

    Law ``rows``: shard sizes differ by one row at most; grown_shard is null.
    Size is the UTF-8 bytes of the text plus 1; a null text counts as empty.
    Null dimensions have cell 0. Equal texts with equal metadata are neighbours
    in the order; very long texts differ by their size alone, and very long
    values of lang and source are compared whole. Ties go by text hash, then
    doc_id (null first), then input place, so repeated rows each have a slot of
    their own. An empty table gives no rows. Columns other than doc_id, text,
    lang and source are not read.
    """
    scratch = Scratch(docs.sparkSession, "hilbert")
    text = F.coalesce(pick(docs, "text", "string"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    narrow = docs.select(
        pick(docs, "doc_id", "long"),
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_key"),
        pick(docs, "lang", "string"),
        pick(docs, "source", "string"),
    ).withColumn("input_place", F.monotonically_increasing_id())
    narrow = scratch.save(narrow, "narrow")
    n = narrow.count()
    cuts = quantiles(narrow, (1 << bits) - 1, scratch)
    made = ", ".join(f"{d}_cell int" for d in DIMENSIONS)

    @F.pandas_udf(f"hilbert long, {made}")
    def curve(columns: pd.DataFrame) -> pd.DataFrame:
        axes = np.stack([cells_of(columns[d], cuts[d]) for d in DIMENSIONS])
        return pd.DataFrame({"hilbert": hilbert_index(axes, bits)} | {f"{d}_cell": axes[k] for k, d in enumerate(DIMENSIONS)})

    order = ["hilbert", "text_key", "doc_id", "input_place"]
    ordered = narrow.withColumn("c", curve(F.struct(*DIMENSIONS))).select("*", "c.*").orderBy(*order).drop("c", "lang", "source", "input_place", "text_key")
    ranked = place_in_order(ordered, scratch).withColumnRenamed("before", "rank")
    each, rest = divmod(n, n_shards)
    large = rest * (each + 1)  # the first ``rest`` shards hold one row more
    which = F.when(F.col("rank") < large, F.expr(f"rank div {each + 1}")).otherwise(F.expr(f"{rest} + (rank - {large}) div {max(each, 1)}"))
    first = F.when(F.col("shard") < rest, F.col("shard") * (each + 1)).otherwise(large + (F.col("shard") - rest) * each)
    return ranked.withColumn("shard", which.cast("int")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("rank") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "hilbert",
        *[f"{d}_cell" for d in DIMENSIONS],
    )
