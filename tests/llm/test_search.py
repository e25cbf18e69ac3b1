"""Hard negatives, the prefix trie and languages, against brute force; languages also by held-out accuracy."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, MID, SMALL, docs_of, odd_documents, tables
from tideline.llm import hard_negatives, language_id, prefix_trie

# Hard negatives.


def mined(rows, anchor_every=100):
    rows = [(v, lab, [math.floor(256 * float(x)) for x in e]) for v, e, lab in rows if None not in (v, e, lab) and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    for k, (v, lab, e) in enumerate(rows):
        if v % anchor_every:
            continue
        others = [(-score(e, f), w, m) for j, (w, m, f) in enumerate(rows) if j != k]
        for s, w, _ in sorted(o for o in others if o[2] == lab)[:5]:
            s = -s
            fits = sorted(o for o in others if o[2] != lab and 30 * s <= -100 * o[0] <= 90 * s)[:10]
            out += [(v, w, r, x, s, -t) for r, (t, x, _) in enumerate(fits, 1)]
    return sorted(out)


def columns(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


def test_hard_negatives_of_odd_rows_equal_brute_force(spark):
    r = random.Random(3)
    base = [[r.gauss(0, 0.3) for _ in range(11)] for _ in range(4)]
    rows = [(k, [x + r.gauss(0, 0.2) for x in base[k % 4]], k % 3) for k in range(260)]
    rows += [(7, rows[7][1], 1), (7, rows[7][1], 1), (100, rows[100][1], 1), (300, [], 1), (400, [0.5], 1), (500, None, 1), (None, base[0], 1), (501, base[0], None), (502, [None] * 11, 1), (503, [float("nan")] * 11, 1), (504, [float("inf")] * 11, 1), (600, [-x for x in base[1]], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rank", F.lit(1)).withColumn("key", F.lit(2))
    want = mined(rows)
    assert len(want) > 100
    assert columns(hard_negatives.mine(df)) == want == columns(hard_negatives.mine(df.repartition(5), rows_a_block=40, queries_a_block=2))
    assert hard_negatives.mine(df.limit(0)).count() == 0


@pytest.mark.parametrize("smooth, most", [(True, 0.1), (False, 0.5)])
def test_bounds_hold_and_decide_most_rows(monkeypatch, smooth, most):
    """Of smooth vectors the means tell nearly all; of noise, the hardest case, only segments of two components tell some."""
    r = np.random.default_rng(4)
    values = (r.normal(0, 6, (8000, 64)).cumsum(axis=1) if smooth else r.normal(0, 32, (80, 64))[np.arange(8000) % 80] + r.normal(0, 16, (8000, 64))).astype(np.int64)
    sums, deviations = hard_negatives.summaries(values)
    cell = {"rows": len(values), **{c: np.arange(len(values), dtype="<i8").tobytes() for c in ("ids", "keys", "labels")}, "values": values.astype("<i8").tobytes(), "sums": sums.tobytes(), "deviations": deviations.tobytes()}
    block, query = hard_negatives.Block(cell, 64), values[17]
    s, d = hard_negatives.summaries(query[None, :])
    for level in block.levels:
        middle, spread = hard_negatives.bounds(sums[:, level], deviations[:, level], s[:, level], d[:, level])
        assert (np.abs(values @ query - middle) <= spread).all()
    scored, real = [], block.exact
    monkeypatch.setattr(block, "exact", lambda rows, q: scored.append(len(rows)) or real(rows, q))
    best = np.sort(values @ query)
    for window in [(None, None), (int(best[4000]), int(best[-400]))]:
        scored.clear()
        [(_, [(rows, scores)])] = block.search(query[None, :], lambda _: np.ones(len(values), bool), [[window]], 5)
        fits = best[(best >= (best[0] if window[0] is None else window[0])) & (best <= (best[-1] if window[1] is None else window[1]))]
        assert fits[-5:][::-1].tolist() == scores.tolist() == (values[rows] @ query).tolist()
        assert window[0] is not None or sum(scored) < len(values) * most


def test_large_scores_are_exact(spark):
    rows = [(0, [2.0**20, 3.5], 1), (1, [2.0**20 + 1 / 256, -2.0], 1), (2, [2.0**19 + 1 / 256, 5.0], 2), (100, [2.0**14 + 1 / 256, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert columns(hard_negatives.mine(df)) == mined(rows) != []


def test_vectors_meet_anchors_in_bounded_pieces(spark, monkeypatch):
    """No row holds a block of vectors, so no join or sort holds several; waves of anchors and blocks of rows give what one of each gives."""
    r = np.random.default_rng(8)
    rows = [(k, x, k % 10) for k, x in enumerate((r.normal(0, 0.3, (50, 64))[np.arange(3000) % 50] + r.normal(0, 0.2, (3000, 64))).tolist())]
    df, real, most = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), hard_negatives.Scratch.save, []

    def save(self, table, tag):
        back = real(self, table, tag)
        wide = [F.length(c) if t == "binary" else 8 * F.size(c) for c, t in back.dtypes if t == "binary" or t.startswith("array")]
        most.extend(back.agg(F.max(w)).first()[0] for w in wide)
        return back

    monkeypatch.setattr(hard_negatives.Scratch, "save", save)
    got = columns(hard_negatives.mine(df, anchor_every=300))
    assert got == columns(hard_negatives.mine(df, anchor_every=300, rows_a_block=300, queries_a_block=4)) == mined(rows, 300) and len(got) > 300
    assert max(most) <= 64 * 8


def test_a_task_holds_one_block_whatever_its_rows():
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    r = np.random.default_rng(9)
    values = r.normal(0, 60, (16_000, 64)).astype(np.int64)
    some = np.arange(0, 16_000, 800)
    held = SimpleNamespace(value=hard_negatives.Queries(some, some, some % 10, values[some], [[]] * len(some)))

    def peak(n):
        def batches():
            for at in range(0, n, 500):
                ids = np.arange(at, at + 500)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, 500 * 64 + 1, 64), pa.int32()), pa.array(values[ids].ravel()))
                yield pa.record_batch([pa.array(ids), pa.array(ids), pa.array(ids % 10), vectors], names=["vec_id", "key", "label", "values"])

        tracemalloc.start()
        try:
            list(hard_negatives.find_positives(64, 5, 2000, held)(batches()))
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    assert peak(16_000) < 1.3 * peak(4000)


# Prefix trie.


def brute_trie(rows, every=5, heads=9):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(r, t) for _, _, r, t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % heads if every else 0
        base = c - int(math.fmod(c, every)) if every else c
        built[c] = tuple(convs.get(base, [])[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in built.items():
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) if children[p] else 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[k] for k in children[p])
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], sha(ends[p])) for p, m in members.items()), key=str)


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def nodes_of(df):
    return sorted((tuple(r[c] for c in NODE) for r in df.collect()), key=str)


def test_the_trie_of_a_corpus_equals_brute_force(spark):
    df = spark.read.parquet(f"{SMALL}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert nodes_of(prefix_trie.trie(df, every=5)) == brute_trie(rows)
    assert nodes_of(prefix_trie.trie(df)) == brute_trie(rows, every=None)


@pytest.mark.parametrize("seed, held", [(1, 1 << 20), (2, 40)])
def test_the_trie_of_odd_conversations_equals_brute_force(spark, monkeypatch, seed, held):
    monkeypatch.setattr(prefix_trie, "HELD", held)
    monkeypatch.setattr(prefix_trie, "STRIDE", 8)
    monkeypatch.setattr(prefix_trie, "MANY_CHILDREN", 3)
    r = random.Random(seed)
    words, rows = ["", None, "a", "bb", "é😀"], []
    for conv in [*range(-12, 90), 2**62]:
        known = [(r.choice(["user", None, ""]), r.choice(words)) for _ in range(4)] if conv % 7 else [("user", "a")] * 30
        for turn in range(r.choice([1, 2, 3, 9, 30])):
            rows.append((conv, None if turn == 0 and conv % 3 == 0 else turn, *(known[turn % len(known)] if r.random() < 0.9 else ("user", r.choice(words)))))
    rows += [(None, 0, "user", "no id"), (5, 3, "user", "tie"), (5, 3, "user", "tie"), (6, 0, "x" * 1000, "long " * 20_000), *[(1000 + k, 0, "user", "hot") for k in range(200)], *[(3000, k, "user", str(k % 3)) for k in range(300)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit(1)).withColumn("n", F.lit("x"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        assert nodes_of(prefix_trie.trie(df.repartition(3), every=5)) == brute_trie(rows)
        assert nodes_of(prefix_trie.trie(df)) == brute_trie(rows, every=None)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    assert prefix_trie.trie(df.limit(0), every=5).count() == 0


def test_handles_find_every_exit_node():
    assert [prefix_trie.two_fattest(a, b) for a, b in ((0, 1), (0, 7), (3, 7), (4, 7), (5, 7), (7, 9), (0, 1000))] == [1, 4, 4, 6, 6, 8, 512]
    r = random.Random(8)
    trie, seen = prefix_trie.Trie(0, (0, 0)), []
    for k in range(600):
        path = [r.randint(0, 1) for _ in range(r.randint(0, 40))] if k % 3 else [0] * r.randint(0, 60)
        names = [(hash(tuple(path[: d + 1])), d) for d in range(len(path))]
        node, depth = trie.exit_node(names)
        want = max((sum(1 for _ in iter_shared(names, other)) for other in seen), default=0)
        assert depth == want, k
        trie.insert(k, names, np.zeros(len(names), np.int64), 0, 0)
        seen.append(names)


def iter_shared(a, b):
    for x, y in zip(a, b):
        if x != y:
            return
        yield x


# Languages.


def symbols(text):
    out = [0]
    for c in text:
        s = language_id.symbol(ord(c))
        if s or out[-1]:
            out.append(s)
    return out[1:] + ([0] if out[-1] else [])


def brute_bits(training, text):
    """Bits a symbol by the textbook's recursion, over dictionaries."""
    counts = [defaultdict(int) for _ in range(5)]
    for t in training:
        s = [0, 0, 0, *symbols(t)]
        for k in range(3, len(s)):
            counts[4][tuple(s[k - 3 : k + 1])] += 1
    for n in (3, 2, 1):
        for gram in counts[n + 1]:
            counts[n][gram[1:]] += 1

    def p(gram):
        if not gram:
            return 1 / 64
        table = counts[len(gram)]
        ones, twos = sum(c == 1 for c in table.values()), sum(c == 2 for c in table.values())
        d = ones / (ones + 2 * twos) if ones else 0.5
        following = [c for g, c in table.items() if g[:-1] == gram[:-1]]
        if not following:
            return p(gram[1:])
        return max(table.get(gram, 0) - d, 0) / sum(following) + d * len(following) / sum(following) * p(gram[1:])

    s = [0, 0, 0, *symbols(text)]
    return -sum(math.log2(p(tuple(s[k - 3 : k + 1]))) for k in range(3, len(s))) / (len(s) - 3)


def test_cross_entropy_equals_the_textbook(monkeypatch):
    corpora = {"x": ["the cat sat. on the mat!", "a cat; a hat", "the the"], "y": ["le chat é là, là", "ça va, ça va", "un chat"]}
    texts = ["the cat", "le chat va", "zzz 9 é", "ÉÀ the", "日本 the ж", "é"]
    read, grams, counts = language_id.Symbols(), defaultdict(int), {}
    for k, (_, training) in enumerate(corpora.items()):
        for t in training:
            for keys in read.grams(t):
                for key in keys.tolist():
                    counts.setdefault(key, [0, 0])[k] += 1
    keys = np.array(sorted(counts))
    model = language_id.kneser_ney(keys, np.array([counts[k] for k in keys.tolist()]))
    for text in texts:
        want = [brute_bits(training, text) for training in corpora.values()]
        for part in (1 << 20, 3):
            monkeypatch.setattr(language_id, "PART", part)
            got = np.concatenate(list(read.grams(text)))
            assert len(got) == len(symbols(text))
            assert np.allclose(-language_id.log_probability(model, got, 4).mean(axis=0) / np.log(2), want), text


def test_held_out_languages(spark):
    docs = DOCS(spark, MID)
    rows = language_id.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and 0 <= r["score"] <= 1 for r in rows)
    assert len(rows) > 2000 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.99
    assert sum(r["rejected"] for r in rows) / len(rows) < 0.03


def test_languages_of_held_out_rows_are_not_learned_from(spark):
    docs = DOCS(spark, SMALL)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    a, b = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(d).collect()} for d in (docs, docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang")))))
    assert a == b and len(a) == docs.count()


def test_languages_of_odd_documents(spark):
    docs, odd = DOCS(spark, SMALL), odd_documents(spark)
    foreign = docs_of(spark, [(900_000, "qxzj vkqx jjzq xkcd qqqq zxzx vvkj wqxz " * 40), (900_001, "1234 ... !!"), (900_002, "𝔞𝔟 ﷽ ß")], extra=True).withColumn("lang", F.lit(None).cast("string"))
    rows = language_id.predict(docs.unionByName(odd, allowMissingColumns=True).unionByName(foreign)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert len(rows) == docs.count() + odd.count() + 3
    assert all((r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True) for k in (1, 2, 900_001) for r in by[k] if r["bits"] is None) and sum(r["lang_pred"] == "und" for r in rows) >= 4
    assert by[900_000][0]["rejected"] and by[900_000][0]["lang_pred"] != "und" and by[900_002][0]["lang_pred"] != "und"
    assert language_id.predict(docs.limit(0)).count() == 0
    unlearned = language_id.predict(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in unlearned} == {("und", 0.0)}


@pytest.mark.parametrize("name", ["op11_segment_hard_negatives", "op12_z_fast_prefix_trie"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from tideline.llm import queries

    duck = duckdb.connect()
    for t in ("embeddings", "conversations"):
        duck.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    ours, cursor = queries.QUERIES[name](spark, SMALL), duck.execute(queries.ORACLE_SQL[name])
    names, columns_ = sorted(ours.columns), [d[0] for d in cursor.description]
    assert sorted(columns_) == names
    want = sorted((tuple(r[columns_.index(c)] for c in names) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in names) for r in ours.collect()), key=str) == want != []
