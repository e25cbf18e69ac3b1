"""Near-duplicates, contamination, repeated bytes, components and the pipeline."""

import hashlib
import random
import time
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from fractions import Fraction
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import DOCS, SMALL, docs_of, odd_documents, tables
from tideline.llm import bloom, common, components, minhash, packing, spaced_seeds, suffix_dedup
from tideline.llm.common import Scratch
from tideline.scratch import shared_folder


def brute_components(rows, n, percent=80):
    sets = [(i, minhash.shingle_set(t or "", n)) for i, t in rows]
    top = list(range(len(sets)))

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for a, (_, x) in enumerate(sets):
        for b in range(a):
            y = sets[b][1]
            common = len(x & y)
            if x and y and 100 * common >= percent * (len(x) + len(y) - common):
                top[find(a)] = find(b)
    least = defaultdict(list)
    for a, (i, s) in enumerate(sets):
        least[find(a)].append(i)
    return sorted((i, len(s), min(least[find(a)])) for a, (i, s) in enumerate(sets))


def words(r, n):
    return [r.choice("abcdefghij") + r.choice("klmnop") + str(r.randint(0, 30)) for _ in range(n)]


def near_copies(r, base, n, most):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, most)):
            w[r.randrange(len(w))] = r.choice(words(r, 5))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("how", ["inner", "left"])
def test_a_frequent_key_is_spread_and_loses_no_row(spark, monkeypatch, how):
    monkeypatch.setattr(common, "SPREAD", 16)
    rows = spark.range(1000).selectExpr("id", "case when id % 3 = 0 then 7 when id % 50 = 1 then null else id % 40 + 100 end as key")
    keyed = rows.where("key is not null and key <> 139").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    out = common.spread_join(rows, keyed, ["key"], "n", "id", how)
    assert sorted(out.columns) == ["id", "key", "least"]
    assert sorted(map(str, out.select("id", "key", "least").collect())) == sorted(map(str, rows.join(keyed, "key", how).select("id", "key", "least").collect()))
    tasks = out.where("key = 7").select(F.xxhash64("id") % 21).distinct().count()  # 334 rows go 21 ways
    assert tasks > 5


def test_links_and_repeats_with_spread_keys_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(common, "SPREAD", 3)
    r = random.Random(8)
    base = words(r, 120)
    texts = near_copies(r, base, 60, 30) + [" ".join(base)] * 20 + [" ".join(words(r, 60)) for _ in range(10)]
    rows = list(enumerate(texts))
    found = minhash.near_duplicates(docs_of(spark, rows), 2).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found)) == brute_components(rows, 2)
    found = suffix_dedup.repeated_bytes(docs_of(spark, rows), 200).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, found)) == brute_bytes(rows, 200)


def test_no_setting_of_the_session_changes(spark):
    before = dict(spark.conf.getAll)
    docs = docs_of(spark, [(1, "some words of a text"), (2, None)])
    minhash.near_duplicates(docs).collect()
    suffix_dedup.repeated_bytes(docs).collect()
    packing.pack(docs).collect()
    assert dict(spark.conf.getAll) == before


@pytest.mark.parametrize("n", [2, 5])
def test_components_of_near_copies_against_brute_force(spark, n):
    r = random.Random(n)
    base = words(r, 150)
    texts = near_copies(r, base, 120, 25) + [" ".join(words(r, 40)) for _ in range(60)] + ["a b", "A  B", "a b c", "", "   ", "x", "X"]
    texts += [" ".join(base[:75] + words(r, 10))] + [texts[0]] * 3
    r.shuffle(texts)
    rows = list(enumerate(texts))
    out = minhash.near_duplicates(docs_of(spark, rows, extra=True), words=n).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == brute_components(rows, n)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_components_of_the_documents_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in DOCS(spark, "/root/testdata/sf0.01").collect()]
    out = minhash.near_duplicates(DOCS(spark, "/root/testdata/sf0.01"), words=2).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == brute_components(rows, 2)


def test_a_large_bucket_below_the_threshold_stays_in_bounded_shards(spark, monkeypatch):
    """Five thousand texts that share a bucket but are no near-duplicates, and two that are."""
    sizes = []
    inner = minhash.open_pairs
    marks = np.zeros((5000, minhash.HASHES), dtype="<u4")
    marks[:, 5:] = np.random.default_rng(5).integers(0, 1 << 31, (5000, minhash.HASHES - 5))
    marks[4001] = marks[17]
    shard = {"owner": np.repeat(9, 5000), "part": np.zeros(5000, int), "band": np.zeros(5000, int), "node": np.arange(5000), "root": np.arange(5000), "guest": np.arange(5000) < 256, "late": np.ones(5000, bool), "signature": [m.tobytes() for m in marks]}
    monkeypatch.setattr(minhash, "surviving", lambda m, i, j, least, f=minhash.surviving: sizes.append(len(i)) or f(m, i, j, least))
    found = [(int(a), int(b)) for i, j, _ in inner(pd.DataFrame(shard), minhash.least_matches(0.8, 1e-3)) for a, b in zip(i, j)]
    assert found == [(17, 4001)] and max(sizes) < minhash.STRIDE + 64 * 5000


@pytest.mark.parametrize("cell", [7, 256])
def test_cells_meet_every_straggler_with_every_member_once(spark, monkeypatch, cell):
    """A chain of texts each near only to its neighbours, in cells smaller than the bucket."""
    monkeypatch.setattr(minhash, "CELL", cell)
    r = random.Random(cell)
    base = words(r, 400)
    rows = [(k, " ".join(base[4 * k : 4 * k + 60])) for k in range(80)] + [(100 + k, t) for k, t in enumerate(near_copies(r, base[:80], 60, 14))]
    out = minhash.near_duplicates(docs_of(spark, rows), words=2).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == brute_components(rows, 2)


def shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    time.sleep(0.3)
    found = sc.statusStore().executorList(False)
    return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))


def test_nothing_moves_of_nodes_without_a_neighbour_but_names_and_one_signature(spark):
    """Of a text like no other: its signature once, a count for each of its buckets, and its ids; no seats, no text, no other copy of the signature."""
    r = random.Random(12)
    rows = list(enumerate([" ".join(words(r, 60)) for _ in range(1500)] + near_copies(r, words(r, 60), 40, 10)))
    docs = docs_of(spark, rows).repartition(4).localCheckpoint()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        found = minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
        moved = shuffled(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, found)) == brute_components(rows, 5)
    assert 300 < moved / len(rows) < 900


def test_texts_past_the_broadcast_come_by_a_filter(spark, monkeypatch):
    monkeypatch.setattr(minhash, "MAX_BROADCAST_ROWS", 0)
    r = random.Random(13)
    base = words(r, 90)
    rows = [(None if k == 3 else k, t) for k, t in enumerate(near_copies(r, base, 60, 20) + [" ".join(words(r, 30)) for _ in range(400)])]
    rows += [rows[1], rows[1], (900, rows[2][1])]
    found = minhash.near_duplicates(docs_of(spark, rows), words=2).select("doc_id", "n_shingles", "component_id").collect()
    monkeypatch.undo()
    assert sorted(map(str, found)) == sorted(map(str, minhash.near_duplicates(docs_of(spark, rows), words=2).select("doc_id", "n_shingles", "component_id").collect()))
    docs = docs_of(spark, rows).withColumn("text_key", common.text_key(F.col("text"))).select("doc_id", "text", "text_key")
    held = spark.sparkContext.broadcast(bloom.bloom_filter(docs.where("doc_id = 2").select("text_key"), minhash.BITS_A_KEY))
    assert [r["doc_id"] for r in docs.mapInArrow(minhash.sifted(held), docs.schema).collect()] == [2, 900]


def test_bloom_filters_lose_no_key_and_are_bounded(spark, monkeypatch):
    keys = np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 60_000)
    table = spark.createDataFrame(pd.DataFrame({"key": keys[:40_000]}))
    held = bloom.bloom_filter(table, 16)
    assert bloom.may_hold(held, keys[:40_000].view(np.uint64)).all()
    assert bloom.may_hold(held, keys[40_000:].view(np.uint64)).mean() < 0.01
    assert bloom.may_hold(held, keys[:0].view(np.uint64)).tolist() == []
    monkeypatch.setattr(bloom, "MOST_BITS", 18)
    held = bloom.bloom_filter(table, 16)
    assert len(held) * 64 == 1 << 18 and bloom.may_hold(held, keys[:40_000].view(np.uint64)).all()


def test_buckets_are_the_bands_of_signatures():
    marks = np.random.default_rng(4).integers(0, 2, (300, minhash.HASHES), dtype=np.uint8) * np.uint8(255)
    found = minhash.buckets_of(pa.array([m.tobytes() for m in marks], pa.binary()))
    told = {}
    for m, row in zip(marks, found.tolist()):
        for band, bucket in enumerate(row):
            assert told.setdefault(bucket, key := (band, m[band * minhash.ROWS : (band + 1) * minhash.ROWS].tobytes())) == key
    assert len(set(told.values())) == len(told)


def test_near_duplicates_of_odd_documents(spark):
    odd = odd_documents(spark)
    got = sorted(((r["doc_id"] or -1), r["component_id"], r["n_shingles"], r["kept"]) for r in minhash.near_duplicates(odd, words=2).collect())
    assert got[:4] == [(-1, None, 0, True), (-1, None, 7, True), (1, 1, 0, True), (2, 2, 0, True)]
    assert [g[1] for g in got if g[0] in (4, 5)] == [4, 4] and [g[1:] for g in got if g[0] == 3] == [(3, 1, True)] * 2
    assert minhash.near_duplicates(odd.limit(0)).count() == 0
    kept = minhash.keep_one(odd, words=2)
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, -1, 1, 2, 3, 4, 6, 7, 8] and kept.columns == odd.columns


def test_posterior_bounds():
    least = minhash.least_matches(0.8, 1e-3)
    assert len(least) == 5 and least == sorted(least) and 0.6 * minhash.HASHES < least[-1] < 0.8 * minhash.HASHES


def test_the_loss_over_all_batches_is_within_the_miss():
    r = np.random.default_rng(3)
    for threshold in (0.7, 0.8, 0.9):
        least = minhash.least_matches(threshold, 1e-3)
        assert 1e-4 < minhash.sequential_loss(least, threshold) <= 1e-3
        matches = r.binomial(minhash.BATCH, threshold, (400_000, len(least))).cumsum(axis=1)
        assert (matches < np.array(least)).any(axis=1).mean() < 1.2e-3


def test_connected_components(spark):
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)] + [(5, 5)]
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "x long, y long"), Scratch(spark, "test")).collect()}
    top = {}

    def find(a):
        while top.setdefault(a, a) != a:
            a = top[a]
        return a

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    assert got == {a: find(a) for a in top}
    assert components.components(spark.createDataFrame([], "x long, y long"), Scratch(spark, "test")).count() == 0


def test_contamination_tolerates_substitutions(spark):
    r = random.Random(4)
    items = [(k, " ".join(words(r, n))) for k, n in enumerate((40, 25, 15, 8, 6, 3))] + [(90, None), (None, " ".join(words(r, 20)))]
    docs, want = [], set()
    for d in range(60):
        filler = words(r, 60)
        k = d % 7
        if k < 5:
            w = items[k][1].split()
            if len(w) >= 15:
                for _ in range(len(w) // 10):
                    w[r.randrange(len(w))] = "changed"
            filler[20:20] = w
            want.add((d, k))
        docs.append((d, " ".join(filler).upper() if d % 2 else " ".join(filler)))
    docs += [(100, items[5][1]), (101, None), (102, ""), (103, " ".join(items[0][1].split()[:16])), (104, " ".join(items[0][1].split()[:8]))]
    want |= {(103, 0), (100, 5)}
    docs.append((105, "and " + items[5][1]))  # a short item is found as a whole document only
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = docs_of(spark, docs, extra=True)
    assert {(x["doc_id"], x["item_id"]) for x in spaced_seeds.links(table, bench).collect()} == want
    counts = {x["doc_id"]: x["n_items"] for x in spaced_seeds.overlaps(table, bench).collect()}
    assert counts == {d: sum(e == d for e, _ in want) for d, _ in want}
    kept = {x["doc_id"] for x in spaced_seeds.keep_clean(table, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}
    assert spaced_seeds.overlaps(table, bench.limit(0)).count() == 0 == spaced_seeds.overlaps(table.limit(0), bench).count()
    assert spaced_seeds.overlaps(odd_documents(spark), bench).count() == 0


def verdict(doc, item, shifts):
    """What is said of one pair, as (matched_words, first_word, end_word)."""
    return spaced_seeds.judged(doc, item, shifts, 13, Fraction("0.8"))


def brute_verdict(doc, item, shifts):
    """The docstring's rule, by trying every stretch of every shift."""
    covered, best, spans = set(), 0, []
    for shift in shifts:
        for a in range(len(item)):
            for b in range(a + 1, len(item) + 1):
                equal = [j for j in range(a, b) if 0 <= j + shift < len(doc) and doc[j + shift] == item[j]]
                if len(equal) >= min(5, len(item)) and 5 * len(equal) >= 4 * (b - a):
                    covered |= set(equal)
                    best = max(best, len(equal))
                    spans += [equal[0] + shift, equal[-1] + shift + 1]
    good = best >= min(13, len(item)) or (len(covered) >= 5 and 5 * len(covered) >= 4 * len(item))
    return (len(covered), min(spans), max(spans)) if good else None


def test_verification_is_the_stated_rule():
    r, accepted = random.Random(9), 0
    for trial in range(1500):
        n = r.randint(5, 45)
        item = [f"w{k}" for k in range(n)]
        laid = list(item)
        for k in r.sample(range(n), r.randint(0, n // 5 + 1)):
            laid[k] = "changed"
        shifts = [7]
        if trial % 3 == 0:  # a word more in the middle: a second shift
            laid.insert(r.randrange(n), "more")
            shifts.append(8)
        doc = ["foreign"] * 7 + laid + ["foreign"] * 3
        want = brute_verdict(doc, item, shifts)
        assert verdict(doc, item, shifts) == want, (item, laid)
        accepted += want is not None
    assert 500 < accepted < 1500
    fifteen, halves = [f"w{k}" for k in range(15)], [f"w{k}" for k in range(24)]
    edges = [w if k not in (1, 13) else "changed" for k, w in enumerate(fifteen)]
    assert verdict(["x", *edges, "x"], fifteen, [1]) == (13, 1, 16)
    assert verdict(["x", *halves[:10], *["changed"] * 4, *halves[14:], "x"], halves, [1]) == (20, 1, 25)


def test_no_arrangement_that_verification_accepts_is_without_a_seed():
    masks = [m.rstrip("0") for m in spaced_seeds.MASKS]
    for n in range(5, 22):
        laid = np.arange(1 << n)
        equal = sum((laid >> k) & 1 for k in range(n))
        hit = np.zeros(len(laid), bool)
        for mask in masks:
            for k in range(n - len(mask) + 1):
                kept = int(mask[::-1], 2) << k
                hit |= (laid & kept) == kept
        assert hit[(equal >= 5) & (5 * equal >= 4 * n)].all()


def test_stretches_have_as_many_words_in_seeds_as_is_said():
    """Over all arrangements: what a stretch has in seeds at least, by equal and changed words, and in any of 13 equal words."""
    masks = [m.rstrip("0") for m in spaced_seeds.MASKS]
    for n in range(5, 19):
        laid = np.arange(1 << n)
        equal, held = sum((laid >> k) & 1 for k in range(n)), np.zeros(len(laid), dtype=np.int64)
        for mask in masks:
            for k in range(n - len(mask) + 1):
                kept = int(mask[::-1], 2) << k
                held |= np.where((laid & kept) == kept, kept, 0)
        inside = sum((held >> k) & 1 for k in range(n))
        for changed in range(n // 5 + 1):
            assert inside[equal == n - changed].min() >= spaced_seeds.hit_words(n - changed, changed), (n, changed)
            assert spaced_seeds.hit_words(n - changed, changed) >= spaced_seeds.of_stretch(n - changed, changed)
    assert min(spaced_seeds.of_stretch(n, n) for n in range(13, 25)) == spaced_seeds.ENOUGH


def brute_links(docs, items):
    """Every document against every item, at every shift at which they share a word."""
    out = set()
    for d, text in docs:
        doc = spaced_seeds.words_of(text)
        for i, told in items:
            item = spaced_seeds.words_of(told)
            if len(item) < 5:
                if item and item == doc:
                    out.add((d, i))
                continue
            shifts = sorted({a - b for a, x in enumerate(doc) for b, y in enumerate(item) if x == y})
            if spaced_seeds.judged(doc, item, shifts, 13, Fraction("0.8")):
                out.add((d, i))
    return out


def test_links_with_common_phrases_equal_brute_force(spark):
    """Documents and items made of the same few phrases, cut, changed and moved: every seed is frequent."""
    r = random.Random(21)
    phrases = [words(r, r.randint(2, 9)) for _ in range(12)]

    def text(parts):
        out = sum((r.choice(phrases) if r.random() < 0.8 else words(r, r.randint(1, 4)) for _ in range(parts)), [])
        for _ in range(r.randint(0, len(out) // 6)):
            out[r.randrange(len(out))] = "changed"
        return " ".join(out)

    items = [(i, text(r.randint(1, 7))) for i in range(70)]
    docs = [(d, text(r.randint(1, 12)) if d % 3 else f"{text(2)} {items[d % 70][1]} {text(2)}") for d in range(90)]
    want = brute_links(docs, items)
    got = {(x["doc_id"], x["item_id"]) for x in spaced_seeds.links(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and len(want) > 150


def test_a_phrase_of_all_items_and_documents_makes_no_pairs(spark):
    """One stem in each of 4,000 items and documents: 16 million pairs if they met by it."""
    r, stem, n = random.Random(6), "which of the following is", 4000
    unlike = lambda k: " ".join(f"{k}w{r.randint(0, 10**9)}" for _ in range(20))
    docs = docs_of(spark, [(k, f"{unlike('d')} {stem} {unlike('d')}") for k in range(n)] + [(n, unlike("i"))])
    items = [(k, f"{stem} {unlike('i')}") for k in range(n)]
    docs = docs.unionByName(docs_of(spark, [(n + 1, f"{unlike('d')} {items[77][1]} {unlike('d')}")]))
    began = time.time()
    out = spaced_seeds.links(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(x["doc_id"], x["item_id"]) for x in out] == [(n + 1, 77)] and time.time() - began < 90


def test_dense_changes_and_short_items_are_found(spark):
    w = [f"w{k}" for k in range(99)]
    items = {0: w, 1: [f"a{k}" for k in range(9)], 2: [f"b{k}" for k in range(8)], 3: [f"c{k}" for k in range(5)], 4: [f"d{k}" for k in range(6)]}
    laid = {0: [x if k % 5 != 4 else "changed" for k, x in enumerate(w)], 3: items[3]}
    laid |= {10 + k: [x if j != k else "changed" for j, x in enumerate(items[1])] for k in range(9)}
    laid |= {20 + k: [x if j != k else "changed" for j, x in enumerate(items[2])] for k in range(8)}
    laid |= {30 + k: [x if j != k else "changed" for j, x in enumerate(items[4])] for k in range(6)}
    want = {(d, {0: 0, 3: 3}.get(d, {1: 1, 2: 2, 3: 4}.get(d // 10))) for d in laid}
    docs = docs_of(spark, [(d, " ".join(["foreign", "text", *x, "more", "text"])) for d, x in laid.items()])
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in spaced_seeds.links(docs, bench).collect()} == want


def test_a_passage_of_many_items_gives_one_row_a_document(spark):
    r = random.Random(8)
    passage = " ".join(words(r, 30))
    bench = spark.createDataFrame([(k, f"{passage} item {k} {' '.join(words(r, 6))}") for k in range(90)], "item_id long, text string")
    docs = docs_of(spark, [(k, f"{' '.join(words(r, 20))} {passage} {' '.join(words(r, 20))}") for k in range(40)])
    out = spaced_seeds.overlaps(docs, bench).collect()
    assert sorted(x["doc_id"] for x in out) == list(range(40)) and {x["n_items"] for x in out} == {90}


def test_planted_items_are_found_and_nothing_else(spark):
    docs, bench = tables(spark, SMALL, "documents", "benchmark")
    plain = lambda t: " ".join(spaced_seeds.words_of(t))
    items = {b["item_id"]: plain(b["text"]) for b in bench.collect()}
    want = {(d["doc_id"], i) for d in docs.collect() for i, t in items.items() if f" {t} " in f" {plain(d['text'])} "}
    assert {(x["doc_id"], x["item_id"]) for x in spaced_seeds.links(docs, bench).collect()} == want


def test_a_window_keeps_its_hash_when_ignored_words_change():
    h = np.arange(1, 10, dtype=np.uint64)
    for mask in spaced_seeds.MASKS:
        other = h.copy()
        for j, kept in enumerate(mask):
            if kept == "0":
                other[j] = 99
        assert (spaced_seeds.seeds(h, mask) == spaced_seeds.seeds(other, mask)).all() and spaced_seeds.seeds(h[:3], mask).size == 0


def brute_bytes(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = defaultdict(int)
    for b in data:
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] += 1
    out = []
    for (i, _), b in zip(rows, data):
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        gone = gone[:-1]
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def planted(r, n, length):
    passage = [" ".join(words(r, 90)) for _ in range(4)]
    rows = []
    for k in range(n):
        w = " ".join(words(r, r.randint(0, 120)))
        if k % 3 == 0:
            p = passage[k % 4]
            a = r.randint(0, 100)
            w = w[: r.randint(0, len(w))] + p[a : a + r.randint(length - 3, 420)] + w[::-1]
        if k % 17 == 0:
            w += "ab" * r.randint(40, 300)
        if k % 13 == 0 and rows:
            w = rows[-1][1]
        rows.append((k, w))
    return rows + [(n, ""), (n + 1, None), (n + 2, "z" * (length + 1)), (n + 3, "y" * length), (n + 4, "ä€" * 150), (n + 5, "€ä" * 149)]


@pytest.mark.parametrize("length, chunk", [(200, 512), (200, 7), (60, 5)])
def test_repeated_bytes_against_brute_force(spark, monkeypatch, length, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "SHARD", 40)
    rows = planted(random.Random(length + chunk), 160, length)
    out = suffix_dedup.repeated_bytes(docs_of(spark, rows, extra=True), length).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == brute_bytes(rows, length)


def test_repeated_bytes_of_odd_documents(spark):
    odd = odd_documents(spark)
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.repeated_bytes(odd).collect()}
    n = len("same text, same words " * 20)
    assert {(1, 0, 0, 0), (3, 4, 0, 0), (4, n, n, 1), (5, n, n, 1), (6, 300_000, 300_000, 1), (7, 480_000, 480_000, 1)} <= got
    assert suffix_dedup.repeated_bytes(odd.limit(0)).count() == 0
    kept = {r["doc_id"]: r["kept"] for r in suffix_dedup.repeated_bytes(odd, with_text=True).collect()}
    assert kept[4] == b""


def test_suffix_arrays_and_common_prefixes():
    r = random.Random(9)
    parts = ["".join(r.choice("ab") for _ in range(r.randint(1, 60))).encode() for _ in range(30)] + [b"abab" * 12, b"abab" * 12, b"a\x00b\x00", b"a"]
    s = suffix_dedup.Stretches(parts)
    sa, rank = suffix_dedup.suffix_array(s)
    suffix = {int(s.start[k]) + i: (p[i:], k) for k, p in enumerate(parts) for i in range(len(p))}
    assert sa.tolist() == sorted(suffix, key=lambda at: suffix[at]) and (rank[sa] == np.arange(len(sa))).all()
    shared = suffix_dedup.common_prefixes(s, sa, rank, 10)
    for k in range(1, len(sa)):
        a, b = suffix[int(sa[k - 1])][0], suffix[int(sa[k])][0]
        if len(b) >= 10:
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert shared[k] == min(n, 10)


def test_anchors_depend_on_the_string_alone():
    r = random.Random(2)
    text = " ".join(words(r, 300)).encode()
    (whole,) = suffix_dedup.anchors([text], 200)
    shifted = list(suffix_dedup.anchors([b"x" * 333, text[57:], b"short"], 200))[1]
    assert set(shifted[0].tolist()) <= set(whole[0].tolist()) and sum(whole[2]) == len(text) - 199


def test_calls_in_threads_do_not_touch_each_other(spark):
    docs = DOCS(spark, SMALL)
    calls = [lambda: minhash.near_duplicates(docs, words=2), lambda: suffix_dedup.repeated_bytes(docs), lambda: minhash.near_duplicates(docs, words=2)]
    with ThreadPoolExecutor(3) as pool:
        near, gone, again = [sorted(map(tuple, rows)) for rows in pool.map(lambda f: f().collect(), calls)]
    assert near == again == sorted(map(tuple, calls[0]().collect())) and gone == sorted(map(tuple, calls[1]().collect()))


def test_stages_of_odd_and_of_no_documents(spark):
    for docs in (odd_documents(spark), odd_documents(spark).limit(0)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            assert (out.count() > 0) == (n > 0), name
            if name != "packing":
                assert out.columns == docs.columns and out.count() <= n, name
                docs = out


def test_pipeline(spark):
    folder = Path(shared_folder(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    out = corpus_pipeline.run(spark, SMALL)
    (made,) = set(folder.iterdir()) - before
    assert [p.name.split("-")[1] for p in made.iterdir()] == ["packing"]  # the result, and nothing else
    docs = {r["doc_id"] for r in DOCS(spark, SMALL).collect()}
    rows = out.collect()
    assert {r["doc_id"] for r in rows} <= docs and 0 < len({r["doc_id"] for r in rows}) < len(docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "packing"]


def test_every_stage_against_its_parts(spark):
    """Each stage keeps the columns of documents, and the last packs exactly what the one before it kept."""
    docs = DOCS(spark, SMALL)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.collect()}
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        after = {r["doc_id"] for r in docs.collect()}
        assert after <= before and (name != "pii" or after == before)
    packed = {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()}
    assert packed == {r["doc_id"] for r in packing.pack(docs).collect()} == {r["doc_id"] for r in docs.collect()}
