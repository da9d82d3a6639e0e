"""Near-copy groups, neighbours and shards against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqalert.llm import jaccard, neighbours, shards
from seqalert.llm.components import components
from seqalert.llm.text import lower_words, shingles


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_groups(rows, k, percent):
    """doc_id -> (set size per row, component) from every pair of texts."""
    sets = []
    for doc, text in rows:
        w = lower_words(text)
        n = min(k, len(w))
        sets.append((doc, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()))
    parent = {d: d for d, _ in rows if d is not None}
    live = [(d, s) for d, s in sets if d is not None and s]
    for i, (a, x) in enumerate(live):
        for b, y in live[:i]:
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                lo, hi = sorted((find(parent, a), find(parent, b)))
                parent[hi] = lo
    return sorted(((d, len(s), None if d is None else find(parent, d)) for d, s in sets), key=repr)


def near_texts(seed, n=120):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + r.choice("xyz")
    passage = [word() + "q" for _ in range(30)]
    base = [[word() for _ in range(r.randint(1, 80))] for _ in range(8)]
    out = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice((0, 0, 1, 2, 3, 8))):
            w[r.randrange(len(w))] = word()
        if r.random() < 0.3:
            w += passage
        out.append((i * 7 % 1000, " ".join(w).upper() if r.random() < 0.2 else "\t".join(w)))
    return out + [(5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "ONE"), (None, "one"), (5005, "one"), (5005, "two words"), (5006, "two words"), (5006, None), (5007, "z " * 3000)]


@pytest.mark.parametrize("k,percent,task_docs,held,task_shingles", [(4, 85, 20_000, 2_000_000, 4_000_000), (5, 80, 20_000, 300, 150), (3, 60, 3, 200, 4_000_000), (4, 85, 100, 2_000_000, 4_000_000)])
def test_near_groups(spark, k, percent, task_docs, held, task_shingles):
    rows = near_texts(k)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"component_id": F.lit("x"), "block": F.lit(1), "a": F.lit(2), "key": F.lit(3)})
    got = jaccard.near_groups(docs.repartition(5), k, percent, task_docs=task_docs, held=held, task_shingles=task_shingles)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_groups(rows, k, percent)


def test_near_groups_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert jaccard.near_groups(docs).collect() == [] and jaccard.keep_one(docs).collect() == []


def brute_kept(rows):
    """(doc_id, text) that stay: every distinct pair is a document of its own."""
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    pairs = sorted({(d, sha(t)): t for d, t in rows if d is not None}.items())
    found = brute_groups([(i, t) for i, (_, t) in enumerate(pairs)], 5, 80)
    return {(pairs[i][0][0], pairs[i][0][1]) for i, _, c in found if i == c}


@pytest.mark.parametrize("repeats", [False, True])
def test_keep_one(spark, repeats):
    rows = near_texts(9)
    if not repeats:
        rows = list({d: (d, t) for d, t in rows}.values())
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"lang": F.lit("en"), "digest": F.lit(1), "number": F.lit(2), "_least": F.lit(3), "component_id": F.lit(4)})
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in kept.collect()]
    assert Counter(g for g in got if g[0] is not None) == Counter(brute_kept(rows))
    assert sum(d is None for d, _ in got) == 1


@pytest.mark.parametrize("sent", [jaccard.SENT, 0])
def test_ids_reach_the_tasks_as_arrays(spark, monkeypatch, sent):
    """The driver hashes no table of ids: they are sent as plain arrays, or shuffled where they are too many."""
    rows = list({d: (d, t) for d, t in near_texts(9)}.values())
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("block", F.lit(1))
    shared = []
    monkeypatch.setattr(jaccard, "share", lambda df, *bound: shared.append(df.columns) or df)
    monkeypatch.setattr(jaccard, "SENT", sent)
    kept = jaccard.keep_one(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert not shared and ("ArrowEvalPython" in plan) == (sent > 0)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert {(r["doc_id"], sha(r["text"])) for r in kept.collect() if r["doc_id"] is not None} == brute_kept(rows)
    got = jaccard.near_groups(docs, 3, 60, task_docs=3)
    assert shared == [["block", "pivot", "chunks", "asked"]]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_groups(rows, 3, 60)


def test_kept_rows_of_an_id_do_not_depend_on_the_parts(spark):
    texts = [f"text number {i} tells of things that no other text has told {i * i}" for i in range(12)]
    near = " ".join(f"w{i}" for i in range(80))
    rows = [(1, t, 0) for t in texts] + [(1, texts[0], 1), (1, None, 0), (1, "", 0), (2, near, 0), (2, near + " end", 0), (3, near + " more", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, other int")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted([(1, t) for t in texts] + [(1, "")] + [(2, min(near, near + " end", key=sha))])
    seen = set()
    for order in ("text", "reverse(text)", "hash(text, other)"):
        got = jaccard.keep_one(docs.orderBy(F.expr(order)).coalesce(1)).collect()
        assert sorted((r["doc_id"], r["text"] or "") for r in got) == want
        seen.add(tuple(sorted((repr(tuple(r)) for r in got))))
    assert len(seen) == 1


def test_search_equals_brute_force():
    r = random.Random(3)
    sets = [np.unique(np.array(r.sample(range(60), r.randint(1, 40)), np.uint64)) for _ in range(150)]
    for percent in (50, 80, 100):
        index = jaccard.Index(sets, np.ones(len(sets), bool))
        for q in sets[:60]:
            both = [len(set(q.tolist()) & set(s.tolist())) for s in sets]
            want = [i for i, s in enumerate(sets) if 100 * both[i] >= percent * (len(q) + len(s) - both[i])]
            assert sorted(index.search(q, percent)) == want


def test_linked_sets_share_a_signature():
    r = random.Random(4)
    for percent in (60, 80, 85):
        ranges = jaccard.size_ranges(percent, 4096)
        starts = [x for x, _ in ranges]
        for _ in range(300):
            n = int(2 ** r.uniform(0, 10))
            x = np.unique(np.array([r.getrandbits(64) for _ in range(n)], np.uint64))
            y = set(x.tolist())
            while True:
                z = set(y)
                (z.add(r.getrandbits(64)) if r.random() < 0.5 else z.discard(r.choice(sorted(z))))
                both = len(z & set(x.tolist()))
                if not z or 100 * both < percent * (len(x) + len(z) - both):
                    break
                y = z
                if r.random() < 0.02:
                    break
            y = np.array(sorted(y), np.uint64)
            for share in (0, 0.3, 1):
                common = np.array(sorted(v for v in {*x.tolist(), *y.tolist()} if r.random() < share), np.uint64)
                assert set(jaccard.signatures(x, percent, ranges, starts, common)) & set(jaccard.signatures(y, percent, ranges, starts, common))


def test_shingles_of_short_and_long_texts():
    assert len(shingles(None, 4)) == len(shingles(" \t", 4)) == 0
    assert len(shingles("a b", 4)) == 1 and len(shingles("a b c d e a b c d", 4)) == 5


def test_components(spark):
    r = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100 + r.randrange(80), 100 + r.randrange(80)) for _ in range(50)] + [(900, 900)]
    parent = {x: x for p in pairs for x in p}
    for a, b in pairs:
        lo, hi = sorted((find(parent, a), find(parent, b)))
        parent[hi] = lo
    edges = spark.createDataFrame([*pairs, (None, 3)], "a bigint, b bigint")
    assert dict(map(tuple, components(edges).collect())) == {x: find(parent, x) for x in parent}


def brute_nearest(rows, asks, k):
    by = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            by[i] = min(by.get(i, v), v)
    out = {}
    for q in asks:
        if q in by:
            a = np.array(by[q], float)
            s = sorted((-float(a @ np.array(v, float) / np.linalg.norm(a) / np.linalg.norm(v)), i) for i, v in by.items() if i != q)
            out[q] = [i for _, i in s[:k]]
    return out


def test_nearest_with_edges(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=20).tolist()) for i in range(300)]
    rows += [(400, None), (401, [0.0] * 20), (402, [float("nan")] * 20), (403, [1.0] * 19 + [None]), (None, [1.0] * 20), (404, rows[7][1]), (405, rows[7][1]), (7, rows[7][1]), (406, [float("inf")] * 20)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({"score": F.lit(1), "block": F.lit(1), "id": F.lit(0)})
    asks = [7, 404, 10, 20, 30, 40, 50, 401, 402]
    got = neighbours.nearest(df, df.where(F.col("vec_id").isin(asks)), k=5, block_rows=64, block_queries=3).orderBy("query_id", "rank").collect()
    want = brute_nearest(rows, asks, 5)
    assert {x["query_id"] for x in got} == set(want)
    hits = sum(x["vec_id"] in want[x["query_id"]] for x in got)
    assert len(got) == 5 * len(want) and hits >= 0.9 * len(got)
    assert [(x["rank"], x["vec_id"]) for x in got if x["query_id"] == 7][:2] == [(1, 404), (2, 405)]
    few = neighbours.nearest(df.where("vec_id < 3"), df.where("vec_id = 1")).collect()
    assert sorted(x["vec_id"] for x in few) == [0, 2]
    assert neighbours.nearest(df.where("false"), df).collect() == []


def test_recall_on_embeddings(spark):
    d = "/root/testdata/sf0.1/embeddings.parquet"
    df = spark.read.parquet(d)
    got = neighbours.nearest(df, df.where("vec_id % 50 = 0")).collect()
    rows = [(x["vec_id"], x["embedding"]) for x in df.collect()]
    want = brute_nearest(rows, [i for i, _ in rows if i % 50 == 0], 5)
    assert sum(x["vec_id"] in want[x["query_id"]] for x in got) >= 0.9 * 5 * len(want)


def test_tables_find_every_code_within_the_radius():
    r = np.random.default_rng(5)
    codes = r.integers(0, 4, (400, 4)).astype(np.uint16) * np.uint16(257)
    tables = neighbours.Tables(codes)
    for radius in (0, 3, 7, 12, 30):
        for q in codes[:20]:
            assert tables.within(q, radius).tolist() == np.flatnonzero(np.bitwise_count(codes ^ q).sum(1) <= radius).tolist()


def brute_best_fit(sizes, capacity):
    rooms, out = [], []
    for s in sizes:
        fits = [(room, i) for i, room in enumerate(rooms) if room >= s]
        if not fits:
            rooms.append(capacity)
            fits = [(capacity, len(rooms) - 1)]
        i = min(fits)[1]
        rooms[i] -= s
        out.append(i)
    return out


def test_best_fit_equals_a_plain_search():
    r = random.Random(6)
    for _ in range(60):
        sizes = sorted((r.randint(1, 60) for _ in range(r.randint(0, 120))), reverse=True)
        assert shards.best_fit(sizes, 100) == brute_best_fit(sizes, 100)
        if sizes:
            load = Counter()
            for s, b in zip(sizes, shards.near_equal(sizes, 6)):
                load[b] += s
            assert max(load) < 6 and max(load.values()) <= max(sizes[0], -(-sum(sizes) // 6) + sizes[0])


@pytest.mark.parametrize("task_rows", [None, 20])
def test_shards(spark, task_rows):
    r = random.Random(7)
    texts = ["".join(r.choice("abcé ") for _ in range(r.randint(0, 90))) for _ in range(150)]
    rows = [(i, r.choice(texts)) for i in range(300)] + [(1000 + i, "hot text " * 40) for i in range(150)] + [(2000, None), (2001, None), (2002, ""), (None, texts[1])]
    rows += [rows[5], rows[5]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"shard": F.lit("x"), "size": F.lit(1), "key": F.lit(2), "item": F.lit(3)})
    got = shards.sharded(docs, shards=8, task_rows=task_rows).collect()
    assert len(got) == len(rows)
    of = {}
    for x in got:
        assert x["size"] == 8 + len((dict(rows)[x["doc_id"]] or "").encode()) and x["law"] == "bytes" and x["grown_shard"] is None
        assert of.setdefault(dict(rows)[x["doc_id"]], x["shard"]) == x["shard"]
    for s in range(8):
        own = [x for x in got if x["shard"] == s]
        assert sorted(x["slot"] for x in own) == list(range(len(own)))
    load = sorted(sum(x["size"] for x in got if x["shard"] == s) for s in range(8))
    assert load[-1] == 150 * (8 + 9 * 40)  # the hot group alone
    assert load[-2] - load[0] <= 0.15 * load[-2]
    assert shards.sharded(docs.where("false"), shards=8).collect() == []


def test_fixed_capacity(spark):
    groups = spark.createDataFrame([(bytes([i]), s, 1) for i, s in enumerate([70, 60, 50, 50, 40, 30])], "key binary, bytes bigint, rows bigint")
    item, table = shards.packed(groups, capacity=100)
    load = item.join(table, "item").join(groups, "key").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()
    assert sorted(x["b"] for x in load) == [100, 100, 100]
