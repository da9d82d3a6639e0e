"""Groups of near vectors against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqalert.llm import projections


def brute(rows, least):
    """id -> (links, component) over all pairs of usable vectors."""
    by = {}
    for i, v in rows:
        if i is not None:
            ok = v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)
            by.setdefault(i, []).extend([[c + 0.0 for c in v]] if ok else [])
    live = {i: np.array(min(v), float) / max(map(abs, min(v))) for i, v in by.items() if v}
    parent, links = {i: i for i in by}, dict.fromkeys(by, 0)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(live)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = live[a], live[b]
            if len(x) == len(y) and x @ y >= least * np.linalg.norm(x) * np.linalg.norm(y):
                links[a] += 1
                links[b] += 1
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {i: (links[i], root(i)) for i in by}


def planted(seed, groups=12, most=40, noise=0.05):
    r = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = r.normal(size=16)
        for _ in range(int(r.integers(1, most))):
            rows.append((centre + noise * r.normal(size=16) * r.uniform(0, 2)).round(3).tolist())
    # A chain whose ends are far apart, copies, scaled copies.
    at, a, b = 0.0, *np.linalg.qr(r.normal(size=(16, 2)))[0].T
    for _ in range(30):
        rows.append((np.cos(at) * a + np.sin(at) * b).tolist())
        at += 0.2
    rows += [rows[0]] * 25 + [[3 * x for x in rows[0]], [1e-200 * x for x in rows[1]]]
    return [(1000 - i, v) for i, v in enumerate(rows)]


@pytest.mark.parametrize("chunk,block,window,seed", [(4096, 2048, 32, 1), (50, 10, 8, 2), (7, 3, 4, 3)])
def test_groups_equal_all_pairs(spark, chunk, block, window, seed):
    rows = planted(seed)
    odd = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [1.0] * 15 + [float("nan")]), (2004, [1.0] * 15 + [None]), (2005, [float("inf")] * 16)]
    odd += [(2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (2008, [0.0, -2.0]), (2009, [-0.0, -2.0]), (None, rows[0][1]), (rows[0][0], None), (2010, rows[0][1]), (2010, rows[5][1])]
    docs = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").withColumns({"label": F.lit(1), "id": F.lit("x"), "n": F.lit(2), "v": F.lit(3), "component": F.lit(4)})
    got = projections.near_groups(docs.repartition(3), 0.95, window=window, reach=0.99999, chunk=chunk, block=block)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = brute(rows + odd, 0.95)
    assert sorted(map(tuple, got.collect())) == sorted((i, n, c, i == c) for i, (n, c) in want.items())
    assert max(n for n, _ in want.values()) > 25


def test_single_precision_vectors(spark):
    rows = planted(4, groups=4)
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    single = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    single = [(i, v) for i, v in single if any(v)]
    got = {r[0]: (r[1], r[2]) for r in projections.near_groups(docs, 0.95, reach=0.99999).collect()}
    want = brute(single, 0.95)
    assert {i: got[i] for i in want} == want


def test_passes_grow_with_the_table_and_the_distance():
    assert projections.passes(10, 0.95) == projections.passes(32, 0.95)
    counts = [projections.passes(n, 0.95) for n in (1_000, 100_000, 10**9)]
    assert counts == sorted(counts) and counts[0] < counts[-1] < 100
    assert projections.passes(10**6, 0.99) < projections.passes(10**6, 0.9)


def test_reach_on_pairs_at_the_threshold(spark):
    """Pairs with the least cosine that links, among vectors that are near nothing."""
    r = np.random.default_rng(9)
    rows = []
    for i in range(400):
        a, b = np.linalg.qr(r.normal(size=(32, 2)))[0].T
        rows += [(2 * i, a.tolist()), (2 * i + 1, (0.9501 * a + np.sqrt(1 - 0.9501**2) * b).tolist())]
    rows += [(1000 + i, r.normal(size=32).tolist()) for i in range(3000)]
    got = projections.near_groups(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 0.95, window=8, reach=0.97)
    assert got.where("vec_id < 800 and n_links = 1").count() >= 0.94 * 800
    assert got.where("vec_id >= 1000 and n_links > 0").count() == 0


def test_nothing(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert projections.near_groups(empty).collect() == []
    lone = spark.createDataFrame([(5, [1.0, 2.0]), (6, None)], "vec_id bigint, embedding array<float>")
    assert sorted(map(tuple, projections.near_groups(lone).collect())) == [(5, 0, 5, True), (6, 0, 6, True)]
