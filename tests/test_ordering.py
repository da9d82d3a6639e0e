"""Skew-safe ordered primitives against plain Python, with ranges and chunks forced to be tiny."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqalert.operators import alerts, curves, ordering, windows as win


@pytest.fixture(scope="module")
def hot(spark):
    """One group holds most of the rows."""
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.8 else f"g{i % 5}", float(rng.randrange(400)), i, rng.randrange(10)) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "g string, o double, id bigint, v bigint").repartition(7)


@pytest.mark.parametrize("task_rows", [50, 10_000])
@pytest.mark.parametrize("descending", [False, True])
def test_prefix_sum(hot, task_rows, descending):
    rows, df = hot
    out = ordering.prefix_sum(df, ["o", "id"], {"run": "v"}, by=["g"], totals={"total": "v"}, descending=descending, task_rows=task_rows)
    got = {r["id"]: (r["run"], r["total"]) for r in out.collect()}
    want = {}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]), reverse=descending)
        total, run = sum(r[3] for r in mine), 0
        for r in mine:
            run += r[3]
            want[r[2]] = (run, total)
    assert got == want


@pytest.mark.parametrize("task_rows", [64, 10_000])
def test_number_rows(hot, task_rows):
    rows, df = hot
    got = {r["id"]: r["pos"] for r in ordering.number_rows(df, ["o", "id"], by=["g"], task_rows=task_rows).collect()}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        assert [got[r[2]] for r in mine] == list(range(len(mine)))


def test_number_rows_by_timestamp_without_zone(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    a = win.tokens_from(e, "user_id", ["ts", "event_id"], "event_id", task_rows=100)
    b = win.tokens_from(e, "user_id", ["ts", "event_id"], "event_id")
    assert a.exceptAll(b).count() == 0 and a.count() == e.count()


def test_hash_rank(hot):
    rows, df = hot
    out = ordering.hash_rank(df, 7, ["id"], by=["g"], total="t").collect()
    for g in {r[0] for r in rows}:
        mine = sorted((hashlib.md5(f"{r[2]}:7".encode()).hexdigest(), r[2]) for r in rows if r[0] == g)
        got = {r["id"]: (r["rank"], r["t"]) for r in out if r["g"] == g}
        assert [got[i] for _, i in mine] == [(k + 1, len(mine)) for k in range(len(mine))]


@pytest.mark.parametrize("task_rows", [40, 10_000])
def test_quantiles(hot, task_rows):
    rows, df = hot
    got = {r["g"]: r for r in ordering.quantiles(df, "o", {"a": 0.1, "b": 0.5, "c": 0.995}, by=["g"], task_rows=task_rows).collect()}
    for g in {r[0] for r in rows}:
        v = [r[1] for r in rows if r[0] == g]
        assert np.allclose([got[g]["a"], got[g]["b"], got[g]["c"]], np.percentile(v, [10, 50, 99.5]))


def test_chunked_frames_equal_plain_frames(spark):
    rng = random.Random(3)
    rows = [(t, w, rng.random()) for t, n in (("a", 501), ("b", 7), ("c", 64)) for w in range(n)]
    df = spark.createDataFrame(rows, "trace_id string, w bigint, prob double")
    key = lambda d: {(r["trace_id"], r["w"]): (round(r["rolling_mean"], 9), r["rolling_rate"], r["rolling_run"]) for r in d.collect()}
    assert key(alerts.rolling(df, 9, 0.5, 3, size=16)) == key(alerts.rolling(df, 9, 0.5, 3))


def test_carry_last_across_chunks(spark):
    rows = [("a", w, {3: 1, 40: 0, 41: 1}.get(w)) for w in range(100)]
    df = spark.createDataFrame(rows, "k string, w bigint, e int")
    got = {r["w"]: r["s"] for r in ordering.carry_last(df, "e", ["k"], "w", "s", 8).collect()}
    assert all(got[w] is None for w in range(3))
    assert all(got[w] == (0 if w == 40 else 1) for w in range(3, 100))


def test_task_limit_never_changes_curves(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select((F.col("event_type") == "error").cast("int").alias("y"), F.col("value").alias("score"))
    a, b = curves.score_table(e, task_rows=37), curves.score_table(e)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("task_rows", [None, 40, 7, 1])
def test_rank_sums_with_ties_over_many_ranges(spark, task_rows):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 5.0, 5.0, 5.0, float(rng.randrange(9)), float("-inf")]), rng.randrange(2)) for i in range(160)]
    df = ordering.cut(spark.createDataFrame(rows, "i int, v double, pos int").withColumn("one", F.lit(1)).repartition(5))
    got = ordering.rank_sums(df, "v", {"n": "one", "p": "pos"}, task_rows=task_rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for i, v, _ in rows:
        if v is None:
            want[i] = (None,) * 6
        else:
            held = [(w, p) for _, w, p in rows if w is not None]
            want[i] = (sum(w < v for w, _ in held), sum(w == v for w, _ in held), len(held), *(sum(p for w, p in held if f(w)) for f in (lambda w: w < v, lambda w: w == v, lambda w: True)))
    cols = [f"{k}_{n}" for n in "np" for k in ("below", "equal", "all")]
    assert {r["i"]: tuple(r[c] for c in cols) for r in got.collect()} == want and got.count() == len(rows)
    assert not any("Join" in line and "(v#" in line for line in plan.splitlines())


def test_rows_without_a_score_keep_a_null_percentile(spark):
    df = spark.createDataFrame([(1, 0.2, None), (2, None, 1.0), (3, 0.4, 3.0), (4, 0.4, None)], "i int, a double, b double")
    got = {r["i"]: (r["a_pct"], r["b_pct"]) for r in curves.rank_percentile(df, ["a", "b"]).collect()}
    assert got == {1: (1 / 3, None), 2: (None, 0.5), 3: (2.5 / 3, 1.0), 4: (2.5 / 3, None)}


@pytest.mark.parametrize("task_rows", [None, 11])
def test_delong_of_all_pairs_equals_each_pair(spark, task_rows):
    rng = random.Random(6)
    rows = [(rng.randrange(2), *(float(rng.randrange(12)) for _ in range(3))) for _ in range(120)]
    df = spark.createDataFrame([*rows, (1, None, 1.0, 1.0), (None, 1.0, 1.0, 1.0)], "y int, a double, b double, c double")
    every = {r["other"]: r for r in curves.delong_all(df, "a", ["b", "c"], task_rows=task_rows).collect()}
    auc = lambda i: sum((p[i] > n[i]) + (p[i] == n[i]) / 2 for p in rows for n in rows if p[0] and not n[0]) / (sum(r[0] for r in rows) * sum(1 - r[0] for r in rows))
    for other, i in (("b", 2), ("c", 3)):
        one = curves.delong(df, "a", other).head()
        assert all(math.isclose(one[k], every[other][k], rel_tol=1e-9, abs_tol=1e-12) for k in ("auc1", "auc2", "variance", "z"))
        assert math.isclose(one["auc1"], auc(1)) and math.isclose(one["auc2"], auc(i))


def test_many_small_groups_need_no_ranges(spark):
    rows = [(i % 40, i, 1) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, o int, v int")
    out = ordering.prefix_sum(df, ["o"], {"run": "v"}, by=["g"], task_rows=50)
    assert "_range" not in out._jdf.queryExecution().toString()
    assert {(r["g"], r["o"]): r["run"] for r in out.collect()} == {(g, o): o // 40 + 1 for g, o, _ in rows}


def test_fold_takes_many_chunks_in_one_batch(spark):
    rng = random.Random(5)
    rows = [(t, w, rng.random() < 0.3, rng.random() < 0.4) for t, n in (("a", 70), ("b", 5), (None, 33)) for w in range(n)]
    marked = spark.createDataFrame(rows, "trace_id string, w bigint, _starts boolean, _ends boolean")
    out = alerts._fold(marked, 3, ["trace_id"], 8)
    assert "InPandas" not in out._jdf.queryExecution().toString()
    want = {}
    for t in ("a", "b", None):
        mine = [r for r in rows if r[0] == t]
        flags, _ = alerts._run_state(np.array([r[2] for r in mine]), np.array([r[3] for r in mine]), 3, 0)
        want |= {(t, w): (bool(f), bool(w and flags[w - 1])) for w, f in enumerate(flags)}
    assert {(r["trace_id"], r["w"]): (r["alert"], r["was_alert"]) for r in out.collect()} == want
