"""Results above the sizes where earlier versions cut, merged or failed, and edges with nulls."""

import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqalert.functions import sql
from seqalert.operators import coresets, curves, features, ordering, pools, windows as win
from seqalert.plans import protocols
from seqalert.contract.base import QUERIES
from seqalert.scorers import chronology, frequency, topology
from seqalert.session import checkpoint_folder
from seqalert.sources import sinks

ROOT = Path(__file__).resolve().parents[1]


def test_windows_of_packed_pieces(spark):
    sql.register(spark)
    tokens = spark.createDataFrame([("a", i, i * 7 % 13) for i in range(10_000)], "trace_id string, pos bigint, token int")
    for size in (64, 63, 4096):
        win.pack(tokens, size=size, ahead=19).createOrReplaceTempView("pieces")
        got = spark.sql(f"SELECT p.trace_id, s.w, s.win FROM pieces p, LATERAL sliding_windows(p.seq, 20, 2, p.chunk * {size}, {size}) s")
        want = win.sliding_windows(tokens)
        assert got.count() == want.count() == 4991 and got.exceptAll(want).count() == 0


def test_bootstrap_keeps_every_score(spark):
    rng = np.random.default_rng(1)
    rows = [(float(rng.normal() + y), y) for y in (0, 1) for _ in range(10_000)]
    tbl = ordering.cut(curves.score_table(spark.createDataFrame(rows, "score double, y int")))
    assert tbl.count() > 16_384
    ci, auc = curves.bootstrap_ci(tbl, 40).head(), curves.roc_auc(tbl).head()["auc"]
    assert ci["auc_lo"] < auc < ci["auc_hi"] and ci["auc_hi"] - ci["auc_lo"] < 0.03
    assert curves.bootstrap_ci(tbl, 10).head() == curves.bootstrap_ci(tbl, 10).head()
    assert curves.bootstrap_ci(tbl, 10, task_rows=3_000).head() == pytest.approx(curves.bootstrap_ci(tbl, 10).head())


def test_bootstrap_equals_plain_resampling(spark):
    rng = np.random.default_rng(5)
    rows = [(round(float(rng.normal() + y), 2), y) for y in (0, 1) for _ in range(400)]
    tbl = curves.score_table(spark.createDataFrame(rows, "score double, y int"))
    each = {r["replicate"]: r for r in curves.replicates(tbl, 6, seed=9, task_rows=50).collect()}
    table = sorted((r["score"], r["pos"], r["neg"]) for r in tbl.collect())[::-1]
    pos, neg = curves.poisson_counts(np.array([t[0] for t in table]), np.array([t[1] for t in table]), np.array([t[2] for t in table]), 6, 9)
    for i in range(6):
        drawn = [(t[0], int(p), int(n)) for t, p, n in zip(table, pos[:, i], neg[:, i]) if p + n]
        again = spark.createDataFrame([(s, y) for s, p, n in drawn for y in [1] * p + [0] * n], "score double, y int")
        want = curves.all_metrics(curves.score_table(again)).head()
        assert [each[i][m] for m in ("auc", "ap", "f1")] == pytest.approx([want["auc"], want["ap"], want["best_f1"]])


def test_bootstrap_without_rows_or_with_one_class(spark):
    none = curves.score_table(spark.createDataFrame([], "score double, y int"))
    assert all(v is None for v in curves.bootstrap_ci(none, 5).head())
    one = curves.score_table(spark.createDataFrame([(0.5, 1), (0.25, 1)], "score double, y int"))
    ci = curves.bootstrap_ci(one, 20).head()
    assert ci["auc_lo"] is None and ci["ap_hi"] == 1.0


def test_coreset_has_its_share_of_clusters(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id bigint, vec array<double>")
    out = coresets.coreset(df, 0.1, part=20).collect()
    assert 55 <= len(out) <= 60 and len({r["cluster"] for r in out}) == len(out) == len({r["vec_id"] for r in out})


def test_coreset_covers_better_than_a_sample(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 6)) * 8
    x = np.vstack([centres[i] + rng.normal(size=(n, 6)) for i, n in enumerate([700] + [30] * 39)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None)], "vec_id bigint, vec array<double>")

    def distance(ids):
        d = ((x[:, None, :] - x[list(ids)][None, :, :]) ** 2).sum(2)
        return np.sqrt(d.min(1)).mean()

    def chosen(df, part):
        return {r["vec_id"] for r in coresets.coreset(df, 80 / len(x), part=part).collect()}

    flat, deep = chosen(df, 256), chosen(df, 25)
    assert len(flat) == len(deep) == 80
    samples = [distance(rng.choice(len(x), 80, replace=False)) for _ in range(5)]
    assert distance(flat) < 0.75 * min(samples) and distance(deep) < 0.85 * min(samples)
    # The same rows whatever the partitioning, and when centres meet the rows by a shuffle.
    monkeypatch.setattr(coresets, "SHARED_BYTES", 1)
    assert chosen(df.repartition(7), 25) == deep


def test_coreset_of_equal_rows_and_none(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], "vec_id bigint, vec array<double>")
    assert coresets.coreset(same, 0.2, part=3).count() == 1
    assert coresets.coreset(same.limit(0), 0.2).count() == 0


def test_every_family_is_held_out_once(spark):
    rows = [(f"t{i}", i % 2, f"f{i}" if i % 2 else None, float(i)) for i in range(24)]
    df = spark.createDataFrame(rows, "trace_id string, y int, family string, x double")

    class Same:
        def score(self, d):
            return d.withColumn("prob", F.col("x"))

    got = protocols.leave_family_out(df, lambda train: Same()).select("held_out").collect()
    assert sorted(r[0] for r in got) == sorted(f"f{i}" for i in range(1, 24, 2))


def test_per_family_equals_single_families(spark):
    r = random.Random(3)
    rows = [(f"t{i}", i, f"f{i % 9}" if i % 3 else None, int(i % 3 > 0), r.choice([0.1, 0.2, r.random()])) for i in range(400)]
    rows += [("n", 900, None, 0, None), ("n", 901, "f1", 1, None)]
    df = spark.createDataFrame(rows, "trace_id string, w bigint, family string, y int, score double")
    got = {x["family"]: x for x in curves.per_family(df, 0.5).collect()}
    for f in {x[2] for x in rows if x[2]}:
        one = curves.all_metrics(curves.score_table(df.where((F.col("y") == 0) | (F.col("family") == f)))).head()
        for name in ("auc", "ap", "tpr_fpr1", "tpr_fpr01", "n_pos", "n_neg"):
            assert got[f][name] == pytest.approx(one[name]), (f, name)


def test_seeded_head_equals_the_whole_order(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("g"))
    whole = ordering.hash_rank(df, 5, ["id"], by=["g"]).where("rank <= 40")
    head = ordering.hash_rank(df, 5, ["id"], by=["g"], at_most=40)
    assert head.count() == 120 and head.exceptAll(whole).count() == 0


def test_share_above_its_limit_is_no_broadcast(spark):
    small, large = spark.range(10), spark.range(11)
    plan = lambda df: spark.range(1000).join(ordering.share(df, 10), "id")._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(small).lower() and "broadcast" not in plan(large).lower()


def test_totals_next_to_null_groups(spark):
    rows = [("a", "f", 1, 0.9), ("b", None, 0, 0.1), ("c", None, 0, 0.8)]
    got = pools.detection_rates(spark.createDataFrame(rows, "trace_id string, family string, y int, prob double"), 0.5).collect()
    assert sorted((str(r["family"]), r["n_traces"], r["median_per_trace"]) for r in got) == [("None", 2, 0.5), ("TOTAL", 3, 1.0), ("f", 1, 1.0)]
    out = win.attrition(spark.createDataFrame([("x", 30), (None, 5)], "split string, length bigint")).collect()
    assert sorted((str(r["split"]), r["traces"], r["too_short"]) for r in out) == [("ALL", 2, 1), ("None", 1, 1), ("x", 1, 0)]


def test_rows_without_a_label_are_no_negatives(spark):
    df = spark.createDataFrame([(0.9, 1), (0.1, 0), (0.95, None), (None, 1)], "score double, y int")
    assert curves.all_metrics(curves.score_table(df)).select("auc", "n_pos", "n_neg").head() == (1.0, 1, 1)


def test_batch_score_of_nothing(spark):
    empty = spark.createDataFrame([], "trace_id string, w bigint, win array<int>")
    assert topology.batch_score(empty, lambda: lambda x: x.sum(axis=1)).collect() == []


def test_hmm_takes_any_token_numbers(spark):
    rows = [("a", i, [5_000_000 + (i + k) % 3 for k in range(6)]) for i in range(30)]
    w = spark.createDataFrame(rows, "trace_id string, w bigint, win array<int>")
    model = chronology.Hmm(2, 4).fit(w)
    other = spark.createDataFrame([("b", 0, [1, 2, 3, 4, 5, 6]), ("b", 1, rows[0][2])], "trace_id string, w bigint, win array<int>")
    score = {r["w"]: r["score"] for r in model.score(other).collect()}
    assert score[0] > 5 > score[1]


def test_short_traces_get_a_record(spark):
    scores = spark.createDataFrame([("a", 0, 0.1, 0.2, 0.3, 0.4)], "trace_id string, w bigint, path_a double, path_b double, path_c double, prob double")
    traces = spark.createDataFrame([("a", 20), ("b", 19), ("c", 0)], "trace_id string, length bigint")
    got = {r["file"]: (r["n_windows"], r["status"], r["phase5_probs"]) for r in sinks.score_records(scores, traces=traces, tau=0.3).collect()}
    short = (0, "too_short_for_window_20", [])
    assert got == {"a": (1, "ok", [0.4]), "b": short, "c": short}


def test_no_private_folder_on_a_cluster():
    assert checkpoint_folder("hdfs://x/y", "spark://h:7077") == "hdfs://x/y"
    assert "seqalert" in checkpoint_folder(None, "local[8]")
    for master in ("spark://h:7077", "yarn", "k8s://h", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            checkpoint_folder(None, master)


def test_everything_else_works_without_the_corpus_operators():
    code = "import sys; sys.modules['seqalert.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and 'pipeline' not in q and not any(n.startswith('op1_') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_report_stamp(spark):
    from seqalert.functions.columns import utc_stamp

    assert spark.range(1).select(utc_stamp().rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d UTC$")).head()[0]


def brute_nearest(ids, x, k):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    return {(int(ids[a]), p): (int(ids[b]), d[a, b]) for a in range(len(ids)) for p, b in enumerate(np.lexsort((ids, d[a]))[:k])}


@pytest.mark.parametrize("block", [40, 8192])
def test_nearest_rows_are_those_of_the_whole_table(spark, block):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 6)).astype("float32").astype(float)
    x[50:120] = x[7]  # one vector many times over
    ids = rng.permutation(1000)[:300]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id bigint, vec array<double>")
    got = {(r["vec_id"], r["place"]): (r["other"], r["distance"]) for r in frequency.nearest_rows(df, 5, block=block).collect()}
    want = brute_nearest(ids, x, 5)
    assert got.keys() == want.keys()
    assert all(got[key][0] == want[key][0] and got[key][1] == pytest.approx(want[key][1]) for key in want)


def test_knn_reads_tables_above_1000_vectors(spark):
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=float)
    size = (x**2).sum(1)
    got = QUERIES["jn_12_knn"](spark, d).collect()
    assert len(rows) == 2000 and len(got) == 5 * len(rows)
    at = {int(v): i for i, v in enumerate(ids)}
    furthest = {r["vec_id"]: r["distance"] for r in got if r["place"] == 4}
    for v in ids[:200].tolist():
        d2 = np.sort(np.maximum(size[at[v]] - 2 * x @ x[at[v]] + size, 0))
        assert furthest[v] == pytest.approx(np.sqrt(d2[4]), abs=1e-4)


def test_the_sweep_runs_the_whole_grid(spark):
    rng = np.random.default_rng(4)
    rows = [("t", w, rng.integers(0, 9 + 3 * (w % 4 == 0), 12).tolist(), int(w % 4 == 0)) for w in range(200)]
    test = spark.createDataFrame(rows, "trace_id string, w bigint, win array<int>, y int")
    train = test.where("y = 0")
    got = {(r["features"], r["method"], r["components"]): r for r in features.sweep_features(train, test).collect()}
    assert got.keys() == {(f, m, n) for f in features.FEATURES for m in ("pca", "svd") for n in (50, 100)} and len(got) == 28
    for name, make, method in (("word(1,2)_2k_sub", lambda: features.WordTfidf(2000), features.pca), ("word(1,3)_2k_sub", lambda: features.PhraseTfidf(2000, 3), features.svd)):
        one = make().fit(train)
        scored = features.with_residual(one.with_vectors(test), method(one.with_vectors(train), 50))
        want = curves.all_metrics(curves.score_table(scored.select("score", "y"))).head()
        assert got[name, method.__name__, 50]["auc"] == pytest.approx(want["auc"], abs=1e-3)
    part = features.sweep_features(train, test, {"word(1,2)_1k": features.FEATURES["word(1,2)_1k"]}, [("svd", 50)])
    assert sorted(r["components"] for r in features.sweep_features(train, test, {"word(1,2)_1k": features.FEATURES["word(1,2)_1k"]}, [("svd", 50), ("svd", 60)], part).collect()) == [50, 60]


def test_phrases_are_counted_as_scikit_learn_does(spark):
    from collections import Counter

    wins = [[1, 2, 1, 2, 3], [7], [5, 5, 5]]
    df = spark.createDataFrame([("t", i, w) for i, w in enumerate(wins)], "trace_id string, w bigint, win array<int>")
    model = features.PhraseTfidf(100, 3, sublinear=False).fit(df)
    want = Counter(" ".join(map(str, w[i : i + n])) for w in wins for n in (1, 2, 3) for i in range(len(w) - n + 1))
    assert {e[0]: e[2] for e in model.entries} == want
    x = model.matrix(wins)
    assert np.allclose(np.linalg.norm(x, axis=1), 1) and x[2, next(e[1] for e in model.entries if e[0] == "5 5 5")] > 0


def test_conversion_job_numbers_a_line_item_once(spark, tmp_path, monkeypatch):
    """Files with missing and repeated parts, against brute force; no row is sorted both as a name and as a number."""
    from seqalert.contract import abi_queries

    parts = [(k, f"n {k}", f"B#{k}", "T", 5, 1.0) for k in range(9)] + [(3, "n 3", "B#3", "T", 5, 1.0)]  # 3 comes twice, from 9 on none
    items = {1: [0, 1, 2], 2: [4, 5], 3: [3, 6], 4: [7, 9, 8], 5: [3, 12], 6: [11], 7: [3, 3], 8: [8, None, 9, 7, 6], None: [1, 2, 4]}
    rows = [(100 + i, part, supplier, i) for supplier, keys in items.items() for i, part in enumerate(keys)]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    lines = spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int").withColumn("l_shipdate", F.lit("2024-01-01").cast("timestamp"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    seen, plain = [], ordering.number_rows
    monkeypatch.setattr(ordering, "number_rows", lambda df, *a, **k: seen.append(df.count()) or plain(df, *a, **k))
    files, tokens = abi_queries._job(spark, str(tmp_path))
    want, sorted_rows = {}, 0
    for supplier, keys in items.items():
        named = [f"n_{k}_B{k}" for k in keys if k is not None and k < 9 for _ in range(2 if k == 3 else 1)]
        kind = named if len(named) % 2 else [None if k is None else str(k) for k in keys]
        if supplier is not None and named:
            want |= {(str(supplier), i): x for i, x in enumerate(kind[: min(len(named), len(keys))])}
            sorted_rows += len(kind)
    assert {(r["trace_id"], r["pos"]): r["token"] for r in tokens.collect()} == want and tokens.count() == len(want)
    assert sorted((r["trace_id"] or "", r["path"] or "") for r in files.collect()) == [("", "")] + [(str(i), f"inbox/{i}.txt") for i in (1, 2, 3, 4, 5, 7, 8)]
    assert sum(seen) == sorted_rows


@pytest.mark.parametrize("run,task_rows", [(1 << 18, None), (64, 50)])
def test_auc_of_runs_is_that_of_the_score_table(spark, monkeypatch, run, task_rows):
    monkeypatch.setattr(curves, "RUN", run)
    rng = np.random.default_rng(3)
    rows = [("a", float(np.round(s, 1)), int(s + rng.normal() > 0)) for s in rng.normal(size=900)]
    rows += [("b", 5.0, i % 2) for i in range(300)] + [("c", float(i), 1) for i in range(9)] + [(None, float(i % 7), i % 3) for i in range(60)]
    rows += [("a", None, 1), ("b", 1.0, None), ("b", float("nan"), 1), ("b", float("nan"), 0), ("d", -0.0, 1), ("d", 0.0, 0)]
    df = spark.createDataFrame(rows, "k string, score double, y int").repartition(5)
    want = {r["k"]: r["auc"] for r in curves.roc_auc(curves.score_table(df, by=["k"]), ["k"]).collect()}
    runs = None
    for k in "abcd":
        one = curves.score_runs(df.where(F.col("k") == k)).select(F.lit(k).alias("k"), "n", "run")
        runs = one if runs is None else runs.unionByName(one)
    runs = runs.unionByName(curves.score_runs(df.where("k is null")).select(F.lit(None).cast("string").alias("k"), "n", "run"))
    got = {r["k"]: r["auc"] for r in curves.roc_auc_of_runs(ordering.cut(runs), ["k"], task_rows).collect()}
    assert got.keys() == want.keys() and got["c"] is None and got["d"] == 0.5
    assert all(got[k] == want[k] or got[k] == pytest.approx(want[k], abs=1e-12) for k in got)


def test_abi_impact_stores_no_row_per_window(spark, monkeypatch):
    """Two scorers under two ABIs against brute force; the tokens are read once, and every stored table is small beside the windows."""
    from seqalert.plans import protocols

    rng = np.random.default_rng(8)
    traces = {f"t{i}": rng.integers(0, 9, 90).tolist() for i in range(30)} | {"none": [1] * 40}
    tokens = spark.createDataFrame([(t, i, x) for t, seq in traces.items() for i, x in enumerate(seq)], "trace_id string, pos bigint, token int")
    labels = spark.createDataFrame([(f"t{i}", int(i % 3 == 0)) for i in range(30)], "trace_id string, y int")
    abi_map = spark.createDataFrame([(abi, f"n{i}", (i * k) % 9, 0, True, False) for abi, k in (("a", 1), ("b", 2)) for i in range(7)], "abi string, name string, number int, ord bigint, common boolean, anchor boolean")
    stored, plain = [], ordering.cut
    monkeypatch.setattr(ordering, "cut", lambda df: stored.append((out := plain(df)).count()) or out)
    sizes = []
    scorers = {"sum": lambda w: w.withColumn("score", F.expr("aggregate(win, 0D, (a, x) -> a + x)")), "last": lambda w: w.withColumn("score", F.col("win")[19].cast("double"))}
    got = {(r["config"], r["scorer"]): r["auc"] for r in protocols.abi_impact(tokens, labels, abi_map, [("a", "b")], 9, lambda benign: sizes.append(benign.count()) or scorers).collect()}
    assert sizes == [20 * 36] and max(stored) < 100
    read = {"correct": lambda x: x, "a_to_b": lambda x: x * 2 % 9 if x < 7 else 0}
    for config, f in read.items():
        wins = [(int(t[1:]) % 3 == 0, [f(x) for x in seq[i : i + 20]]) for t, seq in traces.items() if t != "none" for i in range(0, 71, 2)]
        for name, score in (("sum", sum), ("last", lambda w: w[-1])):
            up, down = [score(w) for y, w in wins if y], [score(w) for y, w in wins if not y]
            won = sum((a > b) + (a == b) / 2 for a in up for b in down)
            assert got[config, name] == pytest.approx(won / len(up) / len(down))
