"""Scorers against plain numpy on small inputs, and invariants of the fitted models."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqalert.operators import coresets, curves, features, sampling, windows as win
from seqalert.scorers import chronology, frequency, fusion, topology


@pytest.fixture(scope="module")
def points(spark):
    """200 points around the origin and 10 far away."""
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(200, 5)), rng.normal(size=(10, 5)) + 9])
    df = spark.createDataFrame([(i, 0, [float(v) for v in r], int(i >= 200)) for i, r in enumerate(x)], "trace_id int, w int, vec array<double>, y int").repartition(5)
    return x, df


@pytest.fixture(scope="module")
def planted(spark):
    """Benign windows count up, attack windows jump around."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(120):
        attack = i >= 100
        seq = rng.integers(0, 12, 12) if attack else (np.arange(12) + rng.integers(0, 12)) % 12
        rows.append((f"t{i}", 0, [int(v) for v in seq], int(attack)))
    return spark.createDataFrame(rows, "trace_id string, w bigint, win array<int>, y int").repartition(4).cache()


def scores(df, key="trace_id"):
    return {r[key]: r["score"] for r in df.collect()}


def auc(df):
    return curves.roc_auc(curves.score_table(df.select("score", "y"))).head()["auc"]


def test_projection_equals_numpy(points):
    x, df = points
    p = features.pca(df, 2)
    c = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(np.abs(p.loadings.T @ vt[:2].T), np.eye(2), atol=1e-8)
    assert np.allclose(p.values, s[:2] ** 2 / len(x))
    got = scores(frequency.PcaError(2).fit(df).score(df))
    want = ((c - c @ vt[:2].T @ vt[:2]) ** 2).mean(axis=1)
    assert np.allclose([got[i] for i in range(len(x))], want)
    q = features.svd(df, 3)
    assert np.allclose(q.values, np.linalg.svd(x)[1][:3])


def test_lof_equals_brute_force(points):
    x, df = points
    k = 10
    got = scores(frequency.Lof(k, 1000).fit(df).score(df))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    own = d + np.diag(np.full(len(x), np.inf))
    near = np.argsort(own, axis=1, kind="stable")[:, :k]
    kdist = np.take_along_axis(own, near, 1)[:, -1]
    lrd = 1 / (np.maximum(np.take_along_axis(own, near, 1), kdist[near]).mean(1) + 1e-10)
    # Scored rows count as new, so a training row finds itself among its neighbours.
    new = np.argsort(d, axis=1, kind="stable")[:, :k]
    mine = 1 / (np.maximum(np.take_along_axis(d, new, 1), kdist[new]).mean(1) + 1e-10)
    assert np.allclose([got[i] for i in range(len(x))], lrd[new].mean(1) / mine, rtol=1e-4)


@pytest.mark.parametrize("make", [
    lambda: frequency.IsolationForest(40, 64), lambda: frequency.Hbos(10), lambda: frequency.CentreDistance(), lambda: frequency.Lof(20),
])
def test_far_points_score_higher(points, make):
    _, df = points
    out = make().fit(df.where("y = 0")).score(df)
    assert auc(out) > 0.95
    assert scores(out) == scores(make().fit(df.where("y = 0")).score(df.repartition(3)))


def test_forest_draws_once_from_many_rows(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, 0, [float(v) for v in rng.normal(size=2)]) for i in range(3000)], "trace_id int, w int, vec array<double>")
    f = frequency.IsolationForest(10, 32).fit(df)
    assert len(f.forest) == 10 and f.sample == 32
    far = spark.createDataFrame([(1, [0.0, 0.0]), (2, [9.0, 9.0])], "trace_id int, vec array<double>")
    s = scores(f.score(far))
    assert s[2] > s[1]


def test_one_class_svm_prefers_the_training_side(spark):
    rng = np.random.default_rng(2)
    a = [(i, 0, [float(v) for v in rng.normal(3, 0.3, 4)], 0) for i in range(80)]
    b = [(100 + i, 0, [float(v) for v in rng.normal(-3, 0.3, 4)], 1) for i in range(20)]
    df = spark.createDataFrame(a + b, "trace_id int, w int, vec array<double>, y int")
    assert auc(frequency.OneClassSvm(0.1, 20).fit(df.where("y = 0")).score(df)) == 1.0


def test_one_class_svm_is_within_its_tolerance_of_the_optimum(spark):
    rng = np.random.default_rng(7)
    x, nu = np.abs(rng.normal(1, 0.6, (600, 5))) * [1, 2, 1, 0.5, 1], 0.05
    model = frequency.OneClassSvm(nu, tol=0.005).fit(spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "i int, vec array<double>").repartition(3))

    def objective(w, rho):
        return w @ w / 2 + np.maximum(0, rho - x @ w).mean() / nu - rho

    w, best = x.mean(axis=0), np.inf
    for step in range(1, 20_001):  # plain sub-gradients, with the best rho for each w
        s = x @ w
        rho = np.sort(s)[int(nu * len(x)) - 1]
        best = min(best, objective(w, rho))
        w = w - (w - x[s <= rho].mean(axis=0)) / (step + 1)
    got = objective(model.w, model.rho)
    assert best < 0 and got <= best + 0.01 * abs(best)
    assert model.gaps[-1] <= 0.005 * (model.w @ model.w) and len(model.gaps) < 100


def test_normal_quantiles():
    from statistics import NormalDist

    u = np.concatenate([np.linspace(1e-7, 1 - 1e-7, 2001), [1e-15, 1e-12, 0.075, 0.925, 1 - 1e-12]])
    assert np.allclose(fusion.normal_quantile(u), [NormalDist().inv_cdf(v) for v in u], rtol=1e-12, atol=1e-15)


@pytest.mark.parametrize("make", [
    lambda: chronology.Markov(1), lambda: chronology.Markov(2), lambda: chronology.Hmm(4, 15), lambda: chronology.ContextModel(3), lambda: topology.EmbeddingError(4, 6),
])
def test_broken_order_scores_higher(planted, make):
    assert auc(make().fit(planted.where("y = 0")).score(planted)) > 0.8


def test_hmm_likelihood_rises(planted):
    m = chronology.Hmm(3, 6).fit(planted)
    assert all(b >= a - 1e-6 for a, b in zip(m.likelihood, m.likelihood[1:]))
    assert np.allclose(m.trans.sum(1), 1) and np.allclose(m.emit.sum(1), 1)


def test_hmm_ends_when_it_gains_nothing(planted):
    m = chronology.Hmm(2, 50, tol=1e-3).fit(planted)
    gains = np.diff(m.likelihood)
    assert len(m.likelihood) < 50 and gains[-1] <= 1e-3 * abs(m.likelihood[-1]) and (gains[:-1] > 1e-3 * np.abs(m.likelihood[1:-1])).all()


def test_hmm_forward_equals_enumeration():
    start, trans = np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]])
    emit = np.array([[0.5, 0.3, 0.2], [0.1, 0.2, 0.7]])
    x = np.array([[0, 2, 1, 2]])
    total = 0.0
    for path in np.ndindex(2, 2, 2, 2):
        p = start[path[0]] * emit[path[0], x[0, 0]]
        for i in range(1, 4):
            p *= trans[path[i - 1], path[i]] * emit[path[i], x[0, i]]
        total += p
    _, scale = chronology._forward(x, start, trans, emit)
    assert math.isclose(np.log(scale).sum(), math.log(total))


@pytest.mark.parametrize("make", [lambda: features.WordTfidf(30), lambda: features.CharTfidf(25)])
def test_dense_vectors_equal_the_weight_table(planted, make):
    model = make().fit(planted)
    dense = {r["trace_id"]: r["vec"] for r in model.with_vectors(planted).collect()}
    table = {}
    for r in model.weights(planted).collect():
        table.setdefault(r["trace_id"], {})[r["idx"]] = r["weight"]
    for t, v in dense.items():
        assert np.allclose(v, [table.get(t, {}).get(i, 0.0) for i in range(len(v))])


def test_coreset_keeps_one_row_per_cluster(points):
    _, df = points
    rows = coresets.coreset(df, 0.05).collect()
    assert len({r["cluster"] for r in rows}) == len(rows) <= 10


def test_sample_by_transition_is_exact_and_repeatable(planted):
    a = sorted(r["trace_id"] for r in sampling.sample_by_transition(planted, 30).collect())
    assert len(set(a)) == 30 and a == sorted(r["trace_id"] for r in sampling.sample_by_transition(planted.repartition(2), 30).collect())


@pytest.fixture(scope="module")
def pool(spark):
    rng = np.random.default_rng(7)
    rows = []
    for t in range(60):
        y = int(t >= 40)
        for w in range(10):
            a, b, c = rng.normal(size=3) + 1.2 * y
            rows.append((f"t{t}", w, y, f"fam{t % 3}" if y else None, float(a), float(b), float(c)))
    return spark.createDataFrame(rows, "trace_id string, w bigint, y int, family string, path_a double, path_b double, path_c double").cache()


def test_normal_scores(pool):
    n = fusion.NormalScores(points=200).fit(pool)
    out = n.transform(pool).select("path_a", "path_a_n").toPandas()
    assert abs(out["path_a_n"].mean()) < 0.05 and abs(out["path_a_n"].quantile(0.8413) - 1) < 0.15
    assert (out.sort_values("path_a")["path_a_n"].diff().dropna() >= -1e-12).all()
    x = np.sort(pool.select("path_a").toPandas()["path_a"].to_numpy())
    assert np.allclose(n.grid["path_a"], np.quantile(x, np.linspace(0, 1, 200)))
    # More grid points than values, and ties.
    few = pool.limit(7).selectExpr("round(path_a) as path_a").cache()
    x = few.toPandas()["path_a"].to_numpy()
    assert np.allclose(fusion._grid(few, "path_a", 100), np.quantile(x, np.linspace(0, 1, 100)))


@pytest.mark.parametrize("make", [fusion.fuse_logistic, fusion.fuse_svm, fusion.fuse_mlp, lambda p: fusion.fuse_forest(p, trees=10), lambda p: fusion.fuse_boosted(p, rounds=5)])
def test_fusion_beats_chance(pool, make):
    out = make(pool).score(pool).withColumnRenamed("prob", "score")
    assert auc(out) > 0.85


def test_unsupervised_fusion(pool):
    benign = pool.where("y = 0")
    assert auc(fusion.CdfMax().fit(benign).score(pool)) > 0.7
    m = fusion.Mixture(2).fit(benign)
    assert auc(m.score(pool)) > 0.7
    x = benign.select("path_a", "path_b", "path_c").toPandas().to_numpy()
    cov = np.cov(x.T, bias=True)
    # One component, with known parameters.
    m.weights, m.means, m.covs = np.array([1.0]), x.mean(0)[None], cov[None]
    d = x[0] - x.mean(0)
    want = 0.5 * (d @ np.linalg.inv(cov) @ d + np.linalg.slogdet(cov)[1] + 3 * math.log(2 * math.pi))
    got = m.score(benign).where((F.col("path_a") == float(x[0, 0])) & (F.col("path_b") == float(x[0, 1]))).head()["score"]
    assert abs(got - want) < 1e-3
    forest = fusion.score_forest(benign, 30)
    assert auc(forest.score(pool.withColumn("vec", F.array(*fusion.PATHS)))) > 0.7


def test_balanced_weights(pool):
    w = fusion.with_weights(pool).groupBy("y").agg(F.sum("weight").alias("s")).collect()
    assert len({round(r["s"], 6) for r in w}) == 1


def test_registry_marks_the_best_model(pool, tmp_path):
    models = {"logistic": fusion.fuse_logistic(pool), "svm": fusion.fuse_svm(pool)}
    metrics = pool.sparkSession.createDataFrame([("logistic", "test", 0.9, 0.5), ("svm", "test", 0.8, 0.9), ("svm", "val", 0.99, 0.9)], "model string, part string, auc double, f1 double")
    rows = fusion.save_models(models, metrics, str(tmp_path / "models")).collect()
    assert {r["model"] for r in rows if r["best"]} == {"logistic"}


def test_bootstrap_interval_holds_the_estimate(pool):
    tbl = curves.score_table(pool, "path_a")
    ci, point = curves.bootstrap_ci(tbl, 100).head(), curves.all_metrics(tbl).head()
    assert ci["auc_lo"] < point["auc"] < ci["auc_hi"] and ci["ap_lo"] < point["ap"] < ci["ap_hi"]


def test_significance_of_a_clear_gap(pool):
    p = pool.withColumn("fused", F.col("path_a") + F.col("path_b") + F.col("path_c")).withColumn("noise", F.rand(3))
    rows = {(r["level"], r["path"]): r for r in curves.significance(p, "fused", ["noise"]).collect()}
    r = rows["window", "noise"]
    assert r["diff"] > 0.2 and r["p"] < 1e-6 and abs(r["neg_log10_p"] + math.log10(max(r["p"], 1e-300))) < 1e-6
    assert rows["trace", "noise"]["auc1"] > 0.95


def test_cells_give_the_same_projection_and_residuals_as_matrices(spark):
    import inspect

    import numpy as np

    from seqalert.operators import features

    rng = np.random.default_rng(3)
    wins = [rng.integers(0, 9, 12).tolist() for _ in range(60)] + [[77] * 12]
    df = spark.createDataFrame([("a", w, v) for w, v in enumerate(wins)], "trace_id string, w bigint, win array<int>")
    for tfidf in (features.WordTfidf(40, sublinear=False), features.PhraseTfidf(50, 3), features.CharTfidf(20, 3, 5)):
        tfidf = tfidf.fit(df.limit(60))._slim()
        x = tfidf.matrix(wins)
        n, sums, gram = features._gram_of_cells(df, tfidf)
        assert n == len(wins) and np.allclose(sums, x.sum(axis=0)) and np.allclose(gram, x.T @ x)
        for method in ("pca", "svd"):
            model = features._projections(n, sums, gram, method, [4])[0]
            assert np.allclose(model.residual_of_cells(len(wins), *tfidf.sparse(wins)), model.residual(x), atol=1e-12)
    assert "matrix(" not in inspect.getsource(features.sweep_features) + inspect.getsource(features._residuals)


def test_markov_scores_windows_in_one_pass(spark):
    import math

    from pyspark.sql import functions as F

    from seqalert.operators import windows as win
    from seqalert.scorers.chronology import UNSEEN, Markov

    rows = [("a", 0, [1, 2, 1, 2, 3]), ("a", 1, [1, None, 2, 1]), ("b", 0, [9]), ("b", 1, [2, 1, 9]), (None, 0, [1, 2]), ("c", 0, None)]
    df = spark.createDataFrame(rows, "trace_id string, w bigint, win array<int>")
    for k in (1, 2):
        model = Markov(k).fit(df.where("win is not null"))
        key = lambda d: sorted(map(str, d.select("state", "nxt", "n", F.round("p", 9)).collect()))
        assert key(model.model) == key(win.transitions(df, k))
        p = {(tuple(r["state"]), r["nxt"]): r["p"] for r in model.model.collect() if r["nxt"] is not None}
        out = model.score(df)
        assert "Join" not in out._jdf.queryExecution().toString()
        got = {(r["trace_id"], r["w"]): r["score"] for r in out.collect()}
        for t, w, v in rows:
            grams = [(tuple(v[i : i + k]), v[i + k]) for i in range(len(v or []) - k)] if t else []
            want = -sum(math.log(p[g]) if g in p else UNSEEN for g in grams) / max(1, len(v or []) - k)
            assert abs(got[t, w] - want) < 1e-9


def test_counts_of_tasks_equal_those_of_rows(spark, monkeypatch):
    """N-grams are counted inside tasks, in any number of parts; windows with missing tokens and short ones count as before."""
    import numpy as np

    from seqalert.operators import features

    rng = np.random.default_rng(6)
    wins = [rng.integers(-3, 40, n).tolist() for n in rng.integers(0, 15, 80)] + [[7, 7, 7], [], [5]]
    holes = [[1, None, 2], [None], [None, None, 3, 1]]
    schema = "trace_id string, w bigint, win array<int>"
    frames = [spark.createDataFrame([("a", i, w) for i, w in enumerate(x)], schema).repartition(3) for x in (wins, wins + holes + [None])]
    made, plain = [], features._Tfidf._counts
    monkeypatch.setattr(features._Tfidf, "_counts", lambda self, df: made.append(df.count()) or plain(self, df))
    for held in (features.HELD, 30):
        monkeypatch.setattr(features, "HELD", held)
        for df in frames:
            for make in (lambda: features.WordTfidf(5000), lambda: features.WordTfidf(5000, bigrams=False), lambda: features.PhraseTfidf(5000, 3), lambda: features.CharTfidf(5000, 3, 5)):
                del made[:]
                got = make().fit(df)
                assert made == [3 if df is frames[1] else 0]
                want = plain(got, df).collect()
                assert sorted((e[0] is None, e[0] or 0, e[2], e[3] or 0) for e in got.entries if not isinstance(e[0], str)) == sorted((r[0] is None, r[0] or 0, r[1], r[2] or 0) for r in want if not isinstance(r[0], str))
                assert sorted((e[0], e[2], e[3]) for e in got.entries if isinstance(e[0], str)) == sorted(tuple(r) for r in want if isinstance(r[0], str))


def test_cells_equal_counts_by_name():
    from collections import Counter

    import numpy as np

    from seqalert.operators import features

    rng = np.random.default_rng(2)
    wins = [np.array(rng.integers(0, 6, n), dtype=np.int32) for n in (12, 1, 0, 3, 12)]
    for tfidf in (features.PhraseTfidf(9, 3), features.PhraseTfidf(9, 4), features.CharTfidf(9, 3, 5)):
        name = lambda w: tfidf._named(int(w)) if isinstance(tfidf, features.CharTfidf) else []
        def grams(w):
            if isinstance(tfidf, features.CharTfidf):
                return [g for t in w for g in name(t)]
            return [" ".join(str(int(t)) for t in w[i : i + n]) for n in range(1, tfidf.longest + 1) for i in range(len(w) - n + 1)]

        known = sorted({g for w in wins for g in grams(w)})[::2]
        tfidf.entries = [(g, i, 1, 1, 1.0) for i, g in enumerate(known)]
        want = [(r, i, float(n)) for r, w in enumerate(wins) for i, n in sorted((known.index(g), n) for g, n in Counter(grams(w)).items() if g in known)]
        assert list(zip(*(x.tolist() for x in tfidf.cells(wins)))) == want


def test_residuals_of_several_sizes_share_a_product():
    import numpy as np

    from seqalert.operators import features

    rng = np.random.default_rng(1)
    x = np.where(rng.random((300, 30)) < 0.2, rng.random((300, 30)), 0)
    x[7] = 0
    r, c = np.nonzero(x)
    for method in ("pca", "svd"):
        few, many = features._projections(300, x.sum(axis=0), x.T @ x, method, [4, 11])
        got = many.residuals_of_cells([4, 11], 300, r, c, x[r, c])
        for model, one in zip((few, many), got):
            assert np.allclose(one, model.residual(x), atol=1e-12) and np.array_equal(one, model.residual_of_cells(300, r, c, x[r, c]))
