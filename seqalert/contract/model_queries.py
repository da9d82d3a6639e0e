"""Features, scorers, fusion and protocols that fit models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from seqalert.contract.abi_queries import li_tokens
from seqalert.contract.base import abi_map, ev_tokens, ev_windows, meta, pool, query, table
from seqalert.operators import coresets, features, ordering, sampling, windows as win
from seqalert.plans import protocols
from seqalert.scorers import chronology, frequency, fusion, topology


def vectors(s, d):
    e = table(s, d, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"), (F.col("label") == 0).cast("int").alias("y"))


def train_windows(s, d):
    return ev_windows(s, d).join(meta(s, d).where(F.col("y") == 0).select("trace_id"), "trace_id", "left_semi")


VEC = "SELECT vec_id, i AS dim, embedding[i + 1]::DOUBLE AS x FROM (SELECT vec_id, embedding, CAST(unnest(range(0, 64)) AS INTEGER) AS i FROM embeddings)"


def _tfidf_sql(gram_rows: str, m: int) -> str:
    return f"""{gram_rows}, vc AS (SELECT gram, row_number() OVER (ORDER BY n DESC, gram) - 1 AS idx, ln((1 + (SELECT count(*) FROM win)::DOUBLE) / (1 + df)) + 1 AS idf FROM (SELECT gram, count(*) AS n, count(DISTINCT (trace_id, w)) AS df FROM gr GROUP BY gram) ORDER BY n DESC, gram LIMIT {m}),
    tf AS (SELECT trace_id, w, idx, (1 + ln(count(*))) * any_value(idf) AS v FROM gr JOIN vc USING (gram) GROUP BY trace_id, w, idx)
    SELECT trace_id, w, CAST(idx AS INTEGER) AS idx, v / sqrt(sum(v * v) OVER (PARTITION BY trace_id, w)) AS weight FROM tf"""


@query(
    "fea_01_word_tfidf",
    _tfidf_sql(""", gr AS (SELECT trace_id, w, unnest(list_concat(list_transform(win, lambda t: t::BIGINT), list_transform(range(1, 20), lambda i: (win[i] + 1)::BIGINT * 4294967296 + win[i + 1]))) AS gram FROM win)""", 1000),
    "win", rounds="weight",
)
def _(s, d):
    w = ordering.cut(ev_windows(s, d))
    return features.WordTfidf(1000).fit(w).weights(w)


@query(
    "fea_02_char_tfidf",
    _tfidf_sql(""", pd AS (SELECT trace_id, w, ' ' || unnest(win) || ' ' AS p FROM win), gr AS (SELECT trace_id, w, substr(p, i, 3) AS gram FROM (SELECT *, unnest(range(1, greatest(1, length(p) - 2) + 1)) AS i FROM pd)
    UNION ALL SELECT trace_id, w, substr(p, i, 4) FROM (SELECT *, unnest(range(1, length(p) - 3 + 1)) AS i FROM pd WHERE length(p) >= 4) UNION ALL SELECT trace_id, w, substr(p, i, 5) FROM (SELECT *, unnest(range(1, length(p) - 4 + 1)) AS i FROM pd WHERE length(p) >= 5))""", 2000),
    "win", rounds="weight",
)
def _(s, d):
    w = ordering.cut(ev_windows(s, d))
    return features.CharTfidf(2000).fit(w).weights(w)


@query("fea_03_pca", rounds="p0 p1 p2")
def _(s, d):
    v = vectors(s, d)
    out = features.pca(v, 3).transform(v)
    return out.select("vec_id", *[F.col("projected")[i].alias(f"p{i}") for i in range(3)])


@query("fea_04_svd", rounds="p0 p1 p2")
def _(s, d):
    v = vectors(s, d)
    out = features.svd(v, 3).transform(v)
    return out.select("vec_id", *[F.col("projected")[i].alias(f"p{i}") for i in range(3)])


@query("fea_05_feature_sweep", rounds="auc ap best_f1")
def _(s, d):
    train = ordering.cut(train_windows(s, d))
    test = ordering.cut(ev_windows(s, d).join(meta(s, d).select("trace_id", "y"), "trace_id"))
    return features.sweep_features(train, test)


@query("smp_02_coreset")
def _(s, d):
    return coresets.coreset(vectors(s, d), 0.05).select("cluster", "vec_id")


@query(
    "jn_11_nearest_to_centres",
    f""", v AS ({VEC}), c AS (SELECT label, dim, avg(x) AS m FROM v JOIN embeddings USING (vec_id) GROUP BY label, dim), d AS (SELECT vec_id, c.label, sum((x - m) * (x - m)) AS d FROM v JOIN c USING (dim) GROUP BY ALL),
    n AS (SELECT vec_id, label, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS r FROM d) WHERE r = 1)
    SELECT CAST(label AS INTEGER) AS cluster, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d) AS r FROM n) WHERE r = 1""",
)
def _(s, d):
    v = vectors(s, d)
    # Ten centres: the class means.
    means = v.select("vec_id", F.posexplode("vec").alias("i", "x")).join(table(s, d, "embeddings").select("vec_id", "label"), "vec_id").groupBy("label", "i").agg(F.avg("x").alias("x"))
    rows = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("r")).orderBy("label").collect()
    centres = np.array([[p["x"] for p in r["r"]] for r in rows])
    return features.nearest_to_centres(v, centres).select("cluster", "vec_id")


@query(
    "jn_12_knn",
    f""", v AS ({VEC}), d AS (SELECT a.vec_id, b.vec_id AS other, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS distance FROM v a JOIN v b USING (dim) GROUP BY ALL)
    SELECT vec_id, place, other, distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, other) - 1 AS place FROM d) WHERE place < 5""",
    rounds="distance", places=5,
)
def _(s, d):
    return frequency.nearest_rows(vectors(s, d), 5)


MARKOV = """, bg AS (SELECT trace_id, w, win[i] AS a, win[i + 1] AS b FROM (SELECT *, unnest(range(1, 20)) AS i FROM win)),
    md AS (SELECT a, b, ln(n / sum(n) OVER (PARTITION BY a)) AS lp FROM (SELECT a, b, count(*) AS n FROM bg JOIN meta USING (trace_id) WHERE y = 0 GROUP BY a, b))"""


@query("jn_10_transition_lookup", MARKOV + "SELECT trace_id, w, bg.a, bg.b, coalesce(lp, -10) AS lp FROM bg LEFT JOIN md ON md.a = bg.a AND md.b = bg.b", "win", "meta", rounds="lp")
def _(s, d):
    model = chronology.Markov(1).fit(train_windows(s, d)).model
    rows = win.ngrams(ev_windows(s, d), 2).join(model.select("state", "nxt", F.log("p").alias("lp")), ["state", "nxt"], "left")
    return rows.select("trace_id", "w", F.col("state")[0].alias("a"), F.col("nxt").alias("b"), F.coalesce("lp", F.lit(chronology.UNSEEN)).alias("lp"))


@query("scr_06_markov_windows", MARKOV + "SELECT trace_id, w, -sum(coalesce(lp, -10)) / 19 AS score FROM bg LEFT JOIN md ON md.a = bg.a AND md.b = bg.b GROUP BY trace_id, w", "win", "meta", rounds="score")
def _(s, d):
    return chronology.Markov(1).fit(train_windows(s, d)).score(ev_windows(s, d)).select("trace_id", "w", "score")


@query(
    "scr_06_markov_order_3",
    """, bg AS (SELECT trace_id, w, win[i:i + 2] AS a, win[i + 3] AS b FROM (SELECT *, unnest(range(1, 18)) AS i FROM win)),
    md AS (SELECT a, b, ln(n / sum(n) OVER (PARTITION BY a)) AS lp FROM (SELECT a, b, count(*) AS n FROM bg JOIN meta USING (trace_id) WHERE y = 0 GROUP BY a, b))
    SELECT trace_id, w, -sum(coalesce(lp, -10)) / 17 AS score FROM bg LEFT JOIN md ON md.a = bg.a AND md.b = bg.b GROUP BY trace_id, w""",
    "win", "meta", rounds="score",
)
def _(s, d):
    return chronology.Markov(3).fit(train_windows(s, d)).score(ev_windows(s, d)).select("trace_id", "w", "score")


@query("scr_06_markov_streams", MARKOV + "SELECT trace_id, w, -sum(coalesce(lp, -10)) / 19 AS score FROM bg LEFT JOIN md ON md.a = bg.a AND md.b = bg.b GROUP BY trace_id, w", "win", "meta", rounds="score")
def _(s, d):
    tokens = ordering.cut(ev_tokens(s, d))
    train = tokens.join(meta(s, d).where(F.col("y") == 0).select("trace_id"), "trace_id", "left_semi")
    return chronology.Markov(1).fit_tokens(train).score_tokens(tokens)


@query(
    "scr_06_markov_long_traces",
    """, pr AS (SELECT trace_id, pos, token AS b, lag(token) OVER (PARTITION BY trace_id ORDER BY pos) AS a, count(*) OVER (PARTITION BY trace_id) AS len FROM ltok),
    wn AS (SELECT trace_id, CAST(unnest(range(0, (len - 20) // 2 + 1)) AS BIGINT) AS w FROM (SELECT DISTINCT trace_id, len FROM pr WHERE len >= 20)),
    bg AS (SELECT wn.trace_id, w, a, b FROM wn JOIN pr ON pr.trace_id = wn.trace_id AND pos BETWEEN 2 * w + 1 AND 2 * w + 19),
    md AS (SELECT a, b, ln(n / sum(n) OVER (PARTITION BY a)) AS lp FROM (SELECT a, b, count(*) AS n FROM bg GROUP BY a, b))
    SELECT trace_id, w, -sum(lp) / 19 AS score FROM bg JOIN md ON md.a = bg.a AND md.b = bg.b GROUP BY trace_id, w""",
    "ltok", rounds="score",
)
def _(s, d):
    tokens = ordering.cut(li_tokens(s, d))
    return chronology.Markov(1).fit_tokens(tokens).score_tokens(tokens)


@query("scr_01_one_class_svm", rounds="score")
def _(s, d):
    v = vectors(s, d)
    return frequency.OneClassSvm(0.1).fit(v.where(F.col("y") == 0)).score(v).select("vec_id", "score")


@query("scr_01_one_class_svm_windows", rounds="score")
def _(s, d):
    train = ordering.cut(train_windows(s, d))
    model = features.WordTfidf(100).fit(train)
    machine = frequency.OneClassSvm(0.01).fit(model.with_vectors(train))
    return machine.score(model.with_vectors(ev_windows(s, d))).select("trace_id", "w", "score")


@query("scr_02_isolation_forest", rounds="score")
def _(s, d):
    v = vectors(s, d)
    return frequency.IsolationForest(keys=["vec_id"]).fit(v).score(v).select("vec_id", "score")


@query(
    "scr_03_lof",
    f""", v AS ({VEC}), tr AS (SELECT vec_id FROM embeddings ORDER BY md5(concat_ws(':', vec_id, 42)) LIMIT 1000),
    d AS (SELECT a.vec_id AS a, b.vec_id AS b, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS d FROM v a JOIN v b USING (dim) WHERE b.vec_id IN (SELECT vec_id FROM tr) GROUP BY ALL),
    nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM d WHERE a <> b AND a IN (SELECT vec_id FROM tr)) WHERE r <= 50), kd AS (SELECT a, max(d) AS kd FROM nn GROUP BY a),
    lr AS (SELECT nn.a, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM nn JOIN kd ON kd.a = nn.b GROUP BY nn.a),
    qn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM d) WHERE r <= 50)
    SELECT qn.a AS vec_id, avg(lrd) * (avg(greatest(d, kd)) + 1e-10) AS score FROM qn JOIN kd ON kd.a = qn.b JOIN lr ON lr.a = qn.b GROUP BY qn.a""",
    rounds="score", places=5,
)
def _(s, d):
    v = vectors(s, d)
    return frequency.Lof(50, 1000, keys=["vec_id"]).fit(v).score(v).select("vec_id", "score")


@query("scr_04_pca_error", rounds="score")
def _(s, d):
    v = vectors(s, d)
    return frequency.PcaError(12).fit(v).score(v).select("vec_id", "score")


@query(
    "scr_05_hbos",
    f""", v AS ({VEC}), b AS (SELECT dim, min(x) AS lo, (max(x) - min(x)) / 80 AS width FROM v GROUP BY dim), p AS (SELECT vec_id, dim, least(79, floor((x - lo) / width)) AS bin, width FROM v JOIN b USING (dim)),
    h AS (SELECT dim, bin, count(*) / ((SELECT count(*) FROM embeddings) * any_value(width)) AS density FROM p GROUP BY dim, bin) SELECT vec_id, -sum(log2(density + 0.1)) AS score FROM p JOIN h USING (dim, bin) GROUP BY vec_id""",
    rounds="score",
)
def _(s, d):
    v = vectors(s, d)
    return frequency.Hbos(80).fit(v).score(v).select("vec_id", "score")


@query("scr_07_hmm", rounds="score")
def _(s, d):
    return chronology.Hmm(4).fit(train_windows(s, d)).score(ev_windows(s, d)).select("trace_id", "w", "score")


@query(
    "scr_08_context_model",
    """, cx AS (SELECT trace_id, w, i, target, o, CASE WHEN o < 5 THEN win[i - 4 + o] ELSE win[i - 3 + o] END AS near FROM (SELECT trace_id, w, win, i, win[i + 1] AS target, unnest(range(0, 10)) AS o FROM (SELECT *, unnest(range(5, 15)) AS i FROM win))),
    tr AS (SELECT o, near, target FROM cx JOIN meta USING (trace_id) WHERE y = 0), md AS (SELECT o, near, target, count(*) AS n FROM tr GROUP BY ALL), tt AS (SELECT o, near, count(*) AS t FROM tr GROUP BY ALL),
    p AS (SELECT trace_id, w, i, avg((coalesce(n, 0) + 0.1::DOUBLE) / (coalesce(t, 0) + 0.1::DOUBLE * (SELECT count(DISTINCT target) FROM tr))) AS p FROM cx LEFT JOIN md ON md.o = cx.o AND md.near = cx.near AND md.target = cx.target LEFT JOIN tt ON tt.o = cx.o AND tt.near = cx.near GROUP BY ALL)
    SELECT trace_id, w, avg(-ln(p)) AS score FROM p GROUP BY trace_id, w""",
    "win", "meta", rounds="score",
)
def _(s, d):
    return chronology.ContextModel(5).fit(train_windows(s, d)).score(ev_windows(s, d)).select("trace_id", "w", "score")


@query("scr_09_embedding_error", rounds="score")
def _(s, d):
    return topology.EmbeddingError(8, 12).fit(train_windows(s, d)).score(ev_windows(s, d)).select("trace_id", "w", "score")


@query(
    "scr_10_centre_distance",
    f""", v AS ({VEC}), h AS (SELECT vec_id FROM embeddings ORDER BY md5(concat_ws(':', vec_id, 42)) LIMIT 1000), c AS (SELECT dim, avg(x) AS m FROM v WHERE vec_id IN (SELECT vec_id FROM h) GROUP BY dim)
    SELECT vec_id, sum((x - m) * (x - m)) AS score FROM v JOIN c USING (dim) GROUP BY vec_id""",
    rounds="score",
)
def _(s, d):
    v = vectors(s, d)
    return frequency.CentreDistance(1000, keys=["vec_id"]).fit(v).score(v).select("vec_id", "score")


def _mean_jump():
    def predict(batch):
        return np.abs(np.diff(batch, axis=1)).mean(axis=1)

    return predict


@query("scr_11_batch_score", "SELECT trace_id, w, path_c * 99 AS score FROM pool", "pool", rounds="score")
def _(s, d):
    return topology.batch_score(ev_windows(s, d), _mean_jump).select("trace_id", "w", "score")


@query("fus_01_assembled", "SELECT trace_id, w, path_a, path_b, path_c FROM pool", "pool", rounds="path_a path_b path_c")
def _(s, d):
    p = pool(s, d)
    return fusion.assemble(*[p.select("trace_id", "w", F.col(c).alias("score")) for c in ("path_a", "path_b", "path_c")])


def labelled_pool(s, d):
    return ordering.cut(pool(s, d).select("trace_id", "w", "y", "family", "path_a", "path_b", "path_c"))


@query("fus_02_normal_scores", rounds="path_a_n path_b_n path_c_n")
def _(s, d):
    p = labelled_pool(s, d)
    return fusion.NormalScores().fit(p).transform(p).select("trace_id", "w", "path_a_n", "path_b_n", "path_c_n")


def _fused(make):
    def run(s, d):
        p = labelled_pool(s, d)
        return make(p).score(p).select("trace_id", "w", "prob")

    return run


query("fus_03_logistic", rounds="prob")(_fused(fusion.fuse_logistic))
query("fus_04_forest", rounds="prob")(_fused(lambda p: fusion.fuse_forest(p)))
query("fus_05_boosted", rounds="prob")(_fused(lambda p: fusion.fuse_boosted(p)))
query("fus_06_svm", rounds="prob")(_fused(fusion.fuse_svm))
query("fus_07_mlp", rounds="prob")(_fused(fusion.fuse_mlp))


@query("fus_08_fit_all", rounds="auc ap fpr95 tau precision recall specificity f1 mcc")
def _(s, d):
    p = labelled_pool(s, d)
    folds = sampling.split_traces(p).select("trace_id", "fold")
    p = ordering.cut(p.join(folds, "trace_id"))
    return fusion.fit_fusion(*[p.where(F.col("fold") == f).drop("fold") for f in ("train", "val", "test")])[1]


def _cdf(c: str) -> str:
    at = "i * (n - 1) / 999.0::DOUBLE"
    return f"""g_{c} AS (SELECT list(g ORDER BY i) AS g FROM (SELECT i, s[CAST(floor({at}) AS INTEGER) + 1] + ({at} - floor({at})) * (s[CAST(ceil({at}) AS INTEGER) + 1] - s[CAST(floor({at}) AS INTEGER) + 1]) AS g FROM (
        SELECT unnest(range(0, 1000)) AS i, s, len(s) AS n FROM (SELECT list({c} ORDER BY {c}) AS s FROM pool WHERE y = 0)))),
    c_{c} AS (SELECT v, CASE WHEN j = 0 THEN 0.0 WHEN j = 1000 THEN 1.0 ELSE (j - 1) / 999.0::DOUBLE + (v - g[j]) / (g[j + 1] - g[j]) / 999.0::DOUBLE END AS u FROM (SELECT v, g, len(list_filter(g, lambda x: x <= v)) AS j FROM (SELECT DISTINCT {c} AS v FROM pool), g_{c}))"""


@query(
    "fus_09_cdf_max",
    f", {_cdf('path_a')}, {_cdf('path_b')}, {_cdf('path_c')} SELECT trace_id, w, greatest(a.u, b.u, c.u) AS score FROM pool JOIN c_path_a a ON a.v = path_a JOIN c_path_b b ON b.v = path_b JOIN c_path_c c ON c.v = path_c",
    "pool", rounds="score",
)
def _(s, d):
    p = labelled_pool(s, d)
    return fusion.CdfMax().fit(p.where(F.col("y") == 0)).score(p).select("trace_id", "w", "score")


@query("fus_10_mixture", rounds="score")
def _(s, d):
    p = labelled_pool(s, d)
    return fusion.Mixture(3).fit(p.where(F.col("y") == 0)).score(p).select("trace_id", "w", "score")


@query("fus_10_mixture_of_five", rounds="score")
def _(s, d):
    p = labelled_pool(s, d)
    return fusion.Mixture(5).fit(p.where(F.col("y") == 0)).score(p).select("trace_id", "w", "score")


@query("fus_11_score_forest", rounds="score")
def _(s, d):
    p = labelled_pool(s, d)
    forest = fusion.score_forest(p.where(F.col("y") == 0))
    return forest.score(p.withColumn("vec", F.array("path_a", "path_b", "path_c"))).select("trace_id", "w", "score")


@query("cur_17_leave_family_out", rounds="auc ap best_f1 best_tau fpr95 tpr_fpr1 tpr_fpr01")
def _(s, d):
    return protocols.leave_family_out(labelled_pool(s, d), lambda t: fusion.fuse_forest(t))


@query("cur_18_abi_impact", rounds="auc degradation")
def _(s, d):
    labels = table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("trace_id"), (F.col("s_acctbal") < 2000).cast("int").alias("y"))
    # A window comes twice only where a trace has two labels.
    twice = not labels.where("trace_id is not null").groupBy("trace_id").count().where("count > 1").isEmpty()

    def fit(benign):
        markov = chronology.Markov(1).fit(benign)
        centre = frequency.CentreDistance(1000).fit(benign.withColumn("vec", F.transform("win", lambda t: t.cast("double"))))
        return {
            "markov": lambda w: markov.score(w, twice),
            "centre": lambda w: centre.score(w.withColumn("vec", F.transform("win", lambda t: t.cast("double")))),
        }

    return protocols.abi_impact(li_tokens(s, d), labels, ordering.cut(abi_map(s, d)), [("economy", "standard")], 341, fit)


@query("udx_03_sliding_windows_sql", "SELECT trace_id, w, array_to_string(win, ',') AS win FROM win", "win")
def _(s, d):
    from seqalert.functions import sql

    sql.register(s)
    # Traces of the events as arrays of 64 tokens, each with the tokens that complete its last windows.
    packed = win.pack(ev_tokens(s, d), size=64, ahead=19)
    packed.createOrReplaceTempView("packed_traces")
    out = s.sql("SELECT p.trace_id, s.w, s.win FROM packed_traces p, LATERAL sliding_windows(p.seq, 20, 2, p.chunk * 64, 64) s")
    return out.select("trace_id", "w", F.array_join("win", ",").alias("win"))


@query(
    "udx_04_grouped_curves",
    """, r AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) %% 2 AS y, value AS score FROM events) %s SELECT event_type, sum(pos * (N - cum_neg + neg / 2.0::DOUBLE)) / (max(P)::DOUBLE * max(N)) AS auc, sum(pos / P::DOUBLE * prec) AS ap FROM rates GROUP BY event_type"""
    % __import__("seqalert.contract.metrics", fromlist=["curve_sql"]).curve_sql("r", "event_type"),
    rounds="auc ap",
)
def _(s, d):
    from seqalert.functions import sql

    y = F.get_json_object("props", "$.k").cast("int") % 2
    rows = table(s, d, "events").select("event_type", y.alias("y"), F.col("value").alias("score"))
    sql.curve_view(rows, ["event_type"], "grouped_curves")
    return s.sql("SELECT event_type, auc, ap FROM grouped_curves")


@query("udx_05_sql_helpers", "SELECT page_id, lower(url) AS path FROM pages")
def _(s, d):
    from seqalert.functions import sql

    sql.register(s, abi_map(s, d))
    table(s, d, "pages").createOrReplaceTempView("raw_pages")
    return s.sql(r"SELECT page_id, canonical_path(replace(url, '/', '\\')) AS path FROM raw_pages")


@query(
    "udx_05_abi_number",
    "SELECT p_partkey, number FROM part LEFT JOIN pnums ON abi = 'economy' AND name = replace(p_name, ' ', '_') || '_' || replace(p_brand, '#', '')", "pnums",
)
def _(s, d):
    from seqalert.functions import sql

    sql.register(s, abi_map(s, d))
    table(s, d, "part").createOrReplaceTempView("parts")
    return s.sql("SELECT p_partkey, abi_number('economy', concat(replace(p_name, ' ', '_'), '_', replace(p_brand, '#', ''))) AS number FROM parts")
