"""Seeded samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqalert.contract.base import LABELLED, ev_windows, labelled, meta, pool, query, table
from seqalert.contract.metrics import AUC, CONF, CONF_COLS, curve_sql
from seqalert.operators import ordering, sampling

H = "md5(concat_ws(':', {}, 42))"


@query(
    "smp_01_sample_by_length",
    f""", st AS (SELECT trace_id, CAST(ntile(5) OVER (ORDER BY n_windows, trace_id) AS INTEGER) AS stratum FROM nw)
    SELECT trace_id, w, stratum FROM (SELECT trace_id, w, stratum, row_number() OVER (PARTITION BY stratum ORDER BY {H.format('trace_id, w')}) AS r FROM win JOIN st USING (trace_id)) WHERE r <= 200""",
    "win", "nw",
)
def _(s, d):
    return sampling.sample_by_length(ev_windows(s, d), 5, 200).select("trace_id", "w", "stratum")


WEIGHTS = """, bg AS (SELECT trace_id, w, win[i] AS a, win[i + 1] AS b FROM (SELECT *, unnest(range(1, 20)) AS i FROM win)), co AS (SELECT a, b, count(*) / (SELECT count(*) FROM bg)::DOUBLE AS q FROM bg GROUP BY a, b),
    wt AS (SELECT trace_id, w, sum(least(n / 19.0::DOUBLE, q)) AS weight FROM (SELECT trace_id, w, a, b, count(*) AS n FROM bg GROUP BY ALL) JOIN co USING (a, b) GROUP BY trace_id, w)"""


@query("smp_03_transition_weights", WEIGHTS + "SELECT trace_id, w, weight FROM wt", "win", rounds="weight", places=9)
def _(s, d):
    return sampling.transition_weights(ev_windows(s, d))


@query(
    "smp_03_sample_by_transition",
    WEIGHTS + """, dr AS (SELECT *, md5(concat_ws(':', trace_id, w, 42)) AS h FROM wt) SELECT trace_id, w, weight FROM (
    SELECT *, row_number() OVER (ORDER BY -ln((CAST('0x' || substr(h, 1, 12) AS BIGINT)::DOUBLE + 1) / 281474976710657.0::DOUBLE) / weight, h) AS r FROM dr) WHERE r <= 500""",
    "win", rounds="weight", places=9,
)
def _(s, d):
    return sampling.sample_by_transition(ev_windows(s, d), 500).select("trace_id", "w", "weight")


@query(
    "smp_04_sample_traces",
    f""", r AS (SELECT trace_id, n_windows, sum(n_windows) OVER (ORDER BY {H.format('trace_id')} ROWS UNBOUNDED PRECEDING) AS upto FROM nw) SELECT win.trace_id, w FROM win JOIN r USING (trace_id) WHERE w < 1000 - (upto - n_windows)""",
    "win", "nw",
)
def _(s, d):
    return sampling.sample_traces(ev_windows(s, d), 1000).select("trace_id", "w")


@query("smp_05_split_rows", f"SELECT trace_id, w, CASE WHEN row_number() OVER (ORDER BY {H.format('trace_id, w')}) <= floor(count(*) OVER () * 0.2) THEN 'calibration' ELSE 'test' END AS part FROM win", "win")
def _(s, d):
    return sampling.split_rows(ev_windows(s, d), 0.2).select("trace_id", "w", "part")


@query("smp_06_eval_pool", f"SELECT trace_id, w, y FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {H.format('trace_id, w')}) AS r FROM pool) WHERE r <= 500", "pool")
def _(s, d):
    return sampling.eval_pool(pool(s, d), 500).select("trace_id", "w", "y")


@query(
    "smp_06_pool_thresholds",
    f"""SELECT quantile_cont(path_a, 0.95) AS path_a, quantile_cont(path_b, 0.95) AS path_b, quantile_cont(path_c, 0.95) AS path_c FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {H.format('trace_id, w')}) AS r FROM pool) WHERE r <= 500 AND y = 0""",
    "pool", rounds="path_a path_b path_c",
)
def _(s, d):
    return sampling.pool_thresholds(sampling.eval_pool(pool(s, d), 500), ["path_a", "path_b", "path_c"])


@query(
    "smp_07_balanced",
    f""", lab AS ({LABELLED}) SELECT id, y FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {H.format('id')}) AS r FROM lab) WHERE r <= (SELECT least(sum(y), sum(1 - y)) FROM lab)""",
)
def _(s, d):
    return sampling.balance(labelled(s, d)).select("id", "y")


@query(
    "smp_08_split_traces",
    f"""SELECT trace_id, y, CASE WHEN r <= a THEN 'train' WHEN r <= a + b THEN 'val' ELSE 'test' END AS fold FROM (SELECT *, greatest(floor(t * 0.6), y) AS a, greatest(floor(t * 0.2), y) AS b FROM (
    SELECT trace_id, y, row_number() OVER (PARTITION BY y ORDER BY {H.format('trace_id')}) AS r, count(*) OVER (PARTITION BY y) AS t FROM meta WHERE trace_id IN (SELECT trace_id FROM win)))""",
    "meta", "win",
)
def _(s, d):
    return sampling.split_traces(pool(s, d))


@query("smp_09_split_groups", f"SELECT trace_id, CASE WHEN row_number() OVER (ORDER BY {H.format('trace_id')}) <= ceil(count(*) OVER () * 0.4) THEN 'test' ELSE 'train' END AS part FROM nw", "nw")
def _(s, d):
    return sampling.split_groups(ev_windows(s, d))


HOLD = f""", ho AS (SELECT trace_id, r <= greatest(1, least(t - 1, round(t * 0.5))) AS cal FROM (SELECT trace_id, row_number() OVER (PARTITION BY y ORDER BY {H.format('trace_id')}) AS r, count(*) OVER (PARTITION BY y) AS t FROM meta
    WHERE trace_id IN (SELECT trace_id FROM win))), hp AS (SELECT y, prob AS score, cal FROM pool JOIN ho USING (trace_id)), hc AS (SELECT * FROM hp WHERE cal)"""


@query(
    "smp_10_holdout",
    HOLD + curve_sql("hc") + ", tau AS (SELECT score AS tau FROM rates ORDER BY f1 DESC, score LIMIT 1)" + CONF.format(g="", extra=", tau", src="SELECT y, tau, score >= tau AS p FROM hp, tau WHERE NOT cal"),
    "pool", rounds=CONF_COLS + " tau",
)
def _(s, d):
    return sampling.holdout(pool(s, d), score="prob")


# Nested folds for two variants, three outer and two inner folds.
_FOLD = """, of AS (SELECT trace_id, CAST(ntile(5) OVER (ORDER BY md5(concat_ws(':', trace_id, 42))) AS INTEGER) AS fold FROM nw),
    tr AS (SELECT trace_id, o AS outr FROM of, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS o) WHERE o <> fold),
    inn AS (SELECT outr, trace_id, CAST(ntile(3) OVER (PARTITION BY outr ORDER BY md5(concat_ws(':', trace_id, 43))) AS INTEGER) AS inr FROM tr),
    lg AS (SELECT trace_id, y, unnest(['path_a', 'prob']) AS variant, unnest([path_a, prob]) AS score FROM pool),
    fit AS (SELECT outr, i AS inr, variant, score, y FROM lg JOIN inn USING (trace_id), (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS i) WHERE i <> inn.inr),
    jud AS (SELECT outr, inr, variant, score, y FROM lg JOIN inn USING (trace_id))"""


def _three(src: str, name: str, by: str) -> str:
    return curve_sql(src, by).replace("st AS", f"st_{name} AS").replace("FROM st ", f"FROM st_{name} ").replace(" cu AS", f" cu_{name} AS").replace("FROM cu)", f"FROM cu_{name})").replace(" rates AS", f" rates_{name} AS")


_NESTED = (
    _FOLD + _three("fit", "fit", "outr, inr, variant") + _three("jud", "jud", "outr, inr, variant")
    + f""", tau AS (SELECT outr, inr, variant, score AS tau FROM (SELECT *, row_number() OVER (PARTITION BY outr, inr, variant ORDER BY f1 DESC, score) AS r FROM rates_fit) WHERE r = 1),
    f1 AS (SELECT outr, inr, variant, any_value(tau) AS tau, 2 * count(CASE WHEN y = 1 AND score >= tau THEN 1 END) / (count(CASE WHEN score >= tau THEN 1 END) + count(CASE WHEN y = 1 THEN 1 END))::DOUBLE AS f1 FROM jud JOIN tau USING (outr, inr, variant) GROUP BY ALL),
    au AS (SELECT outr, inr, variant, {AUC} AS auc FROM cu_jud GROUP BY ALL),
    rk AS (SELECT outr, variant, avg(f1) AS mean_f1, avg(auc) AS mean_auc, stddev_pop(f1) AS std_f1, median(tau) AS tau FROM f1 JOIN au USING (outr, inr, variant) GROUP BY outr, variant),
    ch AS (SELECT *, row_number() OVER (PARTITION BY outr ORDER BY mean_f1 DESC, mean_auc DESC, std_f1, variant) AS place FROM rk)"""
)


@query(
    "smp_11_nested_cv",
    _NESTED + ", te AS (SELECT fold AS outer_fold, lg.variant, tau, score, y FROM lg JOIN of USING (trace_id) JOIN ch ON ch.outr = of.fold AND ch.variant = lg.variant AND place = 1)" + _three("te", "te", "outer_fold, variant, tau")
    + f""", fx AS (SELECT outer_fold, 2 * count(CASE WHEN y = 1 AND score >= tau THEN 1 END) / (count(CASE WHEN score >= tau THEN 1 END) + count(CASE WHEN y = 1 THEN 1 END))::DOUBLE AS f1 FROM te GROUP BY outer_fold)
    SELECT outer_fold, variant, tau, {AUC} AS auc, any_value(fx.f1) AS f1 FROM cu_te JOIN fx USING (outer_fold) GROUP BY outer_fold, variant, tau""",
    "pool", "nw", rounds="tau auc f1",
)
def _(s, d):
    return sampling.nested_cv(ordering.cut(pool(s, d)), ["path_a", "prob"])


@query(
    "top_06_rank_variants",
    """, v AS (SELECT c_nationkey AS outr, c_mktsegment AS variant, c_acctbal AS f1, c_custkey / 1024.0::DOUBLE AS auc, c_acctbal / 2 AS tau FROM customer)
    SELECT outr AS "outer", variant, mean_f1, mean_auc, std_f1, tau, CAST(row_number() OVER (PARTITION BY outr ORDER BY mean_f1 DESC, mean_auc DESC, std_f1, variant) AS INTEGER) AS place FROM (
    SELECT outr, variant, avg(f1) AS mean_f1, avg(auc) AS mean_auc, stddev_pop(f1) AS std_f1, median(tau) AS tau FROM v GROUP BY outr, variant)""",
    rounds="mean_f1 mean_auc std_f1 tau",
)
def _(s, d):
    c = table(s, d, "customer")
    rows = c.select(F.col("c_nationkey").alias("outer"), F.col("c_mktsegment").alias("variant"), F.col("c_acctbal").alias("f1"), (F.col("c_custkey") / 1024.0).alias("auc"), (F.col("c_acctbal") / 2).alias("tau"))
    return sampling.rank_variants(rows)


@query(
    "smp_12_sample_manifest",
    f""", f AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN 'fam_' || o_orderstatus END AS family, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus || '_' || o_orderpriority ELSE 'benign' END AS source_group, 'f/' || o_orderkey AS source_file FROM orders),
    b AS (SELECT *, row_number() OVER (ORDER BY {H.format('source_file')}) AS r, count(*) OVER () AS t FROM f WHERE family IS NULL),
    dr AS (SELECT family, source_group, count(*) AS n, CAST(floor(count(*) * 0.37::DOUBLE) AS BIGINT) AS base, count(*) * 0.37::DOUBLE - floor(count(*) * 0.37::DOUBLE) AS rest FROM f WHERE family IS NOT NULL GROUP BY ALL),
    q AS (SELECT family, source_group, base + CASE WHEN row_number() OVER (PARTITION BY family ORDER BY rest DESC, source_group) <= floor(sum(n) OVER (PARTITION BY family) * 0.37::DOUBLE) - sum(base) OVER (PARTITION BY family) THEN 1 ELSE 0 END AS quota FROM dr),
    a AS (SELECT f.*, row_number() OVER (PARTITION BY f.family, f.source_group ORDER BY {H.format('source_file')}) AS r, quota FROM f JOIN q ON q.family = f.family AND q.source_group = f.source_group)
    SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, CASE WHEN family IS NULL THEN 'benign_control' ELSE 'malware_targeted' END AS intended_label, family AS target_preset, source_group, source_file, source_file AS expected_detect_file FROM (
    SELECT o_orderkey, family, source_group, source_file FROM b WHERE r <= floor(t * 0.1) UNION ALL SELECT o_orderkey, family, source_group, source_file FROM a WHERE r <= quota)""",
)
def _(s, d):
    o = table(s, d, "orders")
    attack = F.col("o_orderstatus") != "O"
    files = o.select(
        F.col("o_orderkey").cast("string").alias("sample_id"), F.when(attack, F.concat_ws("_", "o_orderstatus", "o_orderpriority")).otherwise("benign").alias("source_group"),
        F.when(attack, F.concat(F.lit("fam_"), "o_orderstatus")).alias("family"), F.concat(F.lit("f/"), "o_orderkey").alias("source_file"),
    )
    return sampling.sample_manifest(files, 0.1, 0.37)


@query("smp_13_split_by_domain", f"SELECT doc_id, source, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY {H.format('doc_id')}) <= floor(count(*) OVER (PARTITION BY source) * 0.2) THEN 'train' ELSE 'val' END AS part FROM documents")
def _(s, d):
    return sampling.split_by_domain(table(s, d, "documents").select("doc_id", "source"), 0.2, domain="source", key="doc_id")
