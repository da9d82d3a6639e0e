"""Ranking curves, confusion rates and pool analytics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from seqalert.contract.base import LABELLED, TAU, ev_tokens, labelled, pool, query, table
from seqalert.operators import curves, ordering, pools, sampling

# Score table and per-threshold rates of the labelled events, in one group or per user group.
CURVE = f""", lab AS ({LABELLED}), st AS (SELECT score, count(CASE WHEN y = 1 THEN 1 END) AS pos, count(CASE WHEN y = 0 THEN 1 END) AS neg FROM lab GROUP BY score),
    cu AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS cum_pos, CAST(sum(neg) OVER w AS BIGINT) AS cum_neg, CAST(sum(pos) OVER () AS BIGINT) AS P, CAST(sum(neg) OVER () AS BIGINT) AS N FROM st WINDOW w AS (ORDER BY score DESC)),
    rates AS (SELECT *, cum_pos / P::DOUBLE AS tpr, cum_neg / N::DOUBLE AS fpr, cum_pos / (cum_pos + cum_neg)::DOUBLE AS prec,
    2 * (cum_pos / (cum_pos + cum_neg)::DOUBLE) * (cum_pos / P::DOUBLE) / (cum_pos / (cum_pos + cum_neg)::DOUBLE + cum_pos / P::DOUBLE + 1e-8) AS f1 FROM cu)"""


def curve_sql(src: str, by: str = "") -> str:
    """CTEs ``cu`` and ``rates`` for rows ``(by, score, y)`` of ``src``."""
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f""", st AS (SELECT {g}score, count(CASE WHEN y = 1 THEN 1 END) AS pos, count(CASE WHEN y = 0 THEN 1 END) AS neg FROM {src} GROUP BY ALL),
    cu AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS cum_pos, CAST(sum(neg) OVER w AS BIGINT) AS cum_neg, CAST(sum(pos) OVER ({part}) AS BIGINT) AS P, CAST(sum(neg) OVER ({part}) AS BIGINT) AS N
        FROM st WINDOW w AS ({part}ORDER BY score DESC)),
    rates AS (SELECT *, cum_pos / P::DOUBLE AS tpr, cum_neg / N::DOUBLE AS fpr, cum_pos / (cum_pos + cum_neg)::DOUBLE AS prec,
        2 * (cum_pos / (cum_pos + cum_neg)::DOUBLE) * (cum_pos / P::DOUBLE) / (cum_pos / (cum_pos + cum_neg)::DOUBLE + cum_pos / P::DOUBLE + 1e-8) AS f1 FROM cu)"""


AUC = "sum(pos * (N - cum_neg + neg / 2.0::DOUBLE)) / (max(P)::DOUBLE * max(N))"
AP = "sum(pos / P::DOUBLE * prec)"
CONF = """SELECT {g} tp, fp, tn, fn, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp)::DOUBLE END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn)::DOUBLE END AS recall,
    CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp)::DOUBLE END AS specificity, CASE WHEN tn + fn = 0 THEN 0.0 ELSE tn / (tn + fn)::DOUBLE END AS npv,
    CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END AS f1,
    (CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn)::DOUBLE END + CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp)::DOUBLE END) / 2 AS balanced_accuracy,
    CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0.0 ELSE (tp * tn - fp * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) END AS mcc,
    CASE WHEN tn + fp = 0 THEN 0.0 ELSE fp / (tn + fp)::DOUBLE END AS fpr, CASE WHEN tp + fn = 0 THEN 0.0 ELSE fn / (tp + fn)::DOUBLE END AS fnr,
    (tp + fp) / (tp + fp + tn + fn)::DOUBLE AS positive_rate {extra} FROM (
    SELECT {g} count(CASE WHEN p AND y = 1 THEN 1 END) AS tp, count(CASE WHEN p AND y = 0 THEN 1 END) AS fp, count(CASE WHEN NOT p AND y = 0 THEN 1 END) AS tn, count(CASE WHEN NOT p AND y = 1 THEN 1 END) AS fn {extra}
    FROM ({src}) GROUP BY ALL)"""
CONF_COLS = "precision recall specificity npv f1 balanced_accuracy mcc fpr fnr positive_rate"
Q = lambda col, q: f"quantile_cont({col}, {q})"


def tbl(s, d, rows=300):
    return curves.score_table(labelled(s, d), task_rows=rows)


@query("cur_01_score_table", CURVE + "SELECT score, pos, neg, cum_pos, cum_neg, P, N FROM cu")
def _(s, d):
    return tbl(s, d)


@query("cur_01_roc_points", CURVE + "SELECT score, fpr, tpr FROM rates", rounds="fpr tpr")
def _(s, d):
    return curves.roc_points(tbl(s, d))


@query("cur_02_roc_auc", CURVE + f"SELECT {AUC} AS auc FROM cu", rounds="auc")
def _(s, d):
    return curves.roc_auc(tbl(s, d))


@query(
    "cur_02_roc_auc_by_group",
    f""", r AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 AS y, value AS score FROM events) {curve_sql('r', 'event_type')} SELECT event_type, {AUC} AS auc FROM cu GROUP BY event_type""",
    rounds="auc",
)
def _(s, d):
    y = F.get_json_object("props", "$.k").cast("int") % 2
    rows = table(s, d, "events").select("event_type", y.alias("y"), F.col("value").alias("score"))
    return curves.roc_auc(curves.score_table(rows, by=["event_type"], task_rows=500), by=["event_type"])


@query("cur_03_average_precision", CURVE + f"SELECT {AP} AS ap FROM rates", rounds="ap")
def _(s, d):
    return curves.average_precision(tbl(s, d))


@query("cur_04_best_f1", CURVE + "SELECT f1, score AS tau FROM rates ORDER BY f1 DESC, score LIMIT 1", rounds="f1")
def _(s, d):
    return curves.best_f1(tbl(s, d))


def _smooth_sql() -> str:
    """Local quadratic fits over 21 thresholds, the width for a hundred thresholds or more; weights by least squares."""
    x = np.vander(np.arange(21), 3)
    hat = x @ np.linalg.inv(x.T @ x) @ x.T
    rows = ", ".join("[" + ", ".join(repr(float(v)) for v in r) + "]::DOUBLE[]" for r in hat)
    return f""", fl AS (SELECT list(f1 ORDER BY score) AS f, list(score ORDER BY score) AS t FROM rates), ix AS (SELECT f, t, len(f) AS n, CAST(unnest(range(0, len(f))) AS INTEGER) AS i FROM fl),
    st2 AS (SELECT f[i + 1] AS f1, t[i + 1] AS tau, i, f[least(greatest(0, i - 10), n - 21) + 1 : least(greatest(0, i - 10), n - 21) + 21] AS part, i - least(greatest(0, i - 10), n - 21) AS k0 FROM ix)
    SELECT tau, f1, list_sum(list_transform(range(1, 22), lambda k: part[k] * ([{rows}])[k0 + 1][k])) AS smoothed_f1 FROM st2 ORDER BY smoothed_f1 DESC, i LIMIT 1"""


@query("cur_05_best_f1_smoothed", CURVE + _smooth_sql(), rounds="tau f1 smoothed_f1")
def _(s, d):
    return curves.best_f1_smoothed(tbl(s, d))


@query("cur_06_fpr_at_tpr", CURVE + "SELECT min(fpr) AS fpr FROM rates WHERE tpr >= 0.95", rounds="fpr")
def _(s, d):
    return curves.fpr_at_tpr(tbl(s, d))


@query("cur_07_tpr_at_fpr", CURVE + "SELECT max(CASE WHEN fpr <= 0.01 THEN tpr END) AS tpr FROM rates", rounds="tpr")
def _(s, d):
    return curves.tpr_at_fpr(tbl(s, d), 0.01)


BALANCED = f""", lab AS ({LABELLED}), rk AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(concat_ws(':', id, 42))) AS r FROM lab),
    bal AS (SELECT * FROM rk WHERE r <= (SELECT least(count(CASE WHEN y = 1 THEN 1 END), count(CASE WHEN y = 0 THEN 1 END)) FROM lab))"""


@query("cur_08_balanced_ap", BALANCED + curve_sql("bal") + f"SELECT {AP} AS ap FROM rates", rounds="ap")
def _(s, d):
    return curves.average_precision_balanced(labelled(s, d))


@query("cur_09_benign_threshold", f"SELECT quantile_cont(score, 0.95) AS tau FROM ({LABELLED}) WHERE y = 0", rounds="tau")
def _(s, d):
    return curves.benign_threshold(labelled(s, d))


@query("cur_09_benign_threshold_per_family", "SELECT split, quantile_cont(prob, 0.995) AS tau FROM pool WHERE y = 0 GROUP BY split", "pool", rounds="tau")
def _(s, d):
    return curves.benign_threshold(pool(s, d), 0.995, "prob", by=["split"])


def _halves(s, d):
    rows = ordering.cut(sampling.split_rows(labelled(s, d), 0.2, keys=["id"]))
    return rows.where(F.col("part") == "calibration"), rows.where(F.col("part") == "test")


HALVES = f""", lab AS ({LABELLED}), sp AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', id, 42))) <= floor(count(*) OVER () * 0.2) AS cal FROM lab), tst AS (SELECT * FROM sp WHERE NOT cal)"""


def _record(tau: str, method: str) -> str:
    return f"""{HALVES}{curve_sql('tst')}, t AS ({tau}), c AS ({CONF.format(g='', extra='', src='SELECT y, score >= (SELECT tau FROM t) AS p FROM tst')})
    SELECT '{method}' AS method, (SELECT tau FROM t) AS tau, {AUC} AS auc, {AP} AS ap, (SELECT f1 FROM c) AS f1, (SELECT precision FROM c) AS precision, (SELECT recall FROM c) AS recall, max(f1) AS oracle_f1,
    min(CASE WHEN tpr >= 0.95 THEN fpr END) AS fpr95 FROM rates"""


_CAL_F1 = """SELECT score AS tau FROM (SELECT score, 2 * (cp / (cp + cn)::DOUBLE) * (cp / p::DOUBLE) / (cp / (cp + cn)::DOUBLE + cp / p::DOUBLE + 1e-8) AS f1 FROM (
    SELECT score, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER () AS p FROM (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM sp WHERE cal GROUP BY score) WINDOW w AS (ORDER BY score DESC))) ORDER BY f1 DESC, score LIMIT 1"""


@query("cur_10_calibrated_by_curve", _record(_CAL_F1, "pr_curve"), rounds="tau auc ap f1 precision recall oracle_f1 fpr95")
def _(s, d):
    return curves.calibrated_metrics(*_halves(s, d), "pr_curve")


@query(
    "cur_10_calibrated_by_benign_quantile", _record("SELECT quantile_cont(score, 0.95) AS tau FROM sp WHERE cal AND y = 0", "benign_quantile"),
    rounds="tau auc ap f1 precision recall oracle_f1 fpr95",
)
def _(s, d):
    return curves.calibrated_metrics(*_halves(s, d), "benign_quantile")


@query("cur_11_bootstrap_ci")
def _(s, d):
    return curves.bootstrap_ci(curves.score_table(labelled(s, d)), 200)


def _delong_sql(source: str, s1: str, s2: str) -> str:
    """DeLong's test of two columns of ``source`` from average ranks over all rows and over the rows of a class."""
    rank = lambda c, by: f"rank() OVER ({by[0]} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by[1]} {c}) - 1) / 2.0::DOUBLE"
    both = ("", ""), ("PARTITION BY y", "y,")
    place = lambda i: f"CASE WHEN y = 1 THEN (r{i} - r{i}y) / n.n ELSE 1 - (r{i} - r{i}y) / n.p END AS v{i}"
    var = lambda f, y: f"{f} FILTER (y = {y}) / count(*) FILTER (y = {y})"
    parts = [sign + var(f, y) for sign, f in (("+", "var_samp(v1)"), ("+", "var_samp(v2)"), ("- 2 *", "covar_samp(v1, v2)")) for y in (1, 0)]
    return f"""WITH b AS (SELECT y, {s1} AS s1, {s2} AS s2 FROM {source}), n AS (SELECT sum(y) AS p, sum(1 - y) AS n FROM b),
    v AS (SELECT y, {', '.join(f"{rank(f's{i}', by)} AS r{i}{'y' if by[0] else ''}" for i in (1, 2) for by in both)} FROM b),
    pv AS (SELECT y, {place(1)}, {place(2)} FROM v, n),
    c AS (SELECT avg(v1) FILTER (y = 1) AS auc1, avg(v2) FILTER (y = 1) AS auc2, {' '.join(parts)} AS variance FROM pv)
    SELECT auc1, auc2, auc1 - auc2 AS diff, variance, (auc1 - auc2) / sqrt(variance) AS z, auc1 - auc2 - 1.959963984540054 * sqrt(variance) AS ci_lo, auc1 - auc2 + 1.959963984540054 * sqrt(variance) AS ci_hi FROM c"""


@query(
    "cur_12_delong",
    """, b AS (SELECT y, path_a AS s1, prob AS s2 FROM pool), n AS (SELECT sum(y) AS p, sum(1 - y) AS n FROM b),
    v AS (SELECT y, CASE WHEN y = 1 THEN (a1 - 1 - (a1p - 1) + 0.0) ELSE 0 END AS x, r1, r1y, r2, r2y FROM (SELECT y,
        rank() OVER (ORDER BY s1) + (count(*) OVER (PARTITION BY s1) - 1) / 2.0::DOUBLE AS r1, rank() OVER (PARTITION BY y ORDER BY s1) + (count(*) OVER (PARTITION BY y, s1) - 1) / 2.0::DOUBLE AS r1y,
        rank() OVER (ORDER BY s2) + (count(*) OVER (PARTITION BY s2) - 1) / 2.0::DOUBLE AS r2, rank() OVER (PARTITION BY y ORDER BY s2) + (count(*) OVER (PARTITION BY y, s2) - 1) / 2.0::DOUBLE AS r2y, 1 AS a1, 1 AS a1p FROM b)),
    pv AS (SELECT y, CASE WHEN y = 1 THEN (r1 - r1y) / n.n ELSE 1 - (r1 - r1y) / n.p END AS v1, CASE WHEN y = 1 THEN (r2 - r2y) / n.n ELSE 1 - (r2 - r2y) / n.p END AS v2 FROM v, n),
    c AS (SELECT avg(v1) FILTER (y = 1) AS auc1, avg(v2) FILTER (y = 1) AS auc2,
        var_samp(v1) FILTER (y = 1) / count(*) FILTER (y = 1) + var_samp(v1) FILTER (y = 0) / count(*) FILTER (y = 0) + var_samp(v2) FILTER (y = 1) / count(*) FILTER (y = 1) + var_samp(v2) FILTER (y = 0) / count(*) FILTER (y = 0)
        - 2 * (covar_samp(v1, v2) FILTER (y = 1) / count(*) FILTER (y = 1) + covar_samp(v1, v2) FILTER (y = 0) / count(*) FILTER (y = 0)) AS variance FROM pv)
    SELECT auc1, auc2, auc1 - auc2 AS diff, variance, (auc1 - auc2) / sqrt(variance) AS z, auc1 - auc2 - 1.959963984540054 * sqrt(variance) AS ci_lo, auc1 - auc2 + 1.959963984540054 * sqrt(variance) AS ci_hi FROM c""",
    "pool", rounds="auc1 auc2 diff variance z ci_lo ci_hi",
)
def _(s, d):
    return curves.delong(pool(s, d), "path_a", "prob")


_LEVELS = {"window": "pool", "trace": "(SELECT max(y) AS y, round(avg(prob), 12) AS prob, round(avg(path_a), 12) AS path_a, round(avg(path_b), 12) AS path_b, round(avg(path_c), 12) AS path_c FROM pool GROUP BY trace_id)"}


@query(
    "cur_14_delong_of_paths",
    " UNION ALL ".join(f"SELECT '{level}' AS level, '{p}' AS path, * FROM ({_delong_sql(rows, 'prob', p)})" for level, rows in _LEVELS.items() for p in ("path_a", "path_b", "path_c")),
    "pool", rounds="auc1 auc2 diff variance z ci_lo ci_hi",
)
def _(s, d):
    return curves.significance(ordering.cut(pool(s, d)), "prob", ["path_a", "path_b", "path_c"]).drop("p", "neg_log10_p")


@query("cur_14_significance", rounds="auc1 auc2 diff variance z ci_lo ci_hi p neg_log10_p")
def _(s, d):
    return curves.significance(ordering.cut(pool(s, d)), "prob", ["path_a", "path_b", "path_c"])


_FAM = """, f AS (SELECT DISTINCT family FROM pool WHERE y = 1), fr AS (SELECT family, y, prob AS score, row_number() OVER (PARTITION BY family ORDER BY md5(concat_ws(':', trace_id, w, 42))) AS r, trace_id, w FROM pool WHERE y = 1
    UNION ALL SELECT f.family, y, prob, r, trace_id, w FROM (SELECT y, prob, trace_id, w, row_number() OVER (ORDER BY md5(concat_ws(':', trace_id, w, 42))) AS r FROM pool WHERE y = 0) b, f),
    lim AS (SELECT family, least(count(CASE WHEN y = 1 THEN 1 END), count(CASE WHEN y = 0 THEN 1 END)) AS m FROM fr GROUP BY family)"""
_EVEN = """, ev AS (SELECT fr.* FROM fr JOIN lim USING (family) WHERE r <= m), st2 AS (SELECT family, score, sum(y) AS pos, sum(1 - y) AS neg FROM ev GROUP BY ALL),
    ap1 AS (SELECT family, sum(pos / p::DOUBLE * cp / (cp + cn)::DOUBLE) AS ap_1to1 FROM (SELECT family, pos, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY family) AS p FROM st2 WINDOW w AS (PARTITION BY family ORDER BY score DESC)) GROUP BY family)"""


@query(
    "cur_15_per_family",
    f"""{_FAM}{curve_sql('fr', 'family')}{_EVEN}, fx AS (SELECT family, 2 * count(CASE WHEN y = 1 AND score > {TAU} THEN 1 END) / (count(CASE WHEN score > {TAU} THEN 1 END) + count(CASE WHEN y = 1 THEN 1 END))::DOUBLE AS f1 FROM fr GROUP BY family)
    SELECT family, {AUC} AS auc, {AP} AS ap, any_value(ap_1to1) AS ap_1to1, any_value(fx.f1) AS f1, coalesce(max(CASE WHEN fpr <= 0.01 THEN tpr END), 0.0) AS tpr_fpr1, coalesce(max(CASE WHEN fpr <= 0.001 THEN tpr END), 0.0) AS tpr_fpr01,
    max(P) AS n_pos, max(N) AS n_neg FROM rates JOIN ap1 USING (family) JOIN fx USING (family) GROUP BY family""",
    "pool", rounds="auc ap ap_1to1 f1 tpr_fpr1 tpr_fpr01",
)
def _(s, d):
    return curves.per_family(ordering.cut(pool(s, d)), TAU, "prob")


_TAUS = {"path_a": 0.5001, "path_b": 0.9001, "path_c": 0.3301, "prob": TAU}


@query(
    "cur_16_compare_models",
    """, l AS (SELECT y, unnest(['path_a', 'path_b', 'path_c', 'prob']) AS model, unnest([path_a, path_b, path_c, prob]) AS score, unnest([0.5001, 0.9001, 0.3301, %s]::DOUBLE[]) AS tau FROM pool)%s,
    fx AS (SELECT model, 2 * count(CASE WHEN y = 1 AND score >= tau THEN 1 END) / (count(CASE WHEN score >= tau THEN 1 END) + count(CASE WHEN y = 1 THEN 1 END))::DOUBLE AS f1 FROM l GROUP BY model)
    SELECT model, %s AS auc, %s AS ap, max(rates.f1) AS best_f1, arg_max(score, struct_pack(f := rates.f1, s := -score)) AS best_tau, any_value(fx.f1) AS f1 FROM rates JOIN fx USING (model) GROUP BY model"""
    % (TAU, curve_sql("l", "model"), AUC, AP),
    "pool", rounds="auc ap best_f1 best_tau f1",
)
def _(s, d):
    return curves.compare_models(pool(s, d), list(_TAUS), _TAUS)


_RULES = """, t AS (SELECT trace_id, any_value(y) AS y, avg(prob) AS prob_mean, avg(CAST(prob >= 0.58013 AS INTEGER)) AS pos_rate, CAST(coalesce(max(run), 0) AS INTEGER) AS max_consecutive, CASE WHEN count(*) <= 24 THEN 'short' ELSE 'medium' END AS bucket FROM (
        SELECT *, CASE WHEN p THEN count(*) OVER (PARTITION BY trace_id, g, p ORDER BY w) ELSE 0 END AS run FROM (SELECT *, prob >= 0.58013 AS p, w - row_number() OVER (PARTITION BY trace_id, prob >= 0.58013 ORDER BY w) AS g FROM pool)) GROUP BY trace_id),
    q AS (SELECT unnest([0.50, 0.60, 0.70, 0.80, 0.85, 0.90, 0.92, 0.94, 0.95, 0.96, 0.97, 0.98, 0.99]) AS q),
    sz AS (SELECT bucket, count(CASE WHEN y = 0 THEN 1 END) AS benign, count(CASE WHEN y = 1 THEN 1 END) AS attack, max(max_consecutive) AS cap, list(prob_mean ORDER BY prob_mean) AS ps, list(pos_rate ORDER BY pos_rate) AS rs FROM t GROUP BY bucket),
    pc AS (SELECT DISTINCT bucket, ps[1 + CAST(floor(q * (len(ps) - 1)) AS INTEGER)] + (q * (len(ps) - 1) - floor(q * (len(ps) - 1))) * (ps[1 + CAST(ceil(q * (len(ps) - 1)) AS INTEGER)] - ps[1 + CAST(floor(q * (len(ps) - 1)) AS INTEGER)]) AS v FROM sz, q UNION SELECT bucket, 0.6::DOUBLE FROM sz),
    rc AS (SELECT DISTINCT bucket, rs[1 + CAST(floor(q * (len(rs) - 1)) AS INTEGER)] + (q * (len(rs) - 1) - floor(q * (len(rs) - 1))) * (rs[1 + CAST(ceil(q * (len(rs) - 1)) AS INTEGER)] - rs[1 + CAST(floor(q * (len(rs) - 1)) AS INTEGER)]) AS v FROM sz, q UNION SELECT bucket, 0.5::DOUBLE FROM sz),
    kc AS (SELECT DISTINCT bucket, k AS v FROM sz, (SELECT unnest([1, 2, 3, 4, 5, 6, 8, 10, 12]) AS k) WHERE k <= cap),
    rules AS (SELECT pc.bucket, pc.v AS p, rc.v AS r, kc.v AS k FROM pc JOIN rc USING (bucket) JOIN kc USING (bucket)),
    rated AS (SELECT rules.bucket, p, r, k, count(CASE WHEN y = 0 AND prob_mean >= p AND pos_rate >= r AND max_consecutive >= k THEN 1 END) / max(benign)::DOUBLE AS fpr,
        count(CASE WHEN y = 1 AND prob_mean >= p AND pos_rate >= r AND max_consecutive >= k THEN 1 END) / max(attack)::DOUBLE AS tpr FROM rules JOIN t USING (bucket) JOIN sz USING (bucket) GROUP BY ALL),
    pick AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY CASE WHEN fpr <= 0.1 THEN 0 ELSE 1 END, CASE WHEN fpr <= 0.1 THEN -tpr ELSE fpr END, CASE WHEN fpr <= 0.1 THEN fpr ELSE -tpr END, p, r, k) AS o FROM rated)
    SELECT bucket, benign, attack, CASE WHEN few THEN 'too_few_samples' WHEN fpr <= 0.1 THEN 'target_met' ELSE 'target_not_met' END AS status, CASE WHEN few THEN 0.6::DOUBLE ELSE p END AS min_prob, CASE WHEN few THEN 0.5::DOUBLE ELSE r END AS min_rate,
    CAST(CASE WHEN few THEN 3 ELSE k END AS INTEGER) AS min_run, CASE WHEN NOT few THEN fpr END AS fpr, CASE WHEN NOT few THEN tpr END AS tpr FROM (SELECT *, benign < 5 OR attack = 0 AS few FROM pick JOIN sz USING (bucket) WHERE o = 1)"""


@query("cur_19_calibrated_rules", _RULES, "pool", rounds="min_prob min_rate fpr tpr")
def _(s, d):
    from seqalert.operators import alerts

    rows = ordering.cut(pool(s, d).withColumn("positive", F.col("prob") >= TAU))
    per = rows.groupBy("trace_id").agg(
        F.max("y").alias("y"), F.avg("prob").alias("prob_mean"), F.avg(F.col("positive").cast("int")).alias("pos_rate"),
        F.when(F.count(F.lit(1)) <= 24, "short").otherwise("medium").alias("bucket"),
    )
    runs = alerts.longest_run(rows, "positive").select("trace_id", F.col("longest_run").cast("int").alias("max_consecutive"))
    defaults = {"short": (0.6, 0.5, 3), "medium": (0.6, 0.5, 3)}
    return curves.calibrate_rules(per.join(runs, "trace_id"), defaults, 0.1, 5)


@query("agg_06_trace_fraction", f"SELECT trace_id, avg(CAST(prob >= {TAU} AS INTEGER)) AS fraction, max(y) AS y, count(*) AS n_windows FROM pool GROUP BY trace_id", "pool", rounds="fraction")
def _(s, d):
    return pools.trace_fraction(pool(s, d), TAU)


@query(
    "agg_07_detection_rates",
    f""", t AS (SELECT family, trace_id, count(*) AS n, count(CASE WHEN prob > {TAU} THEN 1 END) AS flagged FROM pool WHERE y = 1 GROUP BY ALL)
    SELECT coalesce(family, 'TOTAL') AS family, count(*) AS n_traces, count(CASE WHEN flagged > 0 THEN 1 END) AS detected_traces, sum(n)::BIGINT AS total_windows, sum(flagged)::BIGINT AS flagged_windows,
    count(CASE WHEN flagged > 0 THEN 1 END) / count(*)::DOUBLE AS trace_dr, sum(flagged) / sum(n)::DOUBLE AS window_dr, quantile_cont(flagged / n::DOUBLE, 0.5) AS median_per_trace, quantile_cont(flagged / n::DOUBLE, 0.1) AS p10_per_trace,
    quantile_cont(flagged / n::DOUBLE, 0.9) AS p90_per_trace FROM t GROUP BY ROLLUP (family)""",
    "pool", rounds="trace_dr window_dr median_per_trace p10_per_trace p90_per_trace",
)
def _(s, d):
    return pools.detection_rates(pool(s, d).where(F.col("y") == 1), TAU)


@query("agg_08_trace_means", "SELECT trace_id, avg(prob) AS mean_score, max(y) AS y FROM pool GROUP BY trace_id", "pool", rounds="mean_score")
def _(s, d):
    return pools.trace_means(pool(s, d))


@query(
    "agg_09_decision_rules",
    f""", t AS (SELECT max(y) AS y, count(CASE WHEN prob >= {TAU} THEN 1 END) AS n, avg(CAST(prob >= {TAU} AS INTEGER)) AS r, avg(prob) AS m FROM pool GROUP BY trace_id),
    l AS (SELECT y, unnest(['single_threshold_any', 'count_2_positive', 'count_3_positive', 'fraction_30pct', 'fraction_60pct', 'mean_proba_ge_tau']) AS rule, unnest([n >= 1, n >= 2, n >= 3, r >= 0.3, r >= 0.6, m >= {TAU}]) AS f FROM t)
    SELECT rule, avg(CASE WHEN y = 1 THEN f::INTEGER END) AS episode_recall, avg(CASE WHEN y = 0 THEN f::INTEGER END) AS false_alert_rate FROM l GROUP BY rule""",
    "pool", rounds="episode_recall false_alert_rate",
)
def _(s, d):
    return pools.decision_rules(pool(s, d), TAU)


@query("agg_12_confusion", CONF.format(g="event_type,", extra="", src="SELECT *, value >= 20 AS p, CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 AS y FROM events"), rounds=CONF_COLS)
def _(s, d):
    y = F.get_json_object("props", "$.k").cast("int") % 2
    return curves.confusion(table(s, d, "events").withColumn("y", y), 20.0, ["event_type"], "value")


@query("agg_12_confusion_strict", CONF.format(g="", extra="", src=f"SELECT *, prob > {TAU} AS p FROM pool"), "pool", rounds=CONF_COLS)
def _(s, d):
    return curves.confusion(pool(s, d), TAU, score="prob", strict=True)


@query(
    "agg_13_score_description",
    """SELECT y, score, min(v) AS min, max(v) AS max, avg(v) AS mean, stddev_pop(v) AS std, max(v) - min(v) AS span FROM (
    SELECT y, unnest(['path_a', 'path_b', 'path_c']) AS score, unnest([path_a, path_b, path_c]) AS v FROM pool) GROUP BY y, score""",
    "pool", rounds="min max mean std span",
)
def _(s, d):
    return pools.describe_scores(pool(s, d), ["path_a", "path_b", "path_c"], ["y"])


@query(
    "agg_13_span_ratio",
    """SELECT greatest(max(path_a) - min(path_a), max(path_b) - min(path_b), max(path_c) - min(path_c)) / least(max(path_a) - min(path_a), max(path_b) - min(path_b), max(path_c) - min(path_c)) AS heterogeneity_ratio FROM pool""",
    "pool", rounds="heterogeneity_ratio",
)
def _(s, d):
    return pools.span_ratio(pool(s, d), ["path_a", "path_b", "path_c"])


def _pct(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE) / count(*) OVER () AS {c}"


@query(
    "agg_14_rank_correlation",
    f"""SELECT corr(path_a, path_b) AS corr_path_a_path_b, corr(path_a, path_c) AS corr_path_a_path_c, corr(path_b, path_c) AS corr_path_b_path_c FROM (
    SELECT {_pct('path_a')}, {_pct('path_b')}, {_pct('path_c')} FROM pool WHERE y = 0)""",
    "pool", rounds="corr_path_a_path_b corr_path_a_path_c corr_path_b_path_c",
)
def _(s, d):
    return pools.rank_correlation(pool(s, d))


@query(
    "agg_15_rescued",
    f"""SELECT count(CASE WHEN path_a < 0.90 AND (path_b > 0.95 OR path_c > 0.95) THEN 1 END) AS rescued, count(*) AS n FROM (SELECT {_pct('path_a')}, {_pct('path_b')}, {_pct('path_c')} FROM pool)""",
    "pool",
)
def _(s, d):
    return pools.rescue_count(pool(s, d), "path_a", ["path_b", "path_c"])


FLAGS = "SELECT y, CAST(path_a >= 0.55 AS INTEGER) AS fa, CAST(path_b >= 0.95 AS INTEGER) AS fb, CAST(path_c >= 0.38 AS INTEGER) AS fc FROM pool"


def _flags(s, d):
    f = lambda c, v: (F.col(c) >= v).cast("int")
    return pool(s, d).select("y", f("path_a", 0.55).alias("fa"), f("path_b", 0.95).alias("fb"), f("path_c", 0.38).alias("fc"))


@query(
    "agg_16_patterns",
    f"SELECT CAST(p AS INTEGER) AS pattern, coalesce(n, 0) AS n, coalesce(n, 0) / (SELECT count(*) FROM pool)::DOUBLE AS share FROM (SELECT unnest(range(0, 8)) AS p) LEFT JOIN (SELECT 4 * fa + 2 * fb + fc AS k, count(*) AS n FROM ({FLAGS}) GROUP BY 1) ON k = p",
    "pool", rounds="share",
)
def _(s, d):
    return pools.patterns(_flags(s, d))


@query(
    "agg_16_pattern_summary",
    f""", f AS ({FLAGS}), a AS (SELECT count(*) AS n_total, count(CASE WHEN fa + fb + fc > 0 THEN 1 END) AS total_detected, count(CASE WHEN fa + fb + fc = 0 THEN 1 END) AS none_detected, count(CASE WHEN fa + fb + fc = 3 THEN 1 END) AS all_three,
    count(CASE WHEN fa + fb + fc >= 2 THEN 1 END) AS at_least_two, count(CASE WHEN fa = 0 AND fb + fc > 0 THEN 1 END) AS first_missed_others_caught, avg(fa) AS p_a, avg(fb) AS p_b, avg(fc) AS p_c FROM f),
    e AS (SELECT *, (p_a * p_b * (1 - p_c) + p_a * (1 - p_b) * p_c + (1 - p_a) * p_b * p_c + p_a * p_b * p_c) * n_total AS expected_at_least_two FROM a)
    SELECT *, at_least_two / greatest(expected_at_least_two, 1) AS observed_vs_expected FROM e""",
    "pool", rounds="p_a p_b p_c expected_at_least_two observed_vs_expected",
)
def _(s, d):
    return pools.pattern_summary(_flags(s, d))


@query(
    "agg_17_path_recall",
    """, t AS (SELECT quantile_cont(path_a, 0.95) AS a, quantile_cont(path_b, 0.95) AS b, quantile_cont(path_c, 0.95) AS c FROM pool WHERE y = 0),
    f AS (SELECT CASE WHEN y = 1 THEN family ELSE 'BENIGN' END AS family, CAST(path_a >= a AS INTEGER) AS fa, CAST(path_b >= b AS INTEGER) AS fb, CAST(path_c >= c AS INTEGER) AS fc FROM pool, t)
    SELECT family, count(*) AS n_windows, avg(fa) AS rate_path_a, avg(fb) AS rate_path_b, avg(fc) AS rate_path_c, avg(greatest(fa, fb, fc)) AS rate_any, 1 - avg(greatest(fa, fb, fc)) AS missed_by_all FROM f GROUP BY family""",
    "pool", rounds="rate_path_a rate_path_b rate_path_c rate_any missed_by_all",
)
def _(s, d):
    p = ordering.cut(pool(s, d))
    return pools.path_recall(p, sampling.pool_thresholds(p, ["path_a", "path_b", "path_c"]))


@query(
    "agg_18_fold_summary",
    """SELECT event_type, metric, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max, count(*) AS n FROM (
    SELECT event_type, unnest(['value', 'inverse']) AS metric, unnest([value, CASE WHEN value <= 1 THEN NULL ELSE 1 / value END]) AS v FROM events) WHERE v IS NOT NULL GROUP BY event_type, metric""",
    rounds="mean std min max",
)
def _(s, d):
    inverse = F.when(F.col("value") <= 1, float("nan")).otherwise(1 / F.col("value"))
    return sampling.fold_summary(table(s, d, "events").withColumn("inverse", inverse), ["value", "inverse"], ["event_type"])


@query("agg_24_majority", "SELECT o_custkey, o_orderpriority, n FROM (SELECT o_custkey, o_orderpriority, count(*) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY o_custkey, o_orderpriority) WHERE r = 1")
def _(s, d):
    return pools.majority(table(s, d, "orders"), "o_orderpriority", ["o_custkey"])


@query("agg_25_class_weight", f"SELECT count(CASE WHEN y = 0 THEN 1 END) / greatest(1, count(CASE WHEN y = 1 THEN 1 END))::DOUBLE AS weight FROM ({LABELLED})", rounds="weight")
def _(s, d):
    return pools.class_weight(labelled(s, d))


@query(
    "agg_26_histogram",
    f""", lab AS ({LABELLED}), b AS (SELECT quantile_cont(score, 0.99) AS hi, min(score) AS lo FROM lab), h AS (SELECT y, CAST(least(19, floor((score - lo) / ((hi - lo) / 20))) AS INTEGER) AS bin, (hi - lo) / 20 AS width FROM lab, b WHERE score <= hi)
    SELECT y, bin, count(*) AS n, count(*) / (sum(count(*)) OVER (PARTITION BY y) * any_value(width)) AS density FROM h GROUP BY y, bin""",
    rounds="density",
)
def _(s, d):
    return curves.histogram(labelled(s, d), "score", 20)


_SWEEP = """, c AS (SELECT p_brand AS model, p_type || '/' || p_partkey AS config, p_retailprice AS auc, CAST(p_size AS DOUBLE) AS f1 FROM part), n AS (SELECT *,
    coalesce((auc - min(auc) OVER w) / nullif(max(auc) OVER w - min(auc) OVER w, 0), 0) + coalesce((f1 - min(f1) OVER w) / nullif(max(f1) OVER w - min(f1) OVER w, 0), 0) AS balance FROM c WINDOW w AS (PARTITION BY model))"""


def _sweep(s, d):
    p = table(s, d, "part")
    return p.select(F.col("p_brand").alias("model"), F.concat_ws("/", "p_type", "p_partkey").alias("config"), F.col("p_retailprice").alias("auc"), F.col("p_size").cast("double").alias("f1"))


@query("agg_27_best_balance", _SWEEP + "SELECT model, config, auc, f1, balance FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY balance DESC, config) AS r FROM n) WHERE r = 1", rounds="balance")
def _(s, d):
    return pools.best_balance(_sweep(s, d))


@query("top_05_best_model", _SWEEP + "SELECT config AS model, auc, f1 FROM c ORDER BY auc DESC, f1 DESC, config LIMIT 1")
def _(s, d):
    return pools.best_model(_sweep(s, d).select(F.col("config").alias("model"), "auc", "f1"))


@query("agg_28_macro_average", "SELECT avg(dr) AS dr, avg(m) AS m FROM (SELECT family, avg(CAST(prob > 0.58013 AS INTEGER)) AS dr, avg(prob) AS m FROM pool WHERE y = 1 GROUP BY family)", "pool", rounds="dr m")
def _(s, d):
    per = pool(s, d).where(F.col("y") == 1).groupBy("family").agg(F.avg((F.col("prob") > TAU).cast("int")).alias("dr"), F.avg("prob").alias("m"))
    return pools.macro_average(per, ["dr", "m"])


@query(
    "agg_29_ppv",
    f""", t AS (SELECT max(y) AS y, avg(CAST(prob >= {TAU} AS INTEGER)) >= 0.5 AS p FROM pool GROUP BY trace_id), r AS (SELECT count(CASE WHEN p AND y = 1 THEN 1 END) / (count(CASE WHEN y = 1 THEN 1 END) + 1e-8) AS tpr,
    count(CASE WHEN p AND y = 0 THEN 1 END) / (count(CASE WHEN y = 0 THEN 1 END) + 1e-8) AS fpr FROM t)
    SELECT tpr, fpr, b AS base_rate, tpr * b / (tpr * b + fpr * (1 - b) + 1e-8) AS ppv FROM r, (SELECT unnest([0.01, 0.001]::DOUBLE[]) AS b)""",
    "pool", rounds="tpr fpr ppv",
)
def _(s, d):
    return pools.ppv(pools.trace_fraction(pool(s, d), TAU), 0.5)


@query("top_01_top_tokens", "SELECT token, n FROM (SELECT token, count(*) AS n FROM tok GROUP BY token) ORDER BY n DESC, token LIMIT 10", "tok")
def _(s, d):
    from seqalert.operators import windows as win

    return win.top_tokens(win.token_counts(ev_tokens(s, d)), 10)
