"""Windows, tokens, sets, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqalert.contract.base import (
    HOLD_POLICY, POLICY, TAU, ev_tokens, ev_windows, li_tokens, meta, pool, query, table,
)
from seqalert.functions import columns as C
from seqalert.operators import alerts, curves, episodes, windows as win


def text(col: str):
    return F.array_join(col, ",").alias(col)


@query("src_11_tokens_from", "SELECT trace_id, pos, token FROM ltok", "ltok")
def _(s, d):
    return li_tokens(s, d)


@query("win_01_sliding_windows", "SELECT trace_id, w, array_to_string(win, ',') AS win FROM win", "win")
def _(s, d):
    return ev_windows(s, d).select("trace_id", "w", text("win"))


@query(
    "win_01_windows_of_long_traces",
    """, lwin AS (SELECT trace_id, CAST(i AS BIGINT) AS w, seq[2 * i + 1 : 2 * i + 20] AS win FROM (SELECT trace_id, seq, unnest(range(0, (len(seq) - 20) // 2 + 1)) AS i
    FROM (SELECT trace_id, list(token ORDER BY pos) AS seq FROM ltok GROUP BY trace_id) WHERE len(seq) >= 20))
    SELECT trace_id, count(*) AS n, CAST(sum(list_sum(win)) AS BIGINT) AS token_sum, CAST(sum(w * win[1]) AS BIGINT) AS position_sum FROM lwin GROUP BY trace_id""",
    "ltok",
)
def _(s, d):
    rows = win.sliding_windows(li_tokens(s, d), size=256)
    total = F.aggregate("win", F.lit(0), lambda a, x: a + x)
    return rows.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("token_sum"), F.sum(F.col("w") * F.col("win")[0]).alias("position_sum"))


@query(
    "win_02_window_cap",
    """SELECT trace_id, w FROM (SELECT trace_id, w, row_number() OVER (PARTITION BY trace_id ORDER BY md5(concat_ws(':', trace_id, w, 42))) AS r FROM win) WHERE r <= 20""",
    "win",
)
def _(s, d):
    return win.cap_windows(ev_windows(s, d), 20).select("trace_id", "w")


@query("win_03_rolling_mean", "SELECT trace_id, w, rolling_mean FROM roll", "roll", rounds="rolling_mean")
def _(s, d):
    return alerts.rolling(pool(s, d), 5, TAU, 3).select("trace_id", "w", "rolling_mean")


@query("win_04_rolling_rate", "SELECT trace_id, w, positive, rolling_rate FROM roll", "roll", rounds="rolling_rate")
def _(s, d):
    return alerts.rolling(pool(s, d), 5, TAU, 3).select("trace_id", "w", "positive", "rolling_rate")


@query("win_05_rolling_run", "SELECT trace_id, w, rolling_run FROM roll", "roll")
def _(s, d):
    return alerts.rolling(pool(s, d), 5, TAU, 3, size=16).select("trace_id", "w", "rolling_run")


@query("win_06_alert_timeline", "SELECT trace_id, w, alert FROM alerts", "alerts")
def _(s, d):
    return alerts.alert_timeline(pool(s, d), POLICY, size=16).select("trace_id", "w", "alert")


@query(
    "win_06_alert_timeline_with_hold",
    f""", r2 AS (SELECT trace_id, w, avg(prob) OVER f AS m, avg(CAST(positive AS INTEGER)) OVER f AS r,
        max(CASE WHEN positive AND prev AND w >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) = 1 AS run
        FROM (SELECT *, coalesce(lag(positive) OVER (PARTITION BY trace_id ORDER BY w), false) AS prev FROM (SELECT *, prob >= {TAU} AS positive FROM pool))
        WINDOW f AS (PARTITION BY trace_id ORDER BY w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
    ev AS (SELECT trace_id, list(w + 1 >= 3 AND m >= 0.57007 AND r >= 0.39 AND run ORDER BY w) AS st, list(m <= 0.59501 AND r <= 0.61 ORDER BY w) AS en, count(*) AS n FROM r2 GROUP BY trace_id),
    steps AS (SELECT trace_id, st, en, n, 0::BIGINT AS w, CASE WHEN st[1] THEN 4 ELSE 0 END AS state FROM ev),
    walk AS (SELECT e.trace_id, list_reduce(list_prepend([0], list_transform(range(1, e.n + 1), lambda i: [CASE WHEN e.st[i] THEN 1 ELSE 0 END + CASE WHEN e.en[i] THEN 2 ELSE 0 END])),
        lambda acc, x: list_append(acc, CASE WHEN acc[-1] = 0 THEN CASE WHEN x[1] % 2 = 1 THEN 4 ELSE 0 END WHEN acc[-1] > 1 THEN acc[-1] - 1 WHEN x[1] >= 2 THEN 0 ELSE 1 END)) AS states, e.n FROM ev e)
    SELECT trace_id, CAST(i AS BIGINT) AS w, states[i + 2] > 0 AS alert FROM (SELECT trace_id, states, unnest(range(0, n)) AS i FROM walk)""",
    "pool",
)
def _(s, d):
    return alerts.alert_timeline(pool(s, d), HOLD_POLICY, size=16).select("trace_id", "w", "alert")


@query("win_07_segments", "SELECT trace_id, start_w, end_w FROM segs", "segs")
def _(s, d):
    return alerts.segments(alerts.alert_timeline(pool(s, d), POLICY), "alert", size=8)


@query(
    "win_08_longest_run",
    """SELECT nw.trace_id, coalesce(max(end_w - start_w + 1), 0) AS longest_run FROM nw LEFT JOIN segs ON segs.trace_id = nw.trace_id GROUP BY nw.trace_id""",
    "segs", "nw",
)
def _(s, d):
    return alerts.longest_run(alerts.alert_timeline(pool(s, d), POLICY), "alert")


@query(
    "win_09_rank_percentile",
    """SELECT trace_id, w, (rank() OVER (ORDER BY path_a) + (count(*) OVER (PARTITION BY path_a) - 1) / 2.0::DOUBLE) / count(*) OVER () AS path_a_pct FROM pool""",
    "pool", rounds="path_a_pct",
)
def _(s, d):
    return curves.rank_percentile(pool(s, d), ["path_a"], task_rows=300).select("trace_id", "w", "path_a_pct")


@query("win_10_length_strata", "SELECT trace_id, n_windows, CAST(ntile(7) OVER (ORDER BY n_windows, trace_id) AS INTEGER) AS stratum FROM nw", "nw")
def _(s, d):
    return win.length_strata(ev_windows(s, d), 7)


@query(
    "win_14_context_pairs",
    """SELECT trace_id, w, CAST(i AS INTEGER) AS i, array_to_string(list_concat(win[i - 4 : i], win[i + 2 : i + 6]), ',') AS context, win[i + 1] AS target
    FROM (SELECT *, unnest(range(5, 15)) AS i FROM win)""",
    "win",
)
def _(s, d):
    return win.context_pairs(ev_windows(s, d)).select("trace_id", "w", "i", text("context"), "target")


@query("win_15_next_pairs", "SELECT trace_id, w, array_to_string(win[1:19], ',') AS input, array_to_string(win[2:20], ',') AS target FROM win", "win")
def _(s, d):
    return win.next_pairs(ev_windows(s, d)).select("trace_id", "w", text("input"), text("target"))


@query("agg_01_token_counts", "SELECT token, count(*) AS n FROM tok GROUP BY token", "tok")
def _(s, d):
    return win.token_counts(ev_tokens(s, d))


@query("agg_01_corpus_size", "SELECT count(DISTINCT trace_id) AS files, count(*) AS tokens FROM tok", "tok")
def _(s, d):
    return win.corpus_size(ev_tokens(s, d))


BIGRAMS = "SELECT win[i] AS a, win[i + 1] AS b FROM (SELECT win, unnest(range(1, 20)) AS i FROM win)"


@query("agg_02_bigram_counts", f"SELECT a, b, count(*) AS n FROM ({BIGRAMS}) GROUP BY a, b", "win")
def _(s, d):
    return win.bigram_counts(ev_windows(s, d))


@query(
    "agg_03_transitions",
    """SELECT array_to_string(state, ',') AS state, nxt, n, n / sum(n) OVER (PARTITION BY state) AS p FROM (
    SELECT win[i : i + 1] AS state, win[i + 2] AS nxt, count(*) AS n FROM (SELECT win, unnest(range(1, 19)) AS i FROM win) GROUP BY 1, 2)""",
    "win", rounds="p",
)
def _(s, d):
    return win.transitions(ev_windows(s, d), 2).select(text("state"), "nxt", "n", "p")


@query(
    "agg_04_census",
    "SELECT split, count(*) AS windows, count(DISTINCT trace_id) AS traces, count(DISTINCT family) AS families FROM win JOIN meta USING (trace_id) GROUP BY split",
    "win", "meta",
)
def _(s, d):
    return win.census(ev_windows(s, d).join(meta(s, d), "trace_id"))


@query(
    "agg_05_attrition",
    """SELECT coalesce(split, 'ALL') AS split, count(*) AS traces, count(CASE WHEN length < 60 THEN 1 END) AS too_short,
    count(CASE WHEN length < 60 THEN 1 END) / count(*)::DOUBLE AS attrition FROM meta GROUP BY ROLLUP (split)""",
    "meta", rounds="attrition",
)
def _(s, d):
    return win.attrition(meta(s, d), 60)


@query("top_07_vocabulary", """SELECT gram, n, CAST(row_number() OVER (ORDER BY n DESC, gram) - 1 AS INTEGER) AS idx FROM (SELECT a || ' ' || b AS gram, count(*) AS n FROM (%s) GROUP BY 1) ORDER BY n DESC, gram LIMIT 50""" % BIGRAMS, "win")
def _(s, d):
    grams = win.bigram_counts(ev_windows(s, d)).select(F.concat_ws(" ", "a", "b").alias("gram"), "n")
    return win.vocabulary(grams, 50)


@query("set_01_stack", "SELECT id, y, score FROM (%s)" % "SELECT event_id AS id, CAST(event_type = 'error' AS INTEGER) AS y, value AS score FROM events")
def _(s, d):
    e = table(s, d, "events")
    part = lambda cond, y: C.with_label(e.where(cond).select(F.col("event_id").alias("id"), F.col("value").alias("score")), y)
    return part(F.col("event_type") != "error", 0).unionByName(part(F.col("event_type") == "error", 1)).select("id", "y", "score")


@query("set_02_leakage", "SELECT count(CASE WHEN n > 1 THEN 1 END) AS shared, count(*) AS traces FROM (SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY user_id)")
def _(s, d):
    return win.leakage(table(s, d, "events").select(F.col("user_id").alias("trace_id"), F.col("event_type").alias("split")))


@query("set_03_first_by_key", "SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def _(s, d):
    e = table(s, d, "events").select("event_id", "user_id", "ts", "event_type")
    rows = episodes.first_by_key(e, F.struct("user_id", "event_type"), [F.col("ts"), F.col("event_id")])
    return rows.select("event_id", "user_id", "ts")


@query(
    "set_04_token_drift",
    """, a AS (SELECT token, count(*) / (SELECT count(*) FROM tok)::DOUBLE AS s FROM tok GROUP BY token), b AS (SELECT token, count(*) / (SELECT count(*) FROM ltok)::DOUBLE AS s FROM ltok GROUP BY token)
    SELECT token, coalesce(a.s, 0) AS share_a, coalesce(b.s, 0) AS share_b, CASE WHEN b.s IS NULL THEN 'only_a' WHEN a.s IS NULL THEN 'only_b' ELSE 'both' END AS seen FROM a FULL JOIN b USING (token)""",
    "tok", "ltok", rounds="share_a share_b",
)
def _(s, d):
    return win.token_drift(ev_tokens(s, d), li_tokens(s, d))


@query("scf_01_label", "SELECT event_id, CAST(event_type = 'error' AS INTEGER) AS y FROM events")
def _(s, d):
    e = table(s, d, "events")
    benign, attack = e.where(F.col("event_type") != "error"), e.where(F.col("event_type") == "error")
    return C.with_label(benign, 0).unionByName(C.with_label(attack, 1)).select("event_id", "y")


@query("scf_02_flag", "SELECT event_id, value >= coalesce(CASE WHEN event_type = 'click' THEN 20.0 END, 0.5) AS positive FROM events")
def _(s, d):
    e = table(s, d, "events").withColumn("tau", F.when(F.col("event_type") == "click", 20.0))
    return C.flag(e, prob="value").select("event_id", "positive")


@query(
    "scf_03_trace_status",
    "SELECT trace_id, CASE WHEN length >= 70 THEN (length - 70) // 2 + 1 ELSE 0 END AS n_windows, CASE WHEN length < 70 THEN 'too_short_for_window_70' ELSE 'ok' END AS status FROM meta",
    "meta",
)
def _(s, d):
    return C.with_status(meta(s, d), 70, 2).select("trace_id", "n_windows", "status")


@query(
    "scf_04_usable_scores",
    """SELECT count(*) AS total, count(CASE WHEN length < 60 THEN 1 END) AS skipped_too_short, count(CASE WHEN length >= 60 AND split = 'val' THEN 1 END) AS unmatched FROM meta""",
    "meta",
)
def _(s, d):
    m = C.with_status(meta(s, d), 60, 2)
    scores = m.select(F.concat(F.lit("Data\\Run/"), "trace_id", F.lit(".txt")).alias("file"), "n_windows")
    manifest = m.where(F.col("split") != "val").select(
        F.col("trace_id").alias("sample_id"), F.lit("benign_control").alias("intended_label"), F.lit(None).cast("string").alias("target_preset"),
        F.concat(F.lit("data/run/"), "trace_id", F.lit(".TXT")).alias("source_file"), F.lit(None).cast("string").alias("expected_detect_file"),
    )
    return episodes.usable_scores(scores, manifest)[1]


@query("scf_05_safe_casts", "SELECT doc_id, coalesce(try_cast(substr(text, 1, 1) AS INTEGER), -1) AS head, coalesce(try_cast(n_chars AS DOUBLE), 0.0) AS n FROM documents")
def _(s, d):
    t = table(s, d, "documents")
    return t.select("doc_id", C.safe_cast(F.substring("text", 1, 1), "int", -1).alias("head"), C.safe_cast(F.col("n_chars"), "double", 0.0).alias("n"))


@query(
    "scf_06_binary_label",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN true WHEN event_type = 'view' THEN false WHEN event_type = 'click' THEN true WHEN event_type = 'signup' THEN false END AS is_attack FROM events""",
)
def _(s, d):
    kind = F.col("event_type")
    e = table(s, d, "events").withColumn("verdict", F.when(kind == "error", " Malware").when(kind == "view", "NORMAL ").when(kind == "purchase", "?"))
    e = e.withColumn("is_malware", F.when(kind == "click", 1).when(kind == "signup", 0))
    return e.select("event_id", C.binary_label(e, ["verdict"]).alias("is_attack"))


@query("scf_07_length_bucket", "SELECT trace_id, CASE WHEN n_windows < 18 THEN 'too_short' WHEN n_windows <= 22 THEN 'short' WHEN n_windows <= 28 THEN 'medium' ELSE 'long' END AS bucket FROM nw", "nw")
def _(s, d):
    n = ev_windows(s, d).groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("trace_id", C.length_bucket(F.col("n"), 18, 22, 28).alias("bucket"))


@query(
    "scf_08_family_rules",
    """SELECT p_partkey, CASE WHEN contains(p_name, 'red') THEN 'Red' WHEN contains(p_name, 'small') THEN 'Small' WHEN contains(p_name, 'ring') THEN 'Ring' ELSE 'Other-Exploit' END AS family FROM part""",
)
def _(s, d):
    rules = [("red", "Red"), ("small", "Small"), ("ring", "Ring")]
    return table(s, d, "part").select("p_partkey", C.family_from_name(F.col("p_name"), rules).alias("family"))


@query("scf_09_oov_flag", "SELECT trace_id, avg(CAST(token > 89 AS INTEGER)) AS oov_rate, avg(CAST(token > 89 AS INTEGER)) > 0.1 AS high_oov FROM tok GROUP BY trace_id", "tok", rounds="oov_rate")
def _(s, d):
    rate = ev_tokens(s, d).groupBy("trace_id").agg(F.avg((F.col("token") > 89).cast("int")).alias("oov_rate"))
    return C.oov_flag(rate)


@query("scf_10_normalized_ids", "SELECT trace_id, w, win[1] / (SELECT max(list_max(win)) FROM win)::DOUBLE AS first, list_sum(win) / (SELECT max(list_max(win)) FROM win)::DOUBLE AS total FROM win", "win", rounds="first total")
def _(s, d):
    n = C.normalize_ids(ev_windows(s, d))
    return n.select("trace_id", "w", F.col("win")[0].alias("first"), F.aggregate("win", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(
    "scf_11_sanitized_scores",
    """, m AS (SELECT max(value) AS top FROM events WHERE event_type IN ('error', 'view')) SELECT event_id, CASE event_type WHEN 'click' THEN (SELECT top FROM m) WHEN 'purchase' THEN -(SELECT top FROM m) WHEN 'signup' THEN 0.0 ELSE value END AS score FROM events""",
    rounds="score",
)
def _(s, d):
    kind = F.col("event_type")
    score = F.when(kind == "click", float("inf")).when(kind == "purchase", float("-inf")).when(kind == "signup", float("nan")).otherwise(F.col("value"))
    return C.sanitize(table(s, d, "events").select("event_id", score.alias("score")))


@query("scf_12_trace_key", "SELECT split || '/' || trace_id AS k, count(*) AS n FROM win JOIN meta USING (trace_id) GROUP BY 1", "win", "meta")
def _(s, d):
    rows = ev_windows(s, d).join(meta(s, d), "trace_id")
    rows = rows.groupBy(C.trace_key(F.col("split"), F.col("trace_id")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.concat_ws("/", "k.split", "k.trace_id").alias("k"), "n")


@query(
    "scf_14_normalized_abi",
    """SELECT doc_id, CASE lang WHEN 'en' THEN 'x86_64' WHEN 'fr' THEN 'arm64_asm_generic' END AS abi FROM documents""",
)
def _(s, d):
    from seqalert.operators import abi

    raw = F.when(F.col("lang") == "en", " AMD64 ").when(F.col("lang") == "fr", "arm64/asm generic").otherwise(F.concat(F.lit("vax-"), "lang"))
    raw = F.when(F.col("lang") == "fr", "AArch64").otherwise(raw)
    return table(s, d, "documents").select("doc_id", abi.normalize_abi(raw).alias("abi"))


@query(
    "fn_01_strings",
    r"""SELECT page_id, lower(replace(replace(url, '/', '\'), '\', '/')) AS path, regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
    len(regexp_extract_all(url, '([0-9]+)')) AS numbers, starts_with(url, 'https') AS secure, split_part(url, '/', 3) AS host FROM pages""",
)
def _(s, d):
    url = F.col("url")
    back = F.replace(url, F.lit("/"), F.lit("\\"))
    return table(s, d, "pages").select(
        "page_id", C.canonical_path(back).alias("path"), C.slug(url).alias("slug"), F.size(F.regexp_extract_all(url, F.lit("([0-9]+)"))).cast("bigint").alias("numbers"),
        F.startswith(url, F.lit("https")).alias("secure"), F.split_part(url, F.lit("/"), F.lit(3)).alias("host"),
    )


@query(
    "fn_02_direction",
    """, t AS (SELECT page_id, regexp_extract_all(url, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+') AS t FROM pages)
    SELECT page_id, CASE WHEN len(t) = 0 THEN NULL WHEN len(list_filter(t, lambda x: regexp_full_match(x, '[0-9]+'))) = len(t) THEN 'number_to_name'
    WHEN len(list_filter(t, lambda x: regexp_full_match(x, '[0-9]+'))) = 0 THEN 'name_to_number' END AS direction FROM t""",
)
def _(s, d):
    t = F.regexp_extract_all("url", F.lit("([A-Za-z_][A-Za-z0-9_]*|[0-9]+)"))
    return table(s, d, "pages").select("page_id", t.alias("t")).select("page_id", C.direction(F.col("t")).alias("direction"))


@query(
    "fn_04_math",
    """SELECT event_id, ln(1 + value) AS log1, sqrt(value) AS root, exp(-value / 100) AS decay, floor(value) AS whole, round(value / 7, 4) AS part, greatest(5.0, least(40.0, value)) AS clamped FROM events""",
    rounds="log1 root decay whole part clamped",
)
def _(s, d):
    v = F.col("value")
    return table(s, d, "events").select(
        "event_id", F.log(1 + v).alias("log1"), F.sqrt(v).alias("root"), F.exp(-v / 100).alias("decay"), F.floor(v).cast("double").alias("whole"),
        F.round(v / 7, 4).alias("part"), F.greatest(F.lit(5.0), F.least(F.lit(40.0), v)).alias("clamped"),
    )


@query(
    "fn_05_ratios",
    """SELECT user_id, CASE WHEN c = 0 THEN NULL ELSE e / c END AS safe, e / (c + 1e-8) AS eps FROM (SELECT user_id, count(CASE WHEN event_type = 'error' THEN 1 END)::DOUBLE AS e,
    count(CASE WHEN event_type = 'click' AND value > 90 THEN 1 END)::DOUBLE AS c FROM events GROUP BY user_id)""",
    rounds="safe eps", places=4,
)
def _(s, d):
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("double")
    kind = F.col("event_type")
    g = table(s, d, "events").groupBy("user_id").agg(n(kind == "error").alias("e"), n((kind == "click") & (F.col("value") > 90)).alias("c"))
    return g.select("user_id", C.safe_ratio(F.col("e"), F.col("c")).alias("safe"), C.eps_ratio(F.col("e"), F.col("c")).alias("eps"))


@query(
    "fn_06_arrays",
    """SELECT trace_id, w, len(win) AS n, list_sum(win[1:5])::BIGINT AS head, list_position(win, list_max(win))::INTEGER - 1 AS argmax, len(list_distinct(win)) AS uniq,
    len(list_distinct(list_transform(range(1, 20), lambda i: win[i : i + 1]))) AS bigrams FROM win""",
    "win",
)
def _(s, d):
    pairs = F.transform(F.sequence(F.lit(1), F.lit(19)), lambda i: F.slice("win", i, 2))
    long = lambda c: c.cast("bigint")
    return ev_windows(s, d).select(
        "trace_id", "w", long(F.size("win")).alias("n"), long(F.aggregate(F.slice("win", 1, 5), F.lit(0), lambda a, x: a + x)).alias("head"),
        (F.array_position("win", F.array_max("win")) - 1).cast("int").alias("argmax"), long(F.size(F.array_distinct("win"))).alias("uniq"),
        long(F.size(F.array_distinct(pairs))).alias("bigrams"),
    )


@query(
    "fn_07_maps",
    """SELECT trace_id, w, string_agg(k || ':' || n, ',' ORDER BY k) AS counts FROM (SELECT trace_id, w, t AS k, count(*) AS n FROM (SELECT trace_id, w, unnest(win) AS t FROM win) GROUP BY ALL) GROUP BY trace_id, w""",
    "win",
)
def _(s, d):
    m = ev_windows(s, d).select("trace_id", "w", F.map_entries(C.count_map(F.col("win"))).alias("m"))
    return m.select("trace_id", "w", F.array_join(F.transform("m", lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("counts"))


@query(
    "fn_08_json",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, '{"id":' || event_id || ',"kind":"' || event_type || '"}' AS packed FROM events""",
)
def _(s, d):
    e = table(s, d, "events").withColumn("_j", F.from_json("props", "k int"))
    return e.select("event_id", F.col("_j.k").alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("packed"))
