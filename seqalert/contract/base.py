"""Registry of queries with their check SQL, and the driver tables as traces, windows, scores and episodes."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqalert.functions.columns import with_status
from seqalert.operators import windows as win
from seqalert.operators.alerts import Policy
from seqalert.operators.episodes import build_segments, resolve_onset
from seqalert.session import ensure_checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

TAU = 0.58013
POLICY = Policy(
    warmup=3, rolling=5, tau=TAU, trigger_mean=0.59007, trigger_rate=0.59, trigger_consecutive=3, clear_mean=0.57501, clear_rate=0.33
)
HOLD_POLICY = Policy(
    warmup=3, rolling=5, tau=TAU, trigger_mean=0.57007, trigger_rate=0.39, trigger_consecutive=2, clear_mean=0.59501, clear_rate=0.61, hold=4
)

# Named parts of the check SQL, in the order they depend on each other.
CTES = {
    "tok": """SELECT CAST(user_id AS VARCHAR) AS trace_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
        CAST(json_extract_string(props, '$.k') AS INTEGER) AS token, event_type FROM events""",
    "seq": "SELECT trace_id, list(token ORDER BY pos) AS seq FROM tok GROUP BY trace_id",
    "win": """SELECT trace_id, CAST(i AS BIGINT) AS w, seq[2 * i + 1 : 2 * i + 20] AS win FROM (
        SELECT trace_id, seq, unnest(range(0, (len(seq) - 20) // 2 + 1)) AS i FROM seq WHERE len(seq) >= 20)""",
    "ltok": """SELECT CAST(l_suppkey AS VARCHAR) AS trace_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey,
        l_linenumber, l_partkey) - 1 AS pos, CAST(l_partkey % 341 AS INTEGER) AS token FROM lineitem""",
    "meta": """SELECT trace_id, length, CAST(CASE WHEN first_type = 'error' THEN 1 ELSE 0 END AS INTEGER) AS y,
        CASE WHEN first_type = 'error' THEN 'fam_' || last_type END AS family,
        CASE WHEN first_type = 'error' THEN 'attack' WHEN first_type IN ('click', 'purchase') THEN 'train' ELSE 'val' END AS split FROM (
        SELECT CAST(user_id AS VARCHAR) AS trace_id, count(*) AS length, arg_min(event_type, ts) AS first_type, arg_max(event_type, ts) AS last_type
        FROM events GROUP BY user_id)""",
    "pool": """SELECT trace_id, w, family, y, split, path_a, path_b, path_c, (path_a + path_b + path_c) / 3.0::DOUBLE AS prob FROM (
        SELECT win.trace_id, w, family, y, split, list_sum(win) / 1980.0::DOUBLE AS path_a, len(list_distinct(win)) / 20.0::DOUBLE AS path_b,
        list_sum(list_transform(range(1, 20), lambda i: abs(win[i + 1] - win[i]))) / 1881.0::DOUBLE AS path_c FROM win JOIN meta USING (trace_id))""",
    "nw": "SELECT trace_id, count(*) AS n_windows FROM win GROUP BY trace_id",
    # Ground truth of the event traces: half of the families have their own onset.
    "onset": """SELECT * FROM (VALUES ('fam_click', 0.2::DOUBLE, 0.9::DOUBLE), ('fam_error', 0.3::DOUBLE, 0.7::DOUBLE), (NULL, 0.25::DOUBLE, 0.8::DOUBLE)) t(family, o, e)""",
    "epi": """SELECT meta.trace_id AS episode_id, 'scores/' || meta.trace_id AS score_file, 'src/' || meta.trace_id AS source_file, n_windows,
        CASE WHEN y = 1 THEN 'malware_targeted' ELSE 'benign_control' END AS intended_label, meta.family AS attack_family,
        CASE WHEN y = 1 THEN coalesce(o.o, d.o) ELSE 0.1::DOUBLE END AS onset_fraction, CASE WHEN y = 1 THEN coalesce(o.e, d.e) ELSE 0.9::DOUBLE END AS end_fraction,
        o.o IS NOT NULL AS override_used
        FROM meta JOIN nw USING (trace_id) LEFT JOIN onset o ON o.family = meta.family CROSS JOIN (SELECT * FROM onset WHERE family IS NULL) d""",
    "att": """SELECT *, CASE WHEN intended_label <> 'malware_targeted' THEN NULL WHEN n_windows = 1 THEN 0 ELSE s END AS attack_start,
        CASE WHEN intended_label <> 'malware_targeted' THEN NULL WHEN n_windows = 1 THEN 0 ELSE least(n_windows - 1, greatest(s, e0)) END AS attack_end FROM (
        SELECT *, least(n_windows - 1, greatest(1, CAST(floor(n_windows * onset_fraction) AS BIGINT))) AS s, CAST(floor(n_windows * end_fraction) AS BIGINT) - 1 AS e0 FROM epi)""",
    "roll": f"""SELECT *, avg(prob) OVER f AS rolling_mean, avg(CAST(positive AS INTEGER)) OVER f AS rolling_rate, coalesce(max(full3) OVER g, 0) = 1 AS rolling_run FROM (
        SELECT *, CASE WHEN sum(CAST(positive AS INTEGER)) OVER (PARTITION BY trace_id ORDER BY w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 3 THEN 1 ELSE 0 END AS full3
        FROM (SELECT *, prob >= {TAU} AS positive FROM pool))
        WINDOW f AS (PARTITION BY trace_id ORDER BY w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), g AS (PARTITION BY trace_id ORDER BY w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "alerts": """SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS alert FROM (
        SELECT *, CASE WHEN w + 1 >= 3 AND rolling_mean >= 0.59007 AND rolling_rate >= 0.59 AND rolling_run THEN 1
        WHEN rolling_mean <= 0.57501 AND rolling_rate <= 0.33 THEN 0 END AS ev FROM roll)""",
    "segs": """SELECT trace_id, min(w) AS start_w, max(w) AS end_w FROM (SELECT trace_id, w, w - row_number() OVER (PARTITION BY trace_id ORDER BY w) AS g
        FROM alerts WHERE alert) GROUP BY trace_id, g""",
    "res": """SELECT r.*, (has_attack_segment AND delay IS NOT NULL AND delay <= 5) AS within5, (has_attack_segment AND delay IS NOT NULL AND delay <= 10) AS within10,
        (has_attack_segment AND delay IS NOT NULL AND delay <= 20) AS within20,
        CASE WHEN has_attack_segment THEN before > 0 ELSE total > 0 END AS had_false FROM (
        SELECT a.episode_id, a.score_file, a.attack_family, a.intended_label, count(*) AS n_windows, a.intended_label = 'malware_targeted' AS has_attack_segment,
        a.attack_start, a.attack_end, min(CASE WHEN alert THEN w END) AS first_alert, min(CASE WHEN alert AND inside THEN w END) AS first_inside,
        min(CASE WHEN alert AND inside THEN w END) - a.attack_start AS delay,
        count(CASE WHEN alert AND inside THEN 1 END) AS inside_n, count(CASE WHEN alert AND w < a.attack_start THEN 1 END) AS before,
        count(CASE WHEN alert AND w > a.attack_end THEN 1 END) AS after, count(CASE WHEN alert THEN 1 END) AS total, count(CASE WHEN inside THEN 1 END) AS attack_n,
        (SELECT count(*) FROM segs s WHERE s.trace_id = a.episode_id) AS n_segs,
        (SELECT count(*) FROM segs s WHERE s.trace_id = a.episode_id AND s.end_w < a.attack_start) AS segs_before,
        CASE WHEN a.attack_end < max(w) THEN CASE WHEN NOT bool_or(alert AND w = a.attack_end) THEN 0
            ELSE coalesce(min(CASE WHEN NOT alert AND w > a.attack_end THEN w END), max(w) + 1) - a.attack_end - 1 END END AS recovery
        FROM att a JOIN (SELECT alerts.*, coalesce(w BETWEEN t.attack_start AND t.attack_end, false) AS inside FROM alerts JOIN att t ON t.episode_id = alerts.trace_id) x
        ON x.trace_id = a.episode_id GROUP BY a.episode_id, a.score_file, a.attack_family, a.intended_label, a.attack_start, a.attack_end) r""",
    # Call-number tables made of the parts: one per part type.
    "amap": """SELECT abi, name, number, row_number() OVER (PARTITION BY abi, name ORDER BY k) - 1 AS ord, common, anchor FROM (
        SELECT lower(p_type) AS abi, replace(p_name, ' ', '_') || '_' || replace(p_brand, '#', '') AS name, CAST(p_partkey % 341 AS INTEGER) AS number, min(p_partkey) AS k,
        bool_or(p_size <= 15) AS common, bool_or(p_size > 40) AS anchor FROM part GROUP BY 1, 2, 3)""",
    "pnames": "SELECT abi, number, min(name) AS name, bool_or(common) AS common, bool_or(anchor) AS anchor FROM amap GROUP BY abi, number",
    "pnums": "SELECT abi, name, arg_min(number, ord) AS number FROM amap GROUP BY abi, name",
}
NEEDS = {
    "tok": [], "seq": ["tok"], "win": ["seq"], "ltok": [], "meta": [], "pool": ["win", "meta"], "nw": ["win"], "onset": [],
    "epi": ["meta", "nw", "onset"], "att": ["epi"], "roll": ["pool"], "alerts": ["roll"], "segs": ["alerts"], "res": ["segs", "att"],
    "amap": [], "pnames": ["amap"], "pnums": ["amap"],
}


def sql(body: str, *ctes: str) -> str:
    """SQL text with the named parts in front; a body that starts with a comma adds parts of its own."""
    need: list[str] = []

    def visit(name: str) -> None:
        for n in NEEDS[name]:
            visit(n)
        if name not in need:
            need.append(name)

    for c in ctes:
        visit(c)
    body = body.strip()
    if not need:
        return ("WITH " + body[1:]) if body.startswith(",") else body
    parts = ", ".join(f"{n} AS ({CTES[n]})" for n in need)
    return f"WITH {parts}{'' if body.startswith(',') else ' '}{body}"


def query(name: str, text: str | None = None, *ctes: str, rounds: str = "", places: int = 6):
    """Register a query; columns in ``rounds`` are rounded on both sides before they are compared."""

    def add(fn: Query) -> Query:
        cols = rounds.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            # Adding 0.0 turns a negative zero into zero.
            return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in cols}) if cols else df

        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = run
        if text is not None:
            full = sql(text, *ctes)
            if cols:
                full = f"SELECT * REPLACE ({', '.join(f'round({c}, {places}) + 0.0::DOUBLE AS {c}' for c in cols)}) FROM ({full})"
            ORACLE[name] = full
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/run-{uuid.uuid4().hex}"


def ev_tokens(spark: SparkSession, d: str) -> DataFrame:
    token = F.get_json_object("props", "$.k").cast("int")
    return win.tokens_from(table(spark, d, "events"), "user_id", ["ts", "event_id"], token)


def ev_names(spark: SparkSession, d: str) -> DataFrame:
    return win.tokens_from(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


def li_tokens(spark: SparkSession, d: str) -> DataFrame:
    token = (F.col("l_partkey") % 341).cast("int")
    return win.tokens_from(table(spark, d, "lineitem"), "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], token)


def ev_windows(spark: SparkSession, d: str) -> DataFrame:
    return win.sliding_windows(ev_tokens(spark, d))


def li_windows(spark: SparkSession, d: str) -> DataFrame:
    return win.sliding_windows(li_tokens(spark, d))


def meta(spark: SparkSession, d: str) -> DataFrame:
    """Label, family, split and length of every event trace: a trace is an attack when it starts with an error."""
    at = F.struct("ts", "event_id")
    per = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("trace_id")).agg(
        F.count(F.lit(1)).alias("length"), F.min_by("event_type", at).alias("_first"), F.max_by("event_type", at).alias("_last")
    )
    attack = F.col("_first") == "error"
    return per.select(
        "trace_id", "length", F.when(attack, 1).otherwise(0).alias("y"), F.when(attack, F.concat(F.lit("fam_"), "_last")).alias("family"),
        F.when(attack, "attack").when(F.col("_first").isin("click", "purchase"), "train").otherwise("val").alias("split"),
    )


def scored(windows: DataFrame) -> DataFrame:
    total = F.aggregate("win", F.lit(0), lambda a, x: a + x)
    jumps = F.expr("aggregate(sequence(2, size(win)), 0, (a, i) -> a + abs(element_at(win, i) - element_at(win, i - 1)))")
    out = windows.withColumns({"path_a": total / 1980.0, "path_b": F.size(F.array_distinct("win")) / 20.0, "path_c": jumps / 1881.0})
    return out.withColumn("prob", (F.col("path_a") + F.col("path_b") + F.col("path_c")) / 3.0)


def pool(spark: SparkSession, d: str) -> DataFrame:
    """Scored windows of the event traces with label, family and split."""
    rows = scored(ev_windows(spark, d)).join(meta(spark, d), "trace_id")
    return rows.select("trace_id", "w", "family", "y", "split", "path_a", "path_b", "path_c", "prob")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Event rows as binary scores with many ties: is the event an error, scored by its value."""
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), "event_type", (F.col("event_type") == "error").cast("int").alias("y"), F.col("value").alias("score"))


LABELLED = "SELECT event_id AS id, event_type, CAST(event_type = 'error' AS INTEGER) AS y, value AS score FROM events"


def onset(spark: SparkSession) -> DataFrame:
    rows = [("fam_click", 0.2, 0.9), ("fam_error", 0.3, 0.7), (None, 0.25, 0.8)]
    return spark.createDataFrame(rows, "family string, onset double, end double")


def raw_episodes(spark: SparkSession, d: str) -> DataFrame:
    return with_status(meta(spark, d), 20, 2).where(F.col("n_windows") > 0).select(
        F.col("trace_id").alias("episode_id"), F.concat(F.lit("scores/"), "trace_id").alias("score_file"),
        F.concat(F.lit("src/"), "trace_id").alias("source_file"), "n_windows",
        F.when(F.col("y") == 1, "malware_targeted").otherwise("benign_control").alias("intended_label"), F.col("family").alias("attack_family"),
    )


def episodes(spark: SparkSession, d: str) -> DataFrame:
    return build_segments(resolve_onset(raw_episodes(spark, d), onset(spark), (0.1, 0.9)))


def abi_map(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    p = table(spark, d, "part")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.replace("p_brand", F.lit("#"), F.lit("")))
    one = p.groupBy(F.lower("p_type").alias("abi"), name.alias("name"), (F.col("p_partkey") % 341).cast("int").alias("number")).agg(
        F.min("p_partkey").alias("_k"), F.max(F.col("p_size") <= 15).alias("common"), F.max(F.col("p_size") > 40).alias("anchor")
    )
    # At most 341 numbers per name.
    place = F.row_number().over(Window.partitionBy("abi", "name").orderBy("_k")) - 1
    return one.select("abi", "name", "number", place.alias("ord"), "common", "anchor")
