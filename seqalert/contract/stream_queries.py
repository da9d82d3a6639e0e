"""Streams over files written from the events, run to the end and compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqalert.contract.base import POLICY, episodes, ev_tokens, ev_windows, meta, pool, query, scratch, table
from seqalert.contract.model_queries import MARKOV, train_windows
from seqalert.operators import episodes as E, ordering
from seqalert.scorers.chronology import Markov
from seqalert.streaming import streams as S



#: Second of the replay's first position; the test events have no time per window, so a position is a second.
START = 946_684_800


def _source(s, df, schema, parts=3, order="pos"):
    """A table as a folder of files that arrive one after the other, in ``order``, and a row that ends the stream."""
    path = scratch(s)
    # Stored first: the bounds of the ranges are looked up in a pass of their own.
    rows = ordering.cut(df.select(*[f.strip().split(" ")[0] for f in schema.split(",")]))
    rows.repartitionByRange(parts, order).write.parquet(path)
    S.write_end(s, path, schema)
    return S.token_stream(s, path, schema, max_files=1)


def _tokens(s, d):
    clocked = ev_tokens(s, d).withColumn("ts", F.timestamp_seconds(F.col("pos") + START))
    return _source(s, clocked, "trace_id string, pos bigint, token int, ts timestamp")


def _run(s, stream):
    path = scratch(s)
    # The state of these tables is small: one partition a core.
    return S.run_to_table(stream, f"{path}/out", f"{path}/state", s.sparkContext.defaultParallelism)


@query("str_01_token_stream", "SELECT trace_id, pos, token FROM tok", "tok")
def _(s, d):
    return _run(s, _tokens(s, d)).where("trace_id is not null").select("trace_id", "pos", "token")


@query("str_02_window_stream", "SELECT trace_id, w, array_to_string(win, ',') AS win FROM win", "win")
def _(s, d):
    out = _run(s, S.window_stream(_tokens(s, d)))
    return out.where(~F.col("late")).select("trace_id", "w", F.array_join("win", ",").alias("win"))


@query("str_03_scored_stream", MARKOV + "SELECT trace_id, w, -sum(coalesce(lp, -10)) / 19 AS score FROM bg LEFT JOIN md ON md.a = bg.a AND md.b = bg.b GROUP BY trace_id, w", "win", "meta", rounds="score")
def _(s, d):
    model = Markov(1).fit(train_windows(s, d))
    src = scratch(s)
    ev_windows(s, d).select("trace_id", "w", "win").repartitionByRange(3, "w").write.parquet(src)
    stream = S.token_stream(s, src, "trace_id string, w bigint, win array<int>", max_files=1)
    path = scratch(s)
    return S.score_batches(stream, model, f"{path}/out", f"{path}/state").select("trace_id", "w", "score")


def _scores(s, d):
    clocked = pool(s, d).withColumn("ts", F.timestamp_seconds(F.col("w") + START))
    return _source(s, clocked, "trace_id string, w bigint, prob double, ts timestamp", order="w")


@query("str_04_alert_stream", "SELECT trace_id, w, alert FROM alerts", "alerts")
def _(s, d):
    return _run(s, S.alert_stream(_scores(s, d), POLICY)).select("trace_id", "w", "alert")


@query(
    "str_05_episode_stream",
    "SELECT episode_id AS trace_id, n_windows, first_alert, first_inside, before, inside_n AS inside, after, total, n_segs AS segments FROM res", "res",
)
def _(s, d):
    known = ordering.cut(episodes(s, d))
    truth = ordering.cut(E.attack_ranges(known).select(F.col("episode_id").alias("trace_id"), "attack_start", "attack_end", F.col("n_windows").alias("expected")))
    closed = _run(s, S.episode_stream(_scores(s, d).join(truth, "trace_id", "left"), POLICY))
    return S.whole_episodes(closed, truth).drop("attack_start", "attack_end")


@query(
    "str_06_ordered_stream",
    "SELECT CAST(user_id AS VARCHAR) AS trace_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, false AS late FROM events",
)
def _(s, d):
    e = table(s, d, "events").select(F.col("user_id").cast("string").alias("trace_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("int").alias("token"))
    # A row's file is chosen by a hash, so every file holds rows that belong before those of the files before it.
    stream = _source(s, e, "trace_id string, ts timestamp, id bigint, token int", order=F.xxhash64("id"))
    span = e.agg((F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))).alias("s")).head()["s"] or 0
    return _run(s, S.ordered(stream, delay=span + 1)).select("trace_id", "id", "pos", "late")


@query(
    "str_07_stream_metrics",
    "SELECT trace_id, count(*) AS windows, count(CASE WHEN alert THEN 1 END) AS alert_windows, coalesce(any_value(n), 0) AS alerts FROM alerts LEFT JOIN (SELECT trace_id AS t, count(*) AS n FROM segs GROUP BY 1) ON t = trace_id GROUP BY trace_id",
    "segs",
)
def _(s, d):
    path = scratch(s)
    S.metrics_sink(S.alert_stream(_scores(s, d), POLICY), f"{path}/metrics", f"{path}/state", partitions=s.sparkContext.defaultParallelism).awaitTermination()
    return S.read_metrics(s, f"{path}/metrics")
