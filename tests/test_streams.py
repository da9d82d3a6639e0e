"""Streams against the batch operators, with shuffled arrival, several batches and late rows."""

import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from seqalert.operators import alerts, ordering, windows as win
from seqalert.operators.alerts import Policy
from seqalert.scorers.chronology import Markov
from seqalert.streaming import streams as S

POLICY = Policy(tau=0.5, rolling=3, warmup=2, trigger_mean=0.6, trigger_rate=0.6, trigger_consecutive=2, clear_mean=0.45, clear_rate=0.34, hold=2)


TOKENS, SCORES = "trace_id string, pos bigint, token int, ts timestamp", "trace_id string, w bigint, prob double, ts timestamp"


def clock(second):
    return datetime(2000, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=second)


def write_batches(spark, batches, schema, path, end=True):
    """A file for each batch, one second apart, so that they arrive in order, and the row that ends the stream."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    if end:
        S.write_end(spark, path, schema)


def dealt(rows, n):
    return [rows[i::n] for i in range(n)]


def run(spark, src, schema, step, tmp_path, name="run"):
    stream = step(S.token_stream(spark, src, schema, max_files=1))
    return S.run_to_table(stream, str(tmp_path / name / "out"), str(tmp_path / name / "state")).cache()


def states(spark, tmp_path, name="run"):
    return spark.read.format("statestore").option("path", str(tmp_path / name / "state")).option("stateVarName", "state").load().count()


@pytest.fixture(scope="module")
def tokens():
    rng = random.Random(8)
    return [(t, p, rng.randrange(9)) for t, n in (("a", 70), ("b", 20), ("c", 5), ("d", 41)) for p in range(n)]


@pytest.mark.parametrize("size", [16, 4096])
def test_windows_do_not_depend_on_arrival(spark, tokens, tmp_path, size):
    rows = [(*r, clock(r[1])) for r in tokens]
    random.Random(1).shuffle(rows)
    src = str(tmp_path / "src")
    # One token arrives a second time; one trace has a gap that nothing fills.
    write_batches(spark, [*dealt(rows, 3), [rows[0], ("gap", 0, 1, clock(0)), ("gap", 2, 1, clock(2))]], TOKENS, src)
    out = run(spark, src, TOKENS, lambda stream: S.window_stream(stream, size=size), tmp_path)
    batch = win.sliding_windows(spark.createDataFrame(tokens, "trace_id string, pos bigint, token int"))
    got = out.where(~F.col("late")).select("trace_id", "w", "win")
    assert got.exceptAll(batch).count() == 0 and got.count() == batch.count() > 0
    assert sorted((r["trace_id"], r["pos"]) for r in out.where("late").collect()) == sorted([rows[0][:2], ("gap", 2)])
    assert states(spark, tmp_path) == 0


def test_state_stays_while_a_trace_goes_on(spark, tokens, tmp_path):
    src = str(tmp_path / "src")
    write_batches(spark, [[(*r, clock(r[1])) for r in tokens]], TOKENS, src, end=False)
    run(spark, src, TOKENS, S.window_stream, tmp_path)
    assert states(spark, tmp_path) == 4


def test_alerts_and_metrics(spark, tmp_path):
    rng = random.Random(4)
    rows = [(t, w, rng.random(), clock(w)) for t, n in (("a", 90), ("b", 2), ("c", 40)) for w in range(n)]
    arrival = sorted(rows, key=lambda r: (r[1] + rng.random() * 6))
    src = str(tmp_path / "src")
    write_batches(spark, [*dealt(arrival, 3), [("d", 1, 0.5, clock(1))]], SCORES, src)
    out = run(spark, src, SCORES, lambda stream: S.alert_stream(stream, POLICY), tmp_path)
    batch = alerts.alert_timeline(spark.createDataFrame(rows, SCORES).drop("ts"), POLICY).cache()
    a, b = out.where("trace_id <> 'd'").select("trace_id", "w", "alert"), batch.select("trace_id", "w", "alert")
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()
    assert [tuple(r) for r in out.where("trace_id = 'd'").collect()] == [("d", 1, 0.5, None, "stranded")]
    opened = batch.where("alert and not was_alert").count()
    assert out.where("event = 'open'").count() == opened and states(spark, tmp_path) == 0
    S.metrics_sink(S.alert_stream(S.token_stream(spark, src, SCORES, max_files=1).where("trace_id <> 'd' or trace_id is null"), POLICY), str(tmp_path / "m"), str(tmp_path / "ms")).awaitTermination()
    total = S.read_metrics(spark, str(tmp_path / "m")).agg(F.sum("windows").alias("w"), F.sum("alerts").alias("a")).head()
    assert (total["w"], total["a"]) == (len(rows), opened)


ROWS = "trace_id string, ts timestamp, id bigint, token int"


def test_overlapping_files_are_ordered(spark, tmp_path):
    rng = random.Random(2)
    rows = [(t, clock(rng.randrange(500)), i, i % 7) for i, t in enumerate(rng.choices("abc", k=200))]
    src = str(tmp_path / "src")
    write_batches(spark, dealt(rows, 3), ROWS, src)
    got = run(spark, src, ROWS, lambda stream: S.ordered(stream, delay=600), tmp_path)
    want = sorted((t, n, i) for t in "abc" for n, (_, i) in enumerate(sorted((ts, i) for u, ts, i, _ in rows if u == t)))
    assert sorted((r["trace_id"], r["pos"], r["id"]) for r in got.collect()) == want
    assert got.where("late").count() == 0 and states(spark, tmp_path) == 0


def test_ordering_marks_late_rows(spark, tmp_path):
    src = str(tmp_path / "src")
    row = lambda minute, i, token: ("a", clock(60 * minute), i, token)
    # The fourth batch finds minute 5 numbered: 3 is behind it, 8 is not, and 5 comes again.
    write_batches(spark, [[row(5, 2, 7), row(1, 1, 6)], [row(10, 3, 8)], [row(20, 4, 8)], [row(3, 9, 1), row(8, 5, None), row(5, 2, 7)]], ROWS, src)
    got = {(r["id"], r["pos"], r["late"]) for r in run(spark, src, ROWS, lambda stream: S.ordered(stream, delay=60), tmp_path).collect()}
    assert got == {(1, 0, False), (2, 1, False), (2, None, True), (5, 2, False), (3, 3, False), (4, 4, False), (9, None, True)}
    assert states(spark, tmp_path) == 0


def test_scored_batches_equal_the_table(spark, tokens, tmp_path):
    w = ordering.cut(win.sliding_windows(spark.createDataFrame(tokens, "trace_id string, pos bigint, token int")))
    w.repartition(3).write.parquet(str(tmp_path / "src"))
    model = Markov(2).fit(w.where("trace_id = 'a'"))
    stream = S.token_stream(spark, str(tmp_path / "src"), "trace_id string, w bigint, win array<int>", max_files=1)
    a = model.score(w).select("trace_id", "w", F.round("score", 9).alias("s"))
    b = S.score_batches(stream, model, str(tmp_path / "out"), str(tmp_path / "state")).select("trace_id", "w", F.round("score", 9).alias("s"))
    assert a.count() == b.count() > 0 and a.exceptAll(b).count() == 0


TRUTH = "trace_id string, attack_start bigint, attack_end bigint, expected bigint"


def episodes_of(spark, tmp_path, batches, known, gap=5):
    src = str(tmp_path / "src")
    write_batches(spark, batches, SCORES, src)
    known = spark.createDataFrame(known, TRUTH)
    return run(spark, src, SCORES, lambda stream: S.episode_stream(stream.join(known, "trace_id", "left"), POLICY, gap=gap), tmp_path), known


def test_episodes_close_by_event_time(spark, tmp_path):
    """Later windows come in later batches; an episode closes when the stream's clock, not the wall clock, has passed it."""
    of = lambda t, ws: [(t, w, 0.9, clock(w)) for w in ws]
    out, known = episodes_of(spark, tmp_path, [of("a", range(4)) + of("b", range(3)), of("c", range(2)), of("a", range(4, 8))], [("a", 1, 5, 8), ("b", None, None, 3), ("c", None, None, 2)])
    got = S.whole_episodes(out, known)
    assert sorted((r["trace_id"], r["n_windows"], r["segments"]) for r in got.collect()) == [("a", 8, 1), ("b", 3, 1), ("c", 2, 1)]
    assert "missing" not in got.columns and states(spark, tmp_path) == 0


def test_a_part_of_an_episode_is_an_error(spark, tmp_path):
    rows = [(t, w, 0.9, clock(w)) for t in "ab" for w in range(6) if (t, w) != ("a", 3)]
    out, known = episodes_of(spark, tmp_path, [rows], [("a", None, None, 6), ("b", None, None, 6), ("c", None, None, 1)])
    assert sorted((r["trace_id"], r["n_windows"], r["missing"]) for r in out.collect()) == [("a", 3, 3), ("b", 6, 0)]
    with pytest.raises(RuntimeError, match=r"2 episodes are not whole: a \(3 windows missing\), c \(never closed\)"):
        S.whole_episodes(out, known)
    with pytest.raises(RuntimeError, match="closed twice"):
        S.whole_episodes(out.where("trace_id = 'b'").union(out.where("trace_id = 'b'")), known.where("trace_id = 'b'"))


def test_missing_windows_are_counted_without_a_known_number(spark, tmp_path):
    out, _ = episodes_of(spark, tmp_path, [[("a", w, 0.1, clock(w)) for w in (0, 1, 4)]], [("x", None, None, None)])
    assert [(r["trace_id"], r["n_windows"], r["missing"]) for r in out.collect()] == [("a", 2, 3)]


def test_episode_query_returns_no_part(spark, sf, monkeypatch):
    """A stream that loses an episode, and one that fails."""
    from seqalert.contract import stream_queries
    from seqalert.contract.base import QUERIES

    whole = S.episode_stream
    monkeypatch.setattr(stream_queries.S, "episode_stream", lambda stream, policy: whole(stream.where("trace_id is null or trace_id not like '%1'"), policy))
    with pytest.raises(RuntimeError, match="never closed"):
        QUERIES["str_05_episode_stream"](spark, sf)
    monkeypatch.setattr(stream_queries.S, "episode_stream", lambda stream, policy: whole(stream.withColumn("prob", F.raise_error(F.lit("broken")).cast("double")), policy))
    with pytest.raises(Exception, match="broken"):
        QUERIES["str_05_episode_stream"](spark, sf)


def test_processor_takes_rows_without_data_frames():
    from pyspark.sql import Row

    class Value:
        held = None

        def get(self):
            return self.held

        def update(self, held):
            self.held = held

    class Handle:
        value = Value()

        def getValueState(self, name, schema):
            return self.value

        def registerTimer(self, at):
            pass

    class Clock:
        def getCurrentWatermarkInMs(self):
            return 0

    order = S._Order(0, 60)
    order.init(Handle())
    came = [Row(us=5, id=2, token=None), Row(us=3, id=1, token=7)]
    out = list(order.handleInputRows(("a",), iter(came), Clock()))
    assert [tuple(r) for r in out] == [("a", 3, 1, 7, 0, False), ("a", 5, 2, None, 1, False)]
    assert list(out[0].asDict()) == list(S._Order.names)
