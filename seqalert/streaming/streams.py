"""Structured Streaming forms of windowing, scoring, alerting and episode results.

Every stateful step is one processor and one query; the next step reads the table the step before wrote. State is
keyed by trace, or by trace and chunk where the result does not depend on one running state.

State ends by event time. A trace that has been silent for ``gap`` of the stream's own clock is over: its state goes, and
what it still holds comes out. Spark drops rows behind its watermark before a processor sees them, so its watermark is kept
``KEEP`` behind, and the processors take the rest off: their clock is the largest time seen less ``delay``. No row is lost for being
late; each step says which rows came too late for it. A stream over files that are all there ends with a row without trace
and a late time (``write_end``), which moves the clock past everything."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from seqalert.operators.alerts import Policy
from seqalert.operators.windows import PACK
from seqalert.scorers.chronology import UNSEEN, Markov

#: How far Spark's watermark stays behind the largest time seen; no row older than that is read.
KEEP = "3650 days"
_KEEP_MS = 3650 * 86_400_000
#: A trace silent for so many seconds of its own clock is over.
GAP = 86_400


@contextmanager
def state_store(spark: SparkSession, partitions: int | None = None):
    """Queries started inside keep their state in the store that timers need, in so many ``partitions`` (the session's number of shuffle partitions if
    None). A query keeps the number that it was first started with; every partition is opened and stored in every batch."""
    settings = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)


class Timed(StatefulProcessor):
    """One record of state per key and one timer; ``delay`` and ``gap`` are seconds. The record starts with the last time seen and
    the timer's time, both in microseconds of the processor's clock. A batch has few rows of a key and many keys, so rows come and go
    as tuples: a data frame per key costs more than all else."""

    fields = ""
    #: Names of the columns that come out.
    names: tuple[str, ...] = ()

    def __init__(self, delay: float, gap: float) -> None:
        self.delay, self.gap = round(delay * 1_000_000), round(gap * 1_000_000)

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"seen bigint, timer bigint, {self.fields}")

    def close(self) -> None:
        pass

    def clock(self, timers) -> int:
        return (timers.getCurrentWatermarkInMs() + _KEEP_MS) * 1000 - self.delay

    def alarm(self, us: int) -> int:
        return max(1, -(-(us + self.delay) // 1000) - _KEEP_MS + 1)

    def load(self) -> tuple[int, int | None, tuple | None]:
        held = self.state.get()
        if held is None:
            return -(1 << 62), None, None
        seen, timer, *rest = held
        return seen, timer, tuple(rest)

    def store(self, seen: int, timer: int | None, due: int, rest: tuple) -> None:
        """Keep ``rest`` and have the timer go off at ``due``."""
        if timer is None or due < timer:
            if timer is not None:
                self.handle.deleteTimer(self.alarm(timer))
            self.handle.registerTimer(self.alarm(due))
            timer = due
        self.state.update((int(seen), int(timer), *rest))

    def handleInputRows(self, key, rows, timerValues):
        came = list(rows)
        if key[0] is None or not came:
            return
        seen, timer, rest = self.load()
        seen = max(seen, max(r["us"] for r in came))
        yield from self.told(self.rows(key, came, seen, timer, rest, self.clock(timerValues)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        seen, timer, rest = self.load()
        if rest is None:
            return
        now = self.clock(timerValues)
        if timer is not None and timer <= now:
            timer = None
        if now >= seen + self.gap:
            out = self.over(key, rest)
            self.state.clear()
            if timer is not None:
                self.handle.deleteTimer(self.alarm(timer))
        else:
            out = self.due(key, seen, timer, rest, now)
        yield from self.told(out)

    def told(self, out: list[tuple]) -> Iterator[Row]:
        row = Row(*self.names)
        return (row(*values) for values in out)

    def rows(self, key, came: list[Row], seen: int, timer: int | None, rest: tuple | None, now: int) -> list[tuple]:
        """What the rows of a batch bring out; ends with ``store``."""
        raise NotImplementedError

    def due(self, key, seen: int, timer: int | None, rest: tuple, now: int) -> list[tuple]:
        """What comes out when the timer goes off before the trace is over."""
        self.store(seen, timer, seen + self.gap, rest)
        return []

    def over(self, key, rest: tuple) -> list[tuple]:
        """What comes out when the trace is over."""
        return []


def _apply(stream: DataFrame, keys: list[str], processor: Timed, output: str) -> DataFrame:
    slim = stream.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return slim.groupBy(*keys).transformWithState(processor, output, "Append", "EventTime")


def _clocked(stream: DataFrame) -> DataFrame:
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", KEEP)


def write_end(spark: SparkSession, path: str, schema: str, at: str = "2200-01-01 00:00:00") -> None:
    """End the stream over the folder ``path``: one more file, newer than all others, with a row without trace at the late time ``at``."""
    time.sleep(1.1)  # some file systems keep whole seconds
    row = spark.createDataFrame([(0,)], "_at int").select(F.to_timestamp(F.lit(at)).alias("ts"))
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    types = [f.strip().split(" ", 1)[1] for f in schema.split(",")]
    row.select(*[F.col("ts") if n == "ts" else F.lit(None).cast(t).alias(n) for n, t in zip(names, types)]).write.mode("append").parquet(path)


def token_stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", max_files: int = 100) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files).load(path)


class _Order(Timed):
    """Numbers the rows of a trace. Rows wait, sorted, until the clock has passed them."""

    fields = "pos bigint, last_us bigint, last_id bigint, wait_us array<bigint>, wait_id array<bigint>, wait_token array<int>"
    names = ("trace_id", "us", "id", "token", "pos", "late")

    def rows(self, key, came, seen, timer, rest, now):
        pos, last_us, last_id, *waiting = rest or (0, -(1 << 62), -(1 << 62), [], [], [])
        held, out = dict(zip(zip(waiting[0], waiting[1]), waiting[2])), []
        for us, i, token in ((r["us"], r["id"], r["token"]) for r in came):
            if (us, i) <= (last_us, last_id) or (us, i) in held:
                out.append((key[0], us, i, token, None, True))
            else:
                held[us, i] = token
        return self.released(key, seen, timer, (pos, last_us, last_id), held, now, out)

    def due(self, key, seen, timer, rest, now):
        return self.released(key, seen, timer, rest[:3], dict(zip(zip(rest[3], rest[4]), rest[5])), now, [])

    def released(self, key, seen, timer, last, held, now, out):
        pos, last_us, last_id = last
        ready = sorted(k for k in held if k[0] <= now)
        for us, i in ready:
            out.append((key[0], us, i, held.pop((us, i)), pos, False))
            pos, last_us, last_id = pos + 1, us, i
        wait = sorted(held)
        rest = (pos, last_us, last_id, [k[0] for k in wait], [k[1] for k in wait], [held[k] for k in wait])
        self.store(seen, timer, wait[0][0] if wait else seen + self.gap, rest)
        return out

    def over(self, key, rest):
        pos, _, _, us, ids, tokens = rest
        return [(key[0], u, i, t, pos + n, False) for n, (u, i, t) in enumerate(zip(us, ids, tokens))]


def ordered(stream: DataFrame, delay: float = 3600, gap: float = 365 * 86_400) -> DataFrame:
    """Number the rows ``(trace_id, ts, id, token)`` of each trace in the order of ``(ts, id)``, however files overlap: a row waits
    ``delay`` seconds of the stream's clock for earlier ones. Rows behind the last numbered row, and repeated ``(ts, id)``, come out with ``late`` and no
    position. A trace silent for ``gap`` seconds is over; if it goes on, its positions begin again."""
    slim = _clocked(stream.select("trace_id", "ts", F.col("id").cast("bigint").alias("id"), F.col("token").cast("int").alias("token")))
    out = _apply(slim, ["trace_id"], _Order(delay, gap), "trace_id string, us bigint, id bigint, token int, pos bigint, late boolean")
    return out.select("trace_id", F.timestamp_micros("us").alias("ts"), "id", "token", "pos", "late")


class _Windows(Timed):
    fields = "nxt bigint, tail array<int>, wait_pos array<bigint>, wait_token array<int>"
    names = ("trace_id", "w", "win", "pos", "late")

    def __init__(self, delay: float, gap: float, w: int, stride: int, size: int) -> None:
        super().__init__(delay, gap)
        self.w, self.stride, self.size = w, stride, size

    def rows(self, key, came, seen, timer, rest, now):
        trace, chunk = key
        begin, w, stride = int(chunk) * self.size, self.w, self.stride
        nxt, tail, wait_pos, wait_token = rest or (begin, [], [], [])
        pos = np.array([*wait_pos, *(r["pos"] for r in came)], np.int64)
        token = np.array([*wait_token, *(r["token"] for r in came)], np.int64)
        # What was waiting comes first, so of equal positions the row seen first stays.
        first = np.unique(pos, return_index=True)[1]
        fresh = first[pos[first] >= nxt]
        again = np.setdiff1d(np.arange(len(wait_pos), len(pos)), fresh)
        # A token shared with the neighbouring chunk is reported by its own chunk only.
        out = [(trace, None, None, p, True) for p in pos[again].tolist() if begin <= p < begin + self.size]
        pos, token = pos[fresh], token[fresh]
        ready = int((pos == nxt + np.arange(len(pos))).cumprod().sum())
        row = np.concatenate([np.array(tail, np.int64), token[:ready]])
        at = nxt - len(tail)  # position of the first token of ``row``
        nxt += ready
        if len(row) >= w:
            start = np.arange(at, at + len(row) - w + 1)
            start = start[(start % stride == 0) & (start >= begin) & (start < begin + self.size) & (start > nxt - ready - w)]
            view = np.lib.stride_tricks.sliding_window_view(row, w)
            out += [(trace, s // stride, view[s - at].tolist(), None, False) for s in start.tolist()]
        tail = row[len(row) - min(len(row), w - 1) :].tolist()
        if nxt >= begin + self.size + w - 1:
            tail, ready = [], len(pos)
        self.store(seen, timer, seen + self.gap, (int(nxt), tail, pos[ready:].tolist(), token[ready:].tolist()))
        return out

    def over(self, key, rest):
        begin = int(key[1]) * self.size
        return [(key[0], None, None, p, True) for p in rest[2] if begin <= p < begin + self.size]


def window_stream(stream: DataFrame, w: int = 20, stride: int = 2, size: int = PACK, delay: float = 0, gap: float = GAP) -> DataFrame:
    """Sliding windows of a stream ``(trace_id, pos, token, ts)``: a window comes out once, when all its tokens are there.
    A token that arrives again, and one still waiting for others when its trace is over, comes out as a row with ``late``.

    State is one small record per trace and chunk of ``size`` window starts: the next expected position, the tokens
    still needed by an open window, and tokens that arrived ahead of their turn. It goes when the chunk has been silent for ``gap`` seconds."""
    size = max(1, size // stride) * stride
    first = F.greatest(F.lit(0).cast("bigint"), F.expr(f"(pos - {w - 1}) div {size}"))
    rows = _clocked(stream).select("trace_id", "ts", F.explode(F.sequence(first, F.expr(f"pos div {size}"))).alias("chunk"), "pos", "token")
    return _apply(rows, ["trace_id", "chunk"], _Windows(delay, gap, w, stride, size), "trace_id string, w bigint, win array<int>, pos bigint, late boolean")


def score_batches(stream: DataFrame, model: Markov, path: str, checkpoint: str) -> DataFrame:
    """Score a stream of windows with a fitted chain, batch by batch: the model joins each batch as it joins a table, whatever
    its size, and nothing is kept between batches. A batch that runs again overwrites its own folder."""

    def one(batch: DataFrame, number: int) -> None:
        model.score(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(path).drop("batch")


class _Alerts:
    """Running alert state of one sequence."""

    def __init__(self, policy: Policy, stored: tuple | None) -> None:
        self.p = policy
        self.nxt, self.probs, self.alert, self.hold, ahead_w, ahead_p = stored or (0, [], False, 0, [], [])
        self.probs, self.waiting = list(self.probs), dict(zip(ahead_w, ahead_p))

    def stored(self) -> tuple:
        return self.nxt, self.probs, self.alert, self.hold, list(self.waiting), list(self.waiting.values())

    def push(self, ws, probs) -> Iterator[tuple[int, float, bool, str | None]]:
        """Yield ``(w, prob, alert, event)`` for every window whose turn has come."""
        for w, p in zip(ws, probs):
            if w is not None and w >= self.nxt:
                self.waiting[w] = float("nan") if p is None else p
        while self.nxt in self.waiting:
            prob = self.waiting.pop(self.nxt)
            was = self.alert
            self._step(prob)
            event = "open" if self.alert and not was else "close" if was and not self.alert else None
            yield self.nxt, prob, self.alert, event
            self.nxt += 1

    def _step(self, prob: float) -> None:
        p = self.p
        self.probs = [*self.probs, prob][-p.rolling :]
        frame = np.array(self.probs)
        on = frame >= (0.5 if p.tau is None else p.tau)
        mean, rate = frame.mean(), on.mean()
        if self.alert:
            if self.hold > 0:
                self.hold -= 1
                return
            clear = [c for c in ((None if p.clear_mean is None else mean <= p.clear_mean), (None if p.clear_rate is None else rate <= p.clear_rate)) if c is not None]
            if clear and all(clear):
                self.alert = False
        elif self.nxt + 1 >= p.warmup:
            best = run = 0
            for v in on:
                run = run + 1 if v else 0
                best = max(best, run)
            start = [
                c
                for c in (
                    None if p.trigger_mean is None else mean >= p.trigger_mean,
                    None if p.trigger_rate is None else rate >= p.trigger_rate,
                    None if p.trigger_consecutive is None else best >= p.trigger_consecutive,
                )
                if c is not None
            ]
            if start and all(start):
                self.alert, self.hold = True, p.hold - 1


STATE = "nxt bigint, probs array<double>, alert boolean, hold int, ahead_w array<bigint>, ahead_p array<double>"


class _AlertRows(Timed):
    fields = STATE
    names = ("trace_id", "w", "prob", "alert", "event")

    def __init__(self, delay: float, gap: float, policy: Policy) -> None:
        super().__init__(delay, gap)
        self.policy = policy

    def rows(self, key, came, seen, timer, rest, now):
        run = _Alerts(self.policy, rest)
        out = [(key[0], *row) for row in run.push(*zip(*((r["w"], r["prob"]) for r in came)))]
        self.store(seen, timer, seen + self.gap, run.stored())
        return out

    def over(self, key, rest):
        return [(key[0], w, p, None, "stranded") for w, p in sorted(zip(rest[4], rest[5]))]


def alert_stream(stream: DataFrame, policy: Policy, delay: float = 0, gap: float = GAP) -> DataFrame:
    """Alert state of a stream ``(trace_id, w, prob, ts)`` with ``open`` and ``close`` events. The state of a trace is its last
    rolling frame, the alert flag and the held windows left, until the trace has been silent for ``gap`` seconds. Windows behind a
    missing one come out then, without alert and with the event ``stranded``."""
    slim = _clocked(stream.select("trace_id", "w", "prob", "ts"))
    return _apply(slim, ["trace_id"], _AlertRows(delay, gap, policy), "trace_id string, w bigint, prob double, alert boolean, event string")


_COUNTERS = ["n_windows", "first_alert", "first_inside", "before", "inside", "after", "total", "segments", "attack_start", "attack_end"]
_UNSET = ("first_alert", "first_inside", "attack_start", "attack_end")


class _Episodes(_AlertRows):
    fields = f"{STATE}, {', '.join(f'{c} bigint' for c in _COUNTERS)}, expected bigint"
    names = ("trace_id", *_COUNTERS, "missing")

    def rows(self, key, came, seen, timer, rest, now):
        run = _Alerts(self.policy, rest[:6] if rest else None)
        count = dict(zip(_COUNTERS, rest[6:-1])) if rest else {c: None if c in _UNSET else 0 for c in _COUNTERS}
        told = {c: next((r[c] for r in came if r[c] is not None), None) for c in ("attack_start", "attack_end", "expected")}
        expected = told["expected"] if told["expected"] is not None else rest[-1] if rest else None
        for c in ("attack_start", "attack_end"):
            if told[c] is not None:
                count[c] = told[c]
        start, end = count["attack_start"], count["attack_end"]
        for w, _, alert, event in run.push(*zip(*((r["w"], r["prob"]) for r in came))):
            count["n_windows"] += 1
            if not alert:
                continue
            count["total"] += 1
            count["segments"] += event == "open"
            count["first_alert"] = w if count["first_alert"] is None else count["first_alert"]
            if start is not None:
                where = "before" if w < start else "after" if w > end else "inside"
                count[where] += 1
                if where == "inside" and count["first_inside"] is None:
                    count["first_inside"] = w
        kept = [None if count[c] is None else int(count[c]) for c in _COUNTERS]
        self.store(seen, timer, seen + self.gap, (*run.stored(), *kept, expected))
        return []

    def over(self, key, rest):
        ahead, n, expected = rest[4], rest[6], rest[-1]
        known = expected if expected is not None else max(ahead) + 1 if ahead else n
        return [(key[0], *rest[6:-1], known - n)]


def episode_stream(stream: DataFrame, policy: Policy, delay: float = 0, gap: float = GAP) -> DataFrame:
    """Close an episode when its stream ``(trace_id, w, prob, ts, attack_start, attack_end)`` has been silent for ``gap`` seconds of event time, and
    emit its counters. ``attack_start`` and ``attack_end`` come from a join with the ground truth and may be NULL. ``missing`` counts
    the windows that never had their turn: those short of ``expected`` where the stream has that column, else those up to the last one seen."""
    known = F.col("expected") if "expected" in stream.columns else F.lit(None)
    cast = lambda c, name: c.cast("bigint").alias(name)
    slim = stream.select("trace_id", "w", "prob", "ts", *[cast(F.col(c), c) for c in ("attack_start", "attack_end")], cast(known, "expected"))
    fields = ", ".join(f"{c} bigint" for c in _COUNTERS)
    return _apply(_clocked(slim), ["trace_id"], _Episodes(delay, gap, policy), f"trace_id string, {fields}, missing bigint")


def whole_episodes(closed: DataFrame, known: DataFrame) -> DataFrame:
    """The stored result ``closed`` of an ``episode_stream`` without ``missing``. An error where an episode of ``known`` (``trace_id``) was never
    closed, was closed twice, or misses windows, so that a part is never taken for the whole."""
    seen = closed.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), F.sum("missing").alias("missing"))
    odd = known.select("trace_id").join(seen, "trace_id", "full").where("n is null or n > 1 or missing > 0")
    some = odd.orderBy("trace_id").limit(5).collect()
    if some:
        what = ", ".join(f"{r['trace_id']} ({'never closed' if r['n'] is None else 'closed twice' if r['n'] > 1 else str(r['missing']) + ' windows missing'})" for r in some)
        raise RuntimeError(f"{odd.count()} episodes are not whole: {what}")
    return closed.drop("missing")


def metrics_sink(stream: DataFrame, path: str, checkpoint: str, by: str = "trace_id", partitions: int | None = None):
    """Count windows, alerts and opened alerts per ``by`` and micro-batch. Each batch has its own folder and replaces it
    when the batch runs again, so a restart counts nothing twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(by).agg(
            F.count(F.lit(1)).alias("windows"), F.sum(F.col("alert").cast("int")).alias("alert_windows"), F.sum(F.coalesce(F.col("event") == "open", F.lit(False)).cast("int")).alias("alerts")
        )
        counts.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    with state_store(stream.sparkSession, partitions):
        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_metrics(spark: SparkSession, path: str, by: str = "trace_id") -> DataFrame:
    """Totals over all batches of a metrics table."""
    return spark.read.parquet(path).groupBy(by).agg(*[F.sum(c).alias(c) for c in ("windows", "alert_windows", "alerts")])


def run_to_table(stream: DataFrame, path: str, checkpoint: str, partitions: int | None = None) -> DataFrame:
    """Run a stream over everything that is there, into a Parquet table."""
    with state_store(stream.sparkSession, partitions):
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
