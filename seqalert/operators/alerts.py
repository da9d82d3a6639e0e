"""Rolling statistics, hysteresis alert state and runs over window sequences ``(key, w, ...)``, ``w`` dense from 0."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqalert.operators import ordering

KEY = ("trace_id",)
#: Windows per chunk of the general state fold, which holds one chunk as a row and a batch of chunks in a Python worker.
FOLD_CHUNK = 1 << 13


@dataclass(frozen=True)
class Policy:
    """Alert policy. A threshold left out is no condition; without any condition the alert never starts (ends)."""

    warmup: int = 5
    rolling: int = 20
    tau: float | None = None
    trigger_mean: float | None = None
    trigger_rate: float | None = None
    trigger_consecutive: int | None = None
    clear_mean: float | None = None
    clear_rate: float | None = None
    hold: int = 1
    name: str = "rolling_hysteresis_v1"

    def __post_init__(self) -> None:
        if self.warmup < 1 or self.rolling < 1 or self.hold < 1:
            raise ValueError("warmup, rolling window and hold must be at least 1")

    @property
    def disjoint(self) -> bool:
        """True when no window can both trigger and clear."""
        mean = self.trigger_mean is not None and self.clear_mean is not None and self.trigger_mean > self.clear_mean
        rate = self.trigger_rate is not None and self.clear_rate is not None and self.trigger_rate > self.clear_rate
        return mean or rate


def _all(conditions: list[Column]) -> Column:
    if not conditions:
        return F.lit(False)
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def trigger_condition(p: Policy, mean: Column, rate: Column, consecutive: Column) -> Column:
    out = []
    if p.trigger_mean is not None:
        out.append(mean >= p.trigger_mean)
    if p.trigger_rate is not None:
        out.append(rate >= p.trigger_rate)
    if p.trigger_consecutive is not None:
        out.append(consecutive)
    return _all(out)


def clear_condition(p: Policy, mean: Column, rate: Column) -> Column:
    out = []
    if p.clear_mean is not None:
        out.append(mean <= p.clear_mean)
    if p.clear_rate is not None:
        out.append(rate <= p.clear_rate)
    return _all(out)


def rolling(
    scores: DataFrame,
    window: int,
    tau: float | Column = 0.5,
    consecutive: int | None = None,
    key: Sequence[str] = KEY,
    prob: str = "prob",
    size: int = ordering.CHUNK,
) -> DataFrame:
    """Add ``positive``, ``rolling_mean``, ``rolling_rate`` and ``rolling_run`` (at least ``consecutive`` positives
    in a row somewhere in the frame). Frames at the start of a sequence are shorter."""
    tau = F.lit(float(tau)) if isinstance(tau, (int, float)) else tau
    rows = scores.withColumn("positive", F.col(prob) >= tau)
    chunked = ordering.with_halo(rows, "w", window - 1, size)
    part = Window.partitionBy(*key, "_chunk").orderBy("w")
    frame = part.rowsBetween(-(window - 1), 0)
    out = chunked.select(
        "*",
        F.avg(prob).over(frame).alias("rolling_mean"),
        F.avg(F.col("positive").cast("int")).over(frame).alias("rolling_rate"),
    )
    if consecutive is None or consecutive > window:
        out = out.withColumn("rolling_run", F.lit(False))
    elif consecutive <= 1:
        out = out.withColumn("rolling_run", F.col("rolling_rate") > 0)
    else:
        # A row ends a run of c positives when the last c rows exist and are all positive; any such row with its
        # whole run inside the frame counts.
        ends = part.rowsBetween(-(consecutive - 1), 0)
        full = F.sum(F.col("positive").cast("int")).over(ends) >= consecutive
        out = out.withColumn("_full", full.cast("int"))
        out = out.withColumn("rolling_run", F.max("_full").over(part.rowsBetween(-(window - consecutive), 0)) == 1).drop("_full")
    return out.where("_own").drop("_own", "_chunk")


def alert_timeline(
    scores: DataFrame, policy: Policy, key: Sequence[str] = KEY, prob: str = "prob", size: int = ordering.CHUNK
) -> DataFrame:
    """Alert state of every window under the policy: adds the rolling columns, ``alert`` and ``was_alert`` (the state one
    window earlier). The rolling columns are computed once and checkpointed."""
    tau = policy.tau if policy.tau is not None else F.coalesce(F.col("tau"), F.lit(0.5)) if "tau" in scores.columns else 0.5
    rolled = rolling(scores, policy.rolling, tau, policy.trigger_consecutive, key, prob, size)
    mean, rate, run = F.col("rolling_mean"), F.col("rolling_rate"), F.col("rolling_run")
    starts = (F.col("w") + 1 >= policy.warmup) & trigger_condition(policy, mean, rate, run)
    ends = clear_condition(policy, mean, rate)
    if policy.hold == 1 and policy.disjoint:
        # Triggering and clearing exclude each other, so the state is the last event that happened.
        events = ordering.cut(rolled.withColumn("_event", F.when(starts, 1).when(ends, 0)))
        out = ordering.carry_last(events, "_event", key, "w", "_state", size, previous="_before")
        state = {n: F.coalesce(c, F.lit(0)) == 1 for n, c in (("alert", "_state"), ("was_alert", "_before"))}
        return out.withColumns(state).drop("_event", "_state", "_before")
    marked = ordering.cut(rolled.withColumn("_starts", starts).withColumn("_ends", ends))
    return _fold(marked, policy.hold, list(key), min(size, FOLD_CHUNK))


def _run_state(starts: np.ndarray, ends: np.ndarray, hold: int, state: int) -> tuple[np.ndarray, int]:
    """Alert flags of one chunk and its end state. State 0 is no alert; 1 + h is alert with h held windows left.
    Jumps from one alert start to its end instead of stepping through the windows."""
    n = len(starts)
    on, off = np.flatnonzero(starts), np.flatnonzero(ends)
    alert = np.zeros(n, dtype=bool)
    at = 0
    since, left = (0, state - 1) if state else (-1, 0)
    while True:
        if since < 0:
            i = np.searchsorted(on, at)
            if i == len(on):
                return alert, 0
            since, left = int(on[i]), hold
        j = np.searchsorted(off, since + left)
        if j == len(off):
            alert[since:] = True
            return alert, 1 + max(0, since + left - n)
        alert[since : off[j]] = True
        at, since = int(off[j]) + 1, -1


def _fold(marked: DataFrame, hold: int, key: list[str], size: int) -> DataFrame:
    """Exact alert state for any policy. Each chunk is turned into a function from its start state to its end
    state; the functions are chained over the chunks of a sequence, and each chunk then runs once more from its
    known start state. A chunk is one row that holds its windows in order, and a sequence of chunks one row that holds their functions, so that a
    task takes many of them in one batch."""
    flags = F.struct("w", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("_starts", "_ends")], *[c for c in marked.columns if c not in (*key, "w", "_starts", "_ends")])
    chunks = marked.groupBy(*key, F.expr(f"w div {size}").alias("_chunk")).agg(F.array_sort(F.collect_list(flags)).alias("_rows"))

    @F.pandas_udf("array<int>")
    def ends_of(starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([[_run_state(s, e, hold, state)[1] for state in range(hold + 1)] for s, e in zip(starts, ends)], index=starts.index, dtype=object)

    @F.pandas_udf("array<int>")
    def begins_of(maps: pd.Series) -> pd.Series:
        out = []
        for steps in maps:
            state, begin = 0, []
            for step in np.asarray(steps).reshape(-1, hold + 1):
                begin.append(state)
                state = int(step[state])
            out.append(begin)
        return pd.Series(out, index=maps.index, dtype=object)

    @F.pandas_udf("array<boolean>")
    def alerts_of(starts: pd.Series, ends: pd.Series, begin: pd.Series) -> pd.Series:
        return pd.Series([_run_state(s, e, hold, int(b))[0] for s, e, b in zip(starts, ends, begin)], index=starts.index, dtype=object)

    maps = chunks.select(*key, "_chunk", ends_of("_rows._starts", "_rows._ends").alias("_map"))
    # One entry per chunk of a sequence.
    lines = maps.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_chunk", "_map"))).alias("_line"))
    begins = lines.withColumn("_begin", begins_of(F.flatten("_line._map")))
    begins = begins.select(*[F.col(k).alias(f"_k_{k}") for k in key], F.explode(F.arrays_zip(F.col("_line._chunk").alias("at"), F.col("_begin").alias("begin"))).alias("_b"))
    same = F.col("_chunk") == F.col("_b.at")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    known = chunks.join(begins, same).select(*key, "_rows", F.col("_b.begin").alias("_begin"))
    known = known.withColumn("_alert", alerts_of("_rows._starts", "_rows._ends", "_begin"))
    # The state before a window is that of the window before it; before the first, the chunk's start state.
    was = F.concat(F.array(F.col("_begin") > 0), F.slice("_alert", F.lit(1), F.size("_alert") - 1))
    rows = known.select(*key, F.explode(F.arrays_zip(F.col("_rows").alias("row"), F.col("_alert").alias("alert"), was.alias("was_alert"))).alias("_r"))
    return rows.select(*[c if c in key else F.col(f"_r.row.`{c}`") for c in marked.columns if c not in ("_starts", "_ends")], "_r.alert", "_r.was_alert")


def segments(df: DataFrame, flag: str, key: Sequence[str] = KEY, size: int = ordering.CHUNK) -> DataFrame:
    """Maximal runs of true ``flag`` as ``(key, start_w, end_w)``.

    Runs are built inside chunks from the flagged rows only; runs that touch a chunk border are then joined."""
    key = list(key)
    on = df.where(F.col(flag)).select(*key, "w", F.expr(f"w div {size}").alias("_chunk"))
    rank = F.row_number().over(Window.partitionBy(*key, "_chunk").orderBy("w"))
    runs = on.withColumn("_run", F.col("w") - rank).groupBy(*key, "_chunk", "_run").agg(
        F.min("w").alias("start_w"), F.max("w").alias("end_w")
    )
    border = (F.col("start_w") % size == 0) | ((F.col("end_w") + 1) % size == 0)
    runs = runs.withColumn("_border", border)
    inner = runs.where(~F.col("_border")).select(*key, "start_w", "end_w")
    # At most two runs per chunk touch a border.
    line = Window.partitionBy(*key).orderBy("start_w")
    new = F.coalesce(F.lag("end_w").over(line) + 1 != F.col("start_w"), F.lit(True)).cast("int")
    edge = runs.where("_border").withColumn("_new", new)
    edge = edge.withColumn("_id", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    joined = edge.groupBy(*key, "_id").agg(F.min("start_w").alias("start_w"), F.max("end_w").alias("end_w"))
    return inner.unionByName(joined.select(*key, "start_w", "end_w"))


def longest_run(df: DataFrame, flag: str, key: Sequence[str] = KEY, size: int = ordering.CHUNK) -> DataFrame:
    """Longest run of true ``flag`` per sequence, 0 where there is none."""
    runs = segments(df, flag, key, size).groupBy(*key).agg(F.max(F.col("end_w") - F.col("start_w") + 1).alias("_best"))
    out = df.select(*key).distinct().join(runs, list(key), "left")
    return out.select(*key, F.coalesce("_best", F.lit(0)).cast("bigint").alias("longest_run"))
