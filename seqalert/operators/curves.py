"""Ranking-curve metrics. Everything is computed from the score table: one row per distinct score."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqalert.operators import ordering

EPS = 1e-8
#: Rows whose scores a task sorts into one run.
RUN = 1 << 18


def score_table(
    df: DataFrame, score: str = "score", y: str = "y", by: Sequence[str] = (), task_rows: int | None = None
) -> DataFrame:
    """``(by, score, pos, neg, cum_pos, cum_neg, P, N)``, cumulated from the highest score down. Rows without a score or a
    label are no rows of the curve."""
    by = list(by)
    counts = df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("neg")
    )
    return ordering.prefix_sum(
        ordering.cut(counts),
        ["score"],
        {"cum_pos": "pos", "cum_neg": "neg"},
        by=by,
        descending=True,
        totals={"P": "pos", "N": "neg"},
        task_rows=task_rows,
    )


def _tpr() -> Column:
    return F.col("cum_pos") / F.col("P")


def _fpr() -> Column:
    return F.col("cum_neg") / F.col("N")


def roc_points(tbl: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return tbl.select(*by, "score", _fpr().alias("fpr"), _tpr().alias("tpr"))


def _auc() -> Column:
    p, n = F.max("P").cast("double"), F.max("N").cast("double")
    won = F.sum(F.col("pos").cast("double") * (F.col("N") - F.col("cum_neg") + F.col("neg") / 2))
    return F.when((p > 0) & (n > 0), won / (p * n))


def _ap() -> Column:
    share = F.col("pos") / F.col("P") * (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    return F.sum(F.when(F.col("P") > 0, share))


def _f1() -> Column:
    p = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    r = F.when(F.col("P") > 0, _tpr()).otherwise(0.0)
    return 2 * p * r / (p + r + EPS)


def roc_auc(tbl: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties one half; NULL when a class is missing."""
    return tbl.groupBy(*by).agg(_auc().alias("auc"))


def _run(score: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[int, bytes]:
    """Rising distinct scores with the sums of ``pos`` and ``neg``, compressed: equal bytes of neighbours lie together."""
    order = np.argsort(score, kind="stable")
    score, pos, neg = score[order], pos[order], neg[order]
    first = np.flatnonzero(np.append(True, (score[1:] != score[:-1]) & ~(np.isnan(score[1:]) & np.isnan(score[:-1]))))
    cols = [score[first], np.add.reduceat(pos, first), np.add.reduceat(neg, first)]
    return len(first), pa.compress(b"".join(c.view(np.uint8).reshape(-1, 8).T.tobytes() for c in cols), "zstd", asbytes=True)


def _of_run(n: int, run: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(run, 24 * n, "zstd"), np.uint8).reshape(3, 8, n)
    score, pos, neg = (np.ascontiguousarray(c.T).reshape(-1) for c in raw)
    return score.view(np.float64), pos.view(np.int64), neg.view(np.int64)


def score_runs(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """``(n, run)``: the scores of ``df`` with their labels as sorted runs of ``n`` distinct scores. A score takes some 6 bytes there and some 80 as a row.
    Rows without a score or a label are in no run."""
    size = RUN

    def made(batches):
        held, rows = [], 0

        def flush():
            s, p = (np.concatenate(c) for c in zip(*held))
            n, run = _run(s, p, 1 - p)
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([run], pa.binary())], names=["n", "run"])

        for batch in batches:
            if batch.num_rows:
                s = batch.column(0).to_numpy(zero_copy_only=False) + 0.0  # zero has one sign
                held.append((s, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)))
                rows += len(s)
            if rows >= size:
                yield flush()
                held, rows = [], 0
        if rows:
            yield flush()

    told = df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).select(F.col(score).cast("double").alias("score"), F.when(F.col(y) == 1, 1).otherwise(0).cast("bigint").alias("p"))
    return told.mapInArrow(made, "n bigint, run binary")


def roc_auc_of_runs(runs: DataFrame, by: Sequence[str], task_rows: int | None = None) -> DataFrame:
    """``roc_auc`` of the stored table ``runs`` of ``score_runs`` with columns ``by``, without a row per score.

    Runs are cut at the same scores into ranges of about ``task_rows`` scores, so that equal scores share a range. A range is merged in one
    task, and the positives of a range are above all negatives of the ranges before it."""
    by, task_rows = list(by), task_rows or ordering.TASK_ROWS
    step = max(1, min(4096, task_rows // 16))
    types = dict(runs.dtypes)
    keys = ", ".join(f"`{b}` {types[b]}" for b in by)

    def rows(batches, with_cuts):
        for batch in batches:
            n, run = batch.column("n").to_pylist(), batch.column("run")
            cuts = batch.column("cuts") if with_cuts else None
            for i in range(batch.num_rows):
                yield [batch.column(b)[i].as_py() for b in by], n[i], run[i].as_py(), cuts[i].as_py() if with_cuts else None

    def marks(batches):
        for key, n, run, _ in rows(batches, False):
            # Every step-th score from a place that the run itself decides, so that the marks of many runs do not lie side by side.
            found = _of_run(n, run)[0][int.from_bytes(run[-8:], "little") % step :: step]
            yield pa.RecordBatch.from_arrays([*[pa.array([k] * len(found), t) for k, t in zip(key, arrow)], pa.array(found)], names=[*by, "mark"])

    def pieces(batches):
        for key, n, run, cuts in rows(batches, True):
            score, pos, neg = _of_run(n, run)
            at = np.append(0, np.append(np.searchsorted(score, np.array(cuts or [], float), "right"), n))
            for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
                if a < b:
                    m, piece = _run(score[a:b], pos[a:b], neg[a:b])
                    yield pa.RecordBatch.from_arrays([*[pa.array([k], t) for k, t in zip(key, arrow)], pa.array([i], pa.int32()), pa.array([m], pa.int64()), pa.array([piece], pa.binary())], names=[*by, "range", "n", "run"])

    def merged(table: pa.Table) -> pa.Table:
        cols = [np.concatenate(c) for c in zip(*[_of_run(n, run) for n, run in zip(table["n"].to_pylist(), table["run"].to_pylist())])]
        order = np.argsort(cols[0], kind="stable")
        score, pos, neg = (c[order] for c in cols)
        first = np.flatnonzero(np.append(True, (score[1:] != score[:-1]) & ~(np.isnan(score[1:]) & np.isnan(score[:-1]))))
        pos, neg = np.add.reduceat(pos, first), np.add.reduceat(neg, first)
        won = float((pos * (neg.cumsum() - neg + neg / 2)).sum())
        told = {b: table[b].slice(0, 1) for b in by} | {"range": table["range"].slice(0, 1)}
        return pa.table(told | {"p": [int(pos.sum())], "m": [int(neg.sum())], "won": [won]})

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(runs.schema[b].dataType) for b in by]
    largest = runs.groupBy(*by).agg(F.sum("n").alias("n")).agg(F.max("n")).head()[0] or 0
    if largest > task_rows:
        parts = -(-largest // task_rows)
        found = runs.select(*by, "n", "run").mapInArrow(marks, f"{keys}, mark double").groupBy(*by)
        cuts = found.agg(F.array_distinct(F.percentile_approx("mark", [i / parts for i in range(1, parts)], 100 * parts)).alias("cuts"))
        cuts = F.broadcast(ordering.cut(cuts.select(*[F.col(b).alias(f"_{b}") for b in by], "cuts")))  # one row per group
        same = F.lit(True)
        for b in by:
            same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
        runs = runs.join(cuts, same, "left").select(*by, "n", "run", "cuts").mapInArrow(pieces, f"{keys}, range int, n bigint, run binary")
    else:
        runs = runs.select(*by, F.lit(0).alias("range"), "n", "run")
    ranges = runs.groupBy(*by, "range").applyInArrow(merged, f"{keys}, range int, p bigint, m bigint, won double")
    # One row per range and group.
    below = F.coalesce(F.sum("m").over(Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    p, m = F.sum("p").cast("double"), F.sum("m").cast("double")
    won = F.sum(F.col("won") + F.col("p").cast("double") * F.col("below"))
    return ranges.withColumn("below", below).groupBy(*by).agg(F.when((p > 0) & (m > 0), won / (p * m)).alias("auc"))


def average_precision(tbl: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return tbl.groupBy(*by).agg(_ap().alias("ap"))


def best_f1(tbl: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Best F1 over all thresholds ``score >= tau``; equal F1 takes the smallest threshold."""
    best = F.max(F.struct(_f1().alias("f1"), (-F.col("score")).alias("neg"), F.col("score").alias("tau")))
    return tbl.groupBy(*by).agg(best.alias("_b")).select(*by, F.col("_b.f1").alias("f1"), F.col("_b.tau").alias("tau"))


def fpr_at_tpr(tbl: DataFrame, target: float = 0.95, by: Sequence[str] = (), name: str = "fpr") -> DataFrame:
    return tbl.groupBy(*by).agg(F.min(F.when(_tpr() >= target, _fpr())).alias(name))


def tpr_at_fpr(tbl: DataFrame, target: float, by: Sequence[str] = (), name: str = "tpr") -> DataFrame:
    """Largest TPR whose FPR stays within ``target``; 0 when no threshold does."""
    return tbl.groupBy(*by).agg(F.coalesce(F.max(F.when(_fpr() <= target, _tpr())), F.lit(0.0)).alias(name))


def all_metrics(tbl: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AUC, average precision, best F1 with its threshold, FPR at TPR 95 % and TPR at FPR 1 % in one aggregation."""
    best = F.max(F.struct(_f1().alias("f1"), (-F.col("score")).alias("neg"), F.col("score").alias("tau")))
    out = tbl.groupBy(*by).agg(
        _auc().alias("auc"),
        _ap().alias("ap"),
        best.alias("_b"),
        F.min(F.when(_tpr() >= 0.95, _fpr())).alias("fpr95"),
        F.coalesce(F.max(F.when(_fpr() <= 0.01, _tpr())), F.lit(0.0)).alias("tpr_fpr1"),
        F.coalesce(F.max(F.when(_fpr() <= 0.001, _tpr())), F.lit(0.0)).alias("tpr_fpr01"),
        F.max("P").cast("bigint").alias("n_pos"),
        F.max("N").cast("bigint").alias("n_neg"),
    )
    return out.select(
        *by, "auc", "ap", F.col("_b.f1").alias("best_f1"), F.col("_b.tau").alias("best_tau"), "fpr95", "tpr_fpr1", "tpr_fpr01", "n_pos", "n_neg"
    )


def average_precision_balanced(df: DataFrame, score: str = "score", y: str = "y", keys: Sequence[str] = ("id",), seed: int = 42) -> DataFrame:
    from seqalert.operators.sampling import balance

    return average_precision(score_table(balance(df, y, keys, seed), score, y))


def benign_threshold(df: DataFrame, q: float = 0.95, score: str = "score", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    return ordering.quantiles(df.where(F.col(y) == 0), score, {"tau": q}, by=by)


def _confusion(flag: Column, y: str) -> list[Column]:
    pos, on = F.col(y) == 1, flag
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return [
        count(on & pos).alias("tp"),
        count(on & ~pos).alias("fp"),
        count(~on & ~pos).alias("tn"),
        count(~on & pos).alias("fn"),
    ]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def confusion(df: DataFrame, tau: float | str | Column, by: Sequence[str] = (), score: str = "score", y: str = "y", strict: bool = False) -> DataFrame:
    """Confusion counts and ten rates at a threshold; a zero denominator gives 0."""
    tau = F.lit(float(tau)) if isinstance(tau, (int, float)) else F.col(tau) if isinstance(tau, str) else tau
    flag = F.col(score) > tau if strict else F.col(score) >= tau
    c = df.groupBy(*by).agg(*_confusion(flag, y))
    tp, fp, tn, fn = (F.col(n).cast("double") for n in ("tp", "fp", "tn", "fn"))
    precision, recall, spec = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    mcc = _ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return c.select(
        *by,
        "tp",
        "fp",
        "tn",
        "fn",
        precision.alias("precision"),
        recall.alias("recall"),
        spec.alias("specificity"),
        _ratio(tn, tn + fn).alias("npv"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ((recall + spec) / 2).alias("balanced_accuracy"),
        mcc.alias("mcc"),
        _ratio(fp, fp + tn).alias("fpr"),
        _ratio(fn, fn + tp).alias("fnr"),
        _ratio(tp + fp, tp + fp + tn + fn).alias("positive_rate"),
    )


def f1_at(df: DataFrame, tau: Column, by: Sequence[str] = (), score: str = "score", y: str = "y", strict: bool = False) -> DataFrame:
    return confusion(df, tau, by, score, y, strict).select(*by, "f1")


def calibrated_metrics(
    calibration: DataFrame, test: DataFrame, method: str = "pr_curve", q: float = 0.95, score: str = "score", y: str = "y"
) -> DataFrame:
    """One metric record: the threshold is chosen on ``calibration`` (best F1 of the curve, or a benign quantile) and
    applied to ``test``, next to the test set's own best F1."""
    if method == "pr_curve":
        tau = best_f1(score_table(calibration, score, y)).select("tau").scalar()
    elif method == "benign_quantile":
        tau = benign_threshold(calibration, q, score, y).select("tau").scalar()
    else:
        raise ValueError(f"unknown calibration method {method}")
    curve = all_metrics(score_table(test, score, y), by=[]).withColumn("method", F.lit(method))
    fixed = confusion(test, tau, score=score, y=y).select(F.lit(method).alias("method"), "precision", "recall", "f1")
    return curve.join(fixed, "method").select(
        "method", tau.alias("tau"), "auc", "ap", "f1", "precision", "recall", F.col("best_f1").alias("oracle_f1"), "fpr95"
    )


def rank_percentile(df: DataFrame, cols: Sequence[str], task_rows: int | None = None) -> DataFrame:
    """Add ``<col>_pct``: average-tie rank divided by the number of rows with a value, in one sort of the rows per column. Rows without
    a value keep a NULL."""
    out = df.withColumn("_one", F.lit(1))
    for c in cols:
        ranked = ordering.rank_sums(ordering.cut(out), c, {"_r": "_one"}, task_rows)
        pct = (F.col("below__r") + (F.col("equal__r") + 1) / 2) / F.col("all__r")
        out = ranked.withColumn(f"{c}_pct", pct).drop("below__r", "equal__r", "all__r")
    return out.drop("_one")


def savgol_weights(window: int, at: int, order: int = 2) -> np.ndarray:
    """Weights of the least-squares polynomial through ``window`` equally spaced points, evaluated at point ``at``."""
    x = np.arange(window) - at
    return np.linalg.pinv(np.vander(x, order + 1, increasing=True))[0]


def best_f1_smoothed(tbl: DataFrame, task_rows: int | None = None) -> DataFrame:
    """Threshold at the highest smoothed F1 over ascending thresholds: local quadratic fits of odd width
    ``min(21, max(5, n // 10 * 2 + 1))`` for ``n`` thresholds, one-sided fits at both ends, no smoothing below 5."""
    base = ordering.cut(tbl.select("score", _f1().alias("f1")))
    n = base.count()
    numbered = ordering.number_rows(base, ["score"], name="_i", task_rows=task_rows)
    if n < 5:
        smooth = numbered.withColumn("_s", F.col("f1"))
    else:
        width = min(21, max(5, n // 10 * 2 + 1))
        width = min(width, n if n % 2 else n - 1)
        half = width // 2
        chunked = _two_sided(numbered, half)
        line = Window.partitionBy("_chunk").orderBy("_i")
        centre = savgol_weights(width, half)
        terms = [F.lit(float(centre[half + k])) * (F.lag("f1", -k).over(line) if k else F.col("f1")) for k in range(-half, half + 1)]
        inner = terms[0]
        for t in terms[1:]:
            inner = inner + t
        smooth = chunked.withColumn("_s", inner).where("_own").drop("_own", "_chunk")
        # The first and last half window take the fit through the outermost ``width`` points: 2 * width rows.
        edge = numbered.where((F.col("_i") < width) | (F.col("_i") >= n - width))
        pieces = []
        for lead, base_i in ((True, 0), (False, n - width)):
            targets = range(half) if lead else range(width - half, width)
            block = edge.where((F.col("_i") >= base_i) & (F.col("_i") < base_i + width))
            weights = [[float(v) for v in savgol_weights(width, t)] for t in targets]
            table = F.array(*[F.array(*[F.lit(v) for v in row]) for row in weights])
            rows = block.select(F.posexplode(table).alias("_t", "_w"), (F.col("_i") - base_i).alias("_at"), "f1")
            val = rows.groupBy("_t").agg(F.sum(F.element_at("_w", (F.col("_at") + 1).cast("int")) * F.col("f1")).alias("_e"))
            pieces.append(val.select((F.col("_t") + base_i + (0 if lead else width - half)).cast("bigint").alias("_i"), "_e"))
        edges = pieces[0].unionByName(pieces[1])
        smooth = smooth.join(F.broadcast(edges), "_i", "left").withColumn("_s", F.coalesce("_e", "_s"))
    top = smooth.agg(F.max(F.struct(F.col("_s"), (-F.col("_i")).alias("_o"), "score", "f1")).alias("_b"))
    return top.select(F.col("_b.score").alias("tau"), F.col("_b.f1").alias("f1"), F.col("_b._s").alias("smoothed_f1"))


def _two_sided(df: DataFrame, half: int, size: int = ordering.CHUNK) -> DataFrame:
    lo = F.expr(f"greatest(0, _i - {half}) div {size}")
    hi = F.expr(f"(_i + {half}) div {size}")
    return df.withColumn("_chunk", F.explode(F.sequence(lo, hi))).withColumn("_own", F.col("_chunk") == F.expr(f"_i div {size}"))


#: Distinct scores one task of a bootstrap draws for.
DRAW_ROWS = 50_000


def bootstrap_ci(tbl: DataFrame, rounds: int = 200, level: float = 0.95, seed: int = 42, groups: int | None = None, task_rows: int | None = None) -> DataFrame:
    """Percentile interval of AUC, average precision and best F1 under resampling; see ``replicates``. ``groups`` merges neighbouring scores
    into about that many groups first, for a caller who wants an approximation. All NULL without rows; no AUC where a class is missing."""
    rows = tbl
    if groups:
        at = F.floor((F.col("cum_pos") + F.col("cum_neg") - 1) / F.greatest(F.lit(1.0), (F.col("P") + F.col("N")) / groups))
        rows = rows.groupBy(at.alias("_g")).agg(F.max("score").alias("score"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    aggs = []
    for m in ("auc", "ap", "f1"):
        aggs += [F.percentile(m, F.lit(lo)).alias(f"{m}_lo"), F.percentile(m, F.lit(hi)).alias(f"{m}_hi")]
    return replicates(rows, rounds, seed, task_rows).agg(*aggs)


def replicates(tbl: DataFrame, rounds: int, seed: int = 42, task_rows: int | None = None) -> DataFrame:
    """``replicate``, ``auc``, ``ap`` and ``f1`` (best over all thresholds) of ``rounds`` resamplings of the rows behind a score table.

    A replicate draws the positive and negative counts of every distinct score anew (a Poisson draw with the count as its mean, the
    large-sample form of resampling rows). A row of the table carries the counts of all replicates as one array, and only inside a
    task: the table is sorted once into ranges of ``task_rows`` scores, each range adds up its draws, and with the totals of the ranges
    before it goes through the same draws again for its part of the curves. What is shuffled is the table and one row per range and replicate. A
    draw follows from ``seed`` and the score alone, so neither ranges nor repeated tasks change it."""
    rows = ordering.cut(tbl.select(F.col("score").cast("double").alias("score"), "pos", "neg"))
    parts = min(ordering.MAX_RANGES, max(1, -(-rows.count() // (task_rows or DRAW_ROWS))))
    ranged = ordering.cut(rows.repartitionByRange(parts, F.desc("score")).withColumn("_range", F.spark_partition_id())).groupBy("_range")

    def blocks(pdf: pd.DataFrame):
        pdf = pdf.sort_values("score", ascending=False)
        for at in range(0, len(pdf), 1000):
            part = pdf.iloc[at : at + 1000]
            yield poisson_counts(*(part[c].to_numpy() for c in ("score", "pos", "neg")), rounds, seed)

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros((2, rounds), dtype="int64")
        for drawn in blocks(pdf):
            sums += [counts.sum(0) for counts in drawn]
        return pd.DataFrame({"_range": pdf["_range"].iloc[0], "replicate": np.arange(rounds, dtype="int32"), "pos": sums[0], "neg": sums[1]})

    def curve(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        start = start.sort_values("replicate")
        all_pos, all_neg = start["P"].to_numpy(), start["N"].to_numpy()
        tp, fp = ((start[f"cum_{c}"] - start[c]).to_numpy() for c in ("pos", "neg"))
        won, ap, f1 = np.zeros(rounds), np.zeros(rounds), np.zeros(rounds)
        for pos, neg in blocks(pdf):
            cum_pos, cum_neg = tp + pos.cumsum(0), fp + neg.cumsum(0)
            precision = cum_pos / np.maximum(cum_pos + cum_neg, 1)
            recall = cum_pos / np.maximum(all_pos, 1)
            won += (pos * (all_neg - cum_neg + neg / 2)).sum(0)
            ap += (pos * precision).sum(0)
            f1 = np.maximum(f1, (2 * precision * recall / (precision + recall + EPS)).max(0))
            tp, fp = cum_pos[-1], cum_neg[-1]
        return pd.DataFrame({"replicate": start["replicate"].to_numpy(), "won": won, "ap": ap, "f1": f1, "P": all_pos, "N": all_neg})

    sums = ordering.cut(ranged.applyInPandas(totals, "_range int, replicate int, pos bigint, neg bigint"))
    starts = ordering.prefix_sum(sums, ["_range"], {"cum_pos": "pos", "cum_neg": "neg"}, by=["replicate"], totals={"P": "pos", "N": "neg"})
    each = ranged.cogroup(starts.groupBy("_range")).applyInPandas(curve, "replicate int, won double, ap double, f1 double, P bigint, N bigint")
    whole = each.groupBy("replicate", "P", "N").agg(F.sum("won").alias("won"), F.sum("ap").alias("ap"), F.max("f1").alias("f1"))
    return whole.select(
        "replicate",
        F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("won") / (F.col("P").cast("double") * F.col("N"))).alias("auc"),
        F.when(F.col("P") > 0, F.col("ap") / F.col("P")).alias("ap"),
        F.when(F.col("P") + F.col("N") > 0, F.col("f1")).alias("f1"),
    )


def poisson_counts(score: np.ndarray, pos: np.ndarray, neg: np.ndarray, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Drawn counts, one row a score and one column a replicate."""
    out = np.zeros((2, len(score), rounds), dtype="int64")
    for i, bits in enumerate((score + 0.0).view("uint64")):
        rng = np.random.Generator(np.random.Philox(key=np.array([seed, bits], dtype="uint64")))
        for j, mean in enumerate((pos[i], neg[i])):
            if mean:
                out[j, i] = rng.poisson(mean, rounds)
    return out[0], out[1]


def delong(df: DataFrame, s1: str, s2: str, y: str = "y", task_rows: int | None = None) -> DataFrame:
    """Test of two correlated AUCs; see ``delong_all``."""
    return delong_all(df, s1, [s2], y, task_rows).drop("other")


def delong_all(df: DataFrame, score: str, others: Sequence[str], y: str = "y", task_rows: int | None = None) -> DataFrame:
    """Test of the AUC of ``score`` against that of each of ``others``: one row each, with its name as ``other``.

    Every score is sorted once and each row gets its placement among the rows of the other class; all covariances are one aggregate.
    Rows without a label or without one of the scores are left out."""
    names = [score, *others]
    rows = df.select((F.col(y) == 1).cast("int").alias("pos"), *[F.col(c).cast("double").alias(f"s{i}") for i, c in enumerate(names)])
    out = rows.dropna().withColumn("neg", 1 - F.col("pos"))
    for i in range(len(names)):
        ranked = ordering.rank_sums(ordering.cut(out), f"s{i}", {"pos": "pos", "neg": "neg"}, task_rows)
        won = (F.col("below_neg") + F.col("equal_neg") / 2) / F.col("all_neg")
        lost = (F.col("all_pos") - F.col("below_pos") - F.col("equal_pos") / 2) / F.col("all_pos")
        out = ranked.withColumn(f"v{i}", F.when(F.col("pos") == 1, won).otherwise(lost)).drop(*[f"{k}_{c}" for k in ("below", "equal", "all") for c in ("pos", "neg")])
    aggs = []
    for name, cls in (("p", 1), ("n", 0)):
        v = [F.when(F.col("pos") == cls, F.col(f"v{i}")) for i in range(len(names))]
        aggs += [F.avg(v[i]).alias(f"m{i}{name}") for i in range(len(names))] + [F.var_samp(v[i]).alias(f"v{i}{name}") for i in range(len(names))]
        aggs += [F.covar_samp(v[0], v[i]).alias(f"c{i}{name}") for i in range(1, len(names))]
        aggs.append(F.sum(F.when(F.col("pos") == cls, 1).otherwise(0)).alias(f"n{name}"))
    each = []
    for i, name in enumerate(names[1:], 1):
        part = lambda k: F.col(f"{k}p") / F.col("np") + F.col(f"{k}n") / F.col("nn")
        var = F.greatest(F.lit(0.0), part("v0") + part(f"v{i}") - 2 * part(f"c{i}"))
        each.append(F.struct(F.lit(name).alias("other"), F.col("m0p").alias("auc1"), F.col(f"m{i}p").alias("auc2"), var.alias("variance")))
    found = out.agg(*aggs).select(F.explode(F.array(*each)).alias("e")).select("e.*")
    diff, half = F.col("auc1") - F.col("auc2"), 1.959963984540054 * F.sqrt("variance")
    z = F.when(F.col("variance") > 0, diff / F.sqrt("variance")).otherwise(0.0)
    return found.select("other", "auc1", "auc2", diff.alias("diff"), "variance", z.alias("z"), (diff - half).alias("ci_lo"), (diff + half).alias("ci_hi"))


def two_sided_p(z: float) -> tuple[float, float]:
    """Two-sided normal p value and ``-log10 p``; the latter stays finite where p underflows."""
    a = abs(z)
    p = math.erfc(a / math.sqrt(2))
    if p > 0:
        return p, -math.log10(p)
    return 0.0, (a * a / 2 + math.log(a) + 0.5 * math.log(math.pi / 2)) / math.log(10)


def significance(df: DataFrame, fused: str, paths: Sequence[str], y: str = "y", trace: str = "trace_id") -> DataFrame:
    """DeLong of the fused score against every path, on windows and on trace means, with p and -log10 p. Means are rounded to 12 digits, so
    that traces tie or not whatever the order in which their scores were added up."""
    means = df.groupBy(trace).agg(F.max(y).alias(y), *[F.round(F.avg(c), 12).alias(c) for c in (fused, *paths)])
    out = None
    for level, rows in (("window", df), ("trace", means)):
        one = delong_all(rows, fused, paths, y).withColumnRenamed("other", "path").select(F.lit(level).alias("level"), "*")
        out = one if out is None else out.unionByName(one)

    def add_p(it):
        for pdf in it:
            both = [two_sided_p(float(z)) for z in pdf["z"]]
            yield pdf.assign(p=[b[0] for b in both], neg_log10_p=[b[1] for b in both])

    return out.mapInPandas(add_p, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema) + ", p double, neg_log10_p double")


def family_tables(df: DataFrame, score: str = "score", y: str = "y", family: str = "family", limits: DataFrame | None = None) -> DataFrame:
    """Score tables of every attack family against the shared benign rows, as one table with a ``family`` column and a row
    for each score that some attack row of the family has: the metrics change nowhere else.

    One running sum over the benign scores serves all families. ``limits`` (``family``, ``limit``) keeps, per family, the
    rows whose ``rank`` is within the limit; a family then has at most as many benign rows as its limit."""
    rows = df.where(F.col(score).isNotNull())
    attack, benign = rows.where(F.col(y) == 1), rows.where(F.col(y) == 0)
    value = F.col(score).alias("score")
    by: list[str] = []
    if limits is None:
        below = benign.select(value)
    else:
        by = [family]
        attack = attack.join(limits, family).where(F.col("rank") <= F.col("limit"))
        each = limits.agg(F.array_agg(F.struct(family, "limit"))).scalar()  # one entry per family
        within = F.filter("_all", lambda e: e["limit"] >= F.col("rank"))
        below = benign.withColumn("_all", each).select(value, F.explode(within).alias("_e"))
        below = below.select("score", F.col(f"_e.{family}").alias(family))
    pos = ordering.cut(attack.groupBy(family, value).agg(F.count(F.lit(1)).alias("pos")))
    run = ordering.prefix_sum(pos, ["score"], {"cum_pos": "pos"}, by=[family], descending=True, totals={"P": "pos"})
    zero = F.lit(0).cast("bigint").alias("neg")
    at = below.groupBy(*by, "score").agg(F.count(F.lit(1)).alias("neg")).unionByName(pos.select(*by, "score", zero).distinct())
    counts = ordering.cut(at.groupBy(*by, "score").agg(F.sum("neg").alias("neg")))
    benign_run = ordering.prefix_sum(counts, ["score"], {"cum_neg": "neg"}, by=by, descending=True, totals={"N": "neg"})
    return run.join(benign_run, [*by, "score"]).select(family, "score", "pos", "neg", "cum_pos", "cum_neg", "P", "N")


def per_family(
    df: DataFrame, tau: float, score: str = "score", y: str = "y", family: str = "family", seed: int = 42, keys: Sequence[str] = ("trace_id", "w")
) -> DataFrame:
    """Metrics of each attack family against the shared benign rows: AUC, AP, AP at 1:1, F1 at ``score > tau``,
    TPR at FPR 1 % and 0.1 %, class sizes."""
    curve = all_metrics(family_tables(df, score, y, family), by=[family])
    attack, benign = df.where(F.col(y) == 1), df.where(F.col(y) == 0)
    ranked = ordering.hash_rank(attack, seed, list(keys), by=[family]).unionByName(ordering.hash_rank(benign, seed, list(keys)))
    n_benign = benign.agg(F.count(F.lit(1))).scalar()
    sizes = ordering.cut(attack.groupBy(family).agg(F.count(F.lit(1)).alias("limit")).withColumn("limit", F.least("limit", n_benign)))
    even = family_tables(ordering.cut(ranked), score, y, family, sizes)
    ap1 = average_precision(even, by=[family]).withColumnRenamed("ap", "ap_1to1")
    over = F.col(score) > tau
    hits = attack.groupBy(family).agg(F.sum(F.when(over, 1).otherwise(0)).alias("_tp"))
    fp = benign.agg(F.sum(F.when(over, 1).otherwise(0))).scalar()
    out = curve.join(ap1, family).join(hits, family)
    f1 = _ratio(2.0 * F.col("_tp"), F.col("_tp") + fp + F.col("n_pos"))
    return out.select(family, "auc", "ap", "ap_1to1", f1.alias("f1"), "tpr_fpr1", "tpr_fpr01", "n_pos", "n_neg")


def compare_models(df: DataFrame, models: Sequence[str], tau: dict[str, float], y: str = "y") -> DataFrame:
    """AUC, AP, F1 at each model's own threshold, best F1 and its threshold per score column."""
    long = df.select(F.col(y).alias("y"), F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score"), F.lit(float(tau[m])).alias("tau")) for m in models])).alias("m"))
    long = long.select("y", "m.*")
    curve = all_metrics(score_table(long, by=["model"]), by=["model"]).select("model", "auc", "ap", "best_f1", "best_tau")
    return curve.join(f1_at(long, F.col("tau"), ["model"]), "model")


def histogram(df: DataFrame, col: str, bins: int, cap: float = 0.99, y: str = "y") -> DataFrame:
    """Equal-width density histogram per class from the smallest value to the ``cap`` quantile of all rows; rows
    above it are left out, as the figure's axis ends there."""
    top, low = ordering.quantiles(df, col, {"_top": cap}).scalar(), df.agg(F.min(col)).scalar()
    rows = df.select(y, col, top.alias("_top"), low.alias("_low"))
    rows = rows.where((F.col(col) <= F.col("_top")) & (F.col("_top") > F.col("_low")))
    width = (F.col("_top") - F.col("_low")) / bins
    rows = rows.withColumn("_bin", F.least(F.floor((F.col(col) - F.col("_low")) / width), F.lit(bins - 1)).cast("int"))
    counts = rows.groupBy(y, "_bin").agg(F.count(F.lit(1)).alias("n"), F.max(width).alias("_w"))
    # bins rows per class.
    return counts.select(y, F.col("_bin").alias("bin"), "n", (F.col("n") / (F.sum("n").over(Window.partitionBy(y)) * F.col("_w"))).alias("density"))


def calibrate_rules(
    traces: DataFrame, defaults: dict[str, tuple[float, float, int]], max_fpr: float = 0.05, min_n: int = 30
) -> DataFrame:
    """Decision rule per length bucket over per-trace ``(bucket, y, prob_mean, pos_rate, max_consecutive)``: of all
    candidate rules the one with the highest TPR within the FPR limit, else the one with the lowest FPR, else the
    default when a bucket has too few traces.

    A rule fires when all three statistics reach its thresholds. Traces are reduced to cells between neighbouring
    candidate thresholds first, so the rules meet at most 15 * 15 * 11 cells per bucket and class."""
    # The quantile grid and the run lengths tried.
    grid = [0.50, 0.60, 0.70, 0.80, 0.85, 0.90, 0.92, 0.94, 0.95, 0.96, 0.97, 0.98, 0.99]
    lengths = [1, 2, 3, 4, 5, 6, 8, 10, 12]
    spark = traces.sparkSession
    base = spark.createDataFrame([(b, *v) for b, v in defaults.items()], "bucket string, d_prob double, d_rate double, d_run int")
    traces = ordering.cut(traces.join(F.broadcast(base.select("bucket")), "bucket"))
    names = {f"q{i}": q for i, q in enumerate(grid)}
    asked = lambda c: ordering.quantiles(traces, c, names, by=["bucket"]).select("bucket", F.array(*names).alias(f"_{c}"))
    cand = base.join(asked("prob_mean"), "bucket", "left").join(asked("pos_rate"), "bucket", "left")
    sizes = traces.groupBy("bucket").agg(
        F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("benign"),
        F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("attack"),
        F.max("max_consecutive").alias("_cap"),
    )
    runs = F.array_distinct(F.concat(F.array(*[F.lit(v) for v in lengths]), F.array("d_run")))
    cand = cand.join(sizes, "bucket", "left").select(
        "bucket", "d_prob", "d_rate", "d_run",
        F.coalesce("benign", F.lit(0)).alias("benign"), F.coalesce("attack", F.lit(0)).alias("attack"),
        F.array_sort(F.array_distinct(F.concat("_prob_mean", F.array("d_prob")))).alias("probs"),
        F.array_sort(F.array_distinct(F.concat("_pos_rate", F.array("d_rate")))).alias("rates"),
        F.array_sort(F.filter(runs, lambda r: r <= F.col("_cap"))).alias("runs"),
    )
    cand = cand.withColumn("runs", F.when(F.size("runs") > 0, F.col("runs")).otherwise(F.array(F.lit(1))))
    cand = ordering.cut(cand)
    # Index of the last candidate a statistic reaches; -1 below all of them.
    reach = lambda arr, c: F.size(F.filter(arr, lambda v: v <= F.col(c))) - 1
    cells = (
        traces.join(F.broadcast(cand), "bucket")
        .groupBy("bucket", "y", reach("probs", "prob_mean").alias("i"), reach("rates", "pos_rate").alias("j"), reach("runs", "max_consecutive").alias("k"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = cand.select("bucket", "benign", "attack", F.posexplode("probs").alias("i", "min_prob"), "rates", "runs")
    grid = grid.select("bucket", "benign", "attack", "i", "min_prob", F.posexplode("rates").alias("j", "min_rate"), "runs")
    grid = grid.select("bucket", "benign", "attack", "i", "min_prob", "j", "min_rate", F.posexplode("runs").alias("k", "min_run"))
    per_cell = cells.groupBy("bucket", "i", "j", "k").agg(
        *[F.sum(F.when(F.col("y") == c, F.col("n")).otherwise(0)).alias(n) for n, c in (("fp", 0), ("hit", 1))]
    )
    rated = grid.join(per_cell, ["bucket", "i", "j", "k"], "left").fillna(0, ["fp", "hit"])
    # A rule catches every cell at or above it: suffix sums along the three axes of the grid.
    for axis in ("i", "j", "k"):
        rest = [c for c in ("i", "j", "k") if c != axis]
        line = Window.partitionBy("bucket", *rest).orderBy(F.desc(axis)).rowsBetween(Window.unboundedPreceding, 0)
        rated = rated.withColumns({n: F.sum(n).over(line) for n in ("fp", "hit")})
    one = F.lit(1)
    rated = rated.withColumns({"fpr": F.col("fp") / F.greatest("benign", one), "tpr": F.col("hit") / F.greatest("attack", one)})
    low = [(-F.col(c)).alias(f"o_{c}") for c in ("min_prob", "min_rate", "min_run")]
    rule = [F.col(c) for c in ("min_prob", "min_rate", "min_run", "fpr", "tpr")]
    ok = F.max(F.when(F.col("fpr") <= max_fpr, F.struct(F.col("tpr").alias("a"), (-F.col("fpr")).alias("b"), *low, F.struct(*rule).alias("rule"))))
    fallback = F.max(F.struct((-F.col("fpr")).alias("a"), F.col("tpr").alias("b"), *low, F.struct(*rule).alias("rule")))
    best = rated.groupBy("bucket").agg(ok.alias("_ok"), fallback.alias("_fb"))
    enough = (F.col("benign") >= min_n) & (F.col("attack") > 0)
    out = cand.join(best, "bucket", "left")
    pick = lambda f, d: F.when(enough, F.coalesce(F.col(f"_ok.rule.{f}"), F.col(f"_fb.rule.{f}"))).otherwise(d)
    status = F.when(~enough, "too_few_samples").when(F.col("_ok").isNotNull(), "target_met").otherwise("target_not_met")
    return out.select(
        "bucket", "benign", "attack", status.alias("status"),
        pick("min_prob", F.col("d_prob")).alias("min_prob"), pick("min_rate", F.col("d_rate")).alias("min_rate"), pick("min_run", F.col("d_run")).alias("min_run"),
        pick("fpr", F.lit(None).cast("double")).alias("fpr"), pick("tpr", F.lit(None).cast("double")).alias("tpr"),
    )
