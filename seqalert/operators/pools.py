"""Analytics over an evaluation pool of scored windows ``(trace_id, w, family, y, path_a, path_b, path_c, prob)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqalert.operators import curves, ordering


def _count(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def _flag(score: str, tau: float | Column, strict: bool) -> Column:
    tau = F.lit(float(tau)) if isinstance(tau, (int, float)) else tau
    return F.col(score) > tau if strict else F.col(score) >= tau


def trace_fraction(scores: DataFrame, tau: float | Column, score: str = "prob", strict: bool = False) -> DataFrame:
    """Share of anomalous windows and label per trace."""
    on = _flag(score, tau, strict)
    return scores.groupBy("trace_id").agg(F.avg(on.cast("int")).alias("fraction"), F.max("y").alias("y"), F.count(F.lit(1)).alias("n_windows"))


def trace_means(scores: DataFrame, score: str = "prob") -> DataFrame:
    return scores.groupBy("trace_id").agg(F.avg(score).alias("mean_score"), F.max("y").alias("y"))


def detection_rates(scores: DataFrame, tau: float | Column, score: str = "prob", strict: bool = True) -> DataFrame:
    """Per family and in total: traces, detected traces, windows, flagged windows, both rates, and median, P10 and
    P90 of the flagged share per trace."""
    per_trace = ordering.cut(
        scores.groupBy("family", "trace_id").agg(F.count(F.lit(1)).alias("n"), _count(_flag(score, tau, strict)).alias("flagged"))
    ).withColumn("share", F.col("flagged") / F.col("n"))
    out = per_trace.rollup("family").agg(
        F.count(F.lit(1)).alias("n_traces"), _count(F.col("flagged") > 0).alias("detected_traces"),
        F.sum("n").alias("total_windows"), F.sum("flagged").alias("flagged_windows"),
        F.grouping_id().alias("_g"),
    ).withColumn("family", F.when(F.col("_g") > 0, F.lit("TOTAL")).otherwise(F.col("family")))
    asked = {"median_per_trace": 0.5, "p10_per_trace": 0.1, "p90_per_trace": 0.9}
    spread = ordering.quantiles(per_trace, "share", asked, by=["family"])
    spread = spread.withColumn("_g", F.lit(0))
    every = ordering.quantiles(per_trace, "share", asked).select(F.lit("TOTAL").alias("family"), *asked, F.lit(1).alias("_g"))
    rates = out.withColumns(
        {"trace_dr": F.col("detected_traces") / F.col("n_traces"), "window_dr": F.col("flagged_windows") / F.col("total_windows")}
    )
    spread = spread.unionByName(every).withColumnsRenamed({"family": "_f", "_g": "_h"})
    # Rows without a family are a row of their own.
    return rates.join(spread, rates["family"].eqNullSafe(spread["_f"]) & (rates["_g"] == spread["_h"])).drop("_f", "_g", "_h")


def decision_rules(scores: DataFrame, tau: float, score: str = "prob") -> DataFrame:
    """Episode recall and false-alert rate of six rules that ignore the order of an episode's windows."""
    per = scores.groupBy("trace_id").agg(
        _count(F.col(score) >= tau).alias("n_pos"), F.avg((F.col(score) >= tau).cast("int")).alias("rate"),
        F.avg(score).alias("mean"), (F.avg("y") >= 0.5).cast("int").alias("y"),
    )
    # Names and limits of the rules.
    rules = {
        "single_threshold_any": F.col("n_pos") >= 1,
        "count_2_positive": F.col("n_pos") >= 2,
        "count_3_positive": F.col("n_pos") >= 3,
        "fraction_30pct": F.col("rate") >= 0.30,
        "fraction_60pct": F.col("rate") >= 0.60,
        "mean_proba_ge_tau": F.col("mean") >= tau,
    }
    fired = F.array(*[F.struct(F.lit(k).alias("rule"), v.cast("int").alias("fired")) for k, v in rules.items()])
    long = per.select("y", F.explode(fired).alias("_r")).select("y", "_r.*")
    return long.groupBy("rule").agg(
        F.avg(F.when(F.col("y") == 1, F.col("fired"))).alias("episode_recall"), F.avg(F.when(F.col("y") == 0, F.col("fired"))).alias("false_alert_rate")
    )


def describe_scores(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Minimum, maximum, mean, population deviation and span of each score column."""
    parts = F.array(*[F.struct(F.lit(c).alias("score"), F.col(c).alias("v")) for c in cols])
    long = df.select(*by, F.explode(parts).alias("_s")).select(*by, "_s.*")
    return long.groupBy(*by, "score").agg(
        F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
        (F.max("v") - F.min("v")).alias("span"),
    )


def span_ratio(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Largest score span divided by the smallest."""
    spans = describe_scores(df, cols)
    return spans.agg((F.max("span") / F.greatest(F.min("span"), F.lit(1e-12))).alias("heterogeneity_ratio"))


def rank_correlation(df: DataFrame, cols: Sequence[str] = ("path_a", "path_b", "path_c"), y: str = "y") -> DataFrame:
    """Correlation of percentile ranks on benign rows for each pair of columns."""
    pct = curves.rank_percentile(ordering.cut(df.where(F.col(y) == 0).select(*cols)), cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    return pct.agg(*[F.corr(f"{a}_pct", f"{b}_pct").alias(f"corr_{a}_{b}") for a, b in pairs])


def rescue_count(df: DataFrame, a: str, others: Sequence[str], lo: float = 0.90, hi: float = 0.95) -> DataFrame:
    """Rows that score ``a`` ranks below ``lo`` while another score ranks them above ``hi``."""
    pct = curves.rank_percentile(ordering.cut(df.select(a, *others)), [a, *others])
    caught = F.lit(False)
    for o in others:
        caught = caught | (F.col(f"{o}_pct") > hi)
    return pct.agg(_count((F.col(f"{a}_pct") < lo) & caught).alias("rescued"), F.count(F.lit(1)).alias("n"))


def patterns(df: DataFrame, flags: Sequence[str] = ("fa", "fb", "fc")) -> DataFrame:
    """Rows per combination of three detector flags, code ``4a + 2b + c``."""
    a, b, c = (F.col(f).cast("int") for f in flags)
    counts = df.groupBy((4 * a + 2 * b + c).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    codes = df.sparkSession.range(8).select(F.col("id").cast("int").alias("pattern"))
    # Eight rows.
    out = codes.join(counts, "pattern", "left").fillna(0, ["n"])
    return out.select("pattern", "n", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("share"))


def pattern_summary(df: DataFrame, flags: Sequence[str] = ("fa", "fb", "fc")) -> DataFrame:
    """Union, none, all three, at least two, missed by the first but caught, and the count of at least two that
    independent detectors would give."""
    a, b, c = (F.col(f).cast("int") for f in flags)
    s = a + b + c
    out = df.agg(
        F.count(F.lit(1)).alias("n_total"), _count(s > 0).alias("total_detected"), _count(s == 0).alias("none_detected"), _count(s == 3).alias("all_three"),
        _count(s >= 2).alias("at_least_two"), _count((a == 0) & ((b == 1) | (c == 1))).alias("first_missed_others_caught"),
        F.avg(a).alias("p_a"), F.avg(b).alias("p_b"), F.avg(c).alias("p_c"),
    )
    pa, pb, pc = F.col("p_a"), F.col("p_b"), F.col("p_c")
    exp = (pa * pb + pa * pc + pb * pc - 2 * pa * pb * pc) * F.col("n_total")
    return out.withColumn("expected_at_least_two", exp).withColumn("observed_vs_expected", F.col("at_least_two") / F.greatest(exp, F.lit(1.0)))


def path_recall(df: DataFrame, thresholds: DataFrame, cols: Sequence[str] = ("path_a", "path_b", "path_c")) -> DataFrame:
    """Window recall per family and path, by any path and missed by all; the row ``BENIGN`` holds the false-alert
    rates. ``thresholds`` is one row with a column per path."""
    tau = thresholds.select(F.struct(*cols)).scalar()
    rows = df.withColumn("_tau", tau)
    flags = {c: (F.col(c) >= F.col(f"_tau.{c}")).cast("int") for c in cols}
    rows = rows.select(F.when(F.col("y") == 1, F.col("family")).otherwise("BENIGN").alias("family"), *[f.alias(c) for c, f in flags.items()])
    some = F.greatest(*cols)
    return rows.groupBy("family").agg(
        F.count(F.lit(1)).alias("n_windows"), *[F.avg(c).alias(f"rate_{c}") for c in cols], F.avg(some).alias("rate_any"), (1 - F.avg(some)).alias("missed_by_all")
    )


def majority(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent value, ties by name."""
    counts = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.min_by(F.struct(col, "n"), F.struct((-F.col("n")).alias("o"), F.col(col).alias("v"))).alias("_b")).select(*by, "_b.*")


def class_weight(df: DataFrame, y: str = "y") -> DataFrame:
    """Positive-class weight ``benign / max(1, attack)``."""
    return df.agg((_count(F.col(y) == 0) / F.greatest(F.lit(1), _count(F.col(y) == 1))).alias("weight"))


def best_balance(results: DataFrame, model: str = "model") -> DataFrame:
    """Best configuration per model by the sum of min-max normalized AUC and F1; ties by configuration."""
    per = Window.partitionBy(model)
    norm = lambda c: F.coalesce(F.try_divide(F.col(c) - F.min(c).over(per), F.max(c).over(per) - F.min(c).over(per)), F.lit(0.0))
    # A sweep has tens of configurations per model.
    scored = results.withColumn("balance", norm("auc") + norm("f1"))
    best = scored.groupBy(model).agg(F.min_by(F.struct("config", "auc", "f1", "balance"), F.struct((-F.col("balance")).alias("o"), "config")).alias("_b"))
    return best.select(model, "_b.*")


def best_model(metrics: DataFrame) -> DataFrame:
    """Model with the highest AUC, then F1, then the first name."""
    return metrics.agg(F.min_by(F.struct("model", "auc", "f1"), F.struct((-F.col("auc")).alias("a"), (-F.col("f1")).alias("f"), "model")).alias("_b")).select("_b.*")


def macro_average(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return rows.agg(*[F.avg(m).alias(m) for m in metrics])


def ppv(fractions: DataFrame, theta: float, base_rates: Sequence[float] = (0.01, 0.001)) -> DataFrame:
    """Trace TPR and FPR when the anomalous share reaches ``theta``, and the precision expected at each base rate."""
    on, pos = F.col("fraction") >= theta, F.col("y") == 1
    eps = 1e-8
    out = fractions.agg(
        (_count(on & pos) / (_count(pos) + eps)).alias("tpr"), (_count(on & ~pos) / (_count(~pos) + eps)).alias("fpr")
    )
    rates = F.explode(F.array(*[F.lit(float(b)) for b in base_rates])).alias("base_rate")
    b = F.col("base_rate")
    return out.select("tpr", "fpr", rates).withColumn("ppv", F.col("tpr") * b / (F.col("tpr") * b + F.col("fpr") * (1 - b) + eps))
