"""Seeded samples and splits. Every draw orders by an md5 of key and seed, so it is the same for any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqalert.operators import curves, ordering, windows as win


def _one() -> Column:
    return F.count(F.lit(1))


def sample_by_length(windows: DataFrame, n_strata: int, m: int, seed: int = 42) -> DataFrame:
    """Up to ``m`` windows from each trace-length stratum."""
    strata = win.length_strata(windows, n_strata).select("trace_id", "stratum")
    rows = windows.join(strata, "trace_id")
    return ordering.hash_rank(rows, seed, ["trace_id", "w"], by=["stratum"], at_most=m).drop("rank")


def transition_weights(windows: DataFrame) -> DataFrame:
    """Weight of a window: histogram intersection of its bigram shares and the corpus bigram shares."""
    windows = ordering.cut(windows.select("trace_id", "w", "win"))
    corpus = ordering.cut(win.bigram_counts(windows))
    # A common bigram is a hot key; up to the limit of shared tables nothing is shuffled for it.
    share = ordering.share(corpus.select("a", "b", (F.col("n") / corpus.agg(F.sum("n")).scalar()).alias("_corpus")))
    pairs = win.ngrams(windows, 2).select("trace_id", "w", F.element_at("state", 1).alias("a"), F.col("nxt").alias("b"))
    own = pairs.groupBy("trace_id", "w", "a", "b").agg(_one().alias("_n"))
    size = windows.select("trace_id", "w", (F.size("win") - 1).alias("_all"))
    rows = own.join(share, ["a", "b"]).join(size, ["trace_id", "w"])
    return rows.groupBy("trace_id", "w").agg(F.sum(F.least(F.col("_n") / F.col("_all"), F.col("_corpus"))).alias("weight"))


def sample_by_transition(windows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` windows without replacement, drawn in proportion to their transition weight (exponential keys)."""
    keyed = transition_weights(windows).withColumn("_hash", ordering.hash_key(seed, "trace_id", "w"))
    u = (F.conv(F.substring("_hash", 1, 12), 16, 10).cast("double") + 1) / F.lit(float(16**12 + 1))
    ranked = keyed.withColumn("_draw", -F.log(u) / F.col("weight"))
    placed = ordering.number_rows(ordering.cut(ranked), ["_draw", "_hash"], name="_place")
    chosen = placed.where(F.col("_place") < n).select("trace_id", "w", "weight")
    return windows.join(chosen, ["trace_id", "w"])


def sample_traces(windows: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """Whole traces in seeded order until ``size`` windows are reached; the next trace gives its first windows."""
    sizes = windows.groupBy("trace_id").agg(_one().alias("n"))
    ranked = ordering.cut(ordering.hash_rank(sizes, seed, ["trace_id"]))
    run = ordering.prefix_sum(ranked, ["rank"], {"_upto": "n"})
    share = run.select("trace_id", (F.lit(size) - (F.col("_upto") - F.col("n"))).alias("_left")).where(F.col("_left") > 0)
    # w is dense from 0, so the head of a trace is a range of w.
    return windows.join(share, "trace_id").where(F.col("w") < F.col("_left")).drop("_left")


def split_rows(df: DataFrame, fraction: float, seed: int = 42, keys: Sequence[str] = ("trace_id", "w")) -> DataFrame:
    """Add ``part``: ``calibration`` for the first ``fraction`` of the rows in seeded order, else ``test``."""
    ranked = ordering.hash_rank(df, seed, list(keys), total="_total")
    first = F.col("rank") <= F.floor(F.col("_total") * fraction)
    return ranked.withColumn("part", F.when(first, "calibration").otherwise("test")).drop("rank", "_total")


def eval_pool(scores: DataFrame, n: int, seed: int = 42, keys: Sequence[str] = ("trace_id", "w"), y: str = "y") -> DataFrame:
    """``n`` benign and ``n`` attack rows."""
    return ordering.hash_rank(scores, seed, list(keys), by=[y], at_most=n).drop("rank")


def pool_thresholds(pool: DataFrame, cols: Sequence[str], q: float = 0.95, y: str = "y") -> DataFrame:
    """Benign quantile of each score column as one row."""
    benign = pool.where(F.col(y) == 0)
    # One value per score column.
    long = benign.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("v")) for c in cols])).alias("_r")).select("_r.*")
    taus = ordering.quantiles(long, "v", {"tau": q}, by=["col"])
    return taus.agg(*[F.max(F.when(F.col("col") == c, F.col("tau"))).alias(c) for c in cols])


def balance(df: DataFrame, y: str = "y", keys: Sequence[str] = ("id",), seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """Seeded 1:1 subsample of the larger class."""
    by = list(by)
    ranked = ordering.hash_rank(df, seed, list(keys), by=[*by, y])
    sizes = df.groupBy(*by).agg(
        F.least(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)), F.sum(F.when(F.col(y) == 1, 0).otherwise(1))).alias("_m")
    )
    out = ranked.join(sizes, by) if by else ranked.withColumn("_m", sizes.scalar())
    return out.where(F.col("rank") <= F.col("_m")).drop("rank", "_m")


def _traces(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy("trace_id").agg(*[F.max(c).alias(c) for c in cols])


def split_traces(df: DataFrame, shares: tuple[float, float, float] = (0.6, 0.2, 0.2), seed: int = 42, y: str = "y") -> DataFrame:
    """Fold of every trace, drawn per class: floors for train and validation, the rest is test; each fold of the
    attack class gets at least one trace."""
    ranked = ordering.hash_rank(_traces(df, y), seed, ["trace_id"], by=[y], total="_t")
    low = F.when(F.col(y) == 1, 1).otherwise(0)
    train = F.greatest(F.floor(F.col("_t") * shares[0]), low)
    val = F.greatest(F.floor(F.col("_t") * shares[1]), low)
    fold = F.when(F.col("rank") <= train, "train").when(F.col("rank") <= train + val, "val").otherwise("test")
    return ranked.select("trace_id", y, fold.alias("fold"))


def split_groups(df: DataFrame, group: str = "trace_id", test: float = 0.4, seed: int = 42) -> DataFrame:
    """Grouped split: ``ceil(test * groups)`` groups form the test side."""
    ranked = ordering.hash_rank(df.select(group).distinct(), seed, [group], total="_t")
    held = F.col("rank") <= F.ceil(F.col("_t") * test)
    return ranked.select(group, F.when(held, "test").otherwise("train").alias("part"))


def holdout_traces(df: DataFrame, ratio: float = 0.5, seed: int = 42, y: str = "y") -> DataFrame:
    """Calibration traces per class: the rounded share, at least one and never all."""
    ranked = ordering.hash_rank(_traces(df, y), seed, ["trace_id"], by=[y], total="_t")
    n = F.greatest(F.lit(1), F.least(F.col("_t") - 1, F.round(F.col("_t") * ratio)))
    return ranked.select("trace_id", F.when(F.col("rank") <= n, "calibration").otherwise("test").alias("part"))


def holdout(df: DataFrame, ratio: float = 0.5, seed: int = 42, score: str = "score", y: str = "y") -> DataFrame:
    """Threshold of best F1 on the calibration traces and the confusion record of the others at it."""
    parts = ordering.cut(df.join(holdout_traces(df, ratio, seed, y), "trace_id"))
    tau = curves.best_f1(curves.score_table(parts.where(F.col("part") == "calibration"), score, y)).select("tau").scalar()
    return curves.confusion(parts.where(F.col("part") == "test"), tau, score=score, y=y).withColumn("tau", tau)


def trace_folds(df: DataFrame, k: int, seed: int = 42, name: str = "fold", by: Sequence[str] = ()) -> DataFrame:
    """Fold 1..k of every trace in seeded order; the first folds take one more trace when they do not divide evenly."""
    ranked = ordering.hash_rank(df.select(*by, "trace_id").distinct(), seed, ["trace_id"], by=by, total="_t")
    q, r, at = F.expr(f"_t div {k}"), F.col("_t") % k, F.col("rank") - 1
    head = r * (q + 1)
    fold = F.when(at < head, F.floor(at / (q + 1))).otherwise(r + F.floor((at - head) / F.greatest(q, F.lit(1))))
    return ranked.select(*by, "trace_id", (fold + 1).cast("int").alias(name))


def nested_cv(df: DataFrame, variants: Sequence[str], outer: int = 5, inner: int = 3, seed: int = 42, y: str = "y") -> DataFrame:
    """Nested trace folds over score columns ``variants``: inside each outer training side the inner folds rank the
    variants and give the median threshold; the outer test side is judged with them. All folds run as one plan over
    a long table ``(outer, inner, variant)``.

    Folds only decide which score-table counts are added up, so every row is read once per side, not per fold."""
    outer_of = trace_folds(df, outer, seed, "outer_fold")
    rows = df.join(outer_of, "trace_id")
    # An outer training side is all folds but one: each trace joins outer - 1 of them.
    sides = F.array_remove(F.sequence(F.lit(1), F.lit(outer)), F.col("outer_fold"))
    train_traces = outer_of.select("trace_id", F.explode(sides).alias("outer"))
    inner_of = trace_folds(train_traces, inner, seed + 1, "inner", by=["outer"])
    long = lambda d, *keep: d.select(*keep, F.col(y).alias("y"), F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("score")) for v in variants])).alias("_v")).select(*keep, "y", "_v.*")
    trained = long(df.join(inner_of, "trace_id"), "outer", "inner")
    trained = ordering.cut(trained.groupBy("outer", "inner", "variant", "score", "y").agg(_one().alias("n")))
    # Threshold from the other inner folds, judged on the held one.
    held_out = F.array_remove(F.sequence(F.lit(1), F.lit(inner)), F.col("inner"))
    fit = trained.select("outer", F.explode(held_out).alias("inner"), "variant", "score", "y", "n")
    key = ["outer", "inner", "variant"]
    taus = curves.best_f1(_counted_table(fit, key), by=key).select(*key, "tau")
    judged = _counted_table(trained, key)
    f1 = trained.join(taus, key).groupBy(*key).agg(_f1_counted())
    inner_rows = curves.roc_auc(judged, by=key).join(f1, key).join(taus, key)
    ranked = rank_variants(inner_rows)
    chosen = ranked.where(F.col("place") == 1).select(F.col("outer").alias("outer_fold"), "variant", "tau")
    tested = long(rows, "outer_fold").join(chosen, ["outer_fold", "variant"])
    counted = ordering.cut(tested.groupBy("outer_fold", "variant", "tau", "score", "y").agg(_one().alias("n")))
    key = ["outer_fold", "variant", "tau"]
    auc = curves.roc_auc(_counted_table(counted, key), by=key)
    return auc.join(counted.groupBy(*key).agg(_f1_counted()), key)


def _counted_table(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Score table from rows that already stand for ``n`` equal rows."""
    table = counts.groupBy(*by, "score").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 1, 0).otherwise(F.col("n"))).alias("neg")
    )
    return ordering.prefix_sum(
        ordering.cut(table), ["score"], {"cum_pos": "pos", "cum_neg": "neg"}, by=by, descending=True, totals={"P": "pos", "N": "neg"}
    )


def _f1_counted() -> Column:
    on, pos = F.col("score") >= F.col("tau"), F.col("y") == 1
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    tp, wrong = n(on & pos), n(on & ~pos) + n(~on & pos)
    return F.when(2 * tp + wrong == 0, 0.0).otherwise(2 * tp / (2 * tp + wrong)).alias("f1")


def rank_variants(inner_rows: DataFrame) -> DataFrame:
    """Variants of each outer fold by mean F1, mean AUC, small F1 spread, name; with the median threshold."""
    # One row per inner fold: a handful per group.
    per = inner_rows.groupBy("outer", "variant").agg(
        F.avg("f1").alias("mean_f1"), F.avg("auc").alias("mean_auc"), F.stddev_pop("f1").alias("std_f1"), F.median("tau").alias("tau")
    )
    order = Window.partitionBy("outer").orderBy(F.desc("mean_f1"), F.desc("mean_auc"), F.asc("std_f1"), F.asc("variant"))
    return per.withColumn("place", F.row_number().over(order))


def fold_summary(rows: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation, minimum and maximum of each metric over the finite values of the folds."""
    parts = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics]
    long = rows.select(*by, F.explode(F.array(*parts)).alias("_m")).select(*by, "_m.*")
    finite = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf"))
    return long.where(finite).groupBy(*by, "metric").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), _one().alias("n")
    )


def sample_manifest(files: DataFrame, benign_fraction: float, attack_fraction: float, seed: int = 42) -> DataFrame:
    """Manifest of a seeded file sample from ``files(sample_id, source_group, family, source_file)``; benign files have
    no family. The benign pool keeps the floor of its share; each family keeps the floor of its own, spread over its
    directories by largest remainder."""
    benign = ordering.hash_rank(files.where(F.col("family").isNull()), seed, ["source_file"], total="_t")
    benign = benign.where(F.col("rank") <= F.floor(F.col("_t") * benign_fraction)).drop("_t", "rank")
    attack = files.where(F.col("family").isNotNull())
    # One row per directory.
    dirs = attack.groupBy("family", "source_group").agg(_one().alias("n"))
    ideal = F.col("n") * attack_fraction
    dirs = dirs.withColumn("_base", F.least(F.col("n"), F.floor(ideal))).withColumn("_rest", ideal - F.col("_base"))
    fam = Window.partitionBy("family")
    keep = F.floor(F.sum("n").over(fam) * attack_fraction) - F.sum("_base").over(fam)
    spare = (F.col("_base") < F.col("n")).cast("int")
    place = F.row_number().over(fam.orderBy(F.desc(spare), F.desc("_rest"), F.asc("source_group")))
    dirs = dirs.withColumn("_keep", keep).withColumn("_place", place).withColumn("_spare", spare)
    quota = F.col("_base") + F.when((F.col("_place") <= F.col("_keep")) & (F.col("_spare") == 1), 1).otherwise(0)
    dirs = dirs.select(F.col("family").alias("_f"), F.col("source_group").alias("_g"), quota.alias("_quota"))
    ranked = ordering.hash_rank(attack, seed, ["source_file"], by=["family", "source_group"])
    chosen = ranked.join(dirs, (F.col("family") == F.col("_f")) & (F.col("source_group") == F.col("_g")))
    chosen = chosen.where(F.col("rank") <= F.col("_quota")).select(files.columns)
    both = benign.select(files.columns).unionByName(chosen)
    return both.select(
        "sample_id",
        F.when(F.col("family").isNull(), "benign_control").otherwise("malware_targeted").alias("intended_label"),
        F.col("family").alias("target_preset"),
        "source_group",
        "source_file",
        F.col("source_file").alias("expected_detect_file"),
    )


def split_by_domain(files: DataFrame, fraction: float = 0.2, seed: int = 42, domain: str = "domain", key: str = "path") -> DataFrame:
    """The first ``fraction`` of each domain's files in seeded order trains, the rest validates."""
    ranked = ordering.hash_rank(files, seed, [key], by=[domain], total="_t")
    train = F.col("rank") <= F.floor(F.col("_t") * fraction)
    return ranked.withColumn("part", F.when(train, "train").otherwise("val")).drop("rank", "_t")
