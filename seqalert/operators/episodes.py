"""Episodes: joining scores to manifests, ground-truth segments, per-episode timing and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqalert.functions.columns import canonical_path, path_stem
from seqalert.operators import alerts, ordering

ATTACK = "malware_targeted"


def first_by_key(df: DataFrame, key: str | Column, order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``. Written as an aggregate, so copies of one key are thinned out
    before the shuffle."""
    key = F.col(key) if isinstance(key, str) else key
    row = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(key.alias("_k")).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def last_by_key(df: DataFrame, key: str | Column, order: Sequence[Column]) -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    row = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(key.alias("_k")).agg(F.max_by(row, F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def usable_scores(scores: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Score rows that have windows and a manifest entry, and the counts of those left out."""
    joined = join_manifest(scores, manifest)
    short = F.col("n_windows") == 0
    lost = F.col("intended_label").isNull()
    counts = joined.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.when(short, 1).otherwise(0)).alias("skipped_too_short"),
        F.sum(F.when(~short & lost, 1).otherwise(0)).alias("unmatched"),
    )
    return joined.where(~short & ~lost), counts


def join_manifest(scores: DataFrame, manifest: DataFrame) -> DataFrame:
    """Score rows with their manifest entry: by canonical path, else by file stem."""
    path = F.coalesce("expected_detect_file", "source_file")
    cols = ["intended_label", "target_preset", "source_file"]
    by_path = manifest.select(canonical_path(path).alias("_path"), F.struct(*cols).alias("_by_path"), "sample_id")
    by_path = last_by_key(by_path, "_path", [F.col("sample_id")]).drop("sample_id")
    by_stem = manifest.select(F.col("sample_id").alias("_stem"), F.struct(*cols).alias("_by_stem"), path.alias("_p"))
    by_stem = last_by_key(by_stem, "_stem", [F.col("_p")]).drop("_p")
    keyed = scores.withColumn("_path", canonical_path(F.col("file"))).withColumn("_stem", path_stem(F.col("file")))
    out = keyed.join(by_path, "_path", "left").join(by_stem, "_stem", "left")
    hit = F.coalesce("_by_path", "_by_stem")
    return out.select(*scores.columns, *[hit.getField(c).alias(c) for c in cols])


def join_scores(episodes: DataFrame, scores: DataFrame, order: Sequence[Column] | None = None) -> DataFrame:
    """Episodes with their score row ``(file, ...)``: by ``score_file``, else by ``source_file``; of several score rows
    with one path the last counts. Unmatched episodes keep NULLs."""
    cols = [c for c in scores.columns if c != "file"]
    one = last_by_key(scores.withColumn("_path", canonical_path(F.col("file"))), "_path", order or [F.col("file")])
    one = one.select("_path", F.struct("file", *cols).alias("_score"))
    a = one.select(F.col("_path").alias("_p1"), F.col("_score").alias("_s1"))
    b = one.select(F.col("_path").alias("_p2"), F.col("_score").alias("_s2"))
    keyed = episodes.withColumn("_p1", canonical_path(F.col("score_file"))).withColumn("_p2", canonical_path(F.col("source_file")))
    out = keyed.join(a, "_p1", "left").join(b, "_p2", "left")
    hit = F.coalesce("_s1", "_s2")
    return out.select(*episodes.columns, hit.getField("file").alias("matched_file"), *[hit.getField(c).alias(f"score_{c}") for c in cols])


def missing_scores(episodes: DataFrame, scores: DataFrame) -> DataFrame:
    """Episodes that no score row matches."""
    paths = scores.select(canonical_path(F.col("file")).alias("_path")).distinct()
    out = episodes.join(paths, canonical_path(F.col("score_file")) == F.col("_path"), "left_anti")
    out = out.join(paths, canonical_path(F.col("source_file")) == F.col("_path"), "left_anti")
    return out.select("episode_id", "score_file", "source_file")


def resolve_onset(episodes: DataFrame, onset: DataFrame, base: tuple[float, float]) -> DataFrame:
    """Attack fractions of each episode: its family's, else the default row (``family`` NULL), else ``base``; benign
    episodes take ``base``."""
    fam = onset.where(F.col("family").isNotNull()).select(
        F.col("family").alias("_f"), F.struct(F.col("onset"), F.col("end")).alias("_own")
    )
    default = onset.where(F.col("family").isNull()).agg(F.max(F.struct("onset", "end"))).scalar()
    out = episodes.join(fam, F.col("attack_family") == F.col("_f"), "left").withColumn("_default", default)
    is_attack = F.col("intended_label") == ATTACK
    pick = lambda f, b: F.when(is_attack, F.coalesce(F.col(f"_own.{f}"), F.col(f"_default.{f}"), F.lit(float(b)))).otherwise(float(b))
    return out.select(
        *episodes.columns, pick("onset", base[0]).alias("onset_fraction"), pick("end", base[1]).alias("end_fraction"),
        F.col("_own").isNotNull().alias("override_used"),
    )


def build_segments(episodes: DataFrame, mode: str = "prefix_attack_suffix") -> DataFrame:
    """Add ``ground_truth_segments`` from ``n_windows``, the label and the two fractions of ``resolve_onset``."""
    n, last = F.col("n_windows"), F.col("n_windows") - 1
    seg = lambda label, a, b: F.struct(F.lit(label).alias("label"), a.cast("bigint").alias("start_window"), b.cast("bigint").alias("end_window"))
    zero = F.lit(0)
    start = F.least(last, F.greatest(F.lit(1), F.floor(n * F.col("onset_fraction"))))
    end = F.least(last, F.greatest(start, F.floor(n * F.col("end_fraction")) - 1))
    parts = F.array(seg("benign", zero, start - 1), seg("attack", start, end), seg("benign", end + 1, last))
    parts = F.filter(parts, lambda s: s["end_window"] >= s["start_window"])
    whole = F.lit(mode == "full_file_label") | (last == 0)
    empty = F.filter(parts, lambda s: F.lit(False))
    out = (
        F.when(n <= 0, empty)
        .when(F.col("intended_label") != ATTACK, F.array(seg("benign", zero, last)))
        .when(whole, F.array(seg("attack", zero, last)))
        .otherwise(parts)
    )
    return episodes.withColumn("ground_truth_segments", out)


def attack_ranges(episodes: DataFrame) -> DataFrame:
    """Clamped attack ranges of each episode with the first start and the end of the last-starting range."""
    n = F.col("n_windows")
    clamp = lambda c: F.greatest(F.lit(0), F.least(n - 1, c))
    raw = F.filter("ground_truth_segments", lambda s: (F.lower(s["label"]) == "attack") & s["start_window"].isNotNull() & s["end_window"].isNotNull())
    ranges = F.transform(raw, lambda s: F.struct(clamp(s["start_window"]).alias("start"), clamp(s["end_window"]).alias("end")))
    ranges = F.array_sort(F.filter(ranges, lambda r: (r["end"] >= r["start"]) & (n > 0)))
    out = episodes.withColumn("_ranges", ranges)
    some = F.size("_ranges") > 0
    return out.withColumns(
        {
            "attack_start": F.when(some, F.col("_ranges")[0]["start"]),
            "attack_end": F.when(some, F.element_at("_ranges", -1)["end"]),
        }
    )


def attack_mask(windows: DataFrame, episodes: DataFrame, key: str = "episode_id", size: int = ordering.CHUNK) -> DataFrame:
    """Windows with ``in_attack`` and the attack bounds. The few episode columns are repeated per chunk of windows, so
    the join spreads a long episode over its chunks."""
    slim = attack_ranges(episodes).select(
        key, "attack_start", "attack_end", "_ranges",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"greatest(0, n_windows - 1) div {size}"))).alias("_chunk"),
    )
    chunked = windows.withColumn("_chunk", F.expr(f"w div {size}"))
    joined = chunked.join(slim, [key, "_chunk"])
    inside = F.exists("_ranges", lambda r: (F.col("w") >= r["start"]) & (F.col("w") <= r["end"]))
    return joined.withColumn("in_attack", inside).drop("_ranges", "_chunk")


def episode_results(timeline: DataFrame, episodes: DataFrame, key: str = "episode_id", tau: float | None = None, size: int = ordering.CHUNK) -> DataFrame:
    """One row of timing measures per episode from ``timeline(key, w, alert, was_alert)`` and
    ``episodes(key, score_file, intended_label, attack_family, n_windows, ground_truth_segments)``.

    The alert segments themselves are rows of ``alerts.segments(timeline, 'alert')``."""
    if "was_alert" not in timeline.columns:
        # One repeated row per chunk supplies the window before its first.
        halo = ordering.with_halo(timeline.select(key, "w", "alert"), "w", 1, size)
        was = F.coalesce(F.lag("alert").over(Window.partitionBy(key, "_chunk").orderBy("w")), F.lit(False))
        timeline = halo.withColumn("was_alert", was).where("_own")
    # A segment starts where the window before it has no alert.
    rows = attack_mask(timeline.select(key, "w", "alert", F.col("was_alert").alias("_prev")), episodes, key, size)
    on, w = F.col("alert"), F.col("w")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    start, end = F.col("attack_start"), F.col("attack_end")
    agg = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.min(F.when(on, w)).alias("first_alert_window"),
        F.min(F.when(on & F.col("in_attack"), w)).alias("first_alert_inside_attack_window"),
        count(on & F.col("in_attack")).alias("alert_time_inside_attack"),
        count(on & (w < start)).alias("alert_time_before_attack"),
        count(on & (w > end)).alias("alert_time_after_attack"),
        count(on).alias("alert_duration_windows_total"),
        count(on & ~F.col("_prev")).alias("alert_segment_count"),
        count(~on & F.col("_prev") & (w - 1 < start)).alias("_ended_before"),
        count(F.col("in_attack")).alias("window_attack_count"),
        F.min(F.when(~on & (w > end), w)).alias("_first_clear"),
        F.max(w).alias("_last"),
        F.max(F.when(w == end, on)).alias("_on_at_end"),
    )
    # The label and bounds come from the episode table again: text in an aggregate would force a sort.
    meta = attack_ranges(episodes).select(
        key, "score_file", "intended_label", "attack_family", F.col("n_windows").alias("declared_n_windows"),
        F.col("attack_start").alias("attack_start_window"), F.col("attack_end").alias("attack_end_window"),
    )
    agg = agg.join(meta, key)
    has = F.coalesce(F.col("intended_label") == ATTACK, F.lit(False))
    inside = F.col("first_alert_inside_attack_window")
    agg = agg.withColumn("has_attack_segment", has).withColumn("detected", has & inside.isNotNull())
    delay = F.when(F.col("detected"), F.greatest(F.lit(0), inside - F.col("attack_start_window")))
    agg = agg.withColumn("detection_delay_windows", delay)
    within = lambda k: F.coalesce(F.col("detected") & (F.col("detection_delay_windows") <= k), F.lit(False))
    false_alert = F.when(has, F.col("alert_time_before_attack") > 0).otherwise(F.col("alert_duration_windows_total") > 0)
    recovery = F.when(F.col("attack_end_window").isNull() | (F.col("attack_end_window") >= F.col("_last")), None).otherwise(
        F.when(~F.col("_on_at_end"), F.lit(0)).otherwise(F.coalesce("_first_clear", F.col("_last") + 1) - F.col("attack_end_window") - 1)
    )
    return agg.select(
        key, "score_file", "attack_family", "intended_label", "n_windows", "declared_n_windows", "has_attack_segment",
        (F.col("window_attack_count") > 0).alias("has_attack_window_range"),
        "attack_start_window", "attack_end_window", "detected", "first_alert_window", "first_alert_inside_attack_window",
        "detection_delay_windows", within(5).alias("detected_within_5_windows"), within(10).alias("detected_within_10_windows"),
        within(20).alias("detected_within_20_windows"), "alert_time_inside_attack", "alert_time_before_attack", "alert_time_after_attack",
        (F.col("alert_time_before_attack") > 0).alias("false_alert_before_attack"), false_alert.alias("had_false_alert"),
        F.when(false_alert, F.col("first_alert_window")).alias("first_false_alert_window"),
        F.when(has, F.col("_ended_before")).otherwise(F.col("alert_segment_count")).alias("false_alert_count"),
        F.when(has, F.col("alert_time_before_attack")).otherwise(F.col("alert_duration_windows_total")).alias("false_alert_duration_windows"),
        "alert_duration_windows_total", "alert_segment_count",
        F.greatest(F.lit(0), F.col("alert_segment_count") - 1).alias("alert_flicker_count"),
        recovery.cast("bigint").alias("recovery_delay_after_attack_end"), F.lit(tau).cast("double").alias("policy_tau"),
        F.col("alert_time_inside_attack").alias("window_true_alert_count"), F.col("alert_duration_windows_total").alias("window_alert_count"),
        "window_attack_count",
    )


def recovery_delay(timeline: DataFrame, episodes: DataFrame, key: str = "episode_id") -> DataFrame:
    """Windows from the end of the attack until the alert is gone; NULL when the stream ends with the attack."""
    return episode_results(timeline, episodes, key).select(key, "recovery_delay_after_attack_end")


def evaluate(scores: DataFrame, episodes: DataFrame, policy: alerts.Policy, key: str = "episode_id", size: int = ordering.CHUNK) -> DataFrame:
    """Episode results straight from window scores ``(key, w, prob)``."""
    timeline = alerts.alert_timeline(scores, policy, [key], size=size)
    return episode_results(timeline, episodes, key, policy.tau, size)


def family_realtime(results: DataFrame) -> DataFrame:
    """Recall, recall within 5/10/20 windows, delay median and P90, pre-attack false-alert rate per attack family."""
    rows = results.where("has_attack_segment").withColumn("attack_family", F.coalesce(F.nullif(F.col("attack_family"), F.lit("")), F.lit("UNKNOWN")))
    rows = ordering.cut(rows)
    rate = lambda c: F.avg(F.col(c).cast("int"))
    out = rows.groupBy("attack_family").agg(
        F.count(F.lit(1)).alias("attack_episodes"),
        rate("detected").alias("episode_recall"),
        rate("detected_within_5_windows").alias("recall_within_5_windows"),
        rate("detected_within_10_windows").alias("recall_within_10_windows"),
        rate("detected_within_20_windows").alias("recall_within_20_windows"),
        rate("false_alert_before_attack").alias("false_alert_before_attack_rate"),
    )
    delays = ordering.quantiles(
        rows, "detection_delay_windows", {"median_detection_delay_windows": 0.5, "p90_detection_delay_windows": 0.9}, by=["attack_family"]
    )
    return out.join(delays, "attack_family", "left")


def realtime_summary(results: DataFrame, missing: int | Column = 0, total: int | Column | None = None) -> DataFrame:
    """Sixteen measures over all episodes as one row; a ratio over nothing is NULL."""
    results = ordering.cut(results)
    has = F.col("has_attack_segment")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    total_of = lambda c, cond=None: F.sum(F.col(c) if cond is None else F.when(cond, F.col(c)).otherwise(0))
    delays = ordering.quantiles(results.where(has), "detection_delay_windows", {"m": 0.5, "p": 0.9}).select(F.struct("m", "p")).scalar()
    a = results.agg(
        F.count(F.lit(1)).alias("episodes_evaluated"),
        count(F.col("declared_n_windows") != F.col("n_windows")).alias("episodes_with_n_window_mismatch"),
        count(has).alias("attack_episodes"),
        count(~has).alias("benign_episodes"),
        count(F.col("detected")).alias("_detected"),
        count(~has & F.col("had_false_alert")).alias("_benign_false"),
        count(F.col("window_alert_count") > 0).alias("_alerting"),
        total_of("window_alert_count").alias("_alert"),
        total_of("window_true_alert_count").alias("_true"),
        total_of("window_attack_count").alias("_attack"),
        total_of("n_windows", ~has).alias("_benign_windows"),
        total_of("window_alert_count", ~has).alias("_benign_alert"),
        total_of("alert_segment_count").alias("_segments"),
        total_of("alert_flicker_count").alias("_flicker"),
    )
    col = lambda v: v if isinstance(v, Column) else F.lit(v)
    missing = col(missing)
    total = F.col("episodes_evaluated") + missing if total is None else col(total)
    div = lambda x, y: F.try_divide(F.col(x).cast("double"), F.col(y).cast("double"))
    return a.withColumn("_d", delays).select(
        total.cast("bigint").alias("episodes_total_input"), "episodes_evaluated", missing.cast("bigint").alias("episodes_missing_scores"),
        "episodes_with_n_window_mismatch", "attack_episodes", "benign_episodes", div("_detected", "attack_episodes").alias("episode_recall"),
        F.col("_d.m").alias("median_detection_delay_windows"), F.col("_d.p").alias("p90_detection_delay_windows"),
        div("_benign_false", "benign_episodes").alias("false_alert_rate_per_benign_episode"),
        (1000 * div("_benign_alert", "_benign_windows")).alias("false_alert_windows_per_1000_benign_windows"),
        div("_detected", "_alerting").alias("alert_precision_episode_level"), div("_true", "_alert").alias("alert_precision_window_level"),
        div("_true", "_attack").alias("alert_recall_window_level"), div("_alert", "_segments").alias("mean_alert_duration_windows"),
        div("_flicker", "episodes_evaluated").alias("alert_flicker_rate_per_episode"),
    )


def top_failures(results: DataFrame, n: int = 12) -> DataFrame:
    """Missed attacks, slowest detections and longest benign false alerts, ``n`` rows each."""
    results = ordering.cut(results)
    cols = ["episode_id", "attack_family", "detection_delay_windows", "first_alert_window", "false_alert_duration_windows", "score_file"]
    has = F.col("has_attack_segment")

    def top(kind: str, cond: Column, *order: Column) -> DataFrame:
        return results.where(cond).orderBy(*order).limit(n).select(F.lit(kind).alias("kind"), *cols)

    missed = top("missed_attack", has & ~F.col("detected"), F.coalesce("attack_family", F.lit("")), F.col("episode_id"))
    slow = top("slow_detected", has & F.col("detection_delay_windows").isNotNull(), F.desc("detection_delay_windows"), F.col("episode_id"))
    false = top("benign_false_alert", ~has & F.col("had_false_alert"), F.desc("false_alert_duration_windows"), F.col("episode_id"))
    return missed.unionByName(slow).unionByName(false)


def family_rows(scores: DataFrame, manifest: DataFrame, text: str) -> DataFrame:
    """Score rows ``(file, ...)`` whose manifest entry names a preset containing ``text``."""
    path = canonical_path(F.coalesce("expected_detect_file", "source_file"))
    chosen = manifest.where(F.contains(F.lower("target_preset"), F.lit(text.lower()))).select(path.alias("_path"), "target_preset")
    one = chosen.groupBy("_path").agg(F.min("target_preset").alias("target_preset"))
    return scores.join(one, canonical_path(F.col("file")) == F.col("_path")).drop("_path")
