"""Joins of scores and manifests, ground truth, episode results and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqalert.contract.base import POLICY, TAU, episodes, ev_windows, meta, onset, pool, query, raw_episodes, scored
from seqalert.operators import alerts, episodes as E, ordering


def results(s, d, size=ordering.CHUNK):
    scores = scored(ev_windows(s, d)).select(F.col("trace_id").alias("episode_id"), "w", "prob")
    return E.evaluate(scores, episodes(s, d), POLICY, size=size)


# Scores of the event traces under other spellings of their paths: every trace has its own score row, traces that
# start with an error only one under the source path, those that start with a sign-up none; duplicates count last.
def _episode_paths(s, d):
    m = meta(s, d)
    id_ = F.col("trace_id")
    return m.select(id_.alias("episode_id"), F.concat(F.lit("Run\\Scores/"), id_, F.lit(".TXT")).alias("score_file"), F.concat(F.lit("src/"), id_).alias("source_file"), "split", "length")


def _score_rows(s, d):
    e = _episode_paths(s, d)
    by_score = e.where(F.col("split") == "train").select(F.lower(F.replace("score_file", F.lit("\\"), F.lit("/"))).alias("file"), F.col("length").alias("n"))
    again = by_score.select(F.upper("file").alias("file"), (-F.col("n")).alias("n"))
    by_source = e.where(F.col("split") == "attack").select(F.upper("source_file").alias("file"), F.col("length").alias("n"))
    return by_score.unionByName(again).unionByName(by_source)


@query(
    "jn_01_join_scores",
    """SELECT trace_id AS episode_id, CASE split WHEN 'train' THEN 'run/scores/' || trace_id || '.txt' WHEN 'attack' THEN 'SRC/' || trace_id END AS matched_file, CASE WHEN split IN ('train', 'attack') THEN length END AS score_n FROM meta""",
    "meta",
)
def _(s, d):
    out = E.join_scores(_episode_paths(s, d), _score_rows(s, d), [F.col("n")])
    return out.select("episode_id", "matched_file", "score_n")


@query("jn_02_missing_scores", "SELECT trace_id AS episode_id, 'Run\\Scores/' || trace_id || '.TXT' AS score_file, 'src/' || trace_id AS source_file FROM meta WHERE split = 'val'", "meta")
def _(s, d):
    return E.missing_scores(_episode_paths(s, d), _score_rows(s, d))


@query(
    "jn_03_join_manifest",
    """SELECT 'data/' || trace_id || '.txt' AS file, CASE split WHEN 'attack' THEN 'malware_targeted' WHEN 'train' THEN 'benign_control' END AS intended_label, CASE WHEN split = 'attack' THEN family END AS target_preset FROM meta""",
    "meta",
)
def _(s, d):
    m = meta(s, d)
    file = F.concat(F.lit("data/"), "trace_id", F.lit(".txt"))
    # Attack traces match by path, training traces by file stem, the others not at all.
    manifest = m.where(F.col("split") != "val").select(
        F.when(F.col("split") == "train", F.col("trace_id")).otherwise(F.concat(F.lit("s"), "trace_id")).alias("sample_id"),
        F.when(F.col("split") == "attack", "malware_targeted").otherwise("benign_control").alias("intended_label"), F.col("family").alias("target_preset"),
        F.when(F.col("split") == "attack", F.upper(file)).otherwise(F.concat(F.lit("other/"), "trace_id")).alias("source_file"),
        F.lit(None).cast("string").alias("expected_detect_file"),
    )
    out = E.join_manifest(m.select(file.alias("file")), manifest)
    return out.select("file", "intended_label", "target_preset")


@query("jn_04_resolved_onset", "SELECT episode_id, onset_fraction, end_fraction, override_used FROM epi", "epi")
def _(s, d):
    out = E.resolve_onset(raw_episodes(s, d), onset(s), (0.1, 0.9))
    return out.select("episode_id", "onset_fraction", "end_fraction", "override_used")


@query("jn_05_attack_mask", "SELECT trace_id AS episode_id, w, coalesce(w BETWEEN attack_start AND attack_end, false) AS in_attack FROM win JOIN att ON att.episode_id = win.trace_id", "win", "att")
def _(s, d):
    rows = ev_windows(s, d).select(F.col("trace_id").alias("episode_id"), "w")
    return E.attack_mask(rows, episodes(s, d), size=16).select("episode_id", "w", "in_attack")


@query("jn_06_semi_join", "SELECT trace_id, w FROM win WHERE trace_id IN (SELECT trace_id FROM meta WHERE split = 'val')", "win", "meta")
def _(s, d):
    keys = meta(s, d).where(F.col("split") == "val").select("trace_id")
    return ev_windows(s, d).join(keys, "trace_id", "left_semi").select("trace_id", "w")


@query(
    "jn_15_family_rows",
    """SELECT trace_id AS file, family FROM meta WHERE contains(family, 'sign') OR contains(family, 'err')""",
    "meta",
)
def _(s, d):
    m = meta(s, d)
    manifest = m.where(F.col("y") == 1).select(F.upper(F.concat(F.lit("x/"), "trace_id")).alias("source_file"), F.col("family").alias("target_preset"), F.lit(None).cast("string").alias("expected_detect_file"))
    scores = m.select(F.concat(F.lit("x\\"), "trace_id").alias("file"), "trace_id")
    out = E.family_rows(scores, manifest, "sign").unionByName(E.family_rows(scores, manifest, "ERR"))
    return out.select(F.col("trace_id").alias("file"), F.col("target_preset").alias("family"))


@query(
    "win_13_segments",
    """SELECT episode_id, label, a AS start_window, b AS end_window FROM (
        SELECT episode_id, 'benign' AS label, 0::BIGINT AS a, n_windows - 1 AS b FROM att WHERE attack_start IS NULL
        UNION ALL SELECT episode_id, 'attack', attack_start, attack_end FROM att WHERE attack_start IS NOT NULL
        UNION ALL SELECT episode_id, 'benign', 0, attack_start - 1 FROM att WHERE attack_start > 0
        UNION ALL SELECT episode_id, 'benign', attack_end + 1, n_windows - 1 FROM att WHERE attack_end < n_windows - 1)""",
    "att",
)
def _(s, d):
    rows = episodes(s, d).select("episode_id", F.explode("ground_truth_segments").alias("g"))
    return rows.select("episode_id", "g.*")


@query(
    "win_11_episode_results",
    """SELECT episode_id, score_file, attack_family, intended_label, n_windows, n_windows AS declared_n_windows, has_attack_segment, attack_n > 0 AS has_attack_window_range, attack_start AS attack_start_window, attack_end AS attack_end_window,
    has_attack_segment AND first_inside IS NOT NULL AS detected, first_alert AS first_alert_window, first_inside AS first_alert_inside_attack_window, delay AS detection_delay_windows, within5 AS detected_within_5_windows,
    within10 AS detected_within_10_windows, within20 AS detected_within_20_windows, inside_n AS alert_time_inside_attack, before AS alert_time_before_attack, after AS alert_time_after_attack, before > 0 AS false_alert_before_attack,
    had_false AS had_false_alert, CASE WHEN had_false THEN first_alert END AS first_false_alert_window, CASE WHEN has_attack_segment THEN segs_before ELSE n_segs END AS false_alert_count,
    CASE WHEN has_attack_segment THEN before ELSE total END AS false_alert_duration_windows, total AS alert_duration_windows_total, n_segs AS alert_segment_count, greatest(0, n_segs - 1) AS alert_flicker_count,
    recovery AS recovery_delay_after_attack_end, %s AS policy_tau, inside_n AS window_true_alert_count, total AS window_alert_count, attack_n AS window_attack_count FROM res""" % f"{TAU}::DOUBLE",
    "res",
)
def _(s, d):
    return results(s, d, size=16)


@query("win_12_recovery_delay", "SELECT episode_id, recovery AS recovery_delay_after_attack_end FROM res", "res")
def _(s, d):
    scores = pool(s, d).select(F.col("trace_id").alias("episode_id"), "w", "prob")
    timeline = alerts.alert_timeline(scores, POLICY, ["episode_id"])
    return E.recovery_delay(timeline, episodes(s, d))


@query(
    "agg_10_family_realtime",
    """SELECT attack_family, count(*) AS attack_episodes, avg(CAST(first_inside IS NOT NULL AS INTEGER)) AS episode_recall, avg(within5::INTEGER) AS recall_within_5_windows, avg(within10::INTEGER) AS recall_within_10_windows,
    avg(within20::INTEGER) AS recall_within_20_windows, avg(CAST(before > 0 AS INTEGER)) AS false_alert_before_attack_rate, quantile_cont(delay, 0.5) AS median_detection_delay_windows, quantile_cont(delay, 0.9) AS p90_detection_delay_windows
    FROM res WHERE has_attack_segment GROUP BY attack_family""",
    "res",
    rounds="episode_recall recall_within_5_windows recall_within_10_windows recall_within_20_windows false_alert_before_attack_rate median_detection_delay_windows p90_detection_delay_windows",
)
def _(s, d):
    return E.family_realtime(results(s, d))


@query(
    "agg_11_realtime_summary",
    """SELECT count(*) + 2 AS episodes_total_input, count(*) AS episodes_evaluated, 2::BIGINT AS episodes_missing_scores, 0::BIGINT AS episodes_with_n_window_mismatch, count(*) FILTER (has_attack_segment) AS attack_episodes,
    count(*) FILTER (NOT has_attack_segment) AS benign_episodes, count(*) FILTER (has_attack_segment AND first_inside IS NOT NULL) / count(*) FILTER (has_attack_segment)::DOUBLE AS episode_recall,
    quantile_cont(delay, 0.5) AS median_detection_delay_windows, quantile_cont(delay, 0.9) AS p90_detection_delay_windows, count(*) FILTER (NOT has_attack_segment AND had_false) / count(*) FILTER (NOT has_attack_segment)::DOUBLE AS false_alert_rate_per_benign_episode,
    1000 * sum(total) FILTER (NOT has_attack_segment) / sum(n_windows) FILTER (NOT has_attack_segment)::DOUBLE AS false_alert_windows_per_1000_benign_windows,
    count(*) FILTER (has_attack_segment AND first_inside IS NOT NULL) / count(*) FILTER (total > 0)::DOUBLE AS alert_precision_episode_level, sum(inside_n) / sum(total)::DOUBLE AS alert_precision_window_level,
    sum(inside_n) / sum(attack_n)::DOUBLE AS alert_recall_window_level, sum(total) / sum(n_segs)::DOUBLE AS mean_alert_duration_windows, sum(greatest(0, n_segs - 1)) / count(*)::DOUBLE AS alert_flicker_rate_per_episode FROM res""",
    "res",
    rounds="episode_recall median_detection_delay_windows p90_detection_delay_windows false_alert_rate_per_benign_episode false_alert_windows_per_1000_benign_windows alert_precision_episode_level alert_precision_window_level alert_recall_window_level mean_alert_duration_windows alert_flicker_rate_per_episode",
)
def _(s, d):
    return E.realtime_summary(results(s, d), missing=2)


@query(
    "top_03_top_failures",
    """SELECT kind, episode_id, attack_family, delay AS detection_delay_windows, first_alert AS first_alert_window, CASE WHEN has_attack_segment THEN before ELSE total END AS false_alert_duration_windows, score_file FROM (
    SELECT 'missed_attack' AS kind, *, row_number() OVER (ORDER BY attack_family, episode_id) AS r FROM res WHERE has_attack_segment AND first_inside IS NULL
    UNION ALL SELECT 'slow_detected', *, row_number() OVER (ORDER BY delay DESC, episode_id) FROM res WHERE has_attack_segment AND delay IS NOT NULL
    UNION ALL SELECT 'benign_false_alert', *, row_number() OVER (ORDER BY total DESC, episode_id) FROM res WHERE NOT has_attack_segment AND had_false) WHERE r <= 5""",
    "res",
)
def _(s, d):
    return E.top_failures(results(s, d), 5)
