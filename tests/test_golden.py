"""Cases small enough to check by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqalert.functions import columns as C
from seqalert.operators import abi, alerts, curves, episodes, sampling, windows as win
from seqalert.operators.alerts import Policy
from seqalert.scorers.chronology import Markov

PROBS = [0.2, 0.7, 0.8, 0.9, 0.3, 0.2, 0.1, 0.6, 0.7]
GOLDEN = dict(tau=0.5, rolling=3, warmup=2, trigger_mean=0.6, trigger_rate=0.6, trigger_consecutive=2, clear_mean=0.45, clear_rate=0.34)


def tokens(spark, seqs):
    rows = [(t, p, v) for t, s in seqs.items() for p, v in enumerate(s)]
    return spark.createDataFrame(rows, "trace_id string, pos bigint, token int")


def scores(spark, seqs, key="trace_id"):
    rows = [(t, w, float(p)) for t, s in seqs.items() for w, p in enumerate(s)]
    return spark.createDataFrame(rows, f"{key} string, w bigint, prob double")


@pytest.mark.parametrize("size", [4, 6, 4096])
def test_window_counts(spark, size):
    rng = random.Random(5)
    seqs = {f"t{n}": [rng.randrange(300) for _ in range(n)] for n in (1, 19, 20, 21, 22, 25, 60, 133)}
    got = {}
    for r in win.sliding_windows(tokens(spark, seqs), 20, 2, size=size).collect():
        got.setdefault(r["trace_id"], {})[r["w"]] = list(r["win"])
    for t, s in seqs.items():
        want = {i: s[2 * i : 2 * i + 20] for i in range((len(s) - 20) // 2 + 1)} if len(s) >= 20 else {}
        assert got.get(t, {}) == want


def test_windows_of_arrays_equal_windows_of_tokens(spark):
    seqs = {"a": list(range(50)), "b": list(range(10))}
    packed = spark.createDataFrame(list(seqs.items()), "trace_id string, seq array<int>")
    a = win.windows_of_arrays(packed, 7, 3).select("trace_id", "w", "win")
    b = win.sliding_windows(tokens(spark, seqs), 7, 3)
    assert a.exceptAll(b).count() == 0 and a.count() == b.count() > 0
    assert win.tokens_of(packed).exceptAll(tokens(spark, seqs)).count() == 0


def test_rolling_token_sums(spark):
    seqs = {"a": [i * 7 % 31 for i in range(80)], "b": [1] * 19}
    t = tokens(spark, seqs)
    got = {r["w"]: (r["all"], r["tail"]) for r in win.rolling_token_stats(t, {"all": "token", "tail": "token@1"}, size=32).collect()}
    s = seqs["a"]
    assert got == {i: (sum(s[2 * i : 2 * i + 20]), sum(s[2 * i + 1 : 2 * i + 20])) for i in range(31)}


@pytest.mark.parametrize("size", [2, 4, 1 << 20])
@pytest.mark.parametrize("hold,want", [(1, "000111000"), (4, "000111100")])
def test_hysteresis(spark, size, hold, want):
    if size <= 2 and hold == 1:
        size = 3
    df = scores(spark, {"a": PROBS})
    out = alerts.alert_timeline(df, Policy(**GOLDEN, hold=hold), size=max(size, 3)).orderBy("w").collect()
    assert "".join(str(int(r["alert"])) for r in out) == want


def sequential(probs, p):
    """The rule as a plain loop."""
    out, alert, left = [], False, 0
    for i in range(len(probs)):
        f = probs[max(0, i - p.rolling + 1) : i + 1]
        on = [x >= p.tau for x in f]
        mean, rate = sum(f) / len(f), sum(on) / len(on)
        best = run = 0
        for v in on:
            run = run + 1 if v else 0
            best = max(best, run)
        start = [c for c in (None if p.trigger_mean is None else mean >= p.trigger_mean, None if p.trigger_rate is None else rate >= p.trigger_rate, None if p.trigger_consecutive is None else best >= p.trigger_consecutive) if c is not None]
        end = [c for c in (None if p.clear_mean is None else mean <= p.clear_mean, None if p.clear_rate is None else rate <= p.clear_rate) if c is not None]
        if alert:
            if left > 0:
                left -= 1
            elif end and all(end):
                alert = False
        elif i + 1 >= p.warmup and start and all(start):
            alert, left = True, p.hold - 1
        out.append(alert)
    return out


@pytest.mark.parametrize(
    "policy",
    [
        Policy(**GOLDEN),
        Policy(**{**GOLDEN, "hold": 5}),
        Policy(warmup=1, rolling=4, tau=0.5, trigger_mean=0.5, clear_mean=0.55),
        Policy(warmup=1, rolling=4, tau=0.5, trigger_mean=0.5, clear_mean=0.55, hold=7),
        Policy(warmup=3, rolling=5, tau=0.5, trigger_rate=0.59),
        Policy(warmup=3, rolling=5, tau=0.5, clear_rate=0.3),
        Policy(warmup=2, rolling=2, tau=0.5, trigger_consecutive=3, clear_mean=0.4),
    ],
)
def test_hysteresis_equals_the_loop(spark, policy):
    rng = random.Random(11)
    seqs = {t: [rng.random() for _ in range(n)] for t, n in (("a", 200), ("b", 3), ("c", 33))}
    got = {}
    for r in alerts.alert_timeline(scores(spark, seqs), policy, size=16).collect():
        got.setdefault(r["trace_id"], {})[r["w"]] = r["alert"]
    for t, s in seqs.items():
        assert [got[t][w] for w in range(len(s))] == sequential(s, policy)


@pytest.mark.parametrize("size", [1, 5, 1 << 20])
def test_segments(spark, size):
    rng = random.Random(2)
    rows = [(t, w, rng.random() < 0.7) for t in "ab" for w in range(60)]
    df = spark.createDataFrame(rows, "trace_id string, w bigint, f boolean")
    got = sorted((r["trace_id"], r["start_w"], r["end_w"]) for r in alerts.segments(df, "f", size=size).collect())
    want = []
    for t in "ab":
        on = [w for k, w, f in rows if k == t and f]
        for w in on:
            if want and want[-1][0] == t and want[-1][2] == w - 1:
                want[-1] = (t, want[-1][1], w)
            else:
                want.append((t, w, w))
    assert got == want
    longest = {r["trace_id"]: r["longest_run"] for r in alerts.longest_run(df, "f", size=size).collect()}
    assert longest == {t: max(e - s + 1 for k, s, e in want if k == t) for t in "ab"}


def episode(spark, n, label="malware_targeted", family="f", onset=(0.2, 0.9)):
    rows = [("e", "s", "x", n, label, family, *onset)]
    return spark.createDataFrame(rows, "episode_id string, score_file string, source_file string, n_windows bigint, intended_label string, attack_family string, onset_fraction double, end_fraction double")


def segs(df):
    return [(s["label"], s["start_window"], s["end_window"]) for s in df.head()["ground_truth_segments"]]


def test_ground_truth_segments(spark):
    build = episodes.build_segments
    assert segs(build(episode(spark, 420))) == [("benign", 0, 83), ("attack", 84, 377), ("benign", 378, 419)]
    assert segs(build(episode(spark, 1))) == [("attack", 0, 0)]
    assert segs(build(episode(spark, 10, "benign_control"))) == [("benign", 0, 9)]
    assert segs(build(episode(spark, 10), "full_file_label")) == [("attack", 0, 9)]
    assert segs(build(episode(spark, 0))) == []


def test_episode_result(spark):
    ep = episode(spark, 9, onset=(2.0 / 9 + 1e-9, 6.0 / 9 + 1e-9))
    ep = episodes.build_segments(ep)
    assert ("attack", 2, 5) in segs(ep)
    r = episodes.evaluate(scores(spark, {"e": PROBS}, "episode_id"), ep, Policy(**GOLDEN)).head()
    assert r["detected"] and r["detection_delay_windows"] == 1
    assert (r["alert_time_inside_attack"], r["alert_time_before_attack"], r["alert_time_after_attack"]) == (3, 0, 0)
    assert r["alert_flicker_count"] == 0 and r["recovery_delay_after_attack_end"] == 0


def test_recovery_after_a_long_alert(spark):
    probs = [0.9] * 8 + [0.1] * 6
    ep = episodes.build_segments(episode(spark, 14, onset=(0.2, 0.5)))
    r = episodes.evaluate(scores(spark, {"e": probs}, "episode_id"), ep, Policy(**GOLDEN), size=4).head()
    state = sequential(probs, Policy(**GOLDEN))
    end = r["attack_end_window"]
    assert state[end]
    assert r["recovery_delay_after_attack_end"] == next(i for i in range(end + 1, 14) if not state[i]) - end - 1


def test_curve_metrics(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, score double")
    m = curves.all_metrics(curves.score_table(df)).head()
    assert m["auc"] == 0.75 and abs(m["ap"] - 5 / 6) < 1e-9
    assert abs(m["best_f1"] - 0.8) < 1e-6 and m["best_tau"] == 0.35
    assert m["fpr95"] == 0.5 and m["tpr_fpr1"] == 0.5


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.4)], "y int, score double")
    assert curves.roc_auc(curves.score_table(df)).head()["auc"] is None


def test_smoothed_best_f1(spark):
    rng = random.Random(4)
    rows = [(int(rng.random() < 0.2 + 0.5 * (i / 300)), i / 300) for i in range(300)]
    tbl = curves.score_table(spark.createDataFrame(rows, "y int, score double"))
    got = curves.best_f1_smoothed(tbl, task_rows=50).head()
    taus = sorted({s for _, s in rows})
    pos = sum(y for y, _ in rows)
    f1 = []
    for t in taus:
        tp = sum(y for y, s in rows if s >= t)
        p, r = tp / sum(s >= t for _, s in rows), tp / pos
        f1.append(2 * p * r / (p + r + 1e-8))
    f1, n = np.array(f1), len(taus)
    w = min(21, max(5, n // 10 * 2 + 1))
    h = w // 2
    smooth = np.array([np.polyval(np.polyfit(np.arange(w), f1[a : a + w], 2), i - a) for i in range(n) for a in [min(max(0, i - h), n - w)]])
    best = int(smooth.argmax())
    assert got["tau"] == taus[best] and abs(got["smoothed_f1"] - smooth[best]) < 1e-9


def test_few_points_are_not_smoothed(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, score double")
    assert curves.best_f1_smoothed(curves.score_table(df)).head()["tau"] == 0.35


def test_strata_sizes(spark):
    rows = [(f"t{i:02d}", w) for i in range(10) for w in range(i + 1)]
    out = win.length_strata(spark.createDataFrame(rows, "trace_id string, w bigint"), 3)
    assert [r["count"] for r in out.groupBy("stratum").count().orderBy("stratum").collect()] == [4, 3, 3]


def test_largest_remainder(spark):
    rows = [(f"{d}{i}", f"{d}_1", "F", f"{d}/{i}") for d, n in (("A", 3), ("B", 5), ("C", 4)) for i in range(n)]
    files = spark.createDataFrame(rows, "sample_id string, source_group string, family string, source_file string")
    out = sampling.sample_manifest(files, 0.5, 0.5)
    assert {r["source_group"]: r["count"] for r in out.groupBy("source_group").count().collect()} == {"A_1": 2, "B_1": 2, "C_1": 2}


def test_markov_golden(spark):
    w = lambda s: spark.createDataFrame([("a", 0, s)], "trace_id string, w bigint, win array<int>")
    score = Markov(1).fit(w([1, 2, 1, 2, 1])).score(w([1, 2, 3])).head()["score"]
    assert abs(score - 5.0) < 1e-8


@pytest.mark.parametrize("order", [1, 2, 3])
def test_markov_streams_equal_windows(spark, order):
    rng = random.Random(order)
    t = tokens(spark, {k: [rng.randrange(6) for _ in range(n)] for k, n in (("a", 90), ("b", 20), ("c", 33), ("d", 5))})
    w = win.sliding_windows(t)
    a, b = Markov(order).fit(w), Markov(order).fit_tokens(t, size=16)
    rows = lambda m: sorted((tuple(r["state"]), r["nxt"], r["n"], round(r["p"], 12)) for r in m.model.collect())
    assert rows(a) == rows(b)
    s = lambda d: {(r["trace_id"], r["w"]): round(r["score"], 9) for r in d.collect()}
    assert s(a.score(w)) == s(b.score_tokens(t, size=32))


@pytest.fixture(scope="module")
def i386(spark):
    rows = [("i386", n, k, 0, True, False) for n, k in (("restart_syscall", 0), ("read", 3), ("open", 5), ("close", 6))] + [("i386", "old_restart", 0, 0, False, False)]
    rows += [("x86_64", n, k, 0, True, False) for n, k in (("read", 0), ("open", 2), ("close", 3), ("futex", 202))]
    return spark.createDataFrame(rows, "abi string, name string, number int, ord int, common boolean, anchor boolean")


def test_abi_lookup(spark, i386):
    names = spark.createDataFrame([("t", p, n) for p, n in enumerate(["open", "read", "close", "nope"])], "trace_id string, pos bigint, token string")
    got = [r["number"] for r in abi.names_to_numbers(names, i386, "i386").orderBy("pos").collect()]
    assert got == ["5", "3", "6", "UNKNOWN_SYSCALL_nope"]
    nums = tokens(spark, {"t": [0, 99999]})
    assert [r["name"] for r in abi.numbers_to_names(nums, i386, "i386").orderBy("pos").collect()] == ["old_restart", "UNKNOWN_NUMBER_99999"]
    q = spark.createDataFrame([("x86", "6"), ("AMD64", "open"), ("i386", "zzz")], "abi string, query string")
    assert {r["query"]: r["answer"] for r in abi.lookup(q, i386).collect()} == {"6": "close", "open": "2", "zzz": None}


def test_abi_resolution(spark, i386):
    files = [("a", "in/x86_64/a.txt"), ("b", "in/b.txt"), ("c", "in/c.txt"), ("d", "in/d.txt"), ("e", "in/sub/e.txt")]
    text = {"a": "open read", "b": "futex read", "c": "open read", "d": "5 open", "e": "0 2 3 202"}
    f = spark.createDataFrame(files, "trace_id string, path string")
    t = spark.createDataFrame([(k, p, w) for k, s in text.items() for p, w in enumerate(s.split())], "trace_id string, pos bigint, token string")
    out = {r["trace_id"]: r for r in abi.resolve_abi(f, t, i386, root="in/").collect()}
    assert (out["a"]["abi"], out["a"]["method"]) == ("x86_64", "folder")
    assert (out["b"]["abi"], out["b"]["method"]) == ("x86_64", "detected")
    assert out["c"]["abi"] is None and out["c"]["error"] is None
    assert out["d"]["error"] == "mixed numbers and names"
    assert out["e"]["abi"] == "x86_64"
    assert abi.resolve_abi(f.where("trace_id = 'a'"), t, i386, explicit="i386", root="in/").head()["error"] == "conflicting hints"
    resolved = abi.resolve_abi(f, t, i386, root="in/")
    conv = abi.convert(resolved, t, i386)
    assert [r["converted"] for r in conv.where("trace_id = 'a'").orderBy("pos").collect()] == ["2", "0"]
    status = {r["trace_id"]: r["status"] for r in abi.conversion_report(resolved, conv).collect()}
    assert status == {"a": "converted", "b": "converted", "c": "unresolved", "d": "error", "e": "converted"}


def test_direction_and_sanitize(spark):
    df = spark.createDataFrame([(["5", "3", "6"],), (["open", "read"],), (["5", "open"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(C.direction(F.col("t"))).collect()] == ["number_to_name", "name_to_number", None, None]
    s = spark.createDataFrame([(0, 1.0), (1, math.inf), (2, math.nan), (3, -math.inf)], "i int, score double")
    assert [r["score"] for r in C.sanitize(s).orderBy("i").collect()] == [1.0, 1.0, 0.0, -1.0]
    assert [r["score"] for r in C.sanitize(s.where("i = 1")).collect()] == [1e6]


def test_status_and_stem(spark):
    df = spark.createDataFrame([("a\\B/c.x.txt", 19), ("d", 20)], "p string, length int")
    r = C.with_status(df, 20, 2).select("n_windows", "status", C.path_stem(F.col("p")).alias("s"), C.canonical_path(F.col("p")).alias("c")).collect()
    assert [tuple(x) for x in r] == [(0, "too_short_for_window_20", "c.x", "a/b/c.x.txt"), (1, "ok", "d", "d")]


def test_two_sided_p_stays_finite():
    p, logp = curves.two_sided_p(1.959963984540054)
    assert abs(p - 0.05) < 1e-9 and abs(logp - 1.30103) < 1e-5
    p, logp = curves.two_sided_p(60.0)
    assert p == 0.0 and 780 < logp < 790
