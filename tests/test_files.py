"""Readers of trace files and configuration."""

import json

from seqalert.operators import abi
from seqalert.sources import files, sinks


def put(root, name, text):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)


def seqs(df, col="token"):
    out = {}
    for r in df.orderBy("trace_id", "pos").collect():
        out.setdefault(r["stem"], []).append(r[col])
    return out


def test_numeric_traces(spark, tmp_path):
    put(tmp_path, "a.txt", "6 6 63\n\n  6 x7 42\t120 -1 6\n195")
    put(tmp_path, "b.txt", "no numbers here")
    put(tmp_path, "c.txt", "1,2;3")
    put(tmp_path, "d.log", "9 9")
    assert seqs(files.read_traces(spark, str(tmp_path))) == {"a": [6, 6, 63, 6, 42, 120, 6, 195]}
    assert seqs(files.read_traces(spark, str(tmp_path), lenient=True)) == {"a": [6, 6, 63, 6, 7, 42, 120, 1, 6, 195], "c": [1, 2, 3]}
    dropped = {r["trace_id"].rsplit("/", 1)[1]: r["dropped"] for r in files.dropped_tokens(spark, str(tmp_path)).collect()}
    assert dropped == {"a.txt": 2, "b.txt": 3, "c.txt": 1}


def test_attack_families(spark, tmp_path):
    put(tmp_path, "Adduser_1/x.txt", "1 2")
    put(tmp_path, "Adduser_22/y.txt", "3")
    put(tmp_path, "Java_Meterpreter_3/z.txt", "4")
    out = files.read_attack_traces(spark, str(tmp_path))
    assert {r["stem"]: r["family"] for r in out.collect()} == {"x": "Adduser", "y": "Adduser", "z": "Java_Meterpreter"}


def test_named_and_mixed_traces(spark, tmp_path):
    maps = tmp_path / "maps"
    put(maps, "i386.json", json.dumps({"abi": "x86", "name_to_numbers": {"open": [5, 5, 295], "read": [3], "newcall": [500, 12]}}))
    m = files.abi_map(spark, str(maps)).cache()
    assert {(r["name"], r["number"], r["ord"]) for r in m.collect()} == {("open", 5, 0), ("open", 295, 1), ("read", 3, 0), ("newcall", 500, 0), ("newcall", 12, 1)}
    assert {r["abi"] for r in m.collect()} == {"i386"}
    put(tmp_path, "logs/web/n.log", "open|read\n zebra | apple |open|\n")
    out = files.read_named_logs(spark, str(tmp_path / "logs"), m, "i386")
    assert seqs(out) == {"n": [5, 3, 501, 500, 5]} and out.head()["domain"] == "web"
    put(tmp_path, "mix/plain.txt", "1 2\n3")
    put(tmp_path, "mix/calls.txt", "open(\"/x\", 0) = 3\n7\n\nmystery(1)\nnewcall\n??\n4 5\n")
    mixed = files.read_mixed_traces(spark, str(tmp_path / "mix"), m, "i386", 340)
    assert seqs(mixed) == {"plain": [1, 2, 3], "calls": [5, 7, 12]}
    repaired = abi.repair_ids(spark.createDataFrame([("t", 0, 500), ("t", 1, 999), ("t", 2, 7)], "trace_id string, pos bigint, token int"), m, "i386", 340)
    assert [(r["token"], r["mapped"]) for r in repaired.orderBy("pos").collect()] == [(12, "renamed"), (0, "zeroed"), (7, "kept")]


def test_configuration(spark, tmp_path):
    put(tmp_path, "p.json", json.dumps({"policy_name": "canonical", "warmup_windows": 3, "rolling_window": 25, "phase5_tau": 0.4, "trigger": {"rolling_mean_prob_gte": 0.6, "rolling_consecutive_positive_gte": 3}, "clear": {"rolling_positive_rate_lte": 0.32}}))
    p = files.read_policy(spark, str(tmp_path / "p.json"))
    assert (p.warmup, p.rolling, p.tau, p.trigger_mean, p.trigger_rate, p.trigger_consecutive, p.clear_mean, p.clear_rate, p.hold) == (3, 25, 0.4, 0.6, None, 3, None, 0.32, 1)
    one = lambda a, b: {"attack_onset_fraction": a, "attack_end_fraction": b}
    put(tmp_path, "o1.json", json.dumps({"default": one(0.1, 0.9), "families": {"F": one(0.2, 0.8)}}))
    put(tmp_path, "o2.json", json.dumps({"F": one(0.2, 0.8), "G": one(0.3, 0.7)}))
    rows = lambda n: {(r["family"], r["onset"], r["end"]) for r in files.read_onset(spark, str(tmp_path / n)).collect()}
    assert rows("o1.json") == {(None, 0.1, 0.9), ("F", 0.2, 0.8)}
    assert rows("o2.json") == {("F", 0.2, 0.8), ("G", 0.3, 0.7)}


def test_score_records_keep_bad_lines(spark, tmp_path):
    put(tmp_path, "s.jsonl", '﻿{"file": "a", "n_windows": 2, "phase5_probs": [0.1, 0.9], "extra": 1}\n\n{broken\n')
    rows = files.read_scores(spark, str(tmp_path / "s.jsonl")).collect()
    good = [r for r in rows if r["file"]]
    assert len(rows) == 2 and good[0]["phase5_probs"] == [0.1, 0.9] and good[0]["_corrupt_record"] is None
    assert [r["_corrupt_record"] for r in rows if not r["file"]] == ["{broken"]


def test_long_traces_make_several_records(spark, tmp_path):
    rows = [("a", w, 0.1, 0.2, 0.3, w / 10) for w in range(7)]
    df = spark.createDataFrame(rows, "trace_id string, w bigint, path_a double, path_b double, path_c double, prob double")
    sinks.write_scores(sinks.score_records(df, tau=0.5, size=3), str(tmp_path / "out"))
    back = files.read_scores(spark, str(tmp_path / "out"))
    assert back.count() == 3
    got = files.score_windows(back).orderBy("w").collect()
    assert [(r["w"], r["prob"], r["positive"]) for r in got] == [(w, w / 10, w / 10 >= 0.5) for w in range(7)]
