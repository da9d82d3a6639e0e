"""Periodic runs against a search of all periods, and their query."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqalert.llm import periods
from seqalert.llm.text import words


def brute(w, least=6, exponent=4):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s = w[i : j + q]
            if len(s) >= max(least, exponent * q) and all(any(s[x] != s[x + p] for x in range(len(s) - p)) for p in range(1, q)):
                out.append((i, len(s), q))
            i = j
    return sorted(out)


def repeating(r, k, n):
    w = [r.randrange(k) for _ in range(n)]
    for _ in range(r.choice([0, 1, 2])):
        unit = [r.randrange(k + 2) for _ in range(r.randint(1, 9))]
        again = (unit * r.randint(2, 9))[: r.randint(3, 60)]
        if r.random() < 0.4:
            again = (again + [99] + again) * r.randint(1, 3)
        at = r.randint(0, len(w))
        w[at:at] = again
    return w


@pytest.mark.parametrize("least,exponent", [(6, 4), (9, 4), (6, 5)])
def test_runs_equal_brute_force(least, exponent):
    r = random.Random(least * exponent)
    found = 0
    for _ in range(1200):
        w = repeating(r, r.choice([1, 2, 3, 5]), r.randint(0, 90))
        want = brute(w, least, exponent)
        assert periods.runs(w, least, exponent) == want
        found += len(want)
    assert found > 1000


def test_words_of_fibonacci_and_thue_morse_and_runs_of_runs():
    a, b = [0], [0, 1]
    while len(b) < 500:
        a, b = b, b + a
    thue = [bin(i).count("1") % 2 for i in range(512)]
    nested = (([1, 2] * 5 + [3]) * 6 + [4]) * 5
    for w in (b, thue, nested, [1] * 700, [x for k in range(40) for x in range(k)]):
        assert periods.runs(w) == brute(w)


def test_a_grammar_spells_its_text():
    r = random.Random(5)
    for _ in range(200):
        w = repeating(r, 3, r.randint(1, 60)) or [1]
        rules, starts, top, at, base = periods.repair(w)
        spell = lambda s: [s] if s < base else [x for part in rules[s - base] for x in spell(part)]
        assert [x for s in top for x in spell(s)] == w
        for i, start in enumerate(starts):
            assert w[start : start + len(spell(base + i))] == spell(base + i)


def test_no_run_leaves_a_segment():
    r = random.Random(6)
    for _ in range(500):
        w = repeating(r, 2, r.randint(6, 80))
        parts = periods.segments(np.array(w, np.uint64))
        assert all(any(s <= a and a + n <= e for s, e in parts) for a, n, _ in brute(w))


def test_long_texts_take_little_time():
    r = random.Random(7)
    for w in (["a"] * 200_000, ["a", "b"] * 100_000, [str(i) for i in range(200_000)], [r.randrange(1000) for _ in range(20_000)] * 5):
        start = time.perf_counter()
        periods.runs(w)
        assert time.perf_counter() - start < 30


def test_thresholds_below_the_cut_are_refused():
    with pytest.raises(ValueError):
        periods.runs([1] * 9, least=5)
    with pytest.raises(ValueError):
        periods.runs([1] * 9, exponent=3)


def plainly(doc, text):
    w = [x.decode() for x in words(text)]
    h = zlib.crc32(str(doc).encode())
    n, g = len(w), h // 10
    if doc is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda t: (t[1] / t[2], -t[0], -t[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_query(spark):
    r = random.Random(8)
    text = lambda: " ".join(f"w{x}" for x in repeating(r, 4, r.randint(0, 60)))
    rows = [(i, text()) for i in range(150)] + [(3, "a a a a a a a"), (None, "b c " * 9), (700, None), (701, ""), (702, " \n\t"), (703, "é é " * 12), (704, "x" * 200_000), (705, "one"), (705, "one")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"start": F.lit(1), "runs": F.lit("x"), "n_words": F.lit(2)})
    got = periods.digests(periods.periodic(docs.repartition(3), prepare=periods.planted))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((plainly(*row) for row in rows), key=repr)
    assert sum(row[1] for row in got.collect()) > 100


def test_texts_and_spans(spark):
    docs = spark.createDataFrame([(1, "go on " * 4 + "and stop"), (2, None)], "doc_id bigint, text string")
    one, two = sorted(periods.periodic(docs).collect())
    assert (one["n_words"], [tuple(x) for x in one["runs"]], tuple(one["strongest"]), one["collapsed"]) == (10, [(0, 8, 2)], (0, 8, 2), "go on and stop")
    assert (two["n_words"], two["runs"], two["strongest"], two["collapsed"]) == (0, [], None, "")
    assert periods.digests(periods.periodic(docs.limit(0))).collect() == []
