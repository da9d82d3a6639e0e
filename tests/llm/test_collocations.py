"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqalert.llm import collocations


def brute(rows, most, least, inside, k):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, most + 1):
                counts.setdefault(lang, Counter()).update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            held = any(len(o) > len(p) and 100 * b >= inside * a and any(o[i : i + len(p)] == p for i in range(len(o))) for o, b in found.items())
            if not held:
                s, _, le, ri = min((1_000_000 * a * a // (f[p[:j]] * f[p[j:]]), j, f[p[:j]], f[p[j:]]) for j in range(1, len(p)))
                kept.append((-s, -a, " ".join(p).encode(), le, ri))
        for rank, (s, a, p, le, ri) in enumerate(sorted(kept)[:k], 1):
            out.append((lang, rank, p.decode(), -a, le, ri, n[lang], -s))
    return sorted(out)


def texts(seed, n):
    r = random.Random(seed)
    word = lambda: r.choice(["The", "the", "of", "é", "a b", "x\x1cy", "ab", "ABBA"]) if r.random() < 0.6 else r.choice("pqrstuv")
    out = []
    for _ in range(n):
        w = []
        for _ in range(r.randint(0, 40)):
            w += ["New", "York", "City"] if r.random() < 0.1 else [word()]
        out.append((r.choice(["en", "en", "en", "de", None, "und", ""]), "".join(x + r.choice([" ", " ", "  ", "\t", ", ", ".\n", "\x0b", "!"]) for x in w)))
    return out + [("en", None), ("en", ""), ("en", " .,\n"), ("fr", "la la " * 2000), ("fr", "no end " * 5000), ("it", "una volta"), ("x", None)]


@pytest.mark.parametrize("most,block_words,held_words,task_rows", [(3, 2_000_000, 400_000, 200_000), (3, 7, 400_000, 4), (4, 50, 6, 10), (2, 3, 400_000, 9)])
def test_equals_brute_force(spark, most, block_words, held_words, task_rows):
    rows = texts(most, 150)
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({"doc_id": F.lit(1), "number": F.lit("x"), "n": F.lit(2), "block": F.lit(3), "word": F.lit(4)})
    got = collocations.collocations(docs.repartition(3), most, 10, 50, 25, block_words=block_words, held_words=held_words, task_rows=task_rows)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, most, 10, 50, 25)


def test_pieces_of_a_text_are_sliced_between_words():
    text = "One two, three\tfour.\nfive" * 30
    whole = [w for part in collocations.slices(text) for w in part]
    assert [w for part in collocations.slices(text, 5) for w in part] == whole and list(collocations.slices(None)) == []


def test_scores_beyond_64_bits(spark):
    one = spark.createDataFrame([(3_000_000_000_000, 3_500_000_000_000, 4_100_000_000_000)], "a bigint, l bigint, r bigint")
    a, le, ri = 3_000_000_000_000, 3_500_000_000_000, 4_100_000_000_000
    assert one.select(collocations.score(F.col("a"), F.col("l"), F.col("r"))).head()[0] == 1_000_000 * a * a // (le * ri)


def test_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(spark.createDataFrame([("en", "a b c"), ("en", None)], "lang string, text string")).collect() == []
