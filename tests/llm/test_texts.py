"""Encoding, mixing, URL rules, extraction, toxicity, quality rules and licenses against brute force."""

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqalert.llm import bpe, html, licenses, mixing, rules, toxicity, urls

PATH = public_tokenizers.path("byte_bpe_50k.json")


def own_tokenizer():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def odd_texts(seed=1, n=400):
    r = random.Random(seed)
    pools = [" \n\t\x0b", "abc'srtve", "ABCÉ1२３", "##<|endoftext|>", "　\xa0😀한\u0301", "<|endoftext|>"]
    return ["".join(r.choice(r.choice(pools)) for _ in range(r.randint(0, 60))) for _ in range(n)] + ["<|endoftext|>", "a <|endoftext|> b", " " * 500, "a" * 3000, "'s't're", "x" * 41 + " y"]


def test_encoding_equals_the_library(spark):
    texts = [*odd_texts(), *(r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(100).collect()), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id bigint, text string").withColumn("ids", F.lit(1))
    own = own_tokenizer()
    want = own.encode_batch([t or "" for t in texts], add_special_tokens=False)
    got = bpe.encoded(docs, PATH).collect()
    assert len(got) == len(texts) + 1
    for x in got:
        assert list(x["ids"]) == want[x["doc_id"]].ids and x["decoded"] == own.decode(want[x["doc_id"]].ids, skip_special_tokens=False)
    for x in bpe.digests(docs, PATH).collect():
        ids = want[x["doc_id"]].ids
        assert x["n_tokens"] == len(ids) and x["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert x["decoded_sha256"] == hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encoded(docs.where("false"), PATH).collect() == []


def test_control_characters_are_no_blanks():
    e, own = bpe.Encoder(bpe.Vocabulary.parse(open(PATH, encoding="utf-8").read())), own_tokenizer()
    r = random.Random(11)
    texts = ["a\n\n\x1cb", "a \x1f\x1d b", *("".join(r.choice("a \n\x1c\x1d\x1e\x1fé\x85\xa0.7") for _ in range(30)) for _ in range(300))]
    for t in texts:
        assert list(memoryview(e.encode(t)).cast("I")) == own.encode(t, add_special_tokens=False).ids, repr(t)


def test_cut_bytes_decode_to_the_replacement_sign():
    e = bpe.Encoder(bpe.Vocabulary.parse(open(PATH, encoding="utf-8").read()))
    packed = e.encode("é😀")
    ids = list(memoryview(packed).cast("I"))
    for i in range(len(ids)):
        assert e.decode(b"".join(x.to_bytes(4, "little") for x in ids[: i + 1])) == own_tokenizer().decode(ids[: i + 1], skip_special_tokens=False)


def brute_targets(sizes, weights=(3, 1, 2)):
    """Source -> target, by sharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        per = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * per >= 2 * sizes[s]}
        if not full:
            return out | {s: w[s] * per for s in open_}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2.0 * sizes[s] for s in full)
        open_ -= full
    return out


def test_mixing(spark):
    r = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(r.randint(0, 40))), r.choice(["a", "é", "Z", "zz", "", None, "big", "big", "big"])) for i in range(3000)]
    rows += [(9000, None, "a"), (9001, "", "only empty"), (9002, " \t\n", None), (0, rows[0][1], rows[0][2]), (None, "x y", "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({"size": F.lit("s"), "rate": F.lit(1), "note": F.lit("n")})
    got = mixing.mixed(docs.repartition(7)).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    taken = Counter()
    for x in got:
        assert x["target"] == pytest.approx(want[x["source"]]) and x["source_size"] == sizes[x["source"]] and x["note"] == "n" and 0 <= x["copies"] <= 2
        taken[x["source"]] += x["size"] * x["copies"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.15 * t + 40
    again = mixing.mixed(docs.coalesce(1)).collect()
    assert Counter((x["doc_id"], x["text"], x["copies"]) for x in again) == Counter((x["doc_id"], x["text"], x["copies"]) for x in got)
    emitted = mixing.taken(docs)
    assert emitted.columns == docs.columns and emitted.select("size", "rate").distinct().collect() == [("s", 1)] and emitted.count() == sum(x["copies"] for x in got)
    assert mixing.mixed(docs.where("false")).collect() == []
    assert [x["copies"] for x in mixing.mixed(docs.where("text = ''")).collect()] == [0] * docs.where("text = ''").count()


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.example.net", "/en/x", "block"), ("tie.com", "/", "allow"), ("tie.com", "/", "block"), ("", "/", "block"), (None, "/", "block")]


def brute_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


@pytest.mark.parametrize("shared", [1_000_000, 0])
def test_urls(spark, shared):
    r = random.Random(3)
    cases = [None, "", "no scheme", "http://", "http://net", "http://NET/", "https://X.Example.NET/en/1?q#f", "http://a.example.net/en/xy", "http://b.a.example.net/en/y", "x://y://net/", "http://tie.com/", "http://net?x/", "http://example.com/de", "http://İ.net/", "http://" + "a." * 3000 + "net/" + "p" * 5000, "http://..net/", "http://notnet/en/"]
    cases += ["".join(r.choice(["http://", "net", "example", ".", "com", "/", "en/", "de/", "?", "#", "org", "/fr/"]) for _ in range(8)) for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(cases)) + [(0, None), (5, cases[5])], "page_id bigint, url string").withColumns({"rule": F.lit(1), "digest": F.lit(2), "html": F.lit("h")})
    ruled = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = urls.judged(pages, ruled, shared=shared).collect()
    assert len(got) == len(cases) + 2
    for x in got:
        assert (x["host"], x["path"], x["rule"], x["verdict"]) == brute_verdict(cases[x["page_id"]]) and x["html"] == "h"
    assert {x["verdict"] for x in urls.judged(pages, ruled.where("false"), otherwise="block").collect()} == {"block"}
    assert urls.judged(pages.where("false"), ruled).collect() == []


def test_html(spark):
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body><nav><ul><li><a href="/a">A</a></li></ul></nav>'
        '<div class="ad">Buy &amp; go</div><article><h1>Head &amp;\n line</h1><p><b>One.<br><p>Two&nbsp; 3 &lt; 4</p><ul><li>I<li>II</ul><aside>no</aside>tail<form>f<input></form>'
        '<div class="comments"><p>c1</p></div></article><!-- <p>gone</p> --><footer>&copy; x</footer>'
    )
    cases = [page, None, "", "plain", "<article><p>" + "long " * 50_000 + "</p></article>", "<article><p>cut</p><p>open <a hre", page]
    pages = spark.createDataFrame([(i, "u", c) for i, c in enumerate(cases)] + [(None, None, page)], "page_id bigint, url string, html string").withColumn("text", F.lit(5))
    got = {(x["page_id"]): x for x in html.extracted(pages).collect()}
    text = "Head & line\nOne.\nTwo 3 < 4\nI\nII\ntail"
    assert [got[i]["text"] for i in (0, 1, 2, 6, None)] == [text, "", "", text, text]
    assert got[4]["text"] == " ".join(["long"] * 50_000) and got[5]["text"] == "cut\nopen" and got[0]["n_chars"] == len(text)
    assert html.extracted(pages.where("false")).collect() == []


def test_marginals_equal_enumeration():
    model = html.fit(html.skeletons())
    nodes = html.parse("<div class='x'><p>Some words here to read</p><div class='ad'><p>no</p></div></div><footer><p>f</p></footer>")
    own = [model.evidence.get(x, 1.0) for x in html.seen(nodes)]
    n, total, on = len(nodes), 0.0, [0.0] * len(nodes)
    for bits in range(1 << n):
        y = [bits >> i & 1 for i in range(n)]
        p = (0.99 if y[0] else 0.01) * (own[0] if y[0] else 1)
        for i in range(1, n):
            q = model.joint(nodes[i]) if y[nodes[i].parent] else model.RARE
            p *= (q if y[i] else 1 - q) * (own[i] if y[i] else 1)
        total += p
        for i in range(n):
            on[i] += p * y[i]
    assert model.marginals(nodes) == pytest.approx([x / total for x in on])


def test_skeletons_are_learned():
    model = html.fit(html.skeletons())
    wrong = right = 0
    for page in html.skeletons():
        nodes = html.parse(page)
        for node, p, y in zip(nodes, model.marginals(nodes), html.labelled(nodes)):
            if any(isinstance(x, str) for x in node.parts):
                right, wrong = right + ((p > 0.5) == y), wrong + ((p > 0.5) != y)
    assert wrong <= 0.03 * (right + wrong)


def test_toxicity(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = toxicity.scored(docs, model).join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(x[0], x[1]): x[2] for x in got}
    assert n[1, 1] >= 0.88 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.02 * n[0, 0]
    words = {"1d10t": "idiot", "m0r0n": "moron", "tr4sh": "trash", "$tupid": "stupid", "stuuupid": "stupid", "sc.um": "scum", "i d i o t": "idiot", "i.d.i.o.t": "idiot", "w0rthl3ss": "worthless", "of%%%": "of", "word,": "word"}
    assert {w: model.reader.words(w) for w in words} == {w: [x] for w, x in words.items()}
    plain = model.score("the and of")
    assert model.score("the and of 1d10t m0ron") > 0.3 > plain
    edge = spark.createDataFrame([(1, None), (1, ""), (None, "idiot moron"), (2, "a " * 100_000), (3, "x" * 20_000)], "doc_id bigint, text string").withColumn("score", F.lit("s"))
    out = toxicity.scored(edge, model).collect()
    assert len(out) == 5 and all(0 <= x["score"] <= 1 for x in out) and out[0]["score"] == out[1]["score"]
    assert toxicity.scored(edge.where("false"), model).collect() == []
    nothing = toxicity.fit(edge.select("doc_id", "text"), labels.where("false"))
    assert {x["predicted"] for x in toxicity.scored(edge, nothing).collect()} == {0}


def test_toxicity_fit_sends_the_driver_only_chosen_features(spark, monkeypatch):
    rng = np.random.default_rng(3)
    common = [f"{a}{b}{c}" for a in ("ba", "do", "ki", "lu") for b in ("mer", "nat", "sol", "tir") for c in ("an", "eth", "is", "om", "ux")]
    lines = []
    for i in range(600):
        words = [str(w) for w in rng.permutation(common)[:70]] + (["idiot", "moron"] if i % 5 == 0 else [])
        lines.append((i, " ".join(words), int(i % 5 == 0)))
    docs = spark.createDataFrame([x[:2] for x in lines], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in lines], "doc_id bigint, toxic int")
    sent, plain = [], type(docs).toArrow

    def counted(df):
        out = plain(df)
        if "found" in out.column_names:
            sent.append(sum(len(f) for f in out["found"].to_pylist()) // 4)
        return out

    monkeypatch.setattr(type(docs), "toArrow", counted)
    model = toxicity.fit(docs, labels)
    # The same model from all features at once: those of the toxic rows that are e times likelier there, weighted by the same fit.
    taught = [(y, toxicity.Reader(model.reader.cost).features(text)) for i, text, y in lines if zlib.crc32(str(i).encode()) % 4 != 2]
    ones, zeros = sum(y for y, _ in taught), sum(1 - y for y, _ in taught)
    n1, n0 = (Counter(f for y, found in taught if y == label for f in found) for label in (1, 0))
    chosen = {f for f, n in n1.items() if n >= 3 and np.log((n + 0.5) / (ones + 1)) - np.log((n0[f] + 0.5) / (zeros + 1)) > 1}
    assert set(model.reader.chosen) == chosen and 0 < len(chosen) < 20
    rows = [[model.reader.chosen[f] for f in found if f in chosen] for _, found in taught]
    weights, bias = toxicity._logistic(np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array(sum(rows, [])), np.array([y for y, _ in taught], float), len(chosen))
    assert np.allclose([model.weights[model.reader.chosen[f]] for f in sorted(chosen)], [weights[model.reader.chosen[f]] for f in sorted(chosen)]) and np.isclose(model.bias, bias)
    assert sum(sent) == sum(len(r) for r in rows)


def brute_measures(text):
    text = text or ""
    blank = "\x20\x09\x0a\x0b\x0c\x0d"
    for c in blank[1:]:
        flat = text.replace(c, " ") if c == "\x09" else flat.replace(c, " ")
    w = [x for x in flat.split(" ") if x]
    lines = [x for x in text.split("\n") if x.strip(blank)]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_rules(spark):
    r = random.Random(4)
    texts = ["".join(r.choice(["a", "bb", "É", " ", " ", "\n", "\x0b", "#", "one two three four five six ", "\u2003"]) for _ in range(r.randint(0, 60))) for _ in range(300)]
    texts += [None, "", "\n\n", "x" * 100_000, "w " * 50_000, "OF!! THE!! " * 10, "and&&& of%%% " * 10]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0]), (None, texts[1])], "doc_id bigint, text string").withColumns({"failed": F.lit("x"), "n_words": F.lit("y")})
    book = rules.verdict(rules.ledger(docs)).cache()
    got = book.collect()
    for x in got:
        m = brute_measures(texts[x["doc_id"] if x["doc_id"] is not None else 1])
        assert tuple(x[c] for c in rules.MEASURES[:5]) == m
        assert x["base_failed"] == (m[0] < 10 or 100 * m[4] > 20 * m[0]) and not (x["kept"] and x["base_failed"])
        assert x["kept"] == (x["rejected_by"] == 0 and not x["base_failed"])
    cut = {(x["policy"], x["rule"]): x for x in rules.ablation(book).collect()}
    for version, names in rules.POLICIES.items():
        whole = rules.mask(names)
        for name in names:
            bit = rules.mask([name])
            assert cut[version, name]["failed"] == sum(bool(x["failed"] & bit) for x in got)
            assert cut[version, name]["alone"] == sum(x["failed"] & whole == bit for x in got)
            assert cut[version, name]["kept"] == sum(not x["failed"] & whole for x in got)
    kept = rules.kept_rows(docs)
    assert kept.columns == docs.columns and Counter(x["doc_id"] for x in kept.collect()) == Counter(x["doc_id"] for x in got if x["kept"])
    assert rules.ledger(docs.where("false")).collect() == [] and rules.kept_rows(docs.where("false")).collect() == []


@pytest.mark.parametrize("blank", ["\xa0", "\u3000", "\x85", "\x1c", "\x1f", "\u2003"])
def test_upper_words_are_those_counted(blank):
    told = dict(zip(rules.MEASURES, rules.measure(" ".join([f"AAA{blank}bbb"] * 10 + ["OF", "É!"]))))
    assert (told["n_words"], told["n_upper_words"]) == (12, 2)


def test_patience_is_an_alignment():
    r = random.Random(5)
    for _ in range(200):
        a, b = ([r.choice("abcdefghij") for _ in range(r.randint(0, 25))] for _ in range(2))
        found = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in found) and all(x < u and y < v for (x, y), (u, v) in zip(found, found[1:]))
        assert licenses.patience(a, a) == [(i, i) for i in range(len(a))]


def test_licenses(spark):
    apache, mit = licenses.STATEMENTS["Apache-2.0"], licenses.STATEMENTS["MIT text"]
    changed = mit.replace("without restriction", "with no restriction").replace("free of charge", "free of any charge")
    filler = "the and of to in a " * 2000
    cases = [None, "", filler, apache, filler + "\n" + apache + "\n" + apache + filler, "licensed under the", changed.upper(), filler + changed + filler, "All rights\nreserved. Released under the MIT License.", (apache + " ") * 300, "license, the under licensed version 2.0 apache"]
    docs = spark.createDataFrame(list(enumerate(cases)) + [(0, None), (None, apache)], "doc_id bigint, text string").withColumn("license", F.lit(1))
    got = {x["doc_id"]: x for x in licenses.scanned(docs).collect()}
    assert [got[i]["license"] for i in range(len(cases))] == [None, None, None, "Apache-2.0", "Apache-2.0", None, "MIT text", "MIT text", "MIT", "Apache-2.0", None]
    assert got[8]["licenses"] == ["All rights reserved", "MIT"] and got[None]["coverage"] == 1.0 and 0.9 < got[7]["coverage"] < 1
    assert got[4]["first_word"] == 12000 and got[4]["last_word"] == 12007
    assert licenses.scanned(docs.where("false")).collect() == []


def test_standard_licenses_are_found():
    from seqalert.llm.license_texts import TEXTS

    scanner, filler = licenses.Scanner(licenses.STATEMENTS, licenses.COVERAGE), "ordinary words of a story " * 50
    assert scanner.scan(filler) is not None and list(scanner.scan(filler)) == []
    for name, text in TEXTS.items():
        found = {f[0]: f[1] for f in scanner.scan(filler + text + " " + filler)}
        assert found.get(name) == max(found.values()) and found[name] > 0.97, name
        if len(text.split()) < 300:
            best = max(found, key=lambda n: (found[n], len(scanner.words[n])))
            assert found[name] == 1.0 and best == name, (name, best)
    for start in ("BSD-2", "BSD-3", "ISC", "MPL-2", "LGPL-2.1", "LGPL-3", "AGPL-3", "Unlicense", "CC-BY-SA", "CC0", "GPL-2", "GPL-3.0 header"):
        assert any(n.startswith(start) for n in TEXTS), start


def test_kept_rows_follow_the_bits(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "some plain words " * 1 + "here and there that nobody minds at all today"), (2, "few")], "doc_id bigint, text string")
    assert [x["doc_id"] for x in rules.kept_rows(docs).collect()] == [1]
    monkeypatch.setattr(rules, "failed_bits", lambda *prefix: F.lit(rules.mask(["shouting"])).cast("bigint"))
    assert rules.kept_rows(docs).collect() == []


@pytest.mark.parametrize("text", ["7" * 1_000_000, "=" * 1_000_000, "a. " * 330_000, "= " * 500_000, "A" * 1_000_000])
def test_rules_measure_long_texts_quickly(text):
    start = time.perf_counter()
    told = dict(zip(rules.MEASURES, rules.measure(text)))
    assert time.perf_counter() - start < 5
    assert told["n_words"] == len(text.split()) and told["n_alpha_words"] == sum(any(c.isalpha() for c in w) for w in text.split())


def test_repeated_licenses_are_scanned_quickly():
    scanner = licenses.Scanner(licenses.STATEMENTS, licenses.COVERAGE)
    long = max(licenses.STATEMENTS, key=lambda name: len(scanner.words[name]))
    words = licenses.STATEMENTS[long].split()
    changed = " ".join("other" if i % 40 == 7 else w for i, w in enumerate(words))
    for text in (" ".join([licenses.STATEMENTS[long]] * 10), " ".join([changed] * 10)):
        start = time.perf_counter()
        found = {name: cover for name, cover, _, _ in scanner.scan(text)}
        assert time.perf_counter() - start < 20 and found[long] > 0.95


def test_what_is_not_shown_parts_no_block():
    model = html.fit(html.skeletons())
    text = lambda body: model.extract(f"<article><h1>Title of the story</h1>{body}<p>{'Some plain words to read. ' * 8}</p></article>").split("\n")[1:-1]
    for inner in ("<script>var a='</p>';</script>", "<svg><path d=''/></svg>", "<noscript>n</noscript>", "<select><option>o</select>", "<button>ok</button>", "<picture><img src=x></picture>", "<x-mark></x-mark>", "<style>p{}</style>"):
        assert text(f"<p>Hello {inner} big world.</p>") == ["Hello big world."], inner
    assert text("<p>A <x-y>b</x-y> c<p>d <em>e</em></p>") == ["A b c", "d e"]
    assert text("<div>one <script>x</script> two<p>three</p>four</div>") == ["one two", "three", "four"]
    assert text('<p class="x>Hello there</p><p title=\'y">more</p>') == ["Hello there", "more"] or text('<p class="x>Hello there</p>') == ["Hello there"]


def test_stray_end_tags_take_no_time():
    page = "<article>" + "<div>" * 10_000 + "<p>text</p>" + "</section>" * 20_000 + "</div>" * 10_000 + "<li>" * 5000
    start = time.perf_counter()
    nodes = html.parse(page)
    assert time.perf_counter() - start < 3 and sum(n.tag == "div" for n in nodes) == 10_000
