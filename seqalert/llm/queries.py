"""One query per operator over its whole table, and check SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqalert.llm import bpe, collocations, html, jaccard, licenses, mixing, neighbours, periods, projections, rules, shards, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The url query's rules: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query()
def op1_neighbours(spark, d):
    vectors = table(spark, d, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


@query()
def op2_shards(spark, d):
    return shards.sharded(table(spark, d, "documents"), shards=24)


@query()
def op3_bpe(spark, d):
    return bpe.digests(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op4_mixing(spark, d):
    rows = mixing.mixed(table(spark, d, "documents"), weights=(3, 1, 2), share_of_all=1.5, most=2.0)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


_URL_SQL = """
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM p),
u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(rhost, rpath, ruled) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT DISTINCT host, path, rhost || rpath AS rule, ruled FROM (SELECT DISTINCT host, path FROM u) k, r
    WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
b AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(ruled, length(rule)) AS ruled FROM m GROUP BY host, path)
SELECT page_id, u.host, u.path, rule, coalesce(ruled, 'allow') AS verdict FROM u LEFT JOIN b ON b.host = u.host AND b.path = u.path"""


@query(_URL_SQL)
def op5_urls(spark, d):
    ruled = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judged(table(spark, d, "pages"), ruled).select("page_id", "host", "path", "rule", "verdict")


@query()
def op6_jaccard(spark, d):
    return jaccard.near_groups(table(spark, d, "documents"), k=4, percent=85)


@query()
def op7_html(spark, d):
    return html.extracted(table(spark, d, "pages"))


@query()
def op8_toxicity(spark, d):
    docs = table(spark, d, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, d, "labels")), threshold=0.3)


_RULES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM (SELECT row, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w)),
c AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(i, i + 5)) AS p FROM g WHERE n > 1) GROUP BY row),
m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x)) AS n_upper FROM w LEFT JOIN c ON c.row = w.row),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND 100 * n_symbols <= 15 * n_words AND 100 * n_upper <= 60 * n_words AS kept FROM b"""


@query(_RULES_SQL)
def op9_rules(spark, d):
    book = rules.verdict(rules.ledger(table(spark, d, "documents")))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query()
def op10_licenses(spark, d):
    return licenses.scanned(table(spark, d, "documents"))


@query()
def op11_projections(spark, d):
    return projections.near_groups(table(spark, d, "embeddings"), least=0.95)


@query()
def op12_periods(spark, d):
    return periods.digests(periods.periodic(table(spark, d, "documents"), prepare=periods.planted))


_COLLOCATIONS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
s AS (SELECT lang, unnest(list_concat(list_transform(range(1, len(w) + 1), lambda i: w[i:i]), list_transform(range(1, len(w)), lambda i: w[i:i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]))) AS g FROM p),
f AS (SELECT lang, g, count(*) AS f FROM s GROUP BY lang, g),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(g) = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE len(g) > 1 AND f >= 10),
x AS (SELECT c.lang, c.g, c.f AS a, k, one.f AS l, two.f AS r, (1000000::HUGEINT * c.f * c.f) // (one.f::HUGEINT * two.f) AS score
    FROM (SELECT *, unnest(range(1, len(g))) AS k FROM c) c
    JOIN f one ON one.lang = c.lang AND one.g = c.g[1:k] JOIN f two ON two.lang = c.lang AND two.g = c.g[k + 1:]),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
h AS (SELECT lang, g, max(f) AS over FROM (SELECT lang, f, unnest([g[1:2], g[2:3]]) AS g FROM c WHERE len(g) = 3) GROUP BY lang, g),
o AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN h ON h.lang = b.lang AND h.g = b.g WHERE over IS NULL OR 100 * over < 50 * a)
SELECT o.lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o) o JOIN t ON t.lang = o.lang WHERE rank <= 2000"""


@query(_COLLOCATIONS_SQL)
def op13_collocations(spark, d):
    return collocations.collocations(table(spark, d, "documents"), most=3, least=10, inside=50, k=2000)
