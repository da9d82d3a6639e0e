"""The pipeline's stages against brute force, and the queries with check SQL."""

from collections import Counter
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from seqalert.llm import queries, rules, toxicity

from .test_pairs import brute_groups
from .test_texts import brute_targets


def written(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality_rules", "ngram_jaccard", "mixing", "bpe"]
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    first = written(stages["toxicity"](spark, docs, sf), tmp_path / "0")
    rejected = {r["doc_id"] for r in toxicity.scored(docs, model).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in first.collect()} == {r["doc_id"] for r in docs.collect()} - rejected

    second = written(stages["quality_rules"](spark, first, sf), tmp_path / "1")
    kept = {r["doc_id"] for r in rules.verdict(rules.ledger(first)).where("kept").collect()}
    assert {r["doc_id"] for r in second.collect()} == kept

    third = written(stages["ngram_jaccard"](spark, second, sf), tmp_path / "2")
    rows = [(r["doc_id"], r["text"]) for r in second.collect()]
    assert sorted(r["doc_id"] for r in third.collect()) == sorted({c for _, _, c in brute_groups(rows, 5, 80)})

    fourth = written(stages["mixing"](spark, third, sf), tmp_path / "3")
    sizes = Counter()
    for r in third.collect():
        sizes[r["source"]] += len(r["text"].split())
    target = brute_targets(sizes)
    size = {r["doc_id"]: (r["source"], len(r["text"].split())) for r in third.collect()}
    for doc, n in Counter(r["doc_id"] for r in fourth.collect()).items():
        rate = target[size[doc][0]] / sizes[size[doc][0]]
        assert n in (int(rate + 1e-9), int(rate + 1e-9) + 1)
    for stage in (first, second, third, fourth):
        assert stage.columns == docs.columns

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.no_padding()
    own.no_truncation()
    text = {r["doc_id"]: r["text"] for r in fourth.collect()}
    last = stages["bpe"](spark, fourth, sf).collect()
    assert Counter(r["doc_id"] for r in last) == Counter(r["doc_id"] for r in fourth.collect())
    for r in last:
        assert list(r["ids"]) == own.encode(text[r["doc_id"]], add_special_tokens=False).ids and r["decoded"] == text[r["doc_id"]]


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "ids", "decoded", "n_tokens"] and out.count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    cur = con.execute(queries.ORACLE[name])
    df = queries.QUERIES[name](spark, sf)
    assert sorted(c[0] for c in cur.description) == sorted(df.columns)
    got = df.select(*[c[0] for c in cur.description]).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, cur.fetchall()))


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
