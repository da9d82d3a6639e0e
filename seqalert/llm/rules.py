"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule; a policy is a
version with a mask of rules that reject. Verdicts, changes of policy and ablations are bit operations on the ledger and
never read a text again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from seqalert.llm.text import emitted, rows, windows, word_hashes

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_alpha_words"]
#: Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
#: A rule fails where its condition on the measurements holds. The place in this list is the rule's bit, so rules are
#: only ever added at the end.
RULES = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbol_dense", "100 * n_symbols > 15 * n_words"),
    ("shouting", "n_words >= 10 and 100 * n_upper_words > 60 * n_words"),
    ("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    ("few_letters", "n_words >= 10 and 100 * n_alpha_words < 50 * n_words"),
    ("long_words", "word_chars > 40 * n_words"),
]
#: Version -> rules that reject. A version is never changed once it is used.
POLICIES = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "symbol_dense", "shouting"],
    "v2": ["few_words", "repeated_windows", "symbol_dense", "shouting", "repeated_lines", "few_letters", "long_words"],
}
CURRENT = "v1"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of a text, in the order of ``MEASURES``; all 0 for null."""
    if not text:
        return (0,) * len(MEASURES)
    data = text.encode("utf-8", "surrogatepass")
    found = data.split()
    n = len(found)
    b = np.frombuffer(data, np.uint8)
    blank = data.count(b" ") + data.count(b"\n") + data.count(b"\t") + data.count(b"\r") + data.count(b"\x0b") + data.count(b"\x0c")
    chars = len(text) - blank
    symbols = int(_SYMBOL[b].sum())
    lines = [line for line in data.split(b"\n") if line.split(None, 1)]
    repeated = 0
    if n > 5:
        run = windows(word_hashes(found), 5)
        order = np.argsort(run, kind="stable")
        same = run[order[1:]] == run[order[:-1]]
        twice = np.zeros(len(run), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        if twice.any():
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, np.flatnonzero(twice), 1)
            np.add.at(edge, np.flatnonzero(twice) + 5, -1)
            repeated = int((np.cumsum(edge[:n]) > 0).sum())
    spelt = [w.decode("utf-8", "surrogatepass") for w in found]
    upper, alpha = sum(w.isupper() for w in spelt), sum(any(map(str.isalpha, w)) for w in spelt)
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), upper, alpha


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the measurements and ``failed`` (one bit per failed rule) of every row of ``docs``.

    A null or blank text has no words and fails only what its zeros fail. Rows that repeat an id are rows of the ledger;
    other columns are ignored; an empty table gives an empty ledger."""
    schema = pa.schema([("doc_id", pa.int64()), *[(m, pa.int64()) for m in MEASURES]])

    def make(batches) -> Iterator[tuple]:
        for doc, body in rows(batches):
            yield doc, *measure(body)

    picked = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    out = picked.mapInArrow(lambda b: emitted(make(b), schema), "doc_id bigint, " + ", ".join(f"{m} bigint" for m in MEASURES))
    return out.withColumn("failed", failed_bits())


def failed_bits(prefix: str = "") -> Column:
    """One bit per failed rule, from the measurements in columns whose names start with ``prefix``."""
    named = lambda rule: re.sub(r"[a-z_]+", lambda m: prefix + m[0] if m[0] in MEASURES else m[0], rule)
    bits = [F.when(F.expr(named(rule)), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out.cast("bigint")


def mask(rules: list[str]) -> int:
    place = {name: i for i, (name, _) in enumerate(RULES)}
    return sum(1 << place[r] for r in set(rules))


def verdict(book: DataFrame, policy: str = CURRENT, policies: Mapping[str, list[str]] = POLICIES) -> DataFrame:
    """Add ``rejected_by`` (failed bits that the policy counts), ``base_failed``, ``kept`` and ``policy``."""
    counted = F.col("failed").bitwiseAND(F.lit(mask(policies[policy])))
    base = F.col("failed").bitwiseAND(F.lit(mask(policies["base"]))) != 0
    return book.withColumns({"rejected_by": counted, "base_failed": base, "kept": ~base & (counted == 0), "policy": F.lit(policy)})


def ablation(book: DataFrame, policies: Mapping[str, list[str]] = POLICIES) -> DataFrame:
    """Per policy and rule: ``failed`` (documents that fail the rule), ``alone`` (that no other rule of the policy rejects, so
    dropping the rule would keep them) and ``kept`` (documents the policy keeps). The ledger is first counted by its bits, of
    which there are at most 2 to the number of rules, whatever the number of documents."""
    by_bits = book.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    cases = [(v, r, mask([r]), mask(rules)) for v, rules in policies.items() for r in rules]
    case = F.explode(F.array(*[F.struct(F.lit(v).alias("policy"), F.lit(r).alias("rule"), F.lit(bit).alias("bit"), F.lit(m).alias("mask")) for v, r, bit, m in cases]))
    each = by_bits.select("failed", "n", case.alias("c")).select("failed", "n", "c.*").withColumn("hit", F.col("failed").bitwiseAND(F.col("mask")))
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return each.groupBy("policy", "rule").agg(
        count(F.col("hit").bitwiseAND(F.col("bit")) != 0).alias("failed"), count(F.col("hit") == F.col("bit")).alias("alone"), count(F.col("hit") == 0).alias("kept")
    )


def kept_rows(docs: DataFrame, policy: str = CURRENT, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with all their columns and nothing else: each row gets its failed bits where it
    lies and is kept by the policy's mask, so ids may be null or repeated."""
    counted = mask([*POLICIES[policy], *POLICIES["base"]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                told = list(zip(*map(measure, part.column(at).to_pylist())))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, pa.int64()) for c in told)], names=[*part.schema.names, *[f"_m_{m}" for m in MEASURES]])

    schema = StructType([*docs.schema, *[StructField(f"_m_{m}", LongType()) for m in MEASURES]])
    failed = failed_bits("_m_")
    return docs.mapInArrow(add, schema).where(failed.bitwiseAND(F.lit(counted)) == 0).select(docs.columns)
