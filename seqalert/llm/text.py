"""Words and word shingles of UTF-8 texts inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(29))


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; ``bytes.split`` knows exactly these six separators."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """Like ``words`` with A-Z in lower case; ``bytes.lower`` changes no other letter."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words; of the whole sequence where it is shorter."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(k, n)
    out = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        out = mix(out * _ODD + hashes[j : n - k + 1 + j])
    return out


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingles of ``k`` lower-cased words as 64-bit hashes."""
    return np.unique(windows(word_hashes(lower_words(text)), k))


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches, a few at a time, so that few long texts are decoded at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns))


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with equal first ``keys`` columns."""
    last, held = None, []
    for row in rows(batches):
        key = row[:keys]
        if held and key != last:
            yield last, held
            held = []
        last = key
        held.append(row)
    if held:
        yield last, held


def emitted(make: Iterator[tuple], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of the tuples that ``make`` yields."""
    held = []
    for row in make:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def sampled(df: DataFrame, keys: list[str], rows: int, seed: int) -> DataFrame:
    """About ``rows`` rows of ``df`` (all of a smaller table), chosen by a seeded hash of their ``keys``. Equal rows are chosen
    together, so no more than twice that many are given; every task decides alone, and nothing else leaves it."""
    n = df.count()
    if n <= rows:
        return df
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 12) / float(1 << 52)
    return df.where(draw < rows / n).limit(2 * rows)


def share_parts(sc, *parts):
    """Broadcast of plain values from which ``made`` builds an object on the executors."""
    return sc.broadcast({"parts": parts})


def made(told, make):
    """What ``make`` builds from the parts of a broadcast. It is kept with the broadcast, so a Python worker builds it once, and
    what it has learned serves the worker's later tasks."""
    held = told.value
    if "made" not in held:
        held["made"] = make(*held["parts"])
    return held["made"]


def emitted_texts(make: Iterator[tuple], schema: pa.Schema, at: int, chars: int = 1 << 22, size: int = 5000) -> Iterator[pa.RecordBatch]:
    """Like ``emitted``, for tuples whose entry ``at`` is a text: a batch ends after about ``chars`` characters."""
    held, total = [], 0
    for row in make:
        held.append(row)
        total += len(row[at] or "")
        if len(held) >= size or total >= chars:
            yield _batch(held, schema)
            held, total = [], 0
    if held:
        yield _batch(held, schema)
