"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

A bounded sample gives a mean, principal axes and a rotation (iterative quantisation), and with them one bit per
dimension. A code is split into substrings, and every block of vectors holds one bucket table per substring. A code within
Hamming distance ``radius`` of a query agrees with it up to ``radius // substrings`` bits in at least one substring, so
probing those buckets of every table finds all of them; the full code is checked and the rest are ranked by their cosine
in double precision on the original vectors. The radius is learned on the sample: wide enough for a wanted share of the
sample's own nearest neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqalert.llm.text import made, sampled, share_parts
from seqalert.session import cut

#: Vectors, about, that mean, rotation and radius are learned from, chosen by a seeded hash.
FIT_ROWS = 4096
#: Vectors that one task indexes, and queries that it answers, at once.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 2048
#: Bits of a substring.
SUBSTRING = 16


@dataclass(frozen=True)
class Codes:
    """Binary codes: ``sign((x / |x| - mean) @ turn)``, and the Hamming radius of a search."""

    mean: np.ndarray
    turn: np.ndarray
    radius: int

    def encode(self, unit: np.ndarray) -> np.ndarray:
        """Code of each row as 16-bit substrings."""
        bits = np.packbits((unit - self.mean) @ self.turn > 0, axis=1)
        return np.ascontiguousarray(bits).view(np.uint16)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(sample: np.ndarray, k: int = 5, reach: float = 0.97, rounds: int = 30, seed: int = 11) -> Codes:
    """Codes learned on ``sample`` (rows are vectors). Dimensions are padded to a multiple of 16 bits."""
    unit = _unit(sample)
    dim = unit.shape[1]
    bits = -(-dim // SUBSTRING) * SUBSTRING
    mean = unit.mean(0)
    _, axes = np.linalg.eigh(np.cov((unit - mean).T).reshape(dim, dim) if len(unit) > 1 else np.eye(dim))
    axes = np.pad(axes, ((0, 0), (0, bits - dim)))
    flat = (unit - mean) @ axes
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
        turn = (u @ vt).T
    codes = Codes(mean, axes @ turn, bits)
    asks = min(len(unit), 512)
    if len(unit) <= k + 1:
        return codes
    code = codes.encode(unit)
    near = unit[:asks] @ unit.T
    near[np.arange(asks), np.arange(asks)] = -2
    best = np.argpartition(-near, k, axis=1)[:, :k]
    apart = np.bitwise_count(code[:asks, None, :] ^ code[best]).sum(2)
    return Codes(mean, axes @ turn, int(np.quantile(apart, reach, method="higher")))


class Tables:
    """One bucket table per substring over the codes of a block."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = []
        for s in range(codes.shape[1]):
            self.tables.append(np.unique(codes[:, s], return_inverse=True))  # buckets, and the bucket of each row

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code lies within ``radius`` of ``query``."""
        hit = np.zeros(len(self.codes), bool)
        step = radius // self.codes.shape[1]
        for s, (value, bucket) in enumerate(self.tables):
            hit |= (np.bitwise_count(value ^ query[s]) <= step)[bucket]
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.codes[rows] ^ query).sum(1) <= radius]


def _usable(embedding: str):
    """Vectors that take part: no null or non-finite component, not all zero."""
    v = F.col(embedding)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", fit_rows: int = FIT_ROWS,
    reach: float = 0.97, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES, seed: int = 11,
) -> DataFrame:
    """The ``k`` rows of ``vectors`` found nearest to each row of ``queries``: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``.

    ``score`` is the cosine in double precision; ties go to the smaller ``vec_id``; a query's own id is no candidate; fewer
    than ``k`` candidates give fewer rows. Vectors that are null, zero or hold a null or non-finite component take no part,
    nor do rows without id and vectors whose length is not that of most of the sample. Rows that repeat an id count as one with the
    smallest vector; other columns are ignored; empty tables give an empty result.

    A block of vectors and a block of queries meet in one task, which sends the best ``k`` of each query on; every vector is
    indexed. The fit reads about ``fit_rows`` vectors. A block with fewer than ``k`` vectors inside the radius for a query looks
    at all of its own for it, so that no query is left short."""
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(F.col(vec_id).cast("bigint").alias("id"), F.transform(F.col(embedding), lambda x: x.cast("double")).alias("v"))
        return df.where(F.col("id").isNotNull() & _usable("v")).groupBy("id").agg(F.min("v").alias("v"))

    held = cut(clean(vectors))
    order = F.xxhash64(F.lit(seed), "id")
    sample = sorted(sampled(held, ["id"], fit_rows, seed).collect(), key=lambda r: r["id"])
    if not sample:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    lengths = [len(r["v"]) for r in sample]
    dim = max(sorted(set(lengths)), key=lengths.count)
    held = held.where(F.size("v") == dim)
    codes = fit(np.array([r["v"] for r in sample if len(r["v"]) == dim]), k, reach, seed=seed)
    asked = clean(queries).where(F.size("v") == dim)
    blocks, asks = max(1, -(-held.count() // block_rows)), max(1, -(-asked.count() // block_queries))

    def placed(df: DataFrame, own: str, n: int, other: str, m: int, query: bool) -> DataFrame:
        df = df.withColumn(own, F.pmod(order, F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        return df.select("block", "ask", F.lit(query).alias("query"), "id", "v")

    both = placed(held, "block", blocks, "ask", asks, False).unionByName(placed(asked, "ask", asks, "block", blocks, True))
    told = share_parts(spark.sparkContext, codes.mean, codes.turn, codes.radius)
    part = both.repartition("block", "ask").sortWithinPartitions("block", "ask", "query", "id")
    found = part.mapInArrow(_search(told, k, dim), "query_id bigint, vec_id bigint, score double")
    # k rows per query and block: structs sort by falling score, then by id.
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), F.col("vec_id").alias("vec_id")))), 1, k)
    top = found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("at", "b"))
    return top.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.less")).alias("score"))


def _search(told, k: int, dim: int):
    names = ["query_id", "vec_id", "score"]

    def answer(ids: np.ndarray, x: np.ndarray, asking: np.ndarray, q: np.ndarray):
        codes = made(told, Codes)
        norm = np.linalg.norm(x, axis=1)
        tables = Tables(codes.encode(x / norm[:, None]))
        for me, vector, code in zip(asking, q, codes.encode(_unit(q))):
            rows = tables.within(code, codes.radius)
            rows = rows[ids[rows] != me]
            if len(rows) < k:
                rows = np.flatnonzero(ids != me)
            score = (x[rows] * vector).sum(1) / norm[rows] / np.sqrt((vector * vector).sum())
            first = np.lexsort((ids[rows], -score))[:k]
            yield np.full(len(first), me), ids[rows][first], score[first]

    def run(batches):
        group, held = None, []

        def done():
            query = np.concatenate([h[0] for h in held])
            ids, x = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            if query.any() and not query.all():
                got = list(answer(ids[~query], x[~query], ids[query], x[query]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*got)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(i).to_numpy() for i in (0, 1)], 1)
            edge = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            ids = batch.column(3).to_numpy()
            query = batch.column(2).to_numpy(zero_copy_only=False)
            x = batch.column(4).flatten().to_numpy().reshape(-1, dim)
            for a, b in zip([0, *edge], [*edge, len(key)]):
                if held and tuple(key[a]) != group:
                    yield from done()
                    held = []
                group = tuple(key[a])
                held.append((query[a:b], ids[a:b], x[a:b]))
        if held:
            yield from done()

    return run
