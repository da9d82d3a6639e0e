"""Coreset selection: clusters of vectors, however many, and one real row for each.

Rows are split level by level: every part of a level is cut into at most ``part`` clusters by one k-means, and all parts of a level
are clustered by the same Spark jobs, so that the number of jobs follows the depth of the tree and not the number of clusters.
Centres are a table (one row a part) and never reach the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqalert.operators import ordering
from seqalert.operators.features import stack

#: Centres sent whole to every executor; more of them meet the rows by a shuffle.
SHARED_BYTES = 64 << 20
#: Rounds of seeding, each of which draws about ``OVERSAMPLE`` times the wanted centres.
ROUNDS, OVERSAMPLE = 2, 2
BLOCK = "part bigint, ids binary, hashes binary, points binary"


def coreset(df: DataFrame, fraction: float = 0.01, part: int = 256, seed: int = 42, vec: str = "vec", steps: int = 10, tol: float = 1e-3) -> DataFrame:
    """``cluster`` and the columns of ``df`` for one row of each cluster, the one nearest to its centre. There are ``fraction`` times as
    many clusters as rows (fewer where rows are equal).

    A part that is to have several clusters is seeded in rounds that draw rows by their squared distance to the seeds so far, and improved by
    up to ``steps`` rounds of means, until the summed distance of a level falls by less than ``tol``. Its clusters get their
    shares of its number by size, and are split on where that is above one. Draws follow from ``seed`` and the row, not from its partition.
    Rows without a vector take no part."""
    rows = ordering.cut(df.where(F.col(vec).isNotNull()).withColumn("_id", F.monotonically_increasing_id()))
    some = rows.select(F.count(F.lit(1)), F.max(F.size(vec))).head()
    wanted, dim = max(2, int(some[0] * fraction)), some[1] or 1
    points = rows.select(F.lit(1).cast("bigint").alias("part"), "_id", F.xxhash64(*df.columns).alias("_h"), F.col(vec).alias("_v"))
    parts = rows.sparkSession.createDataFrame([(1, wanted)], "part bigint, quota bigint")
    picks, level = None, 0
    while True:
        if level:
            # Ranges split a large part and bring the rows of small ones together.
            points = points.repartitionByRange("part", "_h").sortWithinPartitions("part")
        blocks = ordering.cut(points.mapInPandas(_packed, BLOCK).withColumn("slice", F.spark_partition_id()))
        centres = _Parts(blocks, parts.select("part", F.least("quota", F.lit(part)).alias("m")), dim, part, seed + level).fit(steps, tol)
        found = ordering.cut(centres.nearest(_members, "part bigint, child int, _id bigint, _h bigint, d double, _v array<double>"))
        shares = ordering.cut(_shares(found, parts))
        ended = found.join(ordering.share(shares.where("quota = 1").select("part", "child")), ["part", "child"])
        best = ended.groupBy("part", "child").agg(F.min_by("_id", F.struct("d", "_h", "_id")).alias("_id")).select(F.lit(level).alias("_level"), "part", "child", "_id")
        picks = best if picks is None else picks.unionByName(best)
        more = ordering.cut(shares.where("quota > 1").select("part", "child", (F.col("part") * part + F.col("child")).alias("_next"), "quota"))
        if not more.count():
            break
        points = found.join(ordering.share(more.select("part", "child", "_next")), ["part", "child"]).select(F.col("_next").alias("part"), "_id", "_h", "_v")
        parts, level = more.select(F.col("_next").alias("part"), "quota"), level + 1
    numbered = ordering.number_rows(ordering.cut(picks), ["_level", "part", "child"], name="cluster").select("cluster", "_id")
    return rows.join(ordering.share(ordering.cut(numbered)), "_id").select(F.col("cluster").cast("int"), *df.columns)


def _shares(found: DataFrame, parts: DataFrame) -> DataFrame:
    """``quota`` of every cluster: one, and its part by size of what its part has left. A part that did not divide is done."""
    sizes = found.groupBy("part", "child").agg(F.count(F.lit(1)).alias("n")).join(parts, "part")
    whole = Window.partitionBy("part")
    upto, total, extra = F.sum("n").over(whole.orderBy("child")), F.sum("n").over(whole), F.col("quota") - F.count(F.lit(1)).over(whole)
    sizes = sizes.select("*", upto.alias("upto"), total.alias("total"), extra.alias("extra"))
    at = lambda n: F.floor(n / F.col("total") * F.col("extra"))
    own = F.least("n", 1 + at(F.col("upto")) - at(F.col("upto") - F.col("n")))
    return sizes.select("part", "child", F.when(F.col("n") == F.col("total"), 1).otherwise(own).cast("bigint").alias("quota"))


class _Parts:
    """K-means of all parts of a level at once: ``blocks`` of rows (each of one part) beside ``wanted``, ``m`` centres a part."""

    def __init__(self, blocks: DataFrame, wanted: DataFrame, dim: int, most: int, seed: int) -> None:
        self.blocks, self.wanted, self.dim, self.seed = blocks, wanted, dim, seed
        self.shared = wanted.count() * 8 * dim * most * (1 + ROUNDS * OVERSAMPLE) <= SHARED_BYTES
        self.centres: DataFrame | None = None

    def nearest(self, fn: Callable, schema: str, extra: DataFrame | None = None) -> DataFrame:
        """``fn`` of every block beside the centres of its part (and the columns of ``extra``). Parts that together are too large to be sent
        whole are sent once to each slice that holds rows of them."""
        beside = self.centres if extra is None else self.centres.join(extra, "part")
        if self.shared:
            return self.blocks.join(F.broadcast(beside), "part").mapInPandas(fn, schema)
        sent = self.blocks.select("part", "slice").distinct().join(beside, "part")
        return self.blocks.join(sent, ["part", "slice"]).mapInPandas(fn, schema)

    def fit(self, steps: int, tol: float) -> "_Parts":
        dim, seed = self.dim, self.seed
        first = self.blocks.mapInPandas(lambda batches: _first(batches, seed), "part bigint, u double, _v array<double>")
        seeds = ordering.cut(first.groupBy("part").agg(F.min_by("_v", F.struct("u", "_v")).alias("_v")))
        self.centres = _stacked(seeds)
        for i in range(1, ROUNDS + 1):
            cost = self.nearest(_costs, "part bigint, cost double").groupBy("part").agg(F.sum("cost").alias("cost")).join(self.wanted, "part")
            drawn = self.nearest(lambda batches, i=i: _drawn(batches, seed + 1009 * i), "part bigint, _v array<double>", cost)
            seeds = ordering.cut(seeds.unionByName(drawn))
            self.centres = _stacked(seeds)
        weights = self.nearest(_sizes, "part bigint, child int, n bigint").groupBy("part", "child").agg(F.sum("n").alias("n"))
        # One row a part: about 1 + ROUNDS * OVERSAMPLE times the wanted centres, and their weights.
        told = weights.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("child", "n"))).alias("w"))
        told = told.select("part", F.col("w.child").alias("at"), F.col("w.n").alias("n")).join(self.centres, "part").join(self.wanted, "part")
        self.centres = ordering.cut(told.mapInPandas(lambda batches: _reduced(batches, dim, seed), "part bigint, centres binary"))
        last = None
        for _ in range(steps):
            sums = self.nearest(_means, "part bigint, child int, n bigint, cost double, _v array<double>").withColumn("_v", array_to_vector("_v"))
            mean = Summarizer.mean(F.col("_v"), F.col("n").cast("double")).alias("_v")
            moved = ordering.cut(_stacked(sums.groupBy("part", "child").agg(mean, F.sum("cost").alias("cost")).withColumn("_v", vector_to_array("_v")), F.sum("cost").alias("cost")))
            cost = moved.agg(F.sum("cost")).head()[0] or 0.0
            self.centres = moved.drop("cost")
            if last is not None and last - cost <= tol * last:
                break
            last = cost
        return self


def _stacked(seeds: DataFrame, *aggs: Column) -> DataFrame:
    """One row a part: its distinct points ``_v`` in order, as one matrix, and ``aggs``."""
    points = seeds.groupBy("part").agg(F.array_sort(F.collect_set("_v")).alias("_v"), *aggs)

    @F.pandas_udf("binary")
    def matrix(col: pd.Series) -> pd.Series:
        return pd.Series([np.array(list(v), dtype=float).tobytes() for v in col], index=col.index, dtype=object)

    return points.withColumn("centres", matrix("_v")).drop("_v")


def _packed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for part, rows in pdf.groupby("part"):
            yield pd.DataFrame({"part": [part], "ids": [rows["_id"].to_numpy("int64").tobytes()], "hashes": [rows["_h"].to_numpy("int64").tobytes()], "points": [stack(rows["_v"]).tobytes()]})


def _opened(batches: Iterable[pd.DataFrame]) -> Iterator[tuple]:
    """Row, hashes and points of every block, with the nearest centre of each point and the squared distance where centres lie beside it."""
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            hashes = np.frombuffer(r.hashes, "int64")
            x = np.frombuffer(r.points).reshape(len(hashes), -1)
            if not hasattr(r, "centres"):
                yield r, hashes, x, None, None
                continue
            yield r, hashes, x, *_closest(x, np.frombuffer(r.centres).reshape(-1, x.shape[1]))


def _closest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None, :]
    at = d.argmin(1)
    # The distance to the nearest is taken from the difference, so that a point on its centre has exactly none.
    return at, ((x - centres[at]) ** 2).sum(1)


def _uniform(hashes: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) from each hash and ``seed``."""
    z = hashes.view("uint64") + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / 2.0**53


def _first(batches: Iterable[pd.DataFrame], seed: int) -> Iterator[pd.DataFrame]:
    for r, hashes, x, _, _ in _opened(batches):
        u = _uniform(hashes, seed)
        yield pd.DataFrame({"part": [r.part], "u": [u.min()], "_v": [x[u.argmin()]]})


def _costs(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for r, _, _, _, d in _opened(batches):
        yield pd.DataFrame({"part": [r.part], "cost": [d.sum()]})


def _drawn(batches: Iterable[pd.DataFrame], seed: int) -> Iterator[pd.DataFrame]:
    for r, hashes, x, _, d in _opened(batches):
        hit = np.flatnonzero(_uniform(hashes, seed) * r.cost < OVERSAMPLE * r.m * d)
        if len(hit):
            yield pd.DataFrame({"part": r.part, "_v": list(x[hit])})


def _sizes(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for r, _, _, at, _ in _opened(batches):
        child, n = np.unique(at, return_counts=True)
        yield pd.DataFrame({"part": r.part, "child": child.astype("int32"), "n": n})


def _means(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for r, _, x, at, d in _opened(batches):
        order = np.argsort(at, kind="stable")
        child, start, n = np.unique(at[order], return_index=True, return_counts=True)
        mean = np.add.reduceat(x[order], start) / n[:, None]
        yield pd.DataFrame({"part": r.part, "child": child.astype("int32"), "n": n, "cost": np.add.reduceat(d[order], start), "_v": list(mean)})


def _members(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for r, hashes, x, at, d in _opened(batches):
        yield pd.DataFrame({"part": r.part, "child": at.astype("int32"), "_id": np.frombuffer(r.ids, "int64"), "_h": hashes, "d": d, "_v": list(x)})


def _reduced(batches: Iterable[pd.DataFrame], dim: int, seed: int) -> Iterator[pd.DataFrame]:
    """``m`` centres among the seeds of each part, drawn by weight and squared distance, then moved to the weighted means."""
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            x = np.frombuffer(r.centres).reshape(-1, dim)[np.asarray(r.at, dtype=int)]
            weight = np.asarray(r.n, dtype=float)
            if len(x) > r.m:
                rng = np.random.default_rng([seed, int(r.part)])
                chosen, d = [int(rng.choice(len(x), p=weight / weight.sum()))], np.full(len(x), np.inf)
                while len(chosen) < r.m:
                    d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(1))
                    if not (d * weight).sum():
                        break
                    chosen.append(int(rng.choice(len(x), p=d * weight / (d * weight).sum())))
                centres = x[chosen]
                for _ in range(10):
                    at, _ = _closest(x, centres)
                    centres = np.array([np.average(x[at == c], axis=0, weights=weight[at == c]) if (at == c).any() else centres[c] for c in range(len(centres))])
                x = centres
            yield pd.DataFrame({"part": [r.part], "centres": [np.ascontiguousarray(x).tobytes()]})
