"""Near duplicates among vectors by sorted projection passes.

A pass gives each vector a key, the signs of its products with random directions joined to a long bit string, sorts all vectors by
their keys and compares each with the next few in that order. Near vectors share a long beginning of the key with a probability
that falls slowly with the number of vectors, so there are as many passes as that number and the wanted reach ask for. A pair is kept
when its cosine in double precision is high enough; the pairs of all passes are united into components.

The passes decide who belongs together; a window of bounded width does not see all links of a large group. So the links inside a
component are counted on its vectors afterwards: a small component in one product of matrices, a large one by its mean direction. Two
members whose angles to it add up to no more than the largest angle of a link are linked for certain, so members within half that angle
need no comparison among themselves; the others are compared with all members, in blocks. No pair is written down: a pass sends one edge
a vector, the count one number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqalert.llm.components import components
from seqalert.llm.text import emitted
from seqalert.operators.ordering import number_rows, share, with_halo
from seqalert.session import cut

#: Bits of a key. Vectors that agree in all of them are ordered by id.
BITS = 96
#: Neighbours that a vector is compared with in each pass.
WINDOW = 32
#: Vectors of a chunk of the order, and of a block of a component.
CHUNK, BLOCK = 4096, 2048
#: Taken off half the largest angle, far above the error of an angle in double precision.
_SAFE = 1e-6


def passes(n: int, least: float, window: int = WINDOW, reach: float = 0.97) -> int:
    """Passes after which a pair with cosine ``least`` has been within a window with probability ``reach``.

    Such a pair agrees in a bit with probability 1 - angle / pi. Its neighbours in the order are about ``window`` when the common beginning
    leaves ``n / window`` other beginnings, one bit more to have it inside."""
    agree = 1 - math.acos(least) / math.pi
    bits = max(0.0, math.log2(max(1.0, n / window))) + 1
    met = agree**bits
    return 1 if met >= 1 else max(1, math.ceil(math.log(1 - reach) / math.log1p(-met)))


@lru_cache(maxsize=64)
def directions(number: int, dim: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, number, dim]).normal(size=(bits, dim))


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = pc.list_flatten(column)
    return flat.to_numpy().astype(np.float64).reshape(len(column), -1)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows with equal first ``keys`` columns (whole numbers)."""
    last, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy() for i in range(keys)], 1)
        edge = (np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist()
        for a, b in zip([0, *edge], [*edge, len(key)]):
            now = tuple(key[a])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _keyed(count: int, bits: int, seed: int):
    """``(pass, size, key, id)`` of every vector and pass; ``size`` is the vector's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(1).value_lengths().to_numpy()
            for dim in np.unique(size):
                part = batch.filter(pa.array(size == dim))
                x = _vectors(part.column(1))
                for number in range(count):
                    key = np.packbits(_products(x, directions(number, int(dim), bits, seed)) > 0, axis=1)
                    key = pa.FixedSizeBinaryArray.from_buffers(pa.binary(key.shape[1]), len(key), [None, pa.py_buffer(np.ascontiguousarray(key))])
                    sizes = pa.array(np.full(len(key), dim, np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), number, np.int32)), sizes, key.cast(pa.binary()), part.column(0)], names=["pass", "size", "key", "id"])

    return run


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of all rows of ``x`` with all rows of ``y``, in this thread: a task has one core, and a matrix library that starts threads of its
    own in every task slows all of them down."""
    return np.einsum("ik,jk->ij", x, y)


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square is too large or too small
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _compared(window: int, least: float):
    """One edge ``(a, b)`` for every vector of a chunk that is linked with an earlier one: to the first of its group in the chunk."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def linked(ids: list[int], x: np.ndarray) -> Iterator[tuple[int, int]]:
        parent = list(range(len(ids)))
        for at in range(0, len(ids), 4 * window):
            near = _products(x[at : at + 4 * window], x[at : at + 5 * window])
            i, j = np.nonzero(near >= least)
            keep = (j > i) & (j - i <= window)
            for a, b in zip((i[keep] + at).tolist(), (j[keep] + at).tolist()):
                a, b = _root(parent, a), _root(parent, b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        for i in range(len(ids)):
            top = _root(parent, i)
            if top != i:
                yield ids[i], ids[top]

    def make(batches) -> Iterator[tuple]:
        for group in _groups(batches, 3):
            yield from linked(group["id"].to_pylist(), _unit(_vectors(group["v"])))

    return lambda batches: emitted(make(batches), schema)


def _mean_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(component, v)``: sums of the unit vectors of a component, one row a batch and component."""
    for batch in batches:
        group = batch.column(0).to_numpy()
        for component in np.unique(group):
            part = batch.filter(pa.array(group == component))
            total = _unit(_vectors(part.column(1))).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([component]), pa.array([total.tolist()])], names=["component", "v"])


def _counted(least: float):
    """Links of the members of whole components, in the number of vectors that each member stands for."""
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64())])

    def make(batches) -> Iterator[tuple]:
        for group in _groups(batches, 1):
            x, n, ids = _unit(_vectors(group["v"])), group["n"].to_numpy(), group["id"].to_pylist()
            for at in range(0, len(ids), BLOCK):
                near = _products(x[at : at + BLOCK], x) >= least
                own = np.arange(at, at + len(near))
                near[own - at, own] = False
                yield from zip(ids[at : at + BLOCK], (near @ n).tolist())

    return lambda batches: emitted(make(batches), schema)


def _angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, angle)`` between a member and its component's mean direction."""
    for batch in batches:
        x, mean = _vectors(batch.column(1)), _vectors(batch.column(2))
        long = np.abs(mean).max(1) > 0
        cos = np.full(len(x), -1.0)
        cos[long] = (_unit(x[long]) * _unit(mean[long])).sum(1)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arccos(np.clip(cos, -1, 1)))], names=["id", "angle"])


def _outer(least: float):
    """Links between asking members and one block of the members of their component, for both sides. An asking member is compared as a
    member too; a link between two asking members is counted for either when it asks."""
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64())])

    def make(batches) -> Iterator[tuple]:
        for group in _groups(batches, 3):
            asking, held = group.filter(group["asks"]), group.filter(pc.invert(group["asks"]))
            if not len(asking) or not len(held):
                continue
            mine, theirs = asking["id"].to_numpy(), held["id"].to_numpy()
            near = (_products(_unit(_vectors(asking["v"])), _unit(_vectors(held["v"]))) >= least) & (mine[:, None] != theirs[None, :])
            yield from zip(mine.tolist(), (near @ held["n"].to_numpy()).tolist())
            core = ~held["outer"].to_numpy()
            yield from zip(theirs[core].tolist(), (asking["n"].to_numpy() @ near[:, core]).tolist())

    return lambda batches: emitted(make(batches), schema)


def usable(embedding: str):
    """Vectors that take part: no null or non-finite component, not all zero."""
    v = F.col(embedding)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def near_groups(
    vectors: DataFrame, least: float = 0.95, window: int = WINDOW, reach: float = 0.97, vec_id: str = "vec_id", embedding: str = "embedding", bits: int = BITS,
    seed: int = 29, chunk: int = CHUNK, block: int = BLOCK,
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of every id of ``vectors``.

    Two vectors link when their cosine in double precision is ``least`` (above 0) or more. A linked pair with that very cosine is found by the passes
    with probability ``reach``, a nearer one more surely; all links between members of a component are counted. ``component_id`` is the smallest id
    reachable over links, ``kept`` is true for that vector.

    Vectors that are null, zero or hold a null or non-finite component link with nothing; nor do vectors of different length. Equal vectors are
    compared as one and each counts as a link. Rows that repeat an id are one vector, the smallest usable one; rows without id are left out; other columns are
    ignored; an empty table gives an empty result."""
    good = usable(embedding)
    plain = F.transform(F.col(embedding), lambda x: x + F.lit(0).cast("float"))  # no negative zero; the components' type stays
    clean = vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("bigint").alias("id"), F.when(good, plain).alias("v"))
    every = cut(clean.groupBy("id").agg(F.min("v").alias("v")))
    copies = every.where("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    held = cut(copies.select("id", "n", "v"))

    # The order of each pass is found on keys alone; the vectors travel once a pass, to the chunk where they are compared.
    count = passes(held.count(), least, window, reach)
    keys = cut(held.select("id", "v").mapInArrow(_keyed(count, bits, seed), "pass int, size int, key binary, id bigint"))
    placed = with_halo(number_rows(keys, ["size", "key", "id"], by=["pass"]), "pos", 0, size=chunk, after=window)
    dealt = placed.select("pass", "size", F.col("_chunk").alias("chunk"), "pos", "id").join(held.select("id", "v"), "id").select("pass", "size", "chunk", "pos", "id", "v")
    dealt = dealt.repartition("pass", "chunk").sortWithinPartitions("pass", "size", "chunk", "pos")
    edges = dealt.mapInArrow(_compared(window, least), "a bigint, b bigint")
    group = cut(components(cut(edges.distinct())).select(F.col("node").alias("id"), "component"))

    sizes = group.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    member = cut(group.join(sizes, "component").join(held, "id"))
    small = member.where(F.col("members") <= block).select("component", "id", "n", "v")
    links = small.repartition("component").sortWithinPartitions("component", "id").mapInArrow(_counted(least), "id bigint, links bigint")
    large = member.where(F.col("members") > block)
    if not large.isEmpty():
        links = links.union(_large(large, least, block))
    links = links.groupBy("id").agg(F.sum("links").alias("links"))

    found = held.join(group, "id", "left").join(links, "id", "left")
    known = cut(found.select("id", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "id").alias("component"), "v"))
    # Copies take over what the vector that stands for them got; the table of vectors with copies is joined by the vector itself.
    many = share(known.where("n > 1").select("v", F.col("links").alias("links_v"), F.col("component").alias("component_v")), 20_000)
    out = every.join(known.select("id", "links", "component"), "id", "left").join(many, "v", "left")
    component = F.coalesce("component_v", "component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("links_v", "links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))


def _large(member: DataFrame, least: float, block: int) -> DataFrame:
    """Links of members of components of more than ``block`` vectors."""
    dims = "component bigint, v array<double>"
    parts = member.select("component", "v").mapInArrow(_mean_parts, dims)
    # A task sends few sums of a component on; they are added up component by component.
    each = parts.select("component", F.posexplode("v").alias("at", "x")).groupBy("component", "at").agg(F.sum("x").alias("x"))
    mean = each.groupBy("component").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("m")).select("component", F.col("m.x").alias("mean"))
    told = share(cut(mean), 20_000)
    angle = member.join(told, "component").select("id", F.col("v").cast("array<double>").alias("v"), "mean").mapInArrow(_angles, "id bigint, angle double")
    half = math.acos(least) / 2 - _SAFE
    rated = cut(member.join(angle, "id").withColumn("outer", F.col("angle") > half))
    core = rated.where("not outer").groupBy("component").agg(F.sum("n").alias("core"))
    inner = rated.where("not outer").join(share(core, 20_000), "component").select("id", (F.col("core") - F.col("n")).alias("links"))

    asks = rated.where("outer").groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    both = rated.withColumn("blocks", F.ceil(F.col("members") / block).cast("int")).join(share(asks, 20_000), "component")
    own_block, own_part = F.expr("pmod(xxhash64(id), blocks)").cast("int"), F.expr("pmod(xxhash64(id, 1), parts)").cast("int")

    def placed(df: DataFrame, at, part, asking: bool) -> DataFrame:
        return df.withColumn("block", at).withColumn("part", part).select("component", "block", "part", F.lit(asking).alias("asks"), "id", "n", "outer", "v")

    asking = placed(both.where("outer"), F.explode(F.expr("sequence(0, blocks - 1)")), own_part, True)
    asked = placed(both, own_block, F.explode(F.expr("sequence(0, parts - 1)")), False)
    met = asking.unionByName(asked).repartition("component", "block", "part").sortWithinPartitions("component", "block", "part", "id")
    return inner.union(met.mapInArrow(_outer(least), "id bigint, links bigint"))
