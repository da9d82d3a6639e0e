"""N-gram Jaccard join: every pair of texts whose shingle sets overlap enough ends up in one component.

Two steps, both exact up to collisions of 64-bit hashes:

1. Blocks. A linked pair of sets differs in at most ``H`` shingles, so if the shingles are dealt by hash into ``H + 1``
   parts, some part is equal in both. Each set emits one signature per part; sets that share a signature fall into one
   block (a connected component of the table of signatures). A signature covers several shingles, so that texts that only
   share a common passage seldom meet. The map side keeps one document per signature and task and turns the others into
   edges, so a group of copies of any size reaches the shuffle as one row per task. A part made of very common shingles
   alone (or of none) would join texts that share a common line, so a few parts more than needed are dealt and each
   set leaves out that many such parts; a linked pair still has an equal part that both emit.
2. T-occurrence search inside a block. Distinct sets are held in an inverted index. For a query set of ``n`` shingles the
   ``L`` longest lists are set aside, with L by the cost of either side, the short ones are merged by a heap, candidates need ``T - L`` occurrences there, and
   the long lists are probed by binary search (DivideSkip). Found documents leave the index and become queries themselves,
   so a near-copy group of any size costs about one full query. A large block is dealt into overlapping classes of size first:
   sets whose sizes are too far apart cannot link. A class over ``task_docs`` sets or ``task_shingles`` shingles is split into chunks that
   share a pivot; sets not joined to the pivot are searched in every other chunk as well.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqalert.llm.components import components
from seqalert.llm.text import emitted, mix, rows, shingles
from seqalert.operators.ordering import share
from seqalert.session import cut

#: Signatures that a task holds before it combines them.
HELD = 2_000_000
#: Most postings that are merged by a heap in Python.
HEAP = 2_000
#: Cost of merging a posting, in steps of a vectorised binary search.
MERGE = 0.5
#: Shingles found so often among HELD ones are common; the most frequent COMMON of them are told to all tasks. Any such set
#: gives the same result, as it only decides which parts are left out.
OFTEN, COMMON = 4, 500_000
#: Most sets, and most shingles of them, that one task searches at once. A block over a part of either (one in CLASSED) is dealt into
#: classes of size, each reaching to CLASS times its least size.
TASK_DOCS, TASK_SHINGLES = 20_000, 4_000_000
CLASSED, CLASS = 20, 1.3
#: Most bytes of ids that the driver sends to all tasks, as plain arrays: a hashed table of the rows takes six times as much, and more while it grows.
SENT = 24 << 20


def least_overlap(n: int, m: int, percent: int) -> int:
    """Smallest intersection with 100 * intersection >= percent * union for sets of ``n`` and ``m``."""
    return -(-percent * (n + m) // (100 + percent))


def size_ranges(percent: int, upto: int) -> list[tuple[int, int]]:
    """Overlapping size ranges such that both sizes of any linked pair lie in one of them."""
    out, low = [], 1
    while low <= upto:
        high = max(low * 3 // 2, -(-100 * low // percent))
        out.append((low, high))
        low = high * percent // 100 + 1  # larger sizes linked with smaller ones than this lie in this range
    return out


def signatures(found: np.ndarray, percent: int, ranges: list[tuple[int, int]], starts: list[int], common: np.ndarray) -> np.ndarray:
    """Part signatures of a sorted set of shingles, for every size range that holds its size.

    With ``spare`` parts more than needed, a linked pair has at least ``spare + 1`` equal parts. Parts without a shingle that
    is not ``common`` (sorted) are weak; whether a part is weak follows from its content, so a set of at most ``spare`` weak
    parts can leave them out: one of the equal parts is not weak, and both sets emit it."""
    n, out = len(found), []
    at = bisect_right(starts, n) - 1
    place = np.minimum(np.searchsorted(common, found), max(0, len(common) - 1))
    rare = common[place] != found if len(common) else np.ones(n, bool)
    while at >= 0 and ranges[at][1] >= n:
        differ = (100 - percent) * 2 * ranges[at][1] // (100 + percent)
        spare = 1 + differ * 12 // 100
        k = differ + 1 + spare
        part = ((found >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)  # rises with the shingle
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        seed = np.uint64(at * 0x10001 + 7)
        sig = mix(np.add.reduceat(mix(found), first) + mix(part[first] + seed))
        strong = np.logical_or.reduceat(rare, first)
        if k - strong.sum() <= spare:
            out.append(sig[strong])
        else:
            empty = np.setdiff1d(np.arange(k, dtype=np.uint64), part[first])
            out += [sig, mix(mix(empty + seed))]
        at -= 1
    return np.concatenate(out)


def _base(k: int, held: int):
    """Per row its set's size and key; besides, rows of shingles that many of a task's sets hold (without a size)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("shingle", pa.int64()), ("n", pa.int64())])

    def often(sets):
        value, n = np.unique(np.concatenate(sets), return_counts=True)
        often = n >= OFTEN
        yield from ((None, None, None, v, c) for v, c in zip(value[often].view(np.int64).tolist(), n[often].tolist()))

    def make(batches):
        sets, total = [], 0
        for doc, text in rows(batches):
            found = shingles(text, k)
            yield doc, len(found), hashlib.blake2b(found.tobytes(), digest_size=16).digest(), None, None
            sets.append(found)
            total += len(found)
            if total >= held:
                yield from often(sets)
                sets, total = [], 0
        if sets:
            yield from often(sets)

    return lambda batches: emitted(make(batches), schema)


def _signed(k: int, percent: int, held: int, told):
    """(signature, a, b): ``a = b`` is a document with this signature, ``a <> b`` an edge found inside the task."""
    names = ["sig", "a", "b"]

    def flush(sigs: list[np.ndarray], docs: list[int]) -> pa.RecordBatch:
        doc = np.repeat(np.array(docs, np.int64), [len(s) for s in sigs])
        sig = np.concatenate(sigs)
        order = np.argsort(sig, kind="stable")
        sig, doc = sig[order], doc[order]
        first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        least = np.minimum.reduceat(doc, first)
        size = np.diff(np.append(first, len(sig)))
        every = np.repeat(least, size)
        other = doc != every
        edges = np.unique(np.stack([doc[other], every[other]]), axis=1)
        a, b = np.concatenate([least, edges[0]]), np.concatenate([least, edges[1]])
        sig = np.concatenate([sig[first], mix(edges[0].view(np.uint64))]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(a), pa.array(b)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, docs, total = [], [], 0
        ranges = size_ranges(percent, 1 << 12)
        common = told.value
        for doc, text in rows(batches):
            found = shingles(text, k)
            if doc is None or not len(found):
                continue
            if len(found) > ranges[-1][1] * percent // 100:
                ranges = size_ranges(percent, 2 * len(found))
            sigs.append(signatures(found, percent, ranges, [r[0] for r in ranges], common))
            docs.append(doc)
            total += len(sigs[-1])
            if total >= held:
                yield flush(sigs, docs)
                sigs, docs, total = [], [], 0
        if sigs:
            yield flush(sigs, docs)

    return run


def merged(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct entries of sorted lists, and in how many lists each stands.

    Up to HEAP postings go through a heap of the lists' heads. More are merged run by run by numpy's stable sort, which
    merges presorted runs: the same merge, without a Python step per posting."""
    if sum(map(len, lists)) <= HEAP:
        seen = [(entry, sum(1 for _ in same)) for entry, same in groupby(heapq.merge(*(one.tolist() for one in lists)))]
        cand, hits = np.array(seen, np.int64).reshape(-1, 2).T
        return cand, hits
    every = np.sort(np.concatenate(lists), kind="stable")
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    return every[first], np.diff(np.append(first, len(every)))


class Index:
    """Inverted lists over sets, searched by the T-occurrence method."""

    def __init__(self, sets: list[np.ndarray], live: np.ndarray):
        self.live = live
        self.sizes = np.array([len(s) for s in sets])
        which = np.flatnonzero(live)
        token = np.concatenate([sets[i] for i in which])
        owner = np.repeat(which, self.sizes[which])
        order = np.argsort(token, kind="stable")  # owners stay in order inside a list
        token, self.owner = token[order], owner[order]
        self.token, self.first = np.unique(token, return_index=True)
        self.end = np.append(self.first[1:], len(token))
        self.count = len(which)

    def search(self, query: np.ndarray, percent: int) -> list[int]:
        """Live sets linked with ``query``."""
        n = len(query)
        at = np.minimum(np.searchsorted(self.token, query), len(self.token) - 1)
        at = at[self.token[at] == query]
        need = -(-percent * n // 100)  # the least overlap with any set of a fitting size
        if len(at) < need:
            return []
        size = self.end[at] - self.first[at]
        order = np.argsort(size, kind="stable")
        at, size = at[order], size[order]
        lists = [self.owner[self.first[i] : self.end[i]] for i in at]
        # Probing costs a step per candidate and long list, merging MERGE steps a posting, and a candidate takes at least
        # ``need - L`` postings of the short lists. The cheapest L that leaves need - L >= 1 is taken.
        every = np.arange(need)
        postings = np.cumsum(size)[len(at) - 1 - every]
        long = int(np.argmin(MERGE * postings + every * np.minimum(self.count, postings // (need - every))))
        short, probe = lists[: len(lists) - long], lists[len(lists) - long :]
        cand, hits = merged(short)
        keep = (hits >= need - long) & self.live[cand]
        cand, hits = cand[keep], hits[keep]
        for left, one in enumerate(probe):
            keep = hits + (len(probe) - left) >= need
            cand, hits = cand[keep], hits[keep]
            if not len(cand):
                return []
            pos = np.searchsorted(one, cand)
            hits = hits + (one[np.minimum(pos, len(one) - 1)] == cand)
        return cand[100 * hits >= percent * (n + self.sizes[cand] - hits)].tolist()


def block_edges(ids: list, sets: list[np.ndarray], percent: int) -> Iterator[tuple]:
    """(id, smallest id of its component) of every set that is linked, directly or through others, with an earlier one."""
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    live = np.ones(len(ids), bool)
    index = None
    for start in order:
        if not live[start]:
            continue
        live[start] = False
        queue = [start]
        while queue and live.any():
            if index is None or 2 * live.sum() < index.count:
                index = Index(sets, live)
            for found in index.search(sets[queue.pop()], percent):
                live[found] = False
                queue.append(found)
                yield ids[found], ids[start]


_EDGE = pa.schema([("block", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _search(k: int, percent: int):
    """Edges inside one chunk of a block; a document without a link is an edge to itself."""

    def make(batches):
        for (block, _), group in groupby(rows(batches), key=lambda r: r[:2]):
            ids, sets = [], []  # a text is let go as soon as it has become a set
            for _, _, doc, text in group:
                found = shingles(text, k)
                if len(found):
                    ids.append(doc)
                    sets.append(found)
                    yield block, doc, doc
            for a, b in block_edges(ids, sets, percent):
                yield block, a, b

    return lambda batches: emitted(make(batches), _EDGE)


def _search_others(k: int, percent: int):
    """Edges between asking documents and the documents of one chunk, which come before them."""

    def make(batches):
        for (block, _, _), group in groupby(rows(batches), key=lambda r: r[:3]):
            ids, sets, index = [], [], None
            for _, _, _, asks, doc, text in group:
                found = shingles(text, k)
                if not len(found):
                    continue
                if not asks:
                    ids.append(doc)
                    sets.append(found)
                elif sets:
                    index = index or Index(sets, np.ones(len(sets), bool))
                    for other in index.search(found, percent):
                        yield block, doc, ids[other]

    return lambda batches: emitted(make(batches), _EDGE)


def _dealt(df: DataFrame, keys: list[str], *then: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *then, "doc_id")


def _sent(table: DataFrame) -> Broadcast | None:
    """The columns of the stored ``table`` (all long) as arrays in the order of the first, or None if they take more than ``SENT`` bytes."""
    rows = SENT // (8 * len(table.columns))
    if table.limit(rows + 1).count() > rows:
        return None
    told = table.toArrow()
    cols = [told[c].to_numpy() for c in table.columns]
    order = np.argsort(cols[0], kind="stable")
    return table.sparkSession.sparkContext.broadcast([c[order] for c in cols])


def _with_blocks(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``docs`` with a row for each ``block`` that the stored table ``pairs`` (``doc_id``, ``block``) has for them. Texts stay where they lie while
    the pairs fit ``SENT``; beyond, both are shuffled."""
    told = _sent(pairs.select("doc_id", "block"))
    if told is None:
        return docs.join(pairs.select("doc_id", "block"), "doc_id")

    @F.arrow_udf("array<bigint>")
    def blocks(col: pa.Array) -> pa.Array:
        ids, block = told.value
        doc = col.fill_null(0).to_numpy(zero_copy_only=False)
        first = np.searchsorted(ids, doc)
        held = (np.searchsorted(ids, doc, "right") - first) * col.is_valid().to_numpy(zero_copy_only=False)
        ends = np.append(0, held.cumsum())
        at = np.repeat(first - ends[:-1], held) + np.arange(ends[-1])
        return pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(block[at], pa.int64()))

    return docs.withColumn("block", F.explode(blocks("doc_id")))


def _among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is in the stored table ``ids``, found as in ``_with_blocks``."""
    told = _sent(ids)
    if told is None:
        return docs.join(ids, "doc_id", "left_semi").select(docs.columns)

    @F.arrow_udf("boolean")
    def among(col: pa.Array) -> pa.Array:
        (held,) = told.value
        doc = col.fill_null(0).to_numpy(zero_copy_only=False)
        at = np.searchsorted(held, doc)
        found = held[np.minimum(at, len(held) - 1)] == doc if len(held) else np.zeros(len(doc), bool)
        return pa.array(found & col.is_valid().to_numpy(zero_copy_only=False))

    return docs.where(among(F.col("doc_id").cast("bigint")))


def near_groups(
    docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", task_docs: int = TASK_DOCS, held: int = HELD,
    task_shingles: int = TASK_SHINGLES,
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` of every row of ``docs``.

    Shingles are ``k`` consecutive words with A-Z in lower case; a text of fewer words is one shingle. Two documents link
    when 100 * intersection >= percent * union; ``component_id`` is the smallest ``doc_id`` reachable over links. A null or
    blank text is an empty set, linked with nothing. Rows with the same ``doc_id`` are one document with several texts and
    share a component. A row without ``doc_id`` takes no part: its ``component_id`` is null. Other columns are ignored; an
    empty table gives an empty result."""
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    both = cut(docs.mapInArrow(_base(k, held), "doc_id bigint, n_shingles bigint, key binary, shingle bigint, n bigint"))
    base = both.where("n_shingles is not null").select("doc_id", "n_shingles", "key")
    seen = both.where("n_shingles is null").groupBy("shingle").agg(F.sum("n").alias("n"))
    common = seen.orderBy(F.desc("n"), "shingle").limit(COMMON).select("shingle").toArrow()["shingle"].to_numpy()
    told = docs.sparkSession.sparkContext.broadcast(np.sort(common.view(np.uint64)))

    signed = docs.mapInArrow(_signed(k, percent, held, told), "sig bigint, a bigint, b bigint")
    least = signed.selectExpr("sig", "a", "b", "min(b) over (partition by sig) as least")
    near = least.where("b <> least or a <> b").select("a", F.when(F.col("a") == F.col("b"), F.col("least")).otherwise(F.col("b")).alias("b"))
    block = cut(components(near.distinct()).select(F.col("node").alias("doc_id"), F.col("component").alias("block")))

    # One set per distinct key of a block; blocks of one key need no search.
    member = cut(base.where("n_shingles > 0").join(block, "doc_id").select("doc_id", "block", "key", "n_shingles"))
    rep = member.groupBy("block", "key").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"))
    load = [F.count(F.lit(1)).alias("sets"), F.sum("n").alias("load")]
    many = rep.groupBy("block").agg(*load).where("sets > 1")
    large = (F.col("sets") * CLASSED > task_docs) | (F.col("load") * CLASSED > task_shingles)
    # A set stands in the classes of its own size and of all smaller sizes that it can be linked with.
    size_class = lambda n: F.floor(F.log(n) / float(np.log(CLASS)))
    least_size = F.greatest(F.lit(1.0), F.col("n") * (percent / 100 * (1 - 1e-9)))
    classes = F.when(large, F.sequence(size_class(least_size), size_class(F.col("n").cast("double"))))
    dealt = rep.join(many, "block").select(F.col("rep").alias("doc_id"), "block", "n", F.explode_outer(classes).alias("class"))
    # Two classes that meet under one hash are searched together.
    dealt = cut(dealt.select("doc_id", "n", F.when(F.col("class").isNull(), F.col("block")).otherwise(F.xxhash64("block", "class")).alias("block")))
    sized = dealt.groupBy("block").agg(*load, F.min("doc_id").alias("pivot")).where("sets > 1")
    chunks = F.ceil(F.greatest(F.col("sets") / task_docs, F.col("load") / task_shingles)).cast("int")
    sized = sized.select("block", "pivot", chunks.alias("chunks"), F.ceil(F.col("sets") / chunks).alias("asked"))
    chosen = cut(dealt.select("doc_id", "block").distinct().join(sized, "block"))
    chunk = F.expr("pmod(xxhash64(doc_id), chunks)").cast("int")
    alone = _with_blocks(docs, chosen.where("chunks = 1")).select("block", F.lit(0).alias("chunk"), "doc_id", "text")
    found = _dealt(alone, ["block", "chunk"]).mapInArrow(_search(k, percent), "block bigint, a bigint, b bigint")
    found = found.select("a", "b")
    split = chosen.where("chunks > 1")
    if not split.isEmpty():
        # One row per block that is too large for a task.
        shape = share(cut(split.select("block", "pivot", "chunks", "asked").distinct()))
        large = cut(_with_blocks(docs, split).join(shape, "block").withColumn("chunk", chunk))
        pivots = large.where("doc_id = pivot").withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)")))
        local = large.where("doc_id <> pivot").unionByName(pivots).select("block", "chunk", "doc_id", "text")
        inner = cut(_dealt(local, ["block", "chunk"]).mapInArrow(_search(k, percent), "block bigint, a bigint, b bigint"))
        # The pivot is its block's smallest document, so whoever is joined to it has it as its smallest.
        joined = inner.join(large.select("block", "pivot").distinct(), "block").where("b = pivot").select("block", F.col("a").alias("doc_id")).distinct()
        asks = cut(large.join(joined, ["block", "doc_id"], "left_anti"))
        parts = asks.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.min("asked")).cast("int").alias("parts"))
        asking = asks.join(parts, "block").withColumn("part", F.expr("pmod(xxhash64(doc_id, 1), parts)").cast("int"))
        asking = asking.withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)"))).select("block", "chunk", "part", F.lit(True).alias("asks"), "doc_id", "text")
        asked = large.join(parts, "block").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
        asked = asked.select("block", "chunk", "part", F.lit(False).alias("asks"), "doc_id", "text")
        both = _dealt(asking.unionByName(asked), ["block", "chunk", "part"], "asks")
        cross = both.mapInArrow(_search_others(k, percent), "block bigint, a bigint, b bigint")
        found = found.union(inner.select("a", "b")).union(cross.select("a", "b"))
    copies = member.join(rep, ["block", "key"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    linked = components(cut(found.where("a <> b").union(copies).distinct()))
    out = base.join(linked.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents of ``docs`` (``doc_id``, ``text``, ...) with one left of each near-copy group: the one with the smallest
    ``doc_id``, then the smallest SHA-256 of its text. Rows that share a ``doc_id`` are documents of their own where their texts
    differ, and stay unless they link. Rows equal in ``doc_id`` and text (null and empty are equal) are one document; the one
    with the smallest SHA-256 of the whole row stays, however the rows are dealt. Rows without ``doc_id`` stay. An empty table
    gives an empty one; other columns are kept, whatever their names."""
    known = docs.where("doc_id is not null")
    nameless = docs.where("doc_id is null")
    if known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        stays = near_groups(known, k, percent).where("doc_id = component_id").select("doc_id")
        return _among(known, cut(stays)).union(nameless)
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    texts = known.select("doc_id", "text", digest.alias("digest"))
    numbers = cut(texts.select("doc_id", "digest").distinct().withColumn("number", F.monotonically_increasing_id()))
    groups = near_groups(texts.join(numbers, ["doc_id", "digest"]).select("number", "text"), k, percent, doc_id="number")
    named = groups.distinct().join(numbers, groups["doc_id"] == numbers["number"]).select("component_id", F.struct(numbers["doc_id"], "digest").alias("_least"))
    # A row with its digest takes about 256 bytes of a hashed table.
    stays = share(cut(named.groupBy("component_id").agg(F.min("_least").alias("_least")).select("_least.*")), SENT // 256)
    kept = known.join(stays, (known["doc_id"] == stays["doc_id"]) & (digest == stays["digest"]), "left_semi")
    order = F.sha2(F.to_json(F.struct(*docs.columns)).cast("binary"), 256)
    one = kept.groupBy(F.col("doc_id").alias("_of"), digest.alias("_text")).agg(F.min_by(F.struct(*docs.columns), order).alias("_row"))
    return one.select("_row.*").union(nameless)
