"""Shards of near equal size from indivisible groups, by best-fit-decreasing bin packing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqalert.operators.ordering import prefix_sum
from seqalert.session import cut

#: Packing items per shard: a shard's size is near the mean to about this fraction.
GRAINS = 400
#: Rows that one task numbers inside a shard.
SLOT_ROWS = 20_000


class Tree:
    """Ordered pairs (room, bin) in a treap; the pair's own hash is its priority, so its shape follows from its content."""

    def __init__(self):
        self.root = None

    def add(self, pair: tuple[int, int]) -> None:
        low, high = self._split(self.root, pair)
        self.root = self._join(self._join(low, [pair, hash((pair, 0x5BD1E995)), None, None]), high)

    def remove(self, pair: tuple[int, int]) -> None:
        low, rest = self._split(self.root, pair)
        _, high = self._split(rest, (pair[0], pair[1] + 1))
        self.root = self._join(low, high)

    def ceiling(self, pair: tuple[int, int]) -> tuple[int, int] | None:
        """Smallest pair at or above ``pair``."""
        node, best = self.root, None
        while node is not None:
            if node[0] >= pair:
                best, node = node[0], node[2]
            else:
                node = node[3]
        return best

    def _split(self, node, pair):
        """Nodes below ``pair``, and the others."""
        if node is None:
            return None, None
        if node[0] < pair:
            node[3], high = self._split(node[3], pair)
            return node, high
        low, node[2] = self._split(node[2], pair)
        return low, node

    def _join(self, low, high):
        if low is None or high is None:
            return low if high is None else high
        if low[1] > high[1]:
            low[3] = self._join(low[3], high)
            return low
        high[2] = self._join(low, high[2])
        return high


def best_fit(sizes: Sequence[int], capacity: int) -> list[int]:
    """Bin of each size, taken in the given order: the tightest open bin that has room, else a new one. A size over the
    capacity stands alone in a bin."""
    tree, out, opened = Tree(), [], 0
    for size in sizes:
        fit = tree.ceiling((size, 0))
        if fit is None:
            fit, opened = (capacity, opened), opened + 1
        else:
            tree.remove(fit)
        out.append(fit[1])
        if fit[0] > size:
            tree.add((fit[0] - size, fit[1]))
    return out


def near_equal(sizes: Sequence[int], shards: int) -> list[int]:
    """Shard of each size (sizes descend) with the largest shard as small as a search over capacities makes it.

    A size above the mean of what is left takes a shard alone. For the rest, best fit always fits with the mean plus the
    largest size as capacity, and the search halves the range between that and the mean."""
    lone, rest = 0, sum(sizes)
    while lone < min(len(sizes), shards - 1) and sizes[lone] * (shards - lone) > rest:
        rest -= sizes[lone]
        lone += 1
    left, bins = sizes[lone:], shards - lone
    low = -(-rest // bins)
    high = low + (left[0] if left else 0)
    best = best_fit(left, high)
    while high - low > max(1, high // 4000):
        middle = (low + high) // 2
        tried = best_fit(left, middle)
        if max(tried, default=0) < bins and (not left or left[0] <= middle):
            best, high = tried, middle
        else:
            low = middle
    return [*range(lone), *(lone + b for b in best)]


def packed(groups: DataFrame, shards: int | None = None, capacity: int | None = None, grains: int = GRAINS, task_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Shards of ``groups`` (``key``, ``bytes``, ``rows``; stored): (``key``, ``item``) and (``item``, ``shard``).

    With ``shards`` the sizes of that many shards become near equal; with ``capacity`` as few shards as best fit decreasing
    needs hold at most ``capacity`` each. Groups that hold more than one of ``grains`` parts of a mean shard's bytes or rows are
    items of their own. Smaller ones are put in descending order of size, and each run of about one grain is an item. So the
    number of items is at most three times shards times grains, whatever the number of rows, and one packing of them
    fits into the driver."""
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).head()
    parts = grains * (shards if shards else max(1, -(-total["bytes"] // capacity)))
    grain = max(1, total["bytes"] // parts)
    large = (F.col("bytes") > grain) | (F.col("rows") > total["rows"] // parts)
    small = prefix_sum(groups.where(~large).withColumn("less", -F.col("bytes")), ["less", "key"], {"upto": "bytes"}, task_rows=task_rows)
    small = small.select("key", "bytes", F.concat(F.lit("s"), F.floor((F.col("upto") - 1) / grain).cast("string")).alias("item"))
    items = cut(groups.where(large).select("key", "bytes", F.concat(F.lit("g"), F.hex("key")).alias("item")).unionByName(small))
    found = sorted((-r["bytes"], r["item"]) for r in items.groupBy("item").agg(F.sum("bytes").alias("bytes")).collect())
    sizes = [-b for b, _ in found]
    bins = near_equal(sizes, shards) if shards else best_fit(sizes, capacity)
    table = groups.sparkSession.createDataFrame([(i, b) for (_, i), b in zip(found, bins)], "item string, shard int")
    return items.select("key", "item"), table


def sharded(docs: DataFrame, shards: int = 24, text: str = "text", doc_id: str = "doc_id", task_rows: int | None = None) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` of every row of ``docs``.

    Rows with equal texts form a group and share a shard; null texts form one, apart from empty ones. ``size`` is the bytes of
    the text plus 8. Shards are near equal in bytes, as far as groups can't be divided: one that holds more than a mean
    shard has one of its own. ``slot`` numbers a shard's rows from 0. A null text has the checksum of no bytes. Rows that repeat
    an id are numbered like others; an empty table gives no rows; further columns are ignored."""
    binary = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = cut(docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(binary) + 8).cast("bigint").alias("size"), F.crc32(binary).alias("text_crc32"),
        F.when(F.col(text).isNull(), F.lit(b"")).otherwise(F.unhex(F.md5(binary))).alias("key"),
    ))
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")))
    item, table = packed(groups, shards=shards, task_rows=task_rows)
    placed = item.join(F.broadcast(table), "item").select("key", "shard")
    # A group of many copies is a skewed key here; adaptive execution splits its rows.
    rows = rows.join(placed, "key")
    parts = max(1, -(-groups.agg(F.coalesce(F.sum("rows"), F.lit(0))).head()[0] // SLOT_ROWS))
    rows = cut(rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(parts)).cast("int")))
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("shard", "part", before.alias("before"))
    inner = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    rows = rows.withColumn("inner", inner).join(counts, ["shard", "part"])
    slot = (F.col("inner") + F.col("before")).cast("bigint")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

