"""Ordered work that never puts a whole group into one task.

A group (a trace, a class, one score column) may hold a large share of all rows, so nothing here sorts a
group as one unit. Three shapes cover every ordered operator of the package:

* ``prefix_sum`` splits the order into ranges, sums inside each range and adds the totals of the ranges before it;
* ``hash_rank`` does the same for a seeded random order, where the ranges are known beforehand;
* ``with_halo`` cuts a densely numbered sequence into chunks that repeat the few rows a frame looks back on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqalert.session import cut

#: Rows one task may sort. Below it one plain window is cheaper than splitting.
TASK_ROWS = 2_000_000
#: Most ranges a prefix sum makes.
MAX_RANGES = 100_000
#: Windows per chunk for frames over a sequence.
CHUNK = 1 << 20
#: Most rows of a model table that is sent whole to every executor.
SHARED_ROWS = 1_000_000
#: First hex digits of an md5 key that form its range: 16 ** 5 ranges, so that even 1e12 rows leave a million per range.
HASH_DIGITS = 5


def share(df: DataFrame, rows: int = SHARED_ROWS) -> DataFrame:
    """Mark a stored table for broadcasting when it has at most ``rows`` rows; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def prefix_sum(
    df: DataFrame,
    order: Sequence[str],
    sums: dict[str, str],
    by: Sequence[str] = (),
    descending: bool = False,
    totals: dict[str, str] | None = None,
    task_rows: int | None = None,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Add running sums ``sums`` (new name -> column) in the order of ``order`` inside ``by``, and group sums ``totals`` (new
    name -> column). ``order`` is unique inside a group. ``df`` is a stored table or a checkpoint, because its groups are counted
    first, unless the caller has counted them (``sizes``: rows of the largest group, all rows): while the largest has at most ``task_rows`` rows (``TASK_ROWS`` by default) one plain window does, however many groups there
    are; above, the rows are cut into ranges of about that size. The rows are checkpointed with the number of their range before any sum is taken, so that it cannot
    change when an executor is lost."""
    totals, by, task_rows = totals or {}, list(by), task_rows or TASK_ROWS
    sort = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    largest, rows = sizes or df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n"), F.sum("_n")).head()
    parts = min(MAX_RANGES, -(-(rows or 0) // task_rows))
    if (largest or 0) <= task_rows:
        group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        upto = group.orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
        out = df.select("*", *[F.sum(c).over(upto).alias(n) for n, c in sums.items()])
        return out.select("*", *[F.sum(c).over(group).alias(n) for n, c in totals.items()])

    ranged = df.repartitionByRange(parts, *[F.col(b) for b in by], *sort)
    ranged = cut(ranged.withColumn("_range", F.spark_partition_id()))
    used = sorted({*sums.values(), *totals.values()})
    per_range = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_s_{c}") for c in used])
    # One row per range and group: at most MAX_RANGES rows per group.
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per_range = per_range.select(
        *by,
        "_range",
        *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_before_{n}") for n, c in sums.items()],
        *[F.sum(f"_s_{c}").over(group).alias(n) for n, c in totals.items()],
    )
    cond = F.col("l._range") == F.col("r._range")
    for b in by:
        cond = cond & F.col(f"l.{b}").eqNullSafe(F.col(f"r.{b}"))
    inner = Window.partitionBy(*by, "_range").orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *[F.sum(c).over(inner).alias(f"_in_{n}") for n, c in sums.items()])
    joined = local.alias("l").join(per_range.alias("r"), cond)
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns],
        *[(F.col(f"_in_{n}") + F.col(f"_before_{n}")).alias(n) for n in sums],
        *[F.col(f"r.{n}").alias(n) for n in totals],
    )


def rank_sums(df: DataFrame, col: str, sums: dict[str, str], task_rows: int | None = None) -> DataFrame:
    """Add to every row, per entry of ``sums`` (name -> column), the sum over rows with a smaller ``col`` (``below_<name>``), over rows with the same
    (``equal_<name>``) and over all rows with a value (``all_<name>``). Rows without a value keep NULLs.

    ``df`` is a stored table or a checkpoint. Its rows are sorted once, in ranges of about ``task_rows``; equal values are spread over as many
    ranges as they fill. The sums of a range and of the values at its two ends, one row a range, complete what a row sees of its own range, so
    nothing is joined on the value."""
    task_rows = task_rows or TASK_ROWS
    held, rest = df.where(F.col(col).isNotNull()), df.where(F.col(col).isNull())
    nulls = rest.select("*", *[F.lit(None).cast("bigint").alias(f"{kind}_{n}") for n in sums for kind in ("below", "equal", "all")])
    parts = min(MAX_RANGES, -(-df.count() // task_rows))

    def seen(rows: DataFrame, part: Window) -> DataFrame:
        order = part.orderBy(col)
        same = {n: F.sum(c).over(order.rangeBetween(Window.currentRow, Window.currentRow)) for n, c in sums.items()}
        upto = {n: F.sum(c).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)) for n, c in sums.items()}
        return rows.select("*", *[(upto[n] - same[n]).alias(f"below_{n}") for n in sums], *[same[n].alias(f"equal_{n}") for n in sums])

    if parts <= 1:
        whole = Window.partitionBy(F.lit(0))
        out = seen(held, whole).select("*", *[F.sum(c).over(whole).alias(f"all_{n}") for n, c in sums.items()])
        return out.unionByName(nulls)
    spread = F.xxhash64(*[F.col(c) for c in df.columns])
    ranged = cut(held.withColumn("_spread", spread).repartitionByRange(parts, col, "_spread").drop("_spread").withColumn("_range", F.spark_partition_id()))
    part = Window.partitionBy("_range")
    ends = ranged.select("_range", F.col(col).alias("_v"), *[F.col(c).alias(f"_c_{n}") for n, c in sums.items()], F.min(col).over(part).alias("_first"), F.max(col).over(part).alias("_last"))
    at = lambda end, n: F.sum(F.when(F.col("_v") == F.col(end), F.col(f"_c_{n}")).otherwise(0))
    totals = ends.groupBy("_range", "_first", "_last").agg(*[x for n in sums for x in (F.sum(f"_c_{n}").alias(f"_n_{n}"), at("_first", n).alias(f"_f_{n}"), at("_last", n).alias(f"_l_{n}"))])
    totals = cut(totals)
    # One row per range from here on, at most MAX_RANGES: sums of the ranges before, and of the end values in other ranges.
    both = totals.select("_range", F.col("_first").alias("_v"), *[F.col(f"_f_{n}").alias(f"_e_{n}") for n in sums])
    both = both.unionByName(totals.where("_first <> _last").select("_range", F.col("_last").alias("_v"), *[F.col(f"_l_{n}").alias(f"_e_{n}") for n in sums]))
    value = Window.partitionBy("_v").orderBy("_range")
    before, after = value.rowsBetween(Window.unboundedPreceding, -1), value.rowsBetween(1, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0))
    both = both.select("_range", "_v", *[x for n in sums for x in (zero(F.sum(f"_e_{n}").over(before)).alias(f"_b_{n}"), zero(F.sum(f"_e_{n}").over(after)).alias(f"_a_{n}"))])
    line = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    told = totals.select(
        F.col("_range").alias("_r"), "_first", "_last", *[x for n in sums for x in (zero(F.sum(f"_n_{n}").over(line)).alias(f"_s_{n}"), F.sum(f"_n_{n}").over(every).alias(f"all_{n}"))]
    )
    for end in ("first", "last"):
        one = both.select(F.col("_range").alias("_q"), F.col("_v").alias("_w"), *[F.col(f"_{x}_{n}").alias(f"_{x}_{end}_{n}") for n in sums for x in "ab"])
        told = told.join(one, (F.col("_r") == F.col("_q")) & (F.col(f"_{end}") == F.col("_w"))).drop("_q", "_w")
    told = cut(told)
    out = seen(ranged, part).join(share(told), F.col("_range") == F.col("_r"))
    first, last = F.col(col) == F.col("_first"), F.col(col) == F.col("_last")
    cols = []
    for n in sums:
        earlier, later = F.when(first, F.col(f"_b_first_{n}")).otherwise(0), F.when(last, F.col(f"_a_last_{n}")).otherwise(0)
        cols += [(F.col(f"below_{n}") + F.col(f"_s_{n}") - earlier).alias(f"below_{n}"), (F.col(f"equal_{n}") + earlier + later).alias(f"equal_{n}"), F.col(f"all_{n}")]
    return out.select(*df.columns, *cols).unionByName(nulls)


def number_rows(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (),
    name: str = "pos",
    task_rows: int | None = None,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Dense 0-based position of every row inside ``by``; ``order`` must be unique inside a group."""
    numbered = prefix_sum(df.withColumn("_one", F.lit(1)), order, {name: "_one"}, by=by, task_rows=task_rows, sizes=sizes)
    return numbered.withColumn(name, (F.col(name) - 1).cast("bigint")).drop("_one")


def hash_key(seed: int, *keys: str | Column) -> Column:
    """Seeded random order that does not depend on the partitioning."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts], F.lit(str(seed))))


def hash_rank(
    df: DataFrame, seed: int, keys: Sequence[str], by: Sequence[str] = (), name: str = "rank", total: str | None = None, at_most: int | Column | None = None
) -> DataFrame:
    """1-based rank of a row in the seeded order of its ``keys`` inside ``by`` (and the group's size).

    md5 values are uniform, so their first digits cut any group evenly and no pass over the data is needed to
    find the ranges. ``at_most`` keeps the first rows only, and then no row of a range behind them is sorted."""
    by = list(by)
    keyed = df.withColumn("_key", hash_key(seed, *keys)).withColumn("_range", F.substring("_key", 1, HASH_DIGITS))
    per_range = keyed.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # At most 16 ** HASH_DIGITS rows per group.
    per_range = per_range.select(
        *[F.col(b).alias(f"_b_{b}") for b in by],
        F.col("_range").alias("_b_range"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(group).alias("_total"),
    )
    cond = F.col("_range") == F.col("_b_range")
    for b in by:
        cond = cond & F.col(b).eqNullSafe(F.col(f"_b_{b}"))
    joined = keyed.join(per_range, cond)
    if at_most is not None:
        joined = joined.where(F.col("_before") < at_most)
    inner = Window.partitionBy(*by, "_range").orderBy("_key", *keys)
    out = joined.withColumn(name, (F.row_number().over(inner) + F.col("_before")).cast("bigint"))
    if at_most is not None:
        out = out.where(F.col(name) <= at_most)
    if total:
        out = out.withColumn(total, F.col("_total").cast("bigint"))
    return out.select(*df.columns, name, *([total] if total else []))


def quantiles(
    df: DataFrame, col: str, asked: dict[str, float], by: Sequence[str] = (), task_rows: int | None = None
) -> DataFrame:
    """Exact linearly interpolated quantiles, one row per group, one column per entry of ``asked``.

    Equal values are counted together first; the built-in exact percentile would hold every distinct value of
    a group in one task."""
    by = list(by)
    counts = cut(df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    run = prefix_sum(counts, ["_v"], {"_upto": "_n"}, by=by, totals={"_total": "_n"}, task_rows=task_rows)
    aggs = []
    for name, q in asked.items():
        at = F.lit(float(q)) * (F.col("_total") - 1)
        aggs.append(F.min(F.when(F.col("_upto") > F.floor(at), F.col("_v"))).alias(f"_lo_{name}"))
        aggs.append(F.min(F.when(F.col("_upto") > F.ceil(at), F.col("_v"))).alias(f"_hi_{name}"))
    aggs.append(F.max("_total").alias("_total"))
    out = run.groupBy(*by).agg(*aggs)
    cols = []
    for name, q in asked.items():
        at = F.lit(float(q)) * (F.col("_total") - 1)
        lo, hi = F.col(f"_lo_{name}").cast("double"), F.col(f"_hi_{name}").cast("double")
        cols.append((lo + (at - F.floor(at)) * (hi - lo)).alias(name))
    return out.select(*by, *cols)


def with_halo(df: DataFrame, index: str, before: int, size: int = CHUNK, after: int = 0) -> DataFrame:
    """Add ``_chunk`` and ``_own``: a row belongs to chunk ``index div size`` and is repeated in the chunks whose frames look
    back on it over ``before`` rows or ahead to it over ``after`` rows."""
    own = F.expr(f"{index} div {size}")
    if before == 0 and after == 0:
        return df.withColumn("_chunk", own).withColumn("_own", F.lit(True))
    first = F.expr(f"greatest(0, {index} - {after}) div {size}") if after else own
    last = F.expr(f"({index} + {before}) div {size}")
    return df.withColumn("_chunk", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_chunk") == own)


def carry_last(
    df: DataFrame, value: str, key: Sequence[str], index: str, name: str, size: int = CHUNK, previous: str | None = None
) -> DataFrame:
    """Last non-null ``value`` up to each row of a sequence, and up to the row before it as ``previous``: from the row's
    chunk, else from the chunks before. ``df`` is stored or checkpointed: its longest sequence is looked up first, and
    when one chunk holds it no chunks are needed."""
    key = list(key)
    longest = df.agg(F.max(index)).head()[0]
    spans = {name: 0} | ({previous: -1} if previous else {})
    upto = lambda part, end: F.last(value, ignorenulls=True).over(part.orderBy(index).rowsBetween(Window.unboundedPreceding, end))
    if longest is None or longest < size:
        whole = Window.partitionBy(*key)
        return df.select("*", *[upto(whole, end).alias(n) for n, end in spans.items()])
    chunked = df.withColumn("_chunk", F.expr(f"{index} div {size}"))
    part = Window.partitionBy(*key, "_chunk")
    local = chunked.select("*", *[upto(part, end).alias(f"_in_{n}") for n, end in spans.items()])
    at = F.when(F.col(value).isNotNull(), F.col(index))
    ends = chunked.groupBy(*key, "_chunk").agg(F.max_by(value, at).alias("_end"))
    # One row per chunk of a sequence.
    before = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*key, "_chunk", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    out = local.join(ends, [*key, "_chunk"])
    return out.select(*df.columns, *[F.coalesce(f"_in_{n}", "_carried").alias(n) for n in spans])
