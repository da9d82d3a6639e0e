"""Mixing sources to target weights, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqalert.operators.ordering import share
from seqalert.session import cut

#: Columns that a mix adds.
ADDED = ["size", "source_size", "target", "rate", "copies"]


def word_count(text: str | Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def recipe(sized: DataFrame, source: str, size: str, weights: Sequence[float], share_of_all: float, most: float) -> DataFrame:
    """One row per source: ``source_size``, ``target``, ``rate`` = target / size.

    Sources in code point order, null last, take ``weights`` in turn and share ``share_of_all`` of all sizes by weight. A
    target stops at ``most`` times its source's size and the excess is shared again by weight. The level at which this
    ends follows from one running sum over the sources by size per weight: a source is full when the level reached with
    all sources before it full lies above its own. The table has one row per source, after a map-side sum."""
    per = cut(sized.groupBy(source).agg(F.sum(size).alias("source_size")))
    whole = Window.partitionBy(F.lit(0))
    place = F.row_number().over(whole.orderBy(F.col(source).asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("full", F.col("source_size") * float(most)).withColumn("ratio", F.col("full") / F.col("weight"))
    before = whole.orderBy(F.col("ratio"), F.col(source).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) * float(share_of_all) - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    of = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / of).withColumn("is_full", F.col("ratio") <= F.col("level"))
    level = F.max(F.when(~F.col("is_full"), F.col("level"))).over(whole)  # that of the first which is not full
    per = per.withColumn("target", F.when(F.col("is_full"), F.col("full")).otherwise(F.coalesce(F.col("weight") * level, F.lit(0.0))))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return per.select(F.col(source).alias("_source"), "source_size", "target", rate.alias("rate"))


def mixed(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share_of_all: float = 1.5, most: float = 2.0, seed: int = 17,
    doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """All rows of ``docs`` with ``size`` (words), ``source_size``, ``target``, ``rate`` and ``copies`` added.

    A row is taken ``floor(rate)`` times and once more with probability ``rate - floor(rate)``, decided by a seeded hash of
    its id and text, so a rerun on any partitioning takes the same copies. A null source is a source of its own; a null
    or blank text has size 0; rows that repeat an id and text share their draw; an empty table gives no rows. Columns that
    have one of the added names are replaced."""
    kept = [c for c in docs.columns if c not in ADDED]
    sized = docs.select(*kept, word_count(text).alias("size"))
    plan = share(cut(recipe(sized, source, "size", weights, share_of_all, most)))
    rows = sized.join(plan, sized[source].eqNullSafe(plan["_source"]))
    # 52 bits of a hash are exact as a double in [0, 1).
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 12) / float(1 << 52)
    copies = F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("bigint")
    rows = rows.withColumn("copies", F.least(copies, F.lit(int(-(-most // 1))))).drop("_source")
    return rows.select(*kept, *ADDED)


def taken(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``mixed`` takes it, with the columns of ``docs``."""
    own = {c: f"_own_{c}" for c in docs.columns if c in ADDED}
    rows = mixed(docs.withColumnsRenamed(own), **how).where("copies > 0")
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])
