"""Functions and table functions for SQL users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from seqalert.operators import curves


@udtf(returnType=T.StructType([T.StructField("w", T.LongType()), T.StructField("win", T.ArrayType(T.IntegerType()))]))
class SlidingWindows:
    """``SELECT * FROM traces, LATERAL sliding_windows(seq, 20, 2)``.

    A chunk of a longer trace gives ``lead``, its first position in the trace, and ``own``, the number of positions whose windows
    are its own; what follows those is there to complete them. ``w`` counts over the whole trace."""

    def eval(self, seq: list, size: int, stride: int, lead: int = 0, own: int = 1 << 62):
        for start in range(-lead % stride, min(len(seq) - size + 1, own), stride):
            yield (lead + start) // stride, seq[start : start + size]


def curve_view(df: DataFrame, by: list[str], name: str, y: str = "y", score: str = "score") -> None:
    """Make the ranking-curve metrics of every group callable from SQL as the view ``name``. They come from the score table,
    so a group of any size is split over tasks."""
    curves.all_metrics(curves.score_table(df, score, y, by=by), by=by).createOrReplaceTempView(name)


def register(spark: SparkSession, abi_map: DataFrame | None = None) -> None:
    """Make the helpers callable from SQL: ``sliding_windows``, ``canonical_path`` and, with an ABI map, the view ``abi_map`` behind ``abi_number(abi, name)``."""
    spark.udtf.register("sliding_windows", SlidingWindows)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION canonical_path(p STRING) RETURNS STRING RETURN lower(replace(p, '\\\\', '/'))")
    if abi_map is not None:
        one = abi_map.groupBy("abi", "name").agg(F.min_by("number", "ord").alias("number"))
        one.createOrReplaceTempView("abi_numbers")
        spark.sql(
            "CREATE OR REPLACE TEMPORARY FUNCTION abi_number(a STRING, n STRING) RETURNS INT "
            "RETURN (SELECT max(number) FROM abi_numbers t WHERE t.abi = abi_number.a AND t.name = abi_number.n)"
        )
