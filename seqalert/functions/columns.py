"""Column helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings of the two classes.
ATTACK_WORDS = ["1", "true", "malware", "malicious", "attack", "positive"]
BENIGN_WORDS = ["0", "false", "benign", "normal", "negative"]
# Alternate label columns, in order.
LABEL_COLUMNS = ["label", "y_true", "ground_truth", "is_malware", "target"]

# File-name rules of the 64-bit attack families, in order.
FAMILY_RULES = [
    ("use_after_free", "Use-After-Free"),
    ("out_of_bounds", "Out-of-Bounds"),
    ("memory_leak", "Memory-Leak"),
    ("uninit_value", "Uninitialized-Memory"),
    ("WARNING", "Kernel-Warning"),
    ("BUG", "Kernel-BUG"),
    ("null_ptr_deref", "Null-Pointer-Deref"),
    ("deadlock", "Deadlock"),
    ("double_free", "Double-Free"),
    ("overflow", "Overflow"),
]


def canonical_path(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def path_stem(path: Column) -> Column:
    """File name without its last extension."""
    name = F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def family_of_directory(name: Column) -> Column:
    """Directory name without its ``_N`` suffix."""
    return F.regexp_replace(name, "_[0-9]+$", "")


def with_label(df: DataFrame, y: int) -> DataFrame:
    return df.withColumn("y", F.lit(y))


def flag(df: DataFrame, tau: float | None = None, strict: bool = False, prob: str = "prob") -> DataFrame:
    """Add ``positive``: the policy's threshold, else the row's own ``tau``, else 0.5."""
    own = F.col("tau") if "tau" in df.columns else F.lit(None).cast("double")
    limit = F.coalesce(F.lit(tau).cast("double"), own, F.lit(0.5))
    return df.withColumn("positive", F.col(prob) > limit if strict else F.col(prob) >= limit)


def with_status(traces: DataFrame, w: int, stride: int = 1, length: str = "length") -> DataFrame:
    """Add the window count and ``status``."""
    n = F.when(F.col(length) >= w, F.expr(f"({length} - {w}) div {stride}") + 1).otherwise(0).cast("bigint")
    out = traces.withColumn("n_windows", n)
    return out.withColumn("status", F.when(F.col("n_windows") == 0, f"too_short_for_window_{w}").otherwise("ok"))


def utc_stamp() -> Column:
    """Time of the run in UTC, for reports; never part of a compared result."""
    return F.concat(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def safe_cast(col: Column, to: str, default: float | int | str | None = None) -> Column:
    return F.coalesce(col.try_cast(to), F.lit(default).cast(to))


def binary_label(df: DataFrame, cols: Sequence[str]) -> Column:
    """True, False or NULL from the first of ``cols`` (then the usual alternates) that is set."""
    have = [F.col(c).cast("string") for c in [*cols, *LABEL_COLUMNS] if c in df.columns]
    text = F.lower(F.trim(F.coalesce(*have)))
    return F.when(text.isin(ATTACK_WORDS), True).when(text.isin(BENIGN_WORDS), False)


def length_bucket(n: Column, minimum: int, short: int, medium: int) -> Column:
    return F.when(n < minimum, "too_short").when(n <= short, "short").when(n <= medium, "medium").otherwise("long")


def family_from_name(name: Column, rules: Sequence[tuple[str, str]] = FAMILY_RULES, default: str = "Other-Exploit") -> Column:
    """Family of the first rule ``(part of the name, family)`` that matches."""
    out = None
    for part, family in rules:
        hit = F.contains(name, F.lit(part))
        out = F.when(hit, family) if out is None else out.when(hit, family)
    return F.lit(default) if out is None else out.otherwise(default)


def oov_flag(df: DataFrame, limit: float = 0.10) -> DataFrame:
    return df.withColumn("high_oov", F.col("oov_rate") > limit)


def normalize_ids(df: DataFrame, max_df: DataFrame | None = None, win: str = "win") -> DataFrame:
    """Token ids divided by the largest id of ``max_df`` (of all rows by default; a largest id of 0 counts as 1)."""
    base = max_df if max_df is not None else df
    top = base.agg(F.max(F.array_max(win))).scalar()
    scale = F.when(top == 0, 1).otherwise(top)
    return df.withColumn("_top", scale).withColumn(win, F.transform(win, lambda v: v / F.col("_top"))).drop("_top")


def sanitize(df: DataFrame, score: str = "score") -> DataFrame:
    """Replace +Inf by the largest absolute finite score, -Inf by its negative, NaN by 0; 1e6 where nothing is finite."""
    inf = float("inf")
    finite = ~F.isnan(score) & (F.abs(score) != inf)
    top = F.coalesce(df.agg(F.max(F.when(finite, F.col(score)))).scalar(), F.lit(1e6))
    s = F.col(score)
    return df.withColumn(score, F.when(F.isnan(s), 0.0).when(s == inf, top).when(s == -inf, -top).otherwise(s))


def trace_key(split: Column, trace_id: Column) -> Column:
    return F.struct(split.alias("split"), trace_id.alias("trace_id"))


def safe_ratio(a: Column, b: Column) -> Column:
    """NULL over zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def eps_ratio(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return a / (b + eps)


def direction(tokens: Column) -> Column:
    """``number_to_name`` when all tokens are numbers, ``name_to_number`` when none is, else NULL (an error)."""
    number = lambda t: t.rlike("^[0-9]+$")
    return F.when(F.size(tokens) == 0, None).when(F.forall(tokens, number), "number_to_name").when(
        ~F.exists(tokens, number), "name_to_number"
    )


def count_map(tokens: Column) -> Column:
    """Counts of the distinct entries of a bounded array."""
    keys = F.array_sort(F.array_distinct(tokens))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.size(F.filter(tokens, lambda t: t == k))))
