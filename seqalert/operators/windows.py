"""Tokens, packed traces and sliding count windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqalert.operators import ordering

#: Window start positions covered by one packed array.
PACK = 4096


def tokens_from(
    df: DataFrame, trace: str | Column, order_cols: Sequence[str], token: str | Column, task_rows: int | None = None, sizes: tuple[int, int] | None = None
) -> DataFrame:
    """Any table as a token stream ``(trace_id, pos, token)``; ``order_cols`` are unique inside a trace. ``sizes`` as in ``ordering.prefix_sum``."""
    trace = F.col(trace) if isinstance(trace, str) else trace
    token = F.col(token) if isinstance(token, str) else token
    rows = df.select(
        trace.cast("string").alias("trace_id"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)], token.alias("token")
    )
    order = [f"_o{i}" for i in range(len(order_cols))]
    return ordering.number_rows(rows, order, by=["trace_id"], task_rows=task_rows, sizes=sizes).select("trace_id", "pos", "token")


def tokens_of(traces: DataFrame, seq: str = "seq") -> DataFrame:
    """Packed traces (one array each, as a file or a message delivers them) as token rows."""
    keep = [c for c in traces.columns if c != seq]
    return traces.select(*keep, F.posexplode(seq).alias("pos", "token")).withColumn("pos", F.col("pos").cast("bigint"))


def pack(tokens: DataFrame, key: Sequence[str] = ("trace_id",), size: int = PACK, ahead: int = 0) -> DataFrame:
    """Token rows as arrays of at most ``size + ahead`` tokens, one per chunk of ``size`` positions.

    The ``ahead`` tokens behind a chunk are repeated in it, so that every window starting inside is complete."""
    first = F.greatest(F.lit(0), F.expr(f"(pos - {ahead}) div {size}"))
    last = F.expr(f"pos div {size}")
    chunk = last if ahead == 0 else F.explode(F.sequence(first, last))
    rows = tokens.select(*key, chunk.alias("chunk"), "pos", "token")
    packed = rows.groupBy(*key, "chunk").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("_rows"))
    return packed.select(*key, "chunk", F.col("_rows.token").alias("seq"))


def sliding_windows(
    tokens: DataFrame, w: int = 20, stride: int = 2, key: Sequence[str] = ("trace_id",), size: int = PACK
) -> DataFrame:
    """Overlapping windows ``(key, w, win)``: ``(len - w) // stride + 1`` per trace, none when it is shorter."""
    size = max(1, size // stride) * stride
    return windows_of_packed(pack(tokens, key, size, ahead=w - 1), w, stride, size)


def windows_of_packed(packed: DataFrame, w: int = 20, stride: int = 2, size: int = PACK) -> DataFrame:
    """Windows of arrays of ``pack(..., size, ahead=w - 1)``, ``size`` a multiple of ``stride``, with all their other columns. To store the arrays
    takes a tenth of the room that their windows take."""
    key = [c for c in packed.columns if c not in ("chunk", "seq")]
    lead = F.col("chunk") * size
    starts = F.when(F.size("seq") >= w, F.sequence(F.lit(0), F.least(F.size("seq") - w, F.lit(size - 1)), F.lit(stride)))
    out = packed.select(*key, lead.alias("_lead"), "seq", F.explode(starts).alias("_at"))
    return out.select(
        *key,
        F.expr(f"(_lead + _at) div {stride}").cast("bigint").alias("w"),
        F.slice("seq", F.col("_at") + 1, w).alias("win"),
    )


def windows_of_arrays(traces: DataFrame, w: int = 20, stride: int = 2, seq: str = "seq") -> DataFrame:
    """Windows straight from packed traces, without a shuffle."""
    keep = [c for c in traces.columns if c != seq]
    starts = F.when(F.size(seq) >= w, F.sequence(F.lit(0), F.size(seq) - w, F.lit(stride)))
    out = traces.select(*keep, seq, F.explode(starts).alias("_at"))
    return out.select(
        *keep, F.expr(f"_at div {stride}").cast("bigint").alias("w"), F.slice(seq, F.col("_at") + 1, w).alias("win")
    )


def rolling_token_stats(
    tokens: DataFrame, sums: dict[str, str], w: int = 20, stride: int = 2, size: int = ordering.CHUNK
) -> DataFrame:
    """Sums of per-token columns over every window, without building the windows: ``sums`` maps a name to
    ``column`` (all tokens of the window) or ``column@k`` (tokens from offset ``k`` on)."""
    chunked = ordering.with_halo(tokens, "pos", w - 1, size)
    part = Window.partitionBy("trace_id", "_chunk").orderBy("pos")
    cols = []
    for name, spec in sums.items():
        col, _, skip = spec.partition("@")
        cols.append(F.sum(col).over(part.rowsBetween(-(w - 1 - int(skip or 0)), 0)).alias(name))
    out = chunked.select("trace_id", "pos", "_own", *cols)
    ends = F.col("_own") & (F.col("pos") >= w - 1) & ((F.col("pos") - (w - 1)) % stride == 0)
    return out.where(ends).select("trace_id", F.expr(f"(pos - {w - 1}) div {stride}").alias("w"), *sums)


def cap_windows(windows: DataFrame, n: int = 100_000, seed: int = 42) -> DataFrame:
    """At most ``n`` windows per trace: the ``n`` smallest seeded keys of a longer trace, all of the others."""
    sizes = windows.groupBy("trace_id").agg(F.count(F.lit(1)).alias("_n"))
    over = sizes.where(F.col("_n") > n).select("trace_id")
    kept = ordering.hash_rank(windows.join(over, "trace_id", "left_semi"), seed, ["trace_id", "w"], by=["trace_id"], at_most=n)
    kept = kept.drop("rank")
    return windows.join(over, "trace_id", "left_anti").unionByName(kept)


def _ngrams(col: str, n: int) -> Column:
    return F.expr(f"transform(sequence(1, size({col}) - {n} + 1), i -> slice({col}, i, {n}))")


def ngrams(windows: DataFrame, n: int) -> DataFrame:
    """One row per n-gram occurrence ``(trace_id, w, state, nxt)``; ``state`` holds the first n-1 tokens."""
    grams = windows.where(F.size("win") >= n).select("trace_id", "w", F.explode(_ngrams("win", n)).alias("_g"))
    return grams.select("trace_id", "w", F.slice("_g", 1, n - 1).alias("state"), F.element_at("_g", n).alias("nxt"))


def bigram_counts(windows: DataFrame) -> DataFrame:
    pairs = ngrams(windows, 2).select(F.element_at("state", 1).alias("a"), F.col("nxt").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def transitions(windows: DataFrame, order: int = 1) -> DataFrame:
    """Transition counts and probabilities ``(state, nxt, n, p)``."""
    counts = ngrams(windows, order + 1).groupBy("state", "nxt").agg(F.count(F.lit(1)).alias("n"))
    # At most one row per vocabulary entry follows a state.
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("state")))


def token_counts(tokens: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return tokens.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("n"))


def corpus_size(tokens: DataFrame) -> DataFrame:
    return tokens.agg(F.count_distinct("trace_id").alias("files"), F.count(F.lit(1)).alias("tokens"))


def census(windows: DataFrame) -> DataFrame:
    """Windows, traces and families per split. Distinct counts come from one row per trace."""
    per_trace = windows.groupBy("split", "family", "trace_id").agg(F.count(F.lit(1)).alias("n"))
    per_family = per_trace.groupBy("split", "family").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("t"))
    return per_family.groupBy("split").agg(
        F.sum("n").alias("windows"), F.sum("t").alias("traces"), F.count("family").alias("families")
    )


def attrition(traces: DataFrame, w: int = 20) -> DataFrame:
    """Traces too short for one window, per split and overall. ``traces`` has one row ``(split, length)`` each."""
    short = F.sum(F.when(F.col("length") < w, 1).otherwise(0))
    out = traces.rollup("split").agg(F.count(F.lit(1)).alias("traces"), short.alias("too_short"), F.grouping_id().alias("_g"))
    return out.select(
        F.when(F.col("_g") > 0, F.lit("ALL")).otherwise(F.col("split")).alias("split"),
        "traces",
        "too_short",
        (F.col("too_short") / F.col("traces")).alias("attrition"),
    )


def length_strata(windows: DataFrame, n: int) -> DataFrame:
    """Stratum 1..n of every trace: traces ordered by window count in ``n`` near-equal groups."""
    sizes = ordering.cut(windows.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_windows")))
    at = ordering.number_rows(sizes, ["n_windows", "trace_id"], name="_at")
    # The first (traces mod n) groups hold one more trace than the others.
    total = at.withColumn("_t", sizes.agg(F.count(F.lit(1))).scalar())
    q, r = F.expr(f"_t div {n}"), F.col("_t") % n
    head = r * (q + 1)
    stratum = F.when(F.col("_at") < head, F.floor(F.col("_at") / (q + 1))).otherwise(
        r + F.floor((F.col("_at") - head) / F.greatest(q, F.lit(1)))
    )
    return total.select("trace_id", "n_windows", (stratum + 1).cast("int").alias("stratum"))


def context_pairs(windows: DataFrame, c: int = 5) -> DataFrame:
    """Centre token and its ``c`` left plus ``c`` right neighbours, for every full context of a window."""
    rows = windows.select("trace_id", "w", "win", F.explode(F.expr(f"sequence({c}, size(win) - {c} - 1)")).alias("i"))
    return rows.select(
        "trace_id",
        "w",
        "i",
        F.concat(F.slice("win", F.col("i") - c + 1, c), F.slice("win", F.col("i") + 2, c)).alias("context"),
        F.element_at("win", F.col("i") + 1).alias("target"),
    )


def next_pairs(windows: DataFrame) -> DataFrame:
    """Input ``win[:-1]`` and target ``win[1:]`` of a next-token model."""
    n = F.size("win")
    return windows.select("trace_id", "w", F.slice("win", F.lit(1), n - 1).alias("input"), F.slice("win", F.lit(2), n - 1).alias("target"))


def top_tokens(counts: DataFrame, k: int) -> DataFrame:
    return counts.orderBy(F.desc("n"), F.asc("token")).limit(k)


def vocabulary(grams: DataFrame, m: int, gram: str = "gram", n: str = "n") -> DataFrame:
    """The ``m`` most frequent n-grams of counted ``grams`` (ties by n-gram) with a dense index."""
    top = grams.orderBy(F.desc(n), F.asc(gram)).limit(m)
    # m rows at most.
    return top.withColumn("idx", F.row_number().over(Window.orderBy(F.desc(n), F.asc(gram))) - 1)


def token_drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of each token in two corpora and where it is missing."""

    def shares(df: DataFrame, side: str) -> DataFrame:
        counts = token_counts(df)
        return counts.select("token", (F.col("n") / counts.agg(F.sum("n")).scalar()).alias(f"share_{side}"))

    both = shares(a, "a").join(shares(b, "b"), "token", "full_outer")
    where = F.when(F.col("share_b").isNull(), "only_a").when(F.col("share_a").isNull(), "only_b").otherwise("both")
    return both.select(
        "token", F.coalesce("share_a", F.lit(0.0)).alias("share_a"), F.coalesce("share_b", F.lit(0.0)).alias("share_b"), where.alias("seen")
    )


def leakage(splits: DataFrame) -> DataFrame:
    """Traces that appear in more than one split."""
    per = splits.groupBy("trace_id").agg((F.min("split") != F.max("split")).alias("shared"))
    return per.agg(F.sum(F.col("shared").cast("int")).cast("bigint").alias("shared"), F.count(F.lit(1)).alias("traces"))
