"""Tables and files the jobs write."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqalert.functions.columns import utc_stamp, with_status
from seqalert.operators import windows as win

#: Windows per score record; a longer trace is written as several records.
RECORD_WINDOWS = 1 << 16


def write_windows(df: DataFrame, path: str) -> None:
    """Window payload, one folder per split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def score_records(scores: DataFrame, stats: DataFrame | None = None, traces: DataFrame | None = None, w: int = 20, stride: int = 2, tau: float | None = None, size: int = RECORD_WINDOWS) -> DataFrame:
    """Scored windows as records with array columns: one per trace, or one per ``size`` windows of a long trace, with
    ``first_window`` and the counters of ``stats``. Traces of ``traces`` (``trace_id``, ``length``) that are too short for a window get a
    record without scores whose status says so."""
    rows = scores.withColumn("_part", F.expr(f"w div {size}"))
    item = F.struct("w", "path_a", "path_b", "path_c", "prob")
    packed = rows.groupBy("trace_id", "_part").agg(F.sort_array(F.collect_list(item)).alias("_r"))
    out = packed.select(
        F.col("trace_id").alias("file"), (F.col("_part") * size).alias("first_window"), F.size("_r").cast("bigint").alias("n_windows"),
        F.lit(w).alias("window_size"), F.lit(stride).alias("stride"), F.lit(tau).cast("double").alias("phase5_tau"), F.lit("ok").alias("status"),
        F.col("_r.path_a").alias("path_a_scores"), F.col("_r.path_b").alias("path_b_scores"), F.col("_r.path_c").alias("path_c_scores"),
        F.col("_r.prob").alias("phase5_probs"), F.transform("_r.prob", lambda p: p >= F.lit(tau if tau is not None else 0.5)).alias("phase5_positive"),
    )
    if traces is not None:
        short = with_status(traces, w, stride).where(F.col("n_windows") == 0)
        none = {f.name: F.lit([]).cast(f.dataType) for f in out.schema if f.dataType.typeName() == "array"}
        one = {"file": F.col("trace_id"), "first_window": F.lit(0), "n_windows": F.lit(0), "window_size": F.lit(w), "stride": F.lit(stride), "phase5_tau": F.lit(tau), "status": F.col("status"), **none}
        out = out.unionByName(short.select(*[one[f.name].cast(f.dataType).alias(f.name) for f in out.schema]))
    return out if stats is None else out.join(stats.withColumnRenamed("trace_id", "file"), "file", "left")


def write_scores(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def write_episodes(episodes: DataFrame, path: str) -> None:
    """Episodes as JSON lines and one summary row."""
    episodes.write.mode("overwrite").json(f"{path}/episodes")
    attack = F.sum((F.col("intended_label") == "malware_targeted").cast("int"))
    summary = episodes.agg(F.lit(1).alias("schema_version"), F.count(F.lit(1)).alias("episodes"), attack.alias("attack_episodes"), (F.count(F.lit(1)) - attack).alias("benign_episodes"))
    summary.write.mode("overwrite").json(f"{path}/summary")


def write_converted(converted: DataFrame, reports: DataFrame, path: str, line: int = win.PACK) -> None:
    """Conversion output, one folder per ABI: token text in lines of at most ``line`` tokens, and a report row per file.
    Files without an ABI only have a report, under ``unresolved``."""
    rows = converted.withColumn("line", F.expr(f"pos div {line}"))
    text = rows.groupBy("abi", "direction", "trace_id", "line").agg(F.sort_array(F.collect_list(F.struct("pos", "converted"))).alias("_r"))
    text = text.select("abi", "direction", "trace_id", "line", F.array_join(F.col("_r.converted"), " ").alias("text"))
    text.write.mode("overwrite").partitionBy("abi").json(f"{path}/converted")
    named = reports.withColumn("folder", F.coalesce("abi", F.lit("unresolved")))
    named.write.mode("overwrite").partitionBy("folder").json(f"{path}/reports")


def report_lines(summary: DataFrame, families: DataFrame, failures: DataFrame) -> DataFrame:
    """Markdown lines ``(section, row, line)`` of an evaluation report."""

    def cells(df: DataFrame, section: int, order: list[str]) -> DataFrame:
        cell = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in df.columns]
        # Reports have one row, one row per family, or a few top rows.
        rows = df.withColumn("row", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) + 2)
        return rows.select(F.lit(section).alias("section"), "row", F.concat(F.lit("| "), F.concat_ws(" | ", *cell), F.lit(" |")).alias("line"))

    def head(df: DataFrame, section: int, title: str) -> DataFrame:
        top = [(section, 0, f"## {title}"), (section, 1, "| " + " | ".join(df.columns) + " |"), (section, 2, "|" + " --- |" * len(df.columns))]
        return df.sparkSession.createDataFrame(top, "section int, row int, line string")

    facts = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("string").alias("value")) for c in summary.columns])).alias("_f")
    facts = summary.select(facts).select("_f.*")
    out = None
    for i, (title, df, order) in enumerate((("Summary", facts, ["measure"]), ("Families", families, ["attack_family"]), ("Failures", failures, ["kind", "episode_id"]))):
        part = head(df, i, title).unionByName(cells(df, i, order))
        out = part if out is None else out.unionByName(part)
    return out


def write_report(summary: DataFrame, families: DataFrame, failures: DataFrame, path: str) -> None:
    """The report as JSON rows and as one Markdown file; both are report-sized. The JSON summary says when it was made."""
    for name, df in (("summary", summary.withColumn("generated_at", utc_stamp())), ("families", families), ("failures", failures)):
        df.coalesce(1).write.mode("overwrite").json(f"{path}/json/{name}")
    lines = report_lines(summary, families, failures).orderBy("section", "row").select("line")
    lines.coalesce(1).write.mode("overwrite").text(f"{path}/markdown")


def write_z(df: DataFrame, path: str) -> None:
    """Score matrix, one folder per fold."""
    df.write.mode("overwrite").partitionBy("fold").parquet(path)
