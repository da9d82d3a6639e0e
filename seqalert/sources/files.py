"""Trace files, score records and configuration files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqalert import schemas
from seqalert.functions.columns import family_of_directory, path_stem
from seqalert.operators import abi as abis
from seqalert.operators import ordering
from seqalert.operators.alerts import Policy


def _lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Text lines in file order. A file is read in blocks, so ``block`` and ``line`` order the lines of a large file
    without one task reading it whole."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    return text.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value",
    )


def _positions(rows: DataFrame, *keep: str) -> DataFrame:
    out = ordering.number_rows(ordering.cut(rows), ["block", "line", "at"], by=["path"])
    folder = F.element_at(F.split("path", "/"), -2)
    return out.select(
        F.col("path").alias("trace_id"), path_stem(F.col("path")).alias("stem"), folder.alias("folder"), "pos", "token", *keep
    )


def _tokens(lines: DataFrame, found: Column) -> DataFrame:
    return lines.select("path", "block", "line", F.posexplode(found).alias("at", "token"))


def read_traces(spark: SparkSession, path: str, lenient: bool = False, glob: str = "*.txt") -> DataFrame:
    """Numeric trace files as ``(trace_id, stem, folder, pos, token)``. Words that are not numbers are dropped; with
    ``lenient`` every run of digits counts. Files without a number give no rows."""
    lines = _lines(spark, path, glob)
    if lenient:
        found = F.regexp_extract_all("value", F.lit("([0-9]+)"))
    else:
        found = F.filter(F.split("value", r"\s+"), lambda t: t.rlike("^[0-9]+$"))
    return _positions(_tokens(lines, found)).withColumn("token", F.col("token").try_cast("int"))


def dropped_tokens(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Words per file that ``read_traces`` drops."""
    words = _tokens(_lines(spark, path, glob), F.filter(F.split("value", r"\s+"), lambda t: t != ""))
    return words.groupBy(F.col("path").alias("trace_id")).agg(F.sum((~F.col("token").rlike("^[0-9]+$")).cast("int")).alias("dropped"))


def read_attack_traces(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """Traces below family directories ``<family>_<n>/``."""
    return read_traces(spark, path, lenient).withColumn("family", family_of_directory(F.col("folder")))


def read_named_logs(spark: SparkSession, path: str, abi_map: DataFrame, abi: str = "x86_64", first_unknown: int = 500, glob: str = "*.log") -> DataFrame:
    """Logs of ``|``-separated call names as number tokens; unknown names get ids from ``first_unknown`` on in name
    order. ``domain`` is the parent folder."""
    found = F.filter(F.transform(F.split("value", r"\|"), lambda t: F.trim(t)), lambda t: t != "")
    rows = _positions(_tokens(_lines(spark, path, glob), found)).withColumnRenamed("token", "name")
    nums = abis.primary_numbers(abi_map.where(F.col("abi") == abi)).select("name", F.col("number").alias("_num"))
    lost = ordering.cut(rows.join(nums, "name", "left_anti").select("name").distinct())
    ids = ordering.number_rows(lost, ["name"], name="_id")
    ids = ids.select("name", (F.col("_id") + first_unknown).cast("int").alias("_new"))
    out = rows.join(nums, "name", "left").join(ids, "name", "left")
    return out.select("trace_id", "stem", F.col("folder").alias("domain"), "pos", "name", F.coalesce("_num", "_new").cast("int").alias("token"))


def read_mixed_traces(spark: SparkSession, path: str, abi_map: DataFrame, abi: str, max_id: int, glob: str = "*") -> DataFrame:
    """Traces that are all numbers, or one number, name or ``name(args)`` per line. Names that the ABI does not know are left
    out of a trace and of its positions; ``unknown_names`` has them."""
    out = _mixed(spark, path, abi_map, abi, max_id, glob).where(F.col("token").isNotNull())
    numbered = ordering.number_rows(ordering.cut(out.withColumnRenamed("pos", "_at")), ["_at"], by=["trace_id"])
    return numbered.select("trace_id", "stem", "pos", "token", "name")


def unknown_names(spark: SparkSession, path: str, abi_map: DataFrame, abi: str, max_id: int, glob: str = "*") -> DataFrame:
    """Words of mixed traces that the ABI does not know, with their number per trace."""
    out = _mixed(spark, path, abi_map, abi, max_id, glob).where(F.col("token").isNull())
    return out.groupBy("trace_id", "name").agg(F.count(F.lit(1)).alias("n"))


def _mixed(spark: SparkSession, path: str, abi_map: DataFrame, abi: str, max_id: int, glob: str) -> DataFrame:
    lines = ordering.cut(_lines(spark, path, glob))
    plain = lines.groupBy("path").agg(F.every(F.col("value").rlike(r"^[\s0-9]*$")).alias("_plain"))
    lines = lines.join(plain, "path")
    word = F.trim(F.regexp_replace("value", r"\s+", " "))
    name = F.regexp_extract("value", r"^\s*([A-Za-z_][A-Za-z0-9_]*)", 1)
    single = F.when(word.rlike("^[0-9]+$"), F.array(word)).when(name != "", F.array(name)).otherwise(F.array().cast("array<string>"))
    found = F.when(F.col("_plain"), F.filter(F.split("value", r"\s+"), lambda t: t != "")).otherwise(single)
    rows = _positions(_tokens(lines, found)).withColumnRenamed("token", "word")
    one = abi_map.where(F.col("abi") == abi)
    valid = F.when(F.col("number") <= max_id, F.col("number"))
    ids = one.groupBy("name").agg(F.coalesce(F.min(valid), F.min("number")).alias("_num"))
    out = rows.join(ids, F.col("word") == F.col("name"), "left").drop("name")
    is_number = F.col("word").rlike("^[0-9]+$")
    token = F.when(is_number, F.col("word").try_cast("int")).otherwise(F.col("_num"))
    return out.select("trace_id", "stem", "pos", token.cast("int").alias("token"), F.when(~is_number, F.col("word")).alias("name"))


def read_text_tokens(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Names and numbers of free text, as the conversion job takes them."""
    found = F.regexp_extract_all("value", F.lit(r"([A-Za-z_][A-Za-z0-9_]*|[0-9]+)"))
    return _positions(_tokens(_lines(spark, path, glob), found))


def list_files(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("trace_id"), "path", path_stem(F.col("path")).alias("stem"), F.element_at(F.split("path", "/"), -2).alias("folder"), "length")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Per-trace score records, one JSON object per line; bad lines stay in ``_corrupt_record``."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).where(F.trim("value") != "")
    schema = schemas.SCORE_RECORD + ", _corrupt_record string"
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.select(parsed.alias("_r")).select("_r.*")


def score_windows(records: DataFrame) -> DataFrame:
    """Score records as one row per window."""
    z = F.arrays_zip("path_a_scores", "path_b_scores", "path_c_scores", "phase5_probs", "phase5_positive")
    rows = records.select("file", F.col("phase5_tau").alias("tau"), F.coalesce("first_window", F.lit(0)).alias("_first"), F.posexplode(z).alias("w", "_z"))
    return rows.select(
        F.col("file").alias("trace_id"), (F.col("_first") + F.col("w")).alias("w"), "tau", F.col("_z.path_a_scores").alias("path_a"),
        F.col("_z.path_b_scores").alias("path_b"), F.col("_z.path_c_scores").alias("path_c"), F.col("_z.phase5_probs").alias("prob"),
        F.col("_z.phase5_positive").alias("positive"),
    )


def read_manifest(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Manifest entries of one or more documents; a large manifest is kept as one document per line."""
    raw = spark.read.schema(schemas.MANIFEST).option("multiLine", str(multi_line).lower()).json(path)
    return raw.select(F.explode("entries").alias("_e")).select("_e.*")


def read_onset(spark: SparkSession, path: str) -> DataFrame:
    """Onset fractions ``(family, onset, end)`` of either layout; the default has no family."""
    pair = "struct<attack_onset_fraction double, attack_end_fraction double>"
    raw = spark.read.option("wholetext", "true").text(path)
    both = raw.select(F.from_json("value", f"default {pair}, families map<string, {pair}>").alias("j"), F.from_json("value", f"map<string, {pair}>").alias("m"))
    nested = F.col("j.families").isNotNull() | F.col("j.default").isNotNull()
    fams = both.select(F.explode(F.when(nested, F.col("j.families")).otherwise(F.col("m"))).alias("family", "c"))
    default = both.where(nested & F.col("j.default").isNotNull()).select(F.lit(None).cast("string").alias("family"), F.col("j.default").alias("c"))
    rows = fams.where(F.col("c").isNotNull()).unionByName(default)
    return rows.select("family", F.col("c.attack_onset_fraction").alias("onset"), F.col("c.attack_end_fraction").alias("end"))


def read_policy(spark: SparkSession, path: str) -> Policy:
    """Alert policy file; thresholds that are missing are no condition."""
    raw = json.loads(spark.read.option("wholetext", "true").text(path).head()[0])
    trigger, clear = raw.get("trigger", {}), raw.get("clear", {})
    number = lambda d, k: None if d.get(k) is None else float(d[k])
    run = trigger.get("rolling_consecutive_positive_gte")
    return Policy(
        warmup=int(raw.get("warmup_windows", 5)), rolling=int(raw.get("rolling_window", 20)), tau=number(raw, "phase5_tau"),
        trigger_mean=number(trigger, "rolling_mean_prob_gte"), trigger_rate=number(trigger, "rolling_positive_rate_gte"),
        trigger_consecutive=None if run is None else int(run), clear_mean=number(clear, "rolling_mean_prob_lte"),
        clear_rate=number(clear, "rolling_positive_rate_lte"), hold=max(1, int(raw.get("min_alert_hold_windows", 1))),
        name=str(raw.get("policy_name", "rolling_hysteresis_v1")),
    )


def abi_map(spark: SparkSession, path: str) -> DataFrame:
    """ABI map from mapping files ``{"abi", "name_to_numbers": {name: [numbers]}}`` in a folder; repeated numbers of a name
    are dropped, their order is kept."""
    raw = spark.read.option("wholetext", "true").text(path)
    one = raw.select(F.from_json("value", "abi string, name_to_numbers map<string, array<int>>").alias("j"))
    names = one.select(F.coalesce(abis.normalize_abi(F.col("j.abi")), F.col("j.abi")).alias("abi"), F.explode("j.name_to_numbers").alias("name", "_n"))
    rows = names.where(F.trim("name") != "").select("abi", F.trim("name").alias("name"), F.posexplode(F.array_distinct("_n")).alias("ord", "number"))
    return rows.select("abi", "name", "number", "ord", F.col("name").isin(abis.COMMON_NAMES).alias("common"), F.col("name").isin(abis.ANCHOR_NAMES).alias("anchor"))
