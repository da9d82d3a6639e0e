"""Sources and sinks, run over files written from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqalert import schemas
from seqalert.contract.abi_queries import JOB, _job
from seqalert.contract.base import TAU, abi_map, episodes, ev_names, ev_tokens, ev_windows, meta, pool, query, scratch, table
from seqalert.contract.episode_queries import results
from seqalert.operators import abi, episodes as E, ordering, sampling
from seqalert.scorers import fusion
from seqalert.sources import files, sinks


def _write_traces(s, d, column="token", sep=" ", per_line=7, tail=""):
    """One folder per event trace, ``<split>/<family>_<trace>``, with ``per_line`` tokens per line."""
    path = scratch(s)
    rows = ev_tokens(s, d) if column == "token" else ev_names(s, d)
    rows = rows.withColumn("_line", F.expr(f"pos div {per_line}")).groupBy("trace_id", "_line").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("_r"))
    rows = rows.join(meta(s, d).select("trace_id", "split", "family"), "trace_id")
    text = F.concat(F.array_join(F.col("_r.token"), sep), F.lit(tail))
    folder = F.concat_ws("_", F.coalesce("family", F.lit("benign")), "trace_id")
    out = rows.repartition("trace_id").sortWithinPartitions("trace_id", "_line").select("split", folder.alias("run"), text.alias("value"))
    # Tasks move their own files into place; by default the driver moves all of them, one after the other.
    out.write.partitionBy("split", "run").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
    return path


def _run(col="folder"):
    return F.regexp_replace(F.col(col), "^run=", "")


@query("src_01_read_traces", "SELECT trace_id, pos, token FROM tok", "tok")
def _(s, d):
    t = files.read_traces(s, _write_traces(s, d, tail=" # end"), glob="*")
    return t.select(F.substring_index(_run(), "_", -1).alias("trace_id"), "pos", "token")


@query("src_01_dropped_tokens", "SELECT trace_id, ceil(count(*) / 7.0)::BIGINT * 2 AS dropped FROM tok GROUP BY trace_id", "tok")
def _(s, d):
    t = files.dropped_tokens(s, _write_traces(s, d, tail=" # end"), glob="*")
    return t.select(F.substring_index(F.element_at(F.split("trace_id", "/"), -2), "_", -1).alias("trace_id"), "dropped")


@query("src_02_read_attack_traces", "SELECT family, count(*) AS tokens, count(DISTINCT trace_id) AS traces, CAST(sum(pos * token) AS BIGINT) AS weighted FROM tok JOIN meta USING (trace_id) WHERE split = 'attack' GROUP BY family", "tok", "meta")
def _(s, d):
    t = files.read_attack_traces(s, _write_traces(s, d) + "/split=attack")
    per = t.withColumn("family", F.regexp_replace("family", "^run=", ""))
    return per.groupBy("family").agg(F.count(F.lit(1)).alias("tokens"), F.count_distinct("trace_id").alias("traces"), F.sum(F.col("pos") * F.col("token")).alias("weighted"))


@query("src_03_read_malformed_traces", "SELECT trace_id, pos, token FROM tok", "tok")
def _(s, d):
    t = files.read_traces(s, _write_traces(s, d, sep=";x,"), lenient=True, glob="*")
    return t.select(F.substring_index(_run(), "_", -1).alias("trace_id"), "pos", "token")


def _kinds(s, d):
    """A two-entry map made of the event names: those with a known number are the two most frequent."""
    counts = table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "event_type").limit(2)
    return top.select(F.lit("x86_64").alias("abi"), F.col("event_type").alias("name"), F.length("event_type").alias("number"), F.lit(0).alias("ord"), F.lit(True).alias("common"), F.lit(False).alias("anchor"))


KINDS = ", kn AS (SELECT event_type AS name, length(event_type) AS num FROM events GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 2), un AS (SELECT event_type AS name, 499 + row_number() OVER (ORDER BY event_type) AS num FROM (SELECT DISTINCT event_type FROM events WHERE event_type NOT IN (SELECT name FROM kn)))"


@query("src_04_read_named_logs", KINDS + "SELECT trace_id, pos, event_type AS name, CAST(num AS INTEGER) AS token FROM tok JOIN (SELECT * FROM kn UNION ALL SELECT * FROM un) n ON n.name = event_type", "tok")
def _(s, d):
    path = _write_traces(s, d, "name", " | ")
    t = files.read_named_logs(s, path, _kinds(s, d), glob="*")
    return t.select(F.substring_index(_run("domain"), "_", -1).alias("trace_id"), "pos", "name", "token")


@query("src_05_read_mixed_traces", KINDS + "SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY pos) - 1 AS pos, event_type AS name, CAST(num AS INTEGER) AS token FROM tok JOIN kn ON kn.name = event_type WHERE num IS NOT NULL", "tok")
def _(s, d):
    path = _write_traces(s, d, "name", per_line=1, tail="(0x1, NULL) = 3")
    t = files.read_mixed_traces(s, path, _kinds(s, d), "x86_64", 340)
    return t.select(F.substring_index(F.element_at(F.split("trace_id", "/"), -2), "_", -1).alias("trace_id"), "pos", "name", "token")


@query("src_07_read_scores", f"SELECT trace_id, w, path_a, path_b, path_c, prob, prob >= {TAU} AS positive FROM pool", "pool", rounds="path_a path_b path_c prob")
def _(s, d):
    path = scratch(s)
    sinks.write_scores(sinks.score_records(pool(s, d), tau=TAU, size=10), path)
    return files.score_windows(files.read_scores(s, path)).drop("tau")


@query("src_08_read_manifest", "SELECT trace_id AS sample_id, CASE WHEN y = 1 THEN 'malware_targeted' ELSE 'benign_control' END AS intended_label, family AS target_preset FROM meta", "meta")
def _(s, d):
    path = scratch(s)
    rows = meta(s, d).select(F.col("trace_id").alias("sample_id"), F.when(F.col("y") == 1, "malware_targeted").otherwise("benign_control").alias("intended_label"), F.col("family").alias("target_preset"), F.concat(F.lit("f/"), "trace_id").alias("source_file"))
    # A manifest of any size is written as several documents.
    docs = rows.groupBy(F.substring(F.md5("sample_id"), 1, 2).alias("_g")).agg(F.collect_list(F.struct(*rows.columns)).alias("entries"))
    docs.select(F.lit(2).alias("schema_version"), "entries").write.json(path)
    return files.read_manifest(s, path, multi_line=False).select("sample_id", "intended_label", "target_preset")


@query("snk_01_window_payload", "SELECT split, trace_id, w, array_to_string(win, ',') AS win FROM win JOIN meta USING (trace_id)", "win", "meta")
def _(s, d):
    path = scratch(s)
    sinks.write_windows(ev_windows(s, d).join(meta(s, d).select("trace_id", "split"), "trace_id"), path)
    return s.read.parquet(path).select("split", "trace_id", "w", F.array_join("win", ",").alias("win"))


@query(
    "snk_02_score_records",
    f"""SELECT trace_id AS file, count(prob) AS n_windows, CASE WHEN count(prob) = 0 THEN 'too_short_for_window_20' ELSE 'ok' END AS status, coalesce(sum(prob), 0.0) AS total,
    count(CASE WHEN prob >= {TAU} THEN 1 END) AS positive FROM (SELECT trace_id FROM meta UNION ALL SELECT 'c' || c_custkey FROM customer) LEFT JOIN pool USING (trace_id) GROUP BY trace_id""",
    "pool", rounds="total",
)
def _(s, d):
    path = scratch(s)
    # The customers stand for traces of up to 19 tokens.
    short = table(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("trace_id"), (F.col("c_custkey") % 20).alias("length"))
    sinks.write_scores(sinks.score_records(pool(s, d), traces=meta(s, d).select("trace_id", "length").unionByName(short), tau=TAU), path)
    r = files.read_scores(s, path)
    total = F.aggregate("phase5_probs", F.lit(0.0), lambda a, x: a + x)
    return r.select("file", "n_windows", "status", total.alias("total"), F.size(F.filter("phase5_positive", lambda p: p)).cast("bigint").alias("positive"))


@query("snk_03_episodes", "SELECT episode_id, intended_label, n_windows, attack_start, attack_end FROM att", "att")
def _(s, d):
    path = scratch(s)
    sinks.write_episodes(episodes(s, d), path)
    back = s.read.schema(f"episode_id string, intended_label string, n_windows bigint, ground_truth_segments {schemas.EPISODE_SEGMENTS}").json(f"{path}/episodes")
    return E.attack_ranges(back).select("episode_id", "intended_label", "n_windows", "attack_start", "attack_end")


@query("snk_04_converted_files", JOB + "SELECT abi, direction, count(DISTINCT trace_id) AS files, count(*) AS tokens FROM cv2 GROUP BY abi, direction", "ltok", "pnames", "pnums")
def _(s, d):
    path = scratch(s)
    fs, tokens = _job(s, d)
    m = ordering.cut(abi_map(s, d))
    resolved = ordering.cut(abi.resolve_abi(fs, tokens, m))
    converted = ordering.cut(abi.convert(resolved, tokens, m))
    sinks.write_converted(converted, abi.conversion_report(resolved, converted), path)
    text = s.read.schema("direction string, trace_id string, line bigint, text string, abi string").json(f"{path}/converted")
    return text.groupBy("abi", "direction").agg(F.count_distinct("trace_id").alias("files"), F.sum(F.size(F.split("text", " "))).alias("tokens"))


@query("snk_05_report")
def _(s, d):
    path = scratch(s)
    r = ordering.cut(results(s, d))
    sinks.write_report(E.realtime_summary(r), E.family_realtime(r), E.top_failures(r, 5), path)
    return s.read.text(f"{path}/markdown").select(F.col("value").alias("line"))


@query("snk_06_score_matrix", "SELECT fold, count(*) AS n, sum(path_a) AS a FROM (SELECT *, CASE WHEN split = 'attack' THEN 'test' ELSE split END AS fold FROM pool) GROUP BY fold", "pool", rounds="a")
def _(s, d):
    path = scratch(s)
    sinks.write_z(pool(s, d).withColumn("fold", F.when(F.col("split") == "attack", "test").otherwise(F.col("split"))), path)
    return s.read.parquet(path).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("path_a").alias("a"))


@query("snk_07_model_registry")
def _(s, d):
    path = scratch(s)
    p = ordering.cut(pool(s, d))
    folds = sampling.split_traces(p).select("trace_id", "fold")
    p = ordering.cut(p.join(folds, "trace_id"))
    models, metrics = fusion.fit_fusion(*[p.where(F.col("fold") == f).drop("fold") for f in ("train", "val", "test")])
    return fusion.save_models(models, ordering.cut(metrics), path)
