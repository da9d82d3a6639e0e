"""ABI lookup, detection and conversion over call-number tables made of the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqalert.contract.base import abi_map, li_tokens, query, scratch, table
from seqalert.operators import abi, ordering, windows as win


def _wide(s, d):
    """Tokens of the orders beyond the 341 numbers of the map: customer order histories."""
    o = table(s, d, "orders")
    return win.tokens_from(o, "o_custkey", ["o_orderdate", "o_orderkey"], (F.col("o_orderkey") % 500).cast("int"))


WIDE = ", wide AS (SELECT CAST(o_custkey AS VARCHAR) AS trace_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos, CAST(o_orderkey % 500 AS INTEGER) AS token FROM orders)"
NAMED = ", named AS (SELECT CAST(l_suppkey AS VARCHAR) AS trace_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS pos, replace(p_name, ' ', '_') || '_' || replace(p_brand, '#', '') AS token FROM lineitem JOIN part ON p_partkey = l_partkey)"


def _named(s, d):
    l = table(s, d, "lineitem").join(table(s, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.replace("p_brand", F.lit("#"), F.lit("")))
    return win.tokens_from(l, "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], name)


@query("jn_07_numbers_to_names", WIDE + "SELECT trace_id, pos, token, coalesce(name, 'UNKNOWN_NUMBER_' || token) AS name FROM wide LEFT JOIN (SELECT number, name FROM pnames WHERE abi = 'economy') ON number = token", "pnames")
def _(s, d):
    return abi.numbers_to_names(_wide(s, d), abi_map(s, d), "economy")


@query("jn_08_names_to_numbers", NAMED + "SELECT trace_id, pos, token, coalesce(CAST(number AS VARCHAR), 'UNKNOWN_SYSCALL_' || token) AS number FROM named LEFT JOIN (SELECT number, name FROM pnums WHERE abi = 'economy') ON name = token", "pnums")
def _(s, d):
    return abi.names_to_numbers(_named(s, d), abi_map(s, d), "economy")


@query("jn_09_cross_abis", "SELECT token, n, abi, name, common, anchor FROM (SELECT token, count(*) AS n FROM ltok GROUP BY token) JOIN pnames ON number = token", "ltok", "pnames")
def _(s, d):
    return abi.cross_abis(win.token_counts(li_tokens(s, d)), abi_map(s, d))


@query(
    "jn_13_remap",
    """, t AS (SELECT s.number AS token, d.number AS target FROM pnames s JOIN pnums d ON d.name = s.name WHERE s.abi = 'economy' AND d.abi = 'standard' AND s.number < 300 AND d.number < 300)
    SELECT trace_id, pos, CAST(coalesce(target, 0) AS INTEGER) AS token FROM ltok LEFT JOIN t ON t.token = least(299, ltok.token)""",
    "ltok", "pnames", "pnums",
)
def _(s, d):
    return abi.remap(li_tokens(s, d), abi_map(s, d), "economy", "standard", 300)


REPAIR = """, ok AS (SELECT name, min(number) AS target FROM amap WHERE abi = 'economy' AND number <= 200 GROUP BY name), rep AS (SELECT number AS token, arg_min(target, name) AS target FROM (SELECT DISTINCT number, name FROM amap WHERE abi = 'economy' AND number > 200) JOIN ok USING (name) GROUP BY number),
    fixed AS (SELECT trace_id, pos, CAST(CASE WHEN wide.token <= 200 THEN wide.token ELSE coalesce(target, 0) END AS INTEGER) AS token, CASE WHEN wide.token <= 200 THEN 'kept' WHEN target IS NOT NULL THEN 'renamed' ELSE 'zeroed' END AS mapped FROM wide LEFT JOIN rep ON rep.token = wide.token)"""


@query("jn_14_repaired_ids", WIDE + REPAIR + "SELECT trace_id, pos, token, mapped FROM fixed", "amap")
def _(s, d):
    return abi.repair_ids(_wide(s, d), abi_map(s, d), "economy", 200)


@query(
    "agg_22_mapping_stats",
    WIDE + REPAIR + """, un AS (SELECT CAST(o_custkey AS VARCHAR) AS trace_id, o_orderpriority AS name FROM orders WHERE o_orderstatus = 'F'),
    u AS (SELECT trace_id, count(*) AS unknown_name_count, array_to_string(list_sort(list_distinct(list(name)))[1:8], ',') AS unknown_name_examples FROM un GROUP BY trace_id),
    f AS (SELECT trace_id, count(*) AS mapped_tokens, count(CASE WHEN mapped = 'renamed' THEN 1 END) AS name_from_num_remap, count(CASE WHEN mapped = 'zeroed' THEN 1 END) AS oov_to_zero, avg(CAST(mapped = 'zeroed' AS INTEGER)) AS oov_rate FROM fixed GROUP BY trace_id)
    SELECT trace_id, mapped_tokens, name_from_num_remap, oov_to_zero, oov_rate, coalesce(unknown_name_count, 0) AS unknown_name_count, coalesce(unknown_name_examples, '') AS unknown_name_examples, mapped_tokens + coalesce(unknown_name_count, 0) AS raw_tokens FROM f LEFT JOIN u USING (trace_id)""",
    "amap", rounds="oov_rate",
)
def _(s, d):
    o = table(s, d, "orders").where(F.col("o_orderstatus") == "F")
    unknown = o.select(F.col("o_custkey").cast("string").alias("trace_id"), F.col("o_orderpriority").alias("name"))
    out = abi.mapping_stats(abi.repair_ids(_wide(s, d), abi_map(s, d), "economy", 200), unknown)
    return out.withColumn("unknown_name_examples", F.coalesce(F.array_join("unknown_name_examples", ","), F.lit("")))


def _score_sql(counts: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    j = f"{by}, abi" if by else "abi"
    part = f"PARTITION BY {by} " if by else ""
    return f"""{counts}, mk AS (SELECT *, row_number() OVER ({part}ORDER BY n DESC, token) <= 20 AS top FROM cnt),
    tt AS (SELECT {g}sum(n) AS tokens, count(*) AS uniq, sum(CASE WHEN top THEN n ELSE 0 END) AS top_tokens, count(CASE WHEN top THEN 1 END) AS top_ids FROM mk GROUP BY ALL),
    hh AS (SELECT {g}abi, sum(n) AS known, count(*) AS known_ids, sum(CASE WHEN top AND common THEN n ELSE 0 END) AS com, count(CASE WHEN top AND common THEN 1 END) AS com_ids, sum(CASE WHEN anchor THEN n ELSE 0 END) AS anc FROM mk JOIN pnames ON number = token GROUP BY ALL),
    cv AS (SELECT {'tt.' + by + ', ' if by else ''}ab.abi, coalesce(known, 0) / tokens::DOUBLE AS a, coalesce(known_ids, 0) / uniq::DOUBLE AS b, coalesce(com, 0) / top_tokens::DOUBLE AS c, coalesce(com_ids, 0) / top_ids::DOUBLE AS d, coalesce(anc, 0) / tokens::DOUBLE AS e
        FROM tt CROSS JOIN (SELECT DISTINCT abi FROM pnames) ab LEFT JOIN hh ON hh.abi = ab.abi {f'AND hh.{by} = tt.{by}' if by else ''}),
    sc AS (SELECT {g}abi, round(a, 6) AS known_token_coverage, round(b, 6) AS known_unique_coverage, round(c, 6) AS common_top_token_coverage, round(d, 6) AS common_top_id_coverage, round(e, 6) AS anchor_token_coverage,
        round(100 * (0.35 * c + 0.30 * a + 0.20 * e + 0.10 * d + 0.05 * b), 3) AS score FROM cv)"""


LCNT = ", cnt AS (SELECT token, count(*) AS n FROM ltok GROUP BY token)"
TCNT = ", cnt AS (SELECT trace_id, token, count(*) AS n FROM ltok GROUP BY ALL)"
COVER = "known_token_coverage known_unique_coverage common_top_token_coverage common_top_id_coverage anchor_token_coverage score"


@query("agg_19_abi_scores", _score_sql(LCNT) + "SELECT * FROM sc", "ltok", "pnames", rounds=COVER)
def _(s, d):
    return abi.abi_scores(win.token_counts(li_tokens(s, d)), abi_map(s, d))


@query("top_04_ranked_abis", _score_sql(LCNT) + "SELECT abi, score, CAST(row_number() OVER (ORDER BY score DESC, abi) AS INTEGER) AS place FROM sc", "ltok", "pnames", rounds="score")
def _(s, d):
    return abi.rank_abis(abi.abi_scores(win.token_counts(li_tokens(s, d)), abi_map(s, d))).select("abi", "score", "place")


@query("abi_01_detect_per_trace", _score_sql(TCNT, "trace_id") + "SELECT trace_id, abi, score FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY score DESC, abi) AS r FROM sc) WHERE r = 1", "ltok", "pnames", rounds="score")
def _(s, d):
    return abi.detect_abi(li_tokens(s, d), abi_map(s, d), by=["trace_id"]).where(F.col("place") == 1).select("trace_id", "abi", "score")


@query(
    "top_01_top_translations",
    """SELECT token, n, coalesce(names, '') AS names, coalesce(common, false) AS common FROM (SELECT token, count(*) AS n FROM ltok GROUP BY token ORDER BY n DESC, token LIMIT 20)
    LEFT JOIN (SELECT number, array_to_string(list_sort(list_distinct(list(name))), '|') AS names, bool_or(common) AS common FROM amap WHERE abi = 'economy' GROUP BY number) ON number = token""",
    "ltok", "amap",
)
def _(s, d):
    return abi.top_translations(win.token_counts(li_tokens(s, d)), abi_map(s, d), "economy")


@query("top_02_anchors", "SELECT token, n, name, common FROM (SELECT token, count(*) AS n FROM ltok GROUP BY token) JOIN pnames ON number = token WHERE abi = 'economy' AND anchor", "ltok", "pnames")
def _(s, d):
    return abi.anchors(win.token_counts(li_tokens(s, d)), abi_map(s, d), "economy")


COVERAGE = NAMED + """, kn AS (SELECT trace_id, abi, count(*) AS known FROM named JOIN pnums ON name = token GROUP BY ALL), al AS (SELECT trace_id, abi, n_tokens FROM (SELECT trace_id, count(*) AS n_tokens FROM named GROUP BY trace_id), (SELECT DISTINCT abi FROM pnums)),
    cn AS (SELECT trace_id, abi, n_tokens, coalesce(known, 0) AS known FROM al LEFT JOIN kn USING (trace_id, abi)), bs AS (SELECT *, max(known) OVER (PARTITION BY trace_id) AS best FROM cn),
    ti AS (SELECT *, count(CASE WHEN known = best THEN 1 END) OVER (PARTITION BY trace_id) AS tied FROM bs)"""


@query("agg_20_name_coverage", COVERAGE + "SELECT trace_id, abi, known, known / n_tokens::DOUBLE AS coverage, CASE WHEN best > 0 AND tied = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, best > 0 AND tied = 1 AND known = best AS chosen FROM ti", "pnums", rounds="coverage")
def _(s, d):
    return abi.name_coverage(_named(s, d), abi_map(s, d))


@query(
    "abi_04_lookup",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN p.name ELSE CAST(n.number AS VARCHAR) END AS answer FROM (SELECT l_orderkey, l_linenumber, l_linestatus, lower(p_type) AS abi, CAST(l_partkey % 400 AS INTEGER) AS num, replace(p_name, ' ', '_') || '_' || replace(p_brand, '#', '') AS nm
    FROM lineitem JOIN part ON p_partkey = l_suppkey) q LEFT JOIN pnames p ON p.abi = q.abi AND p.number = q.num LEFT JOIN pnums n ON n.abi = q.abi AND n.name = q.nm""",
    "pnames", "pnums",
)
def _(s, d):
    q = table(s, d, "lineitem").join(table(s, d, "part"), F.col("p_partkey") == F.col("l_suppkey"))
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.replace("p_brand", F.lit("#"), F.lit("")))
    text = F.when(F.col("l_linestatus") == "O", (F.col("l_partkey") % 400).cast("string")).otherwise(name)
    queries = q.select("l_orderkey", "l_linenumber", F.lower("p_type").alias("abi"), text.alias("query"))
    return abi.lookup(queries, abi_map(s, d)).select("l_orderkey", "l_linenumber", "answer")


def _stored(s, rows):
    """Rows that several passes read, in column files: a pass reads the columns that it needs, where a checkpoint gives whole rows one by one."""
    path = scratch(s)
    rows.write.parquet(path)
    return s.read.parquet(path)


def _job(s, d):
    """Every supplier's line items as one file: those with an odd number of named items as names, the others as numbers.

    Files are counted first, so that a line item is sorted once, as a name or as a number. Where parts are missing or repeat, a supplier has more rows
    of one kind than of the other; its file ends with the shorter."""
    l, p = table(s, d, "lineitem"), table(s, d, "part")
    keys = p.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("_k"))
    sizes = l.join(keys, F.col("p_partkey") == F.col("l_partkey"), "left").groupBy("l_suppkey").agg(F.sum(F.coalesce("_k", F.lit(0))).alias("named"), F.count(F.lit(1)).alias("numbered"))
    sizes = ordering.cut(sizes.where("named > 0"))
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]

    def tokens(of, rows, token, count):
        of = ordering.cut(of)
        some = ordering.share(of.select("l_suppkey"))
        out = win.tokens_from(rows(l.join(some, "l_suppkey", "left_semi")), "l_suppkey", order, token, sizes=tuple(of.agg(F.max(count), F.sum(count)).head()))
        # Where all files are as long as names and numbers are, there is nothing to end.
        short = of.where("named <> numbered").select(F.col("l_suppkey").cast("string").alias("trace_id"), F.least("named", "numbered").alias("_end"))
        if short.isEmpty():
            return out
        return out.join(ordering.share(short), "trace_id", "left").where("_end IS NULL OR pos < _end").drop("_end")

    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.replace("p_brand", F.lit("#"), F.lit("")))
    known = sizes.where("l_suppkey IS NOT NULL")
    names = tokens(known.where("named % 2 = 1"), lambda rows: rows.join(p, F.col("p_partkey") == F.col("l_partkey")), name, "named")
    numbers = tokens(known.where("named % 2 = 0"), lambda rows: rows, (F.col("l_partkey") % 341).cast("int").cast("string"), "numbered")
    trace = F.col("l_suppkey").cast("string")
    files = sizes.select(trace.alias("trace_id"), F.concat(F.lit("inbox/"), trace, F.lit(".txt")).alias("path"))
    return files, _stored(s, names.unionByName(numbers))


@query(
    "abi_02_resolved",
    _score_sql(TCNT, "trace_id") + COVERAGE + """, nb AS (SELECT trace_id, abi FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY score DESC, abi) AS r FROM sc) WHERE r = 1), nn AS (SELECT trace_id, abi FROM ti WHERE best > 0 AND tied = 1 AND known = best)
    SELECT c.trace_id, n AS n_tokens, CASE WHEN n % 2 = 1 THEN 'name_to_number' ELSE 'number_to_name' END AS direction, CASE WHEN n % 2 = 1 THEN nn.abi ELSE nb.abi END AS abi FROM (SELECT trace_id, count(*) AS n FROM ltok GROUP BY trace_id) c LEFT JOIN nb ON nb.trace_id = c.trace_id LEFT JOIN nn ON nn.trace_id = c.trace_id""",
    "ltok", "pnames", "pnums",
)
def _(s, d):
    return abi.resolve_abi(*_job(s, d), abi_map(s, d)).select("trace_id", "n_tokens", "direction", "abi")


# Every file of the conversion job with its tokens, direction and ABI, and the converted tokens.
JOB = _score_sql(TCNT, "trace_id") + COVERAGE + """, nb AS (SELECT trace_id, abi FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY score DESC, abi) AS r FROM sc) WHERE r = 1), nn AS (SELECT trace_id, abi FROM ti WHERE best > 0 AND tied = 1 AND known = best),
    rs AS (SELECT c.trace_id, n AS n_tokens, CASE WHEN n % 2 = 1 THEN 'name_to_number' ELSE 'number_to_name' END AS direction, CASE WHEN n % 2 = 1 THEN nn.abi ELSE nb.abi END AS abi FROM (SELECT trace_id, count(*) AS n FROM ltok GROUP BY trace_id) c LEFT JOIN nb ON nb.trace_id = c.trace_id LEFT JOIN nn ON nn.trace_id = c.trace_id),
    cv2 AS (SELECT rs.trace_id, rs.abi, direction, CASE WHEN direction = 'name_to_number' THEN nu.number IS NOT NULL ELSE na.name IS NOT NULL END AS known, nu.number AS number FROM rs JOIN named ON named.trace_id = rs.trace_id JOIN ltok ON ltok.trace_id = named.trace_id AND ltok.pos = named.pos
        LEFT JOIN pnums nu ON nu.abi = rs.abi AND nu.name = named.token LEFT JOIN pnames na ON na.abi = rs.abi AND na.number = ltok.token WHERE rs.abi IS NOT NULL),
    rp AS (SELECT rs.*, coalesce(k, 0) AS converted_tokens, coalesce(u, 0) AS unknown_tokens, CASE WHEN rs.abi IS NULL THEN 'unresolved' ELSE 'converted' END AS status FROM rs LEFT JOIN (SELECT trace_id, count(*) AS k, count(CASE WHEN NOT known THEN 1 END) AS u FROM cv2 GROUP BY trace_id) USING (trace_id))"""


@query("abi_03_conversion_report", JOB + "SELECT trace_id, 'inbox/' || trace_id || '.txt' AS path, n_tokens, direction, abi, 'detected' AS method, NULL::VARCHAR AS error, converted_tokens, unknown_tokens, status FROM rp", "ltok", "pnames", "pnums")
def _(s, d):
    files, tokens = _job(s, d)
    m = ordering.cut(abi_map(s, d))
    resolved = ordering.cut(abi.resolve_abi(files, tokens, m))
    return abi.conversion_report(resolved, abi.convert(resolved, tokens, m))


@query(
    "abi_03_converted",
    NAMED + """SELECT trace_id, pos, token, coalesce(CAST(number AS VARCHAR), 'UNKNOWN_SYSCALL_' || token) AS converted, number IS NOT NULL AS known FROM named LEFT JOIN (SELECT name, number FROM pnums WHERE abi = 'economy') ON name = token""",
    "pnums",
)
def _(s, d):
    m = abi_map(s, d)
    tokens = ordering.cut(_named(s, d))
    # An explicit hint may be any ABI of the map.
    files = tokens.select("trace_id").distinct().select("trace_id", F.lit("economy").alias("abi"), F.lit("name_to_number").alias("direction"))
    return abi.convert(files, tokens, m).select("trace_id", "pos", "token", "converted", "known")


@query(
    "agg_21_validated_conversion",
    JOB + """, rc AS (SELECT abi AS folder, number AS token, count(*) AS n FROM cv2 WHERE direction = 'name_to_number' AND known GROUP BY ALL), rm AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY n DESC, token) <= 20 AS top FROM rc),
    rt AS (SELECT folder, sum(n) AS t, count(*) AS q, sum(CASE WHEN top THEN n ELSE 0 END) AS tt, count(CASE WHEN top THEN 1 END) AS tq FROM rm GROUP BY folder),
    rh AS (SELECT folder, abi, sum(n) AS k, count(*) AS kq, sum(CASE WHEN top AND common THEN n ELSE 0 END) AS c, count(CASE WHEN top AND common THEN 1 END) AS cq, sum(CASE WHEN anchor THEN n ELSE 0 END) AS a FROM rm JOIN pnames ON number = token GROUP BY ALL),
    again AS (SELECT folder, arg_min(abi, (-score, abi)) AS again FROM (SELECT rt.folder, abi, round(100 * (0.35 * c / tt::DOUBLE + 0.30 * k / t::DOUBLE + 0.20 * a / t::DOUBLE + 0.10 * cq / tq::DOUBLE + 0.05 * kq / q::DOUBLE), 3) AS score FROM rt JOIN rh USING (folder)) GROUP BY folder),
    ck AS (SELECT abi AS folder, count(*) AS reports, count(*) AS converted, 0::BIGINT AS not_converted, 0::BIGINT AS wrong_abi, count(CASE WHEN unknown_tokens > 0 THEN 1 END) AS with_unknown, bool_and(direction = 'name_to_number') AS num FROM rp WHERE abi IS NOT NULL GROUP BY abi)
    SELECT folder, reports, converted, not_converted, wrong_abi, with_unknown, CASE WHEN num THEN again END AS redetected_abi, with_unknown = 0 AND (NOT num OR coalesce(again = folder, false)) AS passed FROM ck LEFT JOIN again USING (folder)""",
    "ltok", "pnames", "pnums",
)
def _(s, d):
    files, tokens = _job(s, d)
    m = ordering.cut(abi_map(s, d))
    resolved = ordering.cut(abi.resolve_abi(files, tokens, m))
    converted = _stored(s, abi.convert(resolved, tokens, m))
    return abi.validate_conversion(abi.conversion_report(resolved, converted), converted, m)


@query(
    "fn_03_abi_hint",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'i386' WHEN 1 THEN 'x86_64' WHEN 2 THEN 'arm64_asm_generic' WHEN 3 THEN 'x86_64' END AS abi FROM part""",
)
def _(s, d):
    folders = F.array(*[F.lit(x) for x in ("i386", "run/x86_64", "arm64/x", "X86_64/i386", "none")])
    path = F.concat(F.lit("in/"), F.element_at(folders, (F.col("p_partkey") % 5 + 1).cast("int")), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".txt"))
    return table(s, d, "part").select("p_partkey", abi.hint_from_path(path, "in/").alias("abi"))
