"""Call-number tables of processor ABIs: lookup, detection and conversion as joins.

``abi_map`` is a table ``(abi, name, number, ord, common, anchor)``: ``ord`` is the place of a number in its name's
list, ``common`` marks everyday calls and ``anchor`` the calls whose numbers tell ABIs apart. It comes from mapping
files (``sources.files.abi_map``) or any other table. Scoring, coverage and conversion store what they look up, one row
per number or name, and send it whole while it has at most ``ordering.SHARED_ROWS`` rows; the other joins leave that to
the measured size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqalert.operators import ordering

# ABI names and accepted spellings.
ALIASES = {
    "i386": "i386",
    "x86": "i386",
    "x86_32": "i386",
    "x86-32": "i386",
    "x8632": "i386",
    "ia32": "i386",
    "linux_i386": "i386",
    "linux_x86_32": "i386",
    "x86_64": "x86_64",
    "x64": "x86_64",
    "amd64": "x86_64",
    "linux_x86_64": "x86_64",
    "arm": "arm",
    "arm32": "arm",
    "arm_eabi": "arm",
    "linux_arm": "arm",
    "arm64": "arm64_asm_generic",
    "aarch64": "arm64_asm_generic",
    "asm_generic": "arm64_asm_generic",
    "asm-generic": "arm64_asm_generic",
    "arm64_asm_generic": "arm64_asm_generic",
    "arm64/asm-generic": "arm64_asm_generic",
    "linux_arm64": "arm64_asm_generic",
}
# Calls common in user programs.
COMMON_NAMES = """
restart_syscall read write open openat close stat stat64 lstat lstat64 fstat fstat64 newfstatat fstatat64 mmap mmap2
mprotect munmap brk access faccessat ioctl poll ppoll select newselect getdents getdents64 dup dup2 dup3 clone fork
vfork execve exit exit_group waitpid wait4 rt_sigaction rt_sigprocmask sigaction sigprocmask sigreturn rt_sigreturn
futex clock_gettime clock_getres socketcall socket connect accept accept4 recv recvfrom recvmsg sendto sendmsg bind
listen shutdown getsockopt setsockopt getsockname getpeername gettimeofday sched_getparam sched_getscheduler
sched_setparam sched_setscheduler sched_rr_get_interval sched_getaffinity set_tid_address set_robust_list
get_robust_list mkdir rmdir chmod unlink link rename kill pipe pipe2 eventfd epoll_wait epoll_ctl epoll_create
epoll_create1 pread64 preadv pwrite64 pwritev prlimit64 nanosleep pause setitimer getitimer adjtimex
""".split()
# Anchor calls.
ANCHOR_NAMES = """
read write open openat close mmap mmap2 fstat fstat64 newfstatat fstatat64 brk ioctl poll ppoll dup dup2 dup3 pipe pipe2
exit_group exit clock_gettime futex set_tid_address getdents64 getdents set_robust_list prlimit64
""".split()
# Weights of the five coverages.
WEIGHTS = {"common_top_token": 0.35, "known_token": 0.30, "anchor_token": 0.20, "common_top_id": 0.10, "known_unique": 0.05}


def normalize_abi(col: Column) -> Column:
    """Canonical ABI name; NULL for an unknown one."""
    key = F.regexp_replace(F.replace(F.lower(F.trim(col)), F.lit(" "), F.lit("_")), "[^a-z0-9_/-]+", "")
    table = F.create_map(*[F.lit(v) for kv in ALIASES.items() for v in kv])
    return F.try_element_at(table, key)


def primary_names(abi_map: DataFrame) -> DataFrame:
    """Alphabetically first name of every number, with its flags."""
    return abi_map.groupBy("abi", "number").agg(
        F.min("name").alias("name"), F.max("common").alias("common"), F.max("anchor").alias("anchor")
    )


def primary_numbers(abi_map: DataFrame) -> DataFrame:
    """First listed number of every name."""
    return abi_map.groupBy("abi", "name").agg(F.min_by("number", "ord").alias("number"))


def numbers_to_names(tokens: DataFrame, abi_map: DataFrame, abi: str) -> DataFrame:
    """Add ``name`` to numeric tokens; a number without one becomes ``UNKNOWN_NUMBER_x``."""
    names = primary_names(abi_map.where(F.col("abi") == abi)).select(F.col("number").alias("_n"), F.col("name").alias("_name"))
    out = tokens.join(names, F.col("token") == F.col("_n"), "left")
    text = F.coalesce("_name", F.concat(F.lit("UNKNOWN_NUMBER_"), F.col("token").cast("string")))
    return out.select(*tokens.columns, text.alias("name"))


def names_to_numbers(tokens: DataFrame, abi_map: DataFrame, abi: str) -> DataFrame:
    """Add ``number`` (as text) to name tokens; a name without one becomes ``UNKNOWN_SYSCALL_x``."""
    nums = primary_numbers(abi_map.where(F.col("abi") == abi)).select(F.col("name").alias("_n"), F.col("number").alias("_num"))
    out = tokens.join(nums, F.col("token") == F.col("_n"), "left")
    text = F.coalesce(F.col("_num").cast("string"), F.concat(F.lit("UNKNOWN_SYSCALL_"), F.col("token")))
    return out.select(*tokens.columns, text.alias("number"))


def cross_abis(counts: DataFrame, abi_map: DataFrame) -> DataFrame:
    """Counted tokens with their name in every ABI that has one."""
    names = primary_names(abi_map)
    return counts.join(names, F.col("token") == F.col("number")).drop("number")


def remap_table(abi_map: DataFrame, src: str, dst: str, vocab: int) -> DataFrame:
    """``(token, target)``: number in ``dst`` of the call a ``src`` number names; absent or out of vocabulary is 0."""
    s = primary_names(abi_map.where(F.col("abi") == src)).select(F.col("number").alias("token"), "name")
    d = primary_numbers(abi_map.where(F.col("abi") == dst)).select("name", F.col("number").alias("target"))
    out = s.where((F.col("token") >= 0) & (F.col("token") < vocab)).join(d, "name")
    return out.where(F.col("target") < vocab).select("token", "target")


def remap(tokens: DataFrame, abi_map: DataFrame, src: str, dst: str, vocab: int) -> DataFrame:
    """Tokens of ``src`` as numbers of ``dst`` by the call's name. Tokens beyond the vocabulary count as its last id."""
    table = remap_table(abi_map, src, dst, vocab).select(F.col("token").alias("_t"), "target")
    clipped = F.greatest(F.lit(0), F.least(F.lit(vocab - 1), F.col("token")))
    if vocab <= ordering.SHARED_ROWS:
        table = F.broadcast(table)  # at most one row per number of the vocabulary
    rest = [c for c in tokens.columns if c != "token"]
    out = tokens.withColumn("_c", clipped).join(table, F.col("_c") == F.col("_t"), "left")
    return out.select(*rest, F.coalesce("target", F.lit(0)).cast("int").alias("token"))


def repair_table(abi_map: DataFrame, abi: str, max_id: int) -> DataFrame:
    """``(token, target)`` for numbers above ``max_id``: the smallest valid number of the alphabetically first of their
    names that has one."""
    one = abi_map.where(F.col("abi") == abi)
    valid = one.where((F.col("number") >= 0) & (F.col("number") <= max_id)).groupBy("name").agg(F.min("number").alias("target"))
    over = one.where((F.col("number") > max_id) | (F.col("number") < 0)).select(F.col("number").alias("token"), "name").distinct()
    return over.join(valid, "name").groupBy("token").agg(F.min_by("target", "name").alias("target"))


def repair_ids(tokens: DataFrame, abi_map: DataFrame, abi: str, max_id: int) -> DataFrame:
    """Bring numeric tokens into ``0..max_id``. ``mapped`` tells how: ``kept``, ``renamed`` or ``zeroed``."""
    table = repair_table(abi_map, abi, max_id).select(F.col("token").alias("_t"), "target")
    rest = [c for c in tokens.columns if c != "token"]
    ok = F.col("token").between(0, max_id)
    out = tokens.join(table, (F.col("token") == F.col("_t")) & ~ok, "left")
    how = F.when(ok, "kept").when(F.col("target").isNotNull(), "renamed").otherwise("zeroed")
    return out.select(
        *rest, F.when(ok, F.col("token")).otherwise(F.coalesce("target", F.lit(0))).cast("int").alias("token"), how.alias("mapped")
    )


def mapping_stats(repaired: DataFrame, unknown: DataFrame | None = None, max_raw: DataFrame | None = None) -> DataFrame:
    """Counters per trace of repaired tokens; ``unknown(trace_id, name)`` adds unknown names (8 examples)."""
    count = lambda how: F.sum(F.when(F.col("mapped") == how, 1).otherwise(0))
    out = repaired.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("mapped_tokens"), count("renamed").alias("name_from_num_remap"), count("zeroed").alias("oov_to_zero"),
        (count("zeroed") / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("oov_rate"),
    )
    if unknown is None:
        return out
    # Names are counted first; then the examples come from a ranking, so no array of all names is ever built.
    names = unknown.groupBy("trace_id", "name").agg(F.count(F.lit(1)).alias("_n"))
    first = F.row_number().over(Window.partitionBy("trace_id").orderBy("name"))
    names = names.withColumn("_at", first).groupBy("trace_id").agg(
        F.sum("_n").alias("unknown_name_count"), F.sort_array(F.collect_list(F.when(F.col("_at") <= 8, F.col("name")))).alias("unknown_name_examples")
    )
    out = out.join(names, "trace_id", "full_outer")
    zero = ["mapped_tokens", "name_from_num_remap", "oov_to_zero", "unknown_name_count"]
    out = out.fillna(0, zero).fillna(0.0, ["oov_rate"])
    return out.withColumn("raw_tokens", F.col("mapped_tokens") + F.col("unknown_name_count"))


def _top(counts: DataFrame, k: int, by: Sequence[str]) -> DataFrame:
    """Mark the ``k`` most frequent tokens of each group of already counted tokens."""
    if by:
        # Rows per group are distinct tokens of one trace.
        line = Window.partitionBy(*by).orderBy(F.desc("n"), F.asc("token"))
        return counts.withColumn("top", F.row_number().over(line) <= k)
    top = counts.orderBy(F.desc("n"), F.asc("token")).limit(k).select(F.col("token").alias("_t"))
    return counts.join(top, F.col("token") == F.col("_t"), "left").withColumn("top", F.col("_t").isNotNull()).drop("_t")


def _per_abi(rows: DataFrame, entries: DataFrame, key: str, by: Sequence[str], totals: dict[str, Column], known: dict[str, Column]) -> DataFrame:
    """One row per group and candidate ABI: sums ``totals`` over all rows of the group, and sums ``known`` over those whose token the ABI has (0 where it
    has none). ``entries`` has one row per ABI and ``key``; ``known`` names totals, taken whole or under a condition on the other columns of ``entries``.

    Tokens with the same entries are summed together, and only these sums meet the ABIs, so that one pass over the tokens serves totals and ABIs.
    A group whose ``by`` holds a NULL has totals only."""
    by = list(by)
    rest = ["abi", *[c for c in entries.columns if c not in ("abi", key)]]
    # The candidates are the handful of ABIs in the map.
    lists = entries.where(F.col("abi").isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("_in"))
    lists = ordering.cut(lists.join(lists.groupBy("_in").agg(F.min("_key").alias("_kind")), "_in"))
    abis = lists.select(F.explode("_in.abi").alias("abi")).agg(F.sort_array(F.collect_set("abi"))).scalar()
    same = F.col("token") == F.col("_key")
    for c in by:
        same = same & F.col(c).isNotNull()
    met = rows.join(ordering.share(lists.select("_key", "_kind")), same, "left")
    kinds = met.groupBy(*by, "_kind").agg(*[F.sum(c).alias(n) for n, c in totals.items()])
    kinds = kinds.join(ordering.share(lists.groupBy("_kind").agg(F.first("_in").alias("_in"))), "_kind", "left")
    # The entry without an ABI stands for the total.
    kind = lists.schema["_in"].dataType
    entry = F.explode(F.concat(F.array(F.lit(None).cast(kind.elementType)), F.coalesce("_in", F.array().cast(kind))))
    each = kinds.select(*by, *totals, entry.alias("_e")).select(*by, *totals, *[F.col(f"_e.{c}").alias(c) for c in rest])
    sums = each.groupBy(*by, "abi").agg(*[F.sum(n).alias(f"_t_{n}") for n in totals], *[F.sum(c).alias(f"_k_{n}") for n, c in known.items()])
    whole = F.col("abi").isNull()
    of = F.map_from_entries(F.collect_list(F.when(~whole, F.struct("abi", F.struct(*[f"_k_{n}" for n in known])))))
    out = sums.groupBy(*by).agg(F.max(F.when(whole, F.struct(*[f"_t_{n}" for n in totals]))).alias("_all"), of.alias("_of"))
    out = out.select(*by, "_all", "_of", F.explode(abis).alias("abi"))
    one = F.try_element_at("_of", F.col("abi"))
    return out.select(*by, "abi", *[F.col(f"_all._t_{n}").alias(n) for n in totals], *[F.coalesce(one[f"_k_{n}"], F.lit(0)).alias(n) for n in known])


def abi_scores(counts: DataFrame, abi_map: DataFrame, k: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """Five coverages and their weighted score (0..100) of every candidate ABI, per group of counted tokens."""
    by = list(by)
    top = F.col("top")
    part = lambda c, v: F.when(c, v).otherwise(0)
    totals = {"_tokens": F.col("n"), "_unique": F.lit(1), "_top_tokens": part(top, F.col("n")), "_top_ids": part(top, F.lit(1))}
    known = {
        "_known": F.col("_tokens"), "_known_ids": F.col("_unique"), "_common": part(F.col("common"), F.col("_top_tokens")),
        "_common_ids": part(F.col("common"), F.col("_top_ids")), "_anchor": part(F.col("anchor"), F.col("_tokens")),
    }
    ids = primary_names(abi_map).select("abi", "number", "common", "anchor")
    out = _per_abi(_top(counts, k, by), ids, "number", by, totals, known)
    one = F.lit(1)
    cover = {
        "known_token": F.col("_known") / F.greatest(one, "_tokens"),
        "known_unique": F.col("_known_ids") / F.greatest(one, "_unique"),
        "common_top_token": F.col("_common") / F.greatest(one, "_top_tokens"),
        "common_top_id": F.col("_common_ids") / F.greatest(one, "_top_ids"),
        "anchor_token": F.col("_anchor") / F.greatest(one, "_tokens"),
    }
    score = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        score = score + weight * cover[name]
    return out.select(*by, "abi", *[F.round(c, 6).alias(f"{n}_coverage") for n, c in cover.items()], F.round(100.0 * score, 3).alias("score"))


def rank_abis(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add ``place``; 1 is the recommended ABI. Ties by ABI name."""
    # One row per candidate ABI and group.
    line = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(F.desc("score"), F.asc("abi"))
    return scores.withColumn("place", F.row_number().over(line))


def detect_abi(tokens: DataFrame, abi_map: DataFrame, k: int = 20, by: Sequence[str] = ()) -> DataFrame:
    counts = tokens.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("n"))
    return rank_abis(abi_scores(counts, abi_map, k, by), by)


def top_translations(counts: DataFrame, abi_map: DataFrame, abi: str, k: int = 20) -> DataFrame:
    """The ``k`` most frequent numbers with the names they have in ``abi``."""
    top = counts.orderBy(F.desc("n"), F.asc("token")).limit(k)
    # Names per number are a few aliases.
    names = abi_map.where(F.col("abi") == abi).groupBy("number").agg(
        F.concat_ws("|", F.sort_array(F.collect_set("name"))).alias("names"), F.max("common").alias("common")
    )
    out = top.join(names, F.col("token") == F.col("number"), "left")
    return out.select("token", "n", F.coalesce("names", F.lit("")).alias("names"), F.coalesce("common", F.lit(False)).alias("common"))


def anchors(counts: DataFrame, abi_map: DataFrame, abi: str) -> DataFrame:
    """Counted numbers that are an anchor call in ``abi``."""
    ids = primary_names(abi_map.where(F.col("abi") == abi)).where("anchor")
    return counts.join(ids, F.col("token") == F.col("number")).select("token", "n", "name", "common")


def name_coverage(tokens: DataFrame, abi_map: DataFrame) -> DataFrame:
    """Known name tokens per trace and ABI with the verdict: the single best ABI, else ``ambiguous``."""
    names = primary_numbers(abi_map).select("abi", "name")
    out = _per_abi(tokens, names, "name", ["trace_id"], {"n_tokens": F.lit(1)}, {"known": F.col("n_tokens")})
    # One row per candidate ABI.
    per = Window.partitionBy("trace_id")
    best = F.max("known").over(per)
    out = out.withColumn("_best", best).withColumn("_tied", F.sum((F.col("known") == F.col("_best")).cast("int")).over(per))
    clear = (F.col("_best") > 0) & (F.col("_tied") == 1)
    return out.select(
        "trace_id", "abi", "known", (F.col("known") / F.greatest(F.lit(1), "n_tokens")).alias("coverage"),
        F.when(clear, "resolved").otherwise("ambiguous").alias("status"), (clear & (F.col("known") == F.col("_best"))).alias("chosen"),
    )


def lookup(queries: DataFrame, abi_map: DataFrame) -> DataFrame:
    """Answer rows ``(abi, query)``: a number gives its first name, a name its first number; NULL when unknown. The ABI
    may be any accepted spelling or a name of the map."""
    q = queries.withColumn("_abi", F.coalesce(normalize_abi(F.col("abi")), F.col("abi")))
    is_number = F.trim("query").rlike("^[0-9]+$")
    q = q.withColumn("_number", F.when(is_number, F.trim("query").try_cast("int"))).withColumn("_name", F.when(~is_number, F.trim("query")))
    by_number = primary_names(abi_map).select(F.col("abi").alias("_abi"), F.col("number").alias("_number"), F.col("name").alias("_found_name"))
    by_name = primary_numbers(abi_map).select(F.col("abi").alias("_abi"), F.col("name").alias("_name"), F.col("number").alias("_found_number"))
    out = q.join(by_number, ["_abi", "_number"], "left").join(by_name, ["_abi", "_name"], "left")
    answer = F.when(is_number, F.col("_found_name")).otherwise(F.col("_found_number").cast("string"))
    return out.select(*queries.columns, answer.alias("answer"))


def hint_from_path(path: Column, root: str = "") -> Column:
    """ABI named by the first matching folder of the path below ``root``."""
    rel = F.when(F.startswith(path, F.lit(root)), F.substr(path, F.lit(len(root) + 1))).otherwise(path) if root else path
    parts = F.split(rel, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.try_element_at(F.filter(F.transform(folders, normalize_abi), lambda a: a.isNotNull()), F.lit(1))


def resolve_abi(files: DataFrame, tokens: DataFrame, abi_map: DataFrame, explicit: str | None = None, root: str = "", k: int = 20) -> DataFrame:
    """ABI of every file ``(trace_id, path)`` with text tokens ``(trace_id, pos, token)``: explicit hint, folder hint,
    detection; NULL stays unresolved. Problems become the ``error`` column."""
    is_number = F.col("token").rlike("^[0-9]+$")
    kind = tokens.groupBy("trace_id").agg(F.sum(is_number.cast("int")).alias("_num"), F.count(F.lit(1)).alias("n_tokens"))
    out = files.join(kind, "trace_id", "left").fillna(0, ["_num", "n_tokens"])
    direction = F.when((F.col("n_tokens") > 0) & (F.col("_num") == F.col("n_tokens")), "number_to_name").when(
        (F.col("n_tokens") > 0) & (F.col("_num") == 0), "name_to_number"
    )
    out = out.withColumn("direction", direction).withColumn("_folder", hint_from_path(F.col("path"), root))
    out = out.withColumn("_explicit", normalize_abi(F.lit(explicit)) if explicit else F.lit(None).cast("string"))
    numeric = tokens.where(is_number).withColumn("token", F.col("token").try_cast("int"))
    by_number = detect_abi(numeric, abi_map, k, by=["trace_id"]).where(F.col("place") == 1).select("trace_id", F.col("abi").alias("_by_number"))
    by_name = name_coverage(tokens.where(~is_number), abi_map).where("chosen").select("trace_id", F.col("abi").alias("_by_name"))
    out = out.join(by_number, "trace_id", "left").join(by_name, "trace_id", "left")
    conflict = F.col("_explicit") != F.col("_folder")
    error = F.when(F.col("n_tokens") == 0, "no tokens").when(F.col("direction").isNull(), "mixed numbers and names").when(conflict, "conflicting hints")
    detected = F.when(F.col("direction") == "number_to_name", F.col("_by_number")).otherwise(F.col("_by_name"))
    method = F.when(F.col("_explicit").isNotNull(), "explicit").when(F.col("_folder").isNotNull(), "folder").otherwise("detected")
    out = out.withColumn("error", error)
    ok = F.col("error").isNull()
    return out.select(
        "trace_id", "path", "n_tokens", "direction", F.when(ok, F.coalesce("_explicit", "_folder", detected)).alias("abi"),
        F.when(ok, method).alias("method"), "error",
    )


def convert(resolved: DataFrame, tokens: DataFrame, abi_map: DataFrame) -> DataFrame:
    """Converted tokens ``(trace_id, pos, token, converted, known)`` of every resolved file, all ABIs in one join. ``resolved`` is a stored table, because
    its files are counted first."""
    todo = resolved.where(F.col("abi").isNotNull()).select("trace_id", "abi", "direction")
    names = primary_names(abi_map).select("abi", F.lit("number_to_name").alias("direction"), F.col("number").cast("string").alias("_k"), F.col("name").alias("_v"))
    nums = primary_numbers(abi_map).select("abi", F.lit("name_to_number").alias("direction"), F.col("name").alias("_k"), F.col("number").cast("string").alias("_v"))
    is_number = F.col("token").rlike("^[0-9]+$")
    # 007 and 7 are the same number.
    key = F.when(is_number, F.coalesce(F.col("token").try_cast("bigint").cast("string"), F.col("token"))).otherwise(F.col("token"))
    rows = tokens.join(ordering.share(todo), "trace_id").withColumn("_k", key)
    out = rows.join(ordering.share(ordering.cut(names.unionByName(nums))), ["abi", "direction", "_k"], "left")
    missing = F.concat(F.when(F.col("direction") == "number_to_name", "UNKNOWN_NUMBER_").otherwise("UNKNOWN_SYSCALL_"), F.col("token"))
    return out.select(
        "trace_id", "abi", "direction", "pos", "token", F.coalesce("_v", missing).alias("converted"), F.col("_v").isNotNull().alias("known")
    )


def conversion_report(resolved: DataFrame, converted: DataFrame) -> DataFrame:
    """One report row per file: status, direction, ABI, unknown tokens."""
    per = converted.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("converted_tokens"), F.sum((~F.col("known")).cast("int")).alias("unknown_tokens")
    )
    out = resolved.join(per, "trace_id", "left").fillna(0, ["converted_tokens", "unknown_tokens"])
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("abi").isNull(), "unresolved").otherwise("converted")
    return out.withColumn("status", status)


def validate_conversion(reports: DataFrame, converted: DataFrame, abi_map: DataFrame, expected: str = "abi", k: int = 20) -> DataFrame:
    """Checks per output folder (column ``expected``): file counts agree, everything converted to this ABI without
    unknown tokens, and numeric output is detected as this ABI again."""
    rows = reports.withColumn("_folder", F.col(expected))
    files = converted.select("trace_id").distinct().withColumn("_has", F.lit(1))
    rows = rows.join(files, "trace_id", "left")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = rows.where(F.col("_folder").isNotNull()).groupBy(F.col("_folder").alias("folder")).agg(
        F.count(F.lit(1)).alias("reports"), count(F.col("_has") == 1).alias("converted"), count(F.col("status") != "converted").alias("not_converted"),
        count(~F.col("abi").eqNullSafe(F.col("_folder"))).alias("wrong_abi"), count(F.col("unknown_tokens") > 0).alias("with_unknown"),
        F.every(F.coalesce(F.col("direction") == "name_to_number", F.lit(False))).alias("_numeric"),
    )
    numbers = converted.where((F.col("direction") == "name_to_number") & F.col("known")).select(
        F.col("abi").alias("folder"), F.col("converted").cast("int").alias("token")
    )
    again = detect_abi(numbers, abi_map, k, by=["folder"]).where(F.col("place") == 1).select("folder", F.col("abi").alias("_again"))
    out = out.join(again, "folder", "left").withColumn("redetected_abi", F.when(F.col("_numeric"), F.col("_again")))
    clean = (F.col("reports") == F.col("converted")) & (F.col("not_converted") == 0) & (F.col("wrong_abi") == 0) & (F.col("with_unknown") == 0)
    passed = clean & (~F.col("_numeric") | F.coalesce(F.col("_again") == F.col("folder"), F.lit(False)))
    return out.withColumn("passed", passed).drop("_numeric", "_again")
