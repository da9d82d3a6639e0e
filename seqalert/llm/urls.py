"""URL filters by host suffix and path prefix, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqalert.session import cut

#: Hexadecimal digits of a digest that serve as join key: 32 bits.
PREFIX = 8
#: Most rules that are sent whole to every executor.
SHARED_RULES = 1_000_000
#: Copies of each rule where rules are joined by shuffle.
SALTS = 32

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased) and ``path`` (from there up
    to ``?``, ``#`` or the end). Both are empty for a null url and for one without ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return df.withColumn("host", F.translate(host, UPPER, LOWER)).withColumn("path", path)


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow", shared: int = SHARED_RULES) -> DataFrame:
    """All rows of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` added.

    ``rules`` has ``host``, ``path``, ``verdict``. A rule fits its host and all subdomains where the url's path starts with the
    rule's path. The rule with the longest text (host and path) wins, then the longer host, then ``block``. Without a fitting
    rule ``rule`` is null and the verdict is ``otherwise``. Rules with a null or an empty host fit nothing.

    The rules have few shapes (number of host labels, length of path), and each distinct host and path gives one expression
    per shape, however long it is. Expressions meet the rules on a short prefix of their digest; the full digest is compared
    after the join. Up to ``shared`` rules are broadcast; more are joined by shuffle, salted, because one expression may be
    that of a third of all urls. Repeated rows and ids stay as they are; an empty table gives no rows; columns of
    ``pages`` named like an added one are replaced."""
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = split_url(pages.select(*kept), url)
    rule = rules.where("length(host) > 0 and path is not null and verdict is not null").select(
        F.concat("host", "path").alias("rule"), F.length("host").alias("host_len"), F.col("verdict").alias("ruled"),
        F.size(F.split("host", "\\.")).alias("labels"), F.length("path").alias("path_len"), F.sha2(F.concat_ws("\n", "host", "path"), 256).alias("digest"),
    ).distinct()
    rule = cut(rule.withColumn("short", F.substring("digest", 1, PREFIX)))
    # Shapes are bounded by the labels of a host name (127) times the lengths of rule paths, not by the number of rules.
    found = sorted(rule.select("labels", "path_len").distinct().collect())
    if not found:
        return rows.select(*kept, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    shape = F.array(*[F.struct(F.lit(s["labels"]).alias("labels"), F.lit(s["path_len"]).alias("path_len")) for s in found])
    each = rows.select("host", "path").distinct().select("host", "path", F.explode(shape).alias("s"))
    each = each.where((F.size(F.split("host", "\\.")) >= F.col("s.labels")) & (F.length("path") >= F.col("s.path_len")))
    suffix, start = F.expr("substring_index(host, '.', -s.labels)"), F.expr("substring(path, 1, s.path_len)")
    each = each.select("host", "path", F.sha2(F.concat_ws("\n", suffix, start), 256).alias("digest"))
    each = each.withColumn("short", F.substring("digest", 1, PREFIX))
    keys = ["short"]
    if rule.limit(shared + 1).count() <= shared:
        rule = F.broadcast(rule)
    else:
        rule = rule.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        each = each.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
        keys.append("salt")
    met = each.join(rule.withColumnRenamed("digest", "full"), keys).where("digest = full")
    rank = F.struct(F.length("rule"), "host_len", F.col("ruled") == "block")
    best = met.groupBy("host", "path").agg(F.max_by(F.struct("rule", "ruled"), rank).alias("best"))
    # One very common url is a skewed key on the left side of this join, which adaptive execution splits.
    out = rows.join(best, ["host", "path"], "left")
    return out.select(*kept, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.ruled", F.lit(otherwise)).alias("verdict"))
