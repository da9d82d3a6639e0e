"""Collocations by set-oriented mining (SETM) over sorted occurrence relations.

The relation of level k says which frequent phrase of k words starts at each position. A block of a few million words of one
language is one row of it: positions in order, with a gap between pieces, so that equal piece and adjacent position are one
comparison. Per level:

1. Merge-join: the relation meets itself one position further on. Two phrases of k words there are a phrase of k + 1 words.
2. Group-count: a block sends each such phrase once, with its count; the counts are summed over blocks.
3. Semi-join: the frequent phrases go back to the blocks that hold them, and what is left is stored as the next relation.

Blocks are counted before anything is shuffled, so a phrase, however common, is one row per block. A phrase is a pair of numbers,
those of its first and its last k words, so rows do not grow with the length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqalert.llm.text import rows
from seqalert.operators.ordering import share
from seqalert.session import cut

#: Words of a block, and different words that a task holds at once. Neither changes a result.
BLOCK_WORDS, HELD_WORDS = 2_000_000, 400_000
#: Bytes of a text that are split into words at once.
SLICE = 1 << 20
#: Candidates of one language that one task ranks.
TASK_ROWS = 200_000
#: Most phrases of a level that are sent whole to every executor; more are joined by shuffle.
SHARED = 300_000
#: Parts into which the phrases that begin alike are dealt.
SALT = 4

#: Characters that end a piece, all turned into a byte that no UTF-8 text holds.
_END = b"\xff"
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _END * 10)
_PACK = "zstd"
#: Bits of a place in a block, and of a block's number inside its task.
_PLACE, _BLOCK = 22, 20


class Numbers(dict):
    """Numbers of words in the order of their first use; 0 ends a piece."""

    def __init__(self):
        super().__init__({_END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def slices(text: str | None, size: int = SLICE) -> Iterator[list[bytes]]:
    """Lower-cased words (A-Z only) and piece ends of a text, some megabytes at a time."""
    data = (text or "").encode("utf-8", "surrogatepass").lower().translate(_ENDS).replace(_END, b" \xff ")
    at = 0
    while at < len(data):
        end = data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _packed(codes: np.ndarray) -> bytes:
    """Compressed 32-bit numbers, low bytes first, so that the bytes that are mostly zero lie together."""
    return pa.compress(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), _PACK, asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * n, _PACK), np.uint8).reshape(4, n).T.copy().view("<u4").reshape(n)


def _blocks(most: int, block_words: int, held_words: int):
    """Blocks ``(block, lang, counted, n, size, codes, letters, words)``: ``codes`` numbers ``size`` words and piece ends, of which the first
    ``counted`` are this block's own; the rest of a text that goes on in another block is there to complete phrases. ``n`` counts the words."""
    schema = pa.schema(
        [("block", pa.int64()), ("lang", pa.string()), ("counted", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("codes", pa.binary()), ("letters", pa.int64()), ("words", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Numbers, list[np.ndarray]]] = {}
        size: dict[str, int] = {}
        part, number = TaskContext.get().partitionId() << _BLOCK, 0

        def flush(lang: str, ahead: int) -> pa.RecordBatch:
            nonlocal number
            known, parts = held.pop(lang)
            codes = np.concatenate(parts)
            if len(codes) >> _PLACE or number >> _BLOCK:
                raise ValueError("smaller blocks, or more tasks, are needed")
            counted = len(codes) - min(ahead, len(codes))
            letters = b" ".join(list(known)[1:])
            row = (part + number, lang, counted, int(np.count_nonzero(codes[:counted])), len(codes), _packed(codes), len(letters), pa.compress(letters, _PACK, asbytes=True))
            number += 1
            if ahead:
                word = list(known)
                start(lang, [word[c] for c in codes[counted:].tolist()])
            else:
                size.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        def start(lang: str, found: list[bytes]) -> None:
            known, parts = held.setdefault(lang, (Numbers(), []))
            if not parts:
                size[lang] = 0
            parts.append(np.fromiter(map(known.__getitem__, found), np.uint32, len(found)))
            size[lang] += len(found)

        for lang, text in rows(batches):
            for found in slices(text):
                start(lang, found)
                if size[lang] >= block_words or len(held[lang][0]) >= held_words:
                    yield flush(lang, most - 1)
            if lang in held:
                start(lang, [_END])
                while sum(len(known) for known, _ in held.values()) >= held_words:
                    yield flush(max(held, key=lambda one: len(held[one][0])), 0)
        for lang in list(held):
            yield flush(lang, 0)

    return run


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(block, lang, code, word, n)`` of every word of a block."""
    for block, lang, counted, _, size, codes, letters, packed in rows(batches):
        found = pa.decompress(packed, letters, _PACK, asbytes=True).split(b" ") if letters else []
        n = np.bincount(_unpacked(codes, size)[:counted], minlength=len(found) + 1)[1:]
        for at in range(0, len(found), 50_000):
            part = found[at : at + 50_000]
            word = pa.array([w.decode("utf-8", "replace") for w in part], pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(part), block)), pa.array([lang] * len(part), pa.string()), pa.array(np.arange(at + 1, at + 1 + len(part))), word, pa.array(n[at : at + 50_000])],
                names=["block", "lang", "code", "word", "n"],
            )


def joined(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge-join of a relation with itself at the next position: the positions where a phrase starts and another one right after it,
    the number of the longer phrase at each, and of which two numbers each longer phrase is made. 0 is no phrase."""
    at = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0))
    key = (codes[at].astype(np.uint64) << np.uint64(32)) | codes[at + 1]
    pair, longer = np.unique(key, return_inverse=True)
    return at, longer, (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _each(batch: pa.RecordBatch) -> Iterator[tuple]:
    """``block``, ``counted``, ``size``, ``codes``, ``number`` of the rows of a relation."""
    for i in range(batch.num_rows):
        row = batch.slice(i, 1)
        yield *(row.column(row.schema.get_field_index(c))[0].as_py() for c in ("block", "counted", "size", "codes")), row.column(row.schema.get_field_index("number")).flatten().to_numpy()


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(first, block, n, code, last)``: the phrases of a relation's block that are a word longer, and how often the block counts them."""
    for block, counted, size, codes, number in (row for batch in batches for row in _each(batch)):
        at, longer, first, last = joined(_unpacked(codes, size))
        n = np.bincount(longer[at < counted], minlength=len(first))
        for a in range(0, len(first), 50_000):
            part = slice(a, a + 50_000)
            columns = [number[first[part] - 1], np.full(len(first[part]), block), n[part], np.arange(a, a + len(first[part])), number[last[part] - 1]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["first", "block", "n", "code", "last"])


def _kept(grow: bool):
    """The relation of the next level: the blocks with the frequent phrases alone, and the phrases that a block owns."""
    own_type = pa.struct([("number", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("word", pa.string()), ("a", pa.int64())])
    schema = pa.schema(
        [("block", pa.int64()), ("lang", pa.string()), ("counted", pa.int64()), ("size", pa.int64()), ("codes", pa.binary()), ("number", pa.list_(pa.int64())), ("own", pa.list_(own_type))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                block, lang, counted, size, codes = (row.column(c)[0].as_py() for c in range(5))
                kept = row.column(5).flatten()
                old, number = (kept.field(c).to_numpy() for c in ("code", "number"))
                mine = kept.filter(pa.array(number == (block << _PLACE | old)))
                codes = _unpacked(codes, size)
                if grow:
                    at, longer, first, _ = joined(codes)
                    renamed = np.zeros(len(first), np.uint32)
                    renamed[old] = np.arange(1, len(old) + 1)
                    codes = np.zeros(size, np.uint32)
                    codes[at] = renamed[longer]
                else:
                    renamed = np.zeros(max(int(codes.max()), int(old.max())) + 1, np.uint32)
                    renamed[old] = np.arange(1, len(old) + 1)
                    codes = renamed[codes]
                own = pa.StructArray.from_arrays([mine.field(f.name).cast(f.type) for f in own_type], fields=list(own_type))
                lists = [pa.ListArray.from_arrays(pa.array([0, len(one)], pa.int32()), one) for one in (pa.array(number), own)]
                plain = [pa.array([v], f.type) for v, f in zip((block, lang, counted, size, _packed(codes)), schema)]
                yield pa.RecordBatch.from_arrays([*plain, *lists], schema=schema)

    return run


_RELATION = (
    "block bigint, lang string, counted bigint, size bigint, codes binary, number array<bigint>, own array<struct<number bigint, first bigint, last bigint, word string, a bigint>>"
)


def _relation(blocks: DataFrame, found: DataFrame, key: list[str], least: int, grow: bool) -> DataFrame:
    """Group-count and semi-join: ``blocks`` with only those phrases of ``found`` whose ``key`` is counted ``least`` times or more. A phrase's
    number is its place in the first block that holds it; that block owns it and keeps its ``key`` and count. Blocks without any fall out."""
    place = F.shiftleft("block", _PLACE).bitwiseOR(F.col("code"))
    if "first" in key:
        # Rows of one first part lie together, which makes less of what is shuffled; the salt splits a common one.
        key = ["first", "salt", "last"]
        found = found.withColumn("salt", F.pmod(F.xxhash64("last"), F.lit(SALT))).repartition("first", "salt")
    group = Window.partitionBy(*key)
    sums = found.withColumns({"a": F.sum("n").over(group), "number": F.min(place).over(group)}).where(F.col("a") >= least)
    owned = {c: F.when(F.col("number") == place, F.col(c)) for c in ("first", "last", "word", "a") if c in sums.columns}
    types = {"first": "bigint", "last": "bigint", "word": "string", "a": "bigint"}
    each = F.struct("code", "number", *[owned.get(c, F.lit(None).cast(t)).alias(c) for c, t in types.items()])
    told = sums.select("block", each.alias("k")).groupBy("block").agg(F.sort_array(F.collect_list("k")).alias("kept"))
    both = blocks.join(told, "block").select("block", "lang", "counted", "size", "codes", "kept")
    return cut(both.mapInArrow(_kept(grow), _RELATION))


def _phrases(relation: DataFrame) -> DataFrame:
    """The phrases of a relation, once each: ``lang``, ``number``, ``first``, ``last``, ``word``, ``a``."""
    return relation.select("lang", F.explode("own").alias("o")).select("lang", "o.*")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact for counts below 10 ** 14."""
    wide = lambda c: c.cast("decimal(14,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right))


def first_rows(df: DataFrame, by: str, order: list[Column], k: int, spread: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """The first ``k`` rows of each group with their ``rank``. While a group has more than ``task_rows`` rows (at least ``2 * k``) they are
    dealt by a hash of ``spread`` and each part keeps its own first ``k``, so no task sorts a whole group."""
    task_rows = max(task_rows, 2 * k)
    while True:
        many = df.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / task_rows).cast("int").alias("parts")).where("parts > 1")
        if many.isEmpty():
            break
        dealt = df.join(many, by, "left").withColumn("part", F.expr(f"pmod(xxhash64({spread}), coalesce(parts, 1))"))
        dealt = dealt.withColumn("rank", F.row_number().over(Window.partitionBy(by, "part").orderBy(*order))).where(F.col("rank") <= k)
        df = cut(dealt.drop("part", "parts", "rank"))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def collocations(
    docs: DataFrame, most: int = 3, least: int = 10, inside: int = 50, k: int = 2000, lang: str = "lang", text: str = "text",
    block_words: int = BLOCK_WORDS, held_words: int = HELD_WORDS, task_rows: int = TASK_ROWS,
) -> DataFrame:
    """The ``k`` best phrases of 2 to ``most`` words of each language: ``lang``, ``rank`` (from 1), ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A-Z are lower-cased; texts are split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and into words at blanks and tabs. ``a`` counts a phrase, within
    pieces and overlaps included; candidates have ``a >= least``. Cutting a candidate in two leaves counts ``l`` and ``r``; the cut with the least
    score counts, the first of equal ones. A candidate inside a longer candidate with 100 * count >= ``inside`` * ``a`` is dropped. Order: ``score``
    and ``a`` falling, then ``phrase`` by its bytes. ``n`` counts the language's words.

    Null languages are ``und``; null and blank texts have no words; repeated rows count as often as they stand; other columns are ignored; an empty
    table gives an empty result."""
    docs = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    blocks = "block bigint, lang string, counted bigint, n bigint, size bigint, codes binary, letters bigint, words binary"
    stored = cut(docs.mapInArrow(_blocks(most, block_words, held_words), blocks))
    totals = cut(stored.groupBy("lang").agg(F.sum("n").alias("n")))

    found = stored.mapInArrow(_word_counts, "block bigint, lang string, code bigint, word string, n bigint")
    relation = _relation(stored, found, ["lang", "word"], least, grow=False)
    # Per phrase: counts of its beginnings and of its endings, by their number of words, itself last.
    words = _phrases(relation)
    level = words.select("number", "lang", F.col("word").alias("phrase"), F.col("word").alias("last_word"), "a", F.array("a").alias("starts"), F.array("a").alias("ends"))
    levels = []
    for length in range(2, most + 1):
        found = relation.select("block", "counted", "size", "codes", "number").mapInArrow(_extended, "first bigint, block bigint, n bigint, code bigint, last bigint")
        if length < most:
            relation = _relation(relation, found, ["first", "last"], least, grow=True)
            phrases = _phrases(relation).select("first", "last", "a", "number")
        else:
            phrases = found.groupBy("first", "last").agg(F.sum("n").alias("a")).where(F.col("a") >= least).withColumn("number", F.lit(None).cast("bigint"))
        one = share(level.select(F.col("number").alias("first"), "lang", F.col("phrase").alias("begun"), "starts"), SHARED)
        other = share(level.select(F.col("number").alias("last"), "last_word", "ends"), SHARED)
        grown = phrases.join(one, "first").join(other, "last")
        longer = grown.select(
            "number", "lang", F.concat_ws(" ", "begun", "last_word").alias("phrase"), "last_word", "a", "first", "last",
            F.concat("starts", F.array("a")).alias("starts"), F.concat("ends", F.array("a")).alias("ends"),
        )
        longer = cut(longer)
        if levels:
            # Whatever longer phrase holds a phrase, one of the next length holds it too and is no rarer.
            held = longer.select(F.explode(F.array("first", "last")).alias("number"), F.col("a").alias("over")).groupBy("number").agg(F.max("over").alias("over"))
            levels[-1] = levels[-1].join(held, "number", "left").where(F.expr(f"over is null or 100 * over < {inside} * a"))
        levels.append(longer)
        level = longer
    cuts = []
    for length, phrases in enumerate(levels, 2):
        each = [(j, F.col("starts")[j - 1], F.col("ends")[length - j - 1]) for j in range(1, length)]
        best = F.array_min(F.array(*[F.struct(score(F.col("a"), le, ri).alias("score"), F.lit(j).alias("j"), le.alias("l"), ri.alias("r")) for j, le, ri in each]))
        cuts.append(phrases.select("lang", "phrase", "a", best.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    every = cuts[0]
    for one in cuts[1:]:
        every = every.union(one)
    ranked = first_rows(cut(every), "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], k, "phrase", task_rows)
    return ranked.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
