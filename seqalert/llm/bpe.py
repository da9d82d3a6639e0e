"""Byte-level BPE encoding and decoding with a given vocabulary file.

A word's symbols form a doubly linked list, and a priority queue holds every adjacent pair that has a merge rank. The pair of
the lowest rank (leftmost first) is merged, entries that name symbols gone or changed are skipped, and the two new pairs
enter the queue. Decoding concatenates the byte strings of the ids. Words repeat, so a task keeps the ids of short ones.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from seqalert.llm.text import emitted, made, rows, share_parts

#: Word pattern of byte-level BPE. Fixed value: it is part of the file format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and numbers below U+0250, where the faster standard module can split as well.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
LATIN = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{LETTERS}{NUMBERS}]").replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", f"[{NUMBERS}]")
#: Texts with one of these need the full pattern: letters from U+0250 on, and U+001C to U+001F, which are blanks to ``re`` alone.
BEYOND = "[\x1c-\x1f\u0250-\U0010ffff]"
#: Longest word whose ids are kept, and number of words kept, per task.
KEPT_LENGTH, KEPT_WORDS = 40, 400_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the file: printable Latin-1 bytes stand for themselves, the others follow
    from U+0100 on in order. Fixed by the file format."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


@dataclass
class Vocabulary:
    """Ids, merge ranks and added tokens of a vocabulary file."""

    ids: dict[bytes, int]
    merges: dict[tuple[int, int], tuple[int, int]]
    pieces: dict[int, bytes]
    added: list[dict]
    first: list[int] = field(default_factory=list)

    @classmethod
    def parse(cls, data: str) -> Vocabulary:
        told = json.loads(data)
        value = {letter: b for b, letter in enumerate(byte_letters())}
        plain = lambda piece: bytes(value[c] for c in piece)
        ids = {plain(p): i for p, i in told["model"]["vocab"].items()}
        merges = {}
        for rank, pair in enumerate(told["model"]["merges"]):
            a, b = map(plain, pair.split(" ") if isinstance(pair, str) else pair)
            merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        pieces = {i: p for p, i in ids.items()} | {t["id"]: t["content"].encode() for t in told["added_tokens"]}
        return cls(ids, merges, pieces, told["added_tokens"], [ids[bytes([b])] for b in range(256)])


def merge(word: bytes, vocab: Vocabulary) -> list[int]:
    """Ids of one word."""
    symbol = [vocab.first[b] for b in word]
    n = len(symbol)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    known = vocab.merges
    queue = [(known[p][0], i, p) for i, p in enumerate(zip(symbol, symbol[1:])) if p in known]
    heapq.heapify(queue)
    while queue:
        _, left, pair = heapq.heappop(queue)
        right = after[left] if symbol[left] >= 0 else n
        if right >= n or (symbol[left], symbol[right]) != pair:
            continue  # one of the two was merged meanwhile
        symbol[left], symbol[right] = known[pair][1], -1
        after[left] = end = after[right]
        if end < n:
            before[end] = left
            pair = symbol[left], symbol[end]
            if pair in known:
                heapq.heappush(queue, (known[pair][0], left, pair))
        if before[left] >= 0:
            start = before[left]
            pair = symbol[start], symbol[left]
            if pair in known:
                heapq.heappush(queue, (known[pair][0], start, pair))
    return [s for s in symbol if s >= 0]


class Encoder(dict):
    """Word -> its ids as little-endian 32-bit integers, made when first asked for."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab = vocab
        self.every, self.latin, self.beyond = regex.compile(PATTERN).findall, re.compile(LATIN).findall, re.compile(BEYOND).search
        special = sorted((t["content"] for t in vocab.added if t["content"]), key=len, reverse=True)
        self.special = {t["content"]: t["id"].to_bytes(4, "little") for t in vocab.added}
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")").split if special else None
        pieces = [vocab.pieces.get(i, b"") for i in range(max(vocab.pieces) + 1)]
        self.pool, self.length = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces])
        self.start = np.cumsum(self.length) - self.length

    def __missing__(self, word: str) -> bytes:
        out = b"".join(i.to_bytes(4, "little") for i in merge(word.encode("utf-8", "surrogatepass"), self.vocab))
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = out
        return out

    def words(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.every(text) if self.beyond(text) else self.latin(text)))

    def encode(self, text: str) -> bytes:
        """Ids of a text as packed little-endian 32-bit integers; added tokens are cut out of the text first."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.words(text)
        return b"".join(self.special[p] if i % 2 else self.words(p) for i, p in enumerate(self.cut(text)))

    def decode(self, packed: bytes) -> str:
        """Text of packed ids: their byte strings, copied one after the other. Bytes that are no UTF-8 become U+FFFD."""
        ids = np.frombuffer(packed, "<u4")
        if not len(ids):
            return ""
        length = self.length[ids]
        end = np.cumsum(length)
        at = np.arange(end[-1]) + np.repeat(self.start[ids] - end + length, length)
        return self.pool[at].tobytes().decode("utf-8", "replace")


def _parts(told, full: bool):
    def make(batches) -> Iterator[tuple]:
        encoder = made(told, lambda data: Encoder(Vocabulary.parse(data)))
        for doc, text in rows(batches):
            packed = encoder.encode(text or "")
            decoded = encoder.decode(packed)
            if full:
                yield doc, list(memoryview(packed).cast("I")), decoded
            else:
                yield doc, len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()

    return make


def _send(df: DataFrame, path: str):
    """The vocabulary file is read on the driver and sent to every executor; its size does not depend on the data."""
    with open(path, encoding="utf-8") as f:
        return share_parts(df.sparkSession.sparkContext, f.read())


def encoded(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (token ids of the whole text) and ``decoded`` (their text) of every row of ``docs``.

    A null text counts as empty and has no ids. Ids come from the vocabulary file ``path`` of a byte-level BPE. Rows that repeat
    an id are rows of the result, other columns are ignored, and an empty table gives no rows."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
    make = _parts(_send(docs, path), True)
    return docs.selectExpr(f"cast(`{doc_id}` as bigint) as doc_id", f"`{text}` as text").mapInArrow(lambda b: emitted(make(b), schema, 500), "doc_id bigint, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of every row: what ``encoded`` gives, digested inside the task."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    make = _parts(_send(docs, path), False)
    return docs.selectExpr(f"cast(`{doc_id}` as bigint) as doc_id", f"`{text}` as text").mapInArrow(
        lambda b: emitted(make(b), schema), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
