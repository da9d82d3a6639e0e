"""Periodic runs of words by grammar compression.

A run is a stretch of words whose word ``q`` places on is the same all along, with the smallest such ``q`` as its period, that
no neighbouring word extends, and that holds at least ``least`` words and ``exponent`` periods. Per text:

1. Cut. Every three words in a row inside a run occur three times in it, so the text is cut wherever no such triple lies
   across, and only the segments left are compressed.
2. Re-Pair. The most frequent pair of neighbouring symbols of a segment becomes a nonterminal, until no pair occurs twice. Pairs
   wait in a priority queue; the symbols are a linked list. What is left at the end is paired level by level, so that
   the segment has one root.
3. Boundaries. A run crosses the boundary between the two halves of exactly one lowest node of the derivation that holds all of it. So
   the stretches across each nonterminal's own boundary are computed once, on one occurrence: a square on either side of the
   boundary is found by rolling hashes for all periods of all nodes at once, compared word by word, and extended inside the node.
4. Translation. The stretches are moved to every position where the derivation puts their nonterminal, and intervals of one
   period that overlap by a period are merged; the longest is the run.

Three is the number of occurrences that the cut relies on, so ``exponent`` is at least 4 and ``least`` at least 6.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqalert.llm.text import emitted_texts, mix, rows, words

#: Base of the rolling hash. Equal words always give equal hashes; what the hash finds is compared word by word.
_BASE = 0x9E3779B97F4A7C15
#: Entries of the table of nodes and periods that are compared at once.
_AT_ONCE = 1 << 20


def segments(code: np.ndarray) -> list[tuple[int, int]]:
    """Stretches ``(start, end)`` outside which no run lies."""
    out = [(0, len(code))]
    while out:
        # All segments at once: a triple counts where it occurs three times in its own segment.
        start = np.array([s for s, _ in out])
        size = np.array([e - s for s, e in out]) - 2
        own = np.repeat(np.arange(len(out)), size)
        at = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + start[own]
        triple = mix(mix(mix(code[at] + own.astype(np.uint64) * np.uint64(_BASE)) + code[at + 1]) + code[at + 2])
        order = np.argsort(triple, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], triple[order[1:]] != triple[order[:-1]])))
        often = np.repeat(np.diff(np.append(edge, len(order))) >= 3, np.diff(np.append(edge, len(order))))
        at = np.sort(at[order[often]])
        if not len(at):
            return []
        # Triples that share two words lie in one segment.
        gap = np.flatnonzero(np.diff(at) > 1)
        first, last = at[np.concatenate(([0], gap + 1))], at[np.concatenate((gap, [len(at) - 1]))]
        found = [(a, b + 3) for a, b in zip(first.tolist(), last.tolist()) if b + 3 - a >= 6]
        if found == out:
            return out
        out = found
    return out


def repair(code: list[int]) -> tuple[list[tuple[int, int]], list[int], list[int], list[int], int]:
    """Re-Pair over ``code``: the rules (left and right symbol), where each rule's first occurrence starts, the symbols that are
    left with their starts, and the number of the first rule. Symbols below that number are words."""
    n, base = len(code), max(code) + 1
    sym, nxt, prv = list(code), list(range(1, n + 1)), list(range(-1, n - 1))
    where: dict[tuple[int, int], list[int]] = {}
    for i, pair in enumerate(zip(code, code[1:])):
        where.setdefault(pair, []).append(i)
    queue = [(-len(at), pair) for pair, at in where.items() if len(at) > 1]
    heapify(queue)
    rules, starts = [], []
    while queue:
        told, pair = heappop(queue)
        held = where.pop(pair, None)
        if held is None:
            continue
        a, b = pair
        live, last = [], -1
        for i in held:  # ascending; neighbours may have been replaced since, and a pair must not overlap itself
            if sym[i] == a and i != last:
                j = nxt[i]
                if j < n and sym[j] == b:
                    live.append(i)
                    last = j
        if len(live) < 2:
            continue
        if len(live) < -told and queue and len(live) < -queue[0][0]:
            where[pair] = live
            heappush(queue, (-len(live), pair))
            continue
        new = base + len(rules)
        rules.append(pair)
        starts.append(live[0])
        for i in live:
            j = nxt[i]
            sym[i], sym[j] = new, -1
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
        made: dict[tuple[int, int], list[int]] = {}
        for i in live:
            p, k = prv[i], nxt[i]
            if p >= 0:
                made.setdefault((sym[p], new), []).append(p)
            if k < n and sym[k] != new:
                made.setdefault((new, sym[k]), []).append(i)
        for one, at in made.items():
            if len(at) > 1:
                where[one] = at
                heappush(queue, (-len(at), one))
    left, i = [], 0
    while i < n:
        left.append(i)
        i = nxt[i]
    return rules, starts, [sym[i] for i in left], left, base


class Hashes:
    """Rolling hashes of all stretches of a text, modulo 2 ** 64."""

    def __init__(self, code: np.ndarray):
        self.power = np.concatenate(([1], np.full(len(code), _BASE, np.uint64))).astype(np.uint64).cumprod(dtype=np.uint64)
        self.upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(code + np.uint64(1)) * self.power[:-1], dtype=np.uint64)))

    def same(self, a: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether ``[a, a + q)`` and ``[a + q, a + 2q)`` hash alike."""
        one, two, three = self.upto[a], self.upto[a + q], self.upto[a + 2 * q]
        return (two - one) * self.power[q] == three - two


def reach(code: np.ndarray, q: int, at: int, low: int, high: int) -> tuple[int, int]:
    """The stretch of period ``q`` around ``at`` inside ``[low, high)``, where ``code[at] == code[at + q]``."""

    def run(x: int, end: int, step: int) -> int:
        size = 16
        while x != end:
            n = min(size, abs(end - x))
            part = slice(x, x + n) if step > 0 else slice(x - n, x)
            apart = np.flatnonzero(code[part] != code[part.start + q : part.stop + q])
            if len(apart):
                return x + int(apart[0]) if step > 0 else x - n + int(apart[-1]) + 1
            x += n * step
            size *= 4
        return x

    return run(at, low, -1), run(at, high - q, 1) + q


def crossing(code: np.ndarray, hashes: Hashes, s: np.ndarray, b: np.ndarray, e: np.ndarray, least: int, exponent: int) -> Iterator[tuple[int, int, int, int]]:
    """``(node, start, end, period)`` of the long enough stretches inside each node ``[s, e)`` that touch its boundary ``b``.

    Four periods put two on one side of the boundary: a square that ends or begins there. Periods of a side come in rising order; one
    whose square lies inside the stretch found before is a multiple of that stretch's period."""
    for ahead in (True, False):
        most = np.maximum(0, np.minimum((e - b if ahead else b - s) // 2, (e - s) // exponent))
        upto = np.cumsum(most)
        for first, last in _parts(upto):
            size = most[first:last]
            node = np.repeat(np.arange(first, last), size)
            q = np.arange(len(node)) - np.repeat(np.cumsum(size) - size, size) + 1
            hit = np.flatnonzero(hashes.same(b[node] if ahead else b[node] - 2 * q, q))
            before, done = -1, 0
            for i, p in zip(node[hit].tolist(), q[hit].tolist()):
                if i != before:
                    before, done = i, 0
                if 2 * p <= done:
                    continue
                at = int(b[i]) if ahead else int(b[i]) - 2 * p
                if not np.array_equal(code[at : at + p], code[at + p : at + 2 * p]):
                    continue
                start, end = reach(code, p, at, int(s[i]), int(e[i]))
                done = end - at if ahead else at + 2 * p - start
                if end - start >= max(least, exponent * p):
                    yield i, start, end, p


def _parts(upto: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive nodes with about ``_AT_ONCE`` periods together."""
    first = 0
    while first < len(upto):
        before = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, before + _AT_ONCE, side="right")))
        yield first, last
        first = last


def segment_runs(code: np.ndarray, least: int, exponent: int) -> Iterator[tuple[int, int, int]]:
    """Stretches ``(start, end, period)`` of a segment; every run is among them, the others are parts of runs."""
    rules, starts, top, at, base = repair(code.tolist())
    length = [1] * base
    for a, b in rules:
        length.append(length[a] + length[b])
    s = np.array(starts, np.int64)
    # Nodes above the symbols that are left, level by level; each has one position.
    marks = np.array([*at, len(code)], np.int64)
    own = [(s, s + np.array([length[a] for a, _ in rules], np.int64), s + np.array(length[base:], np.int64))]
    while len(marks) > 2:
        pairs = (len(marks) - 1) // 2
        own.append((marks[0 : 2 * pairs : 2], marks[1 : 2 * pairs : 2], marks[2 : 2 * pairs + 1 : 2]))
        marks = np.append(marks[:-1:2], marks[-1])
    found: dict[int, list[tuple[int, int, int]]] = {}
    nodes = [np.concatenate(c) for c in zip(*own)]
    for i, start, end, q in crossing(code, Hashes(code), *nodes, least, exponent):
        if i >= len(rules):
            yield start, end, q
        else:
            found.setdefault(i, []).append((start - starts[i], end - starts[i], q))
    if not found:
        return
    need = [False] * base
    for i, (a, b) in enumerate(rules):
        need.append(i in found or need[a] or need[b])
    places: dict[int, list[np.ndarray]] = {}
    held: dict[int, list[int]] = {}
    for symbol, place in zip(top, at):
        if need[symbol]:
            held.setdefault(symbol, []).append(place)
    for symbol, some in held.items():
        places[symbol] = [np.array(some, np.int64)]
    for i in range(len(rules) - 1, -1, -1):
        if base + i not in places:
            continue
        every = np.concatenate(places.pop(base + i))
        for start, end, q in found.get(i, ()):
            yield from ((x + start, x + end, q) for x in every.tolist())
        a, b = rules[i]
        for symbol, shift in ((a, 0), (b, length[a])):
            if need[symbol]:
                places.setdefault(symbol, []).append(every + shift)


def runs(found: list, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """Runs ``(start, length, period)`` of a list of words (any hashable values), by start, then period."""
    if least < 6 or exponent < 4:
        raise ValueError("a run holds at least 6 words and 4 periods")
    if len(found) < least:
        return []
    number = dict.fromkeys(found)
    for i, w in enumerate(number):
        number[w] = i
    code = np.fromiter(map(number.__getitem__, found), np.uint64, len(found))
    got = []
    for s, e in segments(code):
        _, part = np.unique(code[s:e], return_inverse=True)
        got += [(q, s + a, s + b) for a, b, q in segment_runs(part.astype(np.uint64), least, exponent)]
    out, now = [], None
    for q, a, b in sorted(got):
        if now and now[0] == q and a <= now[2] - q:
            now = (q, now[1], max(b, now[2]))
        else:
            if now:
                out.append(now)
            now = (q, a, b)
    if now:
        out.append(now)
    return sorted((a, b - a, q) for q, a, b in out)


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; ties go to the smallest start, then period."""
    best = None
    for start, length, q in sorted(found):
        if best is None or length * best[2] > best[1] * q:
            best = (start, length, q)
    return best


def collapse(found: list, spans: list[tuple[int, int, int]]) -> list:
    """The words that no run repeats: of each run only the first period stays."""
    edge = np.zeros(len(found) + 1, np.int64)
    for start, length, q in spans:
        edge[start + q] += 1
        edge[start + length] -= 1
    return [found[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()] if spans else found


def planted(found: list, doc_id: int | None) -> list:
    """Words of a document with a repetition of known place: one document of ten, by its id, repeats itself from one word on. A
    document without id stays as it is."""
    n, h = len(found), zlib.crc32(str(doc_id).encode())
    if doc_id is None or not n or h % 10:
        return found
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return found[:a] + [found[a + (i - a) % p] for i in range(a, n)]


def periodic(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 6, exponent: int = 4, prepare: Callable[[list, int | None], list] | None = None
) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (array of start, length, period in words, by start, then period), ``strongest`` (the run with
    the most periods, or null) and ``collapsed`` (the words that no run repeats, with one space between) of every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``; ``prepare`` may change a document's words first. A null or blank text has no words, no runs
    and an empty ``collapsed``. Rows that repeat an id, or have none, are rows of the result; other columns are ignored; an empty table
    gives an empty result. A text is the work of one task; its memory is some hundred bytes a word that repeats."""
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("strongest", run), ("collapsed", pa.string())])
    named = lambda r: None if r is None else dict(zip(("start", "length", "period"), r))

    def make(batches) -> Iterator[tuple]:
        for doc, body in rows(batches):
            found = words(body)
            if prepare:
                found = prepare(found, doc)
            spans = runs(found, least, exponent)
            yield doc, len(found), [named(r) for r in spans], named(strongest(spans)), b" ".join(collapse(found, spans)).decode("utf-8", "replace")

    picked = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    one = "struct<start: bigint, length: bigint, period: bigint>"
    return picked.mapInArrow(
        lambda b: emitted_texts(make(b), schema, 4), f"doc_id bigint, n_words bigint, runs array<{one}>, strongest {one}, collapsed string"
    )


def digests(found: DataFrame) -> DataFrame:
    """One row of figures per row of ``periodic``: the strongest run and digests of all runs and of the collapsed text."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "strongest.*",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
