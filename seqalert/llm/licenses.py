"""License scans by patience alignment of license statements with texts.

Words that occur once in a statement and once in a stretch of text anchor the alignment; their longest increasing run is kept,
and the gaps between anchors are aligned in the same way. Coverage is the share of the statement's words that are aligned.
A text may repeat a statement, so it is not aligned as a whole: places where enough words of a statement stand together
are found first, and each such stretch is aligned on its own.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqalert.llm.license_texts import TEXTS
from seqalert.llm.text import emitted, rows

#: Statements to look for: identifier -> text. Short notices and two long ones are written here; the standard headers and
#: texts of the common licenses are in ``license_texts``.
STATEMENTS = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the '
        "License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing '
        "permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the '
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the Software."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "All rights reserved": "All rights reserved.",
    **TEXTS,
}
#: Least coverage of a statement that is reported.
COVERAGE = 0.8
#: Where a statement is repeated without a gap, nearly every word begins a stretch. Those that begin within this part of the statement's length
#: from one aligned before are not aligned again: that alignment goes on for a quarter of the length behind its stretch, so it holds them.
STEPS = 8

_STRIP = ".,;:!?\"'()[]{}<>*#%&$|/\\-_=~`"


def plain(text: str | None) -> list[str]:
    """Lower-cased words without marks at their ends; words of marks alone are left out."""
    return [w for w in (t.strip(_STRIP) for t in (text or "").lower().split()) if w]


def rising(pairs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of ``pairs`` (sorted by the first) whose second numbers rise, by patience sorting."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        back[i] = last[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(b)
            last.append(i)
        else:
            tops[pile], last[pile] = b, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Aligned places of ``a`` and ``b``. A gap without a common unique word is aligned from its two ends as far as it agrees."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        n_a, n_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1) if n_b[b[j]] == 1}
        anchors = rising([(i, place[a[i]]) for i in range(a0, a1) if n_a[a[i]] == 1 and a[i] in place])
        if not anchors:
            continue
        out += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(ends, ends[1:]) if u > x + 1 and v > y + 1]
    return sorted(out)


class Scanner:
    def __init__(self, statements: Mapping[str, str], least: float):
        self.least = least
        self.words = {name: plain(text) for name, text in statements.items()}
        self.count = {name: Counter(words) for name, words in self.words.items()}
        self.where: dict[str, list[str]] = {}
        for name in statements:
            for word in self.count[name]:
                self.where.setdefault(word, []).append(name)

    def stretches(self, name: str, at: list[int], words: list[str]) -> Iterator[tuple[int, int]]:
        """Parts of the text, twice as long as the statement, that hold enough of its words; ``at`` are the places of its words.

        An alignment with ``hits`` words needs that many of the statement's words within its span. Spans over twice the
        statement's length are no copy of it. Stretches may overlap where a statement is repeated without a gap."""
        size = len(self.words[name])
        need, wide = -(-int(self.least * 1000) * size // 1000), max(2 * size, size + 4)
        first, have, inside, end = 0, 0, Counter(), -1
        told = self.count[name]
        for last, place in enumerate(at):
            word = words[place]
            inside[word] += 1
            have += inside[word] <= told[word]
            while place - at[first] >= wide:
                gone = words[at[first]]
                have -= inside[gone] <= told[gone]
                inside[gone] -= 1
                first += 1
            if have >= need and at[first] > end:
                # Drop surplus words in front, then take the shortest stretch that ends here.
                while inside[words[at[first]]] > told[words[at[first]]]:
                    inside[words[at[first]]] -= 1
                    first += 1
                yield at[first], place + 1 + (size - have)
                end = at[first]

    def scan(self, text: str | None) -> Iterator[tuple]:
        """(statement, coverage, first word, last word + 1) of the best stretch of every statement found."""
        words = plain(text)
        # Only statements of which enough words stand in the text, in any order, are looked for.
        held: dict[str, int] = {}
        for w, n in Counter(words).items():
            for name in self.where.get(w, ()):
                held[name] = held.get(name, 0) + min(n, self.count[name][w])
        for name in [n for n in self.words if held.get(n, 0) and held[n] >= self.least * len(self.words[n])]:
            told, own = self.words[name], self.count[name]
            places = [i for i, w in enumerate(words) if w in own]
            best = (0.0, 0, 0)
            after = 0
            for start, stop in self.stretches(name, places, words):
                if start < after:
                    continue
                after = start + max(1, len(told) // STEPS)
                # Words before the copy may have been counted for it, so that the stretch ends early; then a longer one is aligned.
                for end in (stop, stop + len(told) // 4):
                    found = patience(told, words[start:end])
                    cover = len(found) / len(told)
                    if found and cover > best[0]:
                        best = (cover, start + found[0][1], start + found[-1][1] + 1)
                    if cover == 1:
                        break
                if best[0] == 1:
                    break
            if best[0] >= self.least:
                yield name, *best


def scanned(docs: DataFrame, statements: Mapping[str, str] = STATEMENTS, least: float = COVERAGE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``license`` (the best statement), ``coverage``, ``first_word``, ``last_word`` (its place, in words without marks)
    and ``licenses`` (all found, sorted) of every row of ``docs``.

    The best has the largest coverage, then the most words, then the first name. A text without any, a null and an empty text
    have nulls and an empty list. Texts are scanned whole. Rows that repeat an id are rows of the result, other columns are
    ignored, and an empty table gives no rows."""
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("licenses", pa.list_(pa.string()))])
    statements = dict(statements)

    def make(batches):
        scanner = Scanner(statements, least)
        for doc, body in rows(batches):
            found = sorted(scanner.scan(body), key=lambda f: (-f[1], -len(scanner.words[f[0]]), f[0]))
            yield doc, *(found[0] if found else (None,) * 4), sorted(f[0] for f in found)

    picked = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(lambda b: emitted(make(b), schema), "doc_id bigint, license string, coverage double, first_word bigint, last_word bigint, licenses array<string>")
