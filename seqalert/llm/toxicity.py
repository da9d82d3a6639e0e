"""Toxicity by a noisy channel: obfuscated words are restored under a character language model, then scored.

The channel turns letters into look-alikes, repeats letters and puts spaces or marks between them. A word that may have
gone through it becomes a lattice of readings, and Viterbi decoding picks the cheapest reading under a character trigram
model that is counted over the whole corpus. The score is a logistic model over restored words and their beginnings.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqalert.llm.text import emitted, made, rows, share_parts
from seqalert.session import cut

#: Most labelled rows that the classifier is fitted on, features it starts from and features it keeps.
FIT_ROWS, CANDIDATES, FEATURES = 20_000, 30_000, 2_000
#: Lengths of word beginnings that serve as features.
BEGINNINGS = (3, 4, 5, 6, 7)
#: Words whose features a task keeps.
KEPT_WORDS = 300_000

#: Look-alikes and the letters they stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c"}
#: Costs of the channel in nats: a look-alike, a letter dropped from a run of equal ones, a mark dropped, a word ended.
COST_LOOKALIKE, COST_REPEAT, COST_MARK, COST_BREAK = 1.0, 0.3, 0.7, 0.7

#: Letters of the language model: lower-case letters below U+0180 by rule; 0 is what lies between words, the last code any
#: other letter.
_LETTERS = sorted({ord(chr(c).lower()) for c in range(0x180) if chr(c).isalpha() and len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 0x180})
_OTHER = len(_LETTERS) + 1
SYMBOLS = _OTHER + 1
_AT = {c: i + 1 for i, c in enumerate(_LETTERS)}
_CODE = np.array([_AT.get(ord(chr(c).lower()[0]), _OTHER) if chr(c).isalpha() else 0 for c in range(0x10000)], np.int64)


def letter_code(letter: str) -> int:
    return int(_CODE[min(ord(letter), 0xFFFF)])


def trigram_codes(text: str) -> np.ndarray:
    """One number per letter and word end: its code and the two before it; a word's start forgets what came before."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.concatenate([[0, 0], np.where(c < 0x10000, _CODE[np.minimum(c, 0xFFFF)], _OTHER), [0]])
    first, second, third = c[:-2], c[1:-1], c[2:]
    used = (second != 0) | (third != 0)
    first = np.where(second == 0, 0, first)
    return ((first * SYMBOLS + second) * SYMBOLS + third)[used]


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, held, size = np.zeros(SYMBOLS**3, np.int64), [], 0
    for (text,) in rows(batches):
        if text:
            held.append(trigram_codes(text))
            size += len(held[-1])
            if size > 2_000_000:
                total += np.bincount(np.concatenate(held), minlength=SYMBOLS**3)
                held, size = [], 0
    if held:
        total += np.bincount(np.concatenate(held), minlength=SYMBOLS**3)
    code = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "n"])


def language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Cost of a letter (or word end) after two others, counted over all texts. The alphabet is fixed, so the model is an
    array of bounded size, whatever the number of texts."""
    counted = docs.select(F.col(text).alias("text")).mapInArrow(_count_trigrams, "code bigint, n bigint")
    got = counted.groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # as arrays: rows would take many times the memory
    n = np.zeros(SYMBOLS**3, np.float32)
    n[got["code"].to_numpy()] = got["n"].to_numpy()
    three = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = three.sum(0), three.sum((0, 1))
    p = ((one + 1) / (one.sum() + SYMBOLS)).astype(np.float32)
    p = (two + 5 * p) / (two.sum(1, keepdims=True) + 5)
    three += 5 * p
    three /= three.sum(2, keepdims=True)
    return -np.log(three, out=three)


def readings(mark: str, again: bool) -> list[tuple[str, float]]:
    """What a character may stand for: (letter, cost), with "" for nothing and " " for the end of a word. ``again`` says that
    it repeats the one before inside a run of three or more."""
    out = [(mark, 0.0)] if mark.isalpha() else [(letter, COST_LOOKALIKE) for letter in LOOKALIKES.get(mark, "")]
    if again and out:
        out.append(("", COST_REPEAT))
    if mark.isalpha():
        return out
    if not mark.isdigit():
        out += [("", COST_MARK), (" ", COST_BREAK)]
    return out or [(" ", COST_BREAK)]


def restore(token: str, cost: np.ndarray) -> list[str]:
    """Words of the cheapest reading of ``token`` under the language model ``cost``."""
    best = {(0, 0): (0.0, None)}  # state: codes of the last two letters; value: cost and the letters so far, linked
    run = {i for m in _THRICE.finditer(token) for i in range(m.start() + 1, m.end())}
    for at, mark in enumerate(token):
        then: dict = {}
        for (a, b), (so_far, path) in best.items():
            for letter, price in readings(mark, at in run):
                if letter == "":
                    state, price, after = (a, b), so_far + price, path
                elif letter == " ":
                    state, after = (0, 0), (" ", path)
                    price += so_far + (float(cost[a, b, 0]) if b else 0.0)
                else:
                    c = letter_code(letter)
                    state, after = (b, c), (letter, path)
                    price += so_far + float(cost[a, b, c])
                if state not in then or price < then[state][0]:
                    then[state] = (price, after)
        best = then
    ends = [(so_far + (float(cost[a, b, 0]) if b else 0.0), path) for (a, b), (so_far, path) in best.items()]
    path, out = min(ends, key=lambda e: e[0])[1], []
    while path is not None:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out)).split()


_EDGE = re.compile(r"^(?:[^\w$@!|+€(]|([$@!|+€(])\1+)+|(?:[^\w$@|+€(]|([$@!|+€(])\2+)+$")
_THRICE = re.compile(r"(.)\1\1+")
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")


@dataclass
class Reader:
    """Turns texts into features; ``chosen`` maps a feature's hash to its number, or is None for all features by hash."""

    cost: np.ndarray
    chosen: dict[int, int] | None = None

    def __post_init__(self):
        self.kept: dict[str, tuple] = {}

    def words(self, token: str) -> list[str]:
        """Restored words of a token without white space, or of spaced letters."""
        token = _EDGE.sub("", token)
        if token.isalpha():
            return restore(token, self.cost) if _THRICE.search(token) else [token]
        if not any(c.isalpha() or c in LOOKALIKES for c in token):
            return []
        return restore(token, self.cost)

    def token(self, token: str) -> tuple:
        found = set()
        for word in self.words(token):
            if len(word) > 1:
                found.add(xxhash.xxh3_64_intdigest(word))
                found.update(xxhash.xxh3_64_intdigest(word[:k], 1) for k in BEGINNINGS if k <= len(word))
        if self.chosen is not None:
            found = {self.chosen[f] for f in found if f in self.chosen}
        if len(self.kept) >= KEPT_WORDS:
            self.kept.clear()
        out = self.kept[token] = tuple(found)
        return out

    def features(self, text: str | None) -> set[int]:
        text = (text or "").lower()
        tokens = set(text.split())
        tokens.update(m.replace("\t", " ") for m in _SPACED.findall(text))
        found: set[int] = set()
        kept, new = self.kept.get, self.token
        for t in tokens:
            f = kept(t)
            if f is None:
                f = new(t)
            if f:
                found.update(f)
        return found


@dataclass(frozen=True)
class Model:
    """Logistic model over the features of a ``Reader``."""

    reader: Reader
    weights: np.ndarray
    bias: float

    @classmethod
    def of(cls, cost, chosen, weights, bias):
        return cls(Reader(cost, chosen), weights, bias)

    def sent(self, docs: DataFrame):
        return share_parts(docs.sparkSession.sparkContext, self.reader.cost, self.reader.chosen, self.weights, self.bias)

    def score(self, text: str | None) -> float:
        found = list(self.reader.features(text))
        return float(1 / (1 + np.exp(-(self.bias + self.weights[found].sum()))))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, seed: int = 5, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Language model from all ``docs``, classifier from a sample of at most about ``fit_rows`` labelled rows that are not held out.

    Features are taken from the toxic rows of the sample, at most ``CANDIDATES`` of them by number of rows; the ``FEATURES`` of
    the largest likelihood ratio are weighted by a penalised logistic fit. Counting and choosing is Spark's work; the driver gets one number
    per candidate and label, and the chosen features of the sample's rows. Rows without id or label, and labels other than
    0 and 1, teach nothing. Without any toxic row the model scores every text by the same prior."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    cost = language_model(docs, text)
    known = labels.where(f"{label} in (0, 1)").groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & ~held_out())
    rate = fit_rows / max(1, known.count())
    if rate < 1:
        known = known.where(F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 12) / float(1 << 52) < rate)
    # The sample's ids are bounded by fit_rows, so the texts need not be shuffled to meet them.
    taught = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(known), "doc_id").select("label", "text")
    plain = share_parts(sc, cost)

    def seen(batches):
        total: Counter = Counter()
        reader = made(plain, Reader)
        for (body,) in rows(batches):
            total.update(reader.features(body))
            if len(total) > 1_000_000:
                yield from total.items()
                total.clear()
        yield from total.items()

    pair = pa.schema([("feature", pa.uint64()), ("n", pa.int64())])
    signed = pa.schema([("feature", pa.int64()), ("n", pa.int64())])

    def counted(batches):
        for b in emitted(seen(batches), pair, 50_000):
            yield pa.RecordBatch.from_arrays([b.column(0).view(pa.int64()), b.column(1)], schema=signed)

    count = taught.where("label = 1").select("text").mapInArrow(counted, "feature bigint, n bigint")
    count = count.groupBy("feature").agg(F.sum("n").alias("n")).where("n >= 3").orderBy(F.desc("n"), "feature").limit(CANDIDATES)
    names = count.toArrow()["feature"].to_numpy().view(np.uint64).tolist()
    narrow = share_parts(sc, cost, {f: i for i, f in enumerate(names)})
    row = pa.schema([("label", pa.int32()), ("found", pa.binary())])

    def vectors(batches):
        reader = made(narrow, Reader)
        for y, body in rows(batches):
            yield int(y), np.array(sorted(reader.features(body)), np.int32).tobytes()

    # Features by row are stored, not sent to the driver: a row may have any number of the candidates, the driver needs those that are chosen.
    stored = cut(taught.mapInArrow(lambda b: emitted(vectors(b), row, 500), "label int, found binary"))
    plain.destroy()
    narrow.destroy()
    width = len(names)

    def occurrences(batches):
        n = np.zeros((2, width + 1), np.int64)  # the last place counts rows
        for y, found in rows(batches):
            n[y, np.frombuffer(found, np.int32)] += 1
            n[y, width] += 1
        y, at = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(n[y, at])], names=["label", "at", "n"])

    got = stored.mapInArrow(occurrences, "label int, at int, n bigint").groupBy("label", "at").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((2, width + 1))
    n[got["label"].to_numpy(), got["at"].to_numpy()] = got["n"].to_numpy()
    zeros, ones = n[:, width]
    if not ones or not zeros:
        return Model(Reader(cost, {}), np.zeros(1), float(np.log((ones + 1) / (zeros + 99))))
    n0, n1 = n[:, :width]
    ratio = np.log((n1 + 0.5) / (ones + 1)) - np.log((n0 + 0.5) / (zeros + 1))
    gain = np.where(ratio > 1, n1 * ratio, 0)
    chosen = np.sort(np.argsort(-gain, kind="stable")[:FEATURES])
    chosen = chosen[gain[chosen] > 0]
    place = np.full(width, -1, np.int32)
    place[chosen] = np.arange(len(chosen))

    def narrowed(batches):
        for y, found in rows(batches):
            at = place[np.frombuffer(found, np.int32)]
            yield y, at[at >= 0].tobytes()

    got = stored.mapInArrow(lambda b: emitted(narrowed(b), row), "label int, found binary").toArrow()
    rows_of = sorted(zip(got["label"].to_pylist(), got["found"].to_pylist()))  # the fit does not depend on the order of the tasks
    y = np.array([label for label, _ in rows_of], float)
    found = [np.frombuffer(f, np.int32) for _, f in rows_of]
    weights, bias = _logistic(np.repeat(np.arange(len(y)), [len(f) for f in found]), np.concatenate(found), y, len(chosen))
    return Model(Reader(cost, {names[c]: i for i, c in enumerate(chosen)}), weights, bias)


def _logistic(row: np.ndarray, col: np.ndarray, y: np.ndarray, width: int, penalty: float = 0.2, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model with 0/1 inputs (given by their places), by accelerated gradient descent."""
    w, b = np.zeros(width), float(np.log(y.sum() / (len(y) - y.sum())))
    most = np.bincount(row, minlength=len(y)).max(initial=1) + 1
    step = 1 / (0.25 * most * np.bincount(col, minlength=width).clip(1) + penalty)
    step_b = 1 / (0.25 * most * len(y))
    at, at_b = w, b
    for i in range(rounds):
        p = 1 / (1 + np.exp(-(at_b + np.bincount(row, at[col], len(y)))))
        new = at - step * (np.bincount(col, (p - y)[row], width) + penalty * at)
        new_b = at_b - step_b * (p - y).sum()
        pull = i / (i + 3)
        at, at_b = new + pull * (new - w), new_b + pull * (new_b - b)
        w, b = new, new_b
    return w, float(b)


def scored(docs: DataFrame, model: Model, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row of ``docs``, from its whole text alone.

    A null or blank text has no features and scores the prior. Rows that repeat an id are rows of the result; other columns
    are ignored; an empty table gives no rows."""
    told = model.sent(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def make(batches):
        m = made(told, Model.of)
        for doc, body in rows(batches):
            yield doc, m.score(body)

    picked = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    out = picked.mapInArrow(lambda b: emitted(make(b), schema), "doc_id bigint, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, with all their columns."""
    told = fit(docs, labels).sent(docs)

    def below(batches):
        m = made(told, Model.of)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield part.filter(pa.array([m.score(t) < threshold for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(below, docs.schema)
