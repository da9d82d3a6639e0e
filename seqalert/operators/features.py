"""Window features: n-gram TF-IDF, centred and uncentred projections.

Fitting is grouped counting or summing on the executors; only model-sized results (a vocabulary of at most
``max_features`` entries, one square matrix of that side) reach the driver. Applying a model is one Arrow pass
without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqalert.operators import curves, ordering, windows as win

#: Bigram codes are ``(first + 1) * SHIFT + second``; unigrams are the token itself.
SHIFT = 1 << 32
#: Distinct n-grams that a task counts before it sends them on.
HELD = 2_000_000
#: Bits of a token's place in the code of a phrase.
DIGIT = 20
#: Stands for a missing token in arrays of whole numbers.
NULL = np.iinfo(np.int64).min


def stack(series: pd.Series) -> np.ndarray:
    return np.array(series.tolist(), dtype=float) if len(series) else np.empty((0, 0))


def values_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column of whole numbers, one after the other, with ``NULL`` for a missing one, and the length of every list."""
    flat = col.flatten()
    whole = flat.cast(pa.int64())
    return (whole.fill_null(NULL) if flat.null_count else whole).to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def rows_of(col: pa.Array) -> np.ndarray:
    """``stack`` of an Arrow column."""
    flat = col.flatten()
    sizes = pc.list_value_length(col)
    if len(col) and not col.null_count and not flat.null_count and pc.min(sizes) == pc.max(sizes):
        return flat.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(col), -1)
    return stack(col.to_pandas())


def sum_stats(df: DataFrame, partial: Callable[[Iterable[pd.DataFrame]], Iterable[pd.DataFrame]]) -> dict[int, np.ndarray]:
    """Add up model-sized arrays: ``partial`` turns the batches of one task into rows ``(key, vals)``, which are then
    summed per key in the JVM."""
    parts = df.mapInPandas(partial, "key int, vals array<double>")
    total = parts.groupBy("key").agg(Summarizer.sum(array_to_vector("vals")).alias("v")).select("key", vector_to_array("v").alias("v"))
    told = total.toArrow()  # without a Python number per value
    return {k: v.values.to_numpy() for k, v in zip(told["key"].to_pylist(), told["v"])}


class _Tfidf:
    """Sublinear TF-IDF (or with plain counts) with smoothed idf ``ln((1 + n) / (1 + df)) + 1`` and rows of length one."""

    def __init__(self, max_features: int, sublinear: bool = True) -> None:
        self.max_features, self.sublinear = max_features, sublinear

    def grams(self) -> Column:
        raise NotImplementedError

    def counter(self) -> "_Words | _Phrases | _Chars | None":
        """Turns tokens and their windows into codes of n-grams and their windows inside a task, and codes into n-grams; None where only ``grams`` can."""
        return None

    def _counts(self, windows: DataFrame) -> DataFrame:
        rows = windows.select(self.grams().alias("_g")).select("_g", F.posexplode("_g").alias("_at", "gram"))
        # Only a window's first occurrence counts for the document frequency.
        first = (F.array_position("_g", F.col("gram")) == F.col("_at") + 1).cast("int")
        return rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.sum(first).alias("df"))

    def _counts_in_tasks(self, windows: DataFrame, dtype: str) -> DataFrame:
        """``_counts`` of windows of whole numbers, counted as arrays before a row is made of an n-gram."""
        tfidf, held = self._slim(), HELD

        def rows(batches):
            of, codes, n, df = tfidf.counter(), *[np.empty(0, dtype=np.int64)] * 3
            new, size = [], 0

            def merged():
                told = [np.concatenate(c) for c in zip((codes, n, df), *new)]
                every, at = np.unique(told[0], return_inverse=True)
                return every, *[np.bincount(at, weights=t, minlength=len(every)).astype(np.int64) for t in told[1:]]

            def sent():
                for i in range(0, len(codes), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(of.named(codes[i : i + 50_000])), pa.array(n[i : i + 50_000]), pa.array(df[i : i + 50_000])], names=["gram", "n", "df"])

            for batch in batches:
                flat, lengths = values_of(batch.column(0))
                row = np.repeat(np.arange(len(lengths)), lengths)
                found, owner = of(flat, row)
                every, at = np.unique(found, return_inverse=True)
                once = np.unique(owner * max(1, len(every)) + at) % max(1, len(every))
                new.append((every, np.bincount(at, minlength=len(every)), np.bincount(once, minlength=len(every))))
                size += len(every)
                if size > max(len(codes), held // 4):
                    codes, n, df = merged()
                    new, size = [], 0
                if len(codes) > held or of.full():
                    if new:
                        codes, n, df = merged()
                    yield from sent()
                    of, codes, n, df = tfidf.counter(), *[np.empty(0, dtype=np.int64)] * 3
                    new, size = [], 0
            if new:
                codes, n, df = merged()
            yield from sent()

        return _few_tasks(windows).select(F.col("win").cast("array<bigint>").alias("win")).mapInArrow(rows, f"gram {dtype}, n bigint, df bigint")

    def fit(self, windows: DataFrame):
        whole = dict(windows.dtypes)["win"] in ("array<tinyint>", "array<smallint>", "array<int>", "array<bigint>")
        if whole and self.counter() is not None:
            # A window with a missing token is left to ``grams``, which says what its n-grams are.
            missing = F.exists("win", lambda t: t.isNull())
            others = self._counts(windows.where(missing))
            counts = self._counts_in_tasks(windows.where(~missing), dict(others.dtypes)["gram"])
            counts = counts.unionByName(others).groupBy("gram").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
        else:
            counts = self._counts(windows)
        n = windows.count()
        top = win.vocabulary(counts, self.max_features)
        idf = F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1
        found = top.select("gram", "idx", "n", "df", idf.alias("idf"))
        self.entries = [tuple(r) for r in found.collect()]
        self.table = windows.sparkSession.createDataFrame(self.entries, found.schema)
        self.__dict__.pop("_known", None)
        return self

    def weights(self, windows: DataFrame) -> DataFrame:
        """Non-zero weights ``(trace_id, w, idx, weight)``. A window is one row, so its n-grams are counted and weighted inside a
        task and nothing is shuffled."""
        tfidf = self._slim()

        def rows(batches):
            at = np.array([e[1] for e in tfidf.entries], dtype="int32")
            for pdf in batches:
                for start in range(0, len(pdf), 1000):
                    part = pdf.iloc[start : start + 1000]
                    x = tfidf.matrix(part["win"].tolist())
                    r, c = np.nonzero(x)
                    yield pd.DataFrame({"trace_id": part["trace_id"].to_numpy()[r], "w": part["w"].to_numpy()[r], "idx": at[c], "weight": x[r, c]})

        return windows.select("trace_id", "w", "win").mapInPandas(rows, "trace_id string, w bigint, idx int, weight double")

    def cells(self, wins: Sequence) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window, entry and count of every entry that a window holds, in this order."""
        raise NotImplementedError

    def matrix(self, wins: Sequence) -> np.ndarray:
        out = np.zeros((len(wins), len(self.entries)))
        r, c, n = self.cells(wins)
        out[r, c] = n
        return self._finish(out)

    def sparse(self, wins: Sequence) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``matrix`` as window, entry and weight of its cells that are not zero. A window holds some dozens of thousands of entries."""
        r, c, n = self.cells(wins)
        v = (1 + np.log(n) if self.sublinear else n) * np.array([e[4] for e in self.entries])[c]
        return r, c, v / np.sqrt(np.bincount(r, weights=v * v, minlength=len(wins)))[r]

    def _told(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells from one number ``window * entries + entry`` per occurrence."""
        codes, n = np.unique(at, return_counts=True)
        return codes // len(self.entries), codes % len(self.entries), n.astype(float)

    def _finish(self, counts: np.ndarray) -> np.ndarray:
        idf = np.array([e[4] for e in self.entries])
        x = (np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0.0) if self.sublinear else counts) * idf
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(norm == 0, 1, norm)

    def with_vectors(self, windows: DataFrame, projection: "Projection | None" = None, name: str = "vec") -> DataFrame:
        """Add the dense vector of each window, or its projection."""
        tfidf = self._slim()

        @F.pandas_udf("array<double>")
        def vectors(col: pd.Series) -> pd.Series:
            x = tfidf.matrix(col.tolist())
            return pd.Series(list(x if projection is None else projection.apply(x)), index=col.index)

        return windows.withColumn(name, vectors("win"))

    def _slim(self):
        copy = object.__new__(type(self))
        copy.__dict__.update({k: v for k, v in self.__dict__.items() if k != "table"})
        return copy


class WordTfidf(_Tfidf):
    """Unigrams and bigrams of token numbers."""

    def __init__(self, max_features: int = 1000, bigrams: bool = True, sublinear: bool = True) -> None:
        super().__init__(max_features, sublinear)
        self.bigrams = bigrams

    def grams(self) -> Column:
        one = F.transform("win", lambda t: t.cast("bigint"))
        if not self.bigrams:
            return one
        pair = F.transform(
            F.filter(F.sequence(F.lit(1), F.size("win") - 1), lambda i: F.size("win") > 1),
            lambda i: (F.element_at("win", i).cast("bigint") + 1) * F.lit(SHIFT) + F.element_at("win", i + 1),
        )
        return F.concat(one, pair)

    def counter(self):
        return _Words(self.bigrams)

    def cells(self, wins: Sequence) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes = np.array([e[0] for e in self.entries], dtype=np.int64)
        order = np.argsort(codes)
        if not len(wins):
            return self._told(np.empty(0, dtype=np.int64))
        lengths = np.array([len(v) for v in wins])
        flat = np.concatenate([np.asarray(v, dtype=np.int64) for v in wins])
        row = np.repeat(np.arange(len(wins)), lengths)
        parts = [(row, flat)]
        if self.bigrams and len(flat) > 1:
            same = row[1:] == row[:-1]
            parts.append((row[1:][same], ((flat[:-1] + 1) * SHIFT + flat[1:])[same]))
        found = []
        for r, g in parts:
            at = np.minimum(np.searchsorted(codes[order], g), len(codes) - 1)
            hit = codes[order][at] == g
            found.append(r[hit] * len(codes) + order[at[hit]])
        return self._told(np.concatenate(found))


class PhraseTfidf(_Tfidf):
    """Runs of 1 to ``longest`` token numbers, written as decimals between spaces."""

    def __init__(self, max_features: int = 2000, longest: int = 3, sublinear: bool = True) -> None:
        super().__init__(max_features, sublinear)
        self.longest = longest

    def grams(self) -> Column:
        return F.expr(
            f"""flatten(transform(sequence(1, {self.longest}), n -> transform(
                filter(sequence(1, greatest(1, size(win))), i -> i + n - 1 <= size(win)), i -> array_join(transform(slice(win, i, n), t -> cast(t as string)), ' '))))"""
        )

    def counter(self):
        return _Phrases(self.longest) if self.longest * DIGIT <= 60 else None

    def cells(self, wins: Sequence) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.longest * DIGIT > 60:
            return self._cells_by_name(wins)
        if "_known" not in self.__dict__:
            told = [(tuple(map(int, e[0].split())), e[1]) for e in self.entries if e[0]]
            of = _Phrases(self.longest)
            of.places({t for phrase, _ in told for t in phrase})
            codes = np.array([of.code(phrase) for phrase, _ in told], dtype=np.int64)
            order = np.argsort(codes)
            self._known = of.place, codes[order], np.array([i for _, i in told], dtype=np.int64)[order]
        place, codes, entry = self._known
        lengths = np.array([len(v) for v in wins], dtype=np.int64)
        if not lengths.sum() or not len(codes):
            return self._told(np.empty(0, dtype=np.int64))
        tokens, at = np.unique(np.concatenate([np.asarray(v) for v in wins]), return_inverse=True)
        digit = np.array([place.get(int(t), 0) for t in tokens], dtype=np.int64)[at]
        found, owner = _phrases(digit, np.repeat(np.arange(len(wins)), lengths), self.longest, known=True)
        at = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
        hit = codes[at] == found
        return self._told(owner[hit] * len(self.entries) + entry[at[hit]])

    def _cells_by_name(self, wins: Sequence) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        index = {e[0]: e[1] for e in self.entries}
        found = []
        for r, v in enumerate(wins):
            told = [str(int(t)) for t in v]
            for n in range(1, self.longest + 1):
                for i in range(len(told) - n + 1):
                    if (at := index.get(" ".join(told[i : i + n]))) is not None:
                        found.append(r * len(self.entries) + at)
        return self._told(np.array(found, dtype=np.int64))


class CharTfidf(_Tfidf):
    """Character n-grams of each token written as a decimal between two spaces."""

    def __init__(self, max_features: int = 2000, lo: int = 3, hi: int = 5, sublinear: bool = True) -> None:
        super().__init__(max_features, sublinear)
        self.lo, self.hi = lo, hi

    def grams(self) -> Column:
        lo, hi = self.lo, self.hi
        return F.expr(
            f"""flatten(transform(transform(win, t -> concat(' ', cast(t as string), ' ')), p ->
                flatten(transform(sequence({lo}, least({hi}, greatest({lo}, length(p)))), n ->
                  transform(sequence(1, greatest(1, length(p) - n + 1)), i -> substring(p, i, n))))))"""
        )

    def _named(self, token: int) -> list[str]:
        p = f" {token} "
        sizes = range(self.lo, min(self.hi, max(self.lo, len(p))) + 1)
        return [p[i : i + n] for n in sizes for i in range(max(1, len(p) - n + 1))]

    def counter(self):
        return _Chars(self._named)

    def cells(self, wins: Sequence) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        index = {e[0]: e[1] for e in self.entries}
        lengths = np.array([len(v) for v in wins], dtype=np.int64)
        if not lengths.sum():
            return self._told(np.empty(0, dtype=np.int64))
        tokens, at = np.unique(np.concatenate([np.asarray(v) for v in wins]), return_inverse=True)
        held = [[index[g] for g in self._named(int(t)) if g in index] for t in tokens]
        found, owner = _spread(held, at, np.repeat(np.arange(len(wins)), lengths))
        return self._told(owner * len(self.entries) + found)


class _Words:
    """Codes of ``WordTfidf``, which are its n-grams."""

    def __init__(self, bigrams: bool) -> None:
        self.bigrams = bigrams

    def __call__(self, flat: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.bigrams:
            return flat, row
        same = row[1:] == row[:-1]
        return np.concatenate([flat, ((flat[:-1] + 1) * SHIFT + flat[1:])[same]]), np.concatenate([row, row[1:][same]])

    def named(self, codes: np.ndarray) -> np.ndarray:
        return codes

    def full(self) -> bool:
        return False


class _Phrases:
    """Codes of ``PhraseTfidf``: a digit of ``DIGIT`` bits per token, its place (from 1) among the tokens met so far."""

    def __init__(self, longest: int) -> None:
        self.longest = longest
        self.place: dict[int, int] = {}

    def places(self, tokens) -> list[int]:
        return [self.place.setdefault(t, len(self.place) + 1) for t in tokens]

    def code(self, phrase: tuple) -> int:
        out = 0
        for t in phrase:
            out = (out << DIGIT) + self.place[t]
        return out

    def __call__(self, flat: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tokens, at = np.unique(flat, return_inverse=True)
        digit = np.array(self.places(tokens.tolist()), dtype=np.int64)
        if len(self.place) >= 1 << DIGIT:
            raise ValueError(f"a batch of windows has more than {1 << (DIGIT - 1)} tokens; lower spark.sql.execution.arrow.maxRecordsPerBatch")
        return _phrases(digit[at], row, self.longest)

    def named(self, codes: np.ndarray) -> list[str]:
        word = [""] + [str(t) for t in self.place]
        digits = [(codes >> (DIGIT * i) & (1 << DIGIT) - 1).tolist() for i in range(self.longest - 1, -1, -1)]
        return [" ".join(word[d] for d in phrase if d) for phrase in zip(*digits)]

    def full(self) -> bool:
        return len(self.place) >= 1 << (DIGIT - 1)


def _phrases(digit: np.ndarray, row: np.ndarray, longest: int, known: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Codes and windows of all runs of 1 to ``longest`` digits inside a window; with ``known``, of those without a zero."""
    codes, owners = [], []
    code, fits = digit, digit > 0 if known else np.ones(len(digit), bool)
    for n in range(1, longest + 1):
        if n > 1:
            code = (code[:-1] << DIGIT) + digit[n - 1 :]
            fits = fits[:-1] & (row[n - 1 :] == row[: len(code)])
            if known:
                fits = fits & (digit[n - 1 :] > 0)
        codes.append(code[fits])
        owners.append(row[: len(code)][fits])
        if len(code) < 2:
            break
    return np.concatenate(codes), np.concatenate(owners)


class _Chars:
    """Codes of ``CharTfidf``: the place of an n-gram among those met so far; ``named_of`` gives a token's n-grams."""

    def __init__(self, named_of: Callable[[int], list[str]]) -> None:
        self.named_of = named_of
        self.place: dict[str, int] = {}
        self.known: dict[int, list[int]] = {}

    def __call__(self, flat: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tokens, at = np.unique(flat, return_inverse=True)
        for t in tokens.tolist():
            if t not in self.known:
                self.known[t] = [self.place.setdefault(g, len(self.place)) for g in self.named_of(t)]
        return _spread([self.known[t] for t in tokens.tolist()], at, row)

    def named(self, codes: np.ndarray) -> list[str]:
        every = list(self.place)
        return [every[c] for c in codes.tolist()]

    def full(self) -> bool:
        return len(self.known) > HELD


def _spread(held: list[list[int]], at: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``held[at]`` one after the other, and the ``row`` of every entry."""
    size = np.array([len(h) for h in held], dtype=np.int64)
    flat = np.array([x for h in held for x in h], dtype=np.int64)
    n = size[at]
    start = (size.cumsum() - size)[at] - (n.cumsum() - n)
    return flat[np.repeat(start, n) + np.arange(n.sum())], np.repeat(row, n)


def _few_tasks(df: DataFrame) -> DataFrame:
    """``df`` in at most one part a core, as each part sends a result of the model's size."""
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))


class Projection:
    """Linear map ``(x - mean) @ loadings``."""

    def __init__(self, mean: np.ndarray, loadings: np.ndarray, values: np.ndarray) -> None:
        self.mean, self.loadings, self.values = mean, loadings, values

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.loadings

    def residual(self, x: np.ndarray) -> np.ndarray:
        centred = x - self.mean
        return ((centred - (centred @ self.loadings) @ self.loadings.T) ** 2).mean(axis=1)

    def residual_of_cells(self, n: int, r: np.ndarray, c: np.ndarray, v: np.ndarray) -> np.ndarray:
        """``residual`` of ``n`` rows given by their cells that are not zero, row by row: the square length of a centred row less that of its
        projection, as the loadings are orthonormal."""
        return self.residuals_of_cells([self.loadings.shape[1]], n, r, c, v)[0]

    def residuals_of_cells(self, sizes: Sequence[int], n: int, r: np.ndarray, c: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
        """``residual_of_cells`` under the first components only, for each of ``sizes``."""
        dot = lambda w: np.bincount(r, weights=w, minlength=n)
        length = dot(v * v) - 2 * dot(v * self.mean[c]) + self.mean @ self.mean
        onto, out = _onto(n, r, c, v, self.loadings), []
        for size in sizes:
            part = onto[:, :size] - self.mean @ self.loadings[:, :size].copy(order="K")
            out.append(np.maximum(length - (part**2).sum(axis=1), 0) / len(self.mean))
        return out

    def transform(self, df: DataFrame, vec: str = "vec", name: str = "projected") -> DataFrame:
        @F.pandas_udf("array<double>")
        def project(col: pd.Series) -> pd.Series:
            return pd.Series(list(self.apply(stack(col))), index=col.index)

        return df.withColumn(name, project(vec))


def _onto(n: int, r: np.ndarray, c: np.ndarray, v: np.ndarray, loadings: np.ndarray, rows: int = 32) -> np.ndarray:
    """Products of ``n`` sparse rows (cells in row order) with ``loadings``, some rows at a time, so that their terms stay in the cache."""
    held = np.bincount(r, minlength=n)
    ends = np.append(0, held.cumsum())
    out = np.zeros((n, loadings.shape[1]))
    for i in range(0, n, rows):
        a, b = ends[i], ends[min(i + rows, n)]
        if a < b:
            some = held[i : i + rows] > 0
            terms = loadings[c[a:b]]
            terms *= v[a:b, None]
            out[i : i + rows][some] = np.add.reduceat(terms, (ends[i : i + rows][: len(some)] - a)[some])
    return out


def _gram(df: DataFrame, vec: str, matrices: Callable[[pd.Series], Iterable[np.ndarray]] | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, column sums and ``X'X`` of a vector column, from one partial matrix per task. ``matrices`` makes the rows of
    ``X`` from a column that holds no vectors."""

    def partial(batches):
        total = None
        for pdf in batches:
            for x in [stack(pdf[vec])] if matrices is None else matrices(pdf[vec]):
                if not x.size:
                    continue
                x = np.hstack([x, np.ones((len(x), 1))])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"key": np.arange(len(total)), "vals": list(total)})

    rows = sum_stats(df.select(vec), partial)
    full = np.array([rows[k] for k in sorted(rows)])
    return int(round(full[-1, -1])), full[-1, :-1], full[:-1, :-1]


def _gram_of_cells(df: DataFrame, tfidf: _Tfidf) -> tuple[int, np.ndarray, np.ndarray]:
    """``_gram`` of TF-IDF rows: only pairs of entries that a window holds are added up, some hundreds instead of millions a window."""
    m = len(tfidf.entries)

    def partial(batches):
        total, sums, rows = None, np.zeros(m), 0
        for pdf in batches:
            for i in range(0, len(pdf), 4000):
                add, more = np.zeros(m * m), np.zeros(m)
                for j in range(i, min(i + 4000, len(pdf)), 250):
                    wins = pdf["win"].iloc[j : min(j + 250, i + 4000)].tolist()
                    r, c, v = tfidf.sparse(wins)
                    # Cells of a window follow each other: each meets itself and those behind it.
                    ends = np.bincount(r, minlength=len(wins)).cumsum()
                    met = ends[r] - np.arange(len(r))
                    a = np.repeat(np.arange(len(r)), met)
                    b = a + np.arange(len(a)) - np.repeat(met.cumsum() - met, met)
                    np.add.at(add, c[a] * m + c[b], v[a] * v[b])
                    np.add.at(more, c, v)
                    rows += len(wins)
                total = add if total is None else np.add(total, add, out=total)
                sums += more
        if total is not None:
            half = total.reshape(m, m)
            full = np.zeros((m + 1, m + 1))
            full[:-1, :-1] = half + half.T - np.diag(half.diagonal())
            full[-1, :-1] = full[:-1, -1] = sums
            full[-1, -1] = rows
            yield pd.DataFrame({"key": np.arange(m + 1), "vals": list(full)})

    told = sum_stats(_few_tasks(df.select("win")), partial)
    full = np.array([told[k] for k in sorted(told)])
    return int(round(full[-1, -1])), full[-1, :-1], full[:-1, :-1]


def _fix_sign(v: np.ndarray) -> np.ndarray:
    top = v[np.abs(v).argmax(axis=0), range(v.shape[1])]
    return v * np.where(top < 0, -1, 1)


def pca(df: DataFrame, n: int, vec: str = "vec", matrices: Callable[[pd.Series], Iterable[np.ndarray]] | None = None) -> Projection:
    """Principal components of a vector column of at most a few thousand dimensions, or of the rows that ``matrices`` makes of a column."""
    return _projections(*_gram(df, vec, matrices), "pca", [n])[0]


def svd(df: DataFrame, n: int, vec: str = "vec") -> Projection:
    """Truncated singular vectors, not centred; ``values`` are the singular values."""
    return _projections(*_gram(df, vec), "svd", [n])[0]


def _projections(rows: int, sums: np.ndarray, gram: np.ndarray, method: str, sizes: Sequence[int]) -> list[Projection]:
    """Projections of several sizes from one decomposition; no size is above the number of columns."""
    mean = sums / rows if method == "pca" else np.zeros(len(sums))
    values, vectors = np.linalg.eigh(gram / rows - np.outer(mean, mean) if method == "pca" else gram)
    values = values[::-1] if method == "pca" else np.sqrt(np.maximum(values[::-1], 0))
    return [Projection(mean, _fix_sign(vectors[:, ::-1][:, : min(n, len(sums))]), values[: min(n, len(sums))]) for n in sizes]


#: Name -> features, as the grid of the reference has them.
FEATURES: dict[str, Callable[[], _Tfidf]] = {
    "word(1,2)_1k": lambda: WordTfidf(1000, sublinear=False),
    "word(1,2)_1k_sub": lambda: WordTfidf(1000),
    "word(1,2)_2k_sub": lambda: WordTfidf(2000),
    "word(1,2)_3k_sub": lambda: WordTfidf(3000),
    "word(1,3)_2k_sub": lambda: PhraseTfidf(2000, 3),
    "charwb(3,3)_2k_sub": lambda: CharTfidf(2000, 3, 3),
    "charwb(3,5)_2k_sub": lambda: CharTfidf(2000, 3, 5),
}
REDUCTIONS = [("pca", 50), ("pca", 100), ("svd", 50), ("svd", 100)]


def sweep_features(
    train: DataFrame, test: DataFrame, features: dict[str, Callable[[], _Tfidf]] = FEATURES, reductions: Sequence[tuple[str, int]] = REDUCTIONS, done: DataFrame | None = None
) -> DataFrame:
    """AUC, AP and best F1 of the reconstruction error for each of ``features`` with each ``(method, components)`` of
    ``reductions``, on ``test`` with a label ``y``. Configurations already in ``done`` are not run again. Features are
    fitted, and the training windows summed, once for all reductions."""
    known = set() if done is None else {tuple(r) for r in done.select("features", "method", "components").collect()}
    out = done
    for name, make in features.items():
        todo = [(m, n) for m, n in reductions if (name, m, n) not in known]
        if not todo:
            continue
        tfidf = make().fit(train)._slim()
        sums = _gram_of_cells(train, tfidf)
        configs, models = [], []
        for method in dict.fromkeys(m for m, _ in todo):
            sizes = [n for m, n in todo if m == method]
            configs += [(method, n) for n in sizes]
            # The components of a smaller size are the first of a larger one.
            widest = _projections(*sums, method, [max(sizes)])[0]
            models.append((widest, [min(n, widest.loadings.shape[1]) for n in sizes]))
        errors = _residuals(test, tfidf, models)
        each = F.explode(F.arrays_zip(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(n).alias("components")) for m, n in configs]).alias("config"), F.col("_errors").alias("score")))
        scored = errors.select("y", each.alias("_e")).select("y", "_e.config.method", "_e.config.components", "_e.score")
        rows = curves.all_metrics(curves.score_table(scored, by=["method", "components"]), ["method", "components"]).select(
            F.lit(name).alias("features"), "method", "components", "auc", "ap", "best_f1"
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def _residuals(windows: DataFrame, tfidf: _Tfidf, models: list[tuple[Projection, list[int]]]) -> DataFrame:
    """Add ``_errors``, the reconstruction error of each window under the first components of each of ``models``, by its sizes; vectors stay inside the task."""
    shared = windows.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("array<double>")
    def errors(col: pd.Series) -> pd.Series:
        parts = []
        for i in range(0, len(col), 1000):
            wins = col.iloc[i : i + 1000].tolist()
            cells = tfidf.sparse(wins)
            parts += list(np.stack([e for m, sizes in shared.value for e in m.residuals_of_cells(sizes, len(wins), *cells)], axis=1))
        return pd.Series(parts, index=col.index, dtype=object)

    return windows.withColumn("_errors", errors("win"))


def with_residual(df: DataFrame, model: Projection, vec: str = "vec", name: str = "score") -> DataFrame:
    @F.pandas_udf("double")
    def residual(col: pd.Series) -> pd.Series:
        return pd.Series(model.residual(stack(col)), index=col.index)

    return df.withColumn(name, residual(vec))


def nearest_to_centres(df: DataFrame, centres: np.ndarray, vec: str = "vec") -> DataFrame:
    """The row nearest to each centre, ties by window key."""
    shared = df.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("struct<c int, d double>")
    def nearest(col: pd.Series) -> pd.DataFrame:
        x, c = stack(col), shared.value
        d = (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None, :]
        return pd.DataFrame({"c": d.argmin(1).astype("int32"), "d": np.maximum(d.min(1), 0)}, index=col.index)

    rows = df.withColumn("_n", nearest(vec))
    pick = F.min_by(F.struct(*df.columns), F.struct(F.col("_n.d"), F.hash(*[c for c in df.columns if c != vec])))
    return rows.groupBy(F.col("_n.c").alias("cluster")).agg(pick.alias("_r")).select("cluster", "_r.*")
