"""Fusing the three path scores: Spark ML classifiers, unsupervised rules and the model registry."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqalert.operators import curves, ordering
from seqalert.scorers.frequency import IsolationForest, add_score

PATHS = ("path_a", "path_b", "path_c")


def assemble(a: DataFrame, b: DataFrame, c: DataFrame, key: Sequence[str] = ("trace_id", "w")) -> DataFrame:
    """The three scores side by side. All sides shuffle on the same key once."""
    key = list(key)
    pick = lambda d, n: d.select(*key, F.col("score").alias(n))
    return pick(a, "path_a").join(pick(b, "path_b"), key).join(pick(c, "path_c"), key)


def with_features(df: DataFrame, cols: Sequence[str] = PATHS, name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=name).transform(df)


def with_weights(df: DataFrame, y: str = "y", balanced: bool = True) -> DataFrame:
    """Row weight: ``n / (2 * class size)``, or ``benign / attack`` for the attack class alone."""
    pos, neg = F.sum(F.when(F.col(y) == 1, 1).otherwise(0)), F.sum(F.when(F.col(y) == 1, 0).otherwise(1))
    if balanced:
        w = df.agg(F.struct(((pos + neg) / (2 * F.greatest(F.lit(1), pos))).alias("p"), ((pos + neg) / (2 * F.greatest(F.lit(1), neg))).alias("n"))).scalar()
    else:
        w = df.agg(F.struct((neg / F.greatest(F.lit(1), pos)).alias("p"), F.lit(1.0).alias("n"))).scalar()
    return df.withColumn("weight", F.when(F.col(y) == 1, w.getField("p")).otherwise(w.getField("n")))


class NormalScores:
    """Maps every score column to the normal distribution through its quantile grid."""

    def __init__(self, cols: Sequence[str] = PATHS, points: int = 1000) -> None:
        self.cols, self.points = list(cols), points

    def fit(self, train: DataFrame) -> "NormalScores":
        self.grid = {c: _grid(train, c, self.points) for c in self.cols}
        return self

    def transform(self, df: DataFrame, suffix: str = "_n") -> DataFrame:
        return df.withColumns({f"{c}{suffix}": _normal_column(df, self.grid[c])(F.col(c)) for c in self.cols})


def _grid(df: DataFrame, col: str, points: int) -> np.ndarray:
    """``points`` evenly spaced exact quantiles of a column, from its table of distinct values."""
    counts = ordering.cut(df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")))
    run = ordering.prefix_sum(counts, ["v"], {"upto": "n"}, totals={"total": "n"})
    # Grid points whose rank lies at most one rank from those this value holds, upto - n to upto - 1.
    step = (F.col("total") - 1) / (points - 1)
    lo = F.when(F.col("total") > 1, F.floor((F.col("upto") - F.col("n") - 1) / step)).otherwise(0)
    hi = F.when(F.col("total") > 1, F.ceil(F.col("upto") / step)).otherwise(points - 1)
    span = F.sequence(F.greatest(F.lit(0), lo).cast("int"), F.least(F.lit(points - 1), hi).cast("int"))
    near = run.select("v", "n", "upto", "total", F.explode(span).alias("i"))
    at = F.col("i") * (F.col("total") - 1) / (points - 1)
    ends = near.groupBy("i").agg(
        F.min(F.when(F.col("upto") > F.floor(at), F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > F.ceil(at), F.col("v"))).alias("b"),
        F.max(at - F.floor(at)).alias("f"),
    )
    rows = sorted(ends.collect())
    return np.array([r["a"] + r["f"] * ((r["b"] if r["b"] is not None else r["a"]) - r["a"]) for r in rows])


def _normal_column(df: DataFrame, grid: np.ndarray):
    shared = df.sparkSession.sparkContext.broadcast(grid)

    @F.pandas_udf("double")
    def normal(col: pd.Series) -> pd.Series:
        return pd.Series(_to_normal(col.to_numpy(float), shared.value), index=col.index)

    return normal


def _to_normal(x: np.ndarray, grid: np.ndarray) -> np.ndarray:
    refs = np.linspace(0, 1, len(grid))
    # The mean of both directions puts a tie in the middle of its quantiles.
    u = 0.5 * (np.interp(x, grid, refs) - np.interp(-x, -grid[::-1], -refs[::-1]))
    return normal_quantile(np.clip(u, 1e-7, 1 - 1e-7))


# Coefficients of algorithm AS 241 (PPND16), highest power first; numerator and denominator of the middle, the
# near tail and the far tail.
_MIDDLE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
_NEAR = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
)
_FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0),
)


def normal_quantile(u: np.ndarray) -> np.ndarray:
    """Standard normal quantiles of probabilities between 0 and 1, whole arrays at a time."""
    ratio = lambda c, r: np.polyval(c[0], r) / np.polyval(c[1], r)
    q = u - 0.5
    tail = np.sqrt(-np.log(np.minimum(u, 1 - u)))
    outer = np.sign(q) * np.where(tail <= 5, ratio(_NEAR, tail - 1.6), ratio(_FAR, tail - 5))
    return np.where(np.abs(q) <= 0.425, q * ratio(_MIDDLE, 0.180625 - q * q), outer)


class _Fused:
    """A fitted classifier that adds ``prob`` (or a margin, for the linear machine)."""

    def __init__(self, name: str, model, prepare=None, margin: bool = False) -> None:
        self.name, self.model, self.prepare, self.margin = name, model, prepare, margin

    def score(self, df: DataFrame, name: str = "prob") -> DataFrame:
        rows = self.prepare(df) if self.prepare else with_features(df)
        out = self.model.transform(rows)
        col = F.element_at(vector_to_array("rawPrediction" if self.margin else "probability"), 2)
        return out.select(*df.columns, col.alias(name))


def fuse_logistic(train: DataFrame, y: str = "y") -> _Fused:
    normal = NormalScores().fit(train)

    def prepare(df: DataFrame) -> DataFrame:
        return with_features(normal.transform(df), [f"{c}_n" for c in PATHS])

    model = LogisticRegression(labelCol=y, weightCol="weight", maxIter=1000, tol=1e-6).fit(with_weights(prepare(train), y))
    return _Fused("logistic", model, prepare)


def fuse_forest(train: DataFrame, y: str = "y", seed: int = 42, trees: int = 100) -> _Fused:
    model = RandomForestClassifier(labelCol=y, weightCol="weight", numTrees=trees, maxDepth=5, seed=seed)
    return _Fused("forest", model.fit(with_weights(with_features(train), y)))


def fuse_boosted(train: DataFrame, y: str = "y", seed: int = 42, rounds: int = 20) -> _Fused:
    model = GBTClassifier(labelCol=y, weightCol="weight", maxDepth=4, maxIter=rounds, seed=seed)
    return _Fused("boosted", model.fit(with_weights(with_features(train), y, balanced=False)))


def fuse_svm(train: DataFrame, y: str = "y") -> _Fused:
    model = LinearSVC(labelCol=y, weightCol="weight", maxIter=50, standardization=True)
    return _Fused("svm", model.fit(with_weights(with_features(train), y)), margin=True)


def fuse_mlp(train: DataFrame, y: str = "y", seed: int = 42) -> _Fused:
    normal = NormalScores().fit(train)

    def prepare(df: DataFrame) -> DataFrame:
        return with_features(normal.transform(df), [f"{c}_n" for c in PATHS])

    model = MultilayerPerceptronClassifier(labelCol=y, layers=[3, 32, 16, 2], maxIter=500, tol=1e-5, seed=seed)
    return _Fused("mlp", model.fit(prepare(train)), prepare)


def fit_fusion(train: DataFrame, val: DataFrame, test: DataFrame, seed: int = 42, y: str = "y") -> tuple[dict[str, _Fused], DataFrame]:
    """All five classifiers, each with its threshold from the smoothed curve of ``val``, and their metrics on ``val`` and
    ``test`` as one table."""
    train, val, test = (ordering.cut(d.select("trace_id", "w", y, *PATHS)) for d in (train, val, test))
    fits = [fuse_logistic(train, y), fuse_forest(train, y, seed), fuse_boosted(train, y, seed), fuse_svm(train, y), fuse_mlp(train, y, seed)]
    rows = None
    for m in fits:
        on_val, on_test = ordering.cut(m.score(val)), ordering.cut(m.score(test))
        tau = float(curves.best_f1_smoothed(curves.score_table(on_val, "prob", y)).head()["tau"])
        for part, d in (("val", on_val), ("test", on_test)):
            one = d.select(F.lit(m.name).alias("model"), F.lit(part).alias("part"), F.lit(tau).alias("tau"), F.col(y).alias("y"), F.col("prob").alias("score"))
            rows = one if rows is None else rows.unionByName(one)
    key = ["model", "part"]
    curve = curves.all_metrics(curves.score_table(rows, by=key), by=key).select(*key, "auc", "ap", "fpr95")
    fixed = curves.confusion(rows, "tau", [*key, "tau"]).select(*key, "tau", "precision", "recall", "specificity", "f1", "mcc")
    return {m.name: m for m in fits}, curve.join(fixed, key)


class CdfMax:
    """Largest of the three benign distribution function values."""

    def __init__(self, points: int = 1000) -> None:
        self.points = points

    def fit(self, benign: DataFrame) -> "CdfMax":
        self.grid = {c: _grid(benign, c, self.points) for c in PATHS}
        return self

    def score(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.grid)

        @F.pandas_udf("double")
        def top(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            refs = np.linspace(0, 1, len(shared.value[PATHS[0]]))
            each = [np.interp(s.to_numpy(float), shared.value[p], refs) for p, s in zip(PATHS, (a, b, c))]
            return pd.Series(np.max(each, axis=0), index=a.index)

        return df.withColumn("score", top(*PATHS))


class Mixture:
    """Negative log density under a Gaussian mixture of benign scores."""

    def __init__(self, k: int = 3, seed: int = 42) -> None:
        self.k, self.seed = k, seed

    def fit(self, benign: DataFrame) -> "Mixture":
        model = GaussianMixture(k=self.k, seed=self.seed, maxIter=100).fit(with_features(benign))
        rows = model.gaussiansDF.collect()
        self.weights = np.array(model.weights)
        self.means = np.array([r["mean"].toArray() for r in rows])
        self.covs = np.array([r["cov"].toArray() for r in rows]) + 1e-9 * np.eye(len(PATHS))
        return self

    def score(self, df: DataFrame) -> DataFrame:
        weights, means, covs = self.weights, self.means, self.covs

        def fn(x: np.ndarray) -> np.ndarray:
            if not x.size:
                return np.empty(0)
            parts = []
            for w, m, c in zip(weights, means, covs):
                d = x - m
                q = (d @ np.linalg.inv(c) * d).sum(axis=1)
                parts.append(np.log(max(w, 1e-300)) - 0.5 * (q + np.linalg.slogdet(c)[1] + x.shape[1] * np.log(2 * np.pi)))
            top = np.max(parts, axis=0)
            return -(top + np.log(np.exp(np.array(parts) - top).sum(axis=0)))

        return add_score(df.withColumn("_z", F.array(*PATHS)), fn, "_z").drop("_z")


def score_forest(benign: DataFrame, trees: int = 100, seed: int = 42) -> IsolationForest:
    """Isolation forest on the three scores; score with ``.score(df.withColumn('vec', array(paths)))``."""
    return IsolationForest(trees, 256, seed).fit(benign.withColumn("vec", F.array(*PATHS)))


def save_models(models: dict[str, _Fused], metrics: DataFrame, path: str) -> DataFrame:
    """Write every classifier and a registry table; the best test model by AUC, then F1, is marked."""
    for name, m in models.items():
        m.model.write().overwrite().save(f"{path}/{name}")
    test = metrics.where(F.col("part") == "test")
    # One row per classifier.
    best = test.orderBy(F.desc("auc"), F.desc("f1"), F.asc("model")).limit(1).select("model").scalar()
    registry = metrics.withColumn("path", F.concat(F.lit(f"{path}/"), "model")).withColumn("best", F.col("model") == best)
    registry.write.mode("overwrite").parquet(f"{path}/registry")
    return metrics.sparkSession.read.parquet(f"{path}/registry")
