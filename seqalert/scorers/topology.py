"""Structure-sensitive scorers: reconstruction of windows of token embeddings, and any outside model."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from seqalert.operators import features, ordering


class EmbeddingError:
    """Residual of a window, written as the row of its tokens' learned vectors, outside its first components. The vectors are
    trained over ``partitions`` parts of the windows at once; there is one per distinct call of the ABI."""

    def __init__(self, dim: int = 8, n: int = 12, seed: int = 42, partitions: int = 8) -> None:
        self.dim, self.n, self.seed, self.partitions = dim, n, seed, partitions

    def fit(self, train: DataFrame) -> "EmbeddingError":
        words = ordering.cut(train.select(F.transform("win", lambda t: t.cast("string")).alias("words")))
        parts = {"numPartitions": self.partitions, "maxIter": 2}
        model = Word2Vec(vectorSize=self.dim, minCount=1, seed=self.seed, inputCol="words", outputCol="v", **parts).fit(words)
        table = sorted((int(r["word"]), r["vector"].toArray()) for r in model.getVectors().collect())
        # Tokens without a vector stand at zero, behind the last row.
        self.tokens = np.array([t for t, _ in table], dtype=int)
        self.vectors = np.vstack([*[v for _, v in table], np.zeros(self.dim)])
        tokens, vectors = self.tokens, self.vectors
        self.projection = features.pca(train, self.n, "win", lambda wins: [_embedded(wins, tokens, vectors)])
        return self

    def score(self, windows: DataFrame) -> DataFrame:
        """Add ``score``; a window's vectors stay inside its task."""
        shared = windows.sparkSession.sparkContext.broadcast((self.tokens, self.vectors, self.projection))

        @F.pandas_udf("double")
        def error(col: pd.Series) -> pd.Series:
            if not len(col):
                return pd.Series([], dtype="float64")
            tokens, vectors, projection = shared.value
            return pd.Series(projection.residual(_embedded(col, tokens, vectors)), index=col.index)

        return windows.withColumn("score", error("win"))


def _embedded(wins: pd.Series, tokens: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    if not len(wins):
        return np.empty((0, 0))
    x = np.array(wins.tolist(), dtype=int)
    at = np.minimum(np.searchsorted(tokens, x), len(tokens) - 1)
    at = np.where(tokens[at] == x, at, len(tokens))
    return vectors[at].reshape(len(x), -1)


def batch_score(df: DataFrame, make_predict_fn: Callable, w: int = 20, batch: int = 1024, col: str = "win", name: str = "score") -> DataFrame:
    """Score windows of ``w`` tokens with an outside model: ``make_predict_fn`` loads it once per Python worker and returns a
    function from a batch matrix to one value per row."""
    udf = predict_batch_udf(make_predict_fn, return_type=DoubleType(), batch_size=batch, input_tensor_shapes=[[w]])
    return df.withColumn(name, udf(F.col(col).cast("array<double>")))
