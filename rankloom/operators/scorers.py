"""Encoders of texts and scorers of (query, document) pairs.

Models are injected. A model is loaded once per Python worker and called on
Arrow batches; the built-in ones are Spark expressions and need no model.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.feature import IDF, HashingTF, IDFModel, Normalizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.text import pair_features, token_count, token_overlap, tokens

PairScorer = Callable[[Column, Column], Column]
ENCODE_BATCH = 4096


def lexical_score(query: Column, document: Column) -> Column:
    """Common tokens over the root of the product of the token counts."""
    product = token_count(query).cast("double") * token_count(document)
    overlap = token_overlap(query, document) / F.sqrt(F.greatest(product, F.lit(1.0)))
    return F.coalesce(overlap, F.lit(0.0))


def score_pairs(
    df: DataFrame,
    scorer: PairScorer = lexical_score,
    query: str = "query",
    document: str = "document",
    out: str = "score",
) -> DataFrame:
    """Add the score of each pair of texts."""
    return df.withColumn(out, scorer(F.col(query), F.col(document)).cast("double"))


def model_scorer(
    load: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]], batch_size: int = 64
) -> PairScorer:
    """Scorer of an injected model: ``load()`` returns f(queries, documents) -> scores."""
    return predict_batch_udf(load, return_type=T.DoubleType(), batch_size=batch_size)


def extract_features(
    df: DataFrame, keyword: str = "learning", query: str = "query", document: str = "document"
) -> DataFrame:
    """Add ``features ARRAY<INT>``: lengths, common tokens, keyword counts."""
    return df.withColumn(
        "features", F.array(*pair_features(F.col(query), F.col(document), keyword))
    )


class HashedTfIdf:
    """Encoder of texts as unit vectors of hashed, IDF-weighted token counts."""

    def __init__(self, idf: IDFModel, dims: int):
        self.idf, self.dims = idf, dims

    @staticmethod
    def _counts(df: DataFrame, dims: int) -> DataFrame:
        split = df.withColumn("_tokens", tokens(F.coalesce("text", F.lit(""))))
        return HashingTF(numFeatures=dims, inputCol="_tokens", outputCol="_tf").transform(split)

    @classmethod
    def fit(cls, documents: DataFrame, dims: int = 256) -> HashedTfIdf:
        counts = cls._counts(documents.select("text"), dims)
        return cls(IDF(inputCol="_tf", outputCol="_idf").fit(counts), dims)

    def __call__(self, df: DataFrame) -> DataFrame:
        weighted = self.idf.transform(self._counts(df, self.dims))
        unit = Normalizer(inputCol="_idf", outputCol="_unit").transform(weighted)
        embedding = vector_to_array("_unit", dtype="float32").alias("embedding")
        return unit.select(*df.columns, embedding)


def model_encoder(
    load: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = ENCODE_BATCH
) -> Callable[[DataFrame], DataFrame]:
    """Encoder of an injected model: ``load()`` returns f(texts) -> matrix."""
    encode = predict_batch_udf(
        load, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
    )
    return lambda df: df.withColumn("embedding", encode("text"))


def embed(df: DataFrame, encoder: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Add the ``embedding`` of each ``text``."""
    return encoder(df)
