"""A corpus table with embeddings: build, append, clear."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankloom.schema import require_columns

Encoder = Callable[[DataFrame], DataFrame]


def build_corpus(documents: DataFrame, encoder: Encoder) -> DataFrame:
    """Embed (doc_id, text); ``encoder`` adds the ``embedding`` column."""
    return encoder(require_columns(documents, "doc_id", "text"))


def append_corpus(corpus: DataFrame, new: DataFrame, encoder: Encoder) -> DataFrame:
    """Embed only the new documents and put them under the old ones."""
    return corpus.unionByName(build_corpus(new, encoder).select(*corpus.columns))


def write_corpus(corpus: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the corpus; ``mode="append"`` adds to the stored one."""
    corpus.write.mode(mode).parquet(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def clear_corpus(spark: SparkSession, path: str) -> None:
    """Leave an empty corpus of the same schema."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
