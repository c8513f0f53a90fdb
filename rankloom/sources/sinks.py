"""Writers and their readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of a ranked result file, in order.
RANKED_COLUMNS = ("label", "ctr", "cosine-score", "query", "title", "searchOrder", "newOrder")

_SOURCES = {
    "cosine-score": "cosine_score", "searchOrder": "search_order", "newOrder": "new_order",
}


def ranked_result(df: DataFrame) -> DataFrame:
    """The columns of a ranked result under their published names."""
    return df.select(*[F.col(_SOURCES.get(name, name)).alias(name) for name in RANKED_COLUMNS])


def write_ranked(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a ranked result as ``parquet`` or ``csv`` (with a header)."""
    writer = ranked_result(df).write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_training_set(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_training_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
