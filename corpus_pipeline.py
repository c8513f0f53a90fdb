"""A training corpus in five stages: toxicity, line dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again before the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import line_runs, minmax, mixing, packing, toxicity
from rankloom.llm.common import stored
from rankloom.llm.queries import vocabulary

#: Words whose ids a Python worker keeps when packing: stages before have filled most of an executor's memory.
KEPT_WORDS = 400_000

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model, threshold=0.5).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents share go; ``n_chars`` follows the text."""
    kept = line_runs.drop_frequent_lines(docs, min_docs=10, min_chars=1)
    changed = F.col("n_dropped") > 0
    return kept.withColumn(
        "n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest ``doc_id`` stays."""
    kept = minmax.near_duplicates(docs, threshold=80, words=5).filter("kept").select("doc_id")
    ids = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"))
    same = F.col("id").eqNullSafe(F.col("doc_id"))
    return ids.join(kept, same, "left_semi").select("doc.*").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order that interleaves the sources by their target weights."""
    return mixing.in_mixed_order(docs, block_rows=64, temperature=0.5).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2,048 tokens; their ids follow the order the mixing stage wrote."""
    return packing.pack_documents(
        docs, vocabulary("word_bpe_49k.json"), capacity=2048, end_id=0, in_order=True, kept_words=KEPT_WORDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs


#: The classifier of the first stage is trained, so SQL cannot express the rows.
ORACLE_SQL = None
