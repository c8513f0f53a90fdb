"""Text features, scalar functions, encoders and scorers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import rank_math as rm
from rankloom.functions import text as tx
from rankloom.functions.vectors import cosine
from rankloom.operators.scorers import (
    HashedTfIdf, extract_features, lexical_score, model_encoder, model_scorer, score_pairs,
)
from rankloom.sources.datasets import dataset_profile, group_sizes

# Graded sample judgments: query, document text, number of documents, (places up to, label).
SAMPLE = [
    ("machine learning algorithms", "Document about ML algorithm", 10, [(3, 3), (6, 1)]),
    ("deep learning neural networks", "Document about deep learning", 15, [(5, 3), (10, 2)]),
    ("natural language processing", "Document about NLP", 8, [(2, 3), (5, 1)]),
]


def sample_judgments(spark):
    rows = [
        (q, query, f"{doc} {i}", next((label for upto, label in steps if i < upto), 0))
        for q, (query, doc, n, steps) in enumerate(SAMPLE) for i in range(n)
    ]
    return spark.createDataFrame(rows, "query_id long, query string, document string, relevance int")


def test_sample_features(spark):
    df = extract_features(sample_judgments(spark))
    found = {(r["query_id"], tuple(r["features"])) for r in df.collect()}
    assert found == {(0, (3, 5, 0, 1, 0)), (1, (4, 5, 2, 1, 1)), (2, (3, 4, 0, 0, 0))}
    sizes = group_sizes(df).orderBy("query_id").collect()
    assert [r["size"] for r in sizes] == [10, 15, 8]
    assert tuple(dataset_profile(df).first()) == (33, 5)


@pytest.mark.parametrize("text", ["", "  ", "One  two\tONE\n", "a b c", "x\x1dy z　w", "Éa éA"])
def test_tokens_split_as_python_does(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.tokens(F.col("t"))).first()[0] == text.lower().split()


def test_keyword_and_preview(spark):
    df = spark.createDataFrame([("Learning to learn: LEARNINGlearning", "x" * 51)], "a string, b string")
    row = df.select(
        tx.keyword_count(F.col("a"), "learning"), tx.preview(F.col("b")), tx.preview(F.col("a")),
        tx.preview(F.col("a"), 80, always=True),
    ).first()
    assert tuple(row) == (3, "x" * 50 + "...", "Learning to learn: LEARNINGlearning", "Learning to learn: LEARNINGlearning...")


def test_buckets(spark):
    scores = [(-0.1, 0), (0.0, 0), (0.2, 1), (0.4, 2), (float("nan"), 2), (None, None)]
    df = spark.createDataFrame(scores, "s double, want int")
    assert all(r[0] == r[1] for r in df.select(rm.bucketize(F.col("s")), "want").collect())


def test_scalars(spark):
    df = spark.createDataFrame([(2.0, 3)], "x double, pos int")
    row = df.select(
        rm.activate(F.col("x"), "sigmoid"), rm.activate(F.col("x"), lambda c: c * 2),
        rm.gain(F.col("x")), rm.discount(F.col("pos")), rm.clamp(F.col("x"), high=1.5),
        rm.is_relevant(F.col("x")),
    ).first()
    assert tuple(row) == pytest.approx((1 / (1 + np.exp(-2)), 4.0, 3.0, 2.0, 1.5, True))


def test_cosine_of_zero_vector(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([3.0, 4.0], [6.0, 8.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]


def test_lexical_score(spark):
    df = spark.createDataFrame([("a b", "b c d e f g h i"), ("a", None), ("", "")], "query string, document string")
    got = [r["score"] for r in score_pairs(df, lexical_score).collect()]
    assert got == pytest.approx([1 / 4, 0.0, 0.0])


def test_injected_models(spark):
    def load_scorer():
        return lambda queries, documents: np.array([float(len(q) + len(d)) for q, d in zip(queries, documents)])

    def load_encoder():
        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

    df = spark.createDataFrame([("ab", "cde"), ("x", "y")], "query string, document string")
    scored = score_pairs(df, model_scorer(load_scorer, batch_size=1))
    assert [r["score"] for r in scored.collect()] == [5.0, 2.0]
    encoded = model_encoder(load_encoder)(df.withColumnRenamed("query", "text"))
    assert [r["embedding"] for r in encoded.collect()] == [[2.0, 1.0], [1.0, 1.0]]


def test_hashed_encoder(spark):
    docs = spark.createDataFrame([(1, "red green"), (2, "green blue"), (3, None)], "doc_id long, text string")
    encoder = HashedTfIdf.fit(docs, dims=64)
    vectors = {r["doc_id"]: np.array(r["embedding"]) for r in encoder(docs).collect()}
    assert all(v.shape == (64,) for v in vectors.values())
    assert np.linalg.norm(vectors[1]) == pytest.approx(1.0, abs=1e-6)
    assert np.linalg.norm(vectors[3]) == 0.0
    assert 0.0 < vectors[1] @ vectors[2] < 1.0
