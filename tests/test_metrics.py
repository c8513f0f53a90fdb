"""Golden values of the ranking metrics and properties that hold for any list."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.operators import metrics
from tests.conftest import only, ranked_lists, values

LIST = [3, 2, 3, 0, 1, 2, 1]


def test_dcg_and_ndcg(spark):
    df = ranked_lists(spark, LIST)
    assert values(metrics.dcg(df, 5), "dcg_at_5") == pytest.approx([12.779642067948913])
    assert values(metrics.ndcg(df, 5), "ndcg_at_5") == pytest.approx([0.8755943764161996])
    cut = metrics.ndcg(df, 5, ideal="truncated")
    assert values(cut, "ndcg_at_5") == pytest.approx([0.9574784666412693])
    assert values(metrics.ndcg(df), "ndcg") == pytest.approx([0.9485004222382706])
    assert values(metrics.ndcg_random(df, 5), "ndcg_random") == pytest.approx([0.6348980960372135])
    for ideal in ("full", "truncated"):
        both = metrics.ndcg(df, [3, None], ideal=ideal)
        assert values(both, "ndcg_at_3") == pytest.approx([0.9594535145926796])
        assert values(both, "ndcg") == pytest.approx([0.9485004222382706])


def test_reciprocal_rank(spark):
    df = ranked_lists(spark, [0, 0, 1, 0, 1], [1, 0, 0, 0], [0, 0, 0, 1])
    assert values(metrics.reciprocal_rank(df), "rr") == pytest.approx([1 / 3, 1, 1 / 4])
    assert only(metrics.mrr(df)) == pytest.approx(0.5277777777777778)
    assert values(metrics.reciprocal_rank(df, k=3), "rr") == pytest.approx([1 / 3, 1, 0])


def test_average_precision(spark):
    df = ranked_lists(spark, [1, 0, 1, 0, 1], [0, 1, 1, 0], [1, 1, 0, 1])
    golden = [0.7555555555555555, 0.5833333333333333, 0.9166666666666666]
    assert values(metrics.average_precision(df), "ap") == pytest.approx(golden)
    assert only(metrics.map_score(df)) == pytest.approx(0.7518518518518519)
    cut = metrics.average_precision(df, 2)
    assert values(cut, "ap") == pytest.approx([1.0, 0.5, 1.0])
    whole = metrics.average_precision(df, 2, denominator="all_relevant")
    assert values(whole, "ap") == pytest.approx([1 / 3, 0.25, 2 / 3])


def test_edges(spark):
    df = ranked_lists(spark, [0, 0])
    assert values(metrics.ndcg(df, 5), "ndcg_at_5") == [0.0]
    assert values(metrics.reciprocal_rank(df), "rr") == [0.0]
    assert values(metrics.average_precision(df), "ap") == [0.0]
    some = ranked_lists(spark, [1, 2])
    assert values(metrics.ndcg(some, 0), "ndcg_at_0") == [0.0]
    assert values(metrics.average_precision(some, 0), "ap") == [0.0]
    # Labels that sum to 0 score 0, even with a hit among them.
    assert values(metrics.average_precision(ranked_lists(spark, [1, -1])), "ap") == [0.0]
    none = df.limit(0)
    assert only(metrics.mrr(none)) == 0.0
    assert only(metrics.map_score(none)) == 0.0


def test_precision_and_recall(spark):
    df = ranked_lists(spark, [1, 0, 1, 1], [0, 0])
    assert values(metrics.precision_at(df, 2), "precision") == [0.5, 0.0]
    assert values(metrics.recall_at(df, 2), "recall") == pytest.approx([1 / 3, 0.0])


def test_precision_above_mean(spark):
    df = spark.createDataFrame(
        [(1, i, s) for i, s in enumerate([5.0, 1.0, 1.0, 1.0])], "query_id long, doc_id long, score double"
    )
    assert values(metrics.precision_above_mean(df), "precision_above_mean") == [0.25]


def test_reranking_counts_positives_that_were_not_found(spark):
    rows = [(1, 10, 1, 0, 0.1, 2), (1, 11, 2, 1, 0.9, 2)]
    df = spark.createDataFrame(
        rows, "query_id long, doc_id long, pos int, label int, cross_score double, n_positives long"
    )
    report = {(r["evaluator"], r["metric"]): r["value"] for r in metrics.evaluate_reranking(df, 10).collect()}
    assert report["base", "map"] == pytest.approx(0.25)
    assert report["reranked", "map"] == pytest.approx(0.5)
    assert report["base", "mrr@10"] == 0.5 and report["reranked", "mrr@10"] == 1.0
    ideal = 1 + 1 / 1.584962500721156
    assert report["reranked", "ndcg@10"] == pytest.approx(1 / ideal)


def test_best_iteration_takes_the_first_of_equals(spark):
    history = spark.createDataFrame([(1, 0.2), (2, 0.5), (3, 0.5)], "round int, ndcg double")
    assert tuple(metrics.best_iteration(history, "ndcg").first()) == (2, 0.5)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=12), min_size=1, max_size=4))
def test_ndcg_properties(spark, lists):
    df = ranked_lists(spark, *lists)
    found = values(metrics.ndcg(df, 5), "ndcg_at_5")
    assert all(0.0 <= v <= 1.0 + 1e-12 for v in found)
    ideal = df.withColumn("score", F.col("label"))
    assert values(metrics.ndcg(ideal, 5), "ndcg_at_5") == pytest.approx(
        [1.0 if any(labels) else 0.0 for labels in lists]
    )
    shuffled = df.orderBy(F.rand(3)).repartition(3)
    assert values(metrics.ndcg(shuffled, 5), "ndcg_at_5") == pytest.approx(found)
