"""The inverted file: exact certified search, splits, pruned reads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import inverted_file as inv
from rankloom.operators.inverted_file import InvertedFile
from rankloom.operators.mining import mine_hard_negatives
from rankloom.operators.retrieval import retrieve

KINDS = "embedding array<double>"


def clustered(n=600, dims=8, seed=3):
    """Vectors around a few directions, a third of them copies of one, and some without a direction."""
    rng = np.random.default_rng(seed)
    around = rng.normal(size=(12, dims))
    vectors = around[rng.integers(0, 12, n)] + 0.15 * rng.normal(size=(n, dims))
    vectors[: n // 3] = vectors[0]
    vectors[n // 3: n // 3 + 3] = 0
    vectors[n // 3 + 3, 0] = np.nan
    return vectors


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(clustered())]
    return spark.createDataFrame([*rows, (9999, None)], f"doc_id long, {KINDS}").repartition(3).cache()


@pytest.fixture(scope="module")
def queries(spark):
    vectors = clustered(seed=4)[::25]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame([*rows, (500, [0.0] * 8), (501, None)], f"query_id long, {KINDS}").cache()


def rows_of(df):
    return sorted(tuple(r) for r in df.select("query_id", "doc_id", "bi_score", F.col("stage1_rank").cast("long")).collect())


@pytest.fixture(scope="module")
def index(corpus, tmp_path_factory):
    return InvertedFile.build(corpus, str(tmp_path_factory.mktemp("ivf") / "corpus"), n_cells=12)


@pytest.mark.parametrize("k", [1, 7, 300, 1000])
def test_certified_search_is_exact(corpus, queries, index, k):
    assert rows_of(index.search(queries, k)) == rows_of(retrieve(queries, corpus, k))


def test_certified_search_reads_less(queries, index):
    index.search(queries, 3)
    assert index.cells_asked(queries.count()) < 0.5


def test_probes_bound_the_search(corpus, queries, index):
    found, exact = rows_of(index.search(queries, 5, n_probe=1)), rows_of(retrieve(queries, corpus, 5))
    assert index.asked[0][0] <= queries.count()
    assert len(set(found) & set(exact)) / len(exact) > 0.7


def test_overfull_cells_are_split(corpus, queries, monkeypatch, tmp_path):
    """Few cells at first, small bounds: cells are split, copies are cut into blocks, queries into parts."""
    monkeypatch.setattr(inv, "BLOCK_ROWS", 20)
    monkeypatch.setattr(inv, "BLOCK_QUERIES", 3)
    index = InvertedFile.build(corpus, str(tmp_path / "c"), n_cells=2, cell_rows=20)
    assert len(index.centres) > 10 and index.counts.sum() + index.nowhere == 600
    big = index.counts > 20
    assert (index.radii[big] < 1e-3).all()
    unit = np.nan_to_num(clustered())
    stored = {r["doc_id"]: r["cell"] for r in index.corpus(corpus.sparkSession).collect()}
    for i, v in enumerate(unit[205:], 205):
        cosine = v @ index.centres[stored[i]] / np.linalg.norm(v)
        assert np.arccos(np.clip(cosine, -1, 1)) <= index.radii[stored[i]] + inv.SLACK
    assert rows_of(index.search(queries, 9)) == rows_of(retrieve(queries, corpus, 9))


def test_only_asked_partitions_are_read(spark, queries, index):
    asking = index._asking(queries.withColumn("worst", F.lit(None).cast("double")).where("embedding is not null"), 0, 1)
    counts = {r["cell"]: r["n"] for r in asking.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = dict(list(counts.items())[:2])
    plan = index._met(spark, asking, some, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and f"cell#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "FlatMapCoGroupsInArrow" in plan
    files = index.corpus(spark, list(some)).select(F.input_file_name()).distinct().collect()
    assert {int(r[0].split("cell=")[1].split("/")[0]) for r in files} == set(some)


def test_mining_through_the_index(corpus, queries, index):
    pairs = retrieve(queries, corpus, 2).select("query_id", "doc_id")
    options = dict(num_negatives=4, range_min=1, range_max=40, absolute_margin=0.01)
    known = corpus.where("embedding is not null")
    asked = queries.where("embedding is not null")
    plain = mine_hard_negatives(pairs, asked, known, **options).collect()
    by_index = mine_hard_negatives(pairs, asked, known, index=index, **options).collect()
    assert sorted(map(str, by_index)) == sorted(map(str, plain)) and plain


def test_empty_sides(spark, index, corpus, tmp_path):
    none = spark.createDataFrame([], f"query_id long, {KINDS}")
    assert index.search(none, 5).collect() == []
    assert rows_of(index.search(spark.createDataFrame([(1, [1.0] * 8)], f"query_id long, {KINDS}"), 0)) == []
