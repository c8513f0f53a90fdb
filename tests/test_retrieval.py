"""Retrieval against brute force, re-ranking rules, approximate search, mining."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import mining, retrieval
from rankloom.operators.cells import HyperplaneCells, KMeansCells, recall
from rankloom.operators.scorers import lexical_score

RNG = np.random.default_rng(7)
DOCS = RNG.normal(size=(300, 8)).round(2)
DOCS[50:90] = DOCS[50]  # copies tie
DOCS[3] = 0.0
ASKED = RNG.normal(size=(9, 8)).round(2)
ASKED[4] = 0.0


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, f"text {i % 5} word{i}", [float(x) for x in v]) for i, v in enumerate(DOCS)]
    return spark.createDataFrame(rows, "doc_id long, text string, embedding array<float>").repartition(5)


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(i, f"text {i % 5}", [float(x) for x in v]) for i, v in enumerate(ASKED)]
    return spark.createDataFrame(rows, "query_id long, text string, embedding array<float>")


def unit(m):
    m = m.astype(np.float32).astype(np.float64)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms > 0, norms, 1.0)


SCORES = np.round(unit(ASKED) @ unit(DOCS).T, 12)


def brute(k):
    return {
        (q, int(d)): place + 1
        for q in range(len(ASKED))
        for place, d in enumerate(np.lexsort((np.arange(len(DOCS)), -SCORES[q]))[:k])
    }


def ranks(df):
    return {(r["query_id"], r["doc_id"]): r["stage1_rank"] for r in df.collect()}


@pytest.mark.parametrize("k", [1, 20, 70, 300])
def test_exact_top_k(queries, corpus, k):
    assert ranks(retrieval.retrieve(queries, corpus, k)) == brute(k)


def test_slabs_merges_and_query_blocks(queries, corpus, monkeypatch):
    monkeypatch.setattr(retrieval, "SCORES_AT_ONCE", 90)
    monkeypatch.setattr(retrieval.BestRows, "MERGE_AT", 50)
    monkeypatch.setattr(retrieval, "BROADCAST_BLOCKS", 16)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK_BYTES", 8 * 8 * 3)
    assert ranks(retrieval.retrieve(queries, corpus, 20)) == brute(20)


def test_more_queries_than_may_be_sent(queries, corpus, monkeypatch):
    few = HyperplaneCells(8, 5, 1)
    near = ranks(retrieval.retrieve(queries, corpus, 10, few))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK_BYTES", 8 * 8 * 3)
    monkeypatch.setattr(retrieval, "BROADCAST_BLOCKS", 2)
    monkeypatch.setattr(retrieval, "CORPUS_BLOCK_ROWS", 70)
    assert ranks(retrieval.retrieve(queries, corpus, 20)) == brute(20)
    assert ranks(retrieval.retrieve(queries, corpus, 10, few)) == near
    assert retrieval.cosine_scores(queries, corpus).count() == SCORES.size
    assert retrieval.retrieve(queries, corpus, 0).count() == 0


def test_all_scores(queries, corpus):
    rows = retrieval.cosine_scores(queries, corpus).collect()
    assert len(rows) == SCORES.size
    for r in rows:
        assert r["bi_score"] == pytest.approx(SCORES[r["query_id"], r["doc_id"]], abs=1e-11)


def test_nothing_asked(queries, corpus):
    assert retrieval.retrieve(queries.limit(0), corpus, 5).count() == 0
    assert retrieval.retrieve(queries, corpus, 0).count() == 0
    assert retrieval.retrieve(queries, corpus.limit(0), 5).count() == 0


def test_rerank(spark):
    rows = [(1, d, "a b", text, d) for d, text in enumerate(["x", "a", "y", "a b", "a"], start=1)]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, query string, document string, stage1_rank int")
    order = lambda k: [
        r["doc_id"] for r in retrieval.rerank(df, lexical_score, k).orderBy("final_rank").collect()
    ]
    assert order(None) == [4, 2, 5, 1, 3]
    assert order(2) == [4, 2]
    assert order(0) == []


def test_two_stage(queries, corpus):
    found = retrieval.two_stage(queries, corpus, lexical_score, initial_k=10, final_k=3)
    rows = found.orderBy("query_id", "final_rank").collect()
    assert len(rows) == 3 * len(ASKED)
    stage1 = brute(10)
    for r in rows:
        assert stage1[r["query_id"], r["doc_id"]] == r["stage1_rank"]
    for a, b in zip(rows, rows[1:]):
        if a["query_id"] == b["query_id"]:
            assert (-a["cross_score"], a["stage1_rank"]) < (-b["cross_score"], b["stage1_rank"])


def test_large_candidate_sets_are_joined_without_broadcast(queries, corpus, monkeypatch):
    want = retrieval.two_stage(queries, corpus, lexical_score, 10, 3).collect()
    monkeypatch.setattr("rankloom.operators.pairs.BROADCAST_ROWS", 0)
    got = retrieval.two_stage(queries, corpus, lexical_score, 10, 3).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


@pytest.mark.parametrize("kind", ["kmeans", "hyperplanes"])
def test_approximate_search(spark, queries, corpus, tmp_path, kind):
    exact = retrieval.retrieve(queries, corpus, 10)
    if kind == "kmeans":
        few, every = KMeansCells.fit(corpus, 8, 3), KMeansCells.fit(corpus, 8, 8)
    else:
        few, every = HyperplaneCells(8, 5, 1), HyperplaneCells(8, 5, 5)
    shares = recall(retrieval.retrieve(queries, corpus, 10, few), exact)
    assert 0.2 < shares.agg(F.avg("recall")).first()[0] <= 1.0
    # Probing every cell is exact.
    assert ranks(retrieval.retrieve(queries, corpus, 10, every)) == brute(10)
    # A corpus stored by cell is read without the cells that nobody asks for.
    path = str(tmp_path / kind)
    few.assign(corpus).write.partitionBy("cell").parquet(path)
    stored = spark.read.parquet(path)
    found = retrieval.retrieve(queries, stored, 10, few)
    assert ranks(found) == ranks(retrieval.retrieve(queries, corpus, 10, few))
    assert "PartitionFilters: [isnotnull(cell" in found._jdf.queryExecution().toString() or \
        "PartitionFilters: [cell" in found._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def positives(spark):
    rows = [(q, d) for q in range(len(ASKED)) for d in range(q, len(DOCS), 17)]
    return spark.createDataFrame(rows, "query_id long, doc_id long")


def brute_mined(positives, n, low, high, margin):
    own = {}
    for q, d in positives:
        own.setdefault(q, set()).add(d)
    found = {}
    for (q, d), place in brute(high).items():
        found.setdefault(q, []).append((place, d))
    out = {}
    for q, p in positives:
        fit = [
            d for place, d in sorted(found[q])
            if place > low and d not in own[q] and (margin is None or SCORES[q, d] <= SCORES[q, p] - margin)
        ]
        out[q, p] = fit[:n]
    return {key: negatives for key, negatives in out.items() if negatives}


@pytest.mark.parametrize("n,low,high,margin", [(5, 0, 100, 0.0), (3, 10, 60, 0.05), (4, 0, 30, None)])
@pytest.mark.parametrize("broadcast", [True, False])
def test_mined_negatives(queries, corpus, positives, n, low, high, margin, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(mining, "BROADCAST_BYTES", 0)
    mined = mining.mine_hard_negatives(
        positives, queries, corpus, n, range_min=low, range_max=high, absolute_margin=margin
    )
    got = {}
    for r in mined.orderBy("query_id", "doc_id", "place").collect():
        got.setdefault((r["query_id"], r["doc_id"]), []).append(r["negative_id"])
    pairs = [tuple(r) for r in positives.collect()]
    assert got == brute_mined(pairs, n, low, high, margin)


def test_random_and_inclusive_mining(queries, corpus, positives):
    options = dict(num_negatives=3, range_max=40, sampling="random")
    first = mining.mine_hard_negatives(positives, queries, corpus, seed=1, **options).collect()
    again = mining.mine_hard_negatives(positives, queries, corpus, seed=1, **options).collect()
    other = mining.mine_hard_negatives(positives, queries, corpus, seed=2, **options).collect()
    assert sorted(first) == sorted(again) != sorted(other)
    assert all(r["negative_rank"] <= 40 for r in first)
    whole = mining.mine_hard_negatives(positives, queries, corpus, 30, range_max=100, include_positives=True)
    assert whole.groupBy("query_id", "doc_id").count().where(F.col("count") != 30).count() == 0
    with pytest.raises(ValueError):
        mining.mine_hard_negatives(positives, queries, corpus, range_max=9, sampling="best")


def test_shapes(queries, corpus, positives):
    mined = mining.mine_hard_negatives(positives, queries, corpus, 5, range_max=100, absolute_margin=0.2).cache()
    rows = mined.count()
    complete = mined.where(F.col("place") == 5).count()
    pairs = positives.count()
    assert mined.where(F.col("place") == 1).count() < pairs
    assert mining.shape_negatives(mined, "triplet").count() == rows
    labels = mining.shape_negatives(mined, "labeled-pair", pairs=positives).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in labels} == {1: pairs, 0: rows}
    tuples = mining.shape_negatives(mined, "n-tuple")
    assert tuples.count() == complete and tuples.where(F.size("negatives") != 5).count() == 0
    lists = mining.shape_negatives(mined, "labeled-list", pairs=positives)
    assert lists.count() == pairs
    assert lists.where(F.size("docs") != F.size("labels")).count() == 0
    counted = mining.short_tuples(mined, positives).first()
    assert tuple(counted) == (positives.count(), positives.count() - complete)
    with pytest.raises(ValueError):
        mining.shape_negatives(mined, "wide")
    with pytest.raises(ValueError):
        mining.shape_negatives(mined, "labeled-pair")


def test_vectors_that_are_not_finite_score_zero(spark):
    from rankloom.functions.vectors import cosine
    from rankloom.operators.retrieval import retrieve

    bad = [[float("nan"), 1.0], [float("inf"), 1.0], [0.0, 0.0], [1.0, 2.0]]
    docs = spark.createDataFrame(list(enumerate(bad)), "doc_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<double>")
    got = {r["doc_id"]: r["bi_score"] for r in retrieve(asked, docs, 4).collect()}
    pairs = asked.select(F.col("embedding").alias("q")).join(docs)
    assert got == {0: 0, 1: 0, 2: 0, 3: 1}
    assert {r["doc_id"]: r["c"] for r in pairs.select("doc_id", cosine(F.col("q"), F.col("embedding")).alias("c")).collect()} == got
