"""Second-order trees on bins against a plain grower, bins against quantiles, the ML stage."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from rankloom.operators import histograms as hist
from rankloom.operators.histograms import Binning, Rules, grow_tree, newton_step
from rankloom.operators.lambdamart import LambdaMART
from rankloom.operators.ranker import LambdaMARTRanker
from rankloom.operators.trees import sum_of_trees, tree_column
from tests.conftest import SMALL

SCHEMA = "row long, features array<double>, lambda double, hessian double"


def sample(n=900, seed=5):
    """Rows whose gradients follow a lopsided rule, with ties and missing values."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([
        rng.integers(0, 40, n), np.clip(np.round(rng.normal(size=n), 1), -1.5, 1.5), rng.integers(0, 6, n), rng.integers(0, 2, n)]).astype(float)
    x[rng.random(n) < 0.05, 1] = np.nan
    pull = np.where(x[:, 0] < 5, np.exp(-x[:, 0]) * 9, 0.2 * np.nan_to_num(x[:, 1])) + np.where(np.isin(x[:, 2], [1, 4]), 0.7, 0)
    g = np.round(pull + 0.1 * rng.normal(size=n) - 0.4, 3)
    return x, g, np.round(rng.uniform(0.1, 1.0, n), 3)


def table(spark, x, g, h):
    rows = [(i, [None if math.isnan(v) else float(v) for v in row], float(a), float(b)) for i, (row, a, b) in enumerate(zip(x, g, h))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain_tree(x, g, h, rules, categorical=()):
    """Best-first growth, one leaf after the other, by looking at every split of every leaf: {path: (feature, left rows)}."""
    unit = hist.GAIN_STEP * len(g)

    def score(rows):
        shrunk = max(abs(g[rows].sum()) - rules.l1, 0.0)
        return shrunk**2 / (h[rows].sum() + rules.l2) if len(rows) else 0.0

    def best(rows, depth):
        if rules.max_depth is not None and depth >= rules.max_depth:
            return None
        found = []
        for f in range(x.shape[1]):
            values = x[rows, f]
            if f in categorical:
                ratio = {c: round(g[rows][values == c].sum() / (h[rows][values == c].sum() + rules.l2), 9) for c in np.unique(values)}
                order = sorted(ratio, key=lambda c: (ratio[c], c))
                cuts = [(k, np.isin(values, order[:k + 1])) for k in range(len(order))]
            else:
                cuts = [(v, values <= v) for v in np.unique(values[~np.isnan(values)])]
            for at, left in cuts:
                a, b = rows[left], rows[~left]
                if min(len(a), len(b)) < max(rules.min_leaf_rows, 1):
                    continue
                gain = score(a) + score(b) - score(rows)
                if gain > rules.min_gain and round(gain / unit) >= 1:
                    found.append((-round(gain / unit), f, at, a, b))
        return min(found, key=lambda s: s[:3], default=None)

    every = np.arange(len(g))
    leaves, splits = {"": (every, best(every, 0))}, {}
    while len(leaves) < rules.num_leaves:
        able = {p: s for p, (_, s) in leaves.items() if s is not None}
        if not able:
            break
        path = min(able, key=lambda p: (able[p][0], len(p), p))
        _, feature, _, a, b = able[path]
        splits[path] = (feature, frozenset(a.tolist()))
        del leaves[path]
        for side, rows in (("L", a), ("R", b)):
            leaves[path + side] = rows, best(rows, len(path) + 1)
    values = {p: newton_step(g[rows].sum(), h[rows].sum(), rules.l1, rules.l2) for p, (rows, _) in leaves.items()}
    return splits, values


def as_paths(nodes, x):
    """The same form for a grown tree."""
    splits, values = {}, {}

    def visit(at, path, rows):
        node = nodes[at]
        if node.leaf >= 0:
            values[path] = node.value
            return
        v = x[rows, node.feature]
        left = np.isin(v, node.categories) if node.categories is not None else v <= node.threshold
        splits[path] = (node.feature, frozenset(rows[left].tolist()))
        visit(node.left, path + "L", rows[left])
        visit(node.right, path + "R", rows[~left])

    visit(0, "", np.arange(len(x)))
    return splits, values


@pytest.mark.parametrize("on_driver", [True, False])
@pytest.mark.parametrize("rules, categorical", [
    (Rules(10), ()), (Rules(31, min_leaf_rows=5, l2=0.5), ()), (Rules(8, max_depth=3), (2,)),
    (Rules(6, min_leaf_hessian=20.0, min_gain=0.5, l1=1.5), (2, 0)),
])
def test_trees_equal_best_first_growth(spark, monkeypatch, on_driver, rules, categorical):
    if not on_driver:
        monkeypatch.setattr(hist, "DRIVER_CELLS", 0)
    x, g, h = sample()
    rows = table(spark, x, g, h)
    binning = Binning.fit(rows, 255, categorical, 4)
    binned = binning.assign(rows).select("row", "bins", "lambda", "hessian").cache()
    raw, on_bins = grow_tree(binned, binning, rules, len(g))
    if rules.min_leaf_hessian:  # the plain grower does not know this bound
        assert all(
            h[list(rows)].sum() >= rules.min_leaf_hessian for _, rows in as_paths(raw, x)[0].values())
        assert sum(n.leaf >= 0 for n in raw) <= rules.num_leaves
    else:
        splits, values = plain_tree(x, g, h, rules, categorical)
        got, leaves = as_paths(raw, x)
        assert got == splits
        assert leaves == pytest.approx(values)
        if rules.max_depth is None:
            assert len(leaves) == rules.num_leaves
            depths = {len(p) for p in leaves}
            assert max(depths) - min(depths) >= 2
    scored = rows.join(binned.select("row", "bins"), "row").select(
        "row", tree_column(raw, F.col("features")).alias("raw"), tree_column(on_bins, F.col("bins")).alias("binned"))
    found = {r["row"]: (r["raw"], r["binned"]) for r in scored.collect()}
    want = sum_of_trees([raw], x)
    for i in range(len(g)):
        assert found[i] == pytest.approx((want[i], want[i]))


def test_leaves_without_any_split(spark):
    x = np.ones((5, 2))
    rows = table(spark, x, np.ones(5), np.ones(5))
    binning = Binning.fit(rows, 16, (), 2)
    raw, _ = grow_tree(binning.assign(rows), binning, Rules(31), 5)
    assert len(raw) == 1 and raw[0].leaf == 0


def test_bins_hold_the_values_up_to_their_edge(spark):
    x, g, h = sample()
    rows = table(spark, x, g, h)
    binning = Binning.fit(rows, 64, [2], 4)
    got = {r["row"]: r["bins"] for r in binning.assign(rows).select("row", "bins").collect()}
    for i in range(len(g)):
        for f in (0, 1, 3):
            edges = binning.edges[f]
            want = len(edges) + 1 if math.isnan(x[i, f]) else np.searchsorted(edges, x[i, f], side="left")
            assert got[i][f] == want
        assert got[i][2] == x[i, 2]
    assert binning.categories == {2: 6}
    fresh = spark.createDataFrame([(0, [1e9, -1e9, 17.0], 0.0, 0.0), (1, [None, math.nan, -1.0, 0.0], 0.0, 0.0)], SCHEMA)
    top, low = (r["bins"] for r in binning.assign(fresh).orderBy("row").collect())
    assert top == [len(binning.edges[0]), 0, 6, len(binning.edges[3]) + 1]
    assert low == [len(binning.edges[0]) + 1, len(binning.edges[1]) + 1, 6, 0]


@pytest.mark.parametrize("max_bins", [16, 512])
def test_edges_are_quantiles(spark, max_bins):
    """The rank of each edge is within the stated error of SQL's quantile."""
    values = spark.read.parquet(f"{SMALL}/events.parquet").select(F.array("value").alias("features"))
    edges = Binning.fit(values, max_bins).edges[0]
    ranks = duckdb.sql(f"select list(value order by value) from '{SMALL}/events.parquet'").fetchall()[0][0]
    for i in range(1, max_bins):
        error = 1 / max_bins / hist.SKETCH_STEPS + 1 / len(ranks)
        low, high = (np.quantile(ranks, q, method=m) for q, m in (
            (max(i / max_bins - error, 0), "lower"), (min(i / max_bins + error, 1), "higher")))
        assert any(low <= e <= high for e in edges) or high == max(ranks)


def test_trees_are_watched_at_several_cutoffs(spark):
    x, _, _ = sample(240)
    rows = spark.createDataFrame(
        [(i % 20, i, float(x[i, 0] < 9) + float(x[i, 3]), [float(v) for v in np.nan_to_num(x[i])]) for i in range(240)],
        "query_id long, doc_id long, label double, features array<double>")
    model = LambdaMART(n_trees=3, learning_rate=0.5, eval_at=[1, 3]).fit(rows, rows)
    assert model.history_table(spark).columns == ["round", "ndcg_at_1", "ndcg_at_3"]
    assert model.history[-1][2] > 0.9


@pytest.fixture(scope="module")
def judged(spark):
    x, _, _ = sample(300)
    return spark.createDataFrame(
        [(i % 15, i, float(x[i, 0] < 9) + float(x[i, 3]), *[float(v) for v in np.nan_to_num(x[i])], i % 3 == 0) for i in range(300)],
        "query_id long, doc_id long, label double, a double, b double, c double, d double, held boolean").cache()


def test_pipeline_is_stored_and_loaded(spark, judged, tmp_path):
    ranker = LambdaMARTRanker(
        nTrees=3, numLeaves=6, minLeafRows=5, learningRate=0.3, featuresCol="vector", predictionCol="rank_score",
        validationCol="held", evalAt=[1, 3], categorical=[2])
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=list("abcd"), outputCol="vector"), ranker])
    pipeline.write().overwrite().save(str(tmp_path / "pipeline"))
    again = Pipeline.load(str(tmp_path / "pipeline")).getStages()[1]
    assert again.extractParamMap().values() and again.getOrDefault("numLeaves") == 6
    model = pipeline.fit(judged)
    model.write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    assert loaded.stages[1].uid == model.stages[1].uid
    assert loaded.stages[1].trees == model.stages[1].trees
    assert loaded.stages[1].trees.cutoffs == [1, 3]
    a, b = ({r["doc_id"]: r["rank_score"] for r in m.transform(judged).collect()} for m in (model, loaded))
    assert a == b and len(set(a.values())) > 3
    assert ranker.copy({ranker.nTrees: 1}).getOrDefault("nTrees") == 1
