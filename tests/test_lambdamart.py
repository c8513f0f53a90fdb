"""Boosted trees: learning, regularisation, categories, stopping, storage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators.histograms import newton_step
from rankloom.operators.lambdamart import LambdaMART, LambdaMARTModel, decayed_rate, feature_importance
from rankloom.operators.metrics import mean_ndcg
from rankloom.operators.trees import sum_of_trees, tree_column
from tests.conftest import only


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    data = []
    for q in range(30):
        for d in range(12):
            x = rng.normal(size=4)
            cat = float(rng.integers(0, 5))
            signal = x[0] + (1.5 if cat in (1.0, 4.0) else 0.0) + 0.3 * rng.normal()
            data.append((q, d, float(np.digitize(signal, [0.0, 1.0, 2.0])), [*map(float, x), cat]))
    return spark.createDataFrame(data, "query_id long, doc_id long, label double, features array<double>").cache()


def quality_of(model, rows):
    return only(mean_ndcg(model.transform(rows)))


@pytest.fixture(scope="module")
def model(rows):
    return LambdaMART(n_trees=8, learning_rate=0.3, checkpoint_every=3).fit(rows)


def test_training_improves_ndcg(model, rows):
    before = only(mean_ndcg(rows.withColumn("score", F.lit(0.0))))
    found = [only(mean_ndcg(model.transform(rows, n_trees=n))) for n in (1, 8)]
    assert before + 0.1 < found[0] < found[1]


def test_expression_and_batch_scores_agree(model, rows):
    expression = sum((tree_column(t, F.col("features")) for t in model.trees), F.lit(0.0))
    both = model.transform(rows).withColumn("again", expression)
    assert both.where(F.abs(F.col("score") - F.col("again")) > 1e-9).count() == 0
    matrix = np.array([r["features"] for r in rows.limit(5).collect()])
    want = [r["score"] for r in model.transform(rows.limit(5)).collect()]
    assert sum_of_trees(model.trees, matrix) == pytest.approx(want)


def test_blocks_train_the_same_trees(small_groups, model, rows):
    split = LambdaMART(n_trees=2, learning_rate=0.3, block_rows=5).fit(rows)
    a = split.transform(rows).orderBy("query_id", "doc_id").collect()
    b = model.transform(rows, n_trees=2).orderBy("query_id", "doc_id").collect()
    assert [r["score"] for r in a] == pytest.approx([r["score"] for r in b])


def test_categories_are_split_as_sets(rows):
    plain = LambdaMART(n_trees=3, max_depth=2, learning_rate=0.3)
    sets = LambdaMART(n_trees=3, max_depth=2, learning_rate=0.3, categorical=[4])
    model = sets.fit(rows)
    used = [n for tree in model.trees for n in tree if n.categories is not None]
    assert used and all(n.feature == 4 for n in used)
    assert quality_of(model, rows) >= quality_of(plain.fit(rows), rows) - 0.01


def test_regularisation_and_sampling(rows):
    trainer = LambdaMART(
        n_trees=2, max_depth=5, num_leaves=4, min_leaf_rows=40, l1=0.1, l2=1.0,
        learning_rate=decayed_rate, query_subsample=0.5, feature_subsample=0.5,
    )
    model = trainer.fit(rows)
    for tree in model.trees:
        assert sum(n.leaf >= 0 for n in tree) <= 4
        assert len({n.feature for n in tree if n.leaf < 0}) <= 2
    assert newton_step(2.0, 1.0, 0.5, 0.5) == pytest.approx(1.0)
    assert newton_step(-0.2, 1.0, 0.5, 0.0) == 0.0
    assert newton_step(0.0, 0.0, 0.0, 0.0) == 0.0
    assert [decayed_rate(i) for i in (0, 2)] == pytest.approx([0.1, 0.09025])


def test_watching_and_stopping(rows):
    train, valid = rows.where("query_id < 20"), rows.where("query_id >= 20")
    model = LambdaMART(n_trees=12, learning_rate=1.0, stop_after=2).fit(train, valid)
    scores = [entry[1] for entry in model.history]
    assert model.best_iteration == 1 + int(np.argmax(scores))
    assert len(model.trees) <= 12
    assert len(model.trees) == 12 or len(model.trees) - model.best_iteration == 2
    assert quality_of(model, valid) == pytest.approx(max(scores))


@pytest.mark.parametrize("objective", ["ranknet", "mse", "bce"])
def test_other_objectives(rows, objective):
    binary = rows.withColumn("label", (F.col("label") > 1).cast("double"))
    before = only(mean_ndcg(binary.withColumn("score", F.lit(0.0))))
    model = LambdaMART(n_trees=3, learning_rate=0.5, objective=objective).fit(binary)
    assert quality_of(model, binary) > before
    with pytest.raises(ValueError):
        LambdaMART(objective="other").fit(binary)


def test_storage_and_importance(spark, model, rows, tmp_path):
    path = str(tmp_path / "model")
    model.save(spark, path)
    model.save(spark, path)
    loaded = LambdaMARTModel.load(spark, path)
    assert loaded == model
    table = feature_importance(model, spark).orderBy("name").collect()
    assert [r["name"] for r in table] == [1, 2, 3, 4, 5]
    assert sum(r["importance"] for r in table) == sum(n.leaf < 0 for t in model.trees for n in t)
    assert table[0]["gain"] == max(r["gain"] for r in table)


def test_rounds_do_not_shuffle_the_lists_again(spark):
    """Gradients of stored lists take one pass without an exchange, over batches that cut the lists, and are those of windows."""
    from rankloom.operators.gradients import listed_gradients, pair_gradients
    from rankloom.operators.trees import Node, tree_column

    made = [(None if q == 3 else q, i, float((q * i) % 4), [float(i % 5), float(q)], i)
            for q in range(7) for i in range(1 + 3 * q)]
    df = spark.createDataFrame(made, "query_id long, doc_id long, label double, features array<double>, n long")
    tree = [Node(feature=0, threshold=1.0, left=1, right=2), Node(leaf=0, value=0.5), Node(leaf=1, value=-0.25)]
    trainer = LambdaMART()
    train, by_row, sizes, _ = trainer._prepare(df)
    assert by_row is None
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = listed_gradients(train, [tree, tree], k=5)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        got = got.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    one = tree_column(tree, F.col("bins"))
    want = pair_gradients(train.withColumn("score", F.col("score") + one + one), sizes, ["bins"], k=5).collect()

    def plain(rows):
        return sorted((tuple(r["bins"]), round(r["lambda"], 9), round(r["hessian"], 9)) for r in rows)

    assert len(got) == len(made) and plain(got) == plain(want)
