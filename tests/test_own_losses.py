"""Schemes and activations of the caller's own, hard negatives, batches of distinct texts."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import dual
from rankloom.operators import losses
from rankloom.sources.datasets import batches_without_duplicates
from tests.conftest import only


def test_schemes_of_the_callers_own(toy):
    named = only(losses.lambda_loss(toy, "lambdarank"))

    def swap(gain_i, gain_j, rank_i, rank_j):
        return np.abs(1 / np.log2(1 + rank_i) - 1 / np.log2(1 + rank_j)) * np.abs(gain_i - gain_j)

    assert only(losses.lambda_loss(toy, swap)) == pytest.approx(named)
    every = losses.Scheme(losses.SCHEMES["ndcg1"].weigh, every_pair=True)
    assert only(losses.lambda_loss(toy, every)) == pytest.approx(only(losses.lambda_loss(toy, "ndcg1")))
    losses.register_scheme("of a test", swap)
    try:
        assert only(losses.lambda_loss(toy, "of a test")) == pytest.approx(named)
        with pytest.raises(ValueError):
            losses.register_scheme("of a test", swap)
    finally:
        del losses.SCHEMES["of a test"]
    with pytest.raises(ValueError):
        losses.lambda_loss(toy, "unknown")
    assert only(losses.lambda_loss(toy, "ndcg2pp", mu=3.0)) != pytest.approx(only(losses.lambda_loss(toy)))


def own_activation(x):
    return 2.0 * dual.tanh(x / 3.0) - dual.log(1.0 + dual.exp(-x)) / dual.sqrt(x * x + 1.0) + x**3 * 0.01 + dual.relu(x)


ACTIVATIONS = [None, *dual.NAMED, own_activation]


@pytest.mark.parametrize("activation", ACTIVATIONS)
def test_slopes_against_finite_differences(spark, activation):
    points = [-2.5, -0.3, 0.7, 4.0]
    rows = spark.createDataFrame([(x + d,) for x in points for d in (-1e-5, 0.0, 1e-5)], "x double")
    value, slope = dual.value_and_slope(activation, F.col("x"))
    found = {round(r["x"], 7): (r["v"], r["s"]) for r in rows.select("x", value.alias("v"), slope.alias("s")).collect()}
    for x in points:
        low, high = found[round(x - 1e-5, 7)][0], found[round(x + 1e-5, 7)][0]
        assert found[x][1] == pytest.approx((high - low) / 2e-5, rel=1e-4, abs=1e-6)


def test_foreign_functions_are_refused():
    with pytest.raises(TypeError, match="dual"):
        dual.value_and_slope(F.tanh, F.lit(1.0))


@pytest.mark.parametrize("activation, scale", [("identity", None), ("sigmoid", 10.0), ("tanh", 4.0), (own_activation, 1.0)])
def test_gradients_against_finite_differences(spark, activation, scale):
    rng = np.random.default_rng(2)
    rows = [(a % 2, a, c, float(rng.normal()), c == 0) for a in range(4) for c in range(a + 2)]
    schema = "batch_id int, anchor_id int, candidate_id int, logit double, is_positive boolean"
    df = spark.createDataFrame(rows, schema)
    got = {(r["anchor_id"], r["candidate_id"]): r["gradient"] for r in losses.mnrl_logit_gradients(df, scale, activation).collect()}
    step = 1e-5

    def moved(by):
        """Per anchor, the loss with one logit moved: all moves in one table."""
        parts = [(f"{a}:{c}", b, x, y, z + by * ((x, y) == (a, c)), p) for _, a, c, _, _ in rows for b, x, y, z, p in rows if x == a]
        many = spark.createDataFrame(parts, "anchor_id string, b int, x int, y int, logit double, is_positive boolean")
        return {r["anchor_id"]: r["loss"] for r in losses.mnrl_per_anchor(many, scale, activation).collect()}

    up, down = moved(step), moved(-step)
    for (a, c), gradient in got.items():
        assert gradient == pytest.approx((up[f"{a}:{c}"] - down[f"{a}:{c}"]) / (2 * step) / 2, rel=1e-4, abs=1e-8)


def test_hard_negatives_are_candidates(spark):
    candidates = spark.createDataFrame([(0, 1, 1, True, "q", "p")], "batch_id int, anchor_id int, candidate_id int, is_positive boolean, anchor string, passage string")
    rows = spark.createDataFrame([(0, 1, "q", "bad", None), (0, 2, "r", None, "worse")], "batch_id int, anchor_id int, anchor string, n1 string, n2 string")
    found = losses.with_hard_negatives(candidates, rows, {"n1": -1, "n2": -2}).orderBy("anchor_id", "candidate_id").collect()
    assert [tuple(r) for r in found] == [(0, 1, -1, False, "q", "bad"), (0, 1, 1, True, "q", "p"), (0, 2, -2, False, "r", "worse")]


@pytest.mark.parametrize("texts, size", [
    (["hot"] * 50 + [f"t{i % 30}" for i in range(50)], 8), ([f"t{i}" for i in range(23)], 5), (["a", None, None, "a", ""], 4), ([], 3),
])
def test_batches_hold_no_text_twice(small_groups, texts, size):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = small_groups.createDataFrame(rows, "id long, text string").repartition(3)
    dealt = batches_without_duplicates(df, size, 12, "id", "text").collect()
    assert sorted(r["id"] for r in dealt) == list(range(len(texts)))
    assert all(n == 1 for n in Counter((r["batch_id"], r["text"]) for r in dealt).values())
    sizes = Counter(r["batch_id"] for r in dealt)
    if texts:
        assert len(sizes) == max(math.ceil(len(texts) / size), max(Counter(texts).values()))
        assert max(sizes.values()) <= size and max(sizes.values()) - min(sizes.values()) <= 1


def test_losses_of_a_report_share_their_passes(spark, toy):
    """The same values as one by one; the table itself is read once, when its columns are stored."""
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    schema = "query_id long, pos int, label double, logit double"
    report = losses.loss_report(toy.mapInArrow(count, schema))
    got = {r["loss_name"]: r["loss"] for r in report.collect()}
    assert reads.value == toy.count()
    plain = {
        "bce": losses.bce_loss(toy), "mse": losses.mse_loss(toy), "listnet": losses.listnet_loss(toy),
        "listmle": losses.listmle_loss(toy), "plistmle": losses.plistmle_loss(toy),
        "ranknet": losses.ranknet_loss(toy), "lambda": losses.lambda_loss(toy)}
    assert got == pytest.approx({name: only(loss) for name, loss in plain.items()})


def test_reports_mix_parts_and_functions(small_groups, toy):
    wanted = {"own": losses.PairLoss("ndcg1"), "swap": losses.PairLoss("lambdarank"), "bce": losses.bce_loss,
              "square": losses.PointLoss(lambda label, logit: logit * logit)}
    got = {r["loss_name"]: r["loss"] for r in losses.loss_report(toy, wanted).collect()}
    assert got == pytest.approx({
        "own": only(losses.lambda_loss(toy, "ndcg1")), "swap": only(losses.lambda_loss(toy, "lambdarank")),
        "bce": only(losses.bce_loss(toy)), "square": np.mean([0.25, 0.04, 0.09, 1.44, 0.01])})
    with pytest.raises(ValueError):
        losses.pair_loss_sums(toy, {"a": losses.SCHEMES["none"], "b": losses.SCHEMES["ndcg1"]})
