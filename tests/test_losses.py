"""Golden values of the losses, gradients, and properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import gradients, losses
from tests.conftest import only, values

MATRIX = [[2.0, -1.0, 0.5], [0.1, 0.4, -0.3]]


def test_pointwise(toy):
    assert only(losses.bce_loss(toy)) == pytest.approx(0.5268500450883655)
    assert only(losses.bce_loss(toy, pos_weight=5)) == pytest.approx(1.5602218018776977)
    assert only(losses.mse_loss(toy)) == pytest.approx(0.166)


def test_bce_of_large_logits(spark):
    df = spark.createDataFrame([(1.0, 1000.0), (0.0, -1000.0), (0.0, 800.0)], "label double, logit double")
    assert only(losses.bce_loss(df)) == pytest.approx(800 / 3)


def test_multi_class(spark):
    df = spark.createDataFrame([(row, c) for c, row in enumerate(MATRIX)], "logits array<double>, label int")
    assert only(losses.ce_loss(df)) == pytest.approx(0.5233136746702662)


def test_margin_mse(spark):
    schema = "pos_logit double, neg_logits array<double>, teacher array<double>"
    margins = [[2.0, 1.0], [0.0, 0.5]]
    rows = [(row[0], row[1:], m) for row, m in zip(MATRIX, margins)]
    assert only(losses.margin_mse_loss(spark.createDataFrame(rows, schema))) == pytest.approx(0.3375)
    raw = [(row[0], row[1:], [3.0, 3.0 - m[0], 3.0 - m[1]]) for row, m in zip(MATRIX, margins)]
    assert only(losses.margin_mse_loss(spark.createDataFrame(raw, schema))) == pytest.approx(0.3375)
    scalar = spark.createDataFrame([(1.0, [0.5], 0.25)], schema.replace("teacher array<double>", "teacher double"))
    assert only(losses.margin_mse_loss(scalar)) == pytest.approx(0.0625)
    wrong = spark.createDataFrame([(1.0, [0.5], [1.0, 2.0, 3.0])], schema)
    with pytest.raises(Exception, match="one value per negative"):
        losses.margin_mse_loss(wrong).collect()


def test_listwise(toy):
    per_query = values(losses.listnet_per_query(toy), "loss")
    assert per_query == pytest.approx([0.5914450438444544, 1.104549212018764])
    assert only(losses.listnet_loss(toy)) == pytest.approx(0.8479971279316092)
    assert only(losses.listmle_loss(toy)) == pytest.approx(1.0720425120198456)
    assert only(losses.listmle_loss(toy, pad_to=3)) == pytest.approx(1.641228940799645)
    assert only(losses.plistmle_loss(toy)) == pytest.approx(0.6528743830744417)
    assert only(losses.plistmle_loss(toy, pad_to=3)) == pytest.approx(0.8802294873249987)
    assert only(losses.plistmle_loss(toy, pad_to=1)) == pytest.approx(0.6528743830744417)
    assert only(losses.plistmle_loss(toy, weight=None)) == pytest.approx(1.0720425120198456)


GOLDEN = {
    "none": (0.6197145808395562, 0.5816745132826652),
    "ndcg1": (0.3203196222981393, 0.4470193850543532),
    "ndcg2": (0.1477447138184513, 0.2146787559584357),
    "lambdarank": (0.13701347650808876, 0.2146787559584357),
    "ndcg2pp": (1.6144606146926022, 2.3614663155427933),
}


@pytest.mark.parametrize("scheme", GOLDEN)
@pytest.mark.parametrize("block_rows", [1024, 2])
def test_lambda_loss(toy, scheme, block_rows):
    whole, at_2 = GOLDEN[scheme]
    assert only(losses.lambda_loss(toy, scheme, block_rows=block_rows)) == pytest.approx(whole)
    assert only(losses.lambda_loss(toy, scheme, k=2, block_rows=block_rows)) == pytest.approx(at_2)


def test_pairs_of_ndcg1(toy):
    pairs = lambda k: only(losses.lambda_loss_sums(toy, "ndcg1", k=k).agg(F.sum("pairs")))
    assert (pairs(None), pairs(2)) == (13, 8)


def test_ranknet_is_the_unweighted_scheme(toy):
    assert only(losses.ranknet_loss(toy)) == pytest.approx(GOLDEN["none"][0])
    natural = only(losses.ranknet_loss(toy, log="natural"))
    assert natural == pytest.approx(GOLDEN["none"][0] * np.log(2.0))


def test_no_pairs_give_null(toy):
    assert only(losses.lambda_loss(toy.withColumn("label", F.lit(1.0)))) is None


def test_long_and_steep_lists(spark):
    n = 2000
    logits = np.concatenate([np.linspace(900.0, 0.0, n // 2), np.linspace(-50.0, -800.0, n // 2)])
    rows = [(1, i, 0.0, float(x)) for i, x in enumerate(logits)]
    df = spark.createDataFrame(rows, "query_id long, pos int, label double, logit double")
    tails = np.logaddexp.accumulate(logits[::-1])[::-1]
    log_p = logits - np.logaddexp(tails, np.log(1e-10))
    assert only(losses.listmle_loss(df)) == pytest.approx(-log_p.sum(), rel=1e-9)
    w = 2.0 ** -np.arange(n) - 2.0**-n
    assert only(losses.plistmle_loss(df)) == pytest.approx(-(w * log_p).sum() / w.sum(), rel=1e-9)
    steep = np.log(np.exp(logits - 900.0).sum()) + 900.0
    p = np.full(n, 1.0 / n)
    assert only(losses.listnet_loss(df)) == pytest.approx(-(p * (logits - steep)).sum(), rel=1e-9)


def candidates(spark, matrix):
    rows = [
        (0, a, c, float(x), c == 0) for a, row in enumerate(matrix) for c, x in enumerate(row)
    ]
    return spark.createDataFrame(
        rows, "batch_id int, anchor_id long, candidate_id long, logit double, is_positive boolean"
    )


def test_in_batch_loss_and_gradients(spark):
    assert only(losses.mnrl_loss(candidates(spark, MATRIX))) == pytest.approx(0.6580361319442849)
    found = losses.mnrl_logit_gradients(candidates(spark, MATRIX))
    got = {(r["anchor_id"], r["candidate_id"]): r["gradient"] for r in found.collect()}

    def loss(m):
        z = 10.0 / (1.0 + np.exp(-m))
        return np.mean(np.log(np.exp(z).sum(axis=1)) - z[:, 0])

    for a in range(2):
        for c in range(3):
            step = np.zeros((2, 3))
            step[a, c] = 1e-6
            m = np.array(MATRIX)
            slope = (loss(m + step) - loss(m - step)) / 2e-6
            assert got[a, c] == pytest.approx(slope, abs=1e-7)


def test_in_batch_loss_without_scale_and_activation(spark):
    plain = only(losses.mnrl_loss(candidates(spark, MATRIX), scale=None, activation=None))
    m = np.array(MATRIX)
    assert plain == pytest.approx(np.mean(np.log(np.exp(m).sum(axis=1)) - m[:, 0]))


@pytest.mark.parametrize("block_rows", [1024, 3])
@pytest.mark.parametrize("k", [None, 4])
def test_lambda_gradients_against_brute_force(spark, block_rows, k):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for q, n in enumerate([1, 5, 11]):
        y, s = rng.integers(0, 4, n).astype(float), rng.normal(size=n).round(1)
        rows += [(q, d, float(y[d]), float(s[d])) for d in range(n)]
        order = sorted(range(n), key=lambda d: (-s[d], d))
        place = {d: i + 1 for i, d in enumerate(order)}
        cut = k or n
        inv = np.array([1 / np.log2(1 + place[d]) if place[d] <= cut else 0.0 for d in range(n)])
        ideal = sum((2**v - 1) / np.log2(2 + i) for i, v in enumerate(sorted(y, reverse=True)[:cut]))
        gain = (2**y - 1) / max(ideal, 1e-10)
        pull, curve = np.zeros(n), np.zeros(n)
        for i in range(n):
            for j in range(n):
                if y[i] > y[j]:
                    rho = 1 / (1 + np.exp(s[i] - s[j]))
                    change = abs((gain[i] - gain[j]) * (inv[i] - inv[j]))
                    pull[i] += rho * change
                    pull[j] -= rho * change
                    curve[[i, j]] += rho * (1 - rho) * change
        want.update({(q, d): (pull[d], curve[d]) for d in range(n)})
    df = spark.createDataFrame(rows, "query_id long, doc_id long, label double, score double")
    found = gradients.lambda_gradients(df, k=k, block_rows=block_rows).collect()
    assert len(found) == len(want)
    for r in found:
        assert (r["lambda"], r["hessian"]) == pytest.approx(want[r["query_id"], r["doc_id"]], abs=1e-12)


def test_gradients_of_a_query_sum_to_zero(toy):
    df = toy.withColumnsRenamed({"pos": "doc_id", "logit": "score"})
    sums = gradients.lambda_gradients(df).groupBy("query_id").agg(F.sum("lambda").alias("s"))
    assert values(sums, "s") == pytest.approx([0.0, 0.0], abs=1e-12)


def test_list_likelihood_of_logits_that_are_far_apart(spark):
    rows = [(1, i, float(i == 0), x) for i, x in enumerate((2000.0, 1000.0, 999.0))]
    rows += [(2, i, 0.0, x) for i, x in enumerate((-3000.0, 0.0, 5000.0, 4399.5, 10.0))]
    df = spark.createDataFrame(rows, "query_id long, pos int, label double, logit double")
    got = {r["query_id"]: r["loss"] for r in losses.plistmle_per_query(df, weight=None, eps=0.0).collect()}
    for q in (1, 2):
        x = [r[3] for r in rows if r[0] == q]
        want = sum(np.logaddexp.reduce(x[i:]) - x[i] for i in range(len(x)))
        assert got[q] == pytest.approx(want, rel=1e-9)
