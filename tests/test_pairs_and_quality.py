"""Pairs, in-batch negatives, and prediction quality against brute force."""

import math

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import pairs, quality
from tests.conftest import only


def judged(spark):
    rows = [(q, d, float(d * 7 % 3), float(d * 5 % 4)) for q in range(3) for d in range(6 + q)]
    return spark.createDataFrame(rows, "query_id long, doc_id long, label double, score double"), rows


@pytest.mark.parametrize("k", [3, 50])
def test_pairs(spark, k):
    df, rows = judged(spark)
    want_all, want_preferred = set(), set()
    for q in range(3):
        ranked = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[3], r[1]))[:k]
        for a, b in itertools.product(ranked, ranked):
            want_all.add((q, a[1], b[1]))
            if a[2] > b[2]:
                want_preferred.add((q, a[1], b[1]))
    columns = ["query_id", "doc_id_i", "doc_id_j"]
    assert set(map(tuple, pairs.all_pairs(df, k).select(*columns).collect())) == want_all
    found = pairs.preference_pairs(df, k).select(*columns).collect()
    assert len(found) == len(want_preferred) and set(map(tuple, found)) == want_preferred
    if k == 50:
        counts = {r["query_id"]: tuple(r)[1:] for r in pairs.pair_counts(df).collect()}
        for q in range(3):
            assert counts[q] == (
                sum(p[0] == q for p in want_all), sum(p[0] == q for p in want_preferred)
            )


def test_pair_with_query(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    rows = sorted(map(tuple, pairs.pair_with_query(docs, 7, "q").collect()))
    assert rows == [(7, 1, "q", "a"), (7, 2, "q", "b")]


def batches(spark, sizes, hard=0):
    rows = [
        (b, 100 * b + i, f"a{b}-{i}", f"p{b}-{i}", [f"n{b}-{i}-{h}" for h in range(hard)])
        for b, n in enumerate(sizes) for i in range(n)
    ]
    schema = "batch_id int, anchor_id long, anchor string, positive string, negatives array<string>"
    df = spark.createDataFrame(rows, schema)
    return df if hard else df.drop("negatives")


@pytest.mark.parametrize("hard", [0, 2])
def test_in_batch_negatives(spark, hard):
    sizes = [1, 3, 5, 12]
    df = batches(spark, sizes, hard)
    found = pairs.in_batch_negatives(df, 4).collect()
    per_anchor = Counter((r["batch_id"], r["anchor_id"]) for r in found)
    for b, n in enumerate(sizes):
        for i in range(n):
            assert per_anchor[b, 100 * b + i] == min(4, (n - 1) * (1 + hard))
    keys = [(r["anchor_id"], r["negative_owner"], r["negative_col"]) for r in found]
    assert len(keys) == len(set(keys))
    for r in found:
        assert r["anchor_id"] != r["negative_owner"]
        kind = "p" if r["negative_col"] == 0 else "n"
        name = f"{kind}{r['batch_id']}-{r['negative_owner'] - 100 * r['batch_id']}"
        assert r["negative"] == name + (f"-{r['negative_col'] - 1}" if kind == "n" else "")


def test_all_in_batch_negatives(spark):
    found = pairs.in_batch_negatives(batches(spark, [1, 3, 5], 1), None)
    assert found.count() == 3 * 2 * 2 + 5 * 4 * 2


def test_draws_are_even(spark):
    counts = Counter()
    for seed in range(12):
        rows = pairs.in_batch_negatives(batches(spark, [40]), 4, seed).collect()
        counts.update(r["negative_owner"] for r in rows)
    expected = 12 * 4
    assert len(counts) == 40
    assert max(abs(n - expected) for n in counts.values()) < 5 * np.sqrt(expected)


def test_equal_texts(spark):
    df = batches(spark, [5]).withColumn("positive", F.lit("same"))
    assert pairs.in_batch_negatives(df, 4).count() == 20
    assert pairs.in_batch_negatives(df, 4, drop_duplicates=True).count() == 0


# -- quality -------------------------------------------------------------------------

def average_ranks(v):
    return np.array([(np.sum(v < x) + 1 + np.sum(v <= x)) / 2 for x in v])


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 120).astype(float)
    s = (y + rng.normal(size=120)).round(1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, s)], "label double, score double")
    return df, y, s


def test_correlations(scored):
    df, y, s = scored
    r, rho = np.corrcoef(y, s)[0, 1], np.corrcoef(average_ranks(y), average_ranks(s))[0, 1]
    assert only(quality.pearson(df)) == pytest.approx(r)
    assert only(quality.spearman(df)) == pytest.approx(rho)
    signs = [
        (np.sign(y[i] - y[j]), np.sign(s[i] - s[j])) for i, j in itertools.combinations(range(len(y)), 2)
    ]
    a, b = np.array(signs).T
    tau = (a * b).sum() / np.sqrt(np.abs(a).sum() * np.abs(b).sum())
    assert only(quality.kendall(df)) == pytest.approx(tau)
    assert only(quality.kendall(df, "score", "label")) == pytest.approx(tau)
    assert only(quality.kendall(df, "score", "score")) == pytest.approx(1.0)
    report = {row["statistic"]: row for row in quality.correlation_report(df).collect()}
    assert report["spearman"]["value"] == pytest.approx(rho)
    assert report["pearson"]["p_value"] == pytest.approx(quality.corr_pvalue(r, 120))


def test_p_values():
    # Against numerical integration of the t density.
    for r, n in ((0.3, 20), (-0.5, 8), (0.05, 400), (0.9, 5)):
        freedom = n - 2
        t = abs(r) * np.sqrt(freedom / (1 - r * r))
        angle = np.linspace(np.arctan(t / np.sqrt(freedom)), np.pi / 2, 200_001)
        whole = np.linspace(0, np.pi / 2, 200_001)
        want = np.trapezoid(np.cos(angle) ** (freedom - 1), angle) / np.trapezoid(np.cos(whole) ** (freedom - 1), whole)
        assert quality.corr_pvalue(r, n) == pytest.approx(want, rel=1e-5)
    assert quality.corr_pvalue(1.0, 10) == 0.0
    assert quality.corr_pvalue(0.0, 10) == pytest.approx(1.0)


def test_roc(scored):
    df, y, s = scored
    binary = df.withColumn("label", (F.col("label") > 0).cast("double"))
    up, down = s[y > 0], s[y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in up for b in down])
    assert only(quality.roc_auc(binary)) == pytest.approx(auc)
    for r in quality.roc_curve(binary).collect():
        assert r["fpr"] == pytest.approx(np.mean(down >= r["threshold"]))
        assert r["tpr"] == pytest.approx(np.mean(up >= r["threshold"]))
    assert only(quality.roc_auc(binary.withColumn("label", F.lit(1.0)))) is None


def test_errors_and_report(spark):
    rows = [(0, 0), (0, 1), (1, 1), (2, 1), (1, 1)]
    df = spark.createDataFrame(rows, "label int, predicted int")
    assert only(quality.accuracy(df)) == pytest.approx(60.0)
    report = {r["cls"]: r for r in quality.classification_report(df).collect()}
    assert tuple(report["1"])[1:] == pytest.approx((0.5, 1.0, 2 / 3, 2))
    assert tuple(report["2"])[1:] == (0.0, 0.0, 0.0, 1)
    assert report["accuracy"]["f1"] == pytest.approx(0.6)
    assert report["macro avg"]["recall"] == pytest.approx(0.5)
    assert report["weighted avg"]["precision"] == pytest.approx((2 * 1.0 + 2 * 0.5) / 5)
    scores = df.select(F.col("label").cast("double").alias("label"), F.col("predicted").cast("double").alias("score"))
    assert only(quality.rmse(scores)) == pytest.approx(np.sqrt(2 / 5))


def test_p_values_of_very_many_rows():
    for n, rel in ((10**5, 1e-4), (10**7, 1e-6), (10**12, 1e-9)):
        r = 2.0 / math.sqrt(n + 2.0)
        assert quality.corr_pvalue(r, n) == pytest.approx(0.04550026389635842, rel=rel)
    assert quality.corr_pvalue(0.5, 10**9) == 0
