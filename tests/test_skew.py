"""Groups beyond the bound of one task give the same results as small ones."""

import pytest
from pyspark.sql import functions as F

from rankloom.functions.rank_math import gain
from rankloom.operators import gradients, losses, metrics, pairs, quality, ranking
from rankloom.plans.groups import group_totals, measure_groups, scan_groups
from rankloom.sources import datasets


def skewed(spark):
    """One query holds a third of all rows; scores and labels tie often."""
    rows = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20 + 1).cast("long").alias("query_id"),
        F.col("id").alias("doc_id"), F.col("id").alias("pos"),
        (F.col("id") * 7 % 4).cast("double").alias("label"),
        (F.col("id") * 13 % 11 / 2).alias("score"),
        (F.col("id") * 17 % 23 / 7).alias("logit"),
    )
    return rows


CASES = {
    "positions": lambda df: ranking.positions(df).drop("score", "logit"),
    "hits": ranking.running_hits,
    "softmax": lambda df: ranking.softmax_in_query(df, "score"),
    "suffix": ranking.suffix_exp_sums,
    "report": metrics.ranking_report,
    "ndcg": lambda df: metrics.ndcg(df, [3, None]),
    "ndcg_at_3": lambda df: metrics.ndcg(df, [1, 3]),
    "ndcg_at_0": lambda df: metrics.ndcg(df, 0),
    "dcg_at_3": lambda df: metrics.dcg(df, 3),
    "truncated_at_3": lambda df: metrics.ndcg(df, 3, ideal="truncated"),
    "rr_at_3": lambda df: metrics.reciprocal_rank(df, 3, min_rel=3),
    "ap_at_3": lambda df: metrics.average_precision(df, 3),
    "precision_at_3": lambda df: metrics.precision_at(df, 3),
    "recall_at_3": lambda df: metrics.recall_at(df, 3),
    "random": lambda df: metrics.ndcg_random(df, 3),
    "lambda_loss_at_3": lambda df: losses.lambda_loss_sums(df, k=3),
    "listnet": losses.listnet_per_query,
    "truncated": lambda df: metrics.ndcg(df, 5, ideal="truncated"),
    "above_mean": metrics.precision_above_mean,
    "plistmle": losses.plistmle_per_query,
    "listmle_by_label": lambda df: losses.plistmle_per_query(df, weight=None, respect_input_order=False),
    "lambda_loss": losses.lambda_loss_sums,
    "lambda_loss_in_blocks": lambda df: losses.lambda_loss_sums(df, block_rows=5),
    "gradients": gradients.lambda_gradients,
    "spearman": lambda df: quality.spearman(df, "label", "score"),
    "kendall": lambda df: quality.kendall(df, "label", "logit"),
    "roc_curve": lambda df: quality.roc_curve(df, "label", "logit"),
    "roc_auc": lambda df: quality.roc_auc(df, "label", "logit"),
    "tail": lambda df: datasets.tail_split(df, 0.1, "doc_id"),
    "batches": lambda df: datasets.assign_batches(df, 10, 1, "doc_id", exact=True),
    "pair_counts": pairs.pair_counts,
    "negatives": lambda df: pairs.in_batch_negatives(
        df.select(F.col("query_id").alias("batch_id"), F.col("doc_id").alias("anchor_id"),
                  F.lit("a").alias("anchor"), F.col("doc_id").cast("string").alias("positive")), 3),
}


def table(df):
    names = sorted(df.columns)
    rows = [tuple(flat(row[n]) for n in names) for row in df.collect()]
    return sorted(rows, key=lambda row: tuple((x is not None, 0 if x is None else x) for x in row))


def flat(value):
    """Lists of structs to one tuple of numbers."""
    if isinstance(value, (list, tuple)):
        return tuple(x for v in value for x in (flat(v) if isinstance(v, (list, tuple)) else (v,)))
    return value


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b, strict=True):
            assert x == y or x == pytest.approx(y, rel=1e-9, abs=1e-12)


def odd(spark):
    """The hot list has a NULL key, and some rows are there three times."""
    df = skewed(spark).withColumn("query_id", F.when(F.col("query_id") > 0, F.col("query_id")))
    some = df.where(F.col("doc_id") % 10 == 0)
    return df.union(some).union(some)


#: Cases whose rows follow from the values alone, also if rows or keys repeat.
BY_QUERY = (
    "positions", "hits", "softmax", "report", "ndcg", "ndcg_at_3", "dcg_at_3", "truncated_at_3", "rr_at_3",
    "ap_at_3", "precision_at_3", "recall_at_3", "lambda_loss_at_3", "listnet", "above_mean", "lambda_loss",
    "lambda_loss_in_blocks", "gradients", "gradients_in_blocks",
)
CASES["gradients_in_blocks"] = lambda df: gradients.lambda_gradients(df, block_rows=5)


@pytest.mark.parametrize("rows,case", [(skewed, c) for c in CASES] + [(odd, c) for c in BY_QUERY])
def test_blocks_give_the_same_rows_and_schema(spark, monkeypatch, rows, case):
    from rankloom.plans import groups

    df = rows(spark)
    whole = CASES[case.replace("_in_blocks", "")](df)
    want = table(whole)
    spark.conf.set(groups.GROUP_LIMIT_KEY, "7")
    try:
        for named in (groups.NAMED_GROUPS, 0):
            monkeypatch.setattr(groups, "NAMED_GROUPS", named)
            blocks = CASES[case](df)
            same(table(blocks), want)
            assert sorted(blocks.dtypes) == sorted(whole.dtypes)
    finally:
        spark.conf.unset(groups.GROUP_LIMIT_KEY)


def test_the_large_group_is_split(small_groups):
    df = skewed(small_groups)
    sizes = measure_groups(df, ["query_id"])
    assert (sizes.largest, sizes.total, sizes.bounded) == (100, 300, False)
    scanned = scan_groups(df, ["query_id"], [F.col("doc_id")], rank="rank", sizes=sizes)
    assert scanned.columns == [*df.columns, "rank"]
    # No window of the plan sees a whole group.
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "_block" in plan


def test_totals_of_split_groups(small_groups):
    df = skewed(small_groups)
    totals = group_totals(df, ["query_id"], {"n": F.count(F.lit(1)), "g": F.sum(gain(F.col("label")))}, "doc_id")
    want = {r["query_id"]: (r["n"], r["g"]) for r in df.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(gain(F.col("label"))).alias("g")).collect()}
    rows = totals.collect()
    assert len(rows) == 300
    assert all((r["n"], r["g"]) == want[r["query_id"]] for r in rows)
