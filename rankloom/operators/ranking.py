"""Positions of rows in the ranked lists of their queries.

Rankings are total: score first, then a tiebreak (``doc_id`` unless another
column is named), so that results do not depend on how rows are spread.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import rank_math as rm
from rankloom.plans.groups import GroupSizes, group_totals, per_group, scan_groups, top_rows

QUERY = "query_id"
# Sums of exponentials at neighbouring shifts overlap: one is above 1e-280 until the next holds all.
SHIFT_STEP, MAX_EXPONENT, MAX_SHIFTS = 600.0, 700.0, 64


def by_score(score: str = "score", tiebreak: str = "doc_id") -> list[Column]:
    return [F.col(score).desc(), F.col(tiebreak).asc()]


@per_group(QUERY)
def rank_within_query(
    df: DataFrame,
    score: str = "score",
    tiebreak: str = "pos",
    name: str = "new_order",
    *,
    sizes: GroupSizes,
) -> DataFrame:
    """1-based rank of each row in its query by falling score (stable on ``tiebreak``)."""
    return scan_groups(df, [QUERY], by_score(score, tiebreak), rank=name, sizes=sizes)


@per_group(QUERY)
def positions(
    df: DataFrame, score: str = "score", tiebreak: str = "doc_id", *, sizes: GroupSizes
) -> DataFrame:
    """Add the predicted position ``rank`` and the position by label ``ideal_rank``."""
    ranked = scan_groups(df, [QUERY], by_score(score, tiebreak), rank="rank", sizes=sizes)
    return scan_groups(
        ranked, [QUERY], by_score("label", tiebreak), rank="ideal_rank", sizes=sizes
    )


def top_per_query(df: DataFrame, n: int = 5, score: str = "score") -> DataFrame:
    """The first ``n`` rows of every query by falling score."""
    return top_rows(df, [QUERY], by_score(score), n, "rank")


@per_group(QUERY)
def rank_change(candidates: DataFrame, *, sizes: GroupSizes) -> DataFrame:
    """Add ``final_rank`` by the second score and how far each document moved up.

    Rows are matched by document, and equal second scores keep their order
    from the first stage.
    """
    ranked = scan_groups(
        candidates, [QUERY], by_score("cross_score", "stage1_rank"), rank="final_rank", sizes=sizes
    )
    return ranked.withColumn("rank_change", F.col("stage1_rank") - F.col("final_rank"))


@per_group(QUERY)
def running_hits(
    df: DataFrame, min_rel: float = 1, score: str = "score", *, sizes: GroupSizes
) -> DataFrame:
    """Add ``rank`` and the number of relevant rows down to each row."""
    hit = rm.is_relevant(F.col("label"), min_rel).cast("long")
    return scan_groups(
        df, [QUERY], by_score(score), rank="rank", running={"hits": hit}, sizes=sizes
    )


@per_group(QUERY)
def suffix_exp_sums(
    df: DataFrame,
    logit: str = "logit",
    by_label: bool = False,
    rank: str | None = None,
    *,
    sizes: GroupSizes,
) -> DataFrame:
    """Add ``shift`` and ``suffix``: the sum of exp(logit - shift) to the end of the list.

    The list runs by ``pos``, or by falling label with ``by_label``. The shift is the largest
    logit of the query, at least 0, which keeps exp from overflowing. It is
    summed in reversed order, since Spark recomputes a frame that ends
    unbounded for each row. ``rank``, if named, counts from the end.

    Tails far below the largest logit vanish in that sum. ``tails`` holds the sums
    (shift, sum) for shifts in steps of ``SHIFT_STEP`` down to 0; the first one that is not
    vanishingly small is exact, since everything behind it is near its shift or below.
    """
    backwards = [F.col("label").asc()] if by_label else []
    backwards.append(F.col("pos").desc())
    x = F.col(logit)
    shifted = group_totals(df, [QUERY], {"shift": F.max(x)}, "pos", sizes)
    shifted = shifted.withColumn("shift", F.greatest("shift", F.lit(0.0)))
    largest = df.agg(F.max(x)).first()[0] or 0.0
    steps = max(1, math.ceil(largest / SHIFT_STEP))
    if steps > MAX_SHIFTS:
        raise ValueError(f"logits beyond {MAX_SHIFTS * SHIFT_STEP:g} are not supported")
    shifts = [F.greatest(F.col("shift") - F.lit(i * SHIFT_STEP), F.lit(0.0)) for i in range(steps + 1)]
    names = ["suffix", *[f"_tail_{i}" for i in range(1, steps + 1)]]
    summed = scan_groups(
        shifted,
        [QUERY],
        backwards,
        rank=rank,
        running={
            name: F.exp(F.least(x - shift, F.lit(MAX_EXPONENT)))
            for name, shift in zip(names, shifts, strict=True)
        },
        sizes=sizes,
    )
    tails = [F.struct(s.alias("shift"), F.col(n).alias("sum")) for s, n in zip(shifts, names, strict=True)]
    return summed.withColumn("tails", F.array(*tails)).drop(*names[1:])


@per_group(QUERY)
def softmax_in_query(
    df: DataFrame, column: str, name: str = "softmax", *, sizes: GroupSizes
) -> DataFrame:
    """Add the softmax of a column over each query."""
    top = group_totals(df, [QUERY], {"_top": F.max(column)}, "doc_id", sizes)
    weight = F.exp(F.col(column) - F.col("_top"))
    total = group_totals(top, [QUERY], {"_total": F.sum(weight)}, "doc_id", sizes)
    return total.withColumn(name, weight / F.col("_total")).drop("_top", "_total")
