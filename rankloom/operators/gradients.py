"""Gradients of ranking objectives with respect to the score of each document."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions import rank_math as rm
from rankloom.operators.losses import with_gains
from rankloom.operators.ranking import QUERY, by_score
from rankloom.operators.trees import Node, as_matrix, sum_of_trees
from rankloom.plans.groups import GroupSizes, per_group, scan_groups
from rankloom.plans.pair_blocks import BLOCK_ROWS, Side, better_pairs, map_pair_blocks

PAIR_OBJECTIVES = ("lambdarank", "ranknet")
POINT_OBJECTIVES = ("mse", "bce")
OBJECTIVES = PAIR_OBJECTIVES + POINT_OBJECTIVES

_ADDED = "lambda double, hessian double"


@per_group(QUERY)
def lambda_gradients(
    df: DataFrame,
    sigma: float = 1.0,
    k: int | None = None,
    block_rows: int = BLOCK_ROWS,
    *,
    sizes: GroupSizes,
) -> DataFrame:
    """``lambda`` and ``hessian`` of each document (query_id, doc_id, label, score).

    A pair with label_i > label_j pulls with sigma * rho * |change of NDCG@k if
    swapped|, where rho = 1 / (1 + exp(sigma * (score_i - score_j))): up on i,
    down on j. Its curvature sigma^2 * rho * (1 - rho) * |change| counts on both.
    """
    slim = df.select(QUERY, "doc_id", "label", "score")
    rows = with_gains(slim, k, score="score", sizes=sizes, tiebreak="doc_id").drop("rank")
    return pair_gradients(rows, sizes, [], sigma, k, block_rows=block_rows)


def pair_gradients(
    rows: DataFrame,
    sizes: GroupSizes,
    carry: Sequence[str],
    sigma: float = 1.0,
    k: int | None = None,
    objective: str = "lambdarank",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Pair gradients of rows with a ``gain``; the ``carry`` columns come along."""
    kernel = pair_kernel(sigma, objective)
    ranked = scan_groups(rows, [QUERY], by_score("score"), rank="rank", sizes=sizes)
    place = F.lit(1.0) / rm.discount(F.col("rank"))
    if k is not None:
        place = F.when(F.col("rank") <= k, place).otherwise(0.0)
    ranked = ranked.withColumn("_place", place)

    payload = ["doc_id", "label", "score", "gain", "_place", "rank", *carry]
    pulled = map_pair_blocks(
        ranked.select(QUERY, *payload), QUERY, "rank", payload, kernel, _ADDED,
        sizes, block_rows, per_item=True,
    ).drop("gain", "_place")
    if sizes.largest <= block_rows:
        return pulled.drop("rank")
    # A row of a list is known by its rank: documents may repeat.
    same = [c for c in pulled.columns if c not in (QUERY, "rank", "lambda", "hessian")]
    summed = pulled.groupBy(QUERY, "rank").agg(
        *[F.first(c).alias(c) for c in same],
        F.sum("lambda").alias("lambda"), F.sum("hessian").alias("hessian"),
    )
    return summed.drop("rank")


def pair_kernel(sigma: float, objective: str) -> Callable[[Side, Side], dict[str, pa.Array]]:
    """Sums of pulls and curvatures of the pairs of two blocks, by item of the left one."""
    weighted = objective == "lambdarank"

    def forces(better: Side, worse: Side) -> Iterator[tuple[np.ndarray, ...]]:
        """(better, worse, pull, curvature) of the pairs of two blocks."""
        names = ("score", "gain", "_place")
        a, b = ({c: side.column(c) for c in names} for side in (better, worse))
        for i, j in better_pairs(better, worse):
            ahead = sigma * (a["score"][i] - b["score"][j])
            rho = np.exp(-np.logaddexp(0.0, ahead))
            weight = 1.0
            if weighted:
                weight = np.abs((a["gain"][i] - b["gain"][j]) * (a["_place"][i] - b["_place"][j]))
            yield i, j, sigma * rho * weight, sigma**2 * rho * (1.0 - rho) * weight

    def kernel(left: Side, right: Side) -> dict[str, pa.Array]:
        n = int(left.starts[-1])
        pull, curve = np.zeros(n), np.zeros(n)

        def add(items, force, bend):
            nonlocal pull, curve
            pull += np.bincount(items, weights=force, minlength=n)
            curve += np.bincount(items, weights=bend, minlength=n)

        for i, j, force, bend in forces(left, right):
            add(i, force, bend)
            if right is left:
                add(j, -force, bend)
        if right is not left:
            for _, j, force, bend in forces(right, left):
                add(j, -force, bend)
        return {"lambda": pa.array(pull), "hessian": pa.array(curve)}

    return kernel


def listed_gradients(
    rows: DataFrame,
    trees: Sequence[Sequence[Node]],
    sigma: float = 1.0,
    k: int | None = None,
    objective: str = "lambdarank",
) -> DataFrame:
    """(bins, lambda, hessian) of rows with a ``gain``, scored by ``score`` and further ``trees``.

    The rows of a list lie together in one partition, in the order that breaks ties of scores. So
    scores, ranks and pairs take one pass, in which a task holds a batch and one list.
    """
    kernel = pair_kernel(sigma, objective)
    trees = list(trees)

    def gradients(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        bins = batch.column("bins")
        score = sum_of_trees(trees, as_matrix(bins), batch.column("score").to_numpy(zero_copy_only=False))
        counts = np.diff(np.append(starts, batch.num_rows))
        order = np.lexsort((-score, np.repeat(np.arange(len(starts)), counts)))
        rank = np.empty(batch.num_rows)
        rank[order] = np.arange(1, batch.num_rows + 1) - np.repeat(starts, counts)
        place = 1.0 / np.log2(rank + 1.0)
        if k is not None:
            place[rank > k] = 0.0
        items = pa.StructArray.from_arrays(
            [batch.column("label"), pa.array(score), batch.column("gain"), pa.array(place)],
            ["label", "score", "gain", "_place"])
        side = Side(pa.ListArray.from_arrays(pa.array(np.append(starts, batch.num_rows), pa.int32()), items))
        return pa.RecordBatch.from_pydict({"bins": bins, **kernel(side, side)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.concat_batches([held, batch])
            starts = list_starts(batch.column(QUERY))
            if starts[-1]:  # the last list may go on in the next batch
                yield gradients(batch.slice(0, starts[-1]), starts[:-1])
            held = batch.slice(starts[-1])
        if held is not None:
            yield gradients(held, np.zeros(1, np.int64))

    slim = rows.select(QUERY, "label", "gain", "score", "bins")
    return slim.mapInArrow(run, "bins array<short>, lambda double, hessian double")


def list_starts(keys: pa.Array) -> np.ndarray:
    """Where a new key begins; nulls are one key, and so are NaNs."""
    a, b = keys.slice(1), keys.slice(0, len(keys) - 1)
    new = pc.fill_null(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b)))
    if pa.types.is_floating(keys.type):
        new = pc.and_(new, pc.invert(pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False)))
    return np.append(0, 1 + np.flatnonzero(new.to_numpy(zero_copy_only=False)))


def point_gradients(rows: DataFrame, objective: str) -> DataFrame:
    """Gradients of pointwise objectives, row by row."""
    y, x = F.col("label"), F.col("score")
    if objective == "mse":
        return rows.withColumns({"lambda": y - x, "hessian": F.lit(1.0)})
    p = rm.activate(x, "sigmoid")
    return rows.withColumns({"lambda": y - p, "hessian": p * (F.lit(1.0) - p)})
