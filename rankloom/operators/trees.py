"""Regression trees as plain tables, and their scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, categories array<double>, "
    "left int, right int, leaf int, value double, gain double"
)


@dataclass
class Node:
    """An inner node has a feature and two children, a leaf a number and a value."""

    feature: int = -1
    threshold: float = 0.0
    categories: list[float] | None = None
    left: int = -1
    right: int = -1
    leaf: int = -1
    value: float = 0.0
    gain: float = 0.0


def tree_column(nodes: Sequence[Node], features: Column, value: bool = True) -> Column:
    """The value (or number) of the leaf that a row falls into, as an expression."""

    def visit(at: int) -> Column:
        node = nodes[at]
        if node.leaf >= 0:
            return F.lit(float(node.value)) if value else F.lit(node.leaf)
        x = F.element_at(features, node.feature + 1)
        if node.categories is None:
            goes_left = x <= F.lit(node.threshold)
        else:
            goes_left = x.isin(node.categories)
        return F.when(goes_left, visit(node.left)).otherwise(visit(node.right))

    return visit(0)


def leaf_values(nodes: Sequence[Node], matrix: np.ndarray) -> np.ndarray:
    """The value of the leaf that each row of a feature matrix falls into."""
    feature = np.array([n.feature for n in nodes])
    threshold = np.array([n.threshold for n in nodes])
    is_leaf = np.array([n.leaf >= 0 for n in nodes])
    left, right = np.array([n.left for n in nodes]), np.array([n.right for n in nodes])
    by_category = [i for i, n in enumerate(nodes) if n.categories is not None]
    at = np.zeros(len(matrix), dtype=np.int64)
    live = np.arange(0 if is_leaf[0] else len(matrix))
    while len(live):
        node = at[live]
        x = matrix[live, feature[node]]
        goes_left = x <= threshold[node]
        for i in by_category:
            here = node == i
            goes_left[here] = np.isin(x[here], nodes[i].categories)
        at[live] = node = np.where(goes_left, left[node], right[node])
        live = live[~is_leaf[node]]
    return np.array([n.value for n in nodes])[at]


def sum_of_trees(
    trees: Sequence[Sequence[Node]], matrix: np.ndarray, start: np.ndarray | None = None,
) -> np.ndarray:
    """Sum of the leaf values of all trees for each row of a feature matrix, on top of ``start``."""
    total = np.zeros(len(matrix)) if start is None else start.copy()
    for nodes in trees:
        total += leaf_values(nodes, matrix)
    return total


def as_matrix(lists: pa.Array) -> np.ndarray:
    """Arrays of one length as the rows of a matrix."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), len(flat) // max(len(lists), 1))


def binned_scorer(trees: Sequence[Sequence[Node]]):
    """The ``score`` of a row with these ``bins`` after further trees."""
    trees = list(trees)

    @F.arrow_udf("double")
    def score(before: pa.Array, bins: pa.Array) -> pa.Array:
        return pa.array(sum_of_trees(trees, as_matrix(bins), before.to_numpy(zero_copy_only=False)))

    return score


def tree_scorer(trees: Sequence[Sequence[Node]]):
    """All trees in one pass over Arrow batches of feature arrays."""
    trees = list(trees)

    @F.arrow_udf("double")
    def score(features: pa.Array) -> pa.Array:
        flat = features.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        width = len(flat) // max(len(features), 1)
        return pa.array(sum_of_trees(trees, flat.reshape(len(features), width)))

    return score
