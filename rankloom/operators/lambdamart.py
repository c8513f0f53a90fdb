"""Boosted trees on ranking gradients, trained and applied on DataFrames.

Features are read once, binned and stored by query, each list in one piece. Each round is a chain
of Spark jobs: scores, positions and pair gradients in one pass over the lists, without a shuffle, then
a second-order tree grown leaf by leaf on sums per bin (``histograms``). Trees, and sums of a
bounded number of bins, reach the driver. The trees of the last rounds are applied to the
stored table in that pass; every few rounds their scores are written to the checkpoint folder.

Lists that are longer than a block take windows and pairs of blocks, through which only scores and labels
go; their bins are joined to the gradients by row.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.gradients import (
    OBJECTIVES, PAIR_OBJECTIVES, listed_gradients, pair_gradients, point_gradients,
)
from rankloom.operators.histograms import Binning, Rules, grow_tree
from rankloom.operators.losses import with_gains
from rankloom.operators.metrics import mean_ndcg
from rankloom.operators.ranking import QUERY
from rankloom.operators.trees import NODE_SCHEMA, Node, binned_scorer, tree_column, tree_scorer
from rankloom.plans.durable import durable
from rankloom.plans.groups import GroupSizes, measure_groups, split_groups
from rankloom.plans.pair_blocks import BLOCK_ROWS
from rankloom.sources.datasets import sample_queries

#: Leaves of a tree without bounds on depth or leaves.
DEFAULT_LEAVES = 31


def decayed_rate(round_: int, start: float = 0.1, decay: float = 0.95) -> float:
    """A learning rate that shrinks by a constant factor each round."""
    return start * decay**round_


@dataclass
class LambdaMART:
    """Trainer; columns are (query_id, doc_id, label, features ARRAY<DOUBLE>).

    ``learning_rate`` is a number or a function of the round. Trees grow leaf by leaf up to
    ``num_leaves`` and no deeper than ``max_depth``; without ``num_leaves`` they have
    as many leaves as the depth allows, without ``max_depth`` any shape. Features
    are cut into ``max_bins`` quantiles. ``l1`` and ``l2`` act in split gains and leaf values.
    ``categorical`` lists features (from 0) that hold category numbers. ``query_subsample`` draws
    whole queries for each round, ``feature_subsample`` draws features.

    ``eval_at`` is one cutoff or several that are watched; the first one decides when to stop
    (``stop_after`` rounds without a better value) and which round is the best.
    """

    n_trees: int = 100
    learning_rate: float | Callable[[int], float] = 0.1
    max_depth: int | None = 3
    num_leaves: int | None = None
    min_leaf_rows: int = 1
    min_leaf_hessian: float = 0.0
    min_gain: float = 0.0
    max_bins: int = 255
    l1: float = 0.0
    l2: float = 0.0
    sigma: float = 1.0
    k: int | None = None
    objective: str = "lambdarank"
    query_subsample: float = 1.0
    feature_subsample: float = 1.0
    categorical: Sequence[int] = ()
    eval_at: int | Sequence[int] = 10
    stop_after: int | None = None
    checkpoint_every: int = 10
    block_rows: int = BLOCK_ROWS
    seed: int = 12

    @property
    def cutoffs(self) -> list[int]:
        return [self.eval_at] if isinstance(self.eval_at, int) else list(self.eval_at)

    @property
    def leaf_bound(self) -> int:
        if self.num_leaves:
            return self.num_leaves
        return DEFAULT_LEAVES if self.max_depth is None else 2**self.max_depth

    def fit(self, df: DataFrame, valid: DataFrame | None = None) -> LambdaMARTModel:
        """Train; with ``valid`` watch NDCG there, stop early and keep the best round."""
        if self.objective not in OBJECTIVES:
            raise ValueError(f"objective must be one of {OBJECTIVES}")
        train, by_row, sizes, binning = self._prepare(df)
        watched = self._watch(valid) if valid is not None else None
        draw = random.Random(self.seed)
        model = LambdaMARTModel([], len(binning.edges), cutoffs=self.cutoffs)
        recent: list[list[Node]] = []  # trees that the stored scores do not have yet
        for round_ in range(self.n_trees):
            tree, binned = self._round(train, recent, by_row, sizes, round_, binning, draw)
            model.trees.append(tree)
            recent.append(binned)
            if watched is not None:
                watched = watched.withColumn(
                    "score", F.col("score") + tree_column(tree, F.col("features"))
                )
                values = [float(mean_ndcg(watched, k).first()[0]) for k in self.cutoffs]
                model.history.append((round_ + 1, *values))
                if self.stop_after and round_ + 1 - model.best_iteration >= self.stop_after:
                    break
            if (round_ + 1) % self.checkpoint_every == 0 and round_ + 1 < self.n_trees:
                train, recent = durable(_with_scores(train, recent)), []
                watched = durable(watched) if watched is not None else None
        if by_row is not None:
            by_row.unpersist()
        return model

    def _prepare(self, df: DataFrame):
        """The binned rows by query, their bins by row if there are long lists, the sizes of the lists, and the bins' edges."""
        raw = durable(df.select(
            QUERY, "doc_id", F.col("label").cast("double").alias("label"),
            F.col("features").cast("array<double>").alias("features"),
        ).withColumn("row", F.monotonically_increasing_id()))
        sizes = measure_groups(raw, [QUERY])
        width = raw.agg(F.max(F.size("features"))).first()[0] or 0
        binning = Binning.fit(raw, self.max_bins, self.categorical, max(width, 0))
        rows = binning.assign(raw).drop("features").withColumn("score", F.lit(0.0))
        if self.objective in PAIR_OBJECTIVES:
            if sizes.bounded:
                # The rows of a partition stay there and in order in the checkpoint, so no
                # round has to shuffle or sort the training rows again.
                rows = rows.repartition(QUERY)
            rows = split_groups(rows, [QUERY], sizes, lambda part, own: with_gains(
                part, self.k, score="score", tiebreak="doc_id", sizes=own
            )).drop("rank")
            if self._listed(sizes):
                rows = rows.sortWithinPartitions(QUERY, "doc_id", "row")
        train = durable(rows)
        if self.objective not in PAIR_OBJECTIVES or self._listed(sizes):
            return train, None, sizes, binning
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        by_row = train.select("row", "bins").repartition(tasks, "row").persist(StorageLevel.MEMORY_AND_DISK)
        return train, by_row, sizes, binning

    def _listed(self, sizes: GroupSizes) -> bool:
        """No list is longer than a block."""
        return sizes.bounded and sizes.largest <= self.block_rows

    def _watch(self, valid: DataFrame) -> DataFrame:
        rows = valid.select(QUERY, "doc_id", "label", F.col("features").cast("array<double>").alias("features"))
        return durable(rows.withColumn("score", F.lit(0.0)))

    def _round(self, train, recent, by_row, sizes, round_, binning, draw) -> tuple[list[Node], list[Node]]:
        chosen = list(range(len(binning.edges)))
        if self.feature_subsample < 1.0:
            chosen = sorted(draw.sample(chosen, max(1, round(self.feature_subsample * len(chosen)))))
        rows = train
        if self.query_subsample < 1.0:
            rows = sample_queries(rows, self.query_subsample, self.seed, round_)
        if self.objective not in PAIR_OBJECTIVES:
            pulled = point_gradients(_with_scores(rows, recent), self.objective)
        elif by_row is None:
            pulled = listed_gradients(rows, recent, self.sigma, self.k, self.objective)
        else:
            pulled = split_groups(_with_scores(rows, recent).drop("bins"), [QUERY], sizes, lambda part, own: pair_gradients(
                part, own, ["row"], self.sigma, self.k, self.objective, self.block_rows
            )).select("row", "lambda", "hessian").join(by_row, "row")
        slim = pulled.select("bins", "lambda", "hessian").persist(StorageLevel.MEMORY_AND_DISK)
        rules = Rules(
            self.leaf_bound, self.max_depth, self.min_leaf_rows, self.min_leaf_hessian, self.min_gain, self.l1, self.l2)
        try:
            grown = grow_tree(slim, binning, rules, sizes.total, chosen)
        finally:
            slim.unpersist()
        rate = self.learning_rate(round_) if callable(self.learning_rate) else self.learning_rate
        for nodes in grown:
            for node in nodes:
                node.value *= rate
        return grown


def _with_scores(rows: DataFrame, trees: list[list[Node]]) -> DataFrame:
    """Rows with ``bins`` whose scores have further trees."""
    return rows.withColumn("score", binned_scorer(trees)("score", "bins")) if trees else rows


@dataclass
class LambdaMARTModel:
    """Trained trees, and NDCG at the cutoffs on the watched table after each round."""

    trees: list[list[Node]]
    n_features: int
    history: list[tuple] = field(default_factory=list)
    cutoffs: list[int] = field(default_factory=lambda: [10])

    @property
    def best_iteration(self) -> int:
        """Number of trees at the best watched NDCG (first cutoff); all trees without a watched table."""
        if not self.history:
            return len(self.trees)
        return max(self.history, key=lambda entry: (entry[1], -entry[0]))[0]

    def transform(self, df: DataFrame, out: str = "score", n_trees: int | None = None) -> DataFrame:
        """Add the score at the best round, or of the first ``n_trees``."""
        return self.scored(df, F.col("features").cast("array<double>"), out, n_trees)

    def scored(self, df: DataFrame, features: Column, out: str, n_trees: int | None = None) -> DataFrame:
        used = self.trees[: self.best_iteration if n_trees is None else n_trees]
        return df.withColumn(out, tree_scorer(used)(features))

    def history_table(self, spark: SparkSession) -> DataFrame:
        """round, and NDCG at each watched cutoff."""
        values = [f"ndcg_at_{k} double" for k in self.cutoffs]
        return spark.createDataFrame(self.history, ", ".join(["round int", *values]))

    def nodes_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (t, i, n.feature, n.threshold, n.categories, n.left, n.right, n.leaf, n.value, n.gain)
            for t, nodes in enumerate(self.trees) for i, n in enumerate(nodes)
        ]
        return spark.createDataFrame(rows, NODE_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the trees and the history under ``path``, replacing what is there."""
        self.nodes_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        about = json.dumps({"n_features": self.n_features, "history": self.history, "cutoffs": self.cutoffs})
        spark.createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").parquet(
            f"{path}/about"
        )

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LambdaMARTModel:
        """Read a saved model; it has as many rows as the trees have nodes."""
        trees: list[list[Node]] = []
        for row in spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect():
            values = row.asDict()
            tree = values.pop("tree")
            values.pop("node")
            if tree == len(trees):
                trees.append([])
            trees[tree].append(Node(**values))
        about = json.loads(spark.read.parquet(f"{path}/about").first()[0])
        return cls(trees, about["n_features"], [tuple(entry) for entry in about["history"]], about["cutoffs"])


def feature_importance(model: LambdaMARTModel, spark: SparkSession) -> DataFrame:
    """Splits and total gain of each feature; names count from 1."""
    nodes = model.nodes_table(spark).where(F.col("feature") >= 0)
    used = nodes.groupBy((F.col("feature") + 1).alias("name")).agg(
        F.count(F.lit(1)).alias("importance"), F.sum("gain").alias("gain")
    )
    names = spark.range(1, model.n_features + 1).select(F.col("id").cast("int").alias("name"))
    return names.join(used, "name", "left").na.fill({"importance": 0, "gain": 0.0})
