"""Work on the pairs of a group without making a row per pair.

The rows of a group are packed into blocks of at most ``block_rows`` rows.
Each task gets two blocks of one group as arrays, goes through their pairs in
memory and returns sums. A group that fits one block is paired with itself and
is shuffled once, also if other groups are larger. Larger groups get one row for
each ordered pair of blocks, placed by (group, block), which spreads a large group
over the cluster; a block is copied once per block of its group, so a list of n
rows shuffles n * n / block_rows items.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.plans.durable import durable
from rankloom.plans.groups import GroupSizes, null_safe_join

BLOCK_ROWS = 8192
PAIRS_AT_ONCE = 500_000


class Side:
    """One side of a batch of block pairs: flat columns with list offsets."""

    def __init__(self, lists: pa.Array):
        self.lists = lists
        self.sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.values = lists.flatten()

    @property
    def rows(self) -> np.ndarray:
        """The batch row of each item."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def column(self, name: str) -> np.ndarray:
        return self.values.field(name).to_numpy(zero_copy_only=False)


def all_pairs(left: Side, right: Side) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield (left index, right index) of all pairs of each batch row, in slices."""
    counts = right.sizes[left.rows]
    return _slices(left, right, counts, np.arange(right.starts[-1]))


def better_pairs(
    left: Side, right: Side, column: str = "label"
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield the pairs in which the left item has the larger value, in slices.

    The right items are put in the order of their values, so the partners of a
    left item are the first ones of its row and no other pair is looked at.
    """
    a, b = left.column(column), right.column(column)
    codes = np.unique(np.concatenate([a, b]), return_inverse=True)[1]
    width = int(codes.max(initial=0)) + 1
    keys = right.rows * width + codes[len(a):]
    order = np.argsort(keys, kind="stable")
    below = np.searchsorted(keys[order], left.rows * width + codes[: len(a)], side="left")
    return _slices(left, right, below - right.starts[left.rows], order)


def _slices(left, right, counts, order):
    """Pair each left item with the first ``counts`` right items of its row."""
    ends, rows, item = np.cumsum(counts), left.rows, 0
    while item < len(counts):
        done = ends[item - 1] if item else 0
        stop = max(item + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, side="right")))
        here = counts[item:stop]
        i = np.repeat(np.arange(item, stop), here)
        within = np.arange(int(here.sum())) - np.repeat(np.cumsum(here) - here, here)
        yield i, order[right.starts[rows[i]] + within]
        item = stop


def map_pair_blocks(
    rows: DataFrame,
    key: str,
    rank: str,
    payload: Sequence[str],
    kernel: Callable[[Side, Side], dict[str, pa.Array]],
    schema: str,
    sizes: GroupSizes,
    block_rows: int = BLOCK_ROWS,
    per_item: bool = False,
) -> DataFrame:
    """Run ``kernel`` on the block pairs of each group.

    The kernel gets both sides of a batch and returns the columns of
    ``schema``: one value per batch row, or with ``per_item`` one value per
    item of the left side. In the latter case the rows of the left side come
    back with the columns added, once for each block they were paired with.
    """
    item = F.struct(*payload)
    fits = sizes.largest <= block_rows
    numbered = rows.withColumn("_block", F.floor((F.col(rank) - 1) / F.lit(block_rows)))
    blocks = numbered.groupBy(key, *([] if fits else ["_block"])).agg(F.collect_list(item).alias("left"))
    if not fits:
        counts = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).alias("_n"))
        several = durable(counts.where(F.col("_n") > 1))
        ids = several.select(
            key, "_n", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_block")
        )
        # Blocks meet their partner numbers first, then the partner blocks.
        with_partner = null_safe_join(blocks, ids, [key, "_block"]).select(
            key, "left", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_block")
        )
        meeting = null_safe_join(
            with_partner, blocks.withColumnRenamed("left", "right"), [key, "_block"]
        ).select(key, "left", "right")
        alone = null_safe_join(blocks, several, [key], "left_anti").select(key, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = Side(batch.column("left"))
            right = Side(batch.column("right")) if "right" in batch.schema.names else left
            keys = batch.column(key)
            added = kernel(left, right)
            if per_item:
                keys = keys.take(pa.array(np.repeat(np.arange(len(keys)), left.sizes)))
                added = {**{name: left.values.field(name) for name in payload}, **added}
            yield pa.RecordBatch.from_pydict({key: keys, **added})

    kept = [key, *(payload if per_item else [])]
    fields = [f"`{name}` {rows.schema[name].dataType.simpleString()}" for name in kept]
    out = ", ".join([*fields, schema])
    if fits:
        return blocks.mapInArrow(run, out)
    return alone.mapInArrow(run, out).unionByName(meeting.mapInArrow(run, out))
