"""Per-group order and totals that hold when one group is huge.

Operators first count their groups (one pass over the key column, combined on
the map side). Groups that fit the bound of one task get plain windows: one
shuffle by key. Groups beyond it, if there are any, are set apart and worked
on in blocks: their rows are range-partitioned by (key, order), windows run
inside the partitions, and a small table of offsets joins the blocks together.
Both ways give the same rows.

``per_group`` turns a function of (rows, sizes) into an operator that sets the
large groups apart; ``scan_groups`` and ``group_totals`` are the two steps that
such functions are made of.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from rankloom.plans.durable import durable

GROUP_LIMIT_KEY = "spark.rankloom.maxGroupRows"
GROUP_LIMIT_DEFAULT = 1_000_000
# Large groups that may be named one by one; there are at most rows / limit of them.
NAMED_GROUPS = 10_000
SALTS = 64

_BLOCK = "_block"


@dataclass(frozen=True)
class GroupSizes:
    """Rows of the largest group, rows in all, and the bound for one task.

    ``groups`` bounds the number of groups, if known. ``large`` are the keys
    of the groups beyond the bound, and ``rest`` the sizes without them.
    """

    largest: int
    total: int
    limit: int
    groups: int | None = None
    large: tuple[Row, ...] = field(default=(), repr=False)
    large_total: int = 0
    rest: int = 0

    @property
    def bounded(self) -> bool:
        return self.largest <= self.limit


def group_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(GROUP_LIMIT_KEY, str(GROUP_LIMIT_DEFAULT)))


def measure_groups(df: DataFrame, keys: Sequence[str]) -> GroupSizes:
    """Count the rows of every group, and find the groups beyond the bound."""
    limit = group_limit(df)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    n = F.col("_n")
    row = counts.agg(
        F.max(n).alias("largest"), F.sum(n).alias("total"),
        F.sum(F.when(n > limit, n)).alias("large_total"),
        F.sum(F.when(n > limit, 1)).alias("large"),
        F.max(F.when(n <= limit, n)).alias("rest"),
    ).first()
    large = ()
    if keys and row["large"] and row["large"] <= NAMED_GROUPS:
        large = tuple(counts.where(n > limit).select(*keys).collect())
    return GroupSizes(
        row["largest"] or 0, row["total"] or 0, limit, None, large,
        row["large_total"] or 0, row["rest"] or 0,
    )


def known_groups(df: DataFrame, largest: int) -> GroupSizes:
    """Sizes that follow from the plan (such as a top-k), so need no job."""
    return GroupSizes(largest, largest, group_limit(df))


def split_groups(
    df: DataFrame,
    keys: Sequence[str],
    sizes: GroupSizes,
    work: Callable[[DataFrame, GroupSizes], DataFrame],
) -> DataFrame:
    """Work on the small groups and on the large ones by themselves.

    The few large keys are named, so neither part is shuffled to tell them
    apart. Without large groups, or with too many to name, ``work`` gets the
    whole table.
    """
    if not sizes.large:
        return work(df, sizes)
    schema = df.select(*keys).schema
    named = df.sparkSession.createDataFrame(list(sizes.large), schema)
    small = GroupSizes(sizes.rest, sizes.total - sizes.large_total, sizes.limit)
    large = GroupSizes(sizes.largest, sizes.large_total, sizes.limit, len(sizes.large))
    parts = [
        work(null_safe_join(df, named, keys, how, broadcast=True), own)
        for how, own in (("left_anti", small), ("left_semi", large))
    ]
    return parts[0].unionByName(parts[1])


def per_group(*keys: str):
    """Make an operator of ``work(df, ..., sizes)`` that sets large groups apart.

    Groups must not depend on each other. The groups are measured unless
    ``sizes`` are given, in which case the whole table is worked on with them.
    """

    def decorate(work: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(work)
        def run(df: DataFrame, *args, sizes: GroupSizes | None = None, **options) -> DataFrame:
            if sizes is not None:
                return work(df, *args, sizes=sizes, **options)
            return split_groups(
                df, keys, measure_groups(df, keys),
                lambda part, own: work(part, *args, sizes=own, **options),
            )

        return run

    return decorate


def scan_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    rank: str | None = None,
    running: Mapping[str, Column] | None = None,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Add the 1-based ``rank`` (long) and the ``running`` sums of each group.

    ``order`` must order the rows of a group totally (end it with a unique
    column). ``keys`` may be empty: then the whole table is one group.
    """
    keys = list(keys)
    running = dict(running or {})
    sizes = sizes or measure_groups(df, keys)
    if sizes.bounded:
        return df.withColumns(_local_scan(_window(keys, order), rank, running, F.lit(0), {}))

    parts = max(2, -(-2 * sizes.total // sizes.limit))
    placed = durable(
        df.repartitionByRange(parts, *keys, *order).withColumn(_BLOCK, F.spark_partition_id())
    )
    sums = {f"_sum_{name}": F.sum(value) for name, value in running.items()}
    totals = placed.groupBy(*keys, _BLOCK).agg(
        F.count(F.lit(1)).alias("_rows"), *[agg.alias(name) for name, agg in sums.items()]
    )
    earlier = _window(keys, [F.col(_BLOCK)]).rowsBetween(Window.unboundedPreceding, -1)
    # Only groups that span partitions have a later block, so at most ``parts``
    # rows are left here: small enough to broadcast whatever the input is.
    offsets = totals.select(
        *keys,
        _BLOCK,
        F.sum("_rows").over(earlier).alias("_rows_before"),
        *[F.sum(name).over(earlier).alias(f"{name}_before") for name in sums],
    ).where(F.col("_rows_before").isNotNull())
    joined = null_safe_join(placed, offsets, [*keys, _BLOCK], "left", broadcast=True)
    scan = _local_scan(
        _window([*keys, _BLOCK], order),
        rank,
        running,
        F.coalesce("_rows_before", F.lit(0)),
        {name: F.coalesce(f"_sum_{name}_before", F.lit(0)) for name in running},
    )
    added = [name for name in ([rank] if rank else []) + list(running) if name not in df.columns]
    return joined.withColumns(scan).select(*df.columns, *added)


def group_totals(
    df: DataFrame,
    keys: Sequence[str],
    totals: Mapping[str, Column],
    salt_on: str,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Add aggregates of the whole group to each of its rows.

    Each of ``totals`` is one aggregate function, so that it also works as a window.
    """
    sizes = sizes or measure_groups(df, keys)
    if sizes.bounded:
        w = Window.partitionBy(*keys)
        return df.withColumns({name: agg.over(w) for name, agg in totals.items()})
    per_key = df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in totals.items()])
    if not keys or (sizes.groups is not None and sizes.groups <= NAMED_GROUPS):
        # One row per group, and few groups.
        return _broadcast_join(df, per_key, keys)
    return salted_join(df, per_key, keys, salt_on)


def _broadcast_join(df: DataFrame, per_key: DataFrame, keys: Sequence[str]) -> DataFrame:
    if keys:
        return null_safe_join(df, per_key, keys, broadcast=True)
    one = per_key.withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one")


def salted_join(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], salt_on: str) -> DataFrame:
    """Join one row per key to many, spreading each key over ``SALTS`` tasks."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    left = rows.withColumn("_salt", F.pmod(F.hash(salt_on), F.lit(SALTS)))
    right = per_key.withColumn("_salt", salts)
    return null_safe_join(left, right, [*keys, "_salt"]).drop("_salt")


def null_safe_join(
    rows: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner", broadcast: bool = False
) -> DataFrame:
    """Join by keys of which NULL is one like any other; the columns of ``rows`` come first."""
    names = {key: f"_right_{i}" for i, key in enumerate(keys)}
    right = per_key.withColumnsRenamed(names)
    if broadcast:
        right = F.broadcast(right)
    same = [F.col(key).eqNullSafe(F.col(name)) for key, name in names.items()]
    return rows.join(right, same, how).drop(*names.values())


def top_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None, rank: str
) -> DataFrame:
    """The first ``k`` rows of each group, ranked; None ranks every row.

    The filter on the rank lets Spark drop rows past ``k`` before the shuffle,
    so a task sees at most ``k`` rows per group and input partition.
    """
    if k is None:
        return scan_groups(df, keys, order, rank=rank)
    ranked = df.withColumn(rank, F.row_number().over(_window(keys, order)))
    return ranked.where(F.col(rank) <= k)


def head_rows(
    df: DataFrame,
    keys: Sequence[str],
    orders: Sequence[Sequence[Column]],
    k: int | None,
    sizes: GroupSizes,
) -> tuple[DataFrame, GroupSizes]:
    """The rows of large groups that a cutoff at ``k`` can see, and their sizes.

    These are the first ``k`` rows by each of the orders. Among them a row has
    the same place as in its whole group, if that place is at most ``k``.
    Rows past ``k`` are dropped before the shuffle. Groups within the bound,
    and cutoffs beyond it, are left as they are.
    """
    if sizes.bounded or k is None or k * len(orders) > sizes.limit:
        return df, sizes
    heads = [top_rows(df, keys, order, max(k, 1), "_place").drop("_place") for order in orders]
    if len(heads) > 1:
        # A row in both heads counts once, but equal rows are rows of their own:
        # they are numbered in each head, and the head with more of them decides.
        equal = Window.partitionBy(*df.columns).orderBy(F.lit(0))
        heads = [head.withColumn("_copy", F.row_number().over(equal)) for head in heads]
    rows = heads[0]
    for head in heads[1:]:
        rows = rows.unionByName(head)
    if len(heads) > 1:
        rows = rows.dropDuplicates().drop("_copy")
    return rows, known_groups(df, max(k, 1) * len(heads))


def _window(keys, order):
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)


def _local_scan(window, rank, running, rows_before, sums_before):
    to_here = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = {}
    if rank:
        columns[rank] = F.row_number().over(window).cast("long") + rows_before
    for name, value in running.items():
        here = F.sum(value).over(to_here)
        columns[name] = here + sums_before[name] if name in sums_before else here
    return columns
