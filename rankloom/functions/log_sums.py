"""Sums of exponentials as plain sums, which combine before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# exp of anything inside one band stays a finite double.
BAND = 512.0


def _band(x: Column) -> Column:
    return F.floor(x / F.lit(BAND))


def _in_band(x: Column) -> Column:
    return F.exp(x - _band(x).cast("double") * F.lit(BAND))


def exp_sums(
    df: DataFrame, keys: Sequence[str], sums: dict[str, tuple[Column, Column]], extra: Sequence[Column] = ()
) -> DataFrame:
    """For each name add sum(exp(x) * factor) per key as ``<name>_top`` and ``<name>_sum``.

    The value is ``<name>_sum * exp(<name>_top)``. Each exponent is summed in
    its own band of width ``BAND``, so no maximum has to be known beforehand
    and no window over the group is needed; the few bands of a key are then
    put together relative to its highest band. ``extra`` are sums over the rows.
    """
    bands = [_band(x).alias(f"_band_{name}") for name, (x, _) in sums.items()]
    partial = df.groupBy(*keys, *bands).agg(
        *[F.sum(_in_band(x) * factor).alias(f"_sum_{name}") for name, (x, factor) in sums.items()],
        *extra,
    )
    extra_names = partial.columns[len(keys) + 2 * len(sums):]
    item = F.struct(*[c for c in partial.columns if c not in keys])
    packed = partial.groupBy(*keys).agg(
        F.collect_list(item).alias("_bands"), *[F.sum(name).alias(name) for name in extra_names]
    )
    tops = packed.withColumns({f"_top_{name}": _top(name) for name in sums})
    columns = []
    for name in sums:
        columns.append((F.col(f"_top_{name}") * F.lit(BAND)).alias(f"{name}_top"))
        columns.append(_total(name).alias(f"{name}_sum"))
    return tops.select(*keys, *columns, *extra_names)


def _top(name: str) -> Column:
    return F.array_max(F.col(f"_bands._band_{name}")).cast("double")


def _total(name: str) -> Column:
    def add(total: Column, band: Column) -> Column:
        below = band[f"_band_{name}"].cast("double") - F.col(f"_top_{name}")
        return total + band[f"_sum_{name}"] * F.exp(below * F.lit(BAND))

    return F.aggregate("_bands", F.lit(0.0), add)
