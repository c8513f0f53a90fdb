"""Seeded order that any engine with MD5 can repeat."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(seed: int, *keys: Column) -> Column:
    """Hex digest of the seed and the keys; orders rows at random."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def seeded_int(seed: int, *keys: Column) -> Column:
    """The first 60 bits of :func:`seeded_hash` as a non-negative LONG."""
    return F.conv(F.substring(seeded_hash(seed, *keys), 1, 15), 16, 10).cast("long")
