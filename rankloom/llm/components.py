"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import stored


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m) with the least m of all v of a u and of u itself; combined before the shuffle."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _measure(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(id, component): each id of the links (u, v) with the least id it reaches.

    Every round links each vertex to the least one near it; the number of rounds grows
    with the logarithm of the vertices. A vertex with very many links meets them in a join
    whose large partitions Spark splits.
    """
    edges = stored(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .filter(F.col("u") != F.col("v")).distinct(), "links")
    before = None
    while (now := _measure(edges)) != before:
        before = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        small = _with_least(large)  # here every v is less than its u
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            small.select("u", F.col("m").alias("v")))
        edges = stored(small.filter(F.col("u") != F.col("v")).distinct(), "links")
    stars = edges.groupBy("u").agg(F.min("v").alias("component"))
    return stars.select(F.col("u").alias("id"), "component").union(
        stars.select(F.col("component").alias("id"), "component").distinct())
