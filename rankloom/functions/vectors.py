"""Embedding columns."""

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Similarities are rounded here, so that the order of summation cannot part equal ones.
SCORE_DIGITS = 12


def densify(features: Column, n_features: int) -> Column:
    """Dense array of a map from 1-based feature index to value; missing is 0.

    An index outside 1 to ``n_features`` is an error.

    The map is walked once: a look-up per index inside a lambda would build
    the map anew for every index.
    """
    indices = F.sequence(F.lit(1), F.lit(n_features))
    zeros = F.map_from_arrays(indices, F.array_repeat(F.lit(0.0), n_features))
    outside = F.exists(F.map_keys(features), lambda i: (i < 1) | (i > n_features))
    checked = F.when(~outside, features).otherwise(
        F.raise_error(F.lit(f"feature index outside 1 to {n_features}")).cast("map<int,double>"))
    checked = F.when(features.isNotNull(), checked)
    filled = F.map_zip_with(zeros, checked, lambda _, zero, value: F.coalesce(value, zero))
    ordered = F.array_sort(F.map_entries(filled))
    return F.transform(F.slice(ordered, 1, n_features), lambda entry: entry["value"])


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two vectors, rounded so that equal vectors tie; 0 for a zero or non-finite vector."""
    def dot(a, b):
        products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)

    norms = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    # NaN is larger than any number here.
    return F.when((norms > 0) & (norms < float("inf")), F.round(dot(left, right) / norms, SCORE_DIGITS)).otherwise(0.0)


def mean_vectors(df: DataFrame, keys: Sequence[str], vector: str = "embedding") -> DataFrame:
    """Mean vector of each group; the sums combine before the shuffle."""
    dense = array_to_vector(F.col(vector).cast("array<double>"))
    means = df.where(F.col(vector).isNotNull()).groupBy(*keys).agg(
        Summarizer.mean(dense).alias("_mean")
    )
    return means.select(*keys, vector_to_array("_mean").alias(vector))
