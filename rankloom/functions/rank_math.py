"""Scalar pieces of ranking metrics and losses."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class cuts of a predicted score, and the clamp of score differences.
BUCKET_CUTS = (0.0, 0.4)
SCORE_DIFF_CLAMP = 1e8

ACTIVATIONS: dict[str, Callable[[Column], Column]] = {
    "identity": lambda x: x,
    "sigmoid": lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)),
    "tanh": F.tanh,
}


def activate(x: Column, activation: str | Callable[[Column], Column] | None) -> Column:
    """Apply a named activation, or one given as a Column function."""
    if activation is None:
        return x
    return (activation if callable(activation) else ACTIVATIONS[activation])(x)


def gain(label: Column) -> Column:
    return F.pow(F.lit(2.0), label) - F.lit(1.0)


def discount(position: Column) -> Column:
    """log2(1 + position) for a 1-based position."""
    return F.log2(position.cast("double") + F.lit(1.0))


def is_relevant(label: Column, min_rel: float = 1) -> Column:
    return label >= F.lit(min_rel)


def clamp(x: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        x = F.greatest(x, F.lit(low))
    return x if high is None else F.least(x, F.lit(high))


def bucketize(score: Column, cuts: Sequence[float] = BUCKET_CUTS) -> Column:
    """Class of a score: 0 up to the first cut, then one class more from each further cut.

    A NaN falls into the last class, a NULL stays NULL.
    """
    result = F.when(score <= F.lit(float(cuts[0])), F.lit(0))
    for cls, cut in enumerate(cuts[1:], start=1):
        result = result.when(score < F.lit(float(cut)), F.lit(cls))
    return result.when(score.isNotNull(), F.lit(len(cuts)))


def log_loss_with_logit(label: Column, logit: Column, pos_weight: float | None = None) -> Column:
    """Binary cross-entropy of a logit, safe for logits of any size."""
    w = F.lit(1.0 if pos_weight is None else float(pos_weight))
    one = F.lit(1.0)
    soft = F.log1p(F.exp(-F.abs(logit))) + F.greatest(-logit, F.lit(0.0))
    return (one - label) * logit + (one + (w - one) * label) * soft
