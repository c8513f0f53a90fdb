"""Ranking losses of scored tables, as aggregates over (query_id, pos, label, logit)."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import rank_math as rm
from rankloom.functions.dual import value_and_slope
from rankloom.functions.log_sums import exp_sums
from rankloom.operators.ranking import QUERY, by_score, suffix_exp_sums
from rankloom.plans.durable import durable
from rankloom.plans.groups import (
    GroupSizes, group_totals, head_rows, known_groups, measure_groups, per_group, scan_groups, split_groups,
)
from rankloom.plans.pair_blocks import BLOCK_ROWS, Side, all_pairs, better_pairs, map_pair_blocks
from rankloom.schema import require_columns

Activation = str | Callable[[Column], Column] | None

# Defaults of the losses.
EPS = 1e-10
MNRL_SCALE = 10.0
NDCG2PP_MU = 10.0
PADDED_LOGIT = 1e-16


def _activated(df: DataFrame, activation: Activation) -> DataFrame:
    require_columns(df, "label", "logit")
    return df.withColumn("logit", rm.activate(F.col("logit").cast("double"), activation))


# -- pointwise ---------------------------------------------------------------

def bce_loss(
    df: DataFrame, pos_weight: float | None = None, activation: Activation = None
) -> DataFrame:
    """Mean binary cross-entropy with logits; ``pos_weight`` scales the positive term."""
    term = rm.log_loss_with_logit(F.col("label"), F.col("logit"), pos_weight)
    return _activated(df, activation).agg(F.avg(term).alias("loss"))


def mse_loss(df: DataFrame, activation: Activation = None) -> DataFrame:
    """Mean squared difference of logit and label."""
    off = F.col("logit") - F.col("label")
    return _activated(df, activation).agg(F.avg(off * off).alias("loss"))


def ce_loss(df: DataFrame) -> DataFrame:
    """Mean multi-class cross-entropy of ``logits ARRAY`` against the class ``label``."""
    top = F.array_max("logits")
    total = F.aggregate("logits", F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    own = F.element_at("logits", F.col("label").cast("int") + 1)
    return df.agg(F.avg(top + F.log(total) - own).alias("loss"))


# -- margins -----------------------------------------------------------------

def normalize_margins(df: DataFrame) -> DataFrame:
    """Bring ``teacher`` to one margin per negative.

    With one value more than there are negatives they are raw scores, the
    positive first; with as many they are margins; anything else is an error.
    A scalar column counts as a list of one.
    """
    if df.schema["teacher"].dataType.simpleString().startswith("array"):
        teacher = F.col("teacher")
    else:
        teacher = F.array("teacher")
    n = F.size("neg_logits")
    raw = F.transform(F.slice(teacher, F.lit(2), n), lambda s: F.element_at(teacher, 1) - s)
    wrong = F.raise_error(F.lit("teacher needs one value per negative, or one more"))
    return df.withColumn(
        "margins",
        F.when(F.size(teacher) == n + 1, raw)
        .when(F.size(teacher) == n, teacher)
        .otherwise(wrong.cast("array<double>")),
    )


def margin_mse_loss(df: DataFrame) -> DataFrame:
    """Mean squared difference of student and teacher margins over all negatives.

    Rows hold ``pos_logit``, ``neg_logits ARRAY`` and ``teacher``.
    """
    off = F.zip_with(
        "neg_logits", "margins", lambda neg, margin: F.col("pos_logit") - neg - margin
    )
    squares = F.aggregate(off, F.lit(0.0), lambda acc, d: acc + d * d)
    return normalize_margins(df).agg(
        (F.sum(squares) / F.sum(F.size("margins"))).alias("loss")
    )


# -- listwise ----------------------------------------------------------------

def listnet_per_query(df: DataFrame, activation: Activation = None) -> DataFrame:
    """Cross-entropy of the softmax of the labels with that of the logits, per query."""
    y, x, one = F.col("label"), F.col("logit"), F.lit(1.0)
    sums = exp_sums(
        _activated(df, activation), [QUERY], {"y": (y, one), "yx": (y, x), "x": (x, one)}
    )
    log_total = F.col("x_top") + F.log("x_sum")
    return sums.select(QUERY, (log_total - F.col("yx_sum") / F.col("y_sum")).alias("loss"))


def listnet_loss(df: DataFrame, activation: Activation = None) -> DataFrame:
    return listnet_per_query(df, activation).agg(F.avg("loss").alias("loss"))


ListWeight = str | Callable[[Column], Column] | None


def plistmle_per_query(df: DataFrame, weight: ListWeight = "exp2", **options) -> DataFrame:
    """Position-aware list likelihood of each query.

    ``weight`` is "exp2" (2^(n - i) - 1 for i from 0), a Column function of the 1-based rank, or
    None; ``options`` are those of :func:`list_likelihoods`.
    """
    return list_likelihoods(df, {"loss": weight}, **options)


@per_group(QUERY)
def list_likelihoods(
    df: DataFrame,
    weights: Mapping[str, ListWeight],
    respect_input_order: bool = True,
    pad_to: int | None = None,
    eps: float = EPS,
    activation: Activation = None,
    *,
    sizes: GroupSizes,
) -> DataFrame:
    """List likelihoods of each query under several position weights, from one scan of the lists.

    The list runs by ``pos``, or by falling label. ``pad_to`` adds what padding to that length adds to each
    denominator: one padded logit per missing place.
    """
    rows = _activated(df.select(QUERY, "pos", "label", "logit"), activation)
    counted = group_totals(rows, [QUERY], {"n": F.count(F.lit(1))}, "pos", sizes)
    tails = suffix_exp_sums(counted, by_label=not respect_input_order, rank="_back", sizes=sizes)
    added = F.lit(eps)
    if pad_to is not None:
        missing = F.greatest(F.lit(pad_to) - F.col("n"), F.lit(0))
        added = added + missing * F.exp(F.lit(PADDED_LOGIT))
    here = F.coalesce(
        F.get(F.filter("tails", lambda t: t["sum"] > F.lit(1e-280)), F.lit(0)), F.element_at("tails", -1)
    )
    log_total = here["shift"] + F.log(here["sum"] + added * F.exp(-here["shift"]))
    log_p = F.col("_log_p")
    before = (F.col("n") - F.col("_back")).cast("double")

    def likelihood(weight: ListWeight) -> Column:
        if weight is None:
            return -F.sum(log_p)
        if weight == "exp2":
            # Scaled by 2^-n, which keeps long lists finite and cancels out.
            unit = F.pow(F.lit(2.0), -F.col("n").cast("double"))
            w, w_eps = F.pow(F.lit(2.0), -before) - unit, F.max(F.lit(eps) * unit)
        else:
            w, w_eps = weight(before + F.lit(1.0)), F.lit(eps)
        return -F.sum(w * log_p) / (F.sum(w) + w_eps)

    return tails.withColumn("_log_p", F.col("logit") - log_total).groupBy(QUERY).agg(
        *[likelihood(weight).alias(name) for name, weight in weights.items()])


def plistmle_loss(df: DataFrame, **options) -> DataFrame:
    return plistmle_per_query(df, **options).agg(F.avg("loss").alias("loss"))


def listmle_loss(df: DataFrame, **options) -> DataFrame:
    """The list likelihood without position weights."""
    return plistmle_loss(df, weight=None, **options)


# -- in-batch negatives --------------------------------------------------------

def _scaled(df: DataFrame, scale: float | None, activation: Activation) -> DataFrame:
    z = rm.activate(F.col("logit").cast("double"), activation)
    return df.withColumn("z", z * F.lit(float(scale)) if scale else z)


def mnrl_per_anchor(
    df: DataFrame, scale: float | None = MNRL_SCALE, activation: Activation = "sigmoid"
) -> DataFrame:
    """log-sum-exp over the candidates of each anchor, less its positive.

    Rows are (anchor_id, logit, is_positive).
    """
    z = F.col("z")
    own = F.sum(F.when(F.col("is_positive"), z).otherwise(0.0)).alias("own")
    sums = exp_sums(_scaled(df, scale, activation), ["anchor_id"], {"z": (z, F.lit(1.0))}, [own])
    return sums.select("anchor_id", (F.col("z_top") + F.log("z_sum") - F.col("own")).alias("loss"))


def mnrl_loss(
    df: DataFrame, scale: float | None = MNRL_SCALE, activation: Activation = "sigmoid"
) -> DataFrame:
    return mnrl_per_anchor(df, scale, activation).agg(F.avg("loss").alias("loss"))


def with_hard_negatives(candidates: DataFrame, rows: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """The candidates of each anchor and its own hard negatives.

    ``rows`` (batch_id, anchor_id, anchor, ...) have a column for each negative; ``columns`` maps it to the
    ``candidate_id`` that it gets. A NULL is no candidate.
    """
    named = F.array(*[
        F.struct(F.lit(number).cast(candidates.schema["candidate_id"].dataType).alias("id"), F.col(name).alias("text"))
        for name, number in columns.items()])
    own = rows.select("batch_id", "anchor_id", "anchor", F.explode(named).alias("_own")).where("_own.text is not null")
    return candidates.unionByName(own.select(
        "batch_id", "anchor_id", F.col("_own.id").alias("candidate_id"), F.lit(False).alias("is_positive"),
        "anchor", F.col("_own.text").alias("passage")))


def mnrl_logit_gradients(
    df: DataFrame, scale: float | None = MNRL_SCALE, activation: Activation = "sigmoid"
) -> DataFrame:
    """Gradient of the mean loss of each batch with respect to every logit.

    Rows are (batch_id, anchor_id, candidate_id, logit, is_positive). The slope of the activation
    comes from dual numbers, so one of the caller's own uses the functions of ``functions.dual``.
    Without ``scale`` the activated logits are taken as they are.
    """
    z = F.col("z")
    factor = F.lit(float(scale or 1.0))
    value, slope = value_and_slope(activation, F.col("logit").cast("double"))
    scored = df.withColumns({"z": value * factor, "_slope": slope * factor})
    per_anchor = measure_groups(scored, ["anchor_id"])
    top = group_totals(scored, ["anchor_id"], {"_top": F.max(z)}, "candidate_id", per_anchor)
    share = F.exp(z - F.col("_top"))
    total = group_totals(top, ["anchor_id"], {"_total": F.sum(share)}, "candidate_id", per_anchor)
    anchors = F.sum(F.col("is_positive").cast("long"))
    sized = group_totals(total, ["batch_id"], {"_anchors": anchors}, "candidate_id")
    pull = share / F.col("_total") - F.col("is_positive").cast("double")
    gradient = pull * F.col("_slope") / F.col("_anchors")
    return sized.withColumn("gradient", gradient).drop("z", "_slope", "_top", "_total", "_anchors")


# -- pairwise ------------------------------------------------------------------

@per_group(QUERY)
def with_gains(
    df: DataFrame,
    k: int | None,
    eps: float = EPS,
    score: str = "logit",
    tiebreak: str = "pos",
    *,
    sizes: GroupSizes,
) -> DataFrame:
    """Add ``rank`` by score and ``gain``: (2^label - 1) over the ideal DCG at k."""
    ranked = scan_groups(df, [QUERY], by_score(score, tiebreak), rank="rank", sizes=sizes)
    ranked = scan_groups(ranked, [QUERY], by_score("label", tiebreak), rank="_ideal", sizes=sizes)
    gain = rm.gain(rm.clamp(F.col("label"), low=0.0))
    within = F.lit(True) if k is None else F.col("_ideal") <= F.lit(k)
    ideal = F.sum(F.when(within, gain / rm.discount(F.col("_ideal"))).otherwise(0.0))
    total = group_totals(ranked, [QUERY], {"_idcg": ideal}, tiebreak, sizes)
    return total.withColumn("gain", gain / F.greatest("_idcg", F.lit(eps))).drop("_ideal", "_idcg")


#: Weights of pairs from numpy arrays: gains and ranks of the better and of the other item.
PairWeights = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Scheme:
    """How pairs weigh. Pairs have a better and a worse item, or are ``every_pair`` of a list."""

    weigh: PairWeights
    every_pair: bool = False


def _no_weights(gain_i, gain_j, rank_i, rank_j):
    return np.ones_like(gain_i)


def _discounted_gain(gain_i, gain_j, rank_i, rank_j):
    return gain_i / np.log2(1.0 + rank_i)


def _swapped(gain_i, gain_j, rank_i, rank_j):
    return np.abs(1.0 / np.log2(1.0 + rank_i) - 1.0 / np.log2(1.0 + rank_j)) * np.abs(gain_i - gain_j)


def _step_apart(gain_i, gain_j, rank_i, rank_j):
    apart = np.abs(rank_i - rank_j)
    near = np.maximum(apart, 1.0)
    step = np.where(apart > 0, 1.0 / np.log2(near + 1.0) - 1.0 / np.log2(near + 2.0), 0.0)
    return step * np.abs(gain_i - gain_j)


def step_and_swap(mu: float = NDCG2PP_MU) -> PairWeights:
    """The sum of both, the step ``mu`` times."""
    return lambda *pair: mu * _step_apart(*pair) + _swapped(*pair)


SCHEMES: dict[str, Scheme] = {
    "none": Scheme(_no_weights),
    "ndcg1": Scheme(_discounted_gain, every_pair=True),
    "ndcg2": Scheme(_step_apart),
    "lambdarank": Scheme(_swapped),
    "ndcg2pp": Scheme(step_and_swap()),
}


def register_scheme(name: str, weigh: PairWeights, every_pair: bool = False) -> None:
    """Make a weighting scheme known by name; the function goes to the tasks as it is."""
    if name in SCHEMES:
        raise ValueError(f"there is a scheme {name}")
    SCHEMES[name] = Scheme(weigh, every_pair)


def scheme_of(scheme: str | Scheme | PairWeights, mu: float = NDCG2PP_MU) -> Scheme:
    if isinstance(scheme, Scheme):
        return scheme
    if callable(scheme):
        return Scheme(scheme)
    if scheme not in SCHEMES:
        raise ValueError(f"scheme must be one of {tuple(SCHEMES)}")
    return Scheme(step_and_swap(mu)) if scheme == "ndcg2pp" else SCHEMES[scheme]


def lambda_loss_sums(df: DataFrame, scheme: str | Scheme | Callable = "ndcg2pp", mu: float = NDCG2PP_MU, **options) -> DataFrame:
    """Sum of the pair losses and number of pairs of each query.

    ``scheme`` is the name of a registered one, a :class:`Scheme`, or a function that weighs pairs;
    ``options`` are those of :func:`pair_loss_sums`.
    """
    found = pair_loss_sums(df, {"loss_sum": scheme_of(scheme, mu)}, **options)
    return found.select(QUERY, "loss_sum", "pairs")


@per_group(QUERY)
def pair_loss_sums(
    df: DataFrame,
    schemes: Mapping[str, Scheme],
    k: int | None = None,
    sigma: float = 1.0,
    eps: float = EPS,
    log: str = "binary",
    activation: Activation = None,
    block_rows: int = BLOCK_ROWS,
    *,
    sizes: GroupSizes,
) -> DataFrame:
    """Sums of the pair losses of each query under several schemes, and its ``pairs``, from one pass over the pairs.

    The schemes go through the same pairs: all of them through every pair, or none.
    """
    if len({scheme.every_pair for scheme in schemes.values()}) != 1:
        raise ValueError("schemes of one pass go through the same pairs")
    every_pair = any(scheme.every_pair for scheme in schemes.values())
    slim = _activated(df.select(QUERY, "pos", "label", "logit"), activation)
    orders = [by_score("logit", "pos"), by_score("label", "pos")]
    slim, sizes = head_rows(slim, [QUERY], orders, k or None, sizes)
    rows = with_gains(slim, k or None, eps, sizes=sizes)
    if k:
        rows = rows.where(F.col("rank") <= k)
        sizes = known_groups(rows, min(k, sizes.largest))
    rows = rows.select(
        QUERY, F.col("label").cast("double").alias("label"), "logit", "gain",
        F.col("rank").cast("double").alias("rank"),
    )
    unit = 1.0 if log == "natural" else np.log(2.0)
    floor = np.log(eps)

    def kernel(left: Side, right: Side) -> dict[str, pa.Array]:
        n = len(left.sizes)
        sums, pairs = {name: np.zeros(n) for name in schemes}, np.zeros(n, dtype=np.int64)
        a = {c: left.column(c) for c in ("logit", "gain", "rank")}
        b = a if right is left else {c: right.column(c) for c in a}
        rows_of, pairs_of = left.rows, all_pairs if every_pair else better_pairs
        for i, j in pairs_of(left, right):
            row = rows_of[i]
            diff = np.clip(a["logit"][i] - b["logit"][j], -rm.SCORE_DIFF_CLAMP, rm.SCORE_DIFF_CLAMP)
            log_p = np.maximum(-np.logaddexp(0.0, -sigma * diff), floor)
            for name, scheme in schemes.items():
                weight = scheme.weigh(a["gain"][i], b["gain"][j], a["rank"][i], b["rank"][j])
                value = np.maximum(weight * log_p, floor) / unit
                sums[name] -= np.bincount(row, weights=value, minlength=n)
            pairs += np.bincount(row, minlength=n)
        return {**{name: pa.array(values) for name, values in sums.items()}, "pairs": pa.array(pairs)}

    schema = ", ".join([*[f"`{name}` double" for name in schemes], "pairs long"])
    blocks = map_pair_blocks(
        rows, QUERY, "rank", ["label", "logit", "gain", "rank"], kernel, schema, sizes, block_rows)
    return blocks.groupBy(QUERY).agg(*[F.sum(name).alias(name) for name in [*schemes, "pairs"]])


def lambda_loss(df: DataFrame, scheme: str | Scheme | Callable = "ndcg2pp", **options) -> DataFrame:
    """One mean over the pairs of all queries; NULL without pairs."""
    sums = lambda_loss_sums(df, scheme, **options)
    return sums.agg(
        (F.sum("loss_sum") / F.nullif(F.sum("pairs"), F.lit(0))).alias("loss")
    )


def ranknet_loss(df: DataFrame, **options) -> DataFrame:
    """The pairwise logistic loss: every pair weighs the same."""
    return lambda_loss(df, scheme="none", **options)


# -- comparison ----------------------------------------------------------------

@dataclass(frozen=True)
class PointLoss:
    """The mean of a term of ``label`` and ``logit``; all such losses are one aggregate."""

    term: Callable[[Column, Column], Column]


@dataclass(frozen=True)
class ShareLoss:
    """ListNet: sums of exponentials of each list."""


@dataclass(frozen=True)
class ListLoss:
    """A list likelihood; all such losses share one scan of the lists and its running sums."""

    weight: ListWeight = None


@dataclass(frozen=True)
class PairLoss:
    """A pair loss; all such losses share ranks, gains and one pass over the pairs."""

    scheme: str | Scheme | PairWeights = "none"


Part = PointLoss | ShareLoss | ListLoss | PairLoss

LOSSES: dict[str, Part] = {
    "bce": PointLoss(rm.log_loss_with_logit),
    "mse": PointLoss(lambda label, logit: (logit - label) * (logit - label)),
    "listnet": ShareLoss(),
    "listmle": ListLoss(),
    "plistmle": ListLoss("exp2"),
    "ranknet": PairLoss(),
    "lambda": PairLoss("ndcg2pp"),
}


def loss_report(
    df: DataFrame, losses: Mapping[str, Part | Callable[[DataFrame], DataFrame]] | None = None
) -> DataFrame:
    """(loss_name, loss) for several losses over one scored table.

    The table is read once and its slim columns are stored. Losses given as parts then share
    what they need: one aggregate, one scan of the lists, one pass over the pairs. Losses given as
    functions of the table work on their own.
    """
    losses = dict(losses or LOSSES)
    parts = {name: loss for name, loss in losses.items() if isinstance(loss, Part)}
    reports = [
        loss(df).select(F.lit(name).alias("loss_name"), "loss") for name, loss in losses.items() if name not in parts
    ]
    if parts:
        reports += _shared(durable(_activated(df.select(QUERY, "pos", "label", "logit"), None)), parts)
    combined = reports[0]
    for report in reports[1:]:
        combined = combined.unionByName(report)
    return combined


def _shared(rows: DataFrame, parts: Mapping[str, Part]) -> list[DataFrame]:
    def of(kind: type) -> dict[str, Part]:
        return {name: part for name, part in parts.items() if isinstance(part, kind)}

    reports = []
    if points := of(PointLoss):
        reports.append(_long(rows.agg(*[
            F.avg(part.term(F.col("label"), F.col("logit"))).alias(name) for name, part in points.items()])))
    if shares := of(ShareLoss):
        found = listnet_per_query(rows)
        reports.append(_long(found.agg(*[F.avg("loss").alias(name) for name in shares])))
    grouped = {name: part for name, part in parts.items() if isinstance(part, ListLoss | PairLoss)}
    sizes = measure_groups(rows, [QUERY]) if grouped else None

    def split(work) -> DataFrame:
        return split_groups(rows, [QUERY], sizes, work)

    if lists := of(ListLoss):
        weights = {name: part.weight for name, part in lists.items()}
        found = split(lambda part, own: list_likelihoods(part, weights, sizes=own))
        reports.append(_long(found.agg(*[F.avg(name).alias(name) for name in weights])))
    schemes = {name: scheme_of(part.scheme) for name, part in of(PairLoss).items()}
    for every_pair in (False, True):
        mine = {name: scheme for name, scheme in schemes.items() if scheme.every_pair == every_pair}
        if mine:
            found = split(lambda part, own, mine=mine: pair_loss_sums(part, mine, sizes=own))
            pairs = F.nullif(F.sum("pairs"), F.lit(0))
            reports.append(_long(found.agg(*[(F.sum(name) / pairs).alias(name) for name in mine])))
    return reports


def _long(row: DataFrame) -> DataFrame:
    """One row of losses as (loss_name, loss)."""
    named = F.array(*[F.struct(F.lit(name).alias("loss_name"), F.col(f"`{name}`").alias("loss")) for name in row.columns])
    return row.select(F.explode(named).alias("_loss")).select("_loss.*")
