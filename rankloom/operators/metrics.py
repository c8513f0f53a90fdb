"""Ranking metrics over judgments (query_id, doc_id, label, score)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import rank_math as rm
from rankloom.operators.ranking import QUERY, by_score, positions, running_hits
from rankloom.plans.groups import GroupSizes, group_totals, head_rows, per_group, scan_groups


def _judged(df: DataFrame, score: str = "score") -> DataFrame:
    """The columns that a metric needs; nothing else is ranked or stored."""
    return df.select(QUERY, "doc_id", "label", score)


def _within(rank: str, k: int | None) -> Column:
    return F.lit(True) if k is None else F.col(rank) <= F.lit(k)


def _gain_sum(rank: str, k: int | None) -> Column:
    term = rm.gain(F.col("label")) / rm.discount(F.col(rank))
    return F.sum(F.when(_within(rank, k), term).otherwise(0.0))


def _name(metric: str, k: int | None) -> str:
    return metric if k is None else f"{metric}_at_{k}"


@per_group(QUERY)
def dcg(
    df: DataFrame, k: int | None = None, score: str = "score", *, sizes: GroupSizes
) -> DataFrame:
    """DCG of each query: sum over the first k of (2^label - 1) / log2(rank + 1)."""
    rows, sizes = head_rows(_judged(df, score), [QUERY], [by_score(score)], k, sizes)
    ranked = scan_groups(rows, [QUERY], by_score(score), rank="rank", sizes=sizes)
    return ranked.groupBy(QUERY).agg(_gain_sum("rank", k).alias(_name("dcg", k)))


@per_group(QUERY)
def ndcg(
    df: DataFrame,
    ks: int | None | Sequence[int | None] = None,
    ideal: str = "full",
    score: str = "score",
    *,
    sizes: GroupSizes,
) -> DataFrame:
    """NDCG of each query at one cutoff or several, in one pass.

    ``ideal="full"`` sorts the whole list by label and cuts it at k;
    ``ideal="truncated"`` cuts the ranked list at k and sorts what is left.
    An ideal DCG of 0 gives 0.
    """
    cutoffs = list(ks) if isinstance(ks, (list, tuple)) else [ks]
    deepest = None if None in cutoffs else max(cutoffs)
    rows, orders = _judged(df, score), [by_score(score), by_score("label")]
    if ideal == "full":
        rows, sizes = head_rows(rows, [QUERY], orders, deepest, sizes)
        ranked = positions(rows, score=score, sizes=sizes)
        return _ratio(ranked, cutoffs, {k: "ideal_rank" for k in cutoffs}, ideal)
    if ideal != "truncated":
        raise ValueError("ideal must be 'full' or 'truncated'")
    rows, sizes = head_rows(rows, [QUERY], orders[:1], deepest, sizes)
    ranked = scan_groups(rows, [QUERY], by_score(score), rank="rank", sizes=sizes)
    names = {}
    for k in cutoffs:
        names[k] = _name("_ideal_rank", k)
        first = F.when(_within("rank", k), 0).otherwise(1)
        ranked = scan_groups(
            ranked, [QUERY], [first, *by_score("label")], rank=names[k], sizes=sizes
        )
    return _ratio(ranked, cutoffs, names, ideal)


def _ratio(ranked, cutoffs, ideal_names, ideal):
    sums = []
    for k in cutoffs:
        sums.append(_gain_sum("rank", k).alias(_name("_dcg", k)))
        sums.append(_gain_sum(ideal_names[k], k).alias(_name("_idcg", k)))
    per_query = ranked.groupBy(QUERY).agg(*sums)
    out = []
    for k in cutoffs:
        top, bottom = F.col(_name("_dcg", k)), F.col(_name("_idcg", k))
        defined = bottom != 0 if ideal == "full" else bottom > 0
        out.append(F.when(defined, top / bottom).otherwise(0.0).alias(_name("ndcg", k)))
    return per_query.select(QUERY, *out)


def mean_ndcg(df: DataFrame, k: int = 10) -> DataFrame:
    name = _name("ndcg", k)
    return ndcg(df, k).agg(F.coalesce(F.avg(name), F.lit(0.0)).alias(f"mean_{name}"))


@per_group(QUERY)
def reciprocal_rank(
    df: DataFrame,
    k: int | None = None,
    min_rel: float = 1,
    score: str = "score",
    *,
    sizes: GroupSizes,
) -> DataFrame:
    """1 / rank of the first relevant row of each query, 0 without one."""
    rows, sizes = head_rows(_judged(df, score), [QUERY], [by_score(score)], k, sizes)
    ranked = scan_groups(rows, [QUERY], by_score(score), rank="rank", sizes=sizes)
    return ranked.groupBy(QUERY).agg(_reciprocal(k, min_rel).alias("rr"))


def _reciprocal(k, min_rel):
    hit = rm.is_relevant(F.col("label"), min_rel) & _within("rank", k)
    return F.coalesce(F.lit(1.0) / F.min(F.when(hit, F.col("rank"))), F.lit(0.0))


def mrr(df: DataFrame, k: int | None = None, min_rel: float = 1) -> DataFrame:
    """Mean reciprocal rank; 0 over no queries."""
    per_query = reciprocal_rank(df, k, min_rel)
    return per_query.agg(F.coalesce(F.avg("rr"), F.lit(0.0)).alias("mrr"))


@per_group(QUERY)
def average_precision(
    df: DataFrame,
    k: int | None = None,
    denominator: str = "hits",
    min_rel: float = 1,
    score: str = "score",
    *,
    sizes: GroupSizes,
) -> DataFrame:
    """Average precision of each query.

    ``denominator="hits"`` divides by the relevant rows found in the first k,
    ``"all_relevant"`` by all relevant rows. A query whose labels sum to 0
    scores 0.
    """
    ranked = running_hits(_judged(df, score), min_rel, score, sizes=sizes)
    return ranked.groupBy(QUERY).agg(_precision_mean(k, denominator, min_rel).alias("ap"))


def _precision_mean(k, denominator, min_rel):
    relevant = rm.is_relevant(F.col("label"), min_rel)
    precision = F.when(relevant & _within("rank", k), F.col("hits") / F.col("rank"))
    if denominator == "hits":
        mean = F.avg(precision)
    elif denominator == "all_relevant":
        mean = F.sum(precision) / F.sum(relevant.cast("long"))
    else:
        raise ValueError("denominator must be 'hits' or 'all_relevant'")
    return F.when(F.sum("label") == 0, 0.0).otherwise(F.coalesce(mean, F.lit(0.0)))


def map_score(df: DataFrame, k: int | None = None, min_rel: float = 1) -> DataFrame:
    """Mean average precision; 0 over no queries."""
    per_query = average_precision(df, k, min_rel=min_rel)
    return per_query.agg(F.coalesce(F.avg("ap"), F.lit(0.0)).alias(_name("map", k)))


@per_group(QUERY)
def ranking_report(
    df: DataFrame, k: int = 10, min_rel: float = 1, *, sizes: GroupSizes
) -> DataFrame:
    """NDCG@k, reciprocal rank and AP@k of each query from one shuffle by query."""
    ranked = running_hits(_judged(df), min_rel, sizes=sizes)
    ranked = scan_groups(ranked, [QUERY], by_score("label"), rank="ideal_rank", sizes=sizes)
    per_query = ranked.groupBy(QUERY).agg(
        _gain_sum("rank", k).alias("_dcg"),
        _gain_sum("ideal_rank", k).alias("_idcg"),
        _reciprocal(None, min_rel).alias("rr"),
        _precision_mean(k, "hits", min_rel).alias("ap"),
    )
    ratio = F.when(F.col("_idcg") != 0, F.col("_dcg") / F.col("_idcg")).otherwise(0.0)
    return per_query.select(QUERY, ratio.alias(_name("ndcg", k)), "rr", "ap")


@per_group(QUERY)
def precision_at(df: DataFrame, k: int, min_rel: float = 1, *, sizes: GroupSizes) -> DataFrame:
    """Share of the first k places that hold a relevant row."""
    rows, sizes = head_rows(_judged(df), [QUERY], [by_score()], k, sizes)
    ranked = scan_groups(rows, [QUERY], by_score(), rank="rank", sizes=sizes)
    hit = (rm.is_relevant(F.col("label"), min_rel) & _within("rank", k)).cast("long")
    return ranked.groupBy(QUERY).agg((F.sum(hit) / F.lit(k)).alias("precision"))


@per_group(QUERY)
def recall_at(df: DataFrame, k: int, min_rel: float = 1, *, sizes: GroupSizes) -> DataFrame:
    """Share of the relevant rows found in the first k places; 0 without any."""
    ranked = scan_groups(_judged(df), [QUERY], by_score(), rank="rank", sizes=sizes)
    relevant = rm.is_relevant(F.col("label"), min_rel)
    found = F.sum((relevant & _within("rank", k)).cast("long"))
    wanted = F.sum(relevant.cast("long"))
    return ranked.groupBy(QUERY).agg(
        F.when(wanted > 0, found / wanted).otherwise(0.0).alias("recall")
    )


@per_group(QUERY)
def precision_above_mean(df: DataFrame, score: str = "score", *, sizes: GroupSizes) -> DataFrame:
    """Share of the scores of each query that exceed the mean of its scores."""
    with_mean = group_totals(df, [QUERY], {"_mean": F.avg(score)}, "doc_id", sizes)
    above = (F.col(score) > F.col("_mean")).cast("double")
    return with_mean.groupBy(QUERY).agg(F.avg(above).alias("precision_above_mean"))


@per_group(QUERY)
def ndcg_random(df: DataFrame, k: int | None = None, *, sizes: GroupSizes) -> DataFrame:
    """Expected NDCG of a random order: each place holds the mean gain."""
    rows = df.select(QUERY, "doc_id", "label")
    ranked = scan_groups(rows, [QUERY], by_score("label"), rank="rank", sizes=sizes)
    place = F.lit(1.0) / rm.discount(F.col("rank"))
    places = F.sum(F.when(_within("rank", k), place).otherwise(0.0))
    per_query = ranked.groupBy(QUERY).agg(
        (F.avg(rm.gain(F.col("label"))) * places).alias("_dcg"),
        _gain_sum("rank", k).alias("_idcg"),
    )
    ratio = F.when(F.col("_idcg") != 0, F.col("_dcg") / F.col("_idcg")).otherwise(0.0)
    return per_query.select(QUERY, ratio.alias("ndcg_random"))


@per_group(QUERY)
def _reranked_sums(
    documents: DataFrame, k: int, base: str, reranked: str, *, sizes: GroupSizes
) -> DataFrame:
    """DCG, reciprocal rank and AP of both orders, per query."""
    hits = F.col("label").cast("long")
    both = scan_groups(
        documents.select(QUERY, "doc_id", "label", "n_positives", base, reranked), [QUERY], [F.col(base).asc(), F.col("doc_id").asc()], rank="base_rank",
        running={"base_hits": hits}, sizes=sizes,
    )
    both = scan_groups(
        both, [QUERY], [F.col(reranked).desc(), F.col("base_rank").asc()], rank="new_rank",
        running={"new_hits": hits}, sizes=sizes,
    )
    aggs = []
    for side in ("base", "new"):
        rank, hits_to = F.col(f"{side}_rank"), F.col(f"{side}_hits")
        hit = F.col("label") == 1
        aggs += [
            F.sum(F.when(hit & (rank <= k), F.lit(1.0) / rm.discount(rank)).otherwise(0.0))
            .alias(f"{side}_dcg"),
            F.coalesce(F.lit(1.0) / F.min(F.when(hit & (rank <= k), rank)), F.lit(0.0))
            .alias(f"{side}_rr"),
            (F.coalesce(F.sum(F.when(hit, hits_to / rank)), F.lit(0.0))
             / F.greatest(F.max("n_positives"), F.lit(1))).alias(f"{side}_ap"),
        ]
    return both.groupBy(QUERY).agg(F.max("n_positives").alias("n_positives"), *aggs)


def evaluate_reranking(
    documents: DataFrame,
    k: int = 10,
    base: str = "pos",
    reranked: str = "cross_score",
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Metrics of the base order and of the reranked order of each query.

    ``documents`` holds (query_id, doc_id, pos, label 0/1, n_positives and the
    reranked score). ``pos`` is the base order. Positives that are not among
    the documents have no rank, but count in the ideal DCG and as a
    denominator of AP.
    """
    per_query = _reranked_sums(documents, k, base, reranked, sizes=sizes)
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(F.col("n_positives"), F.lit(k)), F.lit(1))),
        F.lit(0.0),
        lambda total, place: total + F.lit(1.0) / rm.discount(place),
    )
    means = per_query.agg(*[
        F.coalesce(F.avg(value), F.lit(0.0)).alias(f"{side}_{metric}")
        for side in ("base", "new")
        for metric, value in (
            (f"ndcg@{k}", F.col(f"{side}_dcg") / ideal),
            (f"mrr@{k}", F.col(f"{side}_rr")),
            ("map", F.col(f"{side}_ap")),
        )
    ])
    rows = F.array(*[
        F.struct(
            F.lit("base" if name.startswith("base_") else "reranked").alias("evaluator"),
            F.lit(name.split("_", 1)[1]).alias("metric"),
            F.col(f"`{name}`").alias("value"),
        )
        for name in means.columns
    ])
    return means.select(F.inline(rows))


def evaluate_by_dataset(per_query: DataFrame, value: str, dataset: str = "dataset") -> DataFrame:
    """Mean of a per-query metric in each dataset, and the unweighted mean of datasets."""
    sets = per_query.groupBy(dataset).agg(F.avg(value).alias(value))
    mean = sets.agg(F.avg(value).alias(value)).select(F.lit("mean").alias(dataset), value)
    return sets.select(F.col(dataset).cast("string").alias(dataset), value).unionByName(mean)


def combine_reports(*reports: DataFrame) -> DataFrame:
    """One table of (evaluator, metric, value) from several evaluators."""
    combined = reports[0]
    for report in reports[1:]:
        combined = combined.unionByName(report)
    return combined.select("evaluator", "metric", F.col("value").cast("double").alias("value"))


def best_iteration(history: DataFrame, metric: str) -> DataFrame:
    """The round with the highest value of a metric, the earliest of equal ones."""
    best = F.max(F.struct(F.col(metric).alias("value"), (-F.col("round")).alias("minus")))
    return history.agg(best.alias("b")).select(
        (-F.col("b.minus")).alias("round"), F.col("b.value").alias(metric)
    )
