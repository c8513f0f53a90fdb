"""Hard negatives for training rankers.

For each (query, positive) pair the passages most similar to the query are
looked through: those ranked after ``range_min`` and up to ``range_max`` in the
whole corpus, that are no positive of the query, and whose similarity is at
most that of the positive less the margin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.keys import seeded_hash
from rankloom.functions.vectors import cosine
from rankloom.operators.inverted_file import InvertedFile
from rankloom.operators.ranking import QUERY
from rankloom.operators.retrieval import query_shape, retrieve_counted
from rankloom.operators.scorers import PairScorer
from rankloom.plans.groups import salted_join

BROADCAST_BYTES = 64 * 1024 * 1024
FORMATS = ("labeled-pair", "triplet", "n-tuple", "labeled-list")


def _join_queries(rows: DataFrame, per_query: DataFrame, n_bytes: int) -> DataFrame:
    """Join a table of one row per query, of at most ``n_bytes`` in all."""
    if n_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(per_query), QUERY)
    return salted_join(rows, per_query, [QUERY], "doc_id")


def mine_hard_negatives(
    pairs: DataFrame,
    queries: DataFrame,
    corpus: DataFrame,
    num_negatives: int = 5,
    range_min: int = 0,
    *,
    range_max: int,
    absolute_margin: float | None = None,
    sampling: str = "top",
    include_positives: bool = False,
    seed: int = 12,
    index: InvertedFile | None = None,
) -> DataFrame:
    """Mine up to ``num_negatives`` passages per pair.

    ``pairs`` has (query_id, doc_id) of the positives, ``queries`` and
    ``corpus`` have embeddings. ``range_max`` is the depth of the search, which
    a margin may need to be far larger than ``num_negatives``. ``sampling="top"`` takes the most
    similar, ``"random"`` a seeded choice. ``include_positives`` leaves
    positives at their place in the list and applies no margin. An ``index`` of the corpus is
    searched instead of all of it, with the same result.

    Gives (query_id, doc_id, negative_id, negative_score, negative_rank, place).
    Only the candidate lists, ``range_max`` long, are made per query; the pairs
    choose from them in place.
    """
    if sampling not in ("top", "random"):
        raise ValueError("sampling must be 'top' or 'random'")
    depth = range_max
    if index is None:
        found, shape = retrieve_counted(queries, corpus, depth)
    else:
        found, shape = index.search(queries, depth), query_shape(queries)
    found = found.where(F.col("stage1_rank") > range_min)
    if not include_positives:
        found = found.join(pairs.select(QUERY, "doc_id"), [QUERY, "doc_id"], "left_anti")
    item = F.struct(
        F.col("stage1_rank").alias("rank"), F.col("doc_id").alias("id"), F.col("bi_score").alias("score")
    )
    lists = found.groupBy(QUERY).agg(F.array_sort(F.collect_list(item)).alias("_found"))
    rows = _join_queries(pairs.select(QUERY, "doc_id"), lists, shape.n * depth * 24)
    chosen = F.col("_found")
    if absolute_margin is not None and not include_positives:
        asked = queries.select(QUERY, F.col("embedding").alias("_asked"))
        rows = _join_queries(rows, asked, shape.n * shape.dims * 8)
        own = corpus.select("doc_id", "embedding").join(pairs.select("doc_id"), "doc_id", "left_semi")
        rows = rows.join(own, "doc_id")
        rows = rows.withColumn("_own", cosine(F.col("_asked"), F.col("embedding")))
        chosen = F.filter(
            chosen, lambda x: x["score"] <= F.col("_own") - F.lit(float(absolute_margin))
        )
    if sampling == "random":
        keyed = F.transform(chosen, lambda x: F.struct(
            seeded_hash(seed, F.col(QUERY), F.col("doc_id"), x["id"]).alias("key"), x.alias("x")
        ))
        first = F.slice(F.array_sort(keyed), 1, num_negatives)
        chosen = F.array_sort(F.transform(first, lambda x: x["x"]))
    picked = rows.select(
        QUERY, "doc_id", F.posexplode(F.slice(chosen, 1, num_negatives)).alias("_at", "_x")
    )
    return picked.select(
        QUERY, "doc_id",
        F.col("_x.id").alias("negative_id"),
        F.col("_x.score").alias("negative_score"),
        F.col("_x.rank").alias("negative_rank"),
        (F.col("_at") + 1).alias("place"),
    )


def shape_negatives(
    mined: DataFrame, fmt: str, num_negatives: int = 5, pairs: DataFrame | None = None
) -> DataFrame:
    """Bring mined negatives to a training shape, by document ids.

    ``pairs`` are the positives that were mined for. The labeled shapes keep every one
    of them, with or without negatives, and so need them.

    ``labeled-pair``: (query_id, doc_id, label); ``triplet``: (query_id,
    positive_id, negative_id); ``n-tuple``: (query_id, positive_id, negatives
    ARRAY), without pairs that have fewer than ``num_negatives``;
    ``labeled-list``: (query_id, docs ARRAY, labels ARRAY), positive first.
    """
    if fmt == "triplet":
        return mined.select(QUERY, F.col("doc_id").alias("positive_id"), "negative_id")
    if fmt in ("labeled-pair", "labeled-list") and pairs is None:
        raise ValueError(f"{fmt} needs the pairs")
    if fmt == "labeled-pair":
        own = pairs.select(QUERY, "doc_id", F.lit(1).alias("label"))
        others = mined.select(QUERY, F.col("negative_id").alias("doc_id"), F.lit(0).alias("label"))
        return own.unionByName(others)
    if fmt == "labeled-list":
        # One row per pair and negative, and one with nothing for each pair.
        nothing = [F.lit(None).cast(mined.schema[c].dataType).alias(c) for c in ("negative_id", "place")]
        mined = mined.select(QUERY, "doc_id", "negative_id", "place").unionByName(
            pairs.select(QUERY, "doc_id", *nothing))
    found = F.when(F.col("place").isNotNull(), F.struct("place", "negative_id"))
    ordered = F.array_sort(F.collect_list(found))
    grouped = mined.groupBy(QUERY, F.col("doc_id").alias("positive_id")).agg(
        F.transform(ordered, lambda x: x["negative_id"]).alias("negatives")
    )
    if fmt == "n-tuple":
        return grouped.where(F.size("negatives") == num_negatives)
    if fmt == "labeled-list":
        zeros = F.array_repeat(F.lit(0), F.size("negatives"))
        return grouped.select(
            QUERY,
            F.concat(F.array("positive_id"), "negatives").alias("docs"),
            F.concat(F.array(F.lit(1)), zeros).alias("labels"),
        )
    raise ValueError(f"fmt must be one of {FORMATS}")


def short_tuples(mined: DataFrame, pairs: DataFrame, num_negatives: int = 5) -> DataFrame:
    """Number of pairs, and of those with too few negatives for an n-tuple."""
    complete = mined.where(F.col("place") == num_negatives).agg(F.count(F.lit(1)).alias("complete"))
    total = pairs.agg(F.count(F.lit(1)).alias("pairs"))
    joined = total.withColumn("_one", F.lit(1)).join(complete.withColumn("_one", F.lit(1)), "_one")
    return joined.select("pairs", (F.col("pairs") - F.col("complete")).alias("short"))


def teacher_margins(
    triplets: DataFrame,
    scorer: PairScorer,
    query: str = "query",
    positive: str = "positive",
    negative: str = "negative",
) -> DataFrame:
    """Add ``margin``: the score of (query, positive) less that of (query, negative)."""
    own = scorer(F.col(query), F.col(positive))
    return triplets.withColumn("margin", own - scorer(F.col(query), F.col(negative)))
