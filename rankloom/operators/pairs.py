"""Pairs of texts and pairs of documents.

Pairs inside a query are made as rows only within the first ``k`` places.
Over whole lists they are counted from label histograms here, and summed block
by block in the losses and gradients.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.keys import seeded_int
from rankloom.operators.ranking import QUERY, by_score
from rankloom.plans.groups import GroupSizes, group_totals, per_group, scan_groups, top_rows

# Rows of a side that may be sent to every executor.
BROADCAST_ROWS = 1_000_000
BATCH = "batch_id"


def pair_with_query(docs: DataFrame, query_id: int, query: str) -> DataFrame:
    """One query against every document of a table."""
    return docs.select(
        F.lit(query_id).cast("long").alias(QUERY),
        "doc_id",
        F.lit(query).alias("query"),
        F.col("text").alias("document"),
    )


def make_pairs(
    candidates: DataFrame,
    queries: DataFrame,
    corpus: DataFrame,
    n_candidates: int | None = None,
) -> DataFrame:
    """Add ``query`` and ``document`` texts to candidates (query_id, doc_id).

    With ``n_candidates`` known to be small their ids travel to the corpus,
    which is then not shuffled. Texts may be of any size and are never hinted
    to travel. Documents without text keep NULL.
    """
    texts = corpus.select("doc_id", F.col("text").alias("document"))
    asked = queries.select(QUERY, F.col("text").alias("query"))
    if n_candidates is None or n_candidates > BROADCAST_ROWS:
        joined = candidates.join(texts, "doc_id", "left")
    else:
        found = texts.join(F.broadcast(candidates.select("doc_id")), "doc_id", "left_semi")
        joined = candidates.join(found, "doc_id", "left")
    return joined.join(asked, QUERY, "left")


def _sides(df: DataFrame, k: int, score: str, tiebreak: str) -> tuple[DataFrame, DataFrame]:
    first = top_rows(df, [QUERY], by_score(score, tiebreak), k, "rank")
    left, right = (
        first.select(
            QUERY, *[F.col(c).alias(f"{c}_{side}") for c in ("doc_id", "label", "rank", score)]
        )
        for side in "ij"
    )
    return left, right


def preference_pairs(
    df: DataFrame, k: int, score: str = "score", tiebreak: str = "doc_id"
) -> DataFrame:
    """Pairs (i, j) of a query with label_i > label_j, both within the first ``k`` places.

    Both sides are cut before they meet, so a query gives at most k * k rows.
    """
    left, right = _sides(df, k, score, tiebreak)
    return left.join(right, QUERY).where(F.col("label_i") > F.col("label_j"))


def all_pairs(df: DataFrame, k: int, score: str = "score", tiebreak: str = "doc_id") -> DataFrame:
    """All ordered pairs within the first ``k`` places, a row with itself included."""
    left, right = _sides(df, k, score, tiebreak)
    return left.join(right, QUERY)


def pair_counts(df: DataFrame) -> DataFrame:
    """Ordered pairs and preference pairs of each whole list, from its label counts."""
    labels = df.groupBy(QUERY, "label").agg(F.count(F.lit(1)).alias("n"))
    n, same = F.sum("n"), F.sum(F.col("n") * F.col("n"))
    return labels.groupBy(QUERY).agg(
        (n * n).alias("all_pairs"), ((n * n - same) / 2).cast("long").alias("preference_pairs")
    )


@per_group(BATCH)
def in_batch_negatives(
    df: DataFrame,
    num_negatives: int | None = 4,
    seed: int = 12,
    drop_duplicates: bool = False,
    *,
    sizes: GroupSizes,
) -> DataFrame:
    """Negatives of each anchor, drawn from the other rows of its batch.

    Rows are (batch_id, anchor_id, anchor, positive[, negatives ARRAY]); every
    row of a batch must have as many negatives as the others. A batch of B
    rows with C candidates each offers (B - 1) * C negatives. Of these,
    ``num_negatives`` are drawn without replacement, or all are taken if there
    are no more than that (or None is given).

    The rows of a batch are numbered and each anchor draws numbers, so only
    the drawn candidates are joined and no pair of rows has to meet first. The
    draws follow from the seed and ``anchor_id``. Equal texts are kept apart
    only with ``drop_duplicates``.
    """
    candidates = F.array("positive")
    if "negatives" in df.columns:
        candidates = F.concat(candidates, F.coalesce("negatives", F.array().cast("array<string>")))
    slim = df.select(BATCH, "anchor_id", "anchor", "positive", candidates.alias("_own"))
    numbered = scan_groups(slim, [BATCH], [F.col("anchor_id")], rank="_rank", sizes=sizes)
    sized = group_totals(
        numbered, [BATCH], {"_rows": F.count(F.lit(1))}, "anchor_id", sizes
    )
    others = F.col("_rows") - 1
    offered = (others * F.size("_own")).cast("long")
    drawn = sized.select(
        BATCH, "anchor_id", "anchor", "positive", "_rank",
        others.alias("_others"),
        F.explode(_draws(offered, num_negatives, seed)).alias("_draw"),
    )
    step = F.pmod("_draw", F.col("_others")) + 1
    picks = drawn.select(
        BATCH, "anchor_id", "anchor", "positive",
        F.floor(F.col("_draw") / F.col("_others")).cast("int").alias("negative_col"),
        F.when(step >= F.col("_rank"), step + 1).otherwise(step).alias("_rank"),
    )
    owners = numbered.select(
        BATCH, F.col("_rank").cast("long").alias("_rank"),
        F.col("anchor_id").alias("negative_owner"), "_own",
    )
    joined = picks.join(owners, [BATCH, "_rank"]).select(
        BATCH, "anchor_id", "anchor", "positive", "negative_owner", "negative_col",
        F.element_at("_own", F.col("negative_col") + 1).alias("negative"),
    )
    return joined.where(F.col("negative") != F.col("positive")) if drop_duplicates else joined


def _draws(offered, num_negatives, seed):
    """Distinct numbers below ``offered``, each set equally likely."""
    none = F.array().cast("array<bigint>")
    everything = F.when(offered > 0, F.sequence(F.lit(0).cast("long"), offered - 1)).otherwise(none)
    if num_negatives is None:
        return everything
    raw = F.array(*[
        F.pmod(
            seeded_int(seed, F.col("anchor_id"), F.lit(t)),
            F.greatest(offered - t, F.lit(1).cast("long")),
        )
        for t in range(num_negatives)
    ])
    # A draw counts only the numbers still free: step over each one taken.
    distinct = F.aggregate(
        raw,
        none,
        lambda taken, draw: F.array_sort(F.array_append(
            taken, F.aggregate(taken, draw, lambda x, t: F.when(t <= x, x + 1).otherwise(x))
        )),
    )
    return F.when(offered <= num_negatives, everything).otherwise(distinct)
