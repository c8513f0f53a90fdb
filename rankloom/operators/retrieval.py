"""Two-stage retrieval: vector top-k, then re-ranking by a pair scorer.

The corpus is read once per block of queries and never shuffled: a block of
query vectors of bounded size (64 MB) goes to every executor, each task multiplies it
with its part of the corpus and keeps the best ``k`` documents per query, and
only those are shuffled. More queries than may be sent around are cut into blocks
that meet the corpus in a shuffle, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.vectors import SCORE_DIGITS
from rankloom.operators.cells import CellIndex
from rankloom.operators.pairs import make_pairs
from rankloom.operators.ranking import QUERY, by_score
from rankloom.operators.scorers import PairScorer, score_pairs
from rankloom.plans.groups import known_groups, scan_groups, top_rows

QUERY_BLOCK_BYTES = 64 * 1024 * 1024
# Blocks of queries that may be sent around, all of which pass through the driver and stay
# until the result is dropped; beyond that both sides are shuffled.
BROADCAST_BLOCKS = 1
CORPUS_BLOCK_ROWS = 100_000
SCORES_AT_ONCE = 4_000_000

_SCORED = f"{QUERY} long, doc_id long, bi_score double"


@dataclass(frozen=True)
class QueryShape:
    """Number of queries, length of their vectors, and blocks they make."""

    n: int
    dims: int
    blocks: int


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1. Zero rows and rows that are not finite are zero, so their cosine is 0."""
    finite = np.isfinite(vectors).all(axis=1, keepdims=True)
    vectors = np.where(finite, vectors, 0.0)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms > 0, norms, 1.0)


def as_matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def query_shape(vectors: DataFrame) -> QueryShape:
    row = vectors.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dims")
    ).first()
    n, dims = row["n"], row["dims"] or 0
    per_block = max(1, QUERY_BLOCK_BYTES // (8 * max(dims, 1)))
    return QueryShape(n, dims, -(-n // per_block))


def query_blocks(
    vectors: DataFrame, shape: QueryShape
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The queries as (ids, unit vectors), in blocks of bounded size."""
    for block in range(shape.blocks):
        part = vectors
        if shape.blocks > 1:
            part = vectors.where(F.pmod(F.xxhash64(QUERY), F.lit(shape.blocks)) == block)
        table = part.toArrow()
        if table.num_rows:
            ids = table.column(QUERY).to_numpy().astype(np.int64)
            yield ids, unit_rows(as_matrix(table.column("embedding").combine_chunks()))


class BestRows:
    """The best ``k`` documents per query of what a task has seen."""

    MERGE_AT = 1 << 20

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.floor = np.full(n_queries, -np.inf)
        self.best = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))
        self.pending, self.n_pending = [], 0

    def add(self, queries: np.ndarray, docs: np.ndarray, scores: np.ndarray) -> None:
        """Take in a matrix of scores (queries x docs)."""
        floor = self.floor[queries]
        if len(docs) > self.k:
            kth = np.partition(scores, len(docs) - self.k, axis=1)[:, len(docs) - self.k]
            floor = np.maximum(floor, kth)
        q, d = np.nonzero(scores >= floor[:, None])
        self.pending.append((queries[q], docs[d], scores[q, d]))
        self.n_pending += len(q)
        if self.n_pending > max(self.MERGE_AT, len(self.best[0])):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rank what has come in, drop what lies past ``k``, and return the rest."""
        query, doc, score = (np.concatenate(c) for c in zip(self.best, *self.pending))
        order = np.lexsort((doc, -score, query))
        query, doc, score = query[order], doc[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        last = place == self.k - 1
        self.floor[query[last]] = score[last]
        kept = place < self.k
        self.best = (query[kept], doc[kept], score[kept])
        self.pending, self.n_pending = [], 0
        return self.best


def _scores(ids, vectors, batch, docs_at_once, probes):
    """(query rows, document ids, score matrix) of one corpus batch, in slabs."""
    docs = batch.column("doc_id").to_numpy().astype(np.int64)
    corpus = unit_rows(as_matrix(batch.column("embedding")))
    everyone = np.arange(len(ids))
    cells = batch.column("cell").to_numpy() if probes is not None else None
    for start in range(0, len(docs), docs_at_once):
        slab = slice(start, start + docs_at_once)
        if cells is None:
            yield everyone, docs[slab], np.round(vectors @ corpus[slab].T, SCORE_DIGITS)
            continue
        for cell in np.unique(cells[slab]):
            asking = np.nonzero(probes[:, cell])[0]
            inside = cells[slab] == cell
            if len(asking):
                scores = vectors[asking] @ corpus[slab][inside].T
                yield asking, docs[slab][inside], np.round(scores, SCORE_DIGITS)


def cosine_scores(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Cosine of every query with every document, one row each.

    This is as large as it sounds; ``retrieve`` keeps only the best of them.
    """
    return _over_blocks(queries, corpus, k=None, index=None)[0]


def retrieve(
    queries: DataFrame, corpus: DataFrame, k: int = 20, index: CellIndex | None = None
) -> DataFrame:
    """The ``k`` most similar documents of each query.

    Gives (query_id, doc_id, bi_score, stage1_rank); equal scores rank by
    ``doc_id``. With an ``index`` only the cells near a query are searched:
    the result is approximate. If the corpus has a ``cell`` column (as written
    by ``index.assign``, best partitioned by it), other cells are not read.
    """
    return retrieve_counted(queries, corpus, k, index)[0]


def retrieve_counted(queries, corpus, k, index=None) -> tuple[DataFrame, QueryShape]:
    """As :func:`retrieve`, with the shape of the queries."""
    scored, shape = _over_blocks(queries, corpus, k, index)
    return top_rows(scored, [QUERY], by_score("bi_score"), k, "stage1_rank"), shape


def _over_blocks(queries, corpus, k, index):
    if index is not None and "cell" not in corpus.columns:
        corpus = index.assign(corpus)
    rows = corpus.select("doc_id", "embedding", *(["cell"] if index else []))
    rows = rows.where(F.col("embedding").isNotNull())
    vectors = queries.select(QUERY, "embedding").where(F.col("embedding").isNotNull())
    # Encoded once: the vectors are counted first and then fetched block by block.
    vectors.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        shape = query_shape(vectors)
        if shape.blocks <= BROADCAST_BLOCKS:
            return _with_broadcast_blocks(vectors, rows, k, index, shape), shape
    finally:
        vectors.unpersist()
    return _with_shuffled_blocks(vectors, rows, k, index, shape), shape


def _with_broadcast_blocks(vectors, rows, k, index, shape):
    """Send the query blocks to the corpus, which is read once per block."""
    context, result = rows.sparkSession.sparkContext, None
    for ids, block in query_blocks(vectors, shape):
        probes = index.probes(block) if index else None
        part = rows
        if index:
            asked = np.nonzero(probes.any(axis=0))[0].tolist()
            part = rows.where(F.col("cell").isin(asked))
        shared = context.broadcast((ids, block, probes))
        scored = part.mapInArrow(_block_scorer(shared, k), _SCORED)
        result = scored if result is None else result.unionByName(scored)
    return rows.sparkSession.createDataFrame([], _SCORED) if result is None else result


def _with_shuffled_blocks(vectors, rows, k, index, shape):
    """Bring every block of queries together with every block of the corpus.

    For more queries than may be sent around. Both sides are cut into blocks
    of bounded size by a hash of their ids, and each pair of blocks is one
    group; nothing passes through the driver.
    """
    query_parts = shape.blocks
    corpus_parts = max(1, -(-rows.count() // CORPUS_BLOCK_ROWS))

    def spread(df, key, own, n_own, other, n_other):
        partners = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))
        part = F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int")
        return df.withColumn(own, part).withColumn(other, partners).groupBy("_queries", "_docs")

    def score(asked: pa.Table, docs: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows and docs.num_rows:
            ids = asked.column(QUERY).to_numpy().astype(np.int64)
            block = unit_rows(as_matrix(asked.column("embedding").combine_chunks()))
            probes = index.probes(block) if index else None
            found = list(_found(ids, block, probes, docs.to_batches(), k))
        return pa.Table.from_batches(found, _rows([], [], []).schema)

    left = spread(vectors, QUERY, "_queries", query_parts, "_docs", corpus_parts)
    right = spread(rows, "doc_id", "_docs", corpus_parts, "_queries", query_parts)
    return left.cogroup(right).applyInArrow(score, _SCORED)


def _block_scorer(shared, k):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _found(*shared.value, batches, k)

    return run


def _found(ids, vectors, probes, batches, k):
    """Scores of the documents for the queries: the best ``k`` per query, or all."""
    docs_at_once = max(1, SCORES_AT_ONCE // len(ids))
    best = BestRows(len(ids), k) if k else None
    for batch in batches:
        if not batch.num_rows or k == 0:
            continue
        for asking, docs, scores in _scores(ids, vectors, batch, docs_at_once, probes):
            if best is None:
                yield _rows(
                    np.repeat(ids[asking], len(docs)), np.tile(docs, len(asking)), scores.ravel()
                )
            else:
                best.add(asking, docs, scores)
    if best is not None:
        query, doc, score = best.merge()
        yield _rows(ids[query], doc, score)


def _rows(query, doc, score):
    return pa.RecordBatch.from_pydict({
        QUERY: pa.array(query, pa.int64()),
        "doc_id": pa.array(doc, pa.int64()),
        "bi_score": pa.array(score, pa.float64()),
    })


def rerank(
    candidates: DataFrame,
    scorer: PairScorer,
    k: int | None = None,
    tiebreak: str = "stage1_rank",
    largest: int | None = None,
) -> DataFrame:
    """Score (query, document) pairs and rank them by falling ``cross_score``.

    ``k=None`` keeps all rows, 0 keeps none. Equal scores keep the order of
    ``tiebreak``. ``largest`` states a known bound of candidates per query.
    """
    scored = score_pairs(candidates, scorer, out="cross_score")
    order = by_score("cross_score", tiebreak)
    if k is None:
        sizes = known_groups(candidates, largest) if largest else None
        ranked = scan_groups(scored, [QUERY], order, rank="final_rank", sizes=sizes)
    else:
        ranked = top_rows(scored, [QUERY], order, k, "final_rank")
    return ranked.withColumn("final_rank", F.col("final_rank").cast("int"))


def two_stage(
    queries: DataFrame,
    corpus: DataFrame,
    scorer: PairScorer,
    initial_k: int = 20,
    final_k: int | None = 5,
    texts: DataFrame | None = None,
) -> DataFrame:
    """Retrieve ``initial_k`` documents per query, re-rank them, keep ``final_k``.

    The scorer sees only the retrieved rows. Texts come from ``texts`` (doc_id,
    text), or from the corpus itself, and are joined after retrieval, so the
    vector scan reads ids and vectors only.
    """
    found, shape = retrieve_counted(queries, corpus, initial_k)
    source = corpus if texts is None else texts
    pairs = make_pairs(found, queries, source, shape.n * initial_k)
    return rerank(pairs, scorer, final_k, largest=initial_k)
