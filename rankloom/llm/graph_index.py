"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Vectors are dealt to shards of bounded size. A shard's graph is over its distinct vectors;
each has the list of its ids, which a search expands, the smallest first. All is
done in double precision on centred, scaled vectors, so no two become one. Every vector starts from random
edges; greedy beam searches through the graph so far propose neighbours, and relaxed
distance pruning keeps those that no kept edge makes needless: a candidate goes if a kept
neighbour is closer to it, times ``relax``, than the vector itself. Edges run back as
well and are pruned again when a vector has too many. A first pass prunes with a
factor of one, a second with ``relax``.

Queries come in blocks, and each block meets every shard, in slots that hold several: the beam search runs for all
queries of a block in lockstep. What a search finds is ordered by exact distances in double
precision on the original vectors, and the best of all shards are kept.

Edge cases: vectors that are null, zero, of another length than the most, or hold null or
non-finite components take no part, neither as queries nor as candidates; the same holds
for a null ``vec_id``; of rows with one ``vec_id`` each is a candidate of its own, but none
answers a query with its id; ties go to the smaller ``vec_id``; an empty table or a lone
vector gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import stored

SHARD_ROWS = 2048
DEGREE, BEAM, RELAX = 32, 64, 1.2
#: Queries searched together, and vectors inserted together.
BLOCK = 512
#: Blocks of queries that a task holds while shards pass by.
GROUP_BLOCKS = 64


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    v = vector.cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & sound & F.exists(v, lambda x: x != 0), F.lit(False))


def distances(data: np.ndarray, squares: np.ndarray, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its own ``rows``."""
    inner = np.einsum("qrd,qd->qr", data[rows], queries)
    return squares[rows] - 2 * inner + np.einsum("qd,qd->q", queries, queries)[:, None]


def beam_search(
    data: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int,
) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest vectors found for each query, nearest first, with squared distances.

    Per step every query opens its nearest vector not yet opened. No edge of a vector
    is there twice, but for those to itself, which stand for none.
    """
    n, q = len(data), len(queries)
    squares = np.einsum("nd,nd->n", data, data)
    found = np.full((q, beam), n, np.int64)
    far = np.full((q, beam), np.inf, data.dtype)
    opened = np.ones((q, beam), bool)
    found[:, 0] = start
    far[:, :1] = distances(data, squares, found[:, :1], queries)
    opened[:, 0] = False
    seen = np.zeros((q, n + 1), bool)
    seen[:, start] = seen[:, n] = True
    active = np.arange(q)
    while len(active):
        where = np.argmin(np.where(opened[active], np.inf, far[active]), axis=1)
        going = ~opened[active, where]
        active, where = active[going], where[going]
        if not len(active):
            break
        opened[active, where] = True
        near = edges[found[active, where]]
        fresh = ~seen[active[:, None], near]
        seen[active[:, None], near] = True
        d = np.where(fresh, distances(data, squares, near, queries[active]), np.inf)
        all_found = np.concatenate([found[active], np.where(fresh, near, n)], axis=1)
        all_far = np.concatenate([far[active], d], axis=1)
        all_opened = np.concatenate([opened[active], ~fresh], axis=1)
        best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        found[active] = np.take_along_axis(all_found, best, 1)
        far[active] = np.take_along_axis(all_far, best, 1)
        opened[active] = np.take_along_axis(all_opened, best, 1)
    return found, far


def robust_prune(
    data: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, relax: float,
) -> np.ndarray:
    """At most ``degree`` diverse neighbours of each point; unused places hold the point itself.

    ``candidates`` may repeat, hold the point, or hold len(data) for nothing.
    """
    n = len(data)
    padded = np.vstack([data, np.zeros((1, data.shape[1]), data.dtype)])
    order = np.sort(candidates, axis=1)
    order[:, 1:][order[:, 1:] == order[:, :-1]] = n
    away = ((padded[order] - data[points][:, None]) ** 2).sum(axis=2)
    away[(order == n) | (order == points[:, None])] = np.inf
    by = np.argsort(away, axis=1, kind="stable")
    order, away = np.take_along_axis(order, by, 1), np.take_along_axis(away, by, 1)
    kept = np.repeat(points[:, None], degree, axis=1)
    vectors = padded[order]
    rows = np.arange(len(points))
    for place in range(degree):
        first = np.argmin(away, axis=1)
        alive = np.isfinite(away[rows, first])
        if not alive.any():
            break
        chosen = order[rows, first]
        kept[alive, place] = chosen[alive]
        between = ((vectors - padded[chosen][:, None]) ** 2).sum(axis=2)
        away[relax * relax * between <= away] = np.inf
        away[rows, first] = np.inf
    return kept


def build_graph(data: np.ndarray, degree: int, beam: int, relax: float, seed: int = 1) -> tuple[np.ndarray, int]:
    """(edges, start): out-neighbours of each vector, and the vector nearest to the mean."""
    n, rng = len(data), np.random.default_rng(seed)
    start = int(np.argmin(((data - data.mean(axis=0)) ** 2).sum(axis=1)))
    if n <= degree + 1:
        return np.tile(np.arange(n), (n, 1)), start
    edges = np.sort(rng.integers(0, n, (n, degree)), axis=1)
    edges[:, 1:] = np.where(edges[:, 1:] == edges[:, :-1], np.arange(n)[:, None], edges[:, 1:])
    for factor in (1.0, relax):
        for block in np.array_split(rng.permutation(n), max(1, n // BLOCK)):
            found, _ = beam_search(data, edges, start, data[block], beam)
            edges[block] = robust_prune(data, block, np.hstack([found, edges[block]]), degree, factor)
            _link_back(data, edges, block, degree, factor)
    return edges, start


def _link_back(data: np.ndarray, edges: np.ndarray, block: np.ndarray, degree: int, relax: float) -> None:
    """Add the reverse edges of ``block``; targets are pruned again with at most ``degree`` new ones."""
    source = np.repeat(block, degree)
    target = edges[block].ravel()
    real = source != target
    source, target = source[real], target[real]
    near = ((data[source] - data[target]) ** 2).sum(axis=1)
    order = np.lexsort((near, target))
    source, target = source[order], target[order]
    points, begin, counts = np.unique(target, return_index=True, return_counts=True)
    rank = np.arange(len(target)) - np.repeat(begin, counts)
    fits = rank < degree
    more = np.full((len(points), degree), len(data))
    more[np.repeat(np.arange(len(points)), counts)[fits], rank[fits]] = source[fits]
    edges[points] = robust_prune(data, points, np.hstack([edges[points], more]), degree, relax)


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS, degree: int = DEGREE,
                beam: int = BEAM, relax: float = RELAX) -> DataFrame:
    """(shard, ids, begin, vectors, edges, start): one row per shard, arrays as bytes. Every vector is in it.

    ``vectors`` are distinct; those of place i have the ids from ``begin[i]`` to ``begin[i + 1]``.
    """
    rows = stored(
        vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
            F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")), "vectors")
    width = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    n = width["count"] if width else 0
    shards = max(1, -(-n // shard_rows))
    dealt = rows.filter(F.size("v") == (width["d"] if width else 0)).withColumn(
        "shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)))

    def build(key, rows):
        ids = rows["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        places: dict[bytes, list[int]] = {}
        for vec_id, v in zip(ids[order].tolist(), rows["v"].to_numpy()[order], strict=True):
            places.setdefault((v + 0.0).astype("<f8").tobytes(), []).append(vec_id)  # -0.0 is 0.0
        data = np.stack([np.frombuffer(v, "<f8") for v in places])
        edges, start = build_graph(_framed(data, data), degree, beam, relax)
        import pandas as pd

        return pd.DataFrame([{
            "shard": int(key[0]), "ids": np.concatenate(list(places.values())).astype("<i8").tobytes(),
            "begin": np.cumsum([0, *map(len, places.values())]).astype("<i8").tobytes(),
            "vectors": data.astype("<f8").tobytes(), "edges": edges.astype("<i4").tobytes(),
            "start": start, "width": data.shape[1],
        }])

    return stored(dealt.groupBy("shard").applyInPandas(
        build, "shard long, ids binary, begin binary, vectors binary, edges binary, start int, width int"), "graph-index")


def _framed(points: np.ndarray, data: np.ndarray) -> np.ndarray:
    """``points`` in the frame of ``data``: centred and within range, which changes no order."""
    scale = max(np.abs(data).max(), 1e-300)
    centre = (data / scale).mean(axis=0)
    return (points / scale - centre) / max(np.abs(data / scale - centre).max(), 1e-300)


def search(index: DataFrame, queries: DataFrame, k: int = 10, beam: int = BEAM, block_rows: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each query (vec_id, embedding).

    Shards are dealt to as many slots as there are shuffle partitions, and blocks of queries are sent to
    every slot; per shard at most ``k`` rows of a query come back. Neither the plan nor the number of
    tasks grows with the shards, and none of them are listed on the driver.
    """
    asked = queries.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
    n = asked.count()
    blocks = max(1, -(-n // block_rows))
    groups = -(-blocks // GROUP_BLOCKS)
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = min(tasks, (index.agg(F.max("shard")).first()[0] or 0) + 1)
    grouped = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).agg(
        F.collect_list(F.struct("query_id", "q")).alias("queries")).select(
        "queries", F.floor(F.col("block") / GROUP_BLOCKS).cast("int").alias("group"),
        F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    held = index.select(
        "ids", "begin", "vectors", "edges", "start", "width", F.pmod("shard", F.lit(slots)).cast("int").alias("slot"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    # A task holds one group of blocks; shards pass by, and nothing is broadcast by way of the driver.
    meeting = held.hint("merge").join(grouped.hint("merge"), ["slot", "group"]).select(
        "ids", "begin", "vectors", "edges", "start", "width", "queries")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield found_in(*(batch[c][i].as_py() for c in range(7)))

    def found_in(ids, begin, vectors, edges, start, width, queries) -> pa.RecordBatch:
        ids, begin = np.frombuffer(ids, "<i8"), np.frombuffer(begin, "<i8")
        data = np.frombuffer(vectors, "<f8").reshape(-1, width)
        edges = np.frombuffer(edges, "<i4").reshape(len(data), -1).astype(np.int64)
        queries = [x for x in queries if len(x["q"]) == width]
        if not queries:
            return result([], [], [])
        asked = np.array([x["q"] for x in queries])
        places, _ = beam_search(_framed(data, data), edges, start, _framed(asked, data), max(beam, 2 * k))
        out: tuple[list, list, list] = ([], [], [])
        for i, query in enumerate(queries):
            here = places[i][places[i] < len(data)]
            exact = np.sqrt(((data[here] - asked[i]) ** 2).sum(axis=1))
            counts = begin[here + 1] - begin[here]
            rows = np.repeat(begin[here] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            mine, exact = ids[rows], np.repeat(exact, counts)
            other = mine != query["query_id"]
            mine, exact = mine[other], exact[other]
            best = np.lexsort((mine, exact))[:k]
            out[0].extend([query["query_id"]] * len(best))
            out[1].extend(mine[best].tolist())
            out[2].extend(exact[best].tolist())
        return result(*out)

    def result(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
            ["query_id", "vec_id", "score"])

    hits = meeting.mapInArrow(visit, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
