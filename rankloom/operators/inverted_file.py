"""An inverted file: a corpus stored by cells of the vector space, to which queries are joined by key.

Cells surround k-means centres; each has a radius, the greatest angle between its centre and a
document. Overfull cells are split by further centres; what cannot be split (copies) is cut into
blocks by id, so a task's group is bounded. A search reads only the partitions of the cells that some
query asks for, and a query meets only the blocks of its cells.

A certified search is exact. For a query, no document of a cell can be more similar than the cosine
of the angle to the centre less the radius. Cells are asked in the order of that bound, twice as many each
round, and a query is done when the bound of its next cell is below its worst kept score. With
``n_probe`` the search is approximate and asks that many cells.

On the driver are the cells: a centre, a radius and a count each (``n_cells`` and what splits add).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.vectors import SCORE_DIGITS
from rankloom.operators.cells import KMeansCells
from rankloom.operators.ranking import QUERY, by_score
from rankloom.operators.retrieval import BestRows, as_matrix, unit_rows
from rankloom.plans.durable import durable
from rankloom.plans.groups import top_rows

#: Documents of a cell that a task holds at a time, and queries that meet them there.
BLOCK_ROWS, BLOCK_QUERIES = 50_000, 4_096
#: Documents of an overfull cell that its split is learned from, and parts that it makes at most.
SPLIT_SAMPLE, SPLIT_PARTS, SPLIT_ROUNDS = 4_000, 64, 4
#: Slack of the bounds: above the error of an angle that comes from a cosine near 1.
SLACK = 1e-7
#: The cell of vectors without a direction (zero or not finite): their cosine is 0 with any query.
NOWHERE = -1

_FOUND = f"{QUERY} long, doc_id long, bi_score double"


@dataclass
class InvertedFile:
    """Where the documents are stored by ``cell``, and the cells."""

    path: str
    centres: np.ndarray
    radii: np.ndarray
    counts: np.ndarray
    nowhere: int = 0
    asked: list[tuple[int, int]] = field(default_factory=list, repr=False)

    @classmethod
    def build(
        cls, corpus: DataFrame, path: str, n_cells: int = 64, sample: float = 1.0, seed: int = 12,
        cell_rows: int = BLOCK_ROWS,
    ) -> InvertedFile:
        """Learn the cells from a share of (doc_id, embedding) and store all of it under ``path``."""
        rows = corpus.select(F.col("doc_id").cast("long").alias("doc_id"), "embedding").where("embedding is not null")
        known = rows.where(F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < np.inf)) & F.exists("embedding", lambda x: x != 0))
        centres = np.empty((0, 0)) if known.isEmpty() else KMeansCells.fit(known, n_cells, n_cells, seed, sample).centres
        placed = durable(_placed(rows, centres))
        for _ in range(SPLIT_ROUNDS):
            sizes = placed.where(F.col("cell") >= 0).groupBy("cell").agg(
                F.count(F.lit(1)).alias("n"), F.min("cosine").alias("least")).collect()
            # A cell of copies has no extent: nothing can split it.
            over = [r["cell"] for r in sizes if r["n"] > cell_rows and r["least"] < 1.0 - SLACK]
            if not over:
                break
            centres, placed = _split(placed, centres, over, {r["cell"]: r["n"] for r in sizes}, cell_rows, seed)
        found = {r["cell"]: r for r in placed.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), F.min("cosine").alias("least")).collect()}
        counts = np.array([found[c]["n"] if c in found else 0 for c in range(len(centres))], np.int64)
        least = np.array([found[c]["least"] if c in found else 1.0 for c in range(len(centres))])
        placed.select("doc_id", "embedding", "cell").repartition("cell", F.pmod(F.xxhash64("doc_id"), F.lit(16))).write.partitionBy(
            "cell").parquet(path)
        nowhere = found[NOWHERE]["n"] if NOWHERE in found else 0
        return cls(path, centres, np.arccos(np.clip(least, -1.0, 1.0)), counts, nowhere)

    def corpus(self, spark: SparkSession, cells: list[int] | None = None) -> DataFrame:
        """The stored documents; with ``cells`` only their partitions are read."""
        kinds = "doc_id long, embedding array<double>, cell int"
        kept = spark.read.parquet(self.path)
        kept = kept.select("doc_id", F.col("embedding").cast("array<double>").alias("embedding"), "cell").to(
            spark.createDataFrame([], kinds).schema)
        return kept if cells is None else kept.where(F.col("cell").isin(cells))

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """What no cosine of a query (row) with a document of a cell (column) exceeds."""
        angle = np.arccos(np.clip(vectors @ self.centres.T, -1.0, 1.0)) if len(self.centres) else np.empty((len(vectors), 0))
        bound = np.cos(np.maximum(angle - self.radii[None, :], 0.0))
        bound[~vectors.any(axis=1)] = 0.0
        bound[:, self.counts == 0] = -2.0
        if self.nowhere:
            bound = np.column_stack([bound, np.zeros(len(vectors))])
        return bound

    def search(self, queries: DataFrame, k: int = 20, n_probe: int | None = None) -> DataFrame:
        """The ``k`` most similar documents of each query: (query_id, doc_id, bi_score, stage1_rank).

        Exact, unless ``n_probe`` bounds the cells that a query asks. Equal scores rank by ``doc_id``.
        """
        spark = queries.sparkSession
        vectors = durable(queries.select(F.col(QUERY).cast("long").alias(QUERY), F.col("embedding").cast("array<double>").alias("embedding")).where(
            "embedding is not null"))
        best = spark.createDataFrame([], _FOUND)
        self.asked = []
        width, done = (n_probe or self._first(k)), 0
        while k > 0:
            worst = best.groupBy(QUERY).agg(F.count(F.lit(1)).alias("n"), F.min("bi_score").alias("worst"))
            worst = worst.select(QUERY, F.when(F.col("n") >= k, F.col("worst")).alias("worst"))
            asking = durable(self._asking(vectors.join(worst, QUERY, "left"), done, done + width))
            cells = asking.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a cell
            if not cells:
                break
            self.asked.append((sum(r["n"] for r in cells), len(cells)))
            found = self._met(spark, asking, {r["cell"]: r["n"] for r in cells}, k)
            ranked = top_rows(best.unionByName(found), [QUERY], by_score("bi_score"), k, "stage1_rank")
            best = durable(ranked.drop("stage1_rank"))
            done += width
            if n_probe or done >= len(self.centres) + bool(self.nowhere):
                break
            width = done
        return top_rows(best, [QUERY], by_score("bi_score"), max(k, 1), "stage1_rank")

    def cells_asked(self, n_queries: int) -> float:
        """Share of all (query, cell) pairs that the last search looked into."""
        cells = int((self.counts > 0).sum()) + bool(self.nowhere)
        return sum(pairs for pairs, _ in self.asked) / max(1, n_queries * cells)

    def _first(self, k: int) -> int:
        """Cells of the first round: enough for ``k`` documents on average."""
        mean = max(1.0, float(self.counts[self.counts > 0].mean())) if self.counts.any() else 1.0
        return max(1, int(np.ceil(k / mean)))

    def _asking(self, vectors: DataFrame, first: int, last: int) -> DataFrame:
        """(query_id, embedding, cell) of the cells at the places from ``first`` that may still hold better documents."""
        index = self

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                unit = unit_rows(as_matrix(batch["embedding"]))
                bound = index.bounds(unit)
                order = np.argsort(-bound, axis=1, kind="stable")[:, first:last]
                worst = batch["worst"].to_numpy(zero_copy_only=False).astype(np.float64)
                at = np.take_along_axis(bound, order, axis=1)
                open_ = (at > -2.0) & ~(at + SLACK < worst[:, None])  # NaN: fewer than k are known
                row, place = np.nonzero(open_)
                cell = order[row, place]
                cell = np.where(cell == len(index.centres), NOWHERE, cell)
                yield pa.RecordBatch.from_arrays(
                    [batch[QUERY].take(pa.array(row)), batch["embedding"].take(pa.array(row)), pa.array(cell, pa.int32())],
                    [QUERY, "embedding", "cell"])

        return vectors.select(QUERY, "embedding", "worst").mapInArrow(ask, f"{QUERY} long, embedding array<double>, cell int")

    def _met(self, spark: SparkSession, asking: DataFrame, queries_of: dict[int, int], k: int) -> DataFrame:
        """The best ``k`` of each query in each block that it meets."""
        blocks = {c: -(-int(self.counts[c] if c >= 0 else self.nowhere) // BLOCK_ROWS) for c in queries_of}
        parts = spark.createDataFrame(
            [(c, max(1, blocks[c]), -(-n // BLOCK_QUERIES)) for c, n in queries_of.items()], "cell int, blocks int, parts int")

        def spread(df: DataFrame, own: str, key: str, other: str) -> DataFrame:
            with_parts = df.join(F.broadcast(parts), "cell")
            return with_parts.withColumns({
                f"_{own}": F.pmod(F.xxhash64(key), F.col(own)).cast("int"),
                f"_{other}": F.explode(F.sequence(F.lit(0), F.col(other) - 1)),
            }).drop("blocks", "parts").groupBy("cell", "_blocks", "_parts")

        def meet(asked: pa.Table, docs: pa.Table) -> pa.Table:
            query, doc, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            if asked.num_rows and docs.num_rows:
                ids = asked[QUERY].to_numpy()
                left = unit_rows(as_matrix(asked["embedding"].combine_chunks()))
                right = unit_rows(as_matrix(docs["embedding"].combine_chunks()))
                names, best, slab = docs["doc_id"].to_numpy(), BestRows(len(ids), k), max(1, 4_000_000 // len(ids))
                for at in range(0, len(names), slab):
                    best.add(np.arange(len(ids)), names[at:at + slab], np.round(left @ right[at:at + slab].T, SCORE_DIGITS))
                place, doc, score = best.merge()
                query = ids[place]
            return pa.table({QUERY: pa.array(query, pa.int64()), "doc_id": pa.array(doc, pa.int64()), "bi_score": pa.array(score, pa.float64())})

        left = spread(asking, "parts", QUERY, "blocks")
        right = spread(self.corpus(spark, list(queries_of)), "blocks", "doc_id", "parts")
        return left.cogroup(right).applyInArrow(meet, _FOUND)


def _placed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Each document with its nearest centre's ``cell`` and the ``cosine`` with it."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, cosine = np.full(batch.num_rows, NOWHERE), np.zeros(batch.num_rows)
            unit = unit_rows(as_matrix(batch["embedding"]))
            known = np.flatnonzero(unit.any(axis=1))
            if len(known):
                near = unit[known] @ centres.T
                cell[known] = near.argmax(axis=1)
                cosine[known] = near.max(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["embedding"], pa.array(cell, pa.int32()), pa.array(cosine, pa.float64())],
                ["doc_id", "embedding", "cell", "cosine"])

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.select("doc_id", "embedding").mapInArrow(place, f"doc_id long, embedding {kind}, cell int, cosine double")


def _split(placed, centres, over, sizes, cell_rows, seed):
    """Further centres for the overfull cells, learned from bounded samples; their documents move to the nearest."""
    draw = F.xxhash64(F.lit(seed), "doc_id")
    sample = top_rows(placed.where(F.col("cell").isin(over)), ["cell"], [draw.asc(), F.col("doc_id").asc()], SPLIT_SAMPLE, "place")

    def learn(table: pa.Table) -> pa.Table:
        unit = np.unique(unit_rows(as_matrix(table["embedding"].combine_chunks())), axis=0)
        cell = table["cell"][0].as_py()
        wanted = min(SPLIT_PARTS, len(unit), 1 + -(-sizes[cell] // cell_rows))
        found = unit[np.random.default_rng(seed).choice(len(unit), wanted, replace=False)]
        for _ in range(10):
            near = (unit @ found.T).argmax(axis=1)
            found = unit_rows(np.array([unit[near == i].sum(axis=0) if (near == i).any() else c for i, c in enumerate(found)]))
        return pa.table({"cell": pa.array([cell] * len(found), pa.int32()), "centre": pa.array(found.tolist(), pa.list_(pa.float64()))})

    learned = sample.select("cell", "embedding").groupBy("cell").applyInArrow(learn, "cell int, centre array<double>").collect()
    groups: dict[int, list[int]] = {}
    fresh = []
    for row in sorted(learned, key=lambda r: (r["cell"], r["centre"])):
        first = row["cell"] not in groups  # the first part keeps the cell's number
        number = row["cell"] if first else len(centres) + len(fresh)
        groups.setdefault(row["cell"], []).append(number)
        if first:
            centres = centres.copy()
            centres[number] = row["centre"]
        else:
            fresh.append(row["centre"])
    centres = np.vstack([centres, *[np.array(fresh)] * bool(fresh)])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch["cell"].to_numpy().copy()
            cosine = batch["cosine"].to_numpy().copy()
            moved = np.flatnonzero(np.isin(cell, list(groups)))
            if len(moved):
                unit = unit_rows(as_matrix(batch["embedding"].take(pa.array(moved))))
                for own in np.unique(cell[moved]):
                    mine = np.flatnonzero(cell[moved] == own)
                    near = unit[mine] @ centres[groups[own]].T
                    at = near.argmax(axis=1)
                    cosine[moved[mine]] = near[np.arange(len(mine)), at]
                    cell[moved[mine]] = np.array(groups[own])[at]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["embedding"], pa.array(cell, pa.int32()), pa.array(cosine, pa.float64())], batch.schema.names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema)
    return centres, durable(placed.mapInArrow(move, kinds))
