"""Cells of the vector space, for approximate retrieval.

An index is a few numbers (cell centres or hyperplanes) that do not grow with
the corpus. Every document belongs to one cell; a query looks into several.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CellIndex(Protocol):
    def assign(self, corpus: DataFrame) -> DataFrame:
        """Add the ``cell`` of each document."""

    def probes(self, vectors: np.ndarray) -> np.ndarray:
        """Which cells (columns) each query (row) looks into, as booleans."""


def _with_cell(corpus: DataFrame, locate) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            cells = locate(flat.reshape(len(vectors), -1)) if len(vectors) else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells.astype(np.int32))], [*batch.schema.names, "cell"]
            )

    known = corpus.where(F.col("embedding").isNotNull())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.schema)
    return known.mapInArrow(run, f"{fields}, cell int")


def walsh_planes(dims: int, bits: int) -> np.ndarray:
    """Planes of signs by a rule: component i of plane b is -1 if i and 2b + 1 share an odd number of bits."""
    shared = np.arange(dims)[None, :] & (2 * np.arange(bits) + 1)[:, None]
    return np.array([[1.0 - 2.0 * (int(x).bit_count() % 2) for x in row] for row in shared])


class KMeansCells:
    """Cells around k-means centres of the unit vectors; queries probe the nearest."""

    def __init__(self, centres: np.ndarray, n_probe: int):
        norms = np.linalg.norm(centres, axis=1, keepdims=True)
        self.centres = centres / np.where(norms > 0, norms, 1.0)
        self.n_probe = min(n_probe, len(centres))

    @classmethod
    def fit(
        cls, corpus: DataFrame, n_cells: int = 16, n_probe: int = 4, seed: int = 12,
        sample: float = 1.0,
    ) -> KMeansCells:
        """Learn the centres; ``sample`` is the share of the corpus to learn from.

        Zero vectors have no direction and are left out here; ``assign`` still
        gives them a cell.
        """
        vectors = corpus.where(F.exists("embedding", lambda x: x != 0)).select(
            array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
        )
        if sample < 1.0:
            vectors = vectors.sample(sample, seed)
        model = KMeans(k=n_cells, seed=seed, distanceMeasure="cosine", maxIter=10).fit(vectors)
        return cls(np.array(model.clusterCenters()), n_probe)

    def assign(self, corpus: DataFrame) -> DataFrame:
        centres = self.centres
        return _with_cell(corpus, lambda v: np.argmax(v @ centres.T, axis=1))

    def probes(self, vectors: np.ndarray) -> np.ndarray:
        near = np.argsort(-(vectors @ self.centres.T), axis=1, kind="stable")[:, : self.n_probe]
        chosen = np.zeros((len(vectors), len(self.centres)), dtype=bool)
        np.put_along_axis(chosen, near, True, axis=1)
        return chosen


class HyperplaneCells:
    """Cells by the signs of projections; queries probe cells a few signs away.

    The planes are random, or ``planes`` (one row each) if given.
    """

    def __init__(self, dims: int, bits: int = 6, radius: int = 2, seed: int = 12, planes: np.ndarray | None = None):
        self.planes = np.random.default_rng(seed).standard_normal((bits, dims)) if planes is None else planes
        self.radius = radius

    def _cells(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors @ self.planes.T > 0) @ (1 << np.arange(len(self.planes)))

    def assign(self, corpus: DataFrame) -> DataFrame:
        return _with_cell(corpus, self._cells)

    def probes(self, vectors: np.ndarray) -> np.ndarray:
        bits = len(self.planes)
        flips = [
            sum(1 << b for b in chosen)
            for distance in range(self.radius + 1)
            for chosen in combinations(range(bits), distance)
        ]
        near = self._cells(vectors)[:, None] ^ np.array(flips)[None, :]
        chosen = np.zeros((len(vectors), 1 << bits), dtype=bool)
        np.put_along_axis(chosen, near, True, axis=1)
        return chosen


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact top-k of each query that ``found`` holds."""
    hits = exact.select("query_id", "doc_id").join(
        found.select("query_id", "doc_id", F.lit(1).alias("_hit")), ["query_id", "doc_id"], "left"
    )
    return hits.groupBy("query_id").agg(
        F.avg(F.coalesce("_hit", F.lit(0)).cast("double")).alias("recall")
    )
