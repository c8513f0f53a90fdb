"""Mixing sources to target weights by Pfair scheduling.

The documents of a source are cut into blocks of ``block_rows``. With a weight w (shares
sum to 1), block j of a source is released at slot floor(j / w) and due by slot
ceil((j + 1) / w); each slot takes the released block that is due first. Weights are exact
fractions. At any slot of the run a source is less than one block away from its share.

The driver runs the schedule once, one heap step for each block, and keeps only how many
blocks of each source are done where a stretch of ``period`` slots begins. Tasks run the
stretches again from there and hand out the slots.

Sources are finite. When one runs out, the weights of the others are scaled up and a new
phase begins, so there are at most as many phases as sources. No document is dropped.

Edge cases: a null source is a source of its own; a source without a weight gets
``default_weight``; sources of weight zero come after all others, in equal shares; a null ``doc_id`` comes first; repeated rows get places of their own;
an empty table gives no rows; further columns pass through ``in_mixed_order`` unchanged.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.common import stored

#: Rows of a source are numbered in so many buckets at least; a bucket has about so many rows.
BUCKET_ROWS = 50_000
#: Slots of blocks go to the tasks whole only up to this number (20 bytes each).
BROADCAST_BLOCKS = 1_000_000


def whole_weights(weights: dict, period: int) -> dict:
    """Slots of each source in a period: at least one, summing to ``period``."""
    total = sum(weights.values())
    exact = {s: Fraction(w) / Fraction(total) * period for s, w in weights.items()}
    slots = {s: max(1, math.floor(x)) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (slots[s] - exact[s], str(s)))
    for i in range(period - sum(slots.values())):
        slots[by_rest[i % len(by_rest)]] += 1
    while sum(slots.values()) > period:
        slots[max(slots, key=lambda s: (slots[s], str(s)))] -= 1
    return slots


def one_period(slots: dict, period: int) -> dict[object, list[int]]:
    """The slots of each source's blocks in one period, earliest deadline first."""
    names = sorted(slots, key=str)
    places: dict[object, list[int]] = {s: [] for s in slots}
    for slot, (k, _) in enumerate(Pfair([slots[s] for s in names], period).run([0] * len(names), 0)):
        places[names[k]].append(slot)
    return places


def exact_shares(weights: list) -> list[int]:
    """Whole numbers in the exact proportion of the weights; equal ones if all are zero."""
    exact = [Fraction(w) for w in weights]
    if min(exact) < 0:
        raise ValueError("weights are not negative")
    if not any(exact):
        return [1] * len(exact)
    scale = math.lcm(*[x.denominator for x in exact])
    return [int(x * scale) for x in exact]


@dataclass(frozen=True)
class Pfair:
    """Sources with ``shares`` of the slots, scheduled by stretches of ``length`` slots."""

    shares: list[int]
    length: int

    def run(self, done: list[int], at: int) -> list[tuple[int, int]]:
        """(source, block) of each slot of the stretch from ``at``, where ``done`` blocks are placed."""
        shares, total = self.shares, sum(self.shares)
        coming = [(j * total // w, k, j) for k, (j, w) in enumerate(zip(done, shares, strict=True))]
        heapq.heapify(coming)
        ready: list[tuple] = []
        taken = []
        for slot in range(at, at + self.length):
            while coming and coming[0][0] <= slot:
                _, k, j = heapq.heappop(coming)
                heapq.heappush(ready, (-(-(j + 1) * total // shares[k]), k, j))
            _, k, j = heapq.heappop(ready)  # more blocks are released than slots have passed
            taken.append((k, j))
            heapq.heappush(coming, ((j + 1) * total // shares[k], k, j + 1))
        return taken


@dataclass(frozen=True)
class Phase:
    """Sources (by number) that still have blocks, until the first of them ends.

    ``states`` has the blocks of this phase done where each stretch begins.
    """

    start: int
    slots: int
    numbers: list[int]
    first: list[int]
    pfair: Pfair
    states: list[list[int]]
    ended: int


def schedule(blocks: list[int], weights: list, period: int) -> list[Phase]:
    """The phases until every source, by number, has placed its number of blocks."""
    done, start, phases = [0] * len(blocks), 0, []
    while alive := [k for k, n in enumerate(blocks) if done[k] < n]:
        shares = exact_shares([weights[k] for k in alive])
        alive, shares = zip(*[(k, w) for k, w in zip(alive, shares, strict=True) if w], strict=True)
        pfair = Pfair(list(shares), max(period, 4 * len(alive)))
        first, state, states, slots, ended = [done[k] for k in alive], [0] * len(alive), [], 0, None
        while ended is None:
            states.append(list(state))
            for i, j in pfair.run(state, slots):
                state[i], slots = j + 1, slots + 1
                if first[i] + j + 1 == blocks[alive[i]]:
                    ended = alive[i]
                    break
        phases.append(Phase(start, slots, list(alive), first, pfair, states, ended))
        for k, n, m in zip(alive, first, state, strict=True):
            done[k] = n + m
        start += slots
    return phases


STRETCHES = "phase int, at long, done array<long>"


def slot_table(spark: SparkSession, phases: list[Phase], missing: list[int]) -> DataFrame:
    """(source_no, block, slot, missing) of every block; each stretch of each phase is a row of work.

    ``missing`` has the documents by which the slots before a phase fall short of full blocks.
    """
    length = [phase.pfair.length for phase in phases]
    work = [(i, m * length[i], done) for i, phase in enumerate(phases) for m, done in enumerate(phase.states)]
    plans = [replace(phase, states=[]) for phase in phases]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, at, done in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                plan = plans[i]
                taken = plan.pfair.run(done, at)[:plan.slots - at]
                yield pa.RecordBatch.from_arrays([
                    pa.array([plan.numbers[k] for k, _ in taken], pa.int32()),
                    pa.array([plan.first[k] + j for k, j in taken], pa.int64()),
                    pa.array(range(plan.start + at, plan.start + at + len(taken)), pa.int64()),
                    pa.array([missing[i]] * len(taken), pa.int64()),
                ], ["source_no", "block", "slot", "missing"])

    return spark.createDataFrame(work, STRETCHES).mapInArrow(
        place, "source_no int, block long, slot long, missing long")


SOURCES = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_no", T.IntegerType())])


def mix(
    docs: DataFrame, weights: dict | None = None, block_rows: int = 64, period: int = 1024,
    default_weight: float = 1.0, temperature: float = 0.5,
) -> DataFrame:
    """doc_id, source, index, block, slot, position of every document.

    ``weights`` maps sources to target weights; without it they are the sizes of the
    sources to the power of ``temperature``. ``position`` numbers all documents from 0.
    Rows of a source are numbered by buckets, so a source of any size is spread out.
    """
    keys = ["doc_id", "source"]
    found = [row.asDict() for row in docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()]
    sizes = {row["source"]: row["n"] for row in found}
    if not sizes:
        return docs.select(*keys, *[F.lit(0).cast("long").alias(x) for x in ("index", "block", "slot", "position")])
    if weights is None:
        target = {s: n ** temperature for s, n in sizes.items()}
    else:
        target = {s: weights.get(s, default_weight) for s in sizes}
    names = sorted(sizes, key=lambda s: (s is not None, s))
    number = {s: i for i, s in enumerate(names)}
    blocks = [-(-sizes[s] // block_rows) for s in names]
    phases = schedule(blocks, [target[s] for s in names], period)

    buckets = max(1, -(-sum(sizes.values()) // BUCKET_ROWS))
    buckets = max(buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spark = docs.sparkSession
    sources = spark.createDataFrame([(s, number[s]) for s in names], SOURCES)  # one row per source
    rows = stored(
        docs.select(*keys)
        .join(F.broadcast(sources.withColumnRenamed("source", "name")), F.col("source").eqNullSafe(F.col("name")))
        .select(*keys, "source_no", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket")),
        "mixing-rows")
    counts = rows.groupBy("source_no", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("source_no", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = rows.withColumn(
        "k", F.row_number().over(Window.partitionBy("source_no", "bucket").orderBy("doc_id")) - 1,
    ).join(offsets, ["source_no", "bucket"]).withColumn("index", F.col("before") + F.col("k"))

    # Every slot holds block_rows documents, but for the last block of a source, which ends a phase.
    short = [blocks[phase.ended] * block_rows - sizes[names[phase.ended]] for phase in phases]
    slots = slot_table(spark, phases, [0, *itertools.accumulate(short)][:-1])
    if sum(blocks) <= BROADCAST_BLOCKS:
        slots = F.broadcast(slots)
    placed = numbered.withColumn("block", F.floor(F.col("index") / block_rows).cast("long")).join(
        slots, ["source_no", "block"])
    return placed.select(
        *keys, F.col("index").cast("long").alias("index"), "block", "slot",
        (F.col("slot") * block_rows + F.pmod(F.col("index"), F.lit(block_rows)) - F.col("missing")).cast("long").alias("position"),
    )


def in_mixed_order(docs: DataFrame, **how) -> DataFrame:
    """The whole rows of ``docs`` in mixed order: range-partitioned and sorted by position.

    Rows find their position by ``doc_id``; those that share an id share a run of positions.
    """
    at = mix(docs, **how).groupBy("doc_id").agg(F.min("position").alias("position"))
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"))
    ordered = rows.join(at, F.col("id").eqNullSafe(F.col("doc_id")), "left")
    return ordered.repartitionByRange("position").sortWithinPartitions("position").select("doc.*")
