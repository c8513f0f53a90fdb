"""Quartile bucket digests of texts, and a bounded score of their difference.

The byte triplets of a text are hashed into buckets and counted. Each bucket is encoded by
the quartile of its count in two bits; the length is encoded by its logarithm. Two
digests differ by the steps between their quartile codes, a step over all quartiles
counting double, and by their length codes up to a bound; the likeness is one minus the
difference over its greatest value.

Edge cases: a null text is an empty one; an empty text and one shorter than three bytes
have no triplets, so all codes are zero and lengths alone tell them apart; equal texts
have equal digests; a null ``doc_id`` comes last in the descending order; rows of one
``doc_id`` follow each other by the hash of their text; the last row is followed by the
first, which in a table of one row is itself; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import stored, whole_text

BUCKETS = 1024
#: Odd multipliers that mix the three bytes.
MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x2C1B3C6D, 0x297A2D39)
#: A step from the lowest quartile to the highest counts as six, and length codes as 64 at most.
FAR_STEP, LENGTH_BOUND = 6, 64
#: Bytes hashed at once.
SLAB = 1 << 20

DIGESTED = (
    "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
    "near_edited double, near_next double, part int, is_first boolean, is_last boolean, text string")


def triplet_counts(data: bytes, buckets: int = BUCKETS) -> np.ndarray:
    counts = np.zeros(buckets, np.int64)
    whole = np.frombuffer(data, np.uint8)
    a, b, c, d, e = (np.uint32(x) for x in MIX)
    for at in range(0, max(len(whole) - 2, 0), SLAB):
        part = whole[at:at + SLAB + 2].astype(np.uint32)
        h = part[:-2] * a ^ part[1:-1] * b ^ part[2:] * c
        h ^= h >> np.uint32(15)
        h *= d
        h ^= h >> np.uint32(12)
        h *= e
        h ^= h >> np.uint32(15)
        counts += np.bincount(h % np.uint32(buckets), minlength=buckets)
    return counts


def codes(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """The quartile code of each bucket, and the length code at the end."""
    data = text.encode()
    counts = triplet_counts(data, buckets)
    bounds = np.sort(counts)[[buckets // 4 - 1, buckets // 2 - 1, 3 * buckets // 4 - 1]]
    code = np.empty(buckets + 1, np.uint8)
    code[:-1] = (counts[:, None] > bounds).sum(axis=1)
    code[-1] = min(255, round(8 * np.log2(len(data) + 1)))
    return code


def packed(code: np.ndarray) -> bytes:
    """The length code, then four buckets a byte."""
    four = code[:-1].reshape(-1, 4).astype(np.uint8)
    return bytes([code[-1], *(four << np.array([6, 4, 2, 0], np.uint8)).sum(axis=1, dtype=np.uint8)])


def written(code: np.ndarray) -> str:
    """The packed digest in hexadecimal."""
    return packed(code).hex()


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """From 0 to 1; 1 for equal digests."""
    step = np.abs(one[:-1].astype(int) - other[:-1])
    step[step == 3] = FAR_STEP
    length = min(LENGTH_BOUND, abs(int(one[-1]) - int(other[-1])))
    return 1 - (int(step.sum()) + length) / (FAR_STEP * (len(one) - 1) + LENGTH_BOUND)


def edited(text: str, following: str) -> str:
    """The last third replaced by as much of the beginning of the text that follows."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


def compared(text: str, code: np.ndarray, following: str, next_code: np.ndarray) -> tuple:
    """(edited_sha256, edited_fingerprint, near_edited, near_next)."""
    changed = edited(text, following)
    changed_code = codes(changed)
    return (
        hashlib.sha256(changed.encode()).digest(), packed(changed_code),
        likeness(code, changed_code), likeness(code, next_code))


def digest_with_next(docs: DataFrame) -> DataFrame:
    """Digest of every (doc_id, text), of its edited text, and the likeness to the next document.

    The next document is the one before in ascending order of ``doc_id``. Texts are dealt
    out by ranges once; a task walks through its rows in order. Only the last row of a
    task lacks its next one: the first and last rows of tasks, two per partition, keep their
    texts and are matched afterwards.
    """
    spark = docs.sparkSession
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in DIGESTED.split(", "))])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
        return pa.RecordBatch.from_arrays(
            [pa.array(x, kind) for x, kind in zip(columns, schema.types, strict=True)], schema=schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting, first = TaskContext.get().partitionId(), None, True
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                code = codes(text)
                if waiting is not None:
                    rows.append(row(waiting, part, first, (text, code)))
                    first = False
                waiting = (doc_id, text, code)
            yield batch_of(rows)
        if waiting is not None:
            yield batch_of([row(waiting, part, first, None)])

    def row(doc: tuple, part: int, first: bool, following: tuple | None) -> tuple:
        doc_id, text, code = doc
        sha, fingerprint, near, near_next = compared(text, code, *following) if following else (None,) * 4
        return (
            doc_id, len(text), sha, packed(code), fingerprint, near, near_next,
            part, first, following is None, text if first or following is None else None)

    def join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, following, part in zip(*(batch[i].to_pylist() for i in range(4)), strict=True):
                code = codes(text)
                rows.append(row((doc_id, text, code), part, False, (following, codes(following))))
            yield batch_of(rows)

    tie = F.xxhash64(whole_text())
    ordered = (
        docs.select("doc_id", whole_text().alias("text"))
        .repartitionByRange(F.desc("doc_id"), tie).sortWithinPartitions(F.desc("doc_id"), tie)
    )
    walked = stored(ordered.mapInArrow(walk, DIGESTED), "digests")
    parts = sorted(row["part"] for row in walked.filter("is_first").select("part").collect())  # one per task
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    heads = walked.filter("is_first").select(F.col("part").alias("next"), F.col("text").alias("head"))
    ends = (
        walked.filter("is_last").select("doc_id", "text", "part")
        .join(following, "part").join(heads, "next").select("doc_id", "text", "head", "part")
        .mapInArrow(join_ends, DIGESTED)
    )
    hexadecimal = [F.lower(F.hex(c)).alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    return walked.filter("not is_last").union(ends).select(
        "doc_id", "n_chars", *hexadecimal, "near_edited", "near_next")
