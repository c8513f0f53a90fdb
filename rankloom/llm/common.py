"""What the operators share: tables in the shared folder, text columns, row numbers."""

from __future__ import annotations

import ctypes
import functools
import gc
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.plans.durable import shared_folder

#: ASCII white space, as the contracts of lines and words name it.
BLANKS = " \t\n\x0b\x0c\r"
#: Rows of a batch that are turned into Python values at once.
SLICE_ROWS = 1024
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def fresh_folder(spark: SparkSession, what: str) -> str:
    """A path of its own in the folder that driver and executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: a lineage cut
    that outlives executors."""
    path = fresh_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(text: str = "text") -> Column:
    """The text, a null one as an empty one."""
    return F.coalesce(F.col(f"`{text}`"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; pure ASCII takes the faster way to the same."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def two_hashes(value: Column, *names: str) -> list[Column]:
    """A key of 128 bits for a string, as two long columns."""
    return [F.xxhash64(value).alias(names[0]), F.xxhash64(F.lit(77), value).alias(names[1])]


def kept() -> dict:
    """What an operator keeps in this Python worker from task to task."""
    return sys.modules.setdefault("rankloom_kept", types.ModuleType("rankloom_kept")).__dict__


def give_back(keeps: bool = False) -> None:
    """Return memory that this Python worker has freed but holds on to; Spark keeps workers for later stages.

    What earlier operators keep goes too, unless this one keeps something itself.
    """
    if not keeps:
        kept().clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in the same order, so many at a time that their Python values take little memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False):
    """``run`` for mapInArrow, on short batches, begun and ended without memory of earlier ones."""
    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(keeps)
        yield from run(sliced(batches))
        give_back(keeps)

    return whole
