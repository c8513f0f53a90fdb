"""Best-fit packing by hierarchical residuals.

Documents become pieces of at most ``capacity`` tokens; only longer documents are cut.
Pieces are dealt to groups of bounded size. Each group packs its pieces best-fit, the
largest first, and hands out its nearly full bins; a bin that is not full goes up the
tree as an item of the size it has. ``fan_in`` groups meet in each round, until one is left.

A group hands up at most ``carry`` bins, those with most room; others it hands out as
they are. So a task holds at most ``fan_in * carry`` bins, and no piece is ever dropped.

With ``in_order`` the order of the documents is kept as far as packing allows: groups are
contiguous ranges of ``group_items`` pieces, neighbouring groups meet first, and
``sequence_id`` is the number of the sequence's middle piece, so sequences in order of
their ids follow the documents. A sequence closed in the first round holds pieces of one
range; only bins carried up take pieces of further ones. The order is that of the files
a table was written to (file number, then row), or of the partitions of any other table.

Edge cases: a null text is an empty one, a piece of the end id alone; a null ``doc_id``
stays null; repeated rows are packed each; an empty table gives no pieces; further
columns are not read.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import stored, trimmed, whole_text
from rankloom.llm.tokens import IDS, KEPT_WORDS, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
ORDERED = f"{PIECES}, at string, row long"
PACKED = f"{PIECES}, number long, sequence_id long, offset long, used long, grp long, open boolean"
#: Bits of a sequence id for the bin within its group, and for the group within its round.
BIN_BITS, GROUP_BITS = 20, 36
#: Bits of Spark's monotonic ids for the row within its partition.
ROW_BITS = 33


def with_places(docs: DataFrame) -> DataFrame:
    """(doc_id, text, at, row): where each row stands, by its file or else by its partition."""
    columns = [F.col("doc_id"), whole_text().alias("text")]
    name = F.col("_metadata.file_name")
    try:  # file numbers have five digits or more, so shorter names come first
        return docs.select(
            *columns, F.concat(F.lpad(F.length(name).cast("string"), 4, "0"), name).alias("at"),
            F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return docs.select(*columns, F.lit("").alias("at"), F.monotonically_increasing_id().alias("row"))


def cut_documents(
    docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, in_order: bool = False,
    kept_words: int = KEPT_WORDS,
) -> DataFrame:
    """The pieces of all (doc_id, text), in the partitions where the texts are."""
    kinds = pa.schema([
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
        ("length", pa.int64()), ("ids_crc32", pa.int64()),
        *([("at", pa.string()), ("row", pa.int64())] if in_order else []),
    ])

    @functools.partial(trimmed, keeps=True)
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, kept_words), np.asarray([end_id], IDS).tobytes()
        for batch in batches:
            rows = []
            for doc_id, text, *place in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                ids = memoryview(encode.ids(text) + end)
                for piece, at in enumerate(range(0, len(ids), capacity * IDS.itemsize)):
                    part = ids[at:at + capacity * IDS.itemsize]
                    rows.append((
                        doc_id, piece, at // IDS.itemsize, len(part) // IDS.itemsize, zlib.crc32(part), *place))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, kind) for x, kind in zip(columns, kinds.types, strict=True)], schema=kinds)

    if in_order:
        return with_places(docs).mapInArrow(cut, ORDERED)
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(cut, PIECES)


def numbered(pieces: DataFrame) -> DataFrame:
    """Pieces with places become pieces with a ``number`` from 0 in that order."""
    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["at", "row", "piece"]
    sorted_ = stored(
        pieces.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id()).drop("at", "row"), "ordered-pieces"
    ).withColumn("part", F.shiftright("place", ROW_BITS))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sorted_.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(  # one row per task
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    number = F.col("before") + F.col("place").bitwiseAND((1 << ROW_BITS) - 1)
    return sorted_.join(F.broadcast(offsets), "part").withColumn("number", number).drop("part", "place", "before")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: the largest first, each into the fullest bin that takes it.

    Bins are kept by the room they have left; a bit set tells which rooms there are, so
    the smallest that suffices is one shift away.
    """
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, made = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            here = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, here, made = capacity, made, made + 1
        bins[i], offsets[i] = here, capacity - room
        left = room - size
        if not by_room[left]:
            rooms |= 1 << left
        by_room[left].append(here)
    return bins, offsets


def pack(
    pieces: DataFrame, capacity: int, group_items: int = 8192, fan_in: int = 8,
    nearly_full: float = 0.99, carry: int = 4096,
) -> DataFrame:
    """``pieces`` with sequence_id and the offset there; in order if they have a ``number``."""
    n = pieces.count()
    groups = max(1, -(-n // group_items))
    in_order = "number" in pieces.columns
    if in_order:
        group = F.floor(F.col("number") / group_items)
    else:
        pieces = pieces.withColumn("number", F.lit(None).cast("long"))
        group = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups))
    rows = pieces.select(
        "*", group.alias("grp"),
        F.monotonically_increasing_id().alias("item"), F.lit(0).cast("long").alias("inner"),
    )
    closed, level = [], 0
    while True:
        packed = stored(
            rows.groupBy("grp").applyInPandas(
                _packer(capacity, level, 0 if groups == 1 else carry, nearly_full, in_order), PACKED),
            "packed")
        closed.append(packed.filter(~F.col("open")))
        if groups == 1:
            break
        groups, level = -(-groups // fan_in), level + 1
        rows = packed.filter("open").select(
            *[x.split()[0] for x in PIECES.split(", ")], "number", F.floor(F.col("grp") / fan_in).alias("grp"),
            F.col("sequence_id").alias("item"), F.col("offset").alias("inner"),
        )
    out = closed[0]
    for more in closed[1:]:
        out = out.union(more)
    return out.drop("used", "grp", "open", "number")


def _packer(capacity: int, level: int, carry: int, nearly_full: float, in_order: bool):
    """Packs the items of a group. An item is a piece, or a bin of the round before."""

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        item, which = np.unique(rows["item"].to_numpy(), return_inverse=True)
        length = rows["length"].to_numpy()
        sizes = np.zeros(len(item), np.int64)
        np.add.at(sizes, which, length)
        bins, offsets = best_fit(sizes, capacity)
        used = np.zeros(bins.max() + 1, np.int64)
        np.add.at(used, bins, sizes)
        roomy = np.argsort(used, kind="stable")[:carry]
        is_open = np.zeros(len(used), bool)
        is_open[roomy] = used[roomy] < nearly_full * capacity
        group = int(rows["grp"].iloc[0])
        if in_order:
            names = _middle(bins[which], rows["number"].to_numpy(np.int64))
        else:
            names = ((level << GROUP_BITS | group) << BIN_BITS) + np.arange(len(used))
        return rows.drop(columns=["item", "inner"]).assign(
            sequence_id=names[bins[which]],
            offset=offsets[which] + rows["inner"].to_numpy(),
            used=used[bins][which], grp=group, open=is_open[bins][which],
        )[[x.split()[0] for x in PACKED.split(", ")]]

    return packed


def _middle(bins: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """For each bin the number of its middle piece: no other bin has it."""
    order = np.lexsort((numbers, bins))
    counts = np.bincount(bins)
    return numbers[order][np.cumsum(counts) - counts + (counts - 1) // 2]


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, in_order: bool = False,
    kept_words: int = KEPT_WORDS, **tree,
) -> DataFrame:
    """Tokenise, cut and pack whole documents; texts are tokenised once.

    With fewer ``kept_words`` workers take less memory and more words are encoded anew; the rows are the same.
    """
    pieces = stored(cut_documents(docs, tokenizer, capacity, end_id, in_order, kept_words), "pieces")
    return pack(numbered(pieces) if in_order else pieces, capacity, **tree)
