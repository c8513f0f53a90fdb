"""Token ids as length-delimited binary records, with an offset index.

A record is: length of the payload (unsigned 64 bit), masked checksum of these eight
bytes (unsigned 32 bit), payload, masked checksum of the payload; all little-endian.
The payload is one byte for the width of an id, one that tells whether a document id
follows, the document id (64 bit, signed; zero where there is none), and the ids. Ids
take two bytes where the vocabulary allows it. The checksum is CRC-32, rotated and
shifted so that checksums of data that hold checksums stay sound.

Documents are dealt out by ranges of ``doc_id``; each task writes one file in order and
returns index rows (part, file, place, size, tokens before it in the file). A file name
is made anew by each attempt, and the index holds only files of attempts that Spark has
committed: what a lost executor left behind is never read.

Edge cases: a null text is an empty one and gets the end id alone; a null ``doc_id``
comes first and stays null; equal ids stay side by side; an empty table gives an empty
index; further columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.common import whole_text
from rankloom.llm.tokens import IDS, encoder

LENGTH, CHECK, HEAD = "<Q", "<I", "<BBq"
LENGTH_SIZE, CHECK_SIZE, HEAD_SIZE = map(struct.calcsize, (LENGTH, CHECK, HEAD))
INDEX = "doc_id long, part int, place int, file string, offset long, size long, n_tokens long, before long"
#: A task of the reader takes about so many bytes, and asks the store for so many at once.
READ_TASK, READ_AT_ONCE = 64 << 20, 4 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    length = struct.pack(LENGTH, len(payload))
    return b"".join((
        length, struct.pack(CHECK, masked(length)), payload, struct.pack(CHECK, masked(payload))))


def unframed(record: bytes) -> bytes:
    """The payload; an error if the record is damaged."""
    length, body = record[:LENGTH_SIZE], record[LENGTH_SIZE + CHECK_SIZE:-CHECK_SIZE]
    if (
        len(record) < LENGTH_SIZE + 2 * CHECK_SIZE
        or struct.unpack(LENGTH, length)[0] != len(body)
        or struct.unpack_from(CHECK, record, LENGTH_SIZE)[0] != masked(length)
        or struct.unpack(CHECK, record[-CHECK_SIZE:])[0] != masked(body)
    ):
        raise ValueError("damaged record")
    return body


def payload(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return struct.pack(HEAD, width, doc_id is not None, doc_id or 0) + ids.astype(f"<u{width}").tobytes()


def parsed(body: bytes) -> tuple[int | None, np.ndarray]:
    width, known, doc_id = struct.unpack_from(HEAD, body)
    return (doc_id if known else None), np.frombuffer(body, f"<u{width}", offset=HEAD_SIZE)


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the ids of all (doc_id, text) in ascending order below ``folder``; return the index."""
    spark = docs.sparkSession
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(f"{root}/records", recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.asarray([end_id], IDS).tobytes()
        width = 2 if max(encode.tokenizer.get_vocab_size(), end_id) <= 1 << 16 else 4
        part = TaskContext.get().partitionId()
        name = f"records/{part:06d}-{uuid.uuid4().hex}.rec"
        sink, offset, before, place = None, 0, 0, 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                if sink is None:
                    store, root = fs.FileSystem.from_uri(folder)
                    sink = store.open_output_stream(f"{root}/{name}", buffer_size=1 << 20)
                ids = np.frombuffer(encode.ids(text) + end, IDS)
                record = framed(payload(doc_id, ids, width))
                sink.write(record)
                rows.append((doc_id, part, place, name, offset, len(record), len(ids), before))
                offset, before, place = offset + len(record), before + len(ids), place + 1
            yield _batch(rows, _INDEX)
        if sink is not None:
            sink.close()

    tie = F.xxhash64(whole_text())
    ordered = (
        docs.select("doc_id", whole_text().alias("text"))
        .repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    )
    ordered.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """(doc_id, part, place, before, ids) of the records that ``index`` names, in any choice and order."""
    return _read(index, folder, "ids array<long>", lambda ids: ids.tolist())


def digests(index: DataFrame, folder: str) -> DataFrame:
    """As ``read_records``, but with n_tokens and ids_crc32 in place of the ids."""
    return _read(
        index, folder, "n_tokens long, ids_crc32 long",
        lambda ids: (len(ids), zlib.crc32(ids.astype(IDS).tobytes())))


def _read(index: DataFrame, folder: str, columns: str, of_ids) -> DataFrame:
    spark = index.sparkSession
    total = index.agg(F.sum("size")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // READ_TASK))
    schema = f"doc_id long, part int, place int, before long, {columns}"
    kinds = _schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            rows = list(zip(*(batch[i].to_pylist() for i in range(6)), strict=True))
            done, here = [], 0
            while here < len(rows):
                last, file, start = here + 1, rows[here][0], rows[here][1]
                while last < len(rows) and rows[last][:2] == (file, sum(rows[last - 1][1:3])) \
                        and sum(rows[last][1:3]) - start <= READ_AT_ONCE:
                    last += 1
                with store.open_input_file(f"{root}/{file}") as source:
                    data = source.read_at(sum(rows[last - 1][1:3]) - start, start)
                for _, offset, size, part, place, before in rows[here:last]:
                    doc_id, ids = parsed(unframed(data[offset - start:offset - start + size]))
                    found = of_ids(ids)
                    done.append((doc_id, part, place, before,
                                 *(found if isinstance(found, tuple) else (found,))))
                here = last
            yield _batch(done, kinds)

    return (
        index.select("file", "offset", "size", "part", "place", "before")
        .repartition(tasks, "file", F.floor(F.col("offset") / READ_TASK))
        .sortWithinPartitions("file", "offset")
        .mapInArrow(read, schema)
    )


def starts(index: DataFrame) -> DataFrame:
    """(part, start): the ids in all files before. One row per file."""
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


_INDEX = _schema(INDEX)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(x, kind) for x, kind in zip(columns, schema.types, strict=True)], schema=schema)
