"""svmlight and LETOR files as Spark data sources: ``spark.read.format("svmlight").load(path)``.

``register(spark)`` makes the formats ``svmlight`` and ``letor`` known. Files are read in byte
ranges, one task each, and lines that begin in a range belong to it. Schema: ``label double``,
``qid string`` (letor), ``features``, ``comment string`` (letor). Features are a map from the 1-based
index, or an array with the option ``numFeatures``; without a schema the first lines tell
whether an svmlight file has query ids, too. Files are opened by Arrow's file systems (local, S3,
GCS, HDFS with libhdfs).

Writing is committed: tasks write under names of their own in a hidden folder, and the driver
moves the files of the tasks that count into place when all are done; an overwrite drops the earlier
files only then. Numbers are written so that they are read back exactly.

Options: ``numFeatures``, ``zeroBased`` (``true``, ``false``; indices from 0 in the files),
``partitionBytes``, ``keepZeros`` (write features of value 0).
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)
from pyspark.sql.types import ArrayType, StructType

PARTITION_BYTES = 64 * 1024 * 1024
#: Lines that are turned into one batch, and lines that the inference of a schema reads.
BATCH_LINES, FIRST_LINES = 10_000, 100
READ_BYTES = 1 << 20
_PAIR = re.compile(r"^(\d+):(\S+)$")
_COMMENT = re.compile(r"#\s*(.*?)\s*$")
_QUERY = re.compile(r"^qid:(\S+)$")

ROWS = {
    "label": pa.float64(), "qid": pa.string(), "features": pa.map_(pa.int32(), pa.float64()), "comment": pa.string(),
}


def parse_line(line: str, shift: int = 0) -> tuple | None:
    """(label, qid, [(index, value)], comment) of a line, None for one without a label."""
    body, mark, _ = line.partition("#")
    items = body.split()
    if not items:
        return None
    query, pairs = None, {}
    for item in items[1:]:
        if pair := _PAIR.match(item):
            pairs[int(pair[1]) + shift] = float(pair[2])
        elif found := _QUERY.match(item):
            query = found[1]
    comment = _COMMENT.search(line)[1] if mark else ""
    return float(items[0]), query, list(pairs.items()), comment


def format_line(label: float, qid: str | None, pairs: Sequence[tuple[int, float]], comment: str | None) -> str:
    """A line that ``parse_line`` reads back exactly."""
    parts = [repr(float(label))]
    if qid is not None:
        parts.append(f"qid:{qid}")
    parts += [f"{index}:{value!r}" for index, value in pairs]
    if comment:
        parts.append("# " + " ".join(comment.split("\n")))
    return " ".join(parts)


@dataclass(frozen=True)
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


def lines_of(store: fs.FileSystem, part: ByteRange) -> Iterator[str]:
    """The lines that begin in the range, the first and the last one whole."""
    with store.open_input_file(part.path) as file:
        at = max(part.start - 1, 0)
        file.seek(at)
        rest, skip = b"", part.start > 0
        while at < part.end or rest:
            data = file.read(READ_BYTES)
            if not data:
                if rest and not skip:
                    yield rest.decode()
                return
            begin = at - len(rest)
            rest += data
            at += len(data)
            *whole, rest = rest.split(b"\n")
            for line in whole:
                if skip:  # the end of a line that began earlier
                    skip = False
                elif begin >= part.end:
                    return
                else:
                    yield line.decode()
                begin += len(line) + 1
            if begin >= part.end:
                return


class _Files(DataSource):
    """What both formats share."""

    letor = False

    def _flag(self, name: str) -> bool:
        return str(self.options.get(name, "false")).lower() == "true"

    def _place(self) -> tuple[fs.FileSystem, str]:
        path = self.options.get("path")
        if not path:
            raise ValueError("a path is needed")
        return fs.FileSystem.from_uri(path)

    def files(self) -> list[fs.FileInfo]:
        store, root = self._place()
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(root)
        if info.type == fs.FileType.File:
            return [info]
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = [x for x in found if any(p[:1] in "._" for p in x.path[len(root):].strip("/").split("/"))]
        skipped = {x.path for x in hidden}
        return sorted((x for x in found if x.is_file and x.path not in skipped), key=lambda x: x.path)

    def schema(self) -> str:
        width = self.options.get("numFeatures")
        features = "array<double>" if width else "map<int,double>"
        if self.letor or self._has_queries():
            return f"label double, qid string, features {features}, comment string"
        return f"label double, features {features}"

    def _has_queries(self) -> bool:
        store, _ = self._place()
        for info in self.files():
            for n, line in enumerate(lines_of(store, ByteRange(info.path, 0, info.size))):
                parsed = parse_line(line)
                if parsed and parsed[1] is not None:
                    return True
                if n >= FIRST_LINES:
                    return False
        return False

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self, schema, overwrite)


class SvmlightSource(_Files):
    @classmethod
    def name(cls) -> str:
        return "svmlight"


class LetorSource(_Files):
    letor = True

    @classmethod
    def name(cls) -> str:
        return "letor"


class _Reader(DataSourceReader):
    def __init__(self, source: _Files, schema: StructType):
        self.source, self.columns = source, schema.fieldNames()
        unknown = set(self.columns) - set(ROWS)
        if unknown:
            raise ValueError(f"no such columns: {sorted(unknown)}")
        self.dense = isinstance(schema["features"].dataType, ArrayType) if "features" in self.columns else False
        self.width = int(source.options.get("numFeatures", 0))
        if self.dense and not self.width:
            raise ValueError("features as an array need the option numFeatures")
        self.shift = 1 if source._flag("zeroBased") else 0

    def partitions(self) -> Sequence[ByteRange]:
        step = int(self.source.options.get("partitionBytes", PARTITION_BYTES))
        return [
            ByteRange(info.path, start, min(start + step, info.size))
            for info in self.source.files() for start in range(0, info.size, step)
        ] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        if partition.path:
            store, _ = self.source._place()
            for line in lines_of(store, partition):
                if (row := parse_line(line, self.shift)) is not None:
                    rows.append(row)
                if len(rows) == BATCH_LINES:
                    yield self._batch(rows)
                    rows = []
        yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        arrays = []
        for name in self.columns:
            values = [row[list(ROWS).index(name)] for row in rows]
            if name == "features" and self.dense:
                arrays.append(pa.array([self._dense(pairs) for pairs in values], pa.list_(pa.float64())))
            else:
                arrays.append(pa.array(values, ROWS[name]))
        return pa.RecordBatch.from_arrays(arrays, self.columns)

    def _dense(self, pairs: list[tuple[int, float]]) -> list[float]:
        out = [0.0] * self.width
        for index, value in pairs:
            if not 1 <= index <= self.width:
                raise ValueError(f"feature {index} is outside of 1..{self.width}")
            out[index - 1] = value
        return out


@dataclass
class _Written(WriterCommitMessage):
    names: tuple[str, ...]


class _Writer(DataSourceArrowWriter):
    def __init__(self, source: _Files, schema: StructType, overwrite: bool):
        self.source, self.overwrite = source, overwrite
        names = schema.fieldNames()
        if not {"label", "features"} <= set(names):
            raise ValueError("label and features are needed")
        self.dense = isinstance(schema["features"].dataType, ArrayType)
        self.shift = 1 if source._flag("zeroBased") else 0
        self.zeros = source._flag("keepZeros")
        self.job = uuid.uuid4().hex

    def _hidden(self, root: str) -> str:
        return f"{root}/_writing-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = self.source._place()
        name = f"part-{uuid.uuid4().hex}.txt"
        file = None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if file is None:
                store.create_dir(self._hidden(root), recursive=True)
                file = io.TextIOWrapper(store.open_output_stream(f"{self._hidden(root)}/{name}"), encoding="utf-8", newline="\n")
            columns = {c: batch[c].to_pylist() for c in batch.schema.names}
            nothing = [None] * batch.num_rows
            for label, qid, features, comment in zip(
                    columns["label"], columns.get("qid", nothing), columns["features"], columns.get("comment", nothing), strict=True):
                file.write(format_line(label, qid, self._pairs(features), comment) + "\n")
        if file is None:
            return _Written(())
        file.close()
        return _Written((name,))

    def _pairs(self, features) -> list[tuple[int, float]]:
        pairs = list(enumerate(features or [], 1)) if self.dense else sorted(dict(features or {}).items())
        return [(i - self.shift, float(v)) for i, v in pairs if v is not None and (self.zeros or v != 0 or not self.dense)]

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = self.source._place()
        earlier = []
        if self.overwrite and store.get_file_info(root).type == fs.FileType.Directory:
            earlier = [info.path for info in self.source.files()]
        store.create_dir(root, recursive=True)
        for message in messages:
            for name in message.names if message else ():
                store.move(f"{self._hidden(root)}/{name}", f"{root}/{name}")
        for path in earlier:
            store.delete_file(path)
        self._clear(store, root)
        with store.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = self.source._place()
        self._clear(store, root)

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(self._hidden(root)).type == fs.FileType.Directory:
            store.delete_dir(self._hidden(root))


def register(spark: SparkSession) -> None:
    """Make the formats known to the session."""
    spark.dataSource.register(SvmlightSource)
    spark.dataSource.register(LetorSource)
