"""Data sources for ``spark.read.format(...)``, streams and sinks: landed listings, sheets, and queues with whole batches.

``register(spark)`` makes them known. Readers deal files to partitions by their sizes, so a task opens a bounded share of them;
streams go by the files' names, which a landing zone gives in the order of time, so that a batch that is run again reads
the same files. The queue's writer stages a file for each task, and a commit names those of the batch at once.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from claimspark.operators.tabular import COLUMNS

#: Bytes of files that one partition reads, but for a single larger file, and rows of a batch.
SHARE, ROWS = 64 << 20, 4096


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        super().__init__(paths)
        self.paths = paths


class Staged(NamedTuple):
    """A file of a task, and its rows."""

    path: str
    rows: int


class Written(WriterCommitMessage):
    def __init__(self, files: list[Staged]) -> None:
        self.files = files


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def landed(path: str) -> list[fs.FileInfo]:
    """The files below a path in the order of their names; those that writers are still at (_ or . first) don't count."""
    store, root = opened(path)
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    inner = lambda f: f.path[len(root) :].strip("/").split("/")
    return sorted((f for f in found if f.type == fs.FileType.File and not any(x[:1] in "_." for x in inner(f))), key=lambda f: f.path)


def shares(files: list[fs.FileInfo], most: int = SHARE) -> list[Files]:
    """Files in runs of at most ``most`` bytes, a larger one for itself."""
    out: list[Files] = []
    size = most + 1
    for f in files:
        if size + (f.size or 0) > most:
            out.append(Files([]))
            size = 0
        out[-1].paths.append(f.path)
        size += f.size or 0
    return out


def document(path: str, root: str) -> str:
    """A landed file's document: its place below the root, without the name's ending and Spark's own part names."""
    parts = path[len(root) :].strip("/").split("/")
    return "/".join(parts[:-1]) if parts[-1].startswith("part-") and len(parts) > 1 else "/".join(parts).rsplit(".", 1)[0]


class _Landed:
    """What batch and stream readers of landed files share: ``rows`` of one file, in ``SCHEMA``."""

    SCHEMA = ""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.kind, self.options = to_arrow_schema(schema), options
        self.path, self.share = options["path"], int(options.get("sharebytes", SHARE))

    def rows(self, name: str, data: bytes) -> Iterator[tuple]:
        raise NotImplementedError

    def batches(self, files: Files) -> Iterator[pa.RecordBatch]:
        store, root = opened(self.path)
        held: list[tuple] = []
        for path in files.paths:
            with store.open_input_stream(path) as stream:
                data = stream.read()
            for row in self.rows(document(path, root), data):
                held.append(row)
                if len(held) >= ROWS:
                    yield self._batch(held)
                    held = []
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), self.kind)], schema=self.kind)


class _Batch(_Landed, DataSourceReader):
    def partitions(self) -> list[Files]:
        return shares(landed(self.path), self.share) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from self.batches(partition)


class _Stream(_Landed, DataSourceStreamReader):
    """Offsets are the names of the last files that were read; files come with names above all before them."""

    def initialOffset(self) -> dict[str, str]:  # noqa: N802
        return {"upto": ""}

    def latestOffset(self) -> dict[str, str]:  # noqa: N802
        files = landed(self.path)
        return {"upto": files[-1].path if files else ""}

    def partitions(self, start: dict[str, str], end: dict[str, str]) -> list[Files]:
        return shares([f for f in landed(self.path) if start["upto"] < f.path <= end["upto"]], self.share)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from self.batches(partition)

    def commit(self, end: dict[str, str]) -> None:
        """Landed files stay."""


class _Listing:
    def rows(self, name: str, data: bytes) -> Iterator[tuple]:
        text = data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
        for n, line in enumerate(text.split("\n")):
            if line.strip():
                yield name, n, line.strip()


class _Sheet:
    def rows(self, name: str, data: bytes) -> Iterator[tuple]:
        """Records after the header: trimmed, blank ones left out and not counted; an empty first column that isn't the sheet's goes."""
        text = data.decode("utf-8-sig", "replace")
        records = [[x.strip() for x in r] for r in csv.reader(io.StringIO(text, newline=""))]
        if text.startswith((",", '"",')):
            records = [r[1:] for r in records]
        full = [r for r in records if any(r)]
        for n, r in enumerate(full[1:], 2):
            yield name, n, *(r[k] if k < len(r) else "" for k in range(len(COLUMNS)))


class ListingBatch(_Listing, _Batch):
    pass


class ListingStream(_Listing, _Stream):
    pass


class SheetBatch(_Sheet, _Batch):
    pass


class SheetStream(_Sheet, _Stream):
    pass


class ListingSource(DataSource):
    """Lines of landed text pages: document, line (counted from 0, blank ones too), body (trimmed; blank lines are left out)."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "document string, line int, body string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ListingBatch(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return ListingStream(schema, self.options)


class SheetSource(DataSource):
    """Records of landed delimited files: document, row_index (the header is 1), and the six columns of a sheet."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> str:
        return "document string, row_index int, " + ", ".join(f"{c} string" for c in COLUMNS)

    def reader(self, schema: StructType) -> DataSourceReader:
        return SheetBatch(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return SheetStream(schema, self.options)


def _names(path: str) -> list[str]:
    """The batches of a queue in the order of their names."""
    return [f.path for f in landed(f"{path.rstrip('/')}/batches")]


def _staged(store: fs.FileSystem, root: str, batches: Iterator[pa.RecordBatch], kind: pa.Schema) -> Written:
    """One file of a task's rows, under a name of its own; none without rows. A task that fails leaves a file that no batch names."""
    path, n, out = f"{root}/data/{uuid.uuid4().hex}.parquet", 0, None
    try:
        for batch in batches:
            if batch.num_rows:
                if out is None:
                    store.create_dir(f"{root}/data")
                    out = pq.ParquetWriter(path, kind, filesystem=store)
                out.write_batch(batch.cast(kind) if batch.schema != kind else batch)
                n += batch.num_rows
    finally:
        if out is not None:
            out.close()
    return Written([Staged(path, n)] if n else [])


class _Queue:
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.kind, self.options = to_arrow_schema(schema), options

    def _stage(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = opened(self.options["path"].rstrip("/"))
        return _staged(store, root, batches, self.kind)

    def _commit(self, name: str, messages: list[Any]) -> None:
        """Names the batch's files at once. A batch that is there already was sent before: the files of this sending go."""
        store, root = opened(self.options["path"].rstrip("/"))
        files = [f for m in messages if m is not None for f in m.files]
        target = f"{root}/batches/{name}.json"
        if store.get_file_info(target).type != fs.FileType.NotFound:
            self._abort(messages)
            return
        part = f"{root}/batches/.{uuid.uuid4().hex}"
        store.create_dir(f"{root}/batches")
        with store.open_output_stream(part) as out:
            out.write(json.dumps({"files": [f.path for f in files], "rows": sum(f.rows for f in files), "schema": from_arrow_schema(self.kind).jsonValue()}).encode())
        store.move(part, target)

    def _abort(self, messages: list[Any]) -> None:
        store, _ = opened(self.options["path"])
        for f in (f for m in messages if m is not None for f in m.files):
            if store.get_file_info(f.path).type != fs.FileType.NotFound:
                store.delete_file(f.path)


class QueueWriter(_Queue, DataSourceArrowWriter):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return self._stage(iterator)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._commit(self.options.get("batch") or uuid.uuid4().hex, messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._abort(messages)


class QueueStreamWriter(_Queue, DataSourceStreamArrowWriter):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return self._stage(iterator)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:  # noqa: N803
        self._commit(f"{self.options.get('writer', 'stream')}-{batchId:012d}", messages)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:  # noqa: ARG002, N803
        self._abort(messages)


class _Sent:
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.kind, self.path = to_arrow_schema(schema), options["path"].rstrip("/")

    def _files(self, names: list[str]) -> list[Files]:
        store, _ = opened(self.path)
        out = []
        for name in names:
            with store.open_input_stream(name) as stream:
                out += json.loads(stream.read())["files"]
        return [Files([f]) for f in out]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        for path in partition.paths:
            with pq.ParquetFile(path, filesystem=store) as file:
                for batch in file.iter_batches(ROWS):
                    yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in self.kind], schema=self.kind)


class QueueBatch(_Sent, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self._files(_names(self.path)) or [Files([])]


class QueueStream(_Sent, DataSourceStreamReader):
    """Offsets count the batches sent; their names must come in the order of sending, as a writer's numbered batches do."""

    def initialOffset(self) -> dict[str, str]:  # noqa: N802
        return {"upto": ""}

    def latestOffset(self) -> dict[str, str]:  # noqa: N802
        names = _names(self.path)
        return {"upto": names[-1] if names else ""}

    def partitions(self, start: dict[str, str], end: dict[str, str]) -> list[Files]:
        return self._files([n for n in _names(self.path) if start["upto"] < n <= end["upto"]])

    def commit(self, end: dict[str, str]) -> None:
        """Batches stay until they are deleted."""


class QueueSource(DataSource):
    """A queue of whole batches. Writing: option ``batch`` names the batch (a name that is there already sends nothing); streams
    number theirs below ``writer``. Reading gives the rows of all batches, in the schema of the first."""

    @classmethod
    def name(cls) -> str:
        return "queue"

    def schema(self) -> StructType:
        names = _names(self.options["path"])
        if not names:
            raise ValueError("the queue has no batch yet: state a schema")
        store, _ = opened(self.options["path"])
        with store.open_input_stream(names[0]) as stream:
            return StructType.fromJson(json.loads(stream.read())["schema"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return QueueBatch(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return QueueStream(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("a queue is only appended to")
        return QueueWriter(schema, self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:  # noqa: ARG002, N802
        return QueueStreamWriter(schema, self.options)


def register(spark: SparkSession) -> SparkSession:
    """Make the formats ``listing``, ``sheet`` and ``queue`` known to a session."""
    for source in (ListingSource, SheetSource, QueueSource):
        spark.dataSource.register(source)
    return spark
