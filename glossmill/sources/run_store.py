"""A run store as a Spark data source: logs that any number of tasks read and tail, and status and metrics files.

The store is a folder with one folder per run (``<run>`` or ``run=<run>``). ``kind="logs"`` reads the entries of all
files in them whose name matches; a log is a JSON array, JSON lines or anything between, of flat entries
``{"stream_name": …, "time": …, "data": …}``. The start of an entry cannot be mistaken: inside a JSON text its first
quote would be escaped. So a file is cut at any byte, a part reads the entries that start in it, and a log of any size
is read by many tasks. Entries that don't parse, and those without stream and data, are left out.

``kind="status"`` and ``kind="metrics"`` read each file as one value with the time of its last change.

As a stream, the offset of a log is the byte after its last complete entry, and that of the other kinds the time and size
of each file: an entry that is still being written is read by the batch after it is complete, and a file that changes is
read again. A batch read of the same folder equals what the stream has given.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition, StringStartsWith

LOGS = "run string, file string, at long, stream_name string, time double, data string"
VALUES = "run string, file string, at timestamp, value string"
FILES = {"logs": "*", "status": "status.json", "metrics": "metrics.json"}
SPLIT_BYTES = 32 << 20
STEP = 1 << 16
BATCH = 4096
START = re.compile(rb'\{\s*"(?:stream_name|time|data)"\s*:')
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _opened(path: str):
    """The file system of a path or URI, and the path on it."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LocalFileSystem(), path)


def _listed(folder: str, pattern: str) -> list[tuple[str, str, int, int]]:
    """(run, path, bytes, nanoseconds of the last change) of the store's files."""
    from pyarrow.fs import FileSelector, FileType

    store, root = _opened(folder)
    out = []
    for info in store.get_file_info(FileSelector(root, recursive=True, allow_not_found=True)):
        parts = info.path[len(root.rstrip("/")) + 1 :].split("/")
        if info.type == FileType.File and len(parts) == 2 and fnmatch(parts[1], pattern) and parts[1][0] not in "._":
            out.append((parts[0].removeprefix("run="), info.path, info.size, info.mtime_ns or 0))
    return sorted(out)


@dataclass
class Piece:
    """The entries of a file that start in a range of bytes; nothing is read beyond ``limit``."""

    run: str
    path: str
    start: int
    end: int
    limit: int


@dataclass
class Part(InputPartition):
    pieces: list[Piece]


def _entry(raw: bytes) -> tuple[dict | None, int]:
    """The entry at the start of ``raw`` and its length in bytes; nothing if it is broken or not complete."""
    text = raw.decode("utf-8", "replace")
    try:
        found, size = json.JSONDecoder(strict=False).raw_decode(text)
    except ValueError:
        return None, 0
    return found, len(text[:size].encode())


def entries(source, piece: Piece) -> Iterator[tuple[int, dict]]:
    """(byte, entry) of every entry that starts in the piece."""
    source.seek(piece.start)
    buffer, at = source.read(piece.end - piece.start), piece.start

    def more() -> bool:
        nonlocal buffer
        source.seek(at + len(buffer))
        new = source.read(min(STEP, piece.limit - at - len(buffer)))
        buffer += new
        return bool(new)

    begin = 0
    while True:
        here = START.search(buffer, begin)
        # A start at the end of the piece may be cut in two.
        while here is None and begin < piece.end - at and at + len(buffer) < min(piece.limit, piece.end + 64) and more():
            here = START.search(buffer, begin)
        if here is None or at + here.start() >= piece.end:
            return
        after = START.search(buffer, here.end())
        while after is None and more():
            after = START.search(buffer, here.end())
        found, _ = _entry(buffer[here.start() : after.start() if after else None])
        if found is not None and (found.get("stream_name") is not None or found.get("data") is not None):
            yield at + here.start(), found
        if after is None:
            return
        begin = after.start()


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def _number(value) -> float | None:
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def _log_rows(part: Part) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("run", pa.string()), ("file", pa.string()), ("at", pa.int64()), ("stream_name", pa.string()), ("time", pa.float64()), ("data", pa.string())])
    rows: list[dict] = []
    for piece in part.pieces:
        store, path = _opened(piece.path)
        with store.open_input_file(path) as source:
            for at, entry in entries(source, piece):
                rows.append({"run": piece.run, "file": path.rsplit("/", 1)[-1], "at": at, "stream_name": _text(entry.get("stream_name")), "time": _number(entry.get("time")), "data": _text(entry.get("data"))})
                if len(rows) == BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def _value_rows(part: Part) -> Iterator[pa.RecordBatch]:
    kinds = [("run", pa.string()), ("file", pa.string()), ("at", pa.timestamp("us", "UTC")), ("value", pa.string())]
    for piece in part.pieces:
        store, path = _opened(piece.path)
        with store.open_input_file(path) as source:
            row = {"run": piece.run, "file": path.rsplit("/", 1)[-1], "at": piece.start // 1000, "value": source.read().decode("utf-8", "replace")}
        yield pa.RecordBatch.from_pylist([row], pa.schema(kinds))


def _pieces(run: str, path: str, start: int, end: int, size: int) -> Iterator[Piece]:
    for at in range(start, end, size):
        yield Piece(run, path, at, min(at + size, end), end)


def _packed(pieces: list[Piece], size: int) -> list[Part]:
    """Small pieces together, up to ``size`` bytes a task."""
    parts: list[Part] = []
    room = 0
    for piece in pieces:
        need = max(piece.end - piece.start, STEP)
        if need > room or not parts:
            parts.append(Part([]))
            room = size
        parts[-1].pieces.append(piece)
        room -= need
    return parts


class _Store:
    def __init__(self, options: dict):
        self.folder, self.kind = options["path"], options.get("kind", "logs")
        self.pattern, self.size = options.get("files", FILES[self.kind]), int(options.get("splitBytes", SPLIT_BYTES))
        self.wanted: list = []

    def files(self) -> list[tuple[str, str, int, int]]:
        scheme = self.folder.split("://")[0] + "://" if "://" in self.folder else ""
        found = _listed(self.folder, self.pattern)
        return [(run, scheme + path, size, at) for run, path, size, at in found if all(test(run) for test in self.wanted)]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a store without files
            return iter(())
        return _log_rows(partition) if self.kind == "logs" else _value_rows(partition)


class RunStoreReader(_Store, DataSourceReader):
    def partitions(self) -> list[Part]:
        if self.kind == "logs":
            pieces = [p for run, path, size, _ in self.files() for p in _pieces(run, path, 0, size, self.size)]
        else:
            pieces = [Piece(run, path, at, at, size) for run, path, size, at in self.files()]
        return _packed(pieces, self.size)


class PrunedRunStoreReader(RunStoreReader):
    """Leaves out the files of runs that a filter on ``run`` rules out."""

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("run",) and isinstance(f, (EqualTo, In, StringStartsWith)):
                if isinstance(f, StringStartsWith):
                    self.wanted.append(lambda run, v=f.value: run.startswith(v))
                else:
                    self.wanted.append(lambda run, v=(f.value if isinstance(f, In) else (f.value,)): run in v)
            else:
                yield f


class RunStoreStreamReader(_Store, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        if self.kind != "logs":
            return {path: f"{at}:{size}" for _, path, size, at in self.files()}
        known = getattr(self, "known", {})
        self.known = {path: _complete(path, size, known.get(path, 0)) for _, path, size, _ in self.files()}
        return self.known

    def partitions(self, start: dict, end: dict) -> list[Part]:
        run = lambda path: path.rsplit("/", 2)[-2].removeprefix("run=")
        if self.kind == "logs":
            pieces = [p for path, stop in sorted(end.items()) for p in _pieces(run(path), path, start.get(path, 0), stop, self.size)]
        else:
            changed = [(path, int(stamp.split(":")[0])) for path, stamp in sorted(end.items()) if start.get(path) != stamp]
            pieces = [Piece(run(path), path, at, at, 0) for path, at in changed]
        return _packed(pieces, self.size)


def _complete(path: str, size: int, least: int) -> int:
    """The byte after the last complete entry of a log, or where the one being written starts; ``least`` if there is none."""
    store, own = _opened(path)
    window = STEP
    with store.open_input_file(own) as source:
        while size > least:
            start = max(least, size - window)
            source.seek(start)
            raw = source.read(size - start)
            found = list(START.finditer(raw))
            if found:
                last = found[-1].start()
                return start + last + _entry(raw[last:])[1]
            if start == least:
                break
            window *= 4
    return least


class RunStore(DataSource):
    """Options: ``path``, ``kind`` (logs, status, metrics), ``files`` (pattern of names), ``splitBytes``, ``pushdown``."""

    @classmethod
    def name(cls) -> str:
        return "run_store"

    def schema(self) -> str:
        return LOGS if self.options.get("kind", "logs") == "logs" else VALUES

    def reader(self, schema) -> DataSourceReader:
        return (PrunedRunStoreReader if self.options.get("pushdown") == "true" else RunStoreReader)(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return RunStoreStreamReader(self.options)


def _prepared(spark: SparkSession, reader, folder: str, kind: str, options: dict):
    spark.dataSource.register(RunStore)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.format("run_store").option("path", folder).option("kind", kind)


def read_run_store(spark: SparkSession, folder: str, kind: str = "logs", **options) -> DataFrame:
    """The store as a batch. Filters on ``run`` choose files where the session lets Python sources see filters."""
    pushdown = spark.conf.get(PUSHDOWN, "false")
    return _prepared(spark, spark.read, folder, kind, options).option("pushdown", pushdown).load()


def stream_run_store(spark: SparkSession, folder: str, kind: str = "logs", **options) -> DataFrame:
    """The store as a stream: new log entries, or files that are new or changed."""
    return _prepared(spark, spark.readStream, folder, kind, options).load()


def parsed(values: DataFrame, schema: str) -> DataFrame:
    """Status or metrics values as columns; broken ones give nulls."""
    return values.select("run", "file", "at", F.from_json("value", schema).alias("_value")).select("run", "file", "at", "_value.*")
