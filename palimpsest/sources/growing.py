"""Lines of files that grow: a data source that reads byte ranges and resumes where it stopped.

``spark.read.format("growing_lines")`` deals the finished lines of all files below a
path to tasks by byte ranges, so one large file has many readers;
``spark.readStream`` reads what was added since the last batch.  A last line without
its end waits for it.  The progress of a file is its revision, the byte up to which
it was read, and hashes of its head and of what lies before that byte; a file that
shrank or whose hashed regions changed opens a new revision and is read from its
start.

Options: ``path`` (a folder, read recursively, or a file; a URI that pyarrow opens),
``suffix`` (names to read, default all), ``rangeBytes`` (bytes of a task, 64 MiB),
``since`` (batches: progress as JSON, see :func:`progress`) and ``state`` (streams: a
shared folder for the progress that restarts need).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, revision int, byte_offset long, byte_length int, payload string, payload_hash string"
#: Bytes of a file's head, and before its checkpoint, that tell if it is still the same.
REGION = 65_536
_CHUNK = 1 << 20
_BATCH_BYTES = 4 << 20

Progress = dict[str, dict[str, Any]]


@dataclass
class Range(InputPartition):
    """The lines of a file that begin within [start, stop), all of them finished."""

    path: str
    revision: int
    first: int  # where the revision's unread part begins
    start: int
    stop: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str, suffix: str) -> Iterator[tuple[str, int]]:
    """Paths, in the form they were asked for, and sizes."""
    system, inner = _opened(path)
    outer = path[: len(path) - len(inner)] if "://" in path and path.endswith(inner) else ""
    info = system.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
    for f in found:
        if f.type == fs.FileType.File and f.path.endswith(suffix):
            yield outer + f.path, f.size


def _read(stream: pa.NativeFile, start: int, length: int) -> bytes:
    stream.seek(start)
    return stream.read(length)


def _digest(stream: pa.NativeFile, start: int, stop: int) -> str:
    return hashlib.sha256(_read(stream, start, stop - start)).hexdigest()


def _finished(stream: pa.NativeFile, start: int, size: int) -> int:
    """The byte after the last line end at or after ``start``, or ``start``."""
    stop = size
    while stop > start:
        begin = max(start, stop - _CHUNK)
        at = _read(stream, begin, stop - begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        stop = begin
    return start


def advanced(path: str, suffix: str, since: Progress) -> Progress:
    """The progress that reading all finished lines would make; files that are gone keep theirs."""
    out = dict(since)
    for name, size in _files(path, suffix):
        was = since.get(name)
        with _opened(name)[0].open_input_file(_opened(name)[1]) as stream:
            same = was is not None and size >= was["end"] and _digest(stream, 0, was["head"]) == was["head_hash"] and _digest(stream, max(0, was["end"] - REGION), was["end"]) == was["tail_hash"]
            revision, begun = (was["revision"], was["end"]) if same else (was["revision"] + 1 if was else 1, 0)
            end = _finished(stream, begun, size)
            if end == 0 and not was:
                continue  # no line is finished yet
            head = min(REGION, end)
            out[name] = {"revision": revision, "end": end, "head": head, "head_hash": _digest(stream, 0, head), "tail_hash": _digest(stream, max(0, end - REGION), end)}
    return out


def ranges(before: Progress, after: Progress, size: int) -> list[Range]:
    """What lies between two states of progress, cut into tasks."""
    out = []
    for path, now in sorted(after.items()):
        was = before.get(path)
        first = was["end"] if was and was["revision"] == now["revision"] else 0
        out += [Range(path, now["revision"], first, k, min(k + size, now["end"])) for k in range(first, now["end"], size)]
    return out


def _lines(part: Range) -> Iterator[tuple[int, bytes]]:
    """Offsets and bytes of the lines that begin in a range; the last may end beyond it."""
    system, inner = _opened(part.path)
    with system.open_input_file(inner) as stream:
        at = part.start if part.start == part.first else part.start - 1
        stream.seek(at)
        skipping, held = part.start != part.first, b""
        while at < part.stop:
            chunk = stream.read(_CHUNK)
            if not chunk:
                return
            held += chunk
            *whole, held = held.split(b"\n")
            for line in whole:
                if skipping:  # it began before the range, unless the range begins a line
                    skipping = False
                elif at < part.stop:
                    yield at, line
                at += len(line) + 1


def _batches(part: Range) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[int, bytes]] = []
    size = 0

    def batch() -> pa.RecordBatch:
        n = len(rows)
        texts = [x.decode("utf-8", "replace") for _, x in rows]
        return pa.RecordBatch.from_arrays(
            [pa.array([part.path] * n), pa.array([part.revision] * n, pa.int32()), pa.array([a for a, _ in rows], pa.int64()), pa.array([len(x) for _, x in rows], pa.int32()), pa.array(texts, pa.string()), pa.array([hashlib.sha256(x).hexdigest() for _, x in rows])],
            names=["path", "revision", "byte_offset", "byte_length", "payload", "payload_hash"],
        )

    for row in _lines(part):
        rows.append(row)
        size += len(row[1])
        if size >= _BATCH_BYTES or len(rows) >= 10_000:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: Any) -> DataSourceStreamReader:
        return _Stream(self.options)


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.size, self.since = int(options.get("rangeBytes", 64 << 20)), json.loads(options.get("since", "{}"))

    def partitions(self) -> list[Range]:
        return ranges(self.since, advanced(self.path, self.suffix, self.since), self.size) or [Range("", 0, 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(partition) if partition.path else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        if "state" not in options:
            raise ValueError("set the option state to a shared folder for the stream's progress")
        self.path, self.suffix, self.size = options["path"], options.get("suffix", ""), int(options.get("rangeBytes", 64 << 20))
        self.system, self.state = _opened(options["state"])
        self.last: Progress | None = None

    def _saved(self) -> Progress:
        file = f"{self.state}/progress.json"
        if self.system.get_file_info(file).type != fs.FileType.File:
            return {}
        with self.system.open_input_file(file) as f:
            return json.loads(f.read())

    def initialOffset(self) -> Progress:
        return {}

    def latestOffset(self) -> Progress:
        self.last = advanced(self.path, self.suffix, self._saved() if self.last is None else self.last)
        return self.last

    def partitions(self, start: Progress, end: Progress) -> list[Range]:
        return ranges(start, end, self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(partition)

    def commit(self, end: Progress) -> None:
        self.system.create_dir(self.state, recursive=True)
        with self.system.open_output_stream(f"{self.state}/progress.new") as f:
            f.write(json.dumps(end).encode())
        self.system.move(f"{self.state}/progress.new", f"{self.state}/progress.json")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GrowingLines)


def progress(path: str, since: str = "{}", suffix: str = "") -> str:
    """JSON of the progress after reading ``path`` now: the next batch's ``since``."""
    return json.dumps(advanced(path, suffix, json.loads(since)))
