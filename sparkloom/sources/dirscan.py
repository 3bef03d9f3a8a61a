"""The files of a folder as a Spark data source, for batches (``spark.read``) and streams (``spark.readStream``).

Unlike Spark's own file sources it takes hidden files, passes over symbolic links, and reports a file anew when its size or
time of change differs from what the stream saw last; files that vanish are not reported. The walk runs on the driver and
lists metadata only; tasks read the contents. The folder must be at the same path on the driver and on all executors.

Options: path; files_per_task (default 64); max_files (a micro-batch, default none); extensions (comma-separated, as in
functions.text.routing_extension, lower case; default all).
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..schema import FILES

Version = tuple[str, int, int]


def walk(root: str) -> Iterator[Version]:
    """(path, bytes, whole seconds of the last change) of the regular files below a folder, depth first in the order of
    paths. What can't be read is passed over; a time before 1970 counts as 0."""
    try:
        entries = sorted(os.scandir(root), key=lambda e: e.path)
    except OSError:
        return
    for entry in entries:
        try:
            if entry.is_dir(follow_symlinks=False):
                yield from walk(entry.path)
            elif entry.is_file(follow_symlinks=False):
                stat = entry.stat(follow_symlinks=False)
                yield entry.path, stat.st_size, max(0, stat.st_mtime_ns // 10**9)
        except OSError:
            continue


def routing_name(path: str) -> str:
    name = path.replace("\\", "/").rpartition("/")[2]
    stem, dot, extension = name.rpartition(".")
    return extension.lower() if dot and stem else ""


@dataclass
class Files(InputPartition):
    versions: list[Version]


def read_files(versions: list[Version]) -> Iterator[pa.RecordBatch]:
    """One batch a file, so that memory holds one at a time. A file that can't be read any more is a row with an error."""
    schema = pa.schema([("canonical_path", pa.string()), ("size_bytes", pa.int64()), ("mtime_unix_secs", pa.int64()), ("content", pa.binary()), ("error_kind", pa.string()), ("error_message", pa.string())])
    for path, size, mtime in versions:
        content, kind, message = None, None, None
        try:
            with open(path, "rb") as f:
                content = f.read()
        except OSError as e:
            kind, message = "i/o", f"failed to read utf-8 file: {e.strerror}"
        shown = path.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        columns = ([shown], [size], [mtime], [content], [kind], [message])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class _Options:
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]
        self.per_task = int(options.get("files_per_task", "64"))
        self.most = int(options.get("max_files", "0"))
        self.only = {x.strip() for x in options.get("extensions", "").split(",") if x.strip()}

    def files(self) -> Iterator[Version]:
        for version in walk(self.root):
            if not self.only or routing_name(version[0]) in self.only:
                yield version

    def dealt(self, versions: list[Version]) -> list[Files]:
        return [Files(versions[at : at + self.per_task]) for at in range(0, len(versions), self.per_task)] or [Files([])]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = _Options(options)

    def partitions(self) -> list[Files]:
        return self.options.dealt(list(self.options.files()))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from read_files(partition.versions)


class _StreamReader(DataSourceStreamReader):
    """Offsets are scan numbers, which grow with time. A scan with changes is kept until its batch is committed.

    After a restart the reader knows nothing: an unfinished batch gets all files there are, and so does the next scan. The
    stream's state of planned versions (streaming.ingest) takes out those that were planned before.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.options = _Options(options)
        self.last: dict[str, tuple[int, int]] = {}
        self.scans: dict[int, list[Version]] = {}
        self.newest = 0

    def initialOffset(self) -> dict[str, int]:  # noqa: N802
        return {"scan": 0}

    def latestOffset(self) -> dict[str, int]:  # noqa: N802
        changed = [v for v in self.options.files() if self.last.get(v[0]) != v[1:]]
        if self.options.most:
            changed = changed[: self.options.most]
        if changed:
            self.last |= {v[0]: v[1:] for v in changed}
            self.newest = max(self.newest + 1, time.time_ns() // 1000)
            self.scans[self.newest] = changed
        return {"scan": self.newest}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Files]:
        if end["scan"] > start["scan"] and end["scan"] not in self.scans:  # planned before a restart
            return self.options.dealt(list(self.options.files()))
        return self.options.dealt([v for scan, versions in sorted(self.scans.items()) if start["scan"] < scan <= end["scan"] for v in versions])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from read_files(partition.versions)

    def commit(self, end: dict[str, int]) -> None:
        self.scans = {k: v for k, v in self.scans.items() if k > end["scan"]}


class DirectoryScan(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dirscan"

    def schema(self) -> StructType:
        return FILES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DirectoryScan)
