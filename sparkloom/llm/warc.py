"""WARC archives as seekable Zstandard bundles.

An archive is one file:

* independent Zstandard frames, each of whole records, about FRAME_BYTES of them;
* a skippable frame with the record index: for each record its page id, whether that is not null (1) and whether other rows
  have it, too (2), its frame and its offset within the frame's decompressed bytes;
* a skippable frame with the seek table, as the seekable format has it: compressed and decompressed size of each frame,
  then the number of frames and the magic number, so that a reader starts at the file's end.

A page becomes a ``response`` record, or a ``revisit`` if an equal payload of at least LEAST_SHARED bytes has a smaller
page id; a revisit names that response and keeps the HTTP header, whose Content-Length is that of the whole payload, but
not the payload.

``record_locations`` gives the table from record ids to archive, frame and offset, read from the indexes alone, and ``fetch`` a
record of it, of which it reads one frame.

A null page id is larger than any other; where all ids of a payload are null, its records are responses. Rows that share an
id, or have none, are told apart by the archive and their number in it, which their record ids name; each of them that has the
smallest id of its payload is a response. A revisit names the page of its response, whose record id is that of the page alone
unless rows share it. Null html is an empty payload, a null url gives no target. Other columns are not read, whatever their
names. An empty table gives no archives. A payload of any length lies in one frame.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, small_batches, table, written
from .files import open_map, whole_file

FRAME_BYTES = 1 << 18
LEAST_SHARED = 100
LEVEL = 3
# Fixed values of the Zstandard seekable format and its skippable frames.
SEEK_TABLE_FRAME, INDEX_FRAME, SEEKABLE = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
# Fixed values of WARC 1.1.
IDENTICAL_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: int | None, place: str = "") -> str:
    """place: tells the records of rows that share a page id apart."""
    return f"<urn:page:{'null' if page_id is None else page_id}{f'/{place}' if place else ''}>"


def page_of(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">").partition("/")[0]
    return None if number == "null" else int(number)


def header_text(value: str) -> str:
    """A value for a header line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 0x20 or ord(c) == 0x7F else c for c in value)


@dataclass(frozen=True)
class Record:
    """payload is None for a revisit; length and digest are of the whole payload in either case."""

    page_id: int | None
    kind: str
    length: int
    digest: str
    refers_to: int | None
    url: str | None
    payload: bytes | None

    def bytes(self, place: str = "") -> bytes:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {self.length}\r\n\r\n".encode()
        lines = ["WARC/1.1", f"WARC-Type: {self.kind}", f"WARC-Record-ID: {record_id(self.page_id, place)}", f"WARC-Date: {NO_DATE}"]
        if self.url is not None:
            lines.append(f"WARC-Target-URI: {header_text(self.url)}")
        lines.append(f"WARC-Payload-Digest: sha256:{self.digest}")
        if self.kind == "revisit":
            lines += [f"WARC-Refers-To: {record_id(self.refers_to)}", f"WARC-Profile: {IDENTICAL_PAYLOAD}"]
        lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(self.payload or b'')}"]
        return b"".join([*(x.encode("utf-8", "replace") + b"\r\n" for x in lines), b"\r\n", http, self.payload or b"", b"\r\n\r\n"])


def parse(data: bytes, at: int = 0) -> Record:
    """The record that begins at an offset; its digest is checked if it has its payload."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode("utf-8").split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("no record begins here")
    head = dict(x.split(": ", 1) for x in lines)
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).partition(b":")[2])
    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"]
    if kind == "response" and (len(body) != length or hashlib.sha256(body).hexdigest() != digest):
        raise ValueError(f"{head['WARC-Record-ID']} does not hold the payload that its header names")
    refers = page_of(head["WARC-Refers-To"]) if kind == "revisit" else None
    return Record(page_of(head["WARC-Record-ID"]), kind, length, digest, refers, head.get("WARC-Target-URI"), body if kind == "response" else None)


class ArchiveWriter:
    """Writes records to an open stream; close() appends the record index and the seek table. name: the archive's."""

    def __init__(self, out: pa.NativeFile, name: str, frame_bytes: int = FRAME_BYTES) -> None:
        self.out, self.name, self.frame_bytes = out, name, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.held: list[bytes] = []
        self.size = 0
        self.frames: list[tuple[int, int]] = []
        self.ids, self.kinds, self.places = array("q"), bytearray(), array("I")  # of the index; places: frame and offset in turns

    def add(self, record: Record, shared: bool) -> None:
        """shared: other rows have the record's page id, too, or it has none."""
        raw = record.bytes(place(self.name, len(self.ids)) if shared else "")
        self.ids.append(record.page_id or 0)
        self.kinds.append((record.page_id is not None) + 2 * shared)
        self.places.extend((len(self.frames), self.size))
        self.held.append(raw)
        self.size += len(raw)
        if self.size >= self.frame_bytes:
            self._end_frame()

    def _end_frame(self) -> None:
        if self.held:
            raw = self.zstd.compress(b"".join(self.held))
            self.out.write(raw)
            self.frames.append((len(raw), self.size))
            self.held, self.size = [], 0

    def _skippable(self, magic: int, content: bytes) -> None:
        self.out.write(struct.pack("<II", magic, len(content)) + content)

    def close(self) -> None:
        self._end_frame()
        ids, places = np.asarray(self.ids).astype("<i8"), np.asarray(self.places).astype("<u4")
        self._skippable(INDEX_FRAME, struct.pack("<Q", len(ids)) + ids.tobytes() + bytes(self.kinds) + places[::2].tobytes() + places[1::2].tobytes())
        self._skippable(SEEK_TABLE_FRAME, np.array(self.frames, "<u4").tobytes() + struct.pack("<IBI", len(self.frames), 0, SEEKABLE))


class Archive:
    """Reads an archive from its end: the seek table, the record index, then any frame for itself."""

    def __init__(self, uri: str) -> None:
        self.file, self.name = open_map(uri), archive_name(uri)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        sizes = np.frombuffer(self.file.read_at(8 * n, size - 9 - 8 * n), "<u4").reshape(n, 2).astype(np.int64)
        self.starts = np.r_[0, np.cumsum(sizes[:, 0])]
        self.sizes = sizes[:, 1]
        at = int(self.starts[-1])
        magic, length = struct.unpack("<II", self.file.read_at(8, at))
        if magic != INDEX_FRAME:
            raise ValueError(f"{uri} has no record index")
        raw = self.file.read_at(length, at + 8)
        (count,) = struct.unpack_from("<Q", raw)
        self.ids, kinds = np.frombuffer(raw, "<i8", count, 8), np.frombuffer(raw, "u1", count, 8 + 8 * count)
        self.known, self.shared = kinds & 1 == 1, kinds & 2 == 2
        self.frame, self.offset = (np.frombuffer(raw, "<u4", count, 8 + 9 * count + 4 * count * k) for k in (0, 1))
        self.zstd = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.ids)

    def read_frame(self, k: int) -> bytes:
        a, b = int(self.starts[k]), int(self.starts[k + 1])
        return self.zstd.decompress(self.file.read_at(b - a, a), max_output_size=int(self.sizes[k]))

    def record_ids(self) -> list[str]:
        return [record_id(i if known else None, place(self.name, k) if shared else "") for k, (i, known, shared) in enumerate(zip(self.ids.tolist(), self.known.tolist(), self.shared.tolist(), strict=True))]

    def at(self, frame: int, offset: int) -> Record:
        """The record at a place; reads its frame only."""
        return parse(self.read_frame(frame), offset)

    def find(self, page_id: int) -> Record | None:
        """The first record of a page; reads its frame only."""
        at = np.flatnonzero(self.known & (self.ids == page_id))
        return self.at(int(self.frame[at[0]]), int(self.offset[at[0]])) if len(at) else None

    def __iter__(self) -> Iterator[Record]:
        now, data = -1, b""
        for k, at in zip(self.frame.tolist(), self.offset.tolist(), strict=True):
            if k != now:
                now, data = k, self.read_frame(k)
            yield parse(data, at)


def archive_name(uri: str) -> str:
    return uri.rpartition("/")[2].partition(".")[0]


def place(archive: str, number: int) -> str:
    """Of a record in its archive, for ids of rows that share a page id."""
    return f"{archive}-{number}"


def response_of(pages: DataFrame) -> DataFrame:
    """(digest, refers_to): payloads of at least LEAST_SHARED bytes that several rows have, and their smallest page id.

    Counts are summed beside the scan, so a payload that a third of the pages share costs one row a task.
    """
    digests = pages.where(F.octet_length("html") >= LEAST_SHARED).select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    return digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "refers_to")


_READ = ("page_id", "url", "html", "digest", "refers_to", "shares", "again")


def write_archives(pages: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Writes an archive for each partition and returns the written table (path, n_records) of them.

    Only if payloads are shared are pages joined with their responses: by digest, where the thin side is broadcast if it is
    small and hot digests are split otherwise.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    shared = written(response_of(rows), "shared-payloads", thin=True)
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    if shared.isEmpty():
        rows = rows.withColumn("refers_to", F.lit(None).cast("long")).withColumn("shares", F.lit(False))
    else:
        rows = rows.join(shared, "digest", "left").withColumn("shares", F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")))
    again = written(pages.select(F.col("page_id").cast("long").alias("again")).where("again IS NOT NULL").groupBy("again").count().where("count > 1").select("again"), "shared-ids", thin=True)
    if again.isEmpty():
        rows = rows.withColumn("again", F.col("page_id").isNull())
    else:
        rows = rows.join(again, rows["page_id"] == again["again"], "left").withColumn("again", F.col("page_id").isNull() | F.col("again").isNotNull())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        path = f"{folder}/{uuid.uuid4().hex}.warc.zst"  # a task may hold several partitions; a repeated one writes anew
        with whole_file(path) as out:
            archive = ArchiveWriter(out, archive_name(path), frame_bytes)
            batch: pa.RecordBatch | None = first
            while batch is not None:
                for page_id, url, html, digest, refers, shares, shared_id in zip(*(batch.column(c) for c in _READ), strict=True):
                    i, payload = page_id.as_py(), html.as_py().encode("utf-8", "surrogatepass")
                    if shares.as_py():
                        record = Record(i, "revisit", len(payload), digest.as_py(), refers.as_py(), url.as_py(), None)
                    else:
                        record = Record(i, "response", len(payload), digest.as_py(), None, url.as_py(), payload)
                    archive.add(record, shared_id.as_py())
                batch = next(batches, None)
            archive.close()
        yield pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([len(archive.ids)], pa.int64())})

    return written(rows.select(*_READ).mapInArrow(write, "path string, n_records long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the archives in a table."""
    n = max(1, archives.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, count in zip(batch.column("path").to_pylist(), batch.column("n_records").to_pylist(), strict=True):
                archive = Archive(path)
                if len(archive) != count:
                    raise ValueError(f"{path} does not hold as many records as its table says")
                rows = [(r.page_id, r.length, r.digest, r.kind, r.refers_to) for r in archive]
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return archives.repartition(n, "path").mapInArrow(read, schema)


def record_locations(archives: DataFrame) -> DataFrame:
    """(record_id, page_id, path, frame, offset) of every record of the archives in a table; no frame is read."""
    n = max(1, archives.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                a = Archive(path)
                columns = [pa.array(a.record_ids(), pa.string()), pa.array(a.ids, mask=~a.known), pa.array([path] * len(a), pa.string()), pa.array(a.frame.astype(np.int64)), pa.array(a.offset.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["record_id", "page_id", "path", "frame", "offset"])

    return archives.repartition(n, "path").mapInArrow(read, "record_id string, page_id long, path string, frame long, offset long")


def fetch(path: str, frame: int, offset: int) -> Record:
    """The record at a place that record_locations names."""
    return Archive(path).at(frame, offset)


def op3_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages"), shared_folder(spark, "warc")))


OP3_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), r AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND least IS NOT NULL AND page_id IS DISTINCT FROM least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM least THEN least END AS refers_to
FROM r
"""
