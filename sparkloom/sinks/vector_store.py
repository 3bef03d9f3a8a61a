"""Sinks for vector points: a vector store over HTTP, Parquet, memory. All take (id, vector, payload) DataFrames.

An upsert overwrites points by id, so writing a batch again changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..errors import LoomError
from ..operators.embedding import request, retried

#: What became of the points of a document.
OUTCOMES = "canonical_path string, size_bytes long, mtime_unix_secs long, points long, error_kind string, error_message string"


class Sink:
    def prepare(self) -> None:
        """Once, on the driver, before the first batch."""

    def upsert(self, points: DataFrame) -> None:
        raise NotImplementedError

    def outcomes(self, points: DataFrame, retries: int = 0) -> DataFrame | None:
        """Upserts points that have a source_path, and gives a row for each document (see OUTCOMES), to be evaluated once; None
        if a sink takes all points or raises."""
        self.upsert(points.drop("source_path"))
        return None


@dataclass(frozen=True)
class HttpVectorStore(Sink):
    """A collection of a vector store. vector_size: if given, prepare() makes the collection if it is missing.

    Points are put by the tasks that hold them, in requests of at most batch points of one document: a document that fails
    takes no other with it.
    """

    url: str
    collection: str
    vector_size: int | None = None
    batch: int = 256

    @property
    def _place(self) -> str:
        return f"{self.url.rstrip('/')}/collections/{self.collection}"

    def prepare(self) -> None:
        if self.vector_size is None:
            return
        status, text = request("sink", "GET", self._place)
        if 200 <= status < 300:
            return
        if status != 404:
            raise LoomError("sink", f"collection check answered with status {status}: {text}")
        status, text = request("sink", "PUT", self._place, {"vectors": {"size": self.vector_size, "distance": "Cosine"}})
        if 200 <= status < 300:
            return
        if not 200 <= request("sink", "GET", self._place)[0] < 300:  # another writer may have made it meanwhile
            raise LoomError("sink", f"collection could not be made, status {status}: {text}")

    def put(self, points: list[dict]) -> None:
        status, text = request("sink", "PUT", f"{self._place}/points?wait=true", {"points": points})
        if not 200 <= status < 300:
            raise LoomError("sink", f"upsert answered with status {status}: {text}")
        try:
            said = json.loads(text).get("status")
        except (ValueError, AttributeError) as e:
            raise LoomError("sink", f"upsert gave no status: {text}") from e
        if said != "ok":
            raise LoomError("sink", f"upsert status is not ok: {text}")

    def upsert(self, points: DataFrame) -> None:
        sent = self.outcomes(points.withColumn("source_path", F.col("payload.canonical_path")))
        n, first = sent.agg(F.count("error_kind"), F.first("error_message", True)).first()
        if n:
            raise LoomError("sink", f"{n} documents failed, among them: {first}")

    def outcomes(self, points: DataFrame, retries: int = 0) -> DataFrame:
        put, size = self.put, self.batch

        def finish(document: tuple, held: list[dict]) -> tuple:
            try:
                for row in held:
                    row["id"] = checked_id(row["id"])
                for at in range(0, len(held), size):
                    retried(lambda k=at: put(held[k : k + size]), retries)
            except LoomError as e:
                return *document, len(held), e.kind, str(e)
            return *document, len(held), None, None

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held, done = None, [], []
            for batch in batches:
                for row in batch.to_pylist():  # the points of a document follow each other
                    document = row["canonical_path"], row["size_bytes"], row["mtime_unix_secs"]
                    if document != now and held:
                        done.append(finish(now, held))
                        held = []
                    now = document
                    held.append({"id": row["id"], "vector": row["vector"], "payload": json.loads(row["payload"])})
            if held:
                done.append(finish(now, held))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=["canonical_path", "size_bytes", "mtime_unix_secs", "points", "error_kind", "error_message"])

        payload = F.to_json("payload", {"ignoreNullFields": "false"}).alias("payload")
        return points.select("id", "vector", payload, F.col("source_path").alias("canonical_path"), "payload.size_bytes", "payload.mtime_unix_secs").mapInArrow(send, OUTCOMES)


@dataclass(frozen=True)
class ParquetSink(Sink):
    """Appends to a folder of Parquet files; operators.planning.upsert_latest reads the last version of each point."""

    path: str

    def upsert(self, points: DataFrame) -> None:
        points.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(self.path)


@dataclass
class MemorySink(Sink):
    """For tests: keeps rows by id on the driver."""

    points: dict[str, Row] = field(default_factory=dict)

    def upsert(self, points: DataFrame) -> None:
        self.points |= {checked_id(r.id): r for r in points.collect()}


def checked_id(value: str | None) -> str:
    """An id without space around it; a blank one is an error."""
    value = (value or "").strip()
    if not value:
        raise LoomError("invalid input", "point id is empty")
    return value
