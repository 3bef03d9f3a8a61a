"""Continuous ingestion: changed files become points in a sink.

    dirscan stream → versions not planned before (state) → UTF-8 text → chunks → points → vectors → foreachBatch → sink

The checkpoint holds offsets and the state of planned versions; it takes the place of a write-ahead log. A batch that
fails is run again as a whole, and upserts by id make that harmless. A document that can't be loaded, chunked, embedded or
upserted doesn't stop the stream: it is a row with an error in the results, it is logged, and it is not acknowledged. Requests
to services are tried again a bounded number of times first, and hold chunks of one document only.
"""

from __future__ import annotations

import logging
import threading
import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.identity import file_version_id
from ..functions.text import utf8_text
from ..operators import planning
from ..operators.embedding import LocalProvider, Provider
from ..operators.points import embed_documents, payload_rows, point_rows
from ..operators.routing import ChunkerConfig, with_chunks
from ..sinks.vector_store import Sink
from ..sources import dirscan


@dataclass(frozen=True)
class IngestConfig:
    """ack_path: a folder to which acknowledgements of each batch are appended, if given. ack_failed: failed files are
    acknowledged, too. max_files: of a micro-batch; 0 for no bound. signals: what embeds sentences for the semantic chunker,
    by default the provider of the points' vectors. retries: of a request to a service."""

    root: str
    checkpoint: str
    chunker: ChunkerConfig = field(default_factory=ChunkerConfig)
    hash_name: str = "blake3"
    ack_path: str | None = None
    ack_failed: bool = False
    max_files: int = 0
    signals: Provider | None = None
    retries: int = 2


def loaded(files: DataFrame) -> DataFrame:
    """Files with text in place of content; a file that can't be read or is no UTF-8 has an error instead."""
    text, kind, message = utf8_text(F.col("content"))
    return files.withColumns({"text": text, "load_kind": F.coalesce("error_kind", kind), "load_message": F.coalesce("error_message", message)}).drop("content", "error_kind", "error_message")


def document_results(files: DataFrame, chunker: ChunkerConfig, signals: Provider | None = None) -> DataFrame:
    """Chunked documents with status (ok or failed), error_kind and error_message."""
    chunked = with_chunks(loaded(files), chunker, embed=(signals or LocalProvider()).embed_all)
    kind, message = F.coalesce("load_kind", "error_kind"), F.coalesce("load_message", "error_message")
    return chunked.withColumns({"error_kind": kind, "error_message": message, "status": F.when(kind.isNull(), "ok").otherwise("failed")}).drop("load_kind", "load_message", "text")


class IngestSummary(StreamingQueryListener):
    """Counts over a window of activity: discovered, indexed, failed, emitted_points, elapsed_ms.

    A summary is given, and the counts start anew, once the stream is idle after activity, and when it ends.
    """

    def __init__(self, emit=print) -> None:  # noqa: ANN001
        self.emit, self.lock = emit, threading.Lock()
        self._reset()

    def _reset(self) -> None:
        self.counts = dict.fromkeys(("discovered", "indexed", "failed", "emitted_points"), 0)
        self.since: float | None = None

    def add(self, **counts: int) -> None:
        with self.lock:
            if any(counts.values()):
                self.since = self.since or time.monotonic()
            for name, n in counts.items():
                self.counts[name] += n

    def flush(self, trigger: str) -> bool:
        """Gives the summary of the window, if anything happened in it."""
        with self.lock:
            if self.since is None:
                return False
            pending = max(0, self.counts["discovered"] - self.counts["indexed"] - self.counts["failed"])
            said = {"event": "ingest.summary", "trigger": trigger, **self.counts, "pending": pending, "elapsed_ms": int(1000 * (time.monotonic() - self.since))}
            self._reset()
        self.emit(said)
        return True

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        self.flush("idle")

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self.flush("shutdown")


def write_batch(batch: DataFrame, sink: Sink, config: IngestConfig, provider: Provider, summary: IngestSummary | None = None, log: logging.Logger | None = None) -> None:
    """One micro-batch of planned versions: chunks and embeds once, writes points, then acknowledges and logs.

    Documents that fail before the sink, and what becomes of the others in it, are two tables, which need not be joined.
    """
    log = log or logging.getLogger("sparkloom")
    began, version = time.monotonic(), [F.col(c) for c in planning.VERSION]
    embedded = embed_documents(document_results(batch, config.chunker, config.signals or provider), provider, config.retries).persist(StorageLevel.MEMORY_AND_DISK)
    failed = F.col("error_kind").isNotNull()
    early = embedded.where(failed).select(*version, F.lit(0).cast("long").alias("points"), "error_kind", "error_message")
    sent = sink.outcomes(payload_rows(point_rows(embedded.where(~failed), config.hash_name)), config.retries)
    if sent is None:
        sent = embedded.where(~failed).select(*version, F.size("chunks").cast("long").alias("points"), "error_kind", "error_message")
    sent = sent.persist(StorageLevel.MEMORY_AND_DISK)
    counts = dict.fromkeys(("discovered", "indexed", "failed", "emitted_points"), 0)
    try:
        for outcomes in (early, sent):
            n, bad, points = outcomes.agg(F.count(F.lit(1)), F.count("error_kind"), F.coalesce(F.sum(F.when(~failed, F.col("points"))), F.lit(0))).first()
            for name, more in (("discovered", n), ("indexed", n - bad), ("failed", bad), ("emitted_points", int(points))):
                counts[name] += more
            if config.ack_path and n:
                done = outcomes.withColumns({"seq": F.lit(time.time_ns()), "status": F.when(failed, "failed").otherwise("ok")})
                planning.acknowledgements(done, only_ok=not config.ack_failed).write.mode("append").parquet(config.ack_path)
            for r in outcomes.where(failed).toLocalIterator() if bad else ():
                log.warning({"event": "document.failed", "canonical_path": r.canonical_path, "error_kind": r.error_kind, "error_message": r.error_message})
            for r in outcomes.where(~failed).toLocalIterator() if log.isEnabledFor(logging.DEBUG) else ():
                log.debug({"event": "document.indexed", "canonical_path": r.canonical_path, "points": r.points})
        if counts["discovered"]:
            log.info({"event": "ingest.batch", **counts, "elapsed_ms": int(1000 * (time.monotonic() - began))})
        if summary is not None:
            summary.add(**counts)
    finally:
        sent.unpersist()
        embedded.unpersist()


def planned_stream(spark: SparkSession, config: IngestConfig) -> DataFrame:
    """The stream of file versions that were never planned before. The state grows with the number of versions."""
    dirscan.register(spark)
    reader = spark.readStream.format("dirscan").option("path", config.root)
    if config.max_files:
        reader = reader.option("max_files", str(config.max_files))
    versions = reader.load().withColumn("file_version_id", file_version_id(*map(F.col, planning.VERSION), config.hash_name))
    return versions.dropDuplicates(["file_version_id"])


def start(spark: SparkSession, config: IngestConfig, sink: Sink, provider: Provider | None = None, summary: IngestSummary | None = None, once: bool = False, interval: str = "1 second", log: logging.Logger | None = None) -> StreamingQuery:
    """Starts ingestion. once: takes what is there and ends; else looks for changes at an interval until it is stopped."""
    provider = provider or LocalProvider()
    sink.prepare()
    if summary is not None:
        spark.streams.addListener(summary)
    writer = planned_stream(spark, config).writeStream.option("checkpointLocation", config.checkpoint).queryName("ingest")
    writer = writer.foreachBatch(lambda batch, _: write_batch(batch, sink, config, provider, summary, log))
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime=interval).start()
