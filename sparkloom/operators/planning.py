"""What is to be done and what is done: changes of files, work items, acknowledgements, last versions of points.

Each is a relational reading of a log: one shuffle by a key of many values, without a limit on state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERSION = ("canonical_path", "size_bytes", "mtime_unix_secs")


def tailer_changes(observed: DataFrame, seq: str = "seq") -> DataFrame:
    """The observations of files whose version differs from the last one seen of the path; the first always does.

    A file that turns back to an earlier version has changed again; one that vanishes is not reported.
    """
    w = Window.partitionBy("canonical_path").orderBy(seq)
    version = F.struct("size_bytes", "mtime_unix_secs")
    seen = observed.withColumn("_before", F.lag(version).over(w))
    return seen.where(F.col("_before").isNull() | (F.col("_before") != version)).drop("_before")


def plan_versions(changes: DataFrame, seq: str = "seq") -> DataFrame:
    """The first appearance of each version of a file: a version that was ever planned is not planned again.

    A partial aggregate keeps the earliest row of each version, so one that is seen very often costs a row a task.
    """
    rest = [c for c in changes.columns if c not in VERSION]
    ordered = F.struct(seq, *(c for c in rest if c != seq))
    first = changes.groupBy(*VERSION).agg(F.min(ordered).alias("_first"))
    return first.select(*VERSION, *(F.col(f"_first.{c}").alias(c) for c in rest))


def work_items(planned: DataFrame) -> DataFrame:
    """Log records (kind, chunk_id, fingerprint) of planned versions, and their order."""
    return planned.select(F.lit("work_item_v2").alias("kind"), F.lit(None).cast("binary").alias("chunk_id"), F.struct(*VERSION).alias("fingerprint"), "seq")


def acknowledgements(results: DataFrame, only_ok: bool = True) -> DataFrame:
    """Log records of finished work. only_ok: work that failed stays pending; else it is acknowledged, too."""
    done = results.where(F.col("status") == "ok") if only_ok else results
    return done.select(F.lit("sink_ack_v2").alias("kind"), F.lit(None).cast("binary").alias("chunk_id"), F.struct(*VERSION).alias("fingerprint"), "seq")


def log_records(results: DataFrame, only_ok: bool = True) -> DataFrame:
    """work_items of all versions and acknowledgements of those that are done (status is not null), from one pass."""
    done = F.coalesce(F.col("status") == "ok", F.lit(False)) if only_ok else F.col("status").isNotNull()
    kinds = F.when(done, F.array(F.lit("work_item_v2"), F.lit("sink_ack_v2"))).otherwise(F.array(F.lit("work_item_v2")))
    return results.select(F.explode(kinds).alias("kind"), F.lit(None).cast("binary").alias("chunk_id"), F.struct(*VERSION).alias("fingerprint"), "seq")


def new_since(log: DataFrame, before: int, seq: str = "seq") -> DataFrame:
    """The tail of a log after a position."""
    return log.where(F.col(seq) > before)


def executable(log: DataFrame) -> DataFrame:
    """The records that a worker acts on; all other kinds are passed over."""
    return log.where(F.col("kind") == "work_item_v2")


def discovered(log: DataFrame) -> DataFrame:
    return log.where(F.col("kind").startswith("work_item"))


def pending_work(log: DataFrame) -> DataFrame:
    """Work items without an acknowledgement of their version."""
    acked = log.where(F.col("kind") == "sink_ack_v2").select(*(F.col(f"fingerprint.{c}").alias(f"_{c}") for c in VERSION))
    same = [F.col(f"fingerprint.{c}").eqNullSafe(F.col(f"_{c}")) for c in VERSION]
    condition: Column = same[0] & same[1] & same[2]
    return executable(log).join(acked, condition, "left_anti")


def upsert_latest(points: DataFrame, batch: str = "batch") -> DataFrame:
    """The last version of each point: by id, that of the highest batch. A partial aggregate, not a sort."""
    rest = [c for c in points.columns if c not in ("id", batch)]
    last = points.groupBy("id").agg(F.max(F.struct(batch, *rest)).alias("_last"))
    return last.select("id", F.col(f"_last.{batch}").alias(batch), *(F.col(f"_last.{c}").alias(c) for c in rest))


def stale_tail(latest: DataFrame, current: DataFrame) -> DataFrame:
    """Points of documents that have shrunk: their chunk index lies beyond the chunks that the document has now.

    latest: the store's points; current: doc_id and total_chunks of documents as they are. Deleting them is the caller's choice.
    """
    return latest.join(current.select(F.col("doc_id").alias("_doc"), F.col("total_chunks").alias("_now")), F.col("doc_id") == F.col("_doc")).where(F.col("chunk_index") >= F.col("_now")).drop("_doc", "_now")
