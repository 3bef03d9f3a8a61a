"""Summaries of ingestion as aggregates, over all results or by window of activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ingest_summary(results: DataFrame) -> DataFrame:
    """One row: discovered, indexed, failed, emitted_points, pending. results: status (ok, failed or null) and n_points."""
    ok, failed = F.count_if(F.col("status") == "ok"), F.count_if(F.col("status") == "failed")
    return results.agg(
        F.count(F.lit(1)).alias("discovered"),
        ok.alias("indexed"),
        failed.alias("failed"),
        F.coalesce(F.sum(F.when(F.col("status") == "ok", F.col("n_points"))), F.lit(0)).cast("long").alias("emitted_points"),
        F.greatest(F.lit(0), F.count(F.lit(1)) - ok - failed).alias("pending"),
    )


def activity_windows(events: DataFrame, key: str, at: str, gap_s: int) -> DataFrame:
    """(key, window_start, window_end, n_events) of each run of events that are at most gap_s seconds apart.

    Where a run ends, nothing has happened for that long: the moment at which a summary is due.
    """
    w = Window.partitionBy(key).orderBy(at, *(c for c in events.columns if c not in (key, at)))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    apart = micros(F.col(at)) - micros(F.lag(at).over(w))
    marked = events.withColumn("_new", F.coalesce(apart > gap_s * 1_000_000, F.lit(True)).cast("int"))
    numbered = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(key, "_run").agg(F.min(at).alias("window_start"), F.max(at).alias("window_end"), F.count(F.lit(1)).alias("n_events")).drop("_run")
