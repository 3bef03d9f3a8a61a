"""Connected components of a distributed list of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WRITTEN, drop, written


def _round(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over edges (a > b). Written tables lie below both join sides, so hot centres can be split."""
    if large:
        out = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        out = edges
    out = written(out, "star-edges", thin=True)
    least = written(out.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "star-least", thin=True)
    if large:
        new = out.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        new = out.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return new.where("a > b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b): for every node that some link touches, the smallest node of its component; one row a node but the smallest.

    Node ids are longs; links to itself and nulls are left out. The number of rounds grows with the logarithm of the
    longest chain. Each round's table is written to the shared folder, and only a count and a checksum reach the driver.
    """
    spark = edges.sparkSession
    lo, hi = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(hi.alias("a"), lo.alias("b")).where("a > b").distinct()
    now = written(now, "links", thin=True)
    seen, before = None, len(WRITTEN) - 1
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now
        seen = mark
        now = written(_round(written(_round(now, True), "large-star", thin=True), False), "small-star", thin=True)
        drop(spark, WRITTEN[before:-1])  # all but what the next round reads
