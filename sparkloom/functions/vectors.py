"""The arithmetic of semantic chunking over tables: one row an item, with a vector, in an order within a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit(vector: Column) -> Column:
    """The vector scaled to length 1, as doubles; a zero vector stays as it is."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: x / norm))


def dot(a: Column, b: Column) -> Column:
    """Over the shorter of the two."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def neighbour_distances(df: DataFrame, group: str, order: str, vector: str) -> DataFrame:
    """df (group, order) with distance: 1 less the cosine to the item before it; null for the first of a group."""
    units = df.select(group, order, unit(F.col(vector)).alias("_u"))
    before = F.lag("_u").over(Window.partitionBy(group).orderBy(order))
    return units.withColumn("_b", before).select(group, order, F.when(F.col("_b").isNotNull(), 1 - dot(F.col("_b"), F.col("_u"))).alias("distance"))


def semantic_groups(distances: DataFrame, group: str, order: str, percentile: int) -> DataFrame:
    """distances with split (whether an item begins a new group of neighbours) and group_no, counted from 0.

    The threshold of a group is the percentile of its distances by linear interpolation, and only larger ones split.
    """
    limits = distances.groupBy(group).agg(F.percentile("distance", F.lit(percentile / 100)).alias("threshold"))
    marked = distances.join(limits, group).withColumn("split", F.coalesce(F.col("distance") > F.col("threshold"), F.lit(False)))
    running = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn("group_no", F.sum(F.col("split").cast("int")).over(running).cast("int"))


def merge_small_groups(sized: DataFrame, group: str, number: str, size: str, least: int) -> DataFrame:
    """sized (group, number, size) with merged_no: a group smaller than least by itself joins the one before it; the first
    of all has none to join. A group therefore starts a merged one exactly if it is first or large enough."""
    w = Window.partitionBy(group).orderBy(number)
    starts = (F.row_number().over(w) == 1) | (F.col(size) >= least)
    marked = sized.withColumn("_starts", starts.cast("int"))
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn("merged_no", (F.sum("_starts").over(running) - 1).cast("int")).drop("_starts")
