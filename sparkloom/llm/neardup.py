"""SimHash near-duplicate detection by bit-sliced comparison.

1. Fingerprints are computed beside the scan; only (doc_id, fingerprint) goes on.
2. Equal fingerprints are merged by a partial aggregate, so any number of exact copies costs one row from here on.
3. Each distinct fingerprint goes to one key a block table (see simhash.block_masks): no pair within the radius is lost.
4. A key with more rows than TILE is split by longer blocks, twice if need be; what is still as large is dealt out to tiles,
   and each pair of tiles is one group, so no task holds a hot key.
5. Groups are compared bit-sliced (see bitslice); a spanning forest of the links comes out, not all pairs.
6. Components are found by star rounds over distributed tables.

For the removal of near copies the links are then held against the sets of shingles of the texts that they join, and the pairs
of similar sets that no such link joins, as their fingerprints are too far apart, are found by an exact join (see setjoin).

Nulls: a null text counts as empty; a document without words has fingerprint 0 and is linked like any other. A row with
a null doc_id takes part in linking but is never a representative; component_id is null if no id can be reached. Rows
with the same doc_id are separate rows that share their id. Other columns, of whatever name, are neither read nor kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitslice import links
from .common import WRITTEN, drop, small_batches, table, unused_name, written
from .components import components
from .setjoin import frequent, not_refuted, shingle_set, similar_sets, sketch_udf
from .simhash import DEPTH, block_masks, blocks_for, fingerprint_udf, first_tables, hex16, longer

#: Fingerprints of one block key that are compared within one group; above it the key is split.
TILE = 1024
#: Rows of whole groups that a task compares at a time.
ROWS_AT_ONCE = 1 << 17
_ROWS = "g long, fp long"


def _link_groups(radius: int):  # noqa: ANN202
    def compare(groups: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        found = list(links(fps.view(np.uint64), groups, radius))
        a, b = (np.array([x[i] for x in found], dtype=np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(fps[a]), pa.array(fps[b])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_g, held_f = [], []
        for batch in batches:
            held_g.append(batch.column(0).to_numpy(zero_copy_only=False))
            held_f.append(batch.column(1).to_numpy(zero_copy_only=False))
            if sum(map(len, held_g)) < ROWS_AT_ONCE:
                continue
            g, f = np.concatenate(held_g), np.concatenate(held_f)
            cut = int(np.searchsorted(g, g[-1]))  # rows come sorted by g; the last group may go on
            if cut:
                yield compare(g[:cut], f[:cut])
            held_g, held_f = [g[cut:]], [f[cut:]]
        if held_g:
            yield compare(np.concatenate(held_g), np.concatenate(held_f))

    return run


def fingerprint_links(distinct: DataFrame, radius: int = 3, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """(a, b): links that join all fingerprints (column fp, distinct, not null) that chains of steps within radius join.

    blocks: into how many parts fingerprints are cut for the block tables; by default as the number of rows asks.
    """
    if blocks is None:
        blocks = blocks_for(distinct.count(), radius)
    level, ready = first_tables(block_masks(radius, blocks)), []
    now = distinct.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m, _ in level])).alias("mask"))
    for depth in range(DEPTH + 1):
        if depth:  # a hot key's rows under the tables that follow from its own
            below = {level[i // (radius + 1)][0]: [] for i in range(len(level) * (radius + 1))}
            deeper = longer(level, radius)
            for i, (mask, _) in enumerate(deeper):
                below[level[i // (radius + 1)][0]].append(mask)
            lists = F.create_map(*[x for m, c in below.items() for x in (F.lit(m).cast("long"), F.array(*[F.lit(y).cast("long") for y in sorted(set(c))]))])
            level, now = deeper, hot.select("fp", F.explode(lists[F.col("mask")]).alias("mask")).distinct()
        now = now.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = written(now.groupBy("mask", "key").count().where(F.col("count") > tile), "hot-keys", thin=True)
        if sizes.isEmpty():
            ready.append(now.select(F.xxhash64("mask", "key").alias("g"), "fp"))
            break
        ready.append(now.join(sizes, ["mask", "key"], "left_anti").select(F.xxhash64("mask", "key").alias("g"), "fp"))
        hot = written(now.join(sizes, ["mask", "key"]), "hot-rows")
    else:
        dealt = hot.withColumn("tiles", F.ceil(F.col("count") / tile).cast("int")).withColumn("mine", F.pmod(F.xxhash64("fp", "mask"), F.col("tiles")))
        pairs = dealt.select("mask", "key", "fp", "mine", F.explode(F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda i: i != F.col("mine"))).alias("other"))
        ready.append(pairs.select(F.xxhash64("mask", "key", F.least("mine", "other"), F.greatest("mine", "other")).alias("g"), "fp"))
    groups = ready[0]
    for x in ready[1:]:
        groups = groups.unionByName(x)
    # two keys that share a 64-bit group number are compared together, which costs time but is exact
    return groups.repartition("g").sortWithinPartitions("g", "fp").mapInArrow(_link_groups(radius), "a long, b long")


def labelled(distinct: DataFrame, key: str, joined: DataFrame) -> DataFrame:
    """(key, component_id): for each key of a written table (key, least) the smallest least of its component.

    joined: what components() gives of the keys.
    """
    if joined.isEmpty():
        return written(distinct.select(key, F.col("least").alias("component_id")), "labels", thin=True)
    member = joined.select(F.col("a").alias(key), F.col("b").alias("root"))
    rooted = written(distinct.join(member, key, "left").select(key, "least", F.coalesce("root", key).alias("root")), "rooted", thin=True)
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids", thin=True)
    return written(rooted.join(least, "root").select(key, "component_id"), "labels", thin=True)


def simhash_components(fingerprints: DataFrame, radius: int = 3, doc_id: str = "doc_id", fp: str = "fp") -> DataFrame:
    """(doc_id, fp, component_id) for each row of a written table of fingerprints; fp must not be null."""
    spark, before = fingerprints.sparkSession, len(WRITTEN)
    rows = fingerprints.select(F.col(doc_id).alias("doc_id"), F.col(fp).alias("fp"))
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints", thin=True)
    labels = labelled(distinct, "fp", components(fingerprint_links(distinct.select("fp"), radius)))
    drop(spark, WRITTEN[before:-1])
    return rows.join(labels, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, lower: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each document; documents link whose fingerprints are within radius bits."""
    small_batches(docs.sparkSession)
    simhash = fingerprint_udf(width, lower=lower)
    return simhash_components(written(docs.select(F.col(doc_id).alias("doc_id"), simhash(F.col(text)).alias("fp")), "fingerprints"), radius)


def shingle_set_udf(width: int):  # noqa: ANN201
    """The different hashes of a text's shingles, in order."""

    @F.arrow_udf("array<bigint>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t.as_py(), width) for t in texts], pa.list_(pa.int64()))

    return of


def similar_links(links: DataFrame, rows: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The links (a, b) between sets of shingles that have at least this Jaccard similarity, as a written table.

    links: a written table of pairs of nodes. rows: (doc_id, text_hash, node) of docs. Only texts of nodes that a link touches
    are cut into shingles, one for each node.
    """
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    one = rows.join(ends, "node").groupBy("node").agg(F.min(F.struct("text_hash", F.col("doc_id").isNull().alias("none"), "doc_id")).alias("of"))
    one = one.select(F.col("node").alias("_node"), F.col("of.doc_id").alias("_id"), F.col("of.text_hash").alias("_hash"))
    texts = docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"), F.xxhash64("text").alias("_own"))
    met = texts.join(one, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")))
    sets = met.select(F.col("_node").alias("node"), shingle_set_udf(width)(F.col("_text")).alias("s")).groupBy("node").agg(F.first("s").alias("s"))
    sets = written(sets, "shingle-sets")
    both = links.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return written(both.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b"), "similar-links", thin=True)


def fingerprint_candidates(nodes: DataFrame, radius: int) -> DataFrame:
    """(a, b): for the links of a spanning forest of fingerprints within radius bits one pair of nodes each, and for nodes of
    equal fingerprints a star; nodes is a written table (node, fp)."""
    of = written(nodes.groupBy("fp").agg(F.min("node").alias("node")), "distinct-fingerprints", thin=True)
    found = written(fingerprint_links(of.select("fp"), radius).distinct(), "found-links", thin=True)
    ends = found.join(of.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(of.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b")
    equal = nodes.join(of.select("fp", F.col("node").alias("x")), "fp").where("node <> x")
    return ends.select(F.col("x").alias("a"), F.col("y").alias("b")).union(equal.select("x", "node"))


def keep_representatives(docs: DataFrame, similarity: float = 0.8, width: int = 5, radius: int = 6, fingerprint_width: int = 2) -> DataFrame:
    """docs without near copies: one document of each group stays, that with the smallest id; all columns are kept.

    Documents link whose sets of shingles of width words have at least this Jaccard similarity, and groups are what chains of
    all such links join. Most links come from a spanning forest of fingerprints within radius bits, which are made of shorter
    shingles, as those change less with an edit; the exact join of sets adds every link between groups that the forest missed.
    Of rows that repeat an id all or none stay. A row with a null doc_id stays unless a document with an id is in its group.
    """
    small_batches(docs.sparkSession)
    spark, before = docs.sparkSession, len(WRITTEN)
    behind = frequent(docs.select("text"), width)
    sketch = sketch_udf(width, similarity, fingerprint_width, behind)
    rows = written(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), sketch(F.col("text")).alias("s")), "sketches")
    rows = rows.select("doc_id", "text_hash", "s.*")
    nodes = written(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.first("odd").alias("odd")), "nodes", thin=True)
    kept = len(WRITTEN)
    forest = written(fingerprint_candidates(nodes.select("node", "fp"), radius), "forest", thin=True)
    drop(spark, WRITTEN[kept:-1])
    links: list[DataFrame] = []
    joined: list[DataFrame] = []

    def settle(pairs: DataFrame) -> DataFrame | None:
        """Components of all links so far, those of pairs that are similar among them."""
        at = len(WRITTEN)
        pairs = written(not_refuted(pairs.distinct(), nodes, similarity), "candidates", thin=True)
        if not pairs.isEmpty():
            more = similar_links(pairs, rows, docs, width, similarity)
            if not more.isEmpty():
                links.append(more)
                known = links[0]
                for x in links[1:]:
                    known = known.unionByName(x)
                drop(spark, WRITTEN[at:-1])
                joined[:] = [components(known)]
        return joined[0].select(F.col("a").alias("node"), F.col("b").alias("root")) if joined else None

    similar_sets(rows, docs.select("text"), settle(forest), settle, width, similarity, behind)
    labels = labelled(nodes, "node", joined[0]) if joined else nodes.select("node", F.col("least").alias("component_id"))
    name = unused_name(docs, "gone")
    found = rows.join(labels, "node")
    gone = found.where(F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    gone = written(gone, "near-copies", thin=True)
    drop(spark, WRITTEN[before:-1])
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col(name)), "left_anti")


def op8_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=3, lower=True)
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
