"""Document fingerprints, and all fingerprints within a Hamming radius of given ones.

A document's terms are its five-word shingles; a term weighs as often as it occurs, and its hash adds that weight to the
votes for the bits that it sets. ``find_within`` looks fingerprints up in permuted block tables (simhash.block_masks):
each table holds every fingerprint under a different choice of its blocks, and queries meet what agrees with them in it.

Nulls: a null text counts as empty, and a text without words has fingerprint 0. In the order of documents a null doc_id
comes last; rows that share an id (or have none) follow each other by a hash of their text, then by it, so that an id that
very many rows share is dealt to several tasks. Other columns are not read, whatever their names. A table of one document has
that as its own next one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WRITTEN, Slices, drop, longs, small_batches, table, written
from .simhash import BITS, hash_bytes, bit_votes, DEPTH, BlockTable, block_masks, blocks_for, fingerprint, first_tables, hex16, longer

WIDTH, RADIUS = 5, 3
#: Documents of a slice that one task orders and reads.
SLICE_ROWS = 4096
#: Rows of one block key, of either side, that a task holds; beyond it the key is split.
TILE = 4096
#: Pairs that are compared in one step.
PAIRS_AT_ONCE = 1 << 20


def weighted_fingerprint(terms: Mapping[str, int], seed: int = 42) -> int:
    """The fingerprint of terms with whole weights: a bit is 1 if the terms whose hash sets it have over half the weight."""
    if not terms:
        return 0
    hashes = np.array([hash_bytes(t.encode(), seed) for t in terms], dtype=np.uint64)
    weights = np.array(list(terms.values()), dtype=np.int64)
    return int(np.packbits(2 * bit_votes(hashes, weights) > weights.sum(), bitorder="little").view("<u8")[0])


def likeness(a: int, b: int) -> float:
    """1 less the share of bits that differ."""
    return 1 - (a ^ b).bit_count() / BITS


def edited(text: str, following: str) -> str:
    """The text, its last third replaced by as many of the first characters of the following one, or all of them."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_PAIRS = "doc_id long, n_chars long, edited_sha256 string, fp long, edited_fp long, near_edited double, near_next double"


def _compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one slice in order, the first row of the next slice after them: each is held until the next is seen."""

    def row(held: tuple, follows: tuple) -> tuple:
        (doc_id, text, fp), (_, next_text, next_fp) = held, follows
        new = edited(text, next_text)
        new_fp = fingerprint(new, WIDTH) if new != text else fp
        sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(text), sha, fp, new_fp, likeness(fp, new_fp), likeness(fp, next_fp)

    held, over = None, False
    for batch in batches:
        out = []
        for doc_id, text, halo in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("halo").to_pylist(), strict=True):
            if over:
                continue
            text = text.as_py() or ""  # noqa: PLW2901
            now = (doc_id, text, fingerprint(text, WIDTH))
            if held is not None:
                out.append(row(held, now))
            held, over = now, halo
        if out:
            cols = list(zip(*out, strict=True))
            signed = [np.array(cols[i], dtype=np.uint64).view(np.int64) for i in (3, 4)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), *map(pa.array, signed), pa.array(cols[5], pa.float64()), pa.array(cols[6], pa.float64())],
                names=["doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next"],
            )


def neighbour_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Fingerprints of each text and its edited text, and their likeness; see op1 for the columns.

    Slices of the id range go to one task each, in descending order; a copy of the first row of each goes to the task
    before it too. That is one shuffle of the texts; bounds and first ids come from aggregates over the id column, one
    row a slice.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    slices = Slices(rows, "doc_id", slice_rows)
    rows = rows.withColumn("hash", F.xxhash64("text"))
    id_, hash_ = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long")), F.col("hash")
    firsts = rows.select(slices.column(F.col("doc_id"), hash_).alias("slot"), F.struct(id_.alias("i"), hash_.alias("h")).alias("at")).groupBy("slot").agg(F.max("at").alias("at")).collect()
    first_id, first_hash, reader = (np.zeros(slices.count, np.int64) for _ in range(3))
    reader -= 1
    order = sorted((r.slot for r in firsts), reverse=True)
    for r in firsts:
        first_id[r.slot], first_hash[r.slot] = r["at"].i, r["at"].h
    for i, s in enumerate(order):  # the slice that reads this one's first row after its own; the first comes after the last
        reader[s] = order[i - 1]
    of = slices.of

    @F.arrow_udf("struct<slot:int,halo:int>")
    def place(keys: pa.Array, hashes: pa.Array) -> pa.Array:
        k, h = longs(keys), longs(hashes)
        slot = of(k, h)
        halo = np.where((k == first_id[slot]) & (h == first_hash[slot]), reader[slot], -1)
        return pa.StructArray.from_arrays([pa.array(slot.astype(np.int32)), pa.array(halo.astype(np.int32))], names=["slot", "halo"])

    own = F.struct(F.col("p.slot").alias("slot"), F.lit(False).alias("halo"))
    copy = F.struct(F.col("p.halo").alias("slot"), F.lit(True).alias("halo"))
    placed = rows.withColumn("p", place("doc_id", "hash"))
    dealt = placed.select("doc_id", "text", "hash", F.explode(F.when(F.col("p.halo") >= 0, F.array(own, copy)).otherwise(F.array(own))).alias("at")).select("doc_id", "text", "hash", "at.*")
    dealt = dealt.repartitionById(slices.count, F.col("slot")).sortWithinPartitions("halo", F.col("doc_id").desc_nulls_last(), F.col("hash").desc(), "text")
    return dealt.select("doc_id", "text", "halo").mapInArrow(_compare_neighbours, _PAIRS)


def _count_within(radius: int, tables: list[BlockTable]):  # noqa: ANN202
    ahead = [np.array(x, dtype=np.int64).view(np.uint64) for _, x in tables]

    def matches(g: np.ndarray, t: np.ndarray, n: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        ends = np.r_[starts[1:], len(g)]
        asks = np.add.reduceat((n < 0).astype(np.int64), starts)
        found_q, found_n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        wanted = (asks > 0) & (ends - starts > asks)
        for a, b in zip(starts[wanted].tolist(), ends[wanted].tolist(), strict=True):
            data = n[a:b] >= 0
            have, count, which = fp[a:b][data], n[a:b][data], t[a:b][data]
            asked, of = fp[a:b][~data], t[a:b][~data]
            step = max(1, PAIRS_AT_ONCE // len(have))
            for k in range(0, len(asked), step):
                q, d = np.nonzero(np.bitwise_count(asked[k : k + step, None] ^ have[None, :]) <= radius)
                keep = of[k + q] == which[d]
                q, d = q[keep] + k, d[keep]
                apart = asked[q] ^ have[d]
                for x in np.unique(of[q]).tolist():  # told by the first table under which the two meet
                    mine = of[q] == x
                    met = ~((apart[mine, None] & ahead[x][None, :]) == 0).any(1)
                    sums = np.zeros(len(asked), np.int64)
                    np.add.at(sums, q[mine][met], count[d[mine][met]])
                    found_q.append(asked[sums > 0])
                    found_n.append(sums[sums > 0])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_q).view(np.int64)), pa.array(np.concatenate(found_n))], names=["fp", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if sum(len(h[0]) for h in held) < 1 << 17:
                continue
            g, t, n, fp = map(np.concatenate, zip(*held, strict=True))
            cut = int(np.searchsorted(g, g[-1]))
            if cut:
                yield matches(g[:cut], t[:cut], n[:cut], fp[:cut].view(np.uint64))
            held = [[g[cut:], t[cut:], n[cut:], fp[cut:]]]
        if held:
            g, t, n, fp = map(np.concatenate, zip(*held, strict=True))
            yield matches(g, t, n, fp.view(np.uint64))

    return run


def find_within(queries: DataFrame, counted: DataFrame, radius: int = RADIUS, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """(fp, n): for each query fingerprint (distinct, column fp) the sum of n over the rows of counted (distinct fp, n)
    whose fingerprint differs in at most radius bits; queries without any are left out.

    A block key with more than tile rows, of either side, is split by longer blocks (see simhash.longer); where these don't
    help, both sides are dealt to tiles, and each pair of tiles is a group. No pair is emitted: a group gives one sum a query.
    """
    if blocks is None:
        blocks = blocks_for(counted.count(), radius, rows_per_key=1024)
    rows = counted.select("fp", "n").unionByName(queries.select("fp", F.lit(-1).cast("long").alias("n")))
    level = first_tables(block_masks(radius, blocks))
    tables, ready, before = [], [], 0  # tables: of all levels, numbered on; before: of those above the level
    for depth in range(DEPTH + 1):
        if not depth:
            numbers, now = F.sequence(F.lit(0), F.lit(len(level) - 1)), rows
        else:  # a hot key's rows under the tables that follow from its own
            level, first = longer(level, radius), (F.col("t") - before) * (radius + 1) + len(tables)
            before, numbers, now = len(tables), F.sequence(first, first + radius), hot
        tables += level
        masks = F.array(*[F.lit(m).cast("long") for m, _ in level])
        now = now.select("fp", "n", F.explode(numbers).alias("t")).withColumn("key", F.col("fp").bitwiseAND(F.get(masks, F.col("t") - before)))
        sizes = now.groupBy("t", "key").agg(F.count_if(F.col("n") >= 0).alias("data"), F.count_if(F.col("n") < 0).alias("asked")).where((F.col("data") > tile) | (F.col("asked") > tile))
        sizes = written(sizes, "hot-blocks", thin=True)
        if sizes.isEmpty():
            ready.append(now.withColumns({"d": F.lit(0), "q": F.lit(0)}))
            break
        ready.append(now.join(sizes, ["t", "key"], "left_anti").withColumns({"d": F.lit(0), "q": F.lit(0)}))
        hot = written(now.join(sizes.where("data > 0 AND asked > 0"), ["t", "key"]), "hot-rows")
    else:
        tiles = lambda c: F.ceil(F.col(c) / tile).cast("int")
        mine, all_ = F.pmod(F.xxhash64("fp", "t"), F.greatest(F.lit(1), F.when(F.col("n") >= 0, tiles("data")).otherwise(tiles("asked")))).cast("int"), F.when(F.col("n") >= 0, tiles("asked")).otherwise(tiles("data"))
        dealt = hot.withColumns({"mine": mine, "other": F.explode(F.sequence(F.lit(0), all_ - 1))})
        first = F.col("n") >= 0
        ready.append(dealt.select("fp", "n", "t", "key", F.when(first, F.col("mine")).otherwise(F.col("other")).alias("d"), F.when(first, F.col("other")).otherwise(F.col("mine")).alias("q")))
    both = ready[0]
    for x in ready[1:]:
        both = both.unionByName(x)
    groups = both.select(F.xxhash64("t", "key", "d", "q").alias("g"), F.col("t").cast("long").alias("t"), "n", "fp")
    sums = groups.repartition("g").sortWithinPartitions("g").mapInArrow(_count_within(radius, tables), "fp long, n long")
    return sums.groupBy("fp").agg(F.sum("n").alias("n"))


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed columns, and n_within: for ids divisible by 50, how many other documents are within RADIUS bits; else null."""
    rows = written(neighbour_fingerprints(table(spark, sf_dir, "documents")), "fingerprints")
    asks = F.coalesce(F.col("doc_id") % 50 == 0, F.lit(False))
    counted = written(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "distinct-fingerprints", thin=True)
    before = len(WRITTEN) - 1
    found = written(find_within(rows.where(asks).select("fp").distinct(), counted), "within-radius", thin=True)
    drop(spark, WRITTEN[before:-1])
    out = ["doc_id", "n_chars", "edited_sha256", hex16(F.col("fp")).alias("fingerprint"), hex16(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next"]
    asked = rows.where(asks).join(found, "fp", "left").select(*out, (F.col("n") - 1).alias("n_within"))
    return asked.unionByName(rows.where(~asks).select(*out, F.lit(None).cast("long").alias("n_within")))
