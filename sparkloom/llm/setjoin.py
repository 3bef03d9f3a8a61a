"""Pairs of sets with a Jaccard similarity of t or more, without loss: a prefix join that spares pairs already joined.

1. A set's members are put in one order that holds for all sets. Two sets that meet t share a member of both their prefixes,
   the first len - ceil(t * len) + 1 members, and the first one that they share stands early enough in both that what follows
   can still reach t. So sets are dealt out by the members of their prefixes, and each such group is compared within itself.
2. The order is that of the members' hashes, with frequent members behind the others, by their number: prefixes so hold what few
   sets share. One set of ONE_IN is counted for that; as any order is right, a member that the count missed costs time only.
   Members whose group still has more than TILE sets move to the end of the order, and the sets that have one in their prefix
   are joined once more, up to ROUNDS times; no other pair can have been missed.
3. Groups that are still as large are dealt out to tiles, and each pair of tiles is one group: no cap leaves a pair out.
4. Pairs of a component that known links have already joined are not told, so a large group of near copies isn't squared.
5. Pairs that are told are held against parities of their members, a bit or two a member (see parities): those refute nearly all
   pairs that don't meet t, and none that does, so few sets need be fetched whole.

Sets of equal members are one node, whose id is a hash of them. All sets without members are one node, which meets no other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .simhash import fingerprint, shingle_hashes

#: Sets that share a member of their prefixes and are compared within one group; above it the member moves to the end.
TILE = 256
#: One text of so many is looked at for frequent members; a member is frequent that OFTEN of those have; at most MOST_FREQUENT
#: are told, the most frequent ones.
ONE_IN, OFTEN, MOST_FREQUENT = 16, 4, 200_000
#: How often members of large groups are moved to the end of the order.
ROUNDS = 3
#: Rows of groups that a task compares at a time.
ROWS_AT_ONCE = 1 << 17
#: Nodes that a task remembers, so that of equal sets it deals out one.
REMEMBERED = 1 << 20
#: Against rounding in bounds that may only let too much through.
SLACK = 1e-6
_NONE = np.zeros(0, np.int64)
#: Members that come behind all others, in order, and the place of each among these: members of one place go by their hash.
Behind = tuple[np.ndarray, np.ndarray]


def shingle_set(text: str | None, width: int, lower: bool = True) -> np.ndarray:
    """The different hashes of a text's shingles, in order."""
    parts = [np.array(part, np.uint64).view(np.int64) for part in shingle_hashes(text, width, lower=lower)]
    return np.unique(np.concatenate([_NONE, *parts]))


def node_of(members: np.ndarray) -> int:
    """The id of a set, signed."""
    h = xxhash.xxh64_intdigest(members.tobytes())
    return h - (1 << 64) if h >> 63 else h


def prefix(members: np.ndarray, similarity: float, behind: Behind) -> np.ndarray:
    """The prefix of a set, given by its hashes in order."""
    n = len(members)
    last, places = behind
    if len(last) and n:
        at = np.minimum(np.searchsorted(last, members), len(last) - 1)
        late = last[at] == members
        members = np.concatenate([members[~late], members[late][np.argsort(places[at[late]], kind="stable")]])
    return members[: n - int(np.ceil(similarity * n - SLACK)) + 1]


def parities(members: np.ndarray) -> bytes:
    """For each value of the members' lowest bits, one value a member or two, whether an odd number of members has it."""
    bits = max(64, 1 << (len(members) - 1).bit_length() if len(members) else 0)
    odd = np.bincount(members & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def parities_differ(x: bytes, y: bytes) -> int:
    """How many parities of two sets differ: no more than the members that only one of them has."""
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    wide, narrow = (a, b) if len(x) >= len(y) else (b, a)
    size, least = 8 * max(len(x), len(y)), 8 * min(len(x), len(y))
    while size > least:  # fewer of the lowest bits
        size //= 2
        wide = wide >> size ^ wide & (1 << size) - 1
    return (wide ^ narrow).bit_count()


def not_refuted(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes that can meet the similarity by their sizes and parities; nodes is a table (node, n, odd)."""

    @F.arrow_udf("long")
    def differ(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([parities_differ(a.as_py(), b.as_py()) for a, b in zip(x, y, strict=True)], pa.int64())

    for k in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("odd").alias(f"odd{k}")), k)
    most = (F.col("na").cast("long") + F.col("nb")) * ((1 - similarity) / (1 + similarity)) + SLACK
    return pairs.where(F.abs(F.col("na") - F.col("nb")) <= most).where(differ("odda", "oddb") <= most).select("a", "b")


def frequent(texts: DataFrame, width: int) -> Behind:
    """The members of many sets of shingles, by their number among one of ONE_IN texts."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_NONE, *sets]))], names=["member"])

    text = F.col(texts.columns[0])
    counts = texts.where(F.pmod(F.xxhash64(text), F.lit(ONE_IN)) == 0).mapInArrow(members, "member long").groupBy("member").count()
    most = counts.where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "member").limit(MOST_FREQUENT).toArrow()
    found, n = (np.asarray(most.column(i).to_numpy(), np.int64) for i in (0, 1))
    order = np.argsort(found)
    return found[order], n[order]


def sketch_udf(width: int, similarity: float, fingerprint_width: int, behind: Behind) -> Callable:
    """Of a text: its SimHash fingerprint, and the node, size, prefix and parities of its set of shingles."""

    @F.arrow_udf("struct<fp: bigint, odd: binary, node: bigint, n: int, prefix: array<bigint>>")
    def of(texts: pa.Array) -> pa.Array:
        fps = np.fromiter((fingerprint(t.as_py(), fingerprint_width) for t in texts), np.uint64, len(texts))
        sets = [shingle_set(t.as_py(), width) for t in texts]
        return _structs([("fp", pa.array(fps.view(np.int64))), ("odd", pa.array([parities(s) for s in sets], pa.binary()))], sets, [prefix(s, similarity, behind) for s in sets])

    return of


def _late_udf(width: int, similarity: float, behind: Behind, before: Behind, hot: np.ndarray) -> Callable:
    """As sketch_udf without fingerprints and parities; without a prefix where that of the order before has no member in hot."""

    @F.arrow_udf("struct<node: bigint, n: int, prefix: array<bigint>>")
    def of(texts: pa.Array) -> pa.Array:
        sets = [shingle_set(t.as_py(), width) for t in texts]
        again = [np.isin(prefix(s, similarity, before), hot).any() for s in sets]
        return _structs([], sets, [prefix(s, similarity, behind) if m else _NONE for s, m in zip(sets, again, strict=True)])

    return of


def _structs(more: list[tuple[str, pa.Array]], sets: list[np.ndarray], prefixes: list[np.ndarray]) -> pa.Array:
    columns = more + [
        ("node", pa.array([node_of(s) for s in sets], pa.int64())),
        ("n", pa.array([len(s) for s in sets], pa.int32())),
        ("prefix", pa.array(prefixes, pa.list_(pa.int64()))),
    ]
    return pa.StructArray.from_arrays([c for _, c in columns], names=[name for name, _ in columns])


_DEALT = "member long, node long, root long, n int, at int"


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each member of the prefixes of (node, n, prefix, root); of equal sets of a task only one is dealt out.

    root is null for nodes that no known link joins, which takes less room.
    """
    seen: set[int] = set()
    for batch in batches:
        nodes = batch.column(0).to_pylist()
        new = []
        for i, node in enumerate(nodes):
            if node not in seen:
                new.append(i)
                if len(seen) < REMEMBERED:
                    seen.add(node)
        batch = batch.take(pa.array(new, pa.int64()))
        lists = batch.column(2)
        times = lists.value_lengths().to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(times)), times)
        if len(of):
            at = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
            node, n, root = (batch.column(i).take(pa.array(of)) for i in (0, 1, 3))
            yield pa.RecordBatch.from_arrays([lists.flatten(), node, root, n, pa.array(at.astype(np.int32))], names=["member", "node", "root", "n", "at"])


def _pairs(group: np.ndarray, node: np.ndarray, root: np.ndarray, n: np.ndarray, at: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes of a group that can meet the similarity and that no known links join; rows come ordered by group."""
    a, b = [], []
    most = similarity / (1 + similarity)
    left, d = n - at, 0
    while len(group) > 1:
        d += 1
        same = group[d:] == group[:-d]
        if not same.any():
            break
        i = np.flatnonzero(same & (root[d:] != root[:-d]))
        j = i + d
        i, j = (x[np.minimum(left[i], left[j]) >= most * (n[i].astype(np.int64) + n[j]) - SLACK] for x in (i, j))
        a.append(np.minimum(node[i], node[j]))
        b.append(np.maximum(node[i], node[j]))
        if d % 8 == 0:  # rows of groups that have no pair this far apart are taken out
            stay = np.zeros(len(group), bool)
            stay[:-d] |= same
            stay[d:] |= same
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            stay = np.repeat(np.logical_or.reduceat(stay, first), np.diff(np.r_[first, len(group)]))
            group, node, root, n, at, left = (x[stay] for x in (group, node, root, n, at, left))
    return (np.concatenate(a), np.concatenate(b)) if a else (_NONE, _NONE)


def _compare(similarity: float, tile: int | None, members: bool) -> Callable:
    """Over (group, node, root, n, at) ordered by group and node: rows (a, b) for pairs, b not null; and for groups of more
    than tile nodes instead one row (group), or with members all their rows (group, null, node, root, n, at)."""
    names = ["a", "b", "node", "root", "n", "at"]

    def hot_rows(rows: list[np.ndarray]) -> pa.RecordBatch:
        g, node, root, n, at = rows
        return pa.RecordBatch.from_arrays([pa.array(g), pa.nulls(len(g), pa.int64()), pa.array(node), pa.array(root), pa.array(n), pa.array(at)], names=names)

    def told(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        none = [pa.nulls(len(a), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *none], names=names)

    def whole(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])
        sizes = np.diff(np.r_[first, len(rows[0])])
        size = np.repeat(sizes, sizes)
        if tile is not None and (size > tile).any():
            hot = [x[size > tile] for x in rows]
            yield hot_rows(hot if members else [x[first[sizes > tile]] for x in rows])
        some = (size > 1) & (size <= (tile or len(size)))
        a, b = _pairs(*(x[some] for x in rows), similarity)
        if len(a):
            pairs = np.unique(np.stack([a, b]), axis=1)
            yield told(pairs[0], pairs[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        hot, last = None, None  # the group whose rows go out at once, and the row before
        for batch in batches:
            rows = [x.to_numpy(zero_copy_only=False) for x in (*batch.columns[:2], pc.coalesce(batch.column(2), batch.column(1)), *batch.columns[3:])]
            if not len(rows[0]):
                continue
            new = np.r_[last != (rows[0][0], rows[1][0]), (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])]
            last = (rows[0][-1], rows[1][-1])
            rows = [x[new] for x in rows]
            if hot is not None:
                more = rows[0] == hot
                if members and more.any():
                    yield hot_rows([x[more] for x in rows])
                rows = [x[~more] for x in rows]
                if len(rows[0]):
                    hot = None
            if len(rows[0]):
                held.append(rows)
            if sum(len(x[0]) for x in held) < ROWS_AT_ONCE:
                continue
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.flatnonzero(rows[0] == rows[0][-1])[0])  # the last group may go on
            if cut:
                yield from whole([x[:cut] for x in rows])
            rows, held = [x[cut:] for x in rows], []
            if tile is not None and len(rows[0]) > tile:
                hot = rows[0][-1]
                yield hot_rows(rows if members else [x[:1] for x in rows])
            else:
                held = [rows]
        if held:
            yield from whole([np.concatenate(x) for x in zip(*held, strict=True)])

    return run


_TOLD = "a long, b long, node long, root long, n int, at int"


def similar_sets(sets: DataFrame, texts: DataFrame, roots: DataFrame | None, settle: Callable[[DataFrame], DataFrame | None], width: int, similarity: float, behind: Behind, tile: int = TILE, rounds: int = ROUNDS) -> None:
    """Tells settle, a table (a, b) at a time, all pairs of nodes that can meet the similarity and that roots doesn't join.

    sets: a written table (node, n, prefix), by the order that behind gives; texts: those it comes from, the only column.
    roots: (node, root) of nodes that known links join. settle returns the roots after the links that it found.
    """
    before, hot = behind, _NONE
    turn, final = 0, rounds == 0
    while True:
        if turn:
            now = texts.select(_late_udf(width, similarity, behind, before, hot)(F.col(texts.columns[0])).alias("s")).select("s.node", "s.n", "s.prefix")
        else:
            now = sets.select("node", "n", "prefix")
        dealt = _with_roots(now, roots).select("node", "n", "prefix", "root").mapInArrow(_deal, _DEALT)
        ordered = dealt.repartition("member").sortWithinPartitions("member", "node")
        found = written(ordered.mapInArrow(_compare(similarity, tile, members=final), _TOLD), "similar-candidates", thin=True)
        roots = settle(found.where("b IS NOT NULL").select("a", "b"))
        large = found.where("b IS NULL")
        if large.isEmpty():
            return
        if final:
            settle(written(_tiled(large, roots, similarity, tile), "tiled-candidates", thin=True))
            return
        hot = np.unique(np.array([r[0] for r in large.select("a").distinct().toLocalIterator()], np.int64))
        new = np.setdiff1d(hot, behind[0])
        last = np.concatenate([behind[0], new])
        places = np.concatenate([behind[1], np.full(len(new), behind[1].max(initial=0) + 1)])
        order = np.argsort(last)
        before, behind = behind, (last[order], places[order])
        turn += 1
        final = turn >= rounds or not len(new)


def _with_roots(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    return rows.withColumn("root", F.lit(None).cast("long")) if roots is None else rows.join(roots, "node", "left")


def _tiled(hot: DataFrame, roots: DataFrame | None, similarity: float, tile: int) -> DataFrame:
    """The pairs within groups of more than tile nodes, each pair of tiles as a group."""
    sizes = hot.groupBy(F.col("a").alias("member")).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    rows = _with_roots(hot.select(F.col("a").alias("member"), "node", "n", "at"), roots)
    rows = rows.join(written(sizes, "hot-members", thin=True), "member").withColumn("mine", F.pmod(F.xxhash64("node", "member"), F.col("tiles")))
    pairs = rows.select("*", F.explode(F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda i: i != F.col("mine"))).alias("other"))
    # two groups that share a 64-bit number are compared together, which costs time but is exact
    grouped = pairs.select(F.xxhash64("member", F.least("mine", "other"), F.greatest("mine", "other")).alias("member"), "node", "root", "n", "at")
    ordered = grouped.repartition("member").sortWithinPartitions("member", "node")
    return ordered.mapInArrow(_compare(similarity, None, members=False), _TOLD).select("a", "b")
