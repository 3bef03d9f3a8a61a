"""SimHash kernels: XXH64 hashes of word shingles vote on the 64 bits of a fingerprint."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash

BITS = 64
#: Shingle hashes that are unpacked into bits at a time: 64 bytes each.
VOTES_AT_ONCE = 1 << 15

hash_bytes = xxhash.xxh64_intdigest


def shingle_hashes(text: str | None, width: int, seed: int = 42, lower: bool = True, at_once: int = VOTES_AT_ONCE) -> Iterator[list[int]]:
    """Hashes of all shingles of width words, repeats included, in lists of bounded length.

    Fewer words than width give one shingle of them all; no word gives none. lower: A-Z only are lower-cased.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = (raw.lower() if lower else raw).split()
    if not words:
        return
    if len(words) < width:
        yield [hash_bytes(b" ".join(words), seed)]
        return
    join = b" ".join
    for at in range(0, len(words) - width + 1, at_once):
        part = words[at : at + at_once + width - 1]
        yield [hash_bytes(join(x), seed) for x in zip(*(part[i:] for i in range(width)), strict=False)]


def bit_votes(hashes: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """For each of the 64 bits, least significant first, the weight of the hashes that set it."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(0, dtype=np.int64) if weights is None else weights.astype(np.int64) @ bits.astype(np.int64)


def majority(lists: Iterable[list[int]]) -> int:
    """The fingerprint, unsigned: a bit is 1 if set in over half of the weight. No hash gives 0."""
    votes, total = np.zeros(BITS, np.int64), 0
    for part in lists:
        votes += bit_votes(np.array(part, dtype=np.uint64))
        total += len(part)
    return int(np.packbits(2 * votes > total, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int, seed: int = 42, lower: bool = True) -> int:
    return majority(shingle_hashes(text, width, seed, lower))


def fingerprint_udf(width: int, seed: int = 42, lower: bool = True) -> Callable:
    """An Arrow UDF from text to the fingerprint as a signed long; memory is bounded by an Arrow batch."""
    from pyspark.sql import functions as F

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(t.as_py(), width, seed, lower) for t in texts), dtype=np.uint64, count=len(texts))
        return pa.array(found.view(np.int64))

    return simhash


def hex16(column):  # noqa: ANN001, ANN201
    """A long as 16 lowercase hex digits, least negative as unsigned."""
    from pyspark.sql import functions as F

    return F.lower(F.lpad(F.hex(column), 16, "0"))


def block_masks(radius: int, blocks: int) -> list[int]:
    """One mask for each choice of blocks - radius of the blocks, as signed longs.

    Two fingerprints that differ in at most radius bits differ in at most radius blocks, so they agree wholly under one
    mask at least. More blocks make the agreeing part longer: fewer rows share a key, at the price of more tables.
    """
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("radius must be below the number of blocks, and blocks at most 64")
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, blocks - radius)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


#: How often a key that too many fingerprints share is split by longer(), at most.
DEPTH = 2
#: A table of the search: its mask, and those of the tables before it, of which a pair that it tells may share none.
BlockTable = tuple[int, tuple[int, ...]]


def first_tables(masks: list[int]) -> list[BlockTable]:
    return [(m, tuple(masks[:i])) for i, m in enumerate(masks)]


def longer(tables: list[BlockTable], radius: int) -> list[BlockTable]:
    """For each table radius + 1 tables, in its place, for keys that too many fingerprints share.

    Two fingerprints that agree under a mask and differ in at most radius bits agree on one at least of radius + 1 parts of
    the bits outside the mask, so those of a key are looked up again under the mask and each of these parts, which makes keys
    longer without losing a pair. A pair belongs to the first of the tables.
    """
    out = []
    for mask, before in tables:
        rest = [b for b in range(BITS) if not mask >> b & 1]
        parts = [sum(1 << b for b in rest[i :: radius + 1]) for i in range(radius + 1)]  # bits from everywhere
        wide = [m - (1 << BITS) if m >> (BITS - 1) else m for m in ((mask | p) & (1 << BITS) - 1 for p in parts)]
        out += [(m, (*before, *wide[:i])) for i, m in enumerate(wide)]
    return out


def blocks_for(n: int, radius: int, rows_per_key: int = 256) -> int:
    """The fewest blocks whose shortest table key spreads n evenly distributed fingerprints to rows_per_key a key."""
    for blocks in range(radius + 1, BITS + 1):
        cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
        widths = sorted(b - a for a, b in zip(cuts, cuts[1:], strict=False))
        if n <= rows_per_key << sum(widths[: blocks - radius]) or blocks >= 2 * radius + 2:
            return blocks
    return BITS
