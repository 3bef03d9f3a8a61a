"""Bit-sliced Hamming comparison: many fingerprint pairs are compared at once, one bit plane after the other.

A vertical store holds plane b of n fingerprints as n bits, 64 to a machine word. To compare every fingerprint with the
one d places further on, plane b is exclusive-ored with itself shifted by d lanes, and the differing lanes are added to
carry-save counters: a ones and a twos plane and so on, as many as the radius needs, and one for lanes beyond it.
Blocks of 64 lanes in which every lane is beyond the radius (or needs no comparison) are abandoned between planes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Planes that are added between two looks for blocks to abandon.
PLANES_A_LOOK = 8


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(64, words) uint64: plane b holds bit b of fingerprint i in bit i % 64 of word i // 64; two spare words follow."""
    words = -(-len(fps) // 64)
    padded = np.zeros(words * 64, dtype="<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")
    return np.concatenate([planes, np.zeros((64, 2), "<u8")], axis=1)


def pack(mask: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 8, np.uint8)
    packed = np.packbits(mask, bitorder="little")
    out[: len(packed)] = packed
    return out.view("<u8")


def within(planes: np.ndarray, n: int, d: int, radius: int, wanted: np.ndarray) -> np.ndarray:
    """The lanes i < n - d, wanted by a boolean mask, whose fingerprint is within radius bits of that of lane i + d."""
    words = -(-(n - d) // 64)
    alive_lanes = pack(wanted, words)
    blocks = np.flatnonzero(alive_lanes)
    alive = alive_lanes[blocks]
    skip, shift = divmod(d, 64)
    counters = [np.zeros(len(blocks), "<u8") for _ in range(max(1, radius.bit_length()))]
    up, down = np.uint64(shift), np.uint64((64 - shift) % 64)
    for b in range(64):
        if not len(blocks):
            break
        far = planes[b, blocks + skip] >> up
        if shift:
            far |= planes[b, np.minimum(blocks + skip + 1, planes.shape[1] - 1)] << down
        carry = planes[b, blocks] ^ far
        for k, c in enumerate(counters):  # a carry-save step: each plane of the counters takes the carry of the last
            counters[k], carry = c ^ carry, c & carry
        over = carry
        equal = ~np.zeros(len(blocks), "<u8")  # lanes whose counter is above the radius, compared from the top bit
        above = np.zeros(len(blocks), "<u8")
        if radius != (1 << len(counters)) - 1:
            for k in reversed(range(len(counters))):
                if radius >> k & 1:
                    equal &= counters[k]
                else:
                    above |= equal & counters[k]
                    equal &= ~counters[k]
        alive &= ~(over | above)
        if b % PLANES_A_LOOK == PLANES_A_LOOK - 1 and not (keep := alive != 0).all():
            blocks, alive, counters = blocks[keep], alive[keep], [c[keep] for c in counters]
    hits = np.zeros(words, "<u8")
    hits[blocks] = alive
    return np.flatnonzero(np.unpackbits(hits.view(np.uint8), bitorder="little")[: n - d])


def links(fps: np.ndarray, groups: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links within groups: index pairs; equal values of groups must be adjacent.

    Every pair of a group is compared unless links that were found before already join its two sides.
    """
    n = len(fps)
    if n < 2:
        return
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, n])
    keep = np.repeat(sizes > 1, sizes)
    at = np.flatnonzero(keep)
    fps, sizes = fps[at], sizes[sizes > 1]
    n = len(fps)
    if n < 2:
        return
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # lanes of its group from each lane on
    root = np.arange(n)
    planes = planes_of(fps)
    d, shrink_at = 0, 2

    while True:
        d += 1
        if d >= shrink_at:  # lanes of groups that have no pair this far apart are taken out
            size_of = np.repeat(sizes, sizes)
            stay = size_of > d
            if not stay.any():
                return
            if stay.sum() <= 0.7 * n:
                back = np.cumsum(stay) - 1
                root = back[root[stay]]
                at, fps, left, sizes = at[stay], fps[stay], left[stay], sizes[sizes > d]
                n = len(fps)
                planes = planes_of(fps)
            shrink_at = d + max(1, d // 4)
        if d >= n:
            return
        wanted = (left[: n - d] > d) & (root[: n - d] != root[d:])
        if not wanted.any():
            if not (left > d).any():
                return
            continue
        fresh = False
        for i in within(planes, n, d, radius, wanted).tolist():
            a, b = i, i + d
            while root[a] != a:
                root[a] = a = root[root[a]]
            while root[b] != b:
                root[b] = b = root[root[b]]
            if a != b:
                root[max(a, b)] = min(a, b)
                fresh = True
                yield int(at[i]), int(at[i + d])
        if fresh:
            while not np.array_equal(up := root[root], root):
                root = up
