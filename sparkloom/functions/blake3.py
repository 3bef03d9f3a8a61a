"""BLAKE3 of many byte strings at a time, with numpy: lanes run beside each other through each step.

Chunks of 1024 bytes of all strings are lanes of one compression after the other, 16 blocks at most; chaining values of a
string are then joined in pairs, level by level, again for all strings at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of BLAKE3.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
ORDER = np.array([2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8])
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
BLOCK, CHUNK = 64, 1024


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return x >> np.uint32(n) | x << np.uint32(32 - n)


def _mix(v: np.ndarray, rows: tuple[slice | np.ndarray, ...], x: np.ndarray, y: np.ndarray) -> None:
    """The quarter round on four columns or diagonals at a time."""
    a, b, c, d = rows
    v[a] += v[b] + x
    v[d] = _turn(v[d] ^ v[a], 16)
    v[c] += v[d]
    v[b] = _turn(v[b] ^ v[c], 12)
    v[a] += v[b] + y
    v[d] = _turn(v[d] ^ v[a], 8)
    v[c] += v[d]
    v[b] = _turn(v[b] ^ v[c], 7)


_COLUMNS = tuple(np.arange(4) + 4 * r for r in range(4))
_DIAGONALS = tuple((np.arange(4) + r) % 4 + 4 * r for r in range(4))


def compress(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """New chaining values (8, lanes) from chaining values, block words (16, lanes), and the lanes' counters and flags."""
    lanes = cv.shape[1]
    v = np.empty((16, lanes), np.uint32)
    v[:8], v[8:12] = cv, IV[:4, None]
    v[12], v[13] = (counter & 0xFFFFFFFF).astype(np.uint32), (counter >> 32).astype(np.uint32)
    v[14], v[15] = length, flags
    for r in range(7):
        _mix(v, _COLUMNS, words[0:8:2], words[1:8:2])
        _mix(v, _DIAGONALS, words[8:16:2], words[9:16:2])
        if r < 6:
            words = words[ORDER]
    return v[:8] ^ v[8:]


def digests(messages: Sequence[bytes]) -> list[bytes]:
    """The 32-byte hash of each message."""
    if not messages:
        return []
    sizes = np.array([len(m) for m in messages], np.int64)
    chunks = np.maximum(1, -(-sizes // CHUNK))
    first = np.r_[0, np.cumsum(chunks)]
    data = np.zeros((int(first[-1]), CHUNK), np.uint8)
    flat = data.reshape(-1)
    for m, at in zip(messages, first[:-1].tolist(), strict=True):
        flat[at * CHUNK : at * CHUNK + len(m)] = np.frombuffer(m, np.uint8)
    owner = np.repeat(np.arange(len(messages)), chunks)
    number = np.arange(int(first[-1])) - first[owner]
    left = np.minimum(sizes[owner] - number * CHUNK, CHUNK)
    blocks = np.maximum(1, -(-left // BLOCK))
    words = data.view("<u4").reshape(-1, CHUNK // BLOCK, 16)
    single = chunks[owner] == 1

    cvs = np.repeat(IV[:, None], len(owner), axis=1)
    for b in range(int(blocks.max())):
        on = np.flatnonzero(blocks > b)
        last = blocks[on] == b + 1
        flags = np.where(last, CHUNK_END | np.where(single[on], ROOT, 0), 0) | (CHUNK_START if b == 0 else 0)
        length = np.where(last, left[on] - b * BLOCK, BLOCK)
        cvs[:, on] = compress(cvs[:, on], np.ascontiguousarray(words[on, b].T), number[on], length.astype(np.uint32), flags.astype(np.uint32))

    # a level of the tree: neighbours are joined, an odd one out goes up as it is
    while len(owner) > len(messages):
        at = np.arange(len(owner))
        place = at - np.searchsorted(owner, owner)
        has_right = np.r_[owner[1:] == owner[:-1], False] & (place % 2 == 0)
        lefts = np.flatnonzero(has_right)
        pair = np.concatenate([cvs[:, lefts], cvs[:, lefts + 1]])
        final = np.bincount(owner, minlength=len(messages))[owner[lefts]] == 2
        flags = (PARENT | np.where(final, ROOT, 0)).astype(np.uint32)
        start = np.repeat(IV[:, None], len(lefts), axis=1)
        cvs[:, lefts] = compress(start, pair, np.zeros(len(lefts), np.int64), np.full(len(lefts), BLOCK, np.uint32), flags)
        stays = place % 2 == 0
        cvs, owner = cvs[:, stays], owner[stays]
    raw = np.ascontiguousarray(cvs.T).astype("<u4")
    return [row.tobytes() for row in raw]


def blake3(column: Column) -> Column:
    """The hash of a binary column as 32 bytes; null stays null."""

    @F.arrow_udf("binary")
    def hashed(values: pa.Array) -> pa.Array:
        present = [v.as_py() for v in values.drop_null()]
        found = iter(digests(present))
        return pa.array([next(found) if v.is_valid else None for v in values], pa.binary())

    return hashed(column)


def blake3_hex(column: Column) -> Column:
    return F.lower(F.hex(blake3(column)))
