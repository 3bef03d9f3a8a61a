"""The semantic chunker: sentences whose neighbours are far apart in a vector space begin a new group.

``split_semantic`` is the chunker of one text. The same arithmetic over tables of vectors is in functions.vectors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from ..errors import LoomError
from ..functions.recursive import RecursiveConfig
from .sentences import sentences
from .splitting import Chunk, counter, is_blank, normalized, split, whole

Embedder = Callable[[list[str]], Sequence[Sequence[float]]]


@dataclass(frozen=True)
class SemanticConfig:
    """sizes: of the chunks; a group that is larger is split by them. signal: the name of what embeds sentences."""

    sizes: RecursiveConfig = RecursiveConfig()
    percentile: int = 95
    signal: str = "local:hashed-words"

    def __post_init__(self) -> None:
        if not 1 <= self.percentile <= 99:
            raise LoomError("invalid input", f"percentile {self.percentile} is not between 1 and 99")

    @property
    def fingerprint(self) -> str:
        s = self.sizes
        return f"semantic:v1|signal={self.signal}|metric={s.metric}|max={s.max_size}|min={s.min_size}|percentile={self.percentile}"


@lru_cache(maxsize=1 << 16)
def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def hashed_words(texts: list[str], dimension: int = 64) -> np.ndarray:
    """Deterministic vectors without a model or a network: signed counts of words by hash."""
    out = np.zeros((len(texts), dimension), np.float32)
    for row, text in zip(out, texts, strict=True):
        for word in text.lower().split():
            h = _word_hash(word)
            row[h % dimension] += 1 if h >> 63 else -1
    return out


def distances(vectors: Sequence[Sequence[float]]) -> list[float]:
    """1 less the cosine of neighbours, over the shorter of two vectors; a zero vector stays as it is."""
    sizes = [len(v) for v in vectors]
    rows = np.zeros((len(sizes), max(sizes, default=0)), np.float32)
    for row, v, n in zip(rows, vectors, sizes, strict=True):
        row[:n] = v  # zeros behind a shorter vector add nothing to a product
    norms = np.sqrt((rows * rows).sum(1, dtype=np.float32, keepdims=True))
    unit = np.divide(rows, norms, out=rows.copy(), where=norms != 0)
    return (np.float32(1) - (unit[:-1] * unit[1:]).sum(1, dtype=np.float32)).tolist()


def percentile(values: list[float], p: float) -> float:
    """Between the two values around rank p / 100 * (n - 1), in proportion."""
    if not values:
        return 0.0
    ordered = sorted(values)
    rank = p / 100 * (len(ordered) - 1)
    low = math.floor(rank)
    high = math.ceil(rank)
    return ordered[low] + (rank - low) * (ordered[high] - ordered[low])


def groups_of(apart: list[float], p: float) -> list[tuple[int, int]]:
    """First and last item of each group of items whose distances aren't above the percentile."""
    limit = percentile(apart, p)
    starts = [0, *(i + 1 for i, d in enumerate(apart) if d > limit)]
    return list(zip(starts, [*(s - 1 for s in starts[1:]), len(apart)], strict=True))


def merged(groups: list[tuple[int, int]], size: Callable[[tuple[int, int]], int], least: int) -> list[tuple[int, int]]:
    """A group that is smaller than least by itself joins the one before it; the first has none to join."""
    out: list[tuple[int, int]] = []
    for g in groups:
        if out and least and size(g) < least:
            out[-1] = (out[-1][0], g[1])
        else:
            out.append(g)
    return out


def split_semantic(text: str, config: SemanticConfig, embed: Embedder) -> list[Chunk]:
    """The chunks of a text, which is normalised first, so that offsets agree with those of the other chunkers."""
    text = normalized(text)
    if not text:
        return []
    sizes, count = config.sizes, counter(config.sizes)
    spans = sentences(text)
    if len(spans) < 2:
        return [whole(text, "Forced")] if count(text) <= sizes.max_size else split(text, sizes)
    vectors = embed([text[a:b] for a, b in spans])
    if len(vectors) != len(spans):
        raise LoomError("internal", f"count mismatch: expected {len(spans)}, got {len(vectors)}")
    span = lambda g: (spans[g[0]][0], spans[g[1]][1])
    groups = merged(groups_of(distances(vectors), config.percentile), lambda g: count(text[slice(*span(g))]), sizes.min_size)
    out: list[Chunk] = []
    byte = last = 0
    for a, b in map(span, groups):
        byte += len(text[last:a].encode("utf-8", "surrogatepass"))
        last = a
        slab = text[a:b]
        if is_blank(slab):
            continue
        if count(slab) <= sizes.max_size:
            out.append(whole(slab, "Paragraph", byte))
        else:
            out += [{**c, "start_byte": c["start_byte"] + byte, "end_byte": c["end_byte"] + byte} for c in split(slab, sizes)]
    return [{**c, "index": i} for i, c in enumerate(out)]
