"""A generalised additive model with pairwise interactions, boosted.

Each feature is cut into bins. Rounds go through the features in turn and add to each one's lookup table what a shallow
tree over its bins learns from the log-loss gradients of the day, shrunk; then pairs of features that explain most of
what is left get tables of two dimensions in the same way. A score is the sigmoid of an intercept and one table entry
for each feature and pair: vectorised bin additions.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np

BINS, PAIR_BINS = 32, 8
RATE, ROUNDS, PAIR_ROUNDS, PAIRS = 0.1, 120, 40, 8
RIDGE, LEAST_WEIGHT = 1.0, 2.0


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def cuts_of(x: np.ndarray, bins: int) -> np.ndarray:
    """Bounds between bins at quantiles of the values; equal values share a bin."""
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="lower")) if len(x) else np.empty(0)


def binned(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.searchsorted(cuts, x, side="left")


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _step(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return -g / (h + RIDGE)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The best place to cut a run of bins in two, and what it gains; 0 if nothing does."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    gain[(left_h < LEAST_WEIGHT) | (h.sum() - left_h < LEAST_WEIGHT)] = 0
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Steps by bin of a tree with so many leaves over the gradients and weights of the bins."""
    runs = [(0, len(g))]
    while len(runs) < leaves:
        found = [(*_split(g[a:b], h[a:b]), a, b) for a, b in runs]
        gain, at, a, b = max(found)
        if gain <= 1e-9:
            break
        runs.remove((a, b))
        runs += [(a, a + at), (a + at, b)]
    out = np.empty(len(g))
    for a, b in runs:
        out[a:b] = _step(g[a:b].sum(), h[a:b].sum())
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The gain and the steps by bin pair of the best tree that cuts both axes once."""
    corner_g, corner_h = (x.cumsum(0).cumsum(1) for x in (g, h))
    rows, cols = g.shape
    if rows < 2 or cols < 2:
        return 0.0, np.zeros_like(g)
    top_g, top_h = corner_g[:-1, -1:], corner_h[:-1, -1:]
    side_g, side_h = corner_g[-1:, :-1], corner_h[-1:, :-1]
    a_g, a_h = corner_g[:-1, :-1], corner_h[:-1, :-1]
    parts = [(a_g, a_h), (top_g - a_g, top_h - a_h), (side_g - a_g, side_h - a_h), (g.sum() - top_g - side_g + a_g, h.sum() - top_h - side_h + a_h)]
    gain = sum(_gain(x, y) for x, y in parts) - _gain(g.sum(), h.sum())
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    steps = [_step(x[i, j], y[i, j]) for x, y in ((np.broadcast_to(x, gain.shape), np.broadcast_to(y, gain.shape)) for x, y in parts)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = steps
    return float(gain[i, j]), out


@dataclass
class Gam:
    """Cuts and tables by feature, and by pair of features (i, j) over coarser cuts."""

    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, (cuts, values) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += values[binned(x[:, j], cuts)]
        at = {j: binned(x[:, j], self.coarse[j]) for j in {k for p in self.pairs for k in p}}
        for (i, j), values in self.pairs.items():
            out += values[at[i], at[j]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x))


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """The model of features x (rows, features) and labels y (0 or 1). Without both labels it scores their share, and
    without rows 0.5. The same rows in the same order give the same model."""
    share = float(y.mean()) if len(y) else 0.5
    intercept = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    cuts, coarse = ([cuts_of(x[:, j], n) for j in range(x.shape[1])] for n in (BINS, PAIR_BINS))
    model = Gam(intercept, cuts, [np.zeros(len(c) + 1) for c in cuts], coarse)
    if not 0 < share < 1:
        return model
    at = [binned(x[:, j], c) for j, c in enumerate(cuts)]
    logits = np.full(len(y), intercept)

    def sums(where: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        p = sigmoid(logits)
        return np.bincount(where, p - y, n), np.bincount(where, p * (1 - p), n)

    for _ in range(ROUNDS):
        for j, where in enumerate(at):
            if len(cuts[j]):
                step = RATE * tree(*sums(where, len(cuts[j]) + 1))
                model.tables[j] += step
                logits += step[where]

    rough = [binned(x[:, j], c) for j, c in enumerate(coarse)]
    shape = lambda i, j: (len(coarse[i]) + 1, len(coarse[j]) + 1)
    cell = lambda i, j: rough[i] * shape(i, j)[1] + rough[j]

    def learned(i: int, j: int) -> tuple[float, np.ndarray]:
        g, h = (s.reshape(shape(i, j)) for s in sums(cell(i, j), shape(i, j)[0] * shape(i, j)[1]))
        return pair_tree(g, h)

    ranked = sorted(((learned(i, j)[0], i, j) for i, j in combinations(range(len(cuts)), 2)), reverse=True)
    chosen = [(i, j) for gain, i, j in ranked[:PAIRS] if gain > 1e-6]
    for pair in chosen:
        model.pairs[pair] = np.zeros(shape(*pair))
    for _ in range(PAIR_ROUNDS):
        for pair in chosen:
            step = RATE * learned(*pair)[1]
            model.pairs[pair] += step
            logits += step[rough[pair[0]], rough[pair[1]]]
    return model
