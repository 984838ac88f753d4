"""Gradient-boosted trees on binned features, small enough to fit on the driver from a bounded sample.

Trees are complete to their depth and kept as arrays, so that a batch of rows
is scored level by level without a loop over rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32
#: Boosting ends when probabilities are off by no more than this on average.
ENOUGH = 2e-3


@dataclass
class Trees:
    base: float
    edges: list[np.ndarray]
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # go right if the bin is over the cut
    leaf: np.ndarray  # trees x leaves

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8) if len(x) and self.edges else np.zeros((len(x), len(self.edges)), np.uint8)

    def __post_init__(self) -> None:
        # a row goes right if its value is over the edge at the cut, so rows need not be binned to be scored
        self.values = np.full(self.feature.shape, np.inf, np.float32)
        for j, e in enumerate(self.edges):
            here = (self.feature == j) & (self.cut < len(e))
            self.values[here] = e[self.cut[here]]
        self.reach = np.append(np.cumsum(self.leaf.max(1)[::-1])[::-1], 0.0) if len(self.leaf) else np.zeros(1)

    def _add(self, x: np.ndarray, score: np.ndarray, first: int, last: int) -> None:
        inner, rows = self.feature.shape[1], np.arange(len(x))
        for f, v, leaf in zip(self.feature[first:last], self.values[first:last], self.leaf[first:last], strict=True):
            at = np.zeros(len(x), np.int64)
            while len(x) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > v[at])
            score += leaf[at - inner]

    def probability(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.float32)
        score = np.full(len(x), self.base)
        self._add(x, score, 0, len(self.feature))
        return 1 / (1 + np.exp(-score))

    def reaching(self, x: np.ndarray, threshold: float, step: int = 6) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose probability is at least ``threshold`` and their probabilities.

        A row is left as soon as the best leaves of all trees to come could not lift it to the threshold.
        """
        goal = float(np.log(threshold / (1 - threshold))) - 1e-9
        rows, score = np.arange(len(x)), np.full(len(x), self.base)
        for first in range(0, len(self.feature), step):
            alive = score + self.reach[first] >= goal
            if not alive.all():
                rows, score, x = rows[alive], score[alive], x[alive]
            self._add(x, score, first, first + step)
        p = 1 / (1 + np.exp(-score))
        keep = p >= threshold
        return rows[keep], p[keep]


def nothing() -> Trees:
    """Trees that accept no row."""
    return Trees(-20.0, [], np.zeros((0, 15), np.int64), np.zeros((0, 15), np.int64), np.zeros((0, 16)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 48, depth: int = 4, rate: float = 0.2, l2: float = 1.0, least: float = 4.0) -> Trees:
    """Logistic boosting with exact histograms of the binned features; no randomness."""
    x, y = np.asarray(x, np.float32), np.asarray(y, np.float64)
    p = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(p / (1 - p)))
    inner, width = 2**depth - 1, x.shape[1] if x.ndim == 2 else 0
    edges = []
    for j in range(width):
        values = np.unique(x[:, j])
        mids = (values[1:] + values[:-1]) / 2 if len(values) <= BINS else np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]))
        edges.append(mids.astype(np.float32))
    empty = Trees(base, edges, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.int64), np.zeros((0, inner + 1)))
    if not len(y) or y.min() == y.max() or not width:
        return empty
    b = np.ascontiguousarray(empty.binned(x).T).astype(np.int64)  # one row a feature
    split = [j for j in range(width) if len(edges[j])]
    if not split:
        return empty
    score = np.full(len(y), base)
    features, cuts, leaves = [], [], []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-score))
        g, h = q - y, q * (1 - q)
        if np.abs(g).mean() < ENOUGH:
            break
        node = np.zeros(len(y), np.int64)
        f_t, c_t = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            local = node - first
            # histograms of the left children are counted, those of the right ones are what their parents have besides
            left = np.flatnonzero(local % 2 == 0) if level else slice(None)
            width_l = n // 2 if level else 1
            first_bin, g_l, h_l = (local[left] >> 1 if level else local) * BINS, g[left], h[left]
            hists = np.empty((2, len(split), n, BINS))
            for k, j in enumerate(split):
                key = first_bin + b[j][left]
                for m, weight in enumerate((g_l, h_l)):
                    hists[m, k, ::2] = np.bincount(key, weight, width_l * BINS).reshape(width_l, BINS)
            if level:
                hists[:, :, 1::2] = parents - hists[:, :, ::2]
            parents = hists
            gl, hl = hists.cumsum(3)
            gt, ht = gl[..., -1:], hl[..., -1:]
            got = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            got[(hl < least) | (ht - hl < least)] = 0
            flat = got.transpose(1, 0, 2).reshape(n, -1)
            at = flat.argmax(1)
            better = flat[np.arange(n), at] > 1e-9
            f_best = np.where(better, np.array(split)[at // BINS], 0)
            c_best = np.where(better, at % BINS, BINS)
            f_t[first : first + n], c_t[first : first + n] = f_best, c_best
            node = 2 * node + 1 + (b[f_best[local], np.arange(len(y))] > c_best[local])
        at = node - inner
        leaf = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + l2)
        score += leaf[at]
        features.append(f_t)
        cuts.append(c_t)
        leaves.append(leaf)
    return Trees(base, edges, np.array(features), np.array(cuts), np.array(leaves))


def calibrated_threshold(p: np.ndarray, y: np.ndarray, slack: float = 0.002, beta: float = 1.0) -> float:
    """The lowest cut of held-out probabilities whose F score is within ``slack`` of the best (0.5 where there is nothing to choose).

    A ``beta`` over 1 weighs what is missed more than what is wrongly taken.
    Among about equally good cuts the one that misses least is taken.
    """
    if not len(y) or not y.any():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = (1 + beta**2) * hits / (np.arange(1, len(y) + 1) + beta**2 * y.sum())
    # a cut lies between two different probabilities only
    last = np.append(p[order][1:] != p[order][:-1], True)
    f1[~last] = -1
    k = int(np.flatnonzero(f1 >= f1.max() - slack)[-1])
    after = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float(min(0.95, max(0.05, (p[order][k] + after) / 2)))
