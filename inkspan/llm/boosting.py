"""Histogram gradient-boosted trees for two classes, trained in numpy and flattened into arrays for scoring.

A tree is complete to `depth`: node i has the children 2i + 1 and 2i + 2. The trees of a model are stacked into arrays
of trees by nodes, so a batch of rows walks all trees at once by `depth` rounds of array indexing. A node that isn't
split sends all rows left.

Defined results: no rows give a model that says one half; rows of one class give that class's smoothed share; repeated
rows count as often as they occur; values are finite numbers.
"""

from __future__ import annotations

import numpy as np


#: Rows that walk the trees together.
ROWS = 4096


class Model:
    def __init__(self, feature, threshold, value, prior: float, depth: int):
        inner = 2**depth - 1
        self.prior, self.depth = prior, depth
        self.feature = np.array(feature, np.int64).reshape(-1, inner)
        self.threshold = np.array(threshold, float).reshape(-1, inner)
        self.value = np.array(value, float).reshape(-1, inner + 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        tree, inner = np.arange(len(self.feature)), self.feature.shape[1]
        total = np.full(len(x), self.prior)
        for lo in range(0, len(x), ROWS):
            part = x[lo : lo + ROWS]
            rows, at = np.arange(len(part))[:, None], np.zeros((len(part), len(tree)), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (part[rows, self.feature[tree, at]] > self.threshold[tree, at])
            total[lo : lo + ROWS] += self.value[tree, at - inner].sum(axis=1)
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.raw(x)))


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, ridge: float = 2.0, least: int = 8) -> Model:
    """x: rows by features, y: 0 or 1."""
    n, m = x.shape
    prior = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    inner = 2**depth - 1
    features, thresholds, values = [], [], []
    if n == 0 or y.min() == y.max():
        return Model(features, thresholds, values, prior, depth)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(m)]
    code = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    width = max(len(e) for e in edges) + 1
    flat = code + np.arange(m) * width
    score = np.full(n, prior)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first = 2**level - 1
            key = ((at - first)[:, None] * (m * width) + flat).ravel()
            size = 2**level * m * width
            sums = [np.cumsum(np.bincount(key, np.repeat(w, m), size).reshape(2**level, m, width), axis=2) for w in (g, h, np.ones(n))]
            (gl, hl, nl), (gt, ht, nt) = sums, [s[:, :, -1:] for s in sums]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(nl < least) | (nt - nl < least)] = 0
            best = gain.reshape(2**level, -1).argmax(axis=1)
            for node in range(2**level):
                f, b = divmod(int(best[node]), width)
                if gain[node, f, b] > 1e-9 and b < len(edges[f]):
                    feature[first + node], threshold[first + node] = f, edges[f][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        score += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Model(features, thresholds, values, prior, depth)
