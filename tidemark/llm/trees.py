"""Gradient-boosted trees over histograms, kept as flat arrays that numpy walks for many rows at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: node n has the children 2n+1 and 2n+2; leaves are numbered from the left."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes; a value up to it goes left
    value: np.ndarray  # trees x leaves
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - inner]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, bins: int = 64, rate: float = 0.15,
              ridge: float = 1.0) -> Trees:
    """Logistic loss; the split of a node is the best by the gradient sums of its histogram.

    Without rows, or with one label only, the trees are empty and every row gets the share of label 1 (1 without rows).
    """
    inner, leaves = (1 << depth) - 1, 1 << depth
    share = float(y.mean()) if len(y) else 1.0
    base = float(np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3))))
    if len(y) == 0 or share in (0.0, 1.0):
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    n, f = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    place = binned + np.arange(f) * bins
    score = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (f * bins) + place).ravel()
            g, h = (np.bincount(at, np.repeat(v, f), width * f * bins).reshape(width, f, bins).cumsum(axis=2)
                    for v in (grad, hess))
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g ** 2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all ** 2 / (h_all + ridge)
            for w in range(width):
                for j in range(f):
                    gain[w, j, len(cuts[j]):] = 0  # nothing lies beyond the last edge
                j, b = np.unravel_index(gain[w].argmax(), (f, bins))
                if gain[w, j, b] > 1e-9:
                    feature[first + w], threshold[first + w] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + ridge)
        score += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), base)
