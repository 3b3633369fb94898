"""Gradient-boosted trees for a few classes: histograms of binned features, softmax loss, second-order leaves."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Boosted:
    """Complete trees of one depth; ``feature`` and ``cut`` by [tree, inner node], ``leaf`` by [tree, leaf]; tree i votes for class i % classes."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    prior: np.ndarray

    def log_probabilities(self, rows: np.ndarray) -> np.ndarray:
        binned = to_bins(rows, self.edges)
        margins = np.repeat(self.prior[None, :], len(rows), axis=0)
        every = np.arange(len(rows))
        for tree in range(len(self.leaf)):
            at = np.zeros(len(rows), dtype=np.int64)
            for _ in range(int(np.log2(self.leaf.shape[1]))):
                at = 2 * at + 1 + (binned[every, self.feature[tree][at]] > self.cut[tree][at])
            margins[:, tree % len(self.prior)] += self.leaf[tree][at - self.feature.shape[1]]
        top = margins.max(axis=1, keepdims=True)
        return margins - top - np.log(np.exp(margins - top).sum(axis=1, keepdims=True))


def to_bins(rows: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The number of edges below each value, so equal values share a bin."""
    return np.stack([np.searchsorted(e, rows[:, i], "left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)


def _grow(binned, gradient, hessian, depth, bins, ridge, least):
    """One tree: at each level the best cut of every node by its gain; a node without gain sends all rows left."""
    n, width = binned.shape
    feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, bins, np.int64)
    at, columns = np.zeros(n, np.int64), np.arange(width) * bins
    places = binned.astype(np.int64) + columns
    for level in range(depth):
        first, count = 2**level - 1, 2**level
        keys = ((at - first)[:, None] * (width * bins) + places).ravel()
        sums = [
            np.bincount(keys, np.repeat(x, width), count * width * bins).reshape(count, width, bins).cumsum(axis=2)
            for x in (gradient, hessian)
        ]
        (g, h), (g_all, h_all) = sums, (sums[0][:, :, -1:], sums[1][:, :, -1:])
        gain = g**2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
        gain = np.where((h >= least) & (h_all - h >= least), gain, 0.0).reshape(count, -1)
        best = gain.argmax(axis=1)
        found = gain[np.arange(count), best] > 1e-9
        feature[first : first + count] = best // bins
        cut[first : first + count] = np.where(found, best % bins, bins)
        at = 2 * at + 1 + (binned[np.arange(n), feature[at]] > cut[at])
    leaf = at - (2**depth - 1)
    g, h = (np.bincount(leaf, x, 2**depth) for x in (gradient, hessian))
    return feature, cut, -g / (h + ridge), leaf


def fit(rows, labels, weights, classes: int, rounds=40, depth=4, rate=0.25, bins=32, ridge=1.0, least=2.0, share=0.35) -> Boosted:
    """Deterministic; ``labels`` are 0 to ``classes`` - 1, ``weights`` the rows' shares in the loss; each tree sees a ``share`` of the features."""
    rng = np.random.default_rng(0)
    edges = [np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(1) for x in rows.T]
    binned = to_bins(rows, edges)
    wanted = np.eye(classes)[labels]
    prior = np.log((weights @ wanted + 1) / (weights.sum() + classes))
    margins = np.repeat(prior[None, :], len(rows), axis=0)
    trees = []
    for _ in range(rounds):
        p = np.exp(margins - margins.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for k in range(classes):
            gradient, hessian = weights * (p[:, k] - wanted[:, k]), weights * np.maximum(p[:, k] * (1 - p[:, k]), 1e-6)
            seen = np.sort(rng.permutation(rows.shape[1])[: max(1, round(share * rows.shape[1]))])
            feature, cut, values, leaf = _grow(binned[:, seen], gradient, hessian, depth, bins, ridge, least)
            feature = seen[feature]
            margins[:, k] += rate * values[leaf]
            trees.append((feature, cut, rate * values))
    return Boosted(edges, *[np.stack(x) for x in zip(*trees)], prior)
