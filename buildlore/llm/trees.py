"""Gradient-boosted trees for a few classes, in numpy: softmax loss, histogram splits, complete trees of a fixed depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass(frozen=True)
class Forest:
    classes: int
    depth: int
    feature: np.ndarray  # (trees, inner nodes); the class of tree i is i modulo classes
    limit: np.ndarray
    value: np.ndarray  # (trees, leaves)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.classes))
        rows = np.arange(len(x))
        for i in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, self.feature[i, at]] > self.limit[i, at])
            out[:, i % self.classes] += self.value[i, at - (2**self.depth - 1)]
        return out

    def log_likelihood(self, x: np.ndarray) -> np.ndarray:
        z = self.raw(x)
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _grow(binned: np.ndarray, cuts: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, rate: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree: features, limits and leaf values, and the leaf of every row."""
    n, width = binned.shape
    feature, limit = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
    at = np.zeros(n, np.int64)
    for level in range(depth):
        first, count = 2**level - 1, 2**level
        own = at - first
        best = np.zeros(count)
        g_all, h_all = np.bincount(own, grad, count), np.bincount(own, hess, count)
        for f in range(width):
            key = own * BINS + binned[:, f]
            g = np.bincount(key, grad, count * BINS).reshape(count, BINS).cumsum(axis=1)
            h = np.bincount(key, hess, count * BINS).reshape(count, BINS).cumsum(axis=1)
            rest_g, rest_h = g_all[:, None] - g, h_all[:, None] - h
            gain = g**2 / (h + 1) + rest_g**2 / (rest_h + 1) - (g_all**2 / (h_all + 1))[:, None]
            gain[(h < least) | (rest_h < least)] = 0
            gain = gain[:, : BINS - 1]
            where = gain.argmax(axis=1)
            top = gain[np.arange(count), where]
            better = top > best + 1e-9
            best[better] = top[better]
            feature[first + np.flatnonzero(better)] = f
            limit[first + np.flatnonzero(better)] = cuts[f, where[better]]
        chosen = feature[at]
        edge = np.array([np.searchsorted(cuts[feature[k]], limit[k]) if np.isfinite(limit[k]) else BINS for k in range(len(limit))])
        at = 2 * at + 1 + (binned[np.arange(n), chosen] > edge[at])
    leaf = at - (2**depth - 1)
    g, h = np.bincount(leaf, grad, 2**depth), np.bincount(leaf, hess, 2**depth)
    return feature, limit, -rate * g / (h + 1), leaf


def fit(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 20, depth: int = 4, rate: float = 0.3, least: float = 1.0) -> Forest:
    """Boosting over the rows of `x`; equal inputs give equal forests."""
    cuts = np.full((x.shape[1], BINS - 1), np.inf)
    for f in range(x.shape[1]):
        own = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1]))
        cuts[f, : len(own)] = own
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(x.shape[1])], axis=1)
    z = np.zeros((len(x), classes))
    trees = []
    for _ in range(rounds):
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for c in range(classes):
            grad, hess = p[:, c] - (y == c), np.maximum(p[:, c] * (1 - p[:, c]), 1e-6)
            feature, limit, value, leaf = _grow(binned, cuts, grad, hess, depth, rate, least)
            z[:, c] += value[leaf]
            trees.append((feature, limit, value))
    return Forest(classes, depth, *(np.stack(part) for part in zip(*trees)))
