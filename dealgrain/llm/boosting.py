"""Gradient-boosted trees for a yes/no label, small enough to be sent with a task."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Tree:
    """A full binary tree: split feature and limit per inner node, value per leaf."""

    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while len(x) and node[0] < len(self.feature):
            node = 2 * node + 1 + (x[rows, self.feature[node]] > self.limit[node])
        return self.value[node - len(self.feature)] if len(x) else np.zeros(0)


@dataclass(frozen=True)
class Boosted:
    start: float
    trees: tuple[Tree, ...]

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for tree in self.trees:
            total += tree.predict(x)
        return 1 / (1 + np.exp(-total))


def _grow(binned: np.ndarray, edges: list[np.ndarray], slope: np.ndarray, weight: np.ndarray, depth: int, rate: float) -> Tree:
    bins = max(len(e) for e in edges) + 1
    inner = (1 << depth) - 1
    feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
    node = np.zeros(len(binned), np.int64)
    for i in range(inner):
        here = np.flatnonzero(node == i)
        best, cut = 1e-9, -1
        g, h = slope[here].sum(), weight[here].sum()
        for f in range(binned.shape[1]):
            gl = np.cumsum(np.bincount(binned[here, f], weights=slope[here], minlength=bins))[:-1]
            hl = np.cumsum(np.bincount(binned[here, f], weights=weight[here], minlength=bins))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            k = int(np.argmax(gain[: len(edges[f])])) if len(edges[f]) else 0
            if len(edges[f]) and gain[k] > best:
                best, cut, feature[i], limit[i] = gain[k], k, f, edges[f][k]
        node[here] = 2 * i + 1 + (binned[here, feature[i]] > cut if cut >= 0 else 0)
    leaf = node - inner
    leaves = inner + 1
    value = rate * np.bincount(leaf, weights=slope, minlength=leaves) / (np.bincount(leaf, weights=weight, minlength=leaves) + 1)
    return Tree(feature, limit, value)


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 24) -> Boosted:
    """Trees fitted one after another to the gradient of the logistic loss."""
    mean = float(np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4))
    start = float(np.log(mean / (1 - mean)))
    if not len(y) or y.min() == y.max():
        return Boosted(start, ())
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T)], axis=1)
    total, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        tree = _grow(binned, edges, y - p, p * (1 - p), depth, rate)
        trees.append(tree)
        total += tree.predict(x)
    return Boosted(start, tuple(trees))


def calibrated_threshold(score: np.ndarray, label: np.ndarray, precision: float) -> float:
    """The lowest score from which on at least ``precision`` of the rows are positive; above 1 if none is."""
    if not len(score):
        return 2.0
    order = np.argsort(-score, kind="stable")
    ranked = score[order]
    hits = np.cumsum(label[order]) / np.arange(1, len(order) + 1)
    ends = np.append(ranked[1:] != ranked[:-1], True)
    good = np.flatnonzero(ends & (hits >= precision))
    return float(ranked[good[-1]]) if len(good) else 2.0
