"""Gradient-boosted trees on histograms, flattened into node arrays; logistic loss, monotone constraints.

A feature's direction +1 (-1) means that its growth never lowers (raises) the score: splits whose children would stand
the wrong way are not taken, and the middle of the two children bounds all that grows below them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Node i goes left if x[feature[i]] <= threshold[i]; a leaf points at itself. roots: each tree's first node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds for rows of features."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for col in x.T]


def fit(x: np.ndarray, y: np.ndarray, directions: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, least_weight: float = 5.0, ridge: float = 1.0) -> Forest:
    """y: 0 or 1."""
    edges = _edges(x, bins)
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    score = np.full(len(y), start)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, curve = y - p, np.maximum(p * (1 - p), 1e-6)
        roots.append(len(nodes))
        nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
        todo = [(roots[-1], np.arange(len(y)), -np.inf, np.inf, 0)]
        while todo:
            me, rows, low, high, level = todo.pop()
            g, h = grad[rows].sum(), curve[rows].sum()
            value = float(np.clip(g / (h + ridge), low, high))
            best = None
            if level < depth:
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    gs = np.cumsum(np.bincount(binned[f, rows], grad[rows], len(e) + 1))[:-1]
                    hs = np.cumsum(np.bincount(binned[f, rows], curve[rows], len(e) + 1))[:-1]
                    vl, vr = np.clip(gs / (hs + ridge), low, high), np.clip((g - gs) / (h - hs + ridge), low, high)
                    gain = gs * vl - 0.5 * (hs + ridge) * vl**2 + (g - gs) * vr - 0.5 * (h - hs + ridge) * vr**2
                    fine = (hs >= least_weight) & (h - hs >= least_weight) & (directions[f] * (vr - vl) >= 0)
                    if fine.any():
                        k = int(np.argmax(np.where(fine, gain, -np.inf)))
                        if best is None or gain[k] > best[0]:
                            best = (gain[k], f, k, float(vl[k]), float(vr[k]))
            if best is None or best[0] <= g * value - 0.5 * (h + ridge) * value**2 + 1e-6:
                nodes[me] = [0, np.inf, me, me, rate * value]
                score[rows] += rate * value
                continue
            _, f, k, vl, vr = best
            goes = binned[f, rows] <= k
            a, b = len(nodes), len(nodes) + 1
            nodes[me] = [f, edges[f][k], a, b, 0.0]
            nodes += [[0, np.inf, a, a, 0.0], [0, np.inf, b, b, 0.0]]
            middle, way = (vl + vr) / 2, directions[f]
            todo.append((a, rows[goes], middle if way < 0 else low, middle if way > 0 else high, level + 1))
            todo.append((b, rows[~goes], middle if way > 0 else low, middle if way < 0 else high, level + 1))
    flat = np.array(nodes, float)
    as_int = lambda k: flat[:, k].astype(np.int64)
    return Forest(as_int(0), flat[:, 1], as_int(2), as_int(3), flat[:, 4], np.array(roots), start, depth)
