"""Gradient-boosted trees with logistic loss over binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class BoostedTrees:
    """Complete trees of one depth: tree t tests feature[t, node] > cut[t, node] and adds leaf[t, i]."""

    depth: int = 3
    rounds: int = 60
    rate: float = 0.2
    bins: int = 32
    l2: float = 1.0
    start: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = _sigmoid(margin)
            grad, hess = p - y, p * (1 - p)
            node = np.zeros(len(y), int)
            feature, cut = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                width = 2**level
                g_all = np.bincount(node, grad, width)
                h_all = np.bincount(node, hess, width)
                best = np.full(width, 1e-6)
                chosen = np.zeros(width, int)
                split = np.full(width, -1)
                for j, e in enumerate(edges):
                    n = len(e) + 1
                    g = np.bincount(node * n + binned[:, j], grad, width * n).reshape(width, n).cumsum(1)[:, :-1]
                    h = np.bincount(node * n + binned[:, j], hess, width * n).reshape(width, n).cumsum(1)[:, :-1]
                    if not g.size:
                        continue
                    gr, hr = g_all[:, None] - g, h_all[:, None] - h
                    gain = g**2 / (h + self.l2) + gr**2 / (hr + self.l2) - (g_all**2 / (h_all + self.l2))[:, None]
                    gain[(h < 1e-2) | (hr < 1e-2)] = 0
                    at = gain.argmax(1)
                    top = gain[np.arange(width), at]
                    better = top > best
                    best[better], chosen[better], split[better] = top[better], j, at[better]
                for k in range(width):
                    if split[k] >= 0:
                        feature[width - 1 + k], cut[width - 1 + k] = chosen[k], edges[chosen[k]][split[k]]
                inner = width - 1 + node
                node = 2 * node + (x[np.arange(len(y)), feature[inner]] > cut[inner])
            value = -self.rate * np.bincount(node, grad, 2**self.depth) / (np.bincount(node, hess, 2**self.depth) + self.l2)
            margin += value[node]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(value)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 200) -> BoostedTrees:
        """Platt scaling of the margin on rows that weren't fitted."""
        m = self.margin(x)
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(steps):
            p = _sigmoid(a * m + b)
            g, w = p - target, p * (1 - p) + 1e-9
            da, db = (g * m).sum(), g.sum()
            haa, hab, hbb = (w * m * m).sum() + 1e-6, (w * m).sum(), w.sum() + 1e-6
            det = haa * hbb - hab * hab
            if det <= 1e-12:
                break
            step = np.array([hbb * da - hab * db, haa * db - hab * da]) / det
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.shift = float(a), float(b)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.margin(x) + self.shift)
