"""Gradient-boosted trees on quantile bins with monotonic constraints, kept as flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All trees in one set of arrays: inner nodes test ``x[feature] <= cut``; a leaf has feature -1."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of ``x``: all rows walk down all trees level by level."""
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                feature = self.feature[at]
                goes_left = x[rows, np.maximum(feature, 0)] <= self.cut[at]
                at = np.where(feature < 0, at, np.where(goes_left, self.left[at], self.right[at]))
            out += self.value[at]
        return 1 / (1 + np.exp(-out))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: np.ndarray,
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.15,
    bins: int = 32,
    least_rows: int = 5,
    ridge: float = 1.0,
) -> Trees:
    """Boost logistic loss. ``monotone``: 1 rising, -1 falling, 0 free, for each feature.

    A split on a constrained feature must order its leaves' values, and their
    midpoint bounds what lies below on either side, so the sum is monotonic.
    With one class only, the model is that constant.
    """
    n, features = x.shape
    nodes: list[list[float]] = []
    mean = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    bias = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(features)] if n else []
    binned = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1) if n else np.zeros((0, features), dtype=int)
    raw = np.full(n, bias)
    roots = []

    def value(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + ridge), low, high))

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left_depth: int, low: float, high: float) -> int:
        me = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        nodes.append([-1, 0.0, me, me, rate * value(gs, hs, low, high)])
        best, split = 1e-6, None
        if left_depth and len(rows) >= 2 * least_rows:
            for f in range(features):
                size = len(cuts[f]) + 1
                if size < 2:
                    continue
                code = binned[rows, f]
                gl = np.cumsum(np.bincount(code, g[rows], size))[:-1]
                hl = np.cumsum(np.bincount(code, h[rows], size))[:-1]
                nl = np.cumsum(np.bincount(code, minlength=size))[:-1]
                vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-(gs - gl) / (hs - hl + ridge), low, high)
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain = np.where((nl >= least_rows) & (len(rows) - nl >= least_rows) & (monotone[f] * (vr - vl) >= 0), gain, 0)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, split = float(gain[k]), (f, k, float(vl[k]), float(vr[k]))
        if split is None:
            raw[rows] += nodes[me][4]
            return me
        f, k, vl, vr = split
        middle, goes_left = (vl + vr) / 2, binned[rows, f] <= k
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(int(monotone[f]), ((low, high), (low, high)))
        a = grow(rows[goes_left], g, h, left_depth - 1, *bounds[0])
        b = grow(rows[~goes_left], g, h, left_depth - 1, *bounds[1])
        nodes[me] = [f, float(cuts[f][k]), a, b, 0.0]
        return me

    for _ in range(trees if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-raw))
        roots.append(grow(np.arange(n), p - y, p * (1 - p), depth, -np.inf, np.inf))
    flat = np.array(nodes, dtype=float).reshape(-1, 5)
    ints = [flat[:, i].astype(np.int64) for i in (0, 2, 3)]
    return Trees(np.array(roots, dtype=np.int64), ints[0], flat[:, 1], ints[1], ints[2], flat[:, 4], bias, depth)
