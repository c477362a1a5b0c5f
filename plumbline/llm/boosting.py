"""Gradient-boosted trees in numpy: histogram splits, logistic loss, monotonic constraints.

A fitted model is five flat node arrays over all trees; scoring walks every row down a
tree at once. With a constraint of +1 (-1) on a feature, a larger value never lowers
(raises) the score: a split that breaks it is not made, and both children are bounded by
the middle of their values from then on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the rows of x; NaN goes left."""
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                # a leaf's children are itself
                at = np.where(x[rows, self.feature[at]] > self.threshold[at], self.right[at], self.left[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: int = 8, l2: float = 1.0) -> Trees:
    """Without rows, or with one class only, the model is that constant."""
    mean = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(mean / (1 - mean)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], 1) if len(x) else np.zeros(x.shape, int)
    total = np.full(len(y), base)

    def leaf(v: float) -> int:
        i = len(feature)
        feature.append(0), threshold.append(np.inf), left.append(i), right.append(i), value.append(v)
        return i

    def grow(rows: np.ndarray, lo: float, hi: float, level: int) -> int:
        g, h = grad[rows], hess[rows]
        best, v = (1e-6, None), float(np.clip(-g.sum() / (h.sum() + l2), lo, hi))
        if level < depth and len(rows) >= 2 * least:
            parent = g.sum() ** 2 / (h.sum() + l2)
            for f in range(x.shape[1]):
                n = len(edges[f]) + 1
                if n < 2:
                    continue
                c = codes[rows, f]
                gs, hs, ns = (np.cumsum(np.bincount(c, w, n))[:-1] for w in (g, h, None))
                gr, hr, nr = g.sum() - gs, h.sum() - hs, len(rows) - ns
                vl, vr = np.clip(-gs / (hs + l2), lo, hi), np.clip(-gr / (hr + l2), lo, hi)
                gain = gs**2 / (hs + l2) + gr**2 / (hr + l2) - parent
                gain[(ns < least) | (nr < least) | (monotone[f] * (vr - vl) < 0)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), (f, k, float(vl[k]), float(vr[k])))
        if best[1] is None:
            return leaf(rate * v)
        f, k, vl, vr = best[1]
        i, middle = leaf(0.0), (vl + vr) / 2
        goes = codes[rows, f] <= k
        bounds = {0: ((lo, hi), (lo, hi)), 1: ((lo, middle), (middle, hi)), -1: ((middle, hi), (lo, middle))}[int(monotone[f])]
        feature[i], threshold[i] = f, float(edges[f][k])
        left[i], right[i] = grow(rows[goes], *bounds[0], level + 1), grow(rows[~goes], *bounds[1], level + 1)
        return i

    if len(y) and 0 < y.sum() < len(y):
        for _ in range(trees):
            p = 1 / (1 + np.exp(-total))
            grad, hess = p - y, p * (1 - p)
            roots.append(grow(np.arange(len(y)), -np.inf, np.inf, 0))
            model = Trees(0.0, np.array(roots[-1:]), *(np.array(a) for a in (feature, threshold, left, right, value)), depth)
            s = model.score(x)
            total += np.log(s / (1 - s))
    return Trees(base, np.array(roots, int), np.array(feature, int), np.array(threshold), np.array(left, int), np.array(right, int), np.array(value), depth)
