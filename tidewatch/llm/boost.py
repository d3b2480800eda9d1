"""Gradient-boosted trees with monotonic constraints, kept as flat node arrays.

Every tree is complete: node ``i`` has the children ``2 i + 1`` and ``2 i + 2``, so a tree is one
row of ``feature``, ``threshold`` and ``value`` arrays and scoring is a few vectorised lookups per
level. A constrained feature moves the score one way only.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Trees(NamedTuple):
    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # a value above it goes right
    value: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out = np.full(len(x), self.base)
        inner, rows = self.feature.shape[1], np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - inner]
        return out


def fit(
    x: np.ndarray, y: np.ndarray, signs: np.ndarray, *, trees: int = 60, depth: int = 3,
    rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 5.0,
) -> Trees:
    """Fit log odds of ``y``; ``signs`` holds -1, 0 or 1 for each feature."""
    n, width = x.shape
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    code = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(width)], 1)
    score, inner = np.full(n, base), 2**depth - 1
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    value = np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        slope, bend = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        low, high = np.full(2 * inner + 1, -4.0), np.full(2 * inner + 1, 4.0)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            best = _split(code[rows], slope[rows], bend[rows], cuts, signs, ridge, least, low[k], high[k])
            left, right = 2 * k + 1, 2 * k + 2
            low[[left, right]], high[[left, right]] = low[k], high[k]
            if best is not None:
                f, c, middle = best
                feature[t, k], threshold[t, k] = f, cuts[f][c]
                if signs[f] > 0:
                    high[left] = low[right] = middle
                elif signs[f] < 0:
                    low[left] = high[right] = middle
                node[rows] = np.where(code[rows, f] > c, right, left)
            else:
                node[rows] = left
        for k in range(inner, 2 * inner + 1):
            rows = node == k
            leaf = slope[rows].sum() / (bend[rows].sum() + ridge)
            value[t, k - inner] = rate * np.clip(leaf, low[k], high[k])
        score += value[t, node - inner]
    return Trees(base, feature, threshold, value)


def _split(code, slope, bend, cuts, signs, ridge, least, low, high):
    """The feature, cut and middle of the best split that keeps the constraints, if any gains."""
    total_g, total_h = slope.sum(), bend.sum()
    best, found = 1e-6 + total_g**2 / (total_h + ridge), None
    for f, edges in enumerate(cuts):
        if not len(edges) or not len(code):
            continue
        g = np.cumsum(np.bincount(code[:, f], slope, len(edges) + 1))[:-1]
        h = np.cumsum(np.bincount(code[:, f], bend, len(edges) + 1))[:-1]
        m = np.cumsum(np.bincount(code[:, f], minlength=len(edges) + 1))[:-1]
        gr, hr = total_g - g, total_h - h
        left = np.clip(g / (h + ridge), low, high)
        right = np.clip(gr / (hr + ridge), low, high)
        gain = 2 * g * left - (h + ridge) * left**2 + 2 * gr * right - (hr + ridge) * right**2
        ok = (m >= least) & (len(code) - m >= least) & (signs[f] * (right - left) >= 0)
        if ok.any():
            c = int(np.argmax(np.where(ok, gain, -np.inf)))
            if gain[c] > best:
                best, found = gain[c], (f, c, (left[c] + right[c]) / 2)
    return found
