"""Gradient-boosted trees in numpy: histogram splits, logistic loss, monotonic constraints.

A fitted model is a set of flat node arrays; scoring walks all rows through all
trees at once, one level per step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """All trees' nodes one after the other; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1 for each row of ``x``."""
        total = np.full(len(x), self.base)
        if not len(self.roots) or not len(x):
            return total
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            rows = np.arange(len(part))[:, None]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            for _ in range(self.depth):
                below = part[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(below, self.left[node], self.right[node])
            total[at : at + 4096] += self.value[node].sum(axis=1)
        return total


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: dict[int, int],
    *,
    rounds: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 64,
    l2: float = 1.0,
    least: float = 5.0,
) -> Forest | None:
    """Boosted trees for labels 0/1, or None if ``y`` has fewer than two classes.

    ``monotone[f]`` is +1 (the score may not fall as feature f grows) or -1. A
    split on such a feature is taken only if its leaves keep that order, and the
    middle of the two values bounds everything below either side.
    """
    if len(np.unique(y)) < 2:
        return None
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    width = bins + 1
    mean = y.mean()
    base = float(np.log(mean / (1 - mean)))
    score = np.full(len(y), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        at = len(feature)
        feature.append(0), threshold.append(0.0), left.append(at), right.append(at), value.append(v)
        return at

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)

        def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
            g, h = grad[rows].sum(), hess[rows].sum()
            at = leaf(rate * float(np.clip(g / (h + l2), low, high)))
            best = (1e-6, -1, 0, 0.0, 0.0)
            if level < depth and h >= 2 * least:
                for f in range(x.shape[1]):
                    if not len(edges[f]):
                        continue
                    gl = np.bincount(binned[rows, f], grad[rows], width).cumsum()[: len(edges[f])]
                    hl = np.bincount(binned[rows, f], hess[rows], width).cumsum()[: len(edges[f])]
                    vl = np.clip(gl / (hl + l2), low, high)
                    vr = np.clip((g - gl) / (h - hl + l2), low, high)
                    gain = 2 * (gl * vl + (g - gl) * vr) - (hl + l2) * vl**2 - (h - hl + l2) * vr**2 - g**2 / (h + l2)
                    ok = (hl >= least) & (h - hl >= least) & (monotone.get(f, 0) * (vr - vl) >= 0)
                    gain = np.where(ok, gain, -1.0)
                    if len(gain) and gain[k := int(gain.argmax())] > best[0]:
                        best = (float(gain[k]), f, k, float(vl[k]), float(vr[k]))
            if best[1] >= 0:
                _, f, k, vl, vr = best
                middle, sign = (vl + vr) / 2, monotone.get(f, 0)
                bound_l = (low, min(high, middle)) if sign > 0 else (max(low, middle), high) if sign < 0 else (low, high)
                bound_r = (max(low, middle), high) if sign > 0 else (low, min(high, middle)) if sign < 0 else (low, high)
                below = binned[rows, f] <= k
                feature[at], threshold[at] = f, float(edges[f][k])
                left[at] = grow(rows[below], level + 1, *bound_l)
                right[at] = grow(rows[~below], level + 1, *bound_r)
            return at

        roots.append(grow(np.arange(len(y)), 0, -4.0, 4.0))
        forest = Forest(*map(np.array, (feature, threshold, left, right, value)), np.array(roots[-1:]), 0.0, depth)
        score = score + forest.margin(x)
    return Forest(*map(np.array, (feature, threshold, left, right, value, roots)), base, depth)
