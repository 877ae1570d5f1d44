"""Gradient-boosted trees for two classes: trained in numpy on binned features, scored from flat node arrays.

A feature may be declared monotone: +1 (the score never falls as the feature grows), -1 (never rises) or 0. A split that
breaks a constraint is not taken, and the bounds of a split pass on to both subtrees.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Nodes of all trees in flat arrays; a leaf points to itself, so that ``depth`` steps end at a leaf for every row."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for every row of ``x``."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                goes_left = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(goes_left, self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


@dataclass
class _Nodes:
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def leaf(self, value: float) -> int:
        at = len(self.value)
        for held, x in ((self.feature, 0), (self.threshold, 0.0), (self.left, at), (self.right, at), (self.value, value)):
            held.append(x)
        return at


def train(
    x: np.ndarray, y: np.ndarray, monotone: list[int], n_trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: int = 20
) -> Trees:
    """Fit by second-order boosting of the logistic loss. One class alone, or no rows, gives a constant score."""
    ones = float(y.sum())
    base = float(np.log((ones + 0.5) / (len(y) - ones + 0.5)))
    nodes, roots = _Nodes(), []
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    binned = [np.searchsorted(cut, c, "left") for cut, c in zip(cuts, x.T, strict=True)]  # c <= cuts[b] iff its bin <= b
    raw = np.full(len(y), base)

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = grad[rows], hess[rows]
        sum_g, sum_h = g.sum(), h.sum()
        here = float(np.clip(-sum_g / (sum_h + ridge), low, high))
        best, chosen = 1e-6, None
        if level < depth and len(rows) >= 2 * least:
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                b = binned[f][rows]
                gl = np.cumsum(np.bincount(b, g, len(cut) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h, len(cut) + 1))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=len(cut) + 1))[:-1]
                gr, hr = sum_g - gl, sum_h - hl
                vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - sum_g**2 / (sum_h + ridge)
                allowed = (nl >= least) & (len(rows) - nl >= least) & ((vr - vl) * monotone[f] >= 0)
                gain = np.where(allowed, gain, -1)
                at = int(gain.argmax())
                if gain[at] > best:
                    best, chosen = float(gain[at]), (f, at, float(vl[at]), float(vr[at]))
        me = nodes.leaf(here * rate)
        if chosen is None:
            update[rows] = here * rate
            return me
        f, at, vl, vr = chosen
        middle = (vl + vr) / 2
        goes_left = binned[f][rows] <= at
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[monotone[f]]
        nodes.feature[me], nodes.threshold[me] = f, float(cuts[f][at])
        nodes.left[me] = grow(rows[goes_left], level + 1, *bounds[0])
        nodes.right[me] = grow(rows[~goes_left], level + 1, *bounds[1])
        return me

    if 0 < ones < len(y):
        for _ in range(n_trees):
            p = 1 / (1 + np.exp(-raw))
            grad, hess, update = p - y, p * (1 - p), np.zeros(len(y))
            roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
            raw += update
    return Trees(
        np.array(nodes.feature, int), np.array(nodes.threshold, float), np.array(nodes.left, int), np.array(nodes.right, int),
        np.array(nodes.value, float), np.array(roots, int), depth, base,
    )
