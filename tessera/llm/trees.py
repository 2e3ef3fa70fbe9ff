"""Gradient-boosted trees for two classes, fitted on the driver to a bounded sample.

Newton boosting of the logistic loss over quantile bins. Everything is deterministic: ties between splits go to the
first feature and the lowest cut.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """Nodes in the order they were made; a leaf has feature -1. Left: value <= cut."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for column, x in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, value)):
            column.append(x)
        return len(self.feature) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        feature, cut, left, right, value = (np.array(c) for c in (self.feature, self.cut, self.left, self.right, self.value))
        while True:
            inner = np.nonzero(feature[at] >= 0)[0]
            if not len(inner):
                return value[at]
            node = at[inner]
            at[inner] = np.where(x[inner, feature[node]] <= cut[node], left[node], right[node])

    def paths(self) -> list[list[tuple[int, bool, float]]]:
        """The conditions (feature, at most the cut?, cut) that lead to each node but the root."""
        out, todo = [], [(0, [])]
        while todo:
            node, so_far = todo.pop()
            if so_far:
                out.append(so_far)
            if self.feature[node] >= 0:
                f, c = self.feature[node], self.cut[node]
                todo += [(self.right[node], [*so_far, (f, False, c)]), (self.left[node], [*so_far, (f, True, c)])]
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Places to split sorted values: half-way between each quantile and the next larger value."""
    low = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[:-1], method="lower"))
    after = np.searchsorted(values, low, side="right")
    low, after = low[after < len(values)], after[after < len(values)]
    return (low + values[after]) / 2


@dataclass
class Boosted:
    trees: list[Tree]
    start: float
    rate: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for tree in self.trees:
            total += self.rate * tree.predict(x)
        return sigmoid(total)


def boost(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, least: float = 5.0, ridge: float = 1.0, weight: np.ndarray | None = None) -> Boosted:
    """Fit; without rows, or with one class, the model is a constant."""
    if not len(y):
        return Boosted([], 0.0, rate)
    w = np.ones(len(y)) if weight is None else weight
    share = float(np.clip((w * y).sum() / w.sum(), 1e-3, 1 - 1e-3))
    model = Boosted([], float(np.log(share / (1 - share))), rate)
    if y.min() == y.max():
        return model
    cuts = [_cuts(np.sort(x[:, f]), bins) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), model.start)
    for _ in range(trees):
        p = sigmoid(margin)
        g, h = w * (p - y), w * np.maximum(p * (1 - p), 1e-6)
        tree = Tree()
        todo = [(tree.add(-g.sum() / (h.sum() + ridge)), np.arange(len(y)), 0)]
        while todo:
            node, rows, level = todo.pop()
            if level == depth:
                continue
            total_g, total_h = g[rows].sum(), h[rows].sum()
            best = (1e-6, -1, -1)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, f]
                gl = np.cumsum(np.bincount(b, weights=g[rows], minlength=len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, weights=h[rows], minlength=len(c) + 1))[:-1]
                nl = np.cumsum(np.bincount(b, weights=w[rows], minlength=len(c) + 1))[:-1]
                gain = gl**2 / (hl + ridge) + (total_g - gl) ** 2 / (total_h - hl + ridge) - total_g**2 / (total_h + ridge)
                gain[(nl < least) | (w[rows].sum() - nl < least)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
            _, f, k = best
            if f < 0:
                continue
            low = binned[rows, f] <= k
            tree.feature[node], tree.cut[node] = f, float(cuts[f][k])
            sides = []
            for part in (rows[low], rows[~low]):
                sides.append(tree.add(float(-g[part].sum() / (h[part].sum() + ridge))))
                todo.append((sides[-1], part, level + 1))
            tree.left[node], tree.right[node] = sides
        model.trees.append(tree)
        margin += rate * tree.predict(x)
    return model
