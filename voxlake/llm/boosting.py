"""Small gradient-boosted trees and tree rules on numpy, for the models that are trained here."""

from __future__ import annotations

import numpy as np


def bins_of(x: np.ndarray, most: int = 32) -> list[np.ndarray]:
    """Cut points of each column, at its quantiles."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, most + 1)[1:-1])) for c in x.T]


class Tree:
    """A binary tree in arrays: feature (-1 at a leaf), cut (x <= cut goes left), children, value."""

    def __init__(self) -> None:
        self.feature: list[int] = []
        self.cut: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.value: list[float] = []

    def add(self) -> int:
        for column, v in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            column.append(v)
        return len(self.feature) - 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(map(np.array, (self.feature, self.cut, self.left, self.right, self.value)))

    def paths(self) -> list[list[tuple[int, float, bool]]]:
        """Conjunctions of (feature, cut, x <= cut) that lead to every node but the root."""
        found, stack = [], [(0, [])]
        while stack:
            node, path = stack.pop()
            if path:
                found.append(path)
            if self.feature[node] >= 0:
                stack += [(self.left[node], [*path, (self.feature[node], self.cut[node], True)]), (self.right[node], [*path, (self.feature[node], self.cut[node], False)])]
        return found


def grow_tree(codes: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, depth: int, least: int, shrink: float, ridge: float = 1.0) -> Tree:
    """A regression tree by second-order gains on binned columns."""
    tree = Tree()
    stack = [(tree.add(), np.arange(len(gradient)), depth)]
    while stack:
        node, rows, d = stack.pop()
        g, h = gradient[rows].sum(), hessian[rows].sum()
        tree.value[node] = float(-shrink * g / (h + ridge))
        if d == 0 or len(rows) < 2 * least:
            continue
        best = (1e-6, -1, -1)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            code = codes[rows, f]
            gs = np.bincount(code, gradient[rows], len(c) + 1).cumsum()[:-1]
            hs = np.bincount(code, hessian[rows], len(c) + 1).cumsum()[:-1]
            ns = np.bincount(code, minlength=len(c) + 1).cumsum()[:-1]
            gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
            gain[(ns < least) | (len(rows) - ns < least)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
        _, f, k = best
        if f < 0:
            continue
        tree.feature[node], tree.cut[node] = f, float(cuts[f][k])
        tree.left[node], tree.right[node] = tree.add(), tree.add()
        goes = codes[rows, f] <= k
        stack += [(tree.left[node], rows[goes], d - 1), (tree.right[node], rows[~goes], d - 1)]
    return tree


def boost(x: np.ndarray, y: np.ndarray, trees: int, depth: int = 4, least: int = 20, shrink: float = 0.2) -> tuple[float, list[Tree]]:
    """(bias, trees) of a logistic model."""
    cuts = bins_of(x)
    codes = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)
    p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    bias = float(np.log(p / (1 - p)))
    margin, out = np.full(len(y), bias), []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        tree = grow_tree(codes, cuts, q - y, q * (1 - q), depth, least, shrink)
        out.append(tree)
        margin += predict_tree(tree.arrays(), x)
    return bias, out


def predict_tree(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    feature, cut, left, right, value = tree
    node, rows = np.zeros(len(x), int), np.arange(len(x))
    while True:
        f = feature[node]
        inner = f >= 0
        if not inner.any():
            return value[node]
        goes = x[rows, np.maximum(f, 0)] <= cut[node]
        node = np.where(inner, np.where(goes, left[node], right[node]), node)
