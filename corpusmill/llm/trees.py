"""Small decision trees and gradient boosting in numpy, fitted on the labelled tables of this subpackage."""

from __future__ import annotations

import numpy as np


class Tree:
    """A binary tree on numeric features; leaves hold a value. ``fit`` minimises weighted squared error (Gini for 0/1)."""

    def __init__(self, depth: int, least: float = 1.0):
        self.depth, self.least = depth, least
        self.nodes: list[tuple[int, float, int, int, float]] = []

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> Tree:
        """Split greedily up to ``depth`` levels, keeping a weight of at least ``least`` in a leaf."""
        self.nodes = []
        self.flags = np.flatnonzero(((x == 0) | (x == 1)).all(axis=0))
        self.others = np.setdiff1d(np.arange(x.shape[1]), self.flags)
        self._grow(x, y, np.ones(len(y)) if w is None else w, 0)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, level: int) -> int:
        me = len(self.nodes)
        total = w.sum()
        value = float((w * y).sum() / total) if total else 0.0
        self.nodes.append((-1, 0.0, -1, -1, value))
        if level == self.depth or len(y) < 2 or np.ptp(y) == 0:
            return me
        best, pick = 1e-9, None
        base = (w * y).sum() ** 2 / total
        if len(self.flags):  # features that are 0 or 1 need no sorting
            on = x[:, self.flags]
            right, right_sum = w @ on, (w * y) @ on
            left, left_sum = total - right, (w * y).sum() - right_sum
            gain = left_sum**2 / np.maximum(left, 1e-12) + right_sum**2 / np.maximum(right, 1e-12) - base
            gain[(left < self.least) | (right < self.least) | (right == 0) | (left == 0)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, pick = gain[k], (int(self.flags[k]), 0.5)
        for f in self.others.tolist():
            order = np.argsort(x[:, f], kind="stable")
            v, a, b = x[order, f], np.cumsum(w[order]), np.cumsum((w * y)[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            left, right = a[cut], total - a[cut]
            gain = b[cut] ** 2 / np.maximum(left, 1e-12) + (b[-1] - b[cut]) ** 2 / np.maximum(right, 1e-12) - base
            gain[(left < self.least) | (right < self.least)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, pick = gain[k], (f, float((v[cut[k]] + v[cut[k] + 1]) / 2))
        if pick is None:
            return me
        low = x[:, pick[0]] <= pick[1]
        a = self._grow(x[low], y[low], w[low], level + 1)
        b = self._grow(x[~low], y[~low], w[~low], level + 1)
        self.nodes[me] = (pick[0], pick[1], a, b, value)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The leaf value of each row."""
        f, cut, a, b, value = (np.array(c) for c in zip(*self.nodes))
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            inner = f[at] >= 0
            if not inner.any():
                break
            low = x[rows, np.maximum(f[at], 0)] <= cut[at]
            at = np.where(inner, np.where(low, a[at], b[at]), at)
        return value[at]


class Boosted:
    """Gradient-boosted trees for 0/1 labels with logistic loss and Newton steps."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Each round fits a tree to gradient / curvature, weighted by the curvature."""
        p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            bend = np.maximum(prob * (1 - prob), 1e-4)
            tree = Tree(self.depth, self.least * 0.05).fit(x, (y - prob) / bend, bend)
            self.trees.append(tree)
            score += self.rate * np.clip(tree.predict(x), -4, 4)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += self.rate * np.clip(tree.predict(x), -4, 4)
        return out
