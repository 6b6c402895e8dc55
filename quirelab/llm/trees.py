"""Gradient-boosted regression trees over binned features, in NumPy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 64


@dataclass
class Boosted:
    """Squared-error boosting with full binary trees of one depth, as arrays."""

    trees: int = 80
    depth: int = 3
    rate: float = 0.12
    least: float = 8.0
    shrink: float = 1.0
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(self.cuts)], 1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Boosted:
        n, m = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(m)]
        bins = self._bin(x)
        self.base = float((w * y).sum() / w.sum())
        guess = np.full(n, self.base)
        columns = np.arange(m) * BINS
        for _ in range(self.trees):
            rest = y - guess
            at = np.zeros(n, np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, BINS, np.int64)
            for level in range(self.depth):
                width, first = 2**level, 2**level - 1
                code = ((at * m * BINS)[:, None] + columns[None] + bins).ravel()
                size = width * m * BINS
                g = np.bincount(code, np.repeat(w * rest, m), size).reshape(width, m, BINS).cumsum(2)
                h = np.bincount(code, np.repeat(w, m), size).reshape(width, m, BINS).cumsum(2)
                gt, ht = g[:, :1, -1:], h[:, :1, -1:]
                gain = g**2 / (h + self.shrink) + (gt - g) ** 2 / (ht - h + self.shrink) - gt**2 / (ht + self.shrink)
                gain[(h < self.least) | (ht - h < self.least)] = 0
                best = gain.reshape(width, -1).argmax(1)
                ok = gain.reshape(width, -1).max(1) > 1e-9
                feature[first : first + width] = np.where(ok, best // BINS, 0)
                cut[first : first + width] = np.where(ok, best % BINS, BINS)
                at = 2 * at + (bins[np.arange(n), feature[first + at]] > cut[first + at])
            leaves = 2**self.depth
            leaf = self.rate * np.bincount(at, w * rest, leaves) / (np.bincount(at, w, leaves) + self.shrink)
            guess += leaf[at]
            self.nodes.append((feature, cut, leaf))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(x) or not self.nodes:
            return np.full(len(x), self.base)
        bins, rows = self._bin(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for feature, cut, leaf in self.nodes:
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = 2**level - 1 + at
                at = 2 * at + (bins[rows, feature[node]] > cut[node])
            out += leaf[at]
        return out


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising step function closest to (x, y): knots for np.interp."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, first x, last x
    for i in order:
        blocks.append([float(y[i]), float(w[i]), float(x[i]), float(x[i])])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks[-1]
            a[0] = (a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1])
            a[1] += b[1]
            a[3] = b[3]
    if not blocks:
        return np.array([0.0]), np.array([0.0])
    knots = np.array([v for b in blocks for v in (b[2], b[3])])
    levels = np.array([v for b in blocks for v in (b[0], b[0])])
    keep = np.concatenate([[True], (np.diff(knots) > 0) | (np.diff(levels) > 0)])
    return knots[keep], levels[keep]
