"""Logistic regression over hashed sparse rows, fitted on the driver from a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    """Sparse rows: row i has features index[begin[i]:begin[i+1]] with the values beside them."""

    begin: np.ndarray
    index: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.begin) - 1

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return sums(weights[self.index] * self.value, self.begin)

    def take(self, rows: np.ndarray) -> Rows:
        counts = np.diff(self.begin)[rows]
        begin = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(self.begin[:-1][rows] - begin[:-1], counts) + np.arange(begin[-1])
        return Rows(begin, self.index[at], self.value[at])


def sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.bincount(np.repeat(np.arange(len(begin) - 1), np.diff(begin)), weights=values, minlength=len(begin) - 1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(rows: Rows, target: np.ndarray, weight: np.ndarray, size: int, l2: float = 1e-4, steps: int = 80, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the weighted log loss against targets in 0..1, by full-batch Adam."""
    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    weight = weight / max(weight.sum(), 1e-12)
    of = np.repeat(np.arange(len(rows)), np.diff(rows.begin))
    for t in range(1, steps + 1):
        z = np.bincount(of, weights=w[rows.index] * rows.value, minlength=len(rows)) + b
        g = (sigmoid(z) - target) * weight
        grad = np.bincount(rows.index, weights=g[of] * rows.value, minlength=size) + l2 * w
        gb = float(g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-9)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
    return w, b


def platt(z: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset for which sigmoid(slope * z + offset) is calibrated; targets are smoothed as in Platt's method."""
    pos, neg = float((weight * target).sum()), float((weight * (1 - target)).sum())
    if pos <= 0 or neg <= 0 or len(z) < 2:
        return 1.0, 0.0
    n = len(z) / (pos + neg)
    soft = np.where(target > 0.5, (pos * n + 1) / (pos * n + 2), 1 / (neg * n + 2))
    center, scale = z.mean(), z.std() + 1e-9
    x = (z - center) / scale
    a, b = 1.0, float(np.log(pos / neg))
    for _ in range(60):
        p = sigmoid(a * x + b)
        g, h = weight * (p - soft), weight * p * (1 - p) + 1e-9
        ga, gb = float((g * x).sum()), float(g.sum())
        haa, hab, hbb = float((h * x * x).sum()) + 1e-6, float((h * x).sum()), float(h.sum()) + 1e-6
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
        if abs(da) + abs(db) < 1e-7:
            break
    a = max(a, 1e-3)
    return a / scale, b - a * center / scale
