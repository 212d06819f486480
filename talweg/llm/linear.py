"""Hashed features and linear models for the classifiers; training is on bounded samples, in numpy."""

from __future__ import annotations

import zlib

import numpy as np

#: Features are hashed to so many buckets.
BUCKETS = 1 << 20


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Design:
    """Rows of 0/1 features, kept as the columns that are 1, beside a few dense columns; the last one is the bias."""

    def __init__(self, row: np.ndarray, column: np.ndarray, width: int, dense: np.ndarray):
        self.row, self.column, self.width = row, column, width
        self.dense = np.concatenate([dense, np.ones((len(dense), 1))], 1)

    @staticmethod
    def of(sets: list[list[int]], width: int, dense: np.ndarray | None = None) -> Design:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        column = np.array([c for s in sets for c in s], np.int64)
        return Design(row, column, width, np.empty((len(sets), 0)) if dense is None else dense)

    @property
    def columns(self) -> int:
        return self.width + self.dense.shape[1]

    def with_dense(self, dense: np.ndarray) -> Design:
        return Design(self.row, self.column, self.width, dense)

    def take(self, mask: np.ndarray) -> Design:
        on = mask[self.row]
        place = np.cumsum(mask) - 1
        return Design(place[self.row[on]], self.column[on], self.width, self.dense[mask, :-1])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], len(self.dense)) + self.dense @ w[self.width :]

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.column, v[self.row], self.width), self.dense.T @ v])


def logistic(x: Design, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Weights of a logistic regression with soft labels; the last one is the bias.  Accelerated gradient steps."""
    total = weight.sum()
    if not total:
        return np.zeros(x.columns)
    penalty = np.full(x.columns, ridge / total)
    penalty[-1] = 0
    # Largest curvature, by power iteration.
    v, norm = np.ones(x.columns), 1.0
    for _ in range(20):
        v = x.back(weight * x.dot(v)) / total
        norm = np.linalg.norm(v)
        v /= norm or 1
    rate = 1 / (norm / 4 + penalty[0] + 1e-9)
    w = u = np.zeros(x.columns)
    t = 1.0
    for _ in range(steps):
        grad = x.back(weight * (sigmoid(x.dot(u)) - y)) / total + penalty * u
        new = u - rate * grad
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w


def apply(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])
