"""Sparse linear models in numpy, fitted on bounded samples in the driver."""

from __future__ import annotations

import numpy as np


class Sparse:
    """Rows of (column, value) pairs."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.width, self.height = width, len(rows)
        self.row = np.repeat(np.arange(len(rows)), [len(c) for c, _ in rows])
        self.col = np.concatenate([c for c, _ in rows] or [np.empty(0)]).astype(np.int64)
        self.val = np.concatenate([v for _, v in rows] or [np.empty(0)]).astype(np.float64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.height)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * g[self.row], self.width)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


class Adam:
    """Adam steps with the usual decay rates (0.9, 0.999)."""

    def __init__(self, width: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(width), np.zeros(width), 0, rate

    def step(self, w: np.ndarray, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        w -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
