"""Sparse rows and a first-order optimiser for models that are fitted on a bounded sample."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Rows:
    """Sparse rows: column indices and values, one after another."""

    def __init__(self, indices: list[np.ndarray], values: list[np.ndarray] | None = None):
        self.lengths = np.array([len(i) for i in indices], np.int64)
        self.row = np.repeat(np.arange(len(indices)), self.lengths)
        self.index = np.concatenate(indices).astype(np.int64) if indices else np.empty(0, np.int64)
        self.value = np.concatenate(values).astype(np.float64) if values else np.ones(len(self.index))
        self.n = len(indices)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.index] * self.value, self.n)

    def back(self, errors: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.index, errors[self.row] * self.value, width)


def minimise(start: np.ndarray, gradient: Callable[[np.ndarray], np.ndarray], steps: int, rate: float) -> np.ndarray:
    """Adam over full gradients, with a rate that falls linearly."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        x -= rate * (1 - (t - 1) / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
