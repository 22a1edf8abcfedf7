"""Linear machines on sparse rows, fitted inside one task on a bounded sample."""

from __future__ import annotations

import numpy as np


def fit_linear(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, loss: str, penalty: float, steps: int, rate: float) -> tuple[np.ndarray, float]:
    """Weights and intercept for y of 1 and -1, by `steps` adaptive gradient steps over all rows.

    rows, columns, values: the numbers that are not zero. loss: "logistic", or "hinge" (squared, of a support vector
    machine). The intercept bears no penalty. Deterministic.
    """
    w, first, second = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    if loss == "logistic" and 0 < (ones := (y > 0).sum()) < len(y):
        w[-1] = np.log(ones / (len(y) - ones))
    for t in range(1, steps + 1):
        margin = y * (np.bincount(rows, values * w[columns], len(y)) + w[-1])
        pull = 1 / (1 + np.exp(np.clip(margin, -30, 30))) if loss == "logistic" else np.maximum(0, 1 - margin)
        pull *= -y / len(y)
        g = np.append(np.bincount(columns, values * pull[rows], width) + penalty * w[:-1], pull.sum())
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
    return w[:-1], float(w[-1])


def flattened(lists) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and items of lists of numbers."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.repeat(np.arange(len(lists)), sizes), np.concatenate([np.asarray(x) for x in lists] or [np.zeros(0)])
