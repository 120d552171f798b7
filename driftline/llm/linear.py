"""Small linear models fitted on the driver to bounded samples."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def descend(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, step: float, rounds: int) -> np.ndarray:
    """Accelerated gradient descent on a smooth convex function whose gradient has Lipschitz bound 1 / step."""
    w, ahead, t = start, start, 1.0
    for _ in range(rounds):
        new = ahead - step * gradient(ahead)
        later = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + (t - 1) / later * (new - w), new, later
    return w


def largest_square(x: np.ndarray) -> float:
    """Largest eigenvalue of x'x, by power iteration, slightly above."""
    v = np.ones(x.shape[1], x.dtype) / x.shape[1] ** 0.5
    value = 1.0
    for _ in range(30):
        v = x.T @ (x @ v)
        value = float(np.linalg.norm(v)) or 1.0
        v /= value
    return value * 1.05


def with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1), x.dtype)])


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 400) -> np.ndarray:
    """Weights (bias last) of a linear support vector machine with squared hinge loss; y is -1 or 1, classes weigh alike."""
    x = with_one(x)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(x.dtype)
    rows = x * np.sqrt(weight)[:, None]
    step = 1 / (2 * largest_square(rows) + penalty)
    return descend(lambda w: penalty * w - 2 * (x.T @ (weight * y * np.maximum(0, 1 - y * (x @ w)))), np.zeros(x.shape[1], x.dtype), step, rounds)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, p: np.ndarray, penalty: float = 1e-4, rounds: int = 300) -> np.ndarray:
    """Weights (bias last) of a logistic regression on soft labels p between 0 and 1; the last column of x is 1 everywhere, so that no copy of x is made for it."""
    step = 1 / (largest_square(x) / (4 * len(x)) + penalty)
    return descend(lambda w: penalty * w + x.T @ (sigmoid(x @ w) - p) / len(x), np.zeros(x.shape[1], x.dtype), step, rounds)
