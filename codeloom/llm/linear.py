"""Small numpy solvers that the classifiers of this subpackage share."""

from __future__ import annotations

import numpy as np


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression of dense features by Newton's method; the last weight is the intercept, not penalised."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge) + 1e-9 * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sparse_logistic(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dims: int, epochs: int = 6, rate: float = 0.5, l2: float = 1e-5, seed: int = 5) -> tuple[np.ndarray, float]:
    """Logistic regression of (dims, values) rows by AdaGrad; weights and intercept."""
    w, square, b, bs = np.zeros(dims), np.full(dims, 1e-8), 0.0, 1e-8
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            d, x = rows[k]
            g = float(sigmoid(x @ w[d] + b)) - y[k]
            grad = g * x + l2 * w[d]
            square[d] += grad * grad
            w[d] -= rate * grad / np.sqrt(square[d] + 1e-4)
            bs += g * g
            b -= rate * g / np.sqrt(bs + 1)
    return w, b


def platt(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn scores into probabilities, with the usual smoothed targets."""
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = logistic(scores[:, None], target, l2=1e-3)
    return float(a), float(b)
