"""Small linear models, fitted on the driver over a bounded sample."""

from __future__ import annotations

import numpy as np


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, weight: np.ndarray | None = None, steps: int = 300) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by accelerated gradient descent. y: -1 or 1.

    The bias is a weight of a constant feature, not regularised.
    """
    n, m = x.shape
    weight = np.ones(n) if weight is None else weight
    weight = weight / weight.sum()
    w, b = np.zeros(m), 0.0
    v, vb = w.copy(), b
    top = np.linalg.norm(x.astype(np.float64), axis=1).max() ** 2 + 1
    rate = 1 / (1 / c + 2 * top * 1.0)
    t = 1.0
    for _ in range(steps):
        gap = np.maximum(0, 1 - y * (x @ v + vb))
        pull = -2 * weight * y * gap
        nw, nb = v - rate * (v / c / n + x.T @ pull), vb - rate * pull.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, bias: bool = True, steps: int = 30, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's method. y: 0 or 1 (or a share)."""
    full = np.hstack([x, np.ones((len(x), 1))]) if bias else x
    weight = np.ones(len(x)) if weight is None else weight
    w = np.zeros(full.shape[1])
    penalty = np.full(len(w), ridge * weight.sum())
    if bias:
        penalty[-1] = 1e-9 * weight.sum()
    for _ in range(steps):
        p = sigmoid(full @ w)
        gradient = full.T @ (weight * (p - y)) + penalty * w
        curve = (full * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ full + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, gradient)
        w = w - step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return (w[:-1], float(w[-1])) if bias else (w, 0.0)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(z, np.float64)))
