"""Linear classifiers trained in numpy."""

from __future__ import annotations

import numpy as np


def linear_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 250) -> np.ndarray:
    """Weights (with a bias at the end) of a two-class squared-hinge machine; y is -1 or 1.

    Classes weigh the same whatever their sizes. Accelerated gradient steps; the step size comes from
    the largest curvature, found by power iteration.
    """
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    v = np.ones(x.shape[1], x.dtype)
    for _ in range(20):
        v = x.T @ (share * (x @ v))
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (2 * float((share * (x @ v) ** 2).sum()) + penalty)
    w = past = np.zeros(x.shape[1], x.dtype)
    for k in range(steps):
        ahead = w + (k / (k + 3)) * (w - past)
        slack = np.maximum(0, 1 - y * (x @ ahead))
        past, w = w, ahead - step * (penalty * ahead - 2 * x.T @ (share * y * slack))
    return w


def logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> np.ndarray:
    """Weights (with a bias at the end) of a logistic regression on y in 0/1, by accelerated gradients."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    v = np.ones(x.shape[1], x.dtype)
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (0.25 * float(((x @ v) ** 2).sum()) / len(x) + penalty)
    ridge = np.full(x.shape[1], penalty, x.dtype)
    ridge[-1] = 0
    w = past = np.zeros(x.shape[1], x.dtype)
    for k in range(steps):
        ahead = w + (k / (k + 3)) * (w - past)
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        past, w = w, ahead - step * (x.T @ (p - y) / len(x) + ridge * ahead)
    return w
