"""Logistic regression on sparse or dense rows, in numpy; for bounded samples on the driver."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Rows:
    """Sparse rows: ``index`` and ``value`` of row i lie from ``begin[i]`` to ``begin[i + 1]``."""

    def __init__(self, begin: np.ndarray, index: np.ndarray, value: np.ndarray, width: int):
        self.begin, self.index, self.value, self.width = begin, index, value, width
        self.row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))

    def __len__(self) -> int:
        return len(self.begin) - 1

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.index], len(self))

    def back(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, self.value * e[self.row], self.width)

    def take(self, at: np.ndarray) -> Rows:
        lens = np.diff(self.begin)[at]
        begin = np.concatenate([[0], np.cumsum(lens)])
        pos = np.arange(begin[-1]) + np.repeat(self.begin[at] - begin[:-1], lens)
        return Rows(begin, self.index[pos], self.value[pos], self.width)


def fit(x: Rows, extra: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """Weights (sparse width, extra columns, bias): accelerated gradient steps in scaled
    coordinates. ``y`` may hold probabilities; ``extra`` are dense columns beside ``x``."""
    n = len(x)
    weight = np.ones(n) if weight is None else weight
    weight = weight / max(weight.sum(), 1e-9)
    scale = np.concatenate([1 / np.sqrt(np.bincount(x.index, (x.value**2) * weight[x.row], x.width) + 1e-3), 1 / np.sqrt((extra**2 * weight[:, None]).sum(0) + 1e-3), [1.0]])
    w = np.zeros(x.width + extra.shape[1] + 1)
    p = np.average(y, weights=weight)
    w[-1] = np.log(max(p, 1e-6) / max(1 - p, 1e-6))
    v, step, loss_before, k = w.copy(), 0.5, np.inf, 0
    margin = lambda u: x.dot(u[: x.width]) + extra @ u[x.width : -1] + u[-1]

    def loss_of(u, z):
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + l2 * (u[:-1] ** 2).sum() / 2

    for _ in range(rounds):
        z = margin(v)
        e = weight * (sigmoid(z) - y)
        g = np.concatenate([x.back(e), extra.T @ e, [e.sum()]]) + l2 * np.append(v[:-1], 0)
        base = loss_of(v, z)
        while True:  # back-tracking keeps every step a descent
            new = v - step * scale**2 * g
            if loss_of(new, margin(new)) <= base - 0.25 * step * (scale**2 * g * g).sum() or step < 1e-6:
                break
            step /= 2
        now = loss_of(new, margin(new))
        k = 0 if now > loss_before else k + 1
        v = new + (k - 1) / (k + 2) * (new - w) if k else new
        w, step = new, step * 1.3
        if abs(loss_before - now) < 1e-8 and k > 10:
            break
        loss_before = now
    return w
