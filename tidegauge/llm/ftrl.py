"""Softmax regression by follow-the-regularised-leader with elastic-net penalties, over sparse rows; temperature calibration.

Runs on a bounded sample that its caller has gathered.
"""

from __future__ import annotations

import numpy as np

Row = tuple[np.ndarray, np.ndarray]  # indices and values


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list[Row], targets: np.ndarray, dims: int, rate: float = 0.3, l1: float = 1e-3, l2: float = 1e-3,
          passes: int = 5, seed: int = 7) -> np.ndarray:
    """Weights (dims, classes) for target distributions (rows, classes)."""
    classes = targets.shape[1]
    z, n, w = np.zeros((dims, classes)), np.zeros((dims, classes)), np.zeros((dims, classes))
    order = np.random.default_rng(seed)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            own = w[at]
            g = x[:, None] * (softmax(x @ own) - targets[i])
            before = n[at]
            after = before + g * g
            root = np.sqrt(after)
            zi = z[at] + g - (root - np.sqrt(before)) / rate * own
            z[at], n[at] = zi, after
            w[at] = np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((0.1 + root) / rate + l2), 0.0)
    return w


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least held-out log loss, by golden section over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()

    lo, hi, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        if loss(a) <= loss(b):
            hi = b
        else:
            lo = a
    return float(np.exp((lo + hi) / 2))
