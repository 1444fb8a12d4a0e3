"""Logistic regression on hashed features, trained with follow-the-regularised-leader updates.

The per-coordinate proximal form of McMahan et al., "Ad click prediction: a view from the trenches" (KDD 2013).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Model:
    """weights: one per hashed feature; bias: the weight of the constant feature."""

    weights: np.ndarray
    bias: float

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(logit + self.bias, -35.0, 35.0)))


def train(
    rows: Iterable[tuple[np.ndarray, np.ndarray, int]],
    size: int,
    *,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.5,
    l2: float = 1.0,
    epochs: int = 3,
) -> Model:
    """rows: distinct feature numbers, their values, and the label 0 or 1; taken in the given order in each epoch."""
    rows = list(rows)
    z, n, zb, nb = np.zeros(size), np.zeros(size), 0.0, 0.0

    def weight(z, n):
        w = -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def bias() -> float:
        return -zb / ((beta + nb**0.5) / alpha)

    for _ in range(epochs):
        for at, x, y in rows:
            w, b = weight(z[at], n[at]), bias()
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x + b, -35.0, 35.0)))
            g = (p - y) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
            gb = p - y
            zb += gb - ((nb + gb * gb) ** 0.5 - nb**0.5) / alpha * b
            nb += gb * gb
    return Model(weight(z, n).astype(np.float32), float(bias()))
