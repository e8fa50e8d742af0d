"""Probability models that are linear in a design matrix, all fitted by one descent."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _odds(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def descend(design: np.ndarray, y: np.ndarray, begin: np.ndarray, steps: int, rate: float, ridge: float | np.ndarray = 0.0) -> np.ndarray:
    """Coefficients after `steps` full-batch steps down the mean logistic loss; ridge: per coefficient, or one for all."""
    found = begin.astype(float).copy()
    for _ in range(steps):
        found -= rate * (design.T @ (_odds(design @ found) - y) / len(y) + ridge * found)
    return found


@dataclass(frozen=True)
class Logit:
    """A linear score of features, each taken as (x - centre) / scale."""

    weights: np.ndarray
    bias: float
    centre: np.ndarray
    scale: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) / self.scale @ self.weights + self.bias

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, steps: int = 1600, rate: float = 0.08, ridge: float = 0.002) -> Logit:
        """From the prior odds; the bias is not drawn to zero. A feature that does not vary keeps its own scale."""
        spread = x.std(axis=0)
        scale = np.where(spread > 1e-9, spread, 1.0)
        share = min(1 - 1e-6, max(1e-6, float(y.mean())))
        width = x.shape[1]
        design = np.column_stack([(x - x.mean(axis=0)) / scale, np.ones(len(x))])
        begin = np.append(np.zeros(width), np.log(share / (1 - share)))
        found = descend(design, y, begin, steps, rate, np.append(np.full(width, ridge), 0.0))
        return cls(found[:width], float(found[width]), x.mean(axis=0), scale)


@dataclass(frozen=True)
class Sharpness:
    """A straight line through scores, to be read as log odds."""

    slope: float
    shift: float

    @classmethod
    def fit(cls, score: np.ndarray, y: np.ndarray, steps: int = 1200, rate: float = 0.02) -> Sharpness:
        slope, shift = descend(np.column_stack([score, np.ones(len(score))]), y, np.array([1.0, 0.0]), steps, rate)
        return cls(float(slope), float(shift))
