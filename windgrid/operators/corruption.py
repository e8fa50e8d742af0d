"""Damaged copies of ordered points, for checking that an alignment notices what it should."""

from __future__ import annotations

from math import ceil

import numpy as np

#: The kinds in the order that settles their seeds, the base seed and the step of a case.
KINDS = ("clean", "point_outlier", "block_outlier", "drop_10", "drop_20", "drop_30", "drop_40", "drop_50", "reverse", "local_swap", "random_order", "point_missing", "continuous_gap", "receiver_time_bias")
SEED, CASE_STEP = 20260716, 31
#: What an outlier is moved by (degrees, degrees, metres), and the share of a block.
MOVED, BLOCK = (0.25, 0.25, 2500.0), 0.30


def seed_of(case: int, kind: str) -> int:
    return SEED + CASE_STEP * case + KINDS.index(kind)


def plan(n: int, kind: str, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of n points are left, in their new order, and by how many units of MOVED each of these is shifted.

    One point at least is left, but by point_missing of a single one. A kind that touches no position leaves all
    as they are.
    """
    rng, order, shift = np.random.default_rng(seed), np.arange(n), np.zeros((n, 3))

    def block(size: int) -> slice:
        first = int(rng.integers(0, max(1, n - size + 1)))
        return slice(first, first + size)

    share = max(1, ceil(n * BLOCK))
    if kind.startswith("drop_"):
        out = min(n - 1, max(1, round(n * int(kind[5:]) / 100)))
        order = np.setdiff1d(order, rng.choice(n, size=out, replace=False))
    elif kind == "reverse":
        order = order[::-1]
    elif kind == "random_order":
        order = rng.permutation(n)
    elif kind == "local_swap" and n >= 3:
        k = int(rng.integers(0, n - 1))
        order[[k, k + 1]] = order[[k + 1, k]]
    elif kind in ("point_missing", "continuous_gap"):
        order = np.delete(order, block(1 if kind == "point_missing" else min(n - 1, share)))
    elif kind in ("point_outlier", "block_outlier"):
        hit = block(1 if kind == "point_outlier" else min(n, max(2, share)))
        shift[hit] = [[float(rng.choice([-1.0, 1.0])) for _ in MOVED] for _ in range(*hit.indices(n))]
    return order, shift[order]


def corrupt(points: np.ndarray, kind: str, seed: int) -> np.ndarray:
    """A changed copy of ordered points (lat, lon, alt); the seed settles every random choice."""
    order, shift = plan(len(points), kind, seed)
    return points[order] + shift * MOVED
