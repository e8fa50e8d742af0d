"""Order-sensitive algorithms: NumPy kernels, and the grouped-map operators that run them per group.

A group is one tracklet, or one batch with one leg; both are bounded by how long an aircraft flies.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from windgrid.operators.corruption import KINDS as CORRUPTIONS  # noqa: F401
from windgrid.operators.corruption import corrupt  # noqa: F401
from windgrid.operators.smoothing import smooth_states
from windgrid.runtime import ship


# ---- smoothing


def smooth(t: np.ndarray, x: np.ndarray, process: float, noise: float) -> tuple[np.ndarray, np.ndarray]:
    """Position and variance of a scalar track of one noise: see smoothing.smooth_states."""
    found = smooth_states(t, x, np.full(len(x), noise), process)
    return found[:, 0], found[:, 2]


def smoothed(points: DataFrame, keys: list[str], order: list[str], time: str, axes: dict[str, tuple[float, float]]) -> DataFrame:
    """points with smooth_<axis> and spread_<axis>; axes: column -> (process, noise)."""
    ship(points.sparkSession)
    schema = StructType(points.schema.fields[:])
    for a in axes:
        schema = schema.add(f"smooth_{a}", "double").add(f"spread_{a}", "double")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, kind="stable")
        t = g[time].to_numpy(float)
        for a, (process, noise) in axes.items():
            g[f"smooth_{a}"], g[f"spread_{a}"] = smooth(t, g[a].to_numpy(float), process, noise)
        return g

    return points.groupBy(*keys).applyInPandas(run, schema)


# ---- alignment of an ordered batch with an ordered leg


def monotone_path(cost: np.ndarray) -> tuple[float, np.ndarray]:
    """Cheapest non-decreasing states, one per row; of equal costs the earliest state. inf forbids a state."""
    best = cost[0].astype(float)
    back = []
    for row in cost[1:]:
        low = np.minimum.accumulate(best)
        back.append(_first_reached(low))
        best = row + low
    end = int(np.argmin(best))
    path = [end]
    for first in reversed(back):
        path.append(int(first[path[-1]]))
    return float(best[end]), np.array(path[::-1])


def _first_reached(low: np.ndarray) -> np.ndarray:
    out, at = np.zeros(len(low), dtype=int), 0
    for k in range(len(low)):
        if low[k] < low[at]:
            at = k
        out[k] = at
    return out


def drop_alignment(cost: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Rows matched to non-decreasing columns or dropped at a penalty; -1 for dropped. Of equal costs a match wins."""
    n, m = cost.shape
    best = np.zeros(m)  # best[j]: all rows so far done, states beyond j still free
    choice = np.zeros((n, m), dtype=bool)
    reached = np.zeros((n, m), dtype=int)
    for i in range(n):
        match = cost[i] + best
        low = np.minimum.accumulate(match)
        reached[i] = _first_reached(low)
        drop = best + penalty
        choice[i] = low <= drop
        best = np.where(choice[i], low, drop)
    out, j = np.full(n, -1), m - 1
    for i in range(n - 1, -1, -1):
        if choice[i, j]:
            j = int(reached[i, j])
            out[i] = j
    return float(best[-1]), out


def partial_alignment(cost: np.ndarray, gate: float) -> tuple[int, float, np.ndarray]:
    """As many rows as possible within the gate on non-decreasing columns, then least cost; -1 for the others."""
    big = 1e6
    allowed = np.where(cost <= gate, cost, np.inf)
    _, path = drop_alignment(np.where(np.isfinite(allowed), allowed - big, np.inf), 0.0)
    matched = path >= 0
    return int(matched.sum()), float(allowed[np.nonzero(matched)[0], path[matched]].sum()), path


def principal_order(x: np.ndarray) -> np.ndarray:
    """Order along the first principal axis, oriented so that its largest component is positive."""
    axis = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][0]
    axis = axis * np.sign(axis[np.argmax(np.abs(axis))])
    return np.argsort((x - x.mean(axis=0)) @ axis, kind="stable")


def stability(cost: np.ndarray, penalty: float, most: int = 5) -> float:
    """Mean Jaccard similarity of the matched pairs when one of up to `most` rows is left out."""
    full = drop_alignment(cost, penalty)[1]
    whole = {(i, j) for i, j in enumerate(full) if j >= 0}
    rows = np.unique(np.linspace(0, len(cost) - 1, min(most, len(cost))).round().astype(int))
    out = []
    for r in rows:
        if len(cost) == 1:
            continue
        rest = [i for i in range(len(cost)) if i != r]
        part = drop_alignment(cost[rest], penalty)[1]
        b = {(rest[k], j) for k, j in enumerate(part) if j >= 0}
        a = {x for x in whole if x[0] != r}
        out.append(len(a & b) / len(a | b) if a | b else 1.0)
    return float(np.mean(out)) if out else 1.0


def aligned(pairs: DataFrame, keys: list[str], rows: str, states: str, penalty: float) -> DataFrame:
    """Drop alignment per group.

    pairs: keys, `rows` and `states` (arrays of structs x, y; in order). Returns keys, cost, matched,
    coverage, contiguous (longest run of matched rows), stable.
    """
    ship(pairs.sparkSession)
    kinds = {f.name: f.dataType for f in pairs.schema.fields}
    schema = ", ".join([f"{k} {kinds[k].simpleString()}" for k in keys] + ["cost double", "matched long", "coverage double", "contiguous double", "stable double"])

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                r = np.array([[p["x"], p["y"]] for p in getattr(row, rows)], dtype=float)
                s = np.array([[p["x"], p["y"]] for p in getattr(row, states)], dtype=float)
                cost = np.hypot(*(r[:, None] - s[None]).transpose(2, 0, 1))
                total, path = drop_alignment(cost, penalty)
                hit = path >= 0
                run_, longest = 0, 0
                for h in hit:
                    run_ = run_ + 1 if h else 0
                    longest = max(longest, run_)
                out.append([getattr(row, k) for k in keys] + [total, int(hit.sum()), float(hit.mean()), longest / len(hit), stability(cost, penalty)])
            yield pd.DataFrame(out, columns=[*keys, "cost", "matched", "coverage", "contiguous", "stable"])

    return pairs.select(*keys, rows, states).mapInPandas(run, schema)


# ---- calibration


def pool_adjacent(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit: upper scores and values of the blocks; neighbours merge while the left is above the right."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, y in zip(score[order], label[order], strict=True):
        blocks.append([s, y, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] > blocks[-1][1] / blocks[-1][2]:
            s2, y2, n2 = blocks.pop()
            blocks[-1] = [s2, blocks[-1][1] + y2, blocks[-1][2] + n2]
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def step_lookup(upper: np.ndarray, value: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The value of the first block whose upper score is not below; the last beyond."""
    return value[np.minimum(np.searchsorted(upper, score, side="left"), len(value) - 1)]


def binned(df: DataFrame, score: str, label: str, digits: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts and sums of labels by rounded score: at most 10 ** digits + 1 rows, whatever the size of df."""
    from pyspark.sql import functions as F

    t = df.groupBy(F.round(score, digits).alias("s")).agg(F.count("*").alias("n"), F.sum(label).alias("y")).orderBy("s").toArrow()
    return t["s"].to_numpy(), t["n"].to_numpy().astype(float), t["y"].to_numpy().astype(float)


def pool_binned(score: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The isotonic fit on binned scores: a bin starts as one block, as equal scores share one value."""
    blocks: list[list[float]] = []
    for s, c, h in zip(score, n, y, strict=True):
        blocks.append([s, h, c])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            s2, h2, c2 = blocks.pop()
            blocks[-1] = [s2, blocks[-1][1] + h2, blocks[-1][2] + c2]
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])
