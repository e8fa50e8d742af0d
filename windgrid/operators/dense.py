"""Kernels on the dense [z, y, x] box of a frame: fields that need many sweeps over all cells.

A frame's box is bounded by the grid, so a group function holds one box at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from windgrid.runtime import ship

#: Speeds that count as strong, jumps that count as rapid and as smoothed away, the most that a spread confidence has.
STRONG, RAPID, SMOOTHED, MOST_SPREAD = 60.0, 25.0, 2.0, 0.45
#: Fixed value: cells are active above it.
ACTIVE = 1e-6


def beside(f: np.ndarray, axis: int, step: int) -> np.ndarray:
    """Each cell's neighbour along an axis; the edge repeats."""
    return f.take(np.clip(np.arange(f.shape[axis]) + step, 0, f.shape[axis] - 1), axis=axis)


def around(f: np.ndarray, axes: tuple[int, ...] = (0, 1, 2)) -> np.ndarray:
    """Mean of the two neighbours along every one of the axes."""
    return sum(beside(f, a, s) for a in axes for s in (-1, 1)) / (2 * len(axes))


def around_active(f: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Mean of those of the six neighbours that are active; a cell without any keeps its value."""
    total, count = np.zeros_like(f), np.zeros_like(f)
    for axis in range(3):
        for step in (-1, 1):
            at = np.arange(f.shape[axis]) + step
            inside = ((at >= 0) & (at < f.shape[axis])).reshape([-1 if a == axis else 1 for a in range(3)])
            there = beside(active, axis, step) & inside
            total += np.where(there, beside(f, axis, step), 0.0)
            count += there
    return np.where(count > 0, total / np.maximum(count, 1), f)


def slope(f: np.ndarray, axis: int) -> np.ndarray:
    """Central differences, one-sided at the edges; 0 along an axis of one cell."""
    return np.gradient(f, axis=axis) if f.shape[axis] > 1 else np.zeros_like(f)


def limited(u: np.ndarray, v: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    scale = np.minimum(1.0, most / np.maximum(np.hypot(u, v), 1e-6))
    return u * scale, v * scale


def layers_at_risk(u: np.ndarray, v: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strong active cells that are level with the cells above and below, and those whose speed is far from them."""
    speed = np.hypot(u, v)
    pair = np.hypot(np.diff(u, axis=0), np.diff(v, axis=0))
    edge = np.zeros((1, *u.shape[1:]))
    jump = np.maximum(np.concatenate([edge, pair]), np.concatenate([pair, edge]))
    strong = active & (speed >= STRONG)
    return strong & (jump <= SMOOTHED), strong & (np.abs(speed - around(speed, (0,))) >= RAPID)


@dataclass(frozen=True)
class Relaxation:
    """Weights of the sweeps. anchor None: no anchor and no speed limit; layers: strong layers are kept."""

    sweeps: int = 10
    diffusion: float = 0.22
    smooth: float = 0.018
    divergence: float = 0.010
    fill: float = 0.72
    preserve: float = 0.95
    anchor: float | None = 0.10
    most_speed: float = 120.0
    layers: bool = True
    keep_layer: float = 0.12
    damp_context: float = 0.35


def relax(u: np.ndarray, v: np.ndarray, conf: np.ndarray, source: np.ndarray, how: Relaxation) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """u, v and conf after the sweeps.

    A sweep draws cells of low confidence to their neighbours, against the gradient of the horizontal divergence,
    then (anchor) to the active neighbours, back to the first field and under the speed limit. Source cells
    change by 1 - preserve of that. Confidence spreads from neighbours, up to MOST_SPREAD.
    """
    first, now = (u, v), (u, v)
    for _ in range(how.sweeps):
        low, active = np.clip(1 - conf, 0, 1), conf > ACTIVE
        gain = np.clip(how.diffusion * low + how.smooth, 0, 0.65)
        level = apart = np.zeros(u.shape, dtype=bool)
        if how.layers:
            level, apart = layers_at_risk(*now, active)
        risk = level | apart
        gain = np.where(risk, gain * (1 - how.damp_context), gain)
        spread = slope(now[0], 2) + slope(now[1], 1)
        new = []
        for f, axis in zip(now, (2, 1), strict=True):
            mean = np.where(risk, around(f, (1, 2)), around(f))
            new.append(f + gain * (mean - f) - how.divergence * slope(spread, axis))
        if how.anchor is not None:
            for i in (0, 1):
                new[i] = new[i] + how.smooth * low * (around_active(new[i], active) - new[i])
                new[i] = new[i] + how.anchor * conf * (first[i] - new[i])
            new = list(limited(*new, how.most_speed))
        for cells, weight in ((level, how.keep_layer), (apart, how.damp_context)):
            back = np.where(cells, weight * np.clip(conf, 0, 1), 0.0)
            new = [n + back * (f - n) for n, f in zip(new, first, strict=True)]
        held = np.where(source, how.preserve, 0.0)
        now = tuple(n + held * (f - n) for n, f in zip(new, now, strict=True))
        conf = np.maximum(conf, np.clip(how.fill * around(conf), 0, MOST_SPREAD))
    return *now, conf


def relaxed(field: DataFrame, how: Relaxation = Relaxation()) -> DataFrame:
    """Relaxes each frame's active box (frame, z, y, x, u, v, conf, source); returns all cells of the box with conf."""
    ship(field.sparkSession)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        low = g[["z", "y", "x"]].min().to_numpy()
        shape = tuple(g[["z", "y", "x"]].max().to_numpy() - low + 1)
        at = tuple((g[["z", "y", "x"]].to_numpy() - low).T)
        dense = {c: np.zeros(shape) for c in ("u", "v", "conf")}
        for c in dense:
            dense[c][at] = g[c]
        source = np.zeros(shape, dtype=bool)
        source[at] = g["source"]
        u, v, conf = relax(dense["u"], dense["v"], dense["conf"], source, how)
        z, y, x = (i.ravel() for i in np.indices(shape))
        return pd.DataFrame({"frame": g["frame"].iloc[0], "z": z + low[0], "y": y + low[1], "x": x + low[2], "u": u.ravel(), "v": v.ravel(), "conf": conf.ravel()})

    kind = field.schema["frame"].dataType.simpleString()
    return field.groupBy("frame").applyInPandas(run, f"frame {kind}, z long, y long, x long, u double, v double, conf double")


@dataclass(frozen=True)
class Terms:
    """Weights of the eight terms of an analysis, and the speed limit."""

    background: float = 0.04
    radial: float = 0.08
    prior: float = 0.22
    observation: float = 0.28
    smooth: float = 0.018
    divergence: float = 0.006
    shear: float = 0.006
    boundary: float = 0.02
    most_speed: float = 120.0


@dataclass(frozen=True)
class Site:
    """A station's radial speeds: the line of sight (east, north, up) of every cell, what is seen along it, a weight."""

    east: np.ndarray
    north: np.ndarray
    up: np.ndarray
    seen: np.ndarray
    weight: np.ndarray | float = 1.0


def border(shape: tuple[int, ...]) -> np.ndarray:
    inside = np.zeros(shape)
    inside[tuple(slice(1, -1) for _ in shape)] = 1.0
    return 1.0 - inside


def analyse(background: tuple, prior: tuple, observed: tuple, sites: list[Site], steps: int = 60, terms: Terms = Terms()) -> tuple[np.ndarray, np.ndarray, dict[str, float]]:
    """u, v of an analysis by descent from the background, and the misfit of each term.

    background: (u, v, w); prior and observed: (u, v, confidence). Radial speeds pull along their line of sight,
    the vertical curvature and the six neighbours smooth, the edge of the box is drawn to the background.
    """
    edge, wanted = border(background[0].shape), (background[:2], prior[:2], observed[:2])
    pulls = [terms.background + terms.boundary * edge, terms.prior * np.clip(prior[2], 0, 1), terms.observation * np.clip(observed[2], 0, 1)]
    now, loss = tuple(background[:2]), {}
    for _ in range(steps):
        spread = slope(now[0], 2) + slope(now[1], 1)
        means = [around(f) for f in now]
        misses = [(now[0] * s.east + now[1] * s.north + background[2] * s.up - s.seen) * s.weight for s in sites]
        new = []
        for i, axis in ((0, 2), (1, 1)):
            f = now[i]
            step = terms.smooth * (means[i] - f) + terms.shear * 2 * (around(f, (0,)) - f) - terms.divergence * slope(spread, axis)
            step = step + sum(p * (w[i] - f) for p, w in zip(pulls, wanted, strict=True))
            step = step - terms.radial * sum(m * (s.north if i else s.east) for m, s in zip(misses, sites, strict=True))
            new.append(f + step)
        now = limited(*new, terms.most_speed)
        apart = lambda a, b: np.hypot(a[0] - b[0], a[1] - b[1])
        to = {"background": (apart(now, background), None), "prior": (apart(now, prior), prior[2] > 0), "observation": (apart(now, observed), observed[2] > 0)}
        loss = {n: float(gap[where].mean()) if where is None or where.any() else loss.get(n, 0.0) for n, (gap, where) in to.items()}
        loss |= {
            "radial": float(np.mean([np.abs(m).mean() for m in misses])) if sites else 0.0, "smooth": float(apart(means, now).mean()), "divergence": float(np.abs(spread).mean()),
            "shear": float(np.hypot(slope(now[0], 0), slope(now[1], 0)).mean()), "boundary": float((edge * apart(now, background)).mean()),
        }
    return *now, loss


def sight(shape: tuple[int, int, int], station: tuple[float, float, float], cell_km: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors (east, north, up) from a station (z, y, x) to all cells; rows run southwards. cell_km: height, width."""
    z, y, x = (i - s for i, s in zip(np.indices(shape), station, strict=True))
    east, north, up = x * cell_km[1], -y * cell_km[1], z * cell_km[0]
    far = np.maximum(np.sqrt(east**2 + north**2 + up**2), 1e-6)
    return east / far, north / far, up / far


def analysed(cells: DataFrame, shape: tuple[int, int, int], stations: list[tuple[float, float, float]], cell_km: tuple[float, float], steps: int = 60, terms: Terms = Terms()) -> DataFrame:
    """The analysis of every frame's cells (frame, z, y, x, u, v, conf, seen_u, seen_v, seen_conf) inside shape.

    u, v, conf is the sparse field that serves as prior, its mean over the frame the background; seen_* are the
    observations, null where there are none. Radial speeds are those that a station would see of the prior, and of
    the background where there is none. Returns the cells with u and v of the analysis.
    """
    ship(cells.sparkSession)
    views = [sight(shape, s, cell_km) for s in stations]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        at = tuple(g[["z", "y", "x"]].to_numpy().T)
        full = lambda c: _dense(shape, at, g[c])
        still = np.zeros(shape)
        background = (still + g["u"].mean(), still + g["v"].mean(), still)
        prior = tuple(full(c) for c in ("u", "v", "conf"))
        known = prior[2] > 0
        wind = [np.where(known, p, b) for p, b in zip(prior[:2], background[:2], strict=True)]
        sites = [Site(e, n, up, wind[0] * e + wind[1] * n) for e, n, up in views]
        u, v, _ = analyse(background, prior, tuple(full(c) for c in ("seen_u", "seen_v", "seen_conf")), sites, steps, terms)
        return pd.DataFrame({"frame": g["frame"], "z": g["z"], "y": g["y"], "x": g["x"], "u": u[at], "v": v[at]})

    kind = cells.schema["frame"].dataType.simpleString()
    return cells.groupBy("frame").applyInPandas(run, f"frame {kind}, z long, y long, x long, u double, v double")


def _dense(shape: tuple[int, int, int], at: tuple, values: pd.Series) -> np.ndarray:
    out = np.zeros(shape)
    out[at] = values.fillna(0.0).to_numpy(float)
    return out
