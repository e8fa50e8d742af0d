"""Forward and backward smoothing of tracklets on three axes, and the states of their ends.

A tracklet is bounded by how long an aircraft flies, so each is smoothed by itself, many of them in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from windgrid.functions import geo
from windgrid.operators.joins import successors
from windgrid.runtime import ship

#: Kilometres of a degree, process scales of the horizontal axes and of the height.
DEGREE_KM, HORIZONTAL, VERTICAL = 111.32, 2e-6, 0.08
#: Least time step, variances and rate of velocity variance, and limits of the two gains.
LEAST_STEP, LEAST_VARIANCE, LEAST_RATE, MOST_PULL, MOST_GAIN = 1.0, 1e-6, 1e-8, 0.8, 0.6


def filtered(t: np.ndarray, x: np.ndarray, noise: np.ndarray, process: float) -> np.ndarray:
    """Rows (position, velocity, variance) of a constant-velocity filter along t; its variances start from noise and process."""
    noise = np.maximum(noise, LEAST_VARIANCE)
    step = np.maximum(np.diff(t), LEAST_STEP)
    out = np.empty((len(x), 3))
    rate = max(process, LEAST_VARIANCE)  # variance of the velocity
    for k in range(len(x)):
        if k == 0:
            out[0] = x[0], 0.0, noise[0]
            continue
        dt = step[k - 1]
        at, speed, spread = out[k - 1]
        at, spread = at + speed * dt, spread + dt * dt * rate + process * dt
        gain = spread / (spread + noise[k])
        miss = x[k] - at
        out[k] = at + gain * miss, speed + min(MOST_PULL, 2 * gain / dt) * miss, max((1 - gain) * spread, LEAST_VARIANCE)
        rate = max((1 - min(gain, MOST_GAIN)) * rate + process, LEAST_RATE)
    return out


def smooth_states(t: np.ndarray, x: np.ndarray, noise: np.ndarray, process: float) -> np.ndarray:
    """Rows (position, velocity, variance): the filter along t and the one against it, weighed by their precisions.

    The one against it runs on -t; its velocity is merged as it is, with the sign of its own direction.
    """
    if not len(x):
        return np.empty((0, 3))
    ahead, back = filtered(t, x, noise, process), filtered(-t[::-1], x[::-1], noise[::-1], process)[::-1]
    weight = np.stack([1 / ahead[:, 2], 1 / back[:, 2]])
    total = weight.sum(axis=0)
    merged = (weight[0][:, None] * ahead[:, :2] + weight[1][:, None] * back[:, :2]) / total[:, None]
    return np.column_stack([merged, 1 / total])


def smoothed_tracklets(points: DataFrame, keys: list[str], order: list[str], time: str, lat: str, lon: str, alt: str, score: str) -> DataFrame:
    """points with s_lat, s_lon, s_alt, velocities v_east, v_north (km/s), v_up (m/s), var_east, var_north, var_alt and radius_km.

    Positions are taken in kilometres around the tracklet's medians. The noise of a point follows from its score in
    [0, 1] (null: a half): 25 m at 1 to 225 m at 0 across, 20 to 200 m in height, as standard deviations.
    """
    ship(points.sparkSession)
    added = ["s_lat", "s_lon", "s_alt", "v_east", "v_north", "v_up", "var_east", "var_north", "var_alt", "radius_km"]
    schema = StructType(points.schema.fields[:])
    for c in added:
        schema = schema.add(c, "double")

    def starts(g: pd.DataFrame) -> np.ndarray:
        """Where tracklets begin among rows sorted by them."""
        codes = np.column_stack([pd.factorize(g[k], use_na_sentinel=False)[0] for k in keys])
        return np.append(0, np.nonzero((codes[1:] != codes[:-1]).any(axis=1))[0] + 1)

    def done(g: pd.DataFrame) -> pd.DataFrame:
        t, y, x, z = (g[c].to_numpy(float) for c in (time, lat, lon, alt))
        doubt = 1 - g[score].fillna(0.5).to_numpy(float)
        across, high = (0.025 + 0.2 * doubt) ** 2, (20 + 180 * doubt) ** 2
        out = np.empty((len(added), len(g)))
        begin = starts(g)
        for k in map(slice, begin, np.append(begin[1:], len(g))):
            lat0, lon0 = float(np.nanmedian(y[k])), float(np.nanmedian(x[k]))
            wide = DEGREE_KM * max(np.cos(np.radians(lat0)), 0.1)
            east = smooth_states(t[k], (x[k] - lon0) * wide, across[k], HORIZONTAL)
            north = smooth_states(t[k], (y[k] - lat0) * DEGREE_KM, across[k], HORIZONTAL)
            up = smooth_states(t[k], z[k], high[k], VERTICAL)
            out[:, k] = lat0 + north[:, 0] / DEGREE_KM, lon0 + east[:, 0] / wide, up[:, 0], east[:, 1], north[:, 1], up[:, 1], east[:, 2], north[:, 2], up[:, 2], np.sqrt(east[:, 2] + north[:, 2])
        return g.assign(**dict(zip(added, out, strict=True)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole tracklets as they arrive; the last one of a batch may go on in the next."""
        held = None
        for g in batches:
            g = g if held is None else pd.concat([held, g], ignore_index=True)
            last = int(starts(g)[-1]) if len(g) else 0
            if last:
                yield done(g[:last].reset_index(drop=True))
            held = g[last:].reset_index(drop=True)
        if held is not None and len(held):
            yield done(held)

    return points.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def end_states(smoothed: DataFrame, keys: list[str], order) -> DataFrame:
    """First and last state of each tracklet, as start_* and end_*."""
    names = ["lat", "lon", "alt", "v_east", "v_north", "v_up", "var_across", "var_alt", "t"]
    s = smoothed.select(*keys, order.alias("__o"), F.col("s_lat").alias("lat"), F.col("s_lon").alias("lon"), F.col("s_alt").alias("alt"), "v_east", "v_north", "v_up", (F.col("var_east") + F.col("var_north")).alias("var_across"), "var_alt", "t")
    state = F.struct(*names)
    ends = s.groupBy(*keys).agg(F.min_by(state, "__o").alias("a"), F.max_by(state, "__o").alias("b"))
    return ends.select(*keys, *[F.col(f"a.{c}").alias(f"start_{c}") for c in names], *[F.col(f"b.{c}").alias(f"end_{c}") for c in names])


def bridge_edges(ends: DataFrame, keys: list[str], leg: str, most_gap_s: float, lags: int = 3) -> DataFrame:
    """Candidate links of a tracklet to its next `lags`: how far the next begins from where this one's end state leads.

    Adds km and m (residuals), far and high (residuals over the standard deviation of both ends and the gap), turn
    (change of velocity in m/s), prior and physical.
    """
    carried = [f"start_{c}" for c in ("lat", "lon", "alt", "v_east", "v_north", "var_across", "var_alt", "t")]
    e = successors(ends, keys, ["start_t", leg], [leg, *carried], lags, most_gap_s, "start_t", "end_t")
    c, gap = F.col, F.col("gap")
    lat = c("end_lat") + c("end_v_north") * gap / DEGREE_KM
    lon = c("end_lon") + c("end_v_east") * gap / (DEGREE_KM * F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.cos(F.radians("end_lat")))))
    e = e.withColumns({"__lat": lat, "__lon": lon}).withColumns({
        "km": geo.haversine_km(c("__lat"), c("__lon"), c("to_start_lat"), c("to_start_lon")),
        "m": F.abs(c("to_start_alt") - (c("end_alt") + c("end_v_up") * gap)),
        "turn": F.hypot(c("to_start_v_east") - c("end_v_east"), c("to_start_v_north") - c("end_v_north")) * 1000,
    })
    across = F.sqrt(c("end_var_across") + c("to_start_var_across") + F.pow(0.0025 * gap, 2))
    high = F.sqrt(c("end_var_alt") + c("to_start_var_alt") + F.pow(1.5 * gap, 2))
    e = e.withColumns({"far": c("km") / F.greatest(across, F.lit(0.02)), "high": c("m") / F.greatest(high, F.lit(20.0))})
    prior = F.least(F.lit(1.0), F.exp(-0.55 * c("far") - 0.35 * c("high") - 0.004 * c("turn") - 0.001 * gap))
    physical = (c("far") <= 12) & (c("high") <= 12) & (c("turn") <= 180) & (c("km") <= 3 + 0.03 * gap)
    return e.withColumns({"prior": prior, "physical": physical}).drop("__lat", "__lon")
