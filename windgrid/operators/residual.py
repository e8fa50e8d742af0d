"""Residuals of a field at points: features without truth, and a small network that is fitted on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from windgrid.functions.geo import clip
from windgrid.functions.weights import cyclic
from windgrid.operators.ordering import hash_sample
from windgrid.runtime import ship

#: Rows of the sample for the fit.
MOST_ROWS = 5_000

#: Fixed names of the numbers and flags that are features as they are; a column that rows lack, and a null, is 0.
NUMBERS = (
    "z y x lat lon alt_m pred_u pred_v pred_speed recon_confidence obs_count obs_conf nearest_role_gap_mps nearest_current_count nearest_context_count recon_vertical_jump_mps vertical_speed_gap_mps "
    "vertical_neighbor_max_speed_mps role_conflict_component_gap_at_point_mps role_conflict_threshold_at_point_mps role_conflict_context_factor_at_point role_conflict_current_density_at_point "
    "role_conflict_context_time_conf_at_point role_conflict_context_weight_at_point role_conflict_context_removed_weight_at_point nearest_train_distance_vox nearest_train_u nearest_train_v nearest_train_base_weight "
    "adaptive_current_support adaptive_context_support localization_radius_xy localization_sigma_xy localization_radius_z localization_sigma_z"
).split()
FLAGS = "role_overlap_at_point role_conflict_at_point".split()


def features(points: DataFrame, keys: list[str], time: str, grid: tuple[int, int, int], top_m: float) -> DataFrame:
    """keys and 64 features of every point: numbers, flags, places on the grid, time of day and year, source, and the risk
    that the field does not represent the point, with its sigma, chance of a tail, gate and weight.

    Nothing that holds the truth is read. points may have nearest_train_source_role.
    """
    have = set(points.columns)
    number = lambda n, other=0.0: F.coalesce(F.nanvl(F.col(n).cast("double"), F.lit(None).cast("double")), F.lit(other)) if n in have else F.lit(other)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    out: dict[str, Column] = {n: number(n) for n in NUMBERS}
    out |= {n: flag(F.col(n).cast("boolean")) if n in have else F.lit(0.0) for n in FLAGS}
    for axis, size in zip("zyx", grid, strict=True):
        out[f"{axis}_norm"] = clip(number(axis) / max(1.0, size - 1.0) * 2 - 1, -1.0, 1.0)
    speed, alt, current, context = number("pred_speed"), number("alt_m"), number("nearest_current_count"), number("nearest_context_count")
    out |= {"alt_norm": clip(alt / top_m, 0.0, 1.2), "pred_speed_norm": clip(speed / 120, 0.0, 2.0), "support_total": current + context, "support_log1p": F.log1p(F.greatest(current + context, F.lit(0.0)))}
    out["hour_sin"], out["hour_cos"] = cyclic(F.hour(time) + F.minute(time) / 60.0, 24.0)
    out["day_sin"], out["day_cos"] = cyclic(F.dayofyear(time) - 1.0, 366.0)
    source = F.lower(F.coalesce("nearest_train_source_role", F.lit(""))) if "nearest_train_source_role" in have else F.lit("")
    from_context = source.contains("context")
    out |= {"nearest_source_current_train": flag(source.contains("current")), "nearest_source_context": flag(from_context), "nearest_source_unknown": flag(source == "")}
    return points.select(*keys, *[c.alias(n) for n, c in (out | risk(number, speed, alt, current, context, from_context)).items()])


#: How much each of the eight parts weighs in the risk.
PARTS = {"distance": 0.23, "role_gap": 0.18, "low_conf": 0.18, "support": 0.16, "vertical": 0.12, "high_altitude": 0.06, "context_only": 0.05, "high_speed": 0.02}


def risk(number, speed: Column, alt: Column, current: Column, context: Column, from_context: Column) -> dict[str, Column]:
    """The eight parts of the risk and what follows from it; number(name, default) reads a column of the points."""
    unit = lambda c: clip(c, 0.0, 1.0)
    conf = number("recon_confidence")
    part = {
        "distance": unit((number("nearest_train_distance_vox", 99.0) - 2) / 4), "role_gap": unit((number("nearest_role_gap_mps") - 20) / 20), "low_conf": 1 - unit(conf / 0.20), "support": 1 - unit((current + 0.5 * context) / 3),
        "vertical": unit(F.greatest(number("vertical_speed_gap_mps"), number("recon_vertical_jump_mps")) / 30), "high_altitude": F.when(alt >= 12000, 1.0).otherwise(0.0),
        "context_only": F.when((current <= 0) & from_context, 1.0).otherwise(0.0), "high_speed": unit((speed - 45) / 45),
    }
    total = F.lit(0.0)
    for name, weight in PARTS.items():
        total = total + weight * part[name]
    total = unit(total)
    sigma = clip(2 + 22 * total + 4 * part["high_altitude"], 2.0, 32.0)
    gate = (1 - 0.80 * total) * clip((conf - 0.02) / 0.18, 0.05, 1.0) * clip(1 - 0.65 * part["role_gap"], 0.10, 1.0) * clip(1 - 0.55 * part["support"], 0.15, 1.0)
    return {
        "representation_risk_score": total, "sigma_rep_proxy_mps": sigma, "tail_probability_proxy": unit(F.pow(total, 2.2)), "residual_gate_initial": clip(gate, 0.0, 0.85), "sample_weight_raw": 1 / F.greatest(2.2**2 + sigma * sigma, F.lit(1.0)),
        "distance_risk_score": part["distance"], "role_gap_risk_score": part["role_gap"], "low_conf_risk_score": part["low_conf"], "support_risk_score": part["support"], "vertical_risk_score": part["vertical"],
        "context_only_risk_flag": part["context_only"], "high_altitude_flag": part["high_altitude"], "pred_light_wind_flag": F.when((speed >= 5) & (speed < 15), 1.0).otherwise(0.0),
    }


@dataclass(frozen=True)
class Loss:
    """The border of the Huber loss, the weights of the likelihood and of the size of corrections."""

    beta: float = 2.0
    likelihood: float = 0.03
    size: float = 0.02
    least_sigma: float = 0.25
    most_sigma: float = 40.0


@dataclass
class Network:
    """Layers of weights, bias, scale and shift (SiLU, then normalized), and an output of two corrections and two spreads."""

    layers: list[tuple[np.ndarray, ...]]
    last: tuple[np.ndarray, np.ndarray]
    cap: float

    def parameters(self) -> list[np.ndarray]:
        return [p for layer in self.layers for p in layer] + list(self.last)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corrections within +-cap and their spreads, (rows, 2) each."""
        out = self._forward(x)[0]
        return self.cap * np.tanh(out[:, :2]), 0.25 + np.logaddexp(0, out[:, 2:])

    def _forward(self, x: np.ndarray):
        kept = []
        for w, b, scale, shift in self.layers:
            a = x @ w + b
            gate = 1 / (1 + np.exp(-np.clip(a, -40, 40)))
            h = a * gate
            spread = np.sqrt(h.var(axis=1, keepdims=True) + 1e-5)
            normal = (h - h.mean(axis=1, keepdims=True)) / spread
            kept.append((x, a, gate, normal, spread))
            x = normal * scale + shift
        return x @ self.last[0] + self.last[1], x, kept

    def gradient(self, x: np.ndarray, y: np.ndarray, gate: np.ndarray, weight: np.ndarray, how: Loss) -> tuple[float, list[np.ndarray]]:
        """The loss, and its gradient by each of the parameters: weighted Huber, Gaussian likelihood, size of corrections."""
        out, top, kept = self._forward(x)
        rows, bend = len(x), np.tanh(out[:, :2])
        fix, raw = gate[:, None] * self.cap * bend, 0.25 + np.logaddexp(0, out[:, 2:])
        sigma, miss = np.clip(raw, how.least_sigma, how.most_sigma), fix - y
        small = np.abs(miss) < how.beta
        huber = np.where(small, 0.5 * miss**2 / how.beta, np.abs(miss) - 0.5 * how.beta)
        nll = 0.5 * ((miss / sigma) ** 2 + 2 * np.log(sigma))
        loss = (weight[:, None] * huber).sum() / rows + how.likelihood * np.clip(nll, -2, 20).mean() + how.size * ((fix / max(1e-6, self.cap)) ** 2).mean()
        live = ((nll > -2) & (nll < 20)) * how.likelihood / nll.size
        by_miss = weight[:, None] * np.where(small, miss / how.beta, np.sign(miss)) / rows + live * miss / sigma**2
        by_fix = by_miss + how.size * 2 * fix / max(1e-6, self.cap) ** 2 / fix.size
        by_sigma = live * (1 / sigma - miss**2 / sigma**3) * ((raw > how.least_sigma) & (raw < how.most_sigma))
        g = np.concatenate([by_fix * gate[:, None] * self.cap * (1 - bend**2), by_sigma / (1 + np.exp(-np.clip(out[:, 2:], -40, 40)))], axis=1)
        found = [top.T @ g, g.sum(axis=0)]
        g = g @ self.last[0].T
        for (w, _, scale, _), (inside, a, s, normal, spread) in zip(reversed(self.layers), reversed(kept), strict=True):
            by_scale, by_shift, n = (g * normal).sum(axis=0), g.sum(axis=0), g * scale
            h = (n - n.mean(axis=1, keepdims=True) - normal * (n * normal).mean(axis=1, keepdims=True)) / spread
            a_ = h * (s + a * s * (1 - s))
            found = [inside.T @ a_, a_.sum(axis=0), by_scale, by_shift, *found]
            g = a_ @ w.T
        return float(loss), found


def network(inputs: int, width: int, depth: int, cap: float, seed: int) -> Network:
    rng, layers = np.random.default_rng(seed), []
    for k in range(max(1, depth)):
        n = inputs if k == 0 else width
        layers.append((rng.normal(0, 1 / np.sqrt(max(1, n)), (n, width)), rng.normal(0, 0.1, width), np.ones(width), np.zeros(width)))
    return Network(layers, (rng.normal(0, 1 / np.sqrt(width), (width, 4)), np.zeros(4)), cap)


def fit(model: Network, x: np.ndarray, y: np.ndarray, gate: np.ndarray, weight: np.ndarray, how: Loss = Loss(), epochs: int = 60, batch: int = 128, rate: float = 1e-3, seed: int = 3) -> Network:
    """Adam over shuffled batches; all layers learn."""
    rng, p = np.random.default_rng(seed), model.parameters()
    first, second, step = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), batch):
            i, step = order[k : k + batch], step + 1
            for v, g, m, s in zip(p, model.gradient(x[i], y[i], gate[i], weight[i], how)[1], first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return model


def train(rows: DataFrame, key: str, width: int = 32, depth: int = 2, cap: float = 3.0, most: int = MOST_ROWS, seed: int = 3, **how) -> Network:
    """The network of rows (x array, y_u, y_v, gate, weight): fitted on at most `most` of them, chosen by a hash of the key."""
    t = hash_sample(rows.select(key, "x", "y_u", "y_v", "gate", "weight"), F.col(key), most).toPandas()
    x = np.array(t["x"].tolist(), dtype=float).reshape(len(t), -1)
    return fit(network(x.shape[1], width, depth, cap, seed), x, t[["y_u", "y_v"]].to_numpy(float), t["gate"].to_numpy(float), t["weight"].to_numpy(float), **how)


def predict(rows: DataFrame, model: Network) -> DataFrame:
    """rows with delta_u, delta_v (before the gate), sigma_u and sigma_v appended."""
    ship(rows.sparkSession)
    names = ["delta_u", "delta_v", "sigma_u", "sigma_v"]
    schema = StructType(rows.schema.fields[:])
    for n in names:
        schema = schema.add(n, "double")

    def run(batches):
        for pdf in batches:
            x = np.array(pdf["x"].tolist(), dtype=float).reshape(len(pdf), -1)
            found = np.concatenate(model(x), axis=1) if len(pdf) else np.empty((0, 4))
            yield pdf.assign(**{n: pd.Series(found[:, i], index=pdf.index) for i, n in enumerate(names)})

    return rows.mapInPandas(run, schema)
