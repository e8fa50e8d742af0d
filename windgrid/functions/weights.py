"""Kernels, confidences, error models and step functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from windgrid.functions.geo import clip


def half_life(minutes: Column, half: float) -> Column:
    return F.pow(F.lit(0.5), F.abs(minutes) / max(1.0, half))


def decay(minutes: Column, alpha: float) -> Column:
    return F.exp(-alpha * F.abs(minutes))


def space_confidence(distance: Column, height: Column, sigma: float, sigma_z: float) -> Column:
    return clip(F.exp(-0.5 * F.pow(distance / sigma, 2) - 0.5 * F.pow(height / sigma_z, 2)), 0.02, 1.0)


def linear_confidence(x: Column, limit: float) -> Column:
    return clip(1 - F.abs(x) / limit, 0.0, 1.0)


def gaussian(*scaled: Column) -> Column:
    total = F.lit(0.0)
    for x in scaled:
        total = total + x * x
    return F.exp(-0.5 * total)


def gaspari_cohn(r: Column) -> Column:
    """The fifth-order piecewise function with support 2."""
    x = F.abs(r)
    near = 1 - 5 / 3 * x**2 + 5 / 8 * x**3 + 1 / 2 * x**4 - 1 / 4 * x**5
    far = 4 - 5 * x + 5 / 3 * x**2 + 5 / 8 * x**3 - 1 / 2 * x**4 + 1 / 12 * x**5 - F.try_divide(F.lit(2.0), 3 * x)
    return F.when(x <= 1, near).when(x < 2, far).otherwise(0.0)


def speed_taper(speed: Column, low: float = 70.0, high: float = 95.0, least: float = 0.10) -> Column:
    """1 up to `low`, `least` from `high`, half a cosine between."""
    phase = clip((speed - low) / (high - low), 0.0, 1.0)
    return least + (1 - least) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * phase))


def representativeness_sigma(spread: Column, horizontal_km: Column, vertical_m: Column) -> Column:
    return clip(F.sqrt(1.5**2 + 0.5 * spread**2 + (horizontal_km / 80) ** 2 + (vertical_m / 1200) ** 2), 1.0, 18.0)


def error_factor(sigma: Column) -> Column:
    return clip(F.pow(8.0 / sigma, 2), 0.05, 4.0)


def density_confidence(count: Column) -> Column:
    return 1 - F.exp(-count / 3.0)


def log_mean(factors: list[Column], weights: list[float], least: float = 1e-6) -> Column:
    """Weighted geometric mean of factors clipped to [least, 1]."""
    total = F.lit(0.0)
    for f, w in zip(factors, weights, strict=True):
        total = total + w * F.ln(clip(f, least, 1.0))
    return F.exp(total)


def steps(x: Column, bounds: list[float], values: list[float]) -> Column:
    """values[i] for x <= bounds[i], the last value beyond; null stays null."""
    out = F.when(x <= bounds[0], values[0])
    for b, v in zip(bounds[1:], values[1:-1], strict=True):
        out = out.when(x <= b, v)
    return F.when(x.isNotNull(), out.otherwise(values[-1]))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-clip(x, -40.0, 40.0)))


def logit(p: Column) -> Column:
    q = clip(p, 1e-6, 1 - 1e-6)
    return F.ln(q / (1 - q))


def huber(x: Column, delta: float) -> Column:
    a = F.abs(x)
    return F.when(a <= delta, 0.5 * a * a).otherwise(delta * (a - 0.5 * delta))


def buddy_factor(departure: Column, sigma: Column, spread: Column, k: float = 2.0, soft: float = 1.0) -> Column:
    ratio = F.abs(departure) / (k * F.sqrt(sigma**2 + spread**2))
    return F.when(ratio <= 1, 1.0).otherwise(F.exp(-0.5 * ((ratio - 1) / soft) ** 2))


def good_posterior(departure: Column, sigma: Column, prior_bad: float, width: float) -> Column:
    """Chance that a departure is no gross error: a Gaussian against a flat density of `width`."""
    good = F.ln(F.lit(1 - prior_bad)) - 0.5 * (departure / sigma) ** 2 - F.ln(sigma) - 0.9189385332046727
    bad = F.lit(prior_bad / width)
    return sigmoid(good - F.ln(bad))


def cyclic(x: Column, period: float) -> tuple[Column, Column]:
    angle = 2 * 3.141592653589793 * x / period
    return F.sin(angle), F.cos(angle)


def good_wind(du: Column, dv: Column, sigma: Column, prior: float = 0.06, width: float = 260.0, least: float = 0.05) -> Column:
    """Chance that a wind's departure from the background is no gross error, at least `least`."""
    two_pi = 6.283185307179586
    good = F.ln((1 - prior) / (two_pi * sigma * sigma)) - 0.5 * (du * du + dv * dv) / (sigma * sigma)
    return clip(sigmoid(good - F.ln(F.lit(prior / width**2))), least, 1.0)


def background_sigma(alt: Column) -> Column:
    """The spread of a background by height."""
    return F.when(alt < 3000, 7.0).when(alt < 6000, 8.5).when(alt < 9000, 10.0).when(alt < 12000, 12.0).otherwise(15.0)


def buddies(departure: Column, sigma: Column, spread: Column, neighbours: Column, k: float = 3.2, soft: float = 2.0, least: float = 0.15, few: int = 2) -> Column:
    """1 within the tolerance of the neighbours or with too few of them, beyond it a Gaussian, at least `least`."""
    ratio = departure / (k * F.hypot(sigma, clip(spread, 3.0, 45.0)))
    soft_factor = F.greatest(F.lit(least), F.exp(-0.5 * F.pow((ratio - 1) / soft, 2)))
    return F.when((neighbours >= few) & (ratio > 1), soft_factor).otherwise(1.0)
