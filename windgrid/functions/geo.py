"""Geometry and vectors on a sphere and in local planes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def clip(x: Column, low, high) -> Column:
    """x within [low, high]; null stays null (greatest and least alone would turn it into a bound)."""
    return F.when(x.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), x)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(clip(a, 0.0, 1.0)))


def angle_difference(a: Column, b: Column) -> Column:
    """Smallest angle between two directions in degrees; the modulo is floored."""
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def wind_vector(direction: Column, speed: Column) -> tuple[Column, Column]:
    """u, v of a wind that comes from `direction`."""
    return -speed * F.sin(F.radians(direction)), -speed * F.cos(F.radians(direction))


def motion_vector(heading: Column, speed: Column) -> tuple[Column, Column]:
    """u, v of a motion towards `heading`."""
    return speed * F.sin(F.radians(heading)), speed * F.cos(F.radians(heading))


def direction_error(u: Column, v: Column, truth_u: Column, truth_v: Column) -> Column:
    """Degrees between two vectors; null where the truth is below 5 or the prediction below 1 m/s."""
    between = angle_difference(F.degrees(F.atan2(u, v)), F.degrees(F.atan2(truth_u, truth_v)))
    return F.when((F.hypot(truth_u, truth_v) >= 5) & (F.hypot(u, v) >= 1), between)


def local_km(lat: Column, lon: Column, lat0: Column, lon0: Column, per_lat: float = 110.574, per_lon: float = 111.320, least_cos: float | None = None) -> tuple[Column, Column]:
    """East and north of (lat0, lon0) in km. The two projections in use differ in their constants and cosine floor."""
    cos = F.cos(F.radians(lat0))
    if least_cos is not None:
        cos = F.greatest(F.lit(least_cos), cos)
    return (lon - lon0) * per_lon * cos, (lat - lat0) * per_lat


def on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """Clamped fraction along a segment and cross-track distance of a point; a segment of no length has fraction 0."""
    dx, dy = bx - ax, by - ay
    fraction = F.coalesce(clip(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), 0.0, 1.0), F.lit(0.0))
    return fraction, F.hypot(px - (ax + fraction * dx), py - (ay + fraction * dy))


def reachable(gap_s: Column, distance_km: Column, climb_m: Column) -> Column:
    """Whether an aircraft can get from one leg's end to another's start."""
    gap = F.greatest(F.lit(30.0), gap_s)
    # 5 + 0.30 gap with one rounding, so that a distance of just that many km is within
    return (gap_s >= 0) & (gap_s <= 1800) & (distance_km <= (50 + 3 * gap) / 10) & (F.abs(climb_m) <= 500 + 30 * gap)


def radial_velocity(u: Column, v: Column, east: Column, north: Column) -> Column:
    """Speed along the line of sight (east, north)."""
    return F.try_divide(u * east + v * north, F.hypot(east, north))


def pressure_altitude(hpa: Column) -> Column:
    return 44330.0 * (1 - F.pow(hpa / 1013.25, F.lit(0.1903)))


def vertical_speed(omega: Column, pa: Column, kelvin: Column) -> Column:
    """w from omega: -omega / (rho g), rho = p / (287.05 T)."""
    return -omega / (pa / (287.05 * kelvin) * 9.80665)
