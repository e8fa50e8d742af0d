"""Grids: cells of positions, their centres and indices, aggregation into cells."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """A latitude-longitude-height grid; y counts from the north. down: cells joined along y and x."""

    lat_min: float = 12.2
    lat_max: float = 54.2
    lon_min: float = 73.0
    lon_max: float = 135.0
    step: float = 0.5
    dz: float = 500.0
    levels: int = 31
    down: int = 1

    @property
    def height(self) -> int:
        return round((self.lat_max - self.lat_min) / self.step) // self.down

    @property
    def width(self) -> int:
        return round((self.lon_max - self.lon_min) / self.step) // self.down


def inside(df: DataFrame, lat: tuple, lon: tuple, alt: tuple) -> DataFrame:
    """Rows within an inclusive box."""
    return df.where(F.col("lat").between(*lat) & F.col("lon").between(*lon) & F.col("alt").between(*alt))


def voxelize(df: DataFrame, grid: Grid, bounded: bool = True) -> DataFrame:
    """Adds z, y, x by floor; bounded: only rows within the grid."""
    step = grid.step * grid.down
    df = df.withColumns({"z": F.floor(F.col("alt") / grid.dz), "y": F.floor((F.lit(grid.lat_max) - F.col("lat")) / step), "x": F.floor((F.col("lon") - F.lit(grid.lon_min)) / step)})
    if not bounded:
        return df
    return df.where(F.col("z").between(0, grid.levels - 1) & F.col("y").between(0, grid.height - 1) & F.col("x").between(0, grid.width - 1))


def centre(df: DataFrame, grid: Grid) -> DataFrame:
    step = grid.step * grid.down
    return df.withColumns({"lat": grid.lat_max - (F.col("y") + 0.5) * step, "lon": grid.lon_min + (F.col("x") + 0.5) * step, "alt": F.col("z") * grid.dz})


def to_index(grid: Grid) -> Column:
    return F.col("z") * (grid.height * grid.width) + F.col("y") * grid.width + F.col("x")


def from_index(i: Column, grid: Grid) -> tuple[Column, Column, Column]:
    plane = grid.height * grid.width
    return F.floor(i / plane), F.floor(F.pmod(i, F.lit(plane)) / grid.width), F.pmod(i, F.lit(grid.width))
