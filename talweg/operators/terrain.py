"""Terrain derivatives of a DEM (row, col, value).  A missing neighbour counts as the cell itself."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.operators.focal import NINE, raster_filter
from talweg.plans.grid import GridSpec, disk_kernel, keys
from talweg.plans.tiles import TILE, on_tiles, shifts


def _on_nine(dem: DataFrame, f: Callable[..., np.ndarray], tile: int = TILE) -> DataFrame:
    """(keys, value): ``f`` of the nine values around a cell, in rows from up left; cells without a value drop out."""

    def run(a: np.ndarray, here: np.ndarray) -> list[np.ndarray]:
        z = a[0, 1:-1, 1:-1]
        with np.errstate(all="ignore"):
            made = f(*[np.where(np.isnan(p), z, p) for p in shifts(a[0], NINE, (1, 1, 1, 1))])
        return [np.where(np.isnan(z), np.nan, made), np.where(np.isnan(z), np.nan, 1)]

    got = on_tiles(dem, ["value"], (1, 1, 1, 1), run, {"value": "double", "known": "boolean"}, tile)
    return got.where("known").drop("known")


def gradient(csx: float, csy: float, z: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Horn's rise to the east and to the south."""
    gx = ((z[2] + 2 * z[5] + z[8]) - (z[0] + 2 * z[3] + z[6])) / (8 * csx)
    gy = ((z[6] + 2 * z[7] + z[8]) - (z[0] + 2 * z[1] + z[2])) / (8 * csy)
    return gx, gy


def slope(dem: DataFrame, csx: float, csy: float, units: str = "degrees", scale: float = 1.0, tile: int = TILE) -> DataFrame:
    """Horn's slope in degrees or percent."""
    if units not in ("degrees", "percent"):
        raise ValueError(f"unknown units {units!r}")

    def rise(*z: np.ndarray) -> np.ndarray:
        up = np.sqrt(sum(g * g for g in gradient(csx, csy, z))) / scale
        return np.degrees(np.arctan(up)) if units == "degrees" else up * 100

    return _on_nine(dem, rise, tile)


def aspect(dem: DataFrame, csx: float, csy: float, tile: int = TILE) -> DataFrame:
    """Azimuth of the downhill direction, clockwise from north; NULL where flat."""

    def azimuth(*z: np.ndarray) -> np.ndarray:
        gx, gy = gradient(csx, csy, z)
        turned = np.degrees(np.arctan2(-gx, gy))
        return np.where((gx == 0) & (gy == 0), np.nan, np.where(turned < 0, turned + 360, turned))

    return _on_nine(dem, azimuth, tile)


def ruggedness(dem: DataFrame, tile: int = TILE) -> DataFrame:
    """Riley's index: root of the summed squared differences to the eight neighbours."""
    return _on_nine(dem, lambda *z: np.sqrt(sum((n - z[4]) ** 2 for n in z)), tile)


def stream_slope(dem: DataFrame, streams: DataFrame, spec: GridSpec, units: str = "degrees", scale: float = 1.0, focal_mean_dist: float | None = None) -> DataFrame:
    """Slope of the DEM cut down to stream cells, smoothed over a disk on request."""
    on = streams.where("value is not null").select(*keys(streams))
    out = slope(dem.join(on, keys(dem), "left_semi"), spec.csx, spec.csy, units, scale)
    return raster_filter(out, disk_kernel(focal_mean_dist, spec.csx, spec.csy), "mean") if focal_mean_dist else out


def declination(day: int) -> float:
    """Of the sun, in radians (Cooper's formula)."""
    return math.radians(23.45) * math.sin(2 * math.pi * (284 + day) / 365)


def latitudes(spec: GridSpec, rows: np.ndarray) -> np.ndarray:
    """Latitude of each row's centre in degrees: of geographic, web-Mercator and UTM (EPSG:326xx, 327xx; along the meridian) grids."""
    y = spec.top - (rows + 0.5) * spec.csy
    code = spec.crs.upper().removeprefix("EPSG:")
    if code == "4326":
        return y
    if code == "3857":
        return np.degrees(2 * np.arctan(np.exp(y / 6378137.0)) - np.pi / 2)
    if code[:3] in ("326", "327") and len(code) == 5:
        # Footpoint latitude on the WGS84 ellipsoid.
        a, f = 6378137.0, 1 / 298.257223563
        e2 = f * (2 - f)
        mu = (y - (1e7 if code[:3] == "327" else 0)) / 0.9996 / (a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
        e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
        return np.degrees(mu + (1.5 * e1 - 27 * e1**3 / 32) * np.sin(2 * mu) + (21 * e1**2 / 16) * np.sin(4 * mu) + 151 * e1**3 / 96 * np.sin(6 * mu))
    raise NotImplementedError(f"no latitude for {spec.crs!r}: give one")


def solar_radiation(dem: DataFrame, day: int, step: float = 0.5, spec: GridSpec | None = None, latitude: float | None = None, terrain: bool = True, shading: int = 0, transmission: float = 0.7, tile: int = TILE) -> DataFrame:
    """(keys, value): clear-sky beam irradiation of a day in Wh/m2.

    At every ``step`` of hours the sun's height and azimuth follow from the
    day's declination and the cell's latitude (from ``spec``, or the same for
    all); the beam is weakened by the air mass and falls on the cell's slope and
    aspect (on a level surface without ``terrain``).  With ``shading`` cells
    that many cells away towards the sun can put a cell into shade.
    """
    return mean_radiation(dem, [day], step, spec, latitude, terrain, shading, transmission, tile)


def mean_radiation(dem: DataFrame, days: list[int] | range = range(15, 365, 30), step: float = 0.5, spec: GridSpec | None = None, latitude: float | None = None, terrain: bool = True, shading: int = 0, transmission: float = 0.7, tile: int = TILE) -> DataFrame:
    """(keys, value): mean of :func:`solar_radiation` over some days, in one pass over the cells."""
    if not len(days) or any(not 1 <= day <= 365 for day in days):
        raise ValueError("day must be 1 to 365")
    if step <= 0:
        raise ValueError("step must be positive")
    spec = spec or GridSpec(0, 0, 1, 1, 1, 1)
    if latitude is None and not spec.crs:
        raise ValueError("a spec with a CRS or a latitude is needed")
    halo = max(1, shading)
    reach = (halo, halo, halo, halo)

    def run(a: np.ndarray, here: np.ndarray) -> list[np.ndarray]:
        z = a[0, halo : halo + tile, halo : halo + tile]
        rows = a[1, halo : halo + tile, halo : halo + tile]
        phi = np.radians(np.full(z.shape, latitude) if latitude is not None else latitudes(spec, rows))
        nine = [np.where(np.isnan(p), z, p) for p in shifts(a[0], NINE, reach)]
        gx, gy = gradient(spec.csx, spec.csy, nine) if terrain else (np.zeros(z.shape), np.zeros(z.shape))
        length = np.sqrt(1 + gx * gx + gy * gy)
        total = np.zeros(z.shape)
        for day, i in itertools.product(days, range(math.ceil(24 / step))):
            tilt, near = declination(day), 1367 * (1 + 0.033 * math.cos(2 * math.pi * day / 365))
            turn = math.radians(15 * (i * step - 12))
            east = -np.cos(tilt) * np.sin(turn) * np.ones(z.shape)
            north = np.cos(phi) * np.sin(tilt) - np.sin(phi) * np.cos(tilt) * np.cos(turn)
            high = np.sin(phi) * np.sin(tilt) + np.cos(phi) * np.cos(tilt) * np.cos(turn)
            # The upward normal of the surface is (-gx, gy, 1) in (east, north, up).
            lit = (-gx * east + gy * north + high) / length
            beam = near * transmission ** (1 / np.maximum(high, 0.05)) * np.maximum(lit, 0) * (high > 0)
            for k in range(1, shading + 1) if (high > 0).any() else ():
                flat = np.hypot(east, north) + 1e-12
                dc, dr = (np.nan_to_num(np.rint(k * x / flat)).astype(int) for x in (east, -north))
                r, c = np.indices(z.shape)
                there = a[0, r + halo + dr, c + halo + dc]
                away = np.hypot(dc * spec.csx, dr * spec.csy)
                with np.errstate(invalid="ignore"):
                    beam = np.where((away > 0) & (there - z > away * high / flat), 0, beam)
            total += beam * step
        return [np.where(np.isnan(z), np.nan, total / len(days))]

    rows = dem.select(*keys(dem), "value").withColumn("_row", F.col("row").cast("double"))
    return on_tiles(rows, ["value", "_row"], reach, run, {"value": "double"}, tile)


def mean_of_days(stack: DataFrame) -> DataFrame:
    """Mean over a stack of rasters (day, row, col, value)."""
    return stack.groupBy(*keys(stack)).agg(F.avg("value").alias("value"))
