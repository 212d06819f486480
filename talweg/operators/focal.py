"""Moving windows over cells (row, col, value), one band after the other if there is a ``band``.

Windows are computed on tiles with a halo, in numpy: each cell is sent once,
and again only for the halos that it lies in.  A cell's result is NULL where
the cell itself is; absent and NULL neighbours are passed over.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.plans.grid import kernel_offsets, keys
from talweg.plans.tiles import TILE, Reach, on_tiles, shifts

Kernel = tuple[int, int] | list[list[bool]]
#: Values of windows held at a time by methods that sort them.
HELD = 4_000_000
METHODS = ("sum", "min", "max", "mode", "diff", "mean", "median", "std", "variance", "percentile", "quantile", "count")


def reach_of(offsets: list[tuple[int, int]]) -> Reach:
    up, left = (max(0, -min(o[i] for o in offsets)) for i in (0, 1))
    down, right = (max(0, max(o[i] for o in offsets)) for i in (0, 1))
    return up, down, left, right


def _sorted_windows(a: np.ndarray, offsets: list[tuple[int, int]], reach: Reach, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``f`` of the stacked windows (offset, row, column), some rows of cells at a time."""
    up, down, left, right = reach
    rows, cols = a.shape[0] - up - down, a.shape[1] - left - right
    out = np.empty((rows, cols))
    step = max(1, HELD // (len(offsets) * cols))
    for i in range(0, rows, step):
        part = a[i : min(rows, i + step) + up + down]
        out[i : i + step] = f(np.stack(list(shifts(part, offsets, reach))))
    return out


def _quantile(stack: np.ndarray, q: float) -> np.ndarray:
    """Linear interpolation between order statistics; missing values are sorted to the end."""
    stack.sort(axis=0)
    n = (~np.isnan(stack)).sum(axis=0)
    at = q * np.maximum(n - 1, 0)
    lo = np.floor(at).astype(int)
    hi = np.minimum(lo + 1, np.maximum(n - 1, 0))
    a, b = (np.take_along_axis(stack, i[None], axis=0)[0] for i in (lo, hi))
    return a + (b - a) * (at - lo)


def _mode(stack: np.ndarray) -> np.ndarray:
    """The most frequent value; ties to the one first met in row-major order."""
    k = len(stack)
    order = np.argsort(stack, axis=0, kind="stable")  # missing values last, equal ones in the kernel's order
    v = np.take_along_axis(stack, order, axis=0)
    new = np.ones(v.shape, bool)
    new[1:] = v[1:] != v[:-1]
    index = np.arange(k).reshape(-1, *[1] * (v.ndim - 1))
    start = np.maximum.accumulate(np.where(new, index, 0), axis=0)
    first = np.take_along_axis(order, start, axis=0)
    score = np.where(np.isnan(v), -1, (index - start + 1) * (k + 1) - first)
    return np.take_along_axis(v, score.argmax(axis=0)[None], axis=0)[0]


def focal_kernel(offsets: list[tuple[int, int]], method: str, q: float | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """The method as a function of a layer with its halo."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if method in ("percentile", "quantile") and q is None:
        raise ValueError(f"{method} needs q")
    reach = reach_of([*offsets, (0, 0)])
    share = {"median": 0.5, "percentile": (q or 0) / 100, "quantile": q or 0}.get(method)

    def extreme(a: np.ndarray, pick: Callable) -> np.ndarray:
        best = None
        for p in shifts(a, offsets, reach):
            best = p.copy() if best is None else pick(best, p, out=best)
        return best

    def moments(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total, n = 0.0, 0
        for p in shifts(a, offsets, reach):
            ok = ~np.isnan(p)
            n = n + ok
            total = total + np.where(ok, p, 0)
        return total, n

    def kernel(a: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            if share is not None:
                return _sorted_windows(a, offsets, reach, lambda x: _quantile(x, share))
            if method == "mode":
                return _sorted_windows(a, offsets, reach, _mode)
            if method in ("min", "max"):
                return extreme(a, np.fmin if method == "min" else np.fmax)
            if method == "diff":
                return extreme(a, np.fmax) - extreme(a, np.fmin)
            total, n = moments(a)
            if method in ("sum", "count"):
                return np.where(n > 0, total if method == "sum" else n, np.nan)
            mean = total / n
            if method == "mean":
                return mean
            spread = 0.0
            for p in shifts(a, offsets, reach):
                spread = spread + np.where(np.isnan(p), 0, (p - mean) ** 2)
            return np.sqrt(spread / n) if method == "std" else spread / n

    return kernel


def raster_filter(cells: DataFrame, kernel: Kernel, method: str, q: float | None = None, tile: int = TILE) -> DataFrame:
    """(keys, value) of a focal statistic.  ``mode`` gives ties to the value seen first in row-major order."""
    return focal_tiles(cells, kernel_offsets(kernel), method, tile, q)


def focal_tiles(cells: DataFrame, offsets: list[tuple[int, int]], method: str, tile: int = TILE, q: float | None = None) -> DataFrame:
    """:func:`raster_filter` for a list of offsets.  min, max, mode and diff keep the type of the value, and sum that of whole numbers."""
    own = focal_kernel(offsets, method, q)
    reach = up, _, left, _ = reach_of([*offsets, (0, 0)])

    def run(a: np.ndarray, here: np.ndarray) -> list[np.ndarray]:
        centre = a[0, up : up + tile, left : left + tile]
        return [np.where(np.isnan(centre), np.nan, own(a[0]))]

    kind = dict(cells.dtypes)["value"]
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    out = on_tiles(cells, ["value"], reach, run, {"value": "double"}, tile)
    if method in ("min", "max", "mode", "diff") and kind != "double":
        return out.withColumn("value", F.col("value").cast(kind))
    return out.withColumn("value", F.col("value").cast("bigint")) if whole and method in ("sum", "count") else out


def custom_raster_filter(cells: DataFrame, kernel: Kernel, func: Callable[..., float], *args, tile: int = TILE, batched: bool = False) -> DataFrame:
    """Any function of the window: it gets a 2-D float array with NaN outside the kernel and for missing cells, and returns a number.

    With ``batched`` it gets an array (windows, rows, columns) and returns one
    number a window, which spares a Python call for each cell.
    """
    offsets = kernel_offsets(kernel)
    reach = up, _, left, _ = reach_of([*offsets, (0, 0)])
    r_lo, c_lo = (min(o[i] for o in offsets) for i in (0, 1))
    shape = tuple(max(o[i] for o in offsets) - min(o[i] for o in offsets) + 1 for i in (0, 1))
    mask = np.zeros(shape, bool)
    for r, c in offsets:
        mask[r - r_lo, c - c_lo] = True

    def run(a: np.ndarray, here: np.ndarray) -> list[np.ndarray]:
        out = np.full((tile, tile), np.nan)
        windows = np.lib.stride_tricks.sliding_window_view(a[0], shape)
        r, c = np.nonzero(~np.isnan(a[0, up : up + tile, left : left + tile]))
        step = max(1, HELD // mask.size)
        for i in range(0, len(r), step):
            some = np.where(mask, windows[r[i : i + step] + up + r_lo, c[i : i + step] + left + c_lo], np.nan)
            known = ~np.isnan(some).all(axis=(1, 2))
            out[r[i : i + step][known], c[i : i + step][known]] = func(some[known], *args) if batched else [func(w, *args) for w in some[known]]
        return [out]

    return on_tiles(cells, ["value"], reach, run, {"value": "double"}, tile)


NINE = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)]


def erosion_edges(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """Valid cells with an invalid or absent cell among their eight neighbours: (keys, edge)."""

    def run(a: np.ndarray, here: np.ndarray) -> list[np.ndarray]:
        ok = ~np.isnan(a[0])
        whole = np.all(list(shifts(ok, NINE, (1, 1, 1, 1))), axis=0)
        return [np.where(ok[1:-1, 1:-1], ~whole, np.nan)]

    flags = cells.withColumn("value", F.when(F.col("value").isNotNull(), 1.0))
    return on_tiles(flags, ["value"], (1, 1, 1, 1), run, {"edge": "boolean"}, tile).where("edge is not null")


def fill_stats(cells: DataFrame, distance: float = 3, method: str = "wmean", least: int = 3, smooth: bool = True, use_map_units: bool = False, csx: float = 1.0, csy: float = 1.0, power: float = 1.0, tile: int = TILE) -> DataFrame:
    """Fill from the window of ``distance`` cells where at least ``least`` are known.

    ``wmean`` weights by inverse distance in cells to ``power`` (the cell itself
    by 1).  Without ``smooth`` known cells keep their value.  With
    ``use_map_units`` the distance is in map units and the window the disk of
    that radius.
    """
    if method not in ("wmean", "mean", "median", "min", "max", "mode"):
        raise ValueError(f"unknown method {method!r}")
    rows, cols = (int(distance // cs) for cs in (csy, csx)) if use_map_units else (int(distance), int(distance))
    around = [(r, c) for r in range(-rows, rows + 1) for c in range(-cols, cols + 1) if not use_map_units or np.hypot(r * csy, c * csx) <= distance]
    reach = (rows, rows, cols, cols)
    own = None if method == "wmean" else focal_kernel(around, method)

    def run(a: np.ndarray, here: np.ndarray) -> list[np.ndarray]:
        total, weight, n = 0.0, 0.0, 0
        for (r, c), p in zip(around, shifts(a[0], around, reach)):
            ok = ~np.isnan(p)
            w = 1 / max(np.hypot(r, c), 1.0) ** power
            n = n + ok
            total, weight = total + np.where(ok, p * w, 0), weight + ok * w
        with np.errstate(all="ignore"):
            best = np.where(n >= least, total / weight if own is None else own(a[0]), np.nan)
        centre = a[0, rows : rows + tile, cols : cols + tile]
        return [best if smooth else np.where(np.isnan(centre), best, centre)]

    return on_tiles(cells, ["value"], reach, run, {"value": "double"}, tile)


def row_window(cells: DataFrame, before: int, after: int, agg: Column) -> DataFrame:
    """A one-dimensional window along rows of a complete grid."""
    w = Window.partitionBy(*[k for k in keys(cells) if k != "col"]).orderBy("col").rowsBetween(-before, after)
    return cells.withColumn("value", agg.over(w))
