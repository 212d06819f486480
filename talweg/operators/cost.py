"""Distances and costs over cells.  What spreads is solved inside tiles; only tile borders travel."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talweg.functions.algebra import clip
from talweg.operators.focal import erosion_edges
from talweg.operators.hydro import EIGHT, WIDTH, drain
from talweg.plans.graph import cut
from talweg.plans.grid import D8, GridSpec
from talweg.plans.tiles import TILE, on_tiles, shifts, spread

KNIGHT = [(r, c) for r in (-2, -1, 1, 2) for c in (-2, -1, 1, 2) if abs(r) != abs(c)]


def lower_envelope(g2: np.ndarray, cs: float) -> np.ndarray:
    """min over j of g2[j] + ((i - j) cs)**2 for every i, in linear time; infinite g2 take no part."""
    at = np.flatnonzero(np.isfinite(g2))
    if not len(at):
        return np.full(len(g2), np.inf)
    height = (g2[at] / (cs * cs)).tolist()
    place = at.tolist()
    kept, begins = [0], [-math.inf]
    for j in range(1, len(place)):
        while True:
            i = kept[-1]
            cross = ((height[j] + place[j] ** 2) - (height[i] + place[i] ** 2)) / (2 * (place[j] - place[i]))
            if cross > begins[-1]:
                break
            kept.pop()
            begins.pop()
        kept.append(j)
        begins.append(cross)
    i = np.arange(len(g2))
    own = at[np.array(kept)[np.searchsorted(np.array(begins), i, "right") - 1]]
    return g2[own] + ((i - own) * cs) ** 2


def distance_transform(cells: DataFrame, csx: float = 1.0, csy: float = 1.0) -> DataFrame:
    """Euclidean distance of every cell to the nearest valid one, 0 on valid cells.

    First the nearest valid row up and down each column, then along each row the
    lower envelope of the columns' parabolas.  A task holds one row of the grid.
    """
    valid = F.when(F.col("value").isNotNull(), F.col("row"))
    up = Window.partitionBy("col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("col").orderBy("row").rowsBetween(0, Window.unboundedFollowing)
    near = cells.withColumn("_a", F.last(valid, ignorenulls=True).over(up)).withColumn("_b", F.first(valid, ignorenulls=True).over(down))
    g = F.least(F.col("row") - F.col("_a"), F.col("_b") - F.col("row"))
    columns = near.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.pow(g * csy, F.lit(2)).cast("double").alias("g2"))

    def along(t: pa.Table) -> pa.Table:
        col = t.column("col").to_numpy()
        g2 = np.where(np.isnan(x := t.column("g2").to_numpy()), np.inf, x)
        first = col.min()
        line = np.full(col.max() - first + 1, np.inf)
        line[col - first] = g2
        d = np.sqrt(lower_envelope(line, csx)[col - first])
        return pa.table({"row": t.column("row"), "col": t.column("col"), "value": pa.array(d, mask=np.isinf(d))})

    return columns.groupBy("row").applyInArrow(along, "row int, col int, value double")


def cost_distance(friction: DataFrame, starts: DataFrame, knight: bool = False, most: float | None = None, unit: float = 1.0, straight: float = 1.0, diagonal: float = math.sqrt(2), tile: int = TILE) -> DataFrame:
    """Least cost from the start cells: (row, col, value), NULL beyond ``most`` and where no way leads.

    A step costs its length in cells times the mean friction of both ends
    (``straight`` and ``diagonal`` are the lengths, ``unit`` scales them).
    """
    moves = EIGHT + (KNIGHT if knight else [])
    size = {1: straight, 2: diagonal, 5: math.sqrt(5)}
    halo = 2 if knight else 1
    reach = (halo, halo, halo, halo)

    def relax(static: np.ndarray, moving: np.ndarray, here: np.ndarray) -> None:
        f, cost = static[0], moving[0]
        inner = (slice(halo, -halo), slice(halo, -halo))
        steps = [size[r * r + c * c] * unit * (n + f[inner]) / 2 for (r, c), n in zip(moves, shifts(f, moves, reach))]
        while True:
            best = np.full(f[inner].shape, np.inf)
            for step, n in zip(steps, shifts(cost, moves, reach)):
                np.fmin(best, n + step, out=best)
            old = cost[inner]
            better = best < np.where(np.isnan(old), np.inf, old)
            if most is not None:
                better &= best <= most
            if not better.any():
                return
            cost[inner] = np.where(better, best, old)

    on = starts.where("value is not null").select("row", "col", F.lit(0.0).alias("cost"))
    cells = friction.where("value is not null").select("row", "col", "value").join(on, ["row", "col"], "left")
    return spread(cells, ["value"], ["cost"], halo, relax, {"cost": "double"}, tile).withColumnRenamed("cost", "value")


def topographic_wetness(streams: DataFrame, slope: DataFrame, spec: GridSpec, max_cost: float = 750.0, knights_move: bool = True) -> DataFrame:
    """max_cost minus the cost over slope from the streams; NULL beyond."""
    on = streams.where("value is not null").select("row", "col", F.lit(True).alias("s"))
    friction = slope.join(on, ["row", "col"], "left").select("row", "col", F.when(F.col("s"), 0.0).otherwise(clip(F.col("value"), 0.0, 90.0) / 90 * spec.avg_cs).alias("value"))
    cost = cost_distance(friction, streams, knights_move, max_cost)
    return cost.select("row", "col", F.when(F.col("value") <= max_cost, max_cost - F.col("value")).alias("value"))


def bankfull_width_geometric(streams: DataFrame, slope: DataFrame, spec: GridSpec, max_cost: float = 0.8, lcp: DataFrame | None = None, method: str = "balltree") -> DataFrame:
    """Width from the banks, the edges of the region that costs less than ``max_cost`` from the streams.

    ``balltree``: at stream cells, twice the mean distance of the bank cells for
    which the stream cell is the nearest; stream cells without bank cells are
    interpolated linearly between those that have (one cell outside their hull),
    and a width of 0 becomes one cell.  ``growfill``: at all cells of the region,
    twice the greatest distance to the banks among the cells whose steepest way
    to a bank leads through the cell, one cell on banks that no way meets.
    """
    if method not in ("balltree", "growfill"):
        raise ValueError(f"unknown method {method!r}")
    from talweg.operators.interp import linear, nearest

    if lcp is None:
        friction = slope.select("row", "col", (clip(F.col("value"), 0.0, 90.0) / 90 * spec.avg_cs).alias("value"))
        lcp = cut(cost_distance(friction, streams, True, max_cost))
    region = lcp.select("row", "col", F.when(F.col("value") < max_cost, F.lit(1.0)).alias("value"))
    banks = cut(erosion_edges(region).where("edge").select("row", "col"))
    if method == "growfill":
        flags = region.where("value is not null").select("row", "col").join(banks.withColumn("value", F.lit(1)), ["row", "col"], "left")
        away = cut(distance_transform(flags, spec.csx, spec.csy))

        def down(a: np.ndarray, here: np.ndarray) -> list[np.ndarray]:
            d = a[0, 1:-1, 1:-1]
            low, code = np.where(np.isnan(d), np.nan, d), np.zeros(d.shape)
            for c in sorted(D8):
                n = next(shifts(a[0], [D8[c]], (1, 1, 1, 1)))
                with np.errstate(invalid="ignore"):
                    better = n < low
                low, code = np.where(better, n, low), np.where(better, c, code)
            return [np.where(np.isnan(d), np.nan, code)]

        way = on_tiles(away, ["value"], (1, 1, 1, 1), down, {"value": "int"})
        far = drain(way, away.withColumnRenamed("value", "far"), {"far": "max"})
        return far.select("row", "col", F.when(F.col("far") > 0, 2 * F.col("far")).otherwise(F.lit(spec.avg_cs)).alias("value"))
    s = streams.where("value is not null").select((F.col("row").cast("long") * WIDTH + F.col("col")).alias("oid"), spec.x("col").alias("ox"), spec.y("row").alias("oy"), F.lit(0.0).alias("z"))
    b = banks.select((F.col("row").cast("long") * WIDTH + F.col("col")).alias("pid"), spec.x("col").alias("px"), spec.y("row").alias("py"))
    near = nearest(b, s, 1)
    width = near.groupBy("oid").agg((F.avg(F.sqrt("d2")) * 2).alias("w")).select("oid", F.when(F.col("w") == 0, spec.avg_cs).otherwise(F.col("w")).alias("w"))
    known = cut(s.join(width, "oid", "left"))
    have = known.where("w is not null").select("oid", "ox", "oy", F.col("w").alias("z"))
    lack = known.where("w is null").select(F.col("oid").alias("pid"), F.col("ox").alias("px"), F.col("oy").alias("py"))
    out = have.select("oid", F.col("z").alias("w"))
    if not have.isEmpty():
        out = out.unionByName(linear(lack, have, spec.avg_cs).select(F.col("pid").alias("oid"), F.col("value").alias("w")))
    else:
        out = lack.select(F.col("pid").alias("oid"), F.lit(spec.avg_cs).alias("w"))
    return out.select(F.floor(F.col("oid") / WIDTH).cast("int").alias("row"), F.pmod("oid", F.lit(WIDTH)).cast("int").alias("col"), F.col("w").alias("value"))


def valley_width(streams: DataFrame, slope: DataFrame, spec: GridSpec, max_cost: float = 1.0) -> DataFrame:
    return bankfull_width_geometric(streams, slope, spec, max_cost)


def _far_side(start: tuple[int, int], region: np.ndarray, edge: np.ndarray, csx: float, csy: float) -> tuple[float, list[tuple[int, int]], bool]:
    """Search from an edge cell, nearest cells first, until an edge cell on the far side is met.

    The far side lies beyond the centre of the inner cells met, seen from the
    centre of the edge cells met.  Returns the mean distance of the edge cells
    beside the last cell that had some (one cell before that), the cells met,
    and whether the search touched the border of the window.
    """
    from talweg.functions.algebra import near_side

    size, met = (csx + csy) / 2, {start}
    inner, rim = np.zeros(3), np.array([start[0], start[1], 1.0])
    heap: list[tuple[float, int, int]] = []
    at, touched, found = start, False, False
    while True:
        here = []
        for r, c in EIGHT:
            i, j = at[0] + r, at[1] + c
            if not (0 <= i < region.shape[0] and 0 <= j < region.shape[1]):
                touched = True
                continue
            if not region[i, j] or (i, j) in met:
                continue
            met.add((i, j))
            d = math.hypot((i - start[0]) * csy, (j - start[1]) * csx)
            if edge[i, j]:
                here.append(d)
                if inner[2] and not near_side(rim[1] / rim[2], rim[0] / rim[2], inner[1] / inner[2], inner[0] / inner[2], j, i):
                    found = True
                rim += (i, j, 1)
            else:
                inner += (i, j, 1)
                heapq.heappush(heap, (d, i, j))
        if here:
            size = sum(here) / len(here)
        if found or not heap:
            return size, list(met), touched
        _, *at = heapq.heappop(heap)


def width_transform(region: DataFrame, spec: GridSpec, reach: int = 64, tile: int = 128) -> DataFrame:
    """Approximate width of a region (valid cells) at each of its cells.

    A search starts at every edge cell and grows over the region until it meets
    an edge opposite; a cell's width is the mean over all searches that met it.
    Ties between cells at one distance go in row-major order.  Windows are tiles
    with ``reach`` cells around them; a search that would leave its window raises
    ValueError: ``reach`` must be more than the region is wide.
    """
    own = region.where("value is not null").select("row", "col", F.lit(1.0).alias("value"))
    edges = erosion_edges(own).select("row", "col", F.when(F.col("edge"), 1.0).otherwise(0.0).alias("value"))
    schema = "row int, col int, total double, n long"

    def search(t: pa.Table) -> pa.Table:
        r0, c0 = t.column("tr")[0].as_py() * tile - reach, t.column("tc")[0].as_py() * tile - reach
        side = tile + 2 * reach
        r, c = t.column("row").to_numpy() - r0, t.column("col").to_numpy() - c0
        inside, edge = np.zeros((side, side), bool), np.zeros((side, side), bool)
        inside[r, c], edge[r, c] = True, t.column("value").to_numpy() > 0
        total, n = np.zeros((side, side)), np.zeros((side, side), np.int64)
        for i, j in np.argwhere(edge[reach : reach + tile, reach : reach + tile]).tolist():
            size, met, touched = _far_side((i + reach, j + reach), inside, edge, spec.csx, spec.csy)
            if touched:
                raise ValueError(f"a search is wider than {reach} cells")
            at = tuple(np.array(met).T)
            total[at] += size
            n[at] += 1
        i, j = np.nonzero(n)
        return pa.table({"row": pa.array((i + r0).astype(np.int32)), "col": pa.array((j + c0).astype(np.int32)), "total": total[i, j], "n": n[i, j]})

    from talweg.plans.tiles import tiled

    found = tiled(edges.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "value"), tile, (reach,) * 4).groupBy("tr", "tc").applyInArrow(search, schema)
    width = found.groupBy("row", "col").agg((F.sum("total") / F.sum("n")).alias("w"))
    return region.select("row", "col", F.col("value").isNotNull().alias("in")).join(width, ["row", "col"], "left").select("row", "col", F.when(F.col("in"), F.col("w")).alias("value"))


def expand_interpolate(cells: DataFrame, regions: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """Grow values ring by ring into the unknown cells of the regions: mean of the known neighbours weighted by inverse distance.

    A cell's ring is its distance in steps from the known cells; its value comes
    from the neighbours of smaller rings alone, so tiles can be solved in any order.
    """
    base = cells.select("row", "col", F.col("value").cast("double").alias("value"))
    if regions is not None:
        base = base.join(regions.where("value is not null").select("row", "col"), ["row", "col"], "left_semi")
    one = (1, 1, 1, 1)
    weight = [1 / math.hypot(*o) for o in EIGHT]

    def grow(static: np.ndarray, moving: np.ndarray, here: np.ndarray) -> None:
        first, (ring, value) = static[0][1:-1, 1:-1], moving
        inside = here[1:-1, 1:-1]
        known = ~np.isnan(first)
        ring[1:-1, 1:-1] = np.where(known, 0, ring[1:-1, 1:-1])
        value[1:-1, 1:-1] = np.where(known, first, value[1:-1, 1:-1])
        while True:
            best = np.full(first.shape, np.inf)
            for n in shifts(ring, EIGHT, one):
                np.fmin(best, n + 1, out=best)
            old = ring[1:-1, 1:-1]
            better = inside & ~known & (best < np.where(np.isnan(old), np.inf, old))
            if not better.any():
                break
            ring[1:-1, 1:-1] = np.where(better, best, old)
        inner = ring[1:-1, 1:-1]
        for k in np.unique(inner[inner > 0]):
            total, share = np.zeros(first.shape), np.zeros(first.shape)
            for w, r, v in zip(weight, shifts(ring, EIGHT, one), shifts(value, EIGHT, one)):
                with np.errstate(invalid="ignore"):
                    ok = (r < k) & ~np.isnan(v)
                total, share = total + np.where(ok, v * w, 0), share + ok * w
            on = (inner == k) & (share > 0)
            value[1:-1, 1:-1][on] = total[on] / share[on]

    start = base.select("row", "col", F.col("value").alias("first"), F.lit(None).cast("double").alias("ring"), F.lit(None).cast("double").alias("value"))
    return spread(start, ["first"], ["ring", "value"], 1, grow, {"value": "double"}, tile)


def bankfull_extent(width: DataFrame, depth: DataFrame, dem: DataFrame, spec: GridSpec, flood_factor: float = 1.0, rings: int = 16, tile: int = TILE) -> DataFrame:
    """Cells flooded from the streams, ring by ring: ground not above the carried bankfull elevation, distance within the carried width.

    A ring takes the inverse-distance means of its flooded neighbours; all
    cells of a ring are taken at once.  Each pass computes ``rings`` rings on
    tiles with a halo of as many cells, so there are about as many passes as the
    greatest width has cells, over ``rings``.
    """
    cells = dem.select("row", "col", F.col("value").cast("double").alias("z"))
    cells = cells.join(width.select("row", "col", F.col("value").cast("double").alias("w")), ["row", "col"], "left").join(depth.select("row", "col", F.col("value").cast("double").alias("h")), ["row", "col"], "left")
    on = F.col("w").isNotNull() & F.col("h").isNotNull() & F.col("z").isNotNull()
    state = cut(cells.select("row", "col", "z", F.when(on, F.col("z") + F.col("h") * flood_factor).alias("e"), F.when(on, F.col("w")).alias("w"), F.when(on, 0.0).alias("d")))
    names = ["z", "e", "w", "d"]
    step = [math.hypot(r * spec.csy, c * spec.csx) for r, c in EIGHT]

    def flood(a: np.ndarray, here: np.ndarray) -> list[np.ndarray]:
        z, e, w, d = a
        before = ~np.isnan(d)
        for _ in range(rings):
            total, es, ws, least = (np.zeros(z.shape) for _ in range(4))
            least += np.inf
            pads = [np.pad(x, 1, constant_values=np.nan) for x in (e, w, d)]
            for s, (pe, pw, pd) in zip(step, zip(*(shifts(p, EIGHT, (1, 1, 1, 1)) for p in pads))):
                ok = ~np.isnan(pd)
                total, es, ws = total + ok / s, es + np.where(ok, pe / s, 0), ws + np.where(ok, pw / s, 0)
                np.fmin(least, pd + s, out=least)
            with np.errstate(all="ignore"):
                me, mw = es / total, ws / total
                new = np.isnan(d) & ~np.isnan(z) & (total > 0) & (me >= z) & (least <= mw)
            if not new.any():
                break
            e, w, d = np.where(new, me, e), np.where(new, mw, w), np.where(new, least, d)
        inner = (slice(rings, rings + tile), slice(rings, rings + tile))
        return [x[inner] for x in (z, e, w, d, (~np.isnan(d) & ~before).astype(float))]

    while True:
        state = cut(on_tiles(state, names, (rings,) * 4, flood, {n: "double" for n in names} | {"fresh": "boolean"}, tile))
        if state.where("fresh").isEmpty():
            return state.select("row", "col", F.when(F.col("d").isNotNull(), F.lit(1)).alias("value"))
