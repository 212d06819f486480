"""Resampling, mosaics, clipping and conversions between rasters and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.operators.focal import NINE
from talweg.plans.graph import component_labels, cut, numbered
from talweg.plans.grid import GridSpec, transform_points


def _cubic(d: Column) -> Column:
    """Cubic convolution weight (a = -1/2)."""
    x = F.abs(d)
    return F.when(x <= 1, 1.5 * x * x * x - 2.5 * x * x + 1).when(x < 2, -0.5 * x * x * x + 2.5 * x * x - 4 * x + 2).otherwise(F.lit(0.0))


def warp(sources: list[tuple[DataFrame, GridSpec]], target: GridSpec, method: str = "cubic") -> DataFrame:
    """(row, col, value) on the target grid; where several sources have a value the last one wins.

    nearest, bilinear (4 cells) or cubic (16 cells); weights of missing cells
    are left out and the others scaled up.
    """
    reach = {"nearest": [0], "bilinear": [0, 1], "cubic": [-1, 0, 1, 2]}.get(method)
    if reach is None:
        raise ValueError(f"unknown method {method!r}")
    out = None
    for order, (cells, spec) in enumerate(sources):
        grid = target.cells(cells.sparkSession).where("band = 1").select("row", "col")
        x, y = transform_points(target.x("col"), target.y("row"), target.crs or "0", spec.crs or target.crs or "0") if target.crs != spec.crs else (target.x("col"), target.y("row"))
        fr, fc = (F.lit(spec.top) - y) / spec.csy - 0.5, (x - F.lit(spec.left)) / spec.csx - 0.5
        grid = grid.withColumn("fr", fr).withColumn("fc", fc)
        if method == "nearest":
            asked = grid.select("row", "col", F.floor(F.col("fr") + 0.5).cast("int").alias("sr"), F.floor(F.col("fc") + 0.5).cast("int").alias("sc"), F.lit(1.0).alias("w"))
        else:
            near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in reach for j in reach]))
            asked = grid.withColumn("o", near).withColumn("sr", (F.floor("fr") + F.col("o.i")).cast("int")).withColumn("sc", (F.floor("fc") + F.col("o.j")).cast("int"))
            dr, dc = F.col("fr") - F.col("sr"), F.col("fc") - F.col("sc")
            weight = _cubic(dr) * _cubic(dc) if method == "cubic" else F.greatest(1 - F.abs(dr), F.lit(0.0)) * F.greatest(1 - F.abs(dc), F.lit(0.0))
            asked = asked.withColumn("w", weight).where("w <> 0")
        src = cells.where("value is not null").select(F.col("row").alias("sr"), F.col("col").alias("sc"), F.col("value").cast("double").alias("v"))
        got = asked.join(src, ["sr", "sc"]).groupBy("row", "col").agg(F.try_divide(F.sum(F.col("v") * F.col("w")), F.sum("w")).alias("value")).withColumn("ord", F.lit(order))
        out = got if out is None else out.unionByName(got)
    return out.groupBy("row", "col").agg(F.max_by("value", "ord").alias("value"))


def common_dtype(dtypes: list[str]) -> str:
    """The most frequent type; ties to the smaller name."""
    return min(set(dtypes), key=lambda t: (-dtypes.count(t), t))


def warp_like(sources: list[tuple[DataFrame, GridSpec]], template: GridSpec, method: str = "cubic", **overrides) -> tuple[DataFrame, GridSpec]:
    target = template.with_(dtype=common_dtype([s.dtype for _, s in sources]), **overrides)
    return warp(sources, target, method), target


def data_extent(cells: DataFrame, spec: GridSpec) -> GridSpec | None:
    """The smallest aligned grid around the valid cells; None without any."""
    r0, r1, c0, c1 = cells.where("value is not null").agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    if r0 is None:
        return None
    return spec.with_(left=spec.left + c0 * spec.csx, top=spec.top - r0 * spec.csy, n_rows=r1 - r0 + 1, n_cols=c1 - c0 + 1)


def clip_raster(cells: DataFrame, spec: GridSpec, mask: DataFrame, mask_spec: GridSpec, crop_to_data: bool = False, method: str = "bilinear") -> tuple[DataFrame, GridSpec]:
    """The raster on the mask's grid, cut down to its valid cells."""
    moved = cells if spec.matches(mask_spec) else warp([(cells, spec)], mask_spec, method)
    out = moved.join(mask.where("value is not null").select("row", "col"), ["row", "col"], "left_semi")
    if not crop_to_data or (small := data_extent(mask, mask_spec)) is None:
        return out, mask_spec
    r0, c0 = round((mask_spec.top - small.top) / spec.csy), round((small.left - mask_spec.left) / spec.csx)
    return out.withColumn("row", F.col("row") - r0).withColumn("col", F.col("col") - c0), small


def common_grid(a: GridSpec, b: GridSpec, align: str = "min", how: str = "union") -> GridSpec:
    """Smallest (or with ``how="intersection"`` common) extent, with the smaller or larger cell size."""
    pick = {"min": min, "max": max}[align]
    csx, csy = pick(a.csx, b.csx), pick(a.csy, b.csy)
    lo, hi = (min, max) if how == "union" else (max, min)
    left, right, top, bottom = lo(a.left, b.left), hi(a.right, b.right), hi(a.top, b.top), lo(a.bottom, b.bottom)
    if right <= left or top <= bottom:
        raise ValueError("extents do not meet")
    return a.with_(left=left, top=top, csx=csx, csy=csy, n_cols=max(1, round((right - left) / csx)), n_rows=max(1, round((top - bottom) / csy)))


def xy_align(a: tuple[DataFrame, GridSpec], b: tuple[DataFrame, GridSpec], align: str = "min", method: str = "bilinear", how: str = "union") -> tuple[DataFrame, DataFrame, GridSpec]:
    grid = common_grid(a[1], b[1], align, how)
    return warp([a], grid, method), warp([b], grid, method), grid


def equal_value_regions(cells: DataFrame, width: int = 1 << 31) -> DataFrame:
    """(row, col, value, region): eight-connected cells of equal value; regions by their first cell in row-major order."""
    own = cut(cells.where("value is not null").select((F.col("row").cast("long") * width + F.col("col")).alias("id"), "row", "col", "value"))
    half = [o for o in NINE if o > (0, 0)]
    near = own.select("id", "value", "row", "col", F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in half])).alias("o"))
    near = near.select(F.col("id").alias("a"), "value", ((F.col("row") + F.col("o.r")).cast("long") * width + F.col("col") + F.col("o.c")).alias("b"))
    pairs = near.join(own.select(F.col("id").alias("b"), F.col("value").alias("v2")), "b").where("value = v2").select("a", "b")
    labels = component_labels(own.select("id"), pairs)
    number = numbered(labels.select("label").distinct(), "label", "region")
    return own.join(labels, "id").join(number, "label").select("row", "col", "value", "region")


def region_outlines(regions: DataFrame, spec: GridSpec) -> DataFrame:
    """(region, value, rings): boundary edges between a region and anything else, stitched into closed rings of (x, y)."""
    sides = {"t": (-1, 0), "b": (1, 0), "l": (0, -1), "r": (0, 1)}
    ends = {"t": ((0, 0), (0, 1)), "r": ((0, 1), (1, 1)), "b": ((1, 1), (1, 0)), "l": ((1, 0), (0, 0))}
    places = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("dr", "dc", "r1", "c1", "r2", "c2"), (*sides[s], *ends[s][0], *ends[s][1]))]) for s in sides])
    all_ = regions.select("region", "value", "row", "col", F.explode(places).alias("e"))
    other = regions.select(F.col("region").alias("r2"), F.col("row").alias("nr"), F.col("col").alias("nc"))
    edge = all_.withColumn("nr", F.col("row") + F.col("e.dr")).withColumn("nc", F.col("col") + F.col("e.dc")).join(other, ["nr", "nc"], "left").where("r2 is null or r2 <> region")
    edge = edge.select("region", "value", (F.col("row") + F.col("e.r1")).alias("r1"), (F.col("col") + F.col("e.c1")).alias("c1"), (F.col("row") + F.col("e.r2")).alias("r2"), (F.col("col") + F.col("e.c2")).alias("c2"))
    left, top, csx, csy = spec.left, spec.top, spec.csx, spec.csy

    def stitch(pdf):
        import pandas as pd

        steps: dict = {}
        for r1, c1, r2, c2 in pdf[["r1", "c1", "r2", "c2"]].sort_values(["r1", "c1", "r2", "c2"]).itertuples(index=False):
            steps.setdefault((r1, c1), []).append((r2, c2))
        rings = []
        while steps:
            start = at = min(steps)
            ring = [start]
            while True:
                to = steps[at].pop(0)
                if not steps[at]:
                    del steps[at]
                ring.append(to)
                at = to
                if at == start:
                    break
            rings.append([{"x": float(left + c * csx), "y": float(top - r * csy)} for r, c in ring])
        return pd.DataFrame({"region": [pdf.region.iloc[0]], "value": [float(pdf.value.iloc[0])], "rings": [rings]})

    return edge.groupBy("region").applyInPandas(stitch, "region int, value double, rings array<array<struct<x:double,y:double>>>")


def vectorize(cells: DataFrame, spec: GridSpec, geometry: str = "polygon") -> DataFrame:
    if geometry == "point":
        return cells.where("value is not null").select(spec.x("col").alias("x"), spec.y("row").alias("y"), "value")
    if geometry != "polygon":
        raise ValueError(f"unknown geometry {geometry!r}")
    return region_outlines(equal_value_regions(cells), spec)


def vector_to_raster(polygons: DataFrame, spec: GridSpec, burn_value: float | None = None, burn_field: str | None = None, as_mask: bool = False, all_touched: bool = False) -> DataFrame:
    """(row, col, value) of cells inside polygons (id, rings); the largest id wins where they overlap.

    A centre is inside by the even-odd rule over all rings; ``all_touched``
    adds cells that an edge passes through.
    """
    if sum(x is not None and x is not False for x in (burn_value, burn_field, as_mask or None)) != 1:
        raise ValueError("one of burn_value, burn_field and as_mask is needed")
    value = F.lit(1.0) if as_mask else F.lit(float(burn_value)) if burn_value is not None else F.col(burn_field).cast("double")
    own = polygons.select("id", "rings", value.alias("value"))
    flat = F.flatten("rings")
    limit = lambda f, k: f(F.transform(flat, lambda p: p[k]))
    box = own.select("*", limit(F.array_min, "x").alias("x0"), limit(F.array_max, "x").alias("x1"), limit(F.array_min, "y").alias("y0"), limit(F.array_max, "y").alias("y1"))
    rows = F.sequence(F.greatest(spec.row("y1"), F.lit(0)), F.least(spec.row("y0"), F.lit(spec.n_rows - 1)))
    cols = F.sequence(F.greatest(spec.col("x0"), F.lit(0)), F.least(spec.col("x1"), F.lit(spec.n_cols - 1)))
    meets = (F.greatest(spec.row("y1"), F.lit(0)) <= F.least(spec.row("y0"), F.lit(spec.n_rows - 1))) & (F.greatest(spec.col("x0"), F.lit(0)) <= F.least(spec.col("x1"), F.lit(spec.n_cols - 1)))
    cells = box.where(meets).select("id", "rings", "value", F.explode(rows).alias("row"), cols.alias("cols")).select("id", "rings", "value", "row", F.explode("cols").alias("col"))
    px, py = spec.x("col"), spec.y("row")
    legs = F.flatten(F.transform("rings", lambda r: F.transform(F.sequence(F.lit(1), F.size(r) - 1), lambda i: F.struct(F.element_at(r, i).alias("a"), F.element_at(r, i + 1).alias("b")))))
    crosses = F.size(F.filter(legs, lambda e: ((e["a"]["y"] > py) != (e["b"]["y"] > py)) & (px < (e["b"]["x"] - e["a"]["x"]) * (py - e["a"]["y"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0)) + e["a"]["x"])))
    hit = crosses % 2 == 1
    if all_touched:
        x0, x1, y0, y1 = px - spec.csx / 2, px + spec.csx / 2, py - spec.csy / 2, py + spec.csy / 2

        def touches(e):
            dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
            side = lambda x, y: dx * (y - e["a"]["y"]) - dy * (x - e["a"]["x"])
            s = [side(x, y) for x in (x0, x1) for y in (y0, y1)]
            apart = (F.greatest(e["a"]["x"], e["b"]["x"]) < x0) | (F.least(e["a"]["x"], e["b"]["x"]) > x1) | (F.greatest(e["a"]["y"], e["b"]["y"]) < y0) | (F.least(e["a"]["y"], e["b"]["y"]) > y1)
            return ~apart & ~((F.least(*s) > 0) | (F.greatest(*s) < 0))

        hit = hit | F.exists(legs, touches)
    return cells.where(hit).groupBy("row", "col").agg(F.max_by("value", "id").alias("value"))


def values_on_lines(lines: DataFrame, cells: DataFrame, spec: GridSpec) -> DataFrame:
    """(fid, points): the cells that lines (fid, seq, x, y) pass through, as (x, y, value), in order along the line."""
    w = Window.partitionBy("fid").orderBy("seq")
    legs = lines.withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("y").over(w)).where("x2 is not null")
    n = F.ceil(F.greatest(F.abs(F.col("x2") - F.col("x")) / spec.csx, F.abs(F.col("y2") - F.col("y")) / spec.csy) * 4).cast("int") + 1
    steps = legs.withColumn("n", n).select("fid", "seq", "x", "y", "x2", "y2", "n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("i"))
    t = F.col("i") / F.col("n")
    at = steps.select("fid", "seq", "i", spec.row(F.col("y") + (F.col("y2") - F.col("y")) * t).alias("row"), spec.col(F.col("x") + (F.col("x2") - F.col("x")) * t).alias("col"))
    once = at.groupBy("fid", "row", "col").agg(F.min(F.struct("seq", "i")).alias("ord"))
    got = once.join(cells.where("value is not null"), ["row", "col"])
    return got.groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", spec.x("col").alias("x"), spec.y("row").alias("y"), F.col("value").alias("value")))), lambda s: F.struct(s["x"], s["y"], s["value"])).alias("points"))


def tile_keys(points: DataFrame, zoom: int) -> DataFrame:
    """Points (x = longitude, y = latitude, value) with their slippy-map tile (z, tx, ty)."""
    n = float(1 << zoom)
    lat = F.radians("y")
    tx, ty = F.floor((F.col("x") + 180) / 360 * n), F.floor((1 - F.log(F.tan(lat) + 1 / F.cos(lat)) / F.pi()) / 2 * n)
    return points.select("*", F.lit(zoom).alias("z"), tx.cast("int").alias("tx"), ty.cast("int").alias("ty"))


def z_align(source: DataFrame, addition: DataFrame, n_neighbours: int = 1000) -> DataFrame:
    """The source, with holes filled from the addition, shifted by the difference at the edges of their overlap (IDW)."""
    from talweg.operators.focal import erosion_edges
    from talweg.operators.interp import idw

    both = source.select("row", "col", F.col("value").cast("double").alias("s")).join(addition.select("row", "col", F.col("value").cast("double").alias("a")), ["row", "col"], "full")
    both = cut(both)
    delta = both.select("row", "col", (F.col("s") - F.col("a")).alias("value"))
    rim = erosion_edges(delta).where("edge").join(delta, ["row", "col"])
    obs = rim.select((F.col("row").cast("long") * (1 << 31) + F.col("col")).alias("oid"), F.col("col").cast("double").alias("ox"), F.col("row").cast("double").alias("oy"), F.col("value").alias("z"))
    gaps = both.where("s is null and a is not null").select(F.struct("row", "col").alias("pid"), F.col("col").cast("double").alias("px"), F.col("row").cast("double").alias("py"))
    shift = idw(gaps, obs, n_neighbours).select("pid.row", "pid.col", F.col("value").alias("d"))
    return both.join(shift, ["row", "col"], "left").select("row", "col", F.coalesce("s", F.col("a") + F.col("d")).alias("value"))


def las_to_dtm(points: DataFrame, spec: GridSpec, max_slope: float = 1.0) -> DataFrame:
    """Ground surface of points (x, y, z): lowest point of each cell, off-ground cells by slope, holes by IDW."""
    from talweg.operators.focal import raster_filter
    from talweg.operators.interp import fill_nodata

    low = points.select(spec.row("y").alias("row"), spec.col("x").alias("col"), "z").where(F.col("row").between(0, spec.n_rows - 1) & F.col("col").between(0, spec.n_cols - 1)).groupBy("row", "col").agg(F.min("z").alias("value"))
    low = cut(low)
    around = [[(r, c) != (1, 1) for c in range(3)] for r in range(3)]
    mid = raster_filter(low, around, "median").withColumnRenamed("value", "mid")
    ground = low.join(mid, ["row", "col"]).select("row", "col", F.when(F.col("mid").isNull() | (F.col("value") - F.col("mid") <= max_slope * spec.avg_cs), F.col("value")).alias("value"))
    grid = spec.cells(points.sparkSession).where("band = 1").select("row", "col").join(ground, ["row", "col"], "left")
    return fill_nodata(cut(grid), "rst", spec.csx, spec.csy)


