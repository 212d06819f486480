"""Reaches: connected cells of one class, their vertices, and the forest that they form."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from talweg.operators.hydro import _cells, _id, edges
from talweg.plans.graph import component_labels, cut, numbered, pointer_doubling
from talweg.plans.grid import GridSpec

REDUCERS = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "median": F.median, "std": F.stddev_pop, "var": F.var_pop}
#: Points and legs of a tile that one task takes, about; pairs held at a time.
POINTS, LEGS, HELD = 32_768, 131_072, 32_768


def flow_labels(classes: DataFrame, direction: DataFrame) -> DataFrame:
    """(row, col, value): components of cells of equal class that a flow edge links, numbered in row-major order."""
    nodes = classes.where("value is not null").select(_id().alias("id"), F.col("value").alias("class"))
    e = edges(direction).where("next is not null")
    pairs = e.join(nodes, "id").join(nodes.select(F.col("id").alias("next"), F.col("class").alias("other")), "next").where("class = other")
    labels = component_labels(nodes.select("id"), pairs.select(F.col("id").alias("a"), F.col("next").alias("b")))
    number = numbered(labels.select("label").distinct(), "label")
    return _cells(labels.join(number, "label")).select("row", "col", "value")


def reach_vertices(reaches: DataFrame, direction: DataFrame, spec: GridSpec) -> tuple[DataFrame, DataFrame]:
    """(vertices, links): (rid, seq, row, col, x, y) from the head down, with the first cell of the next reach at the end; (rid, next_rid), -1 for none."""
    nodes = cut(reaches.where("value is not null").select(_id().alias("id"), F.col("value").alias("rid")))
    e = edges(direction).join(nodes, "id").join(nodes.select(F.col("id").alias("next"), F.col("rid").alias("next_rid")), "next", "left")
    e = cut(e.select("id", "rid", F.when(F.col("next_rid").isNotNull(), F.col("next")).alias("next"), "next_rid"))
    inner = e.select("id", F.when(F.col("rid") == F.col("next_rid"), F.col("next")).alias("next"), F.lit(1).alias("n"))
    # Height above the reach's end orders the vertices.
    depth = _heights(inner.select("id", "next"))
    ends = e.where("next_rid is null or rid <> next_rid")
    links = ends.groupBy("rid").agg(F.coalesce(F.min_by("next_rid", "id"), F.lit(-1)).alias("next_rid"))
    tail = ends.where("next_rid is not null").groupBy("rid").agg(F.min_by("next", "id").alias("id")).select("rid", "id", F.lit(-1).alias("height"))
    rows = nodes.join(depth, "id").select("rid", "id", "height").unionByName(tail)
    order = Window.partitionBy("rid").orderBy(F.col("height").desc(), "id")
    out = _cells(rows.withColumn("seq", F.row_number().over(order)))
    return out.select("rid", "seq", "row", "col", spec.x("col").alias("x"), spec.y("row").alias("y")), links


def _heights(tree: DataFrame) -> DataFrame:
    """(id, height): steps down to the root, by doubling; a circle raises RuntimeError."""
    steps = F.when(F.col("next").isNotNull(), 1).otherwise(0).alias("height")
    return pointer_doubling(tree.select("id", "next", steps), {}, ("height",)).select("id", "height")


def segment_edges(direction: DataFrame, segments: DataFrame) -> DataFrame:
    """(rid, next_rid): -1 for none."""
    nodes = segments.where("value is not null").select(_id().alias("id"), F.col("value").alias("rid"))
    e = edges(direction).join(nodes, "id").join(nodes.select(F.col("id").alias("next"), F.col("rid").alias("next_rid")), "next", "left")
    out = e.where("next_rid is not null and rid <> next_rid").groupBy("rid").agg(F.min("next_rid").alias("next_rid"))
    return nodes.select("rid").distinct().join(out, "rid", "left").select("rid", F.coalesce("next_rid", F.lit(-1)).alias("next_rid"))


def strahler(links: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(rid, next_rid, strahler): 1 at heads; the greatest order above, one more if two or more have it.  A cycle raises RuntimeError."""
    base = cut(links)
    fed = base.where("next_rid <> -1").select("rid", F.col("next_rid").alias("to"))
    state = cut(base.join(fed.select(F.col("to").alias("rid")).distinct(), "rid", "left_anti").select("rid", F.lit(1).alias("strahler")))
    total, have = base.count(), state.count()
    need = cut(fed.groupBy("to").agg(F.count(F.lit(1)).alias("need")))
    for _ in range(rounds):
        if have == total:
            return base.join(state, "rid")
        got = fed.join(state, "rid").groupBy("to").agg(F.count(F.lit(1)).alias("n"), F.max("strahler").alias("m"), F.collect_list("strahler").alias("all"))
        ready = got.join(need, "to").where("n = need").select(F.col("to").alias("rid"), (F.col("m") + F.when(F.size(F.filter("all", lambda s: s == F.col("m"))) > 1, 1).otherwise(0)).alias("strahler"))
        state = cut(state.unionByName(ready.join(state.select("rid"), "rid", "left_anti")))
        now = state.count()
        if now == have:
            break
        have = now
    raise RuntimeError("reaches run in a circle")


def upstream_reaches(links: DataFrame) -> DataFrame:
    """(rid, prev_rid01, prev_rid02, ...): as many columns as the widest junction, -1 for none."""
    fed = links.where("next_rid <> -1").select(F.col("next_rid").alias("at"), "rid")
    fed = fed.withColumn("k", F.row_number().over(Window.partitionBy("at").orderBy("rid")))
    widest = fed.agg(F.max("k")).first()[0] or 1
    names = {k: f"prev_rid0{k}" for k in range(1, widest + 1)}
    wide = fed.groupBy("at").agg(*[F.max(F.when(F.col("k") == k, F.col("rid"))).alias(n) for k, n in names.items()])
    out = links.select("rid").join(wide, F.col("rid") == F.col("at"), "left")
    return out.select("rid", *[F.coalesce(n, F.lit(-1)).alias(n) for n in names.values()])


def reach_geometry(vertices: DataFrame) -> DataFrame:
    """(rid, length, straight, sinuosity, n): sinuosity is NULL for closed reaches."""
    w = Window.partitionBy("rid").orderBy("seq")
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), F.lit(2)) + F.pow(F.col("y") - F.lag("y").over(w), F.lit(2)))
    got = vertices.withColumn("step", step).groupBy("rid").agg(
        F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"), F.min_by("x", "seq").alias("x0"), F.min_by("y", "seq").alias("y0"), F.max_by("x", "seq").alias("x1"), F.max_by("y", "seq").alias("y1"), F.count(F.lit(1)).alias("n")
    )
    straight = F.sqrt(F.pow(F.col("x1") - F.col("x0"), F.lit(2)) + F.pow(F.col("y1") - F.col("y0"), F.lit(2)))
    return got.select("rid", "length", straight.alias("straight"), F.try_divide("length", straight).alias("sinuosity"), "n")


def horton(order: DataFrame, water: DataFrame) -> DataFrame:
    """(rid, next_rid, strahler): Strahler's orders (rid, next_rid, strahler) made Horton's.

    Of the reaches that meet, the one with most ``water`` (rid, water; ties to
    the smaller rid) is the main stem and takes the order of the reach below;
    the others keep their own to their main stem's end.
    """
    best = Window.partitionBy("next_rid").orderBy(F.col("water").desc(), "rid")
    ranked = order.join(water, "rid", "left").withColumn("k", F.row_number().over(best))
    stem = ranked.select(F.col("rid").alias("id"), F.when((F.col("next_rid") != -1) & (F.col("k") == 1), F.col("next_rid")).alias("next"))
    root = pointer_doubling(stem, {}).select(F.col("id").alias("rid"), "root")
    top = order.select(F.col("rid").alias("root"), F.col("strahler").alias("top"))
    return order.join(root, "rid").join(top, "root").select("rid", "next_rid", F.col("top").alias("strahler"))


def net_and_distance(links: DataFrame, lengths: DataFrame) -> DataFrame:
    """(rid, netID, upDist): outlets numbered by rid; own length plus all lengths down to the outlet.  A circle raises RuntimeError."""
    base = links.join(lengths.select("rid", "length"), "rid").select(F.col("rid").alias("id"), F.when(F.col("next_rid") != -1, F.col("next_rid")).alias("next"), F.col("length").alias("d"))
    got = cut(pointer_doubling(base, {}, ("d",)))
    nets = numbered(got.select("root").distinct(), "root", "netID")
    return got.join(nets, "root").select(F.col("id").alias("rid"), "netID", F.col("d").alias("upDist"))


def stream_topology(reaches: DataFrame, direction: DataFrame, spec: GridSpec) -> tuple[DataFrame, DataFrame]:
    """(features, vertices): rid, next_rid, prev_rid0k, strahler, netID, length, sinuosity, upDist.

    Reaches of a single vertex drop out and what flows into them ends there.
    """
    vertices, links = reach_vertices(reaches, direction, spec)
    vertices = cut(vertices)
    geometry = cut(reach_geometry(vertices).where("n > 1"))
    kept = geometry.select("rid")
    links = links.join(kept, "rid", "left_semi")
    there = kept.select(F.col("rid").alias("next_rid"), F.lit(True).alias("ok"))
    links = cut(links.join(there, "next_rid", "left").select("rid", F.when(F.col("ok"), F.col("next_rid")).otherwise(-1).alias("next_rid")))
    out = strahler(links).join(upstream_reaches(links), "rid").join(net_and_distance(links, geometry), "rid").join(geometry.select("rid", "length", "sinuosity"), "rid")
    return out, vertices.join(kept, "rid", "left_semi")


def attributes_on_reaches(vertices: DataFrame, raster: DataFrame, method: str = "mean") -> DataFrame:
    """(rid, value): a statistic of the raster along each reach."""
    if method not in REDUCERS:
        raise ValueError(f"unknown method {method!r}")
    return vertices.join(raster.where("value is not null"), ["row", "col"]).groupBy("rid").agg(REDUCERS[method]("value").alias("value"))


def reach_attributes(vertices: DataFrame, layers: DataFrame, **stats: tuple[str, str]) -> DataFrame:
    """Many statistics in one pass: name=(layer column, method) over a wide table (row, col, layers...)."""
    aggs = [REDUCERS[m](c).alias(n) for n, (c, m) in stats.items()]
    return vertices.join(layers, ["row", "col"], "left").groupBy("rid").agg(*aggs)


def _inside(left: pa.Table, right: pa.Table, radius: float) -> pa.Table:
    """(fid, station, x, y, length): length of the legs (x, y, x2, y2, n times) inside the circle around each point.

    Points are taken by cells, so that only legs near a cell are tried. Legs that
    pass through all circles of a cell have whole chords.
    """
    px, py = (left.column(c).to_numpy() for c in ("px", "py"))
    total = np.zeros(len(px))
    if len(px) and len(right):
        ax, ay, bx, by, n = (right.column(c).to_numpy().astype(float) for c in ("x", "y", "x2", "y2", "n"))
        x0, y0 = px.min(), py.min()
        far = np.hypot(bx - ax, by - ay)
        ux, uy = (bx - ax) / far, (by - ay) / far
        # Of a point (x, y, 1): the place along each leg, and the distance from its line.
        along = np.stack([ux, uy, (x0 - ax) * ux + (y0 - ay) * uy])
        aside = np.stack([-uy, ux, (y0 - ay) * ux - (x0 - ax) * uy])
        p = np.stack([px - x0, py - y0, np.ones(len(px))], axis=1)
        cells = max(1, min(8, math.isqrt(len(p) // 64)))
        edge = max(p[:, :2].max() / cells, 1e-300)
        code = np.floor(p[:, 0] / edge) * (cells + 1) + np.floor(p[:, 1] / edge)
        order = np.argsort(code, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
            lo, hi = p[mine].min(axis=0), p[mine].max(axis=0)
            wide = (hi - lo) / 2
            s, d = (lo + wide) @ along, np.abs((lo + wide) @ aside)
            reach = radius * (1 + 1e-6) + np.abs(ux) * wide[0] + np.abs(uy) * wide[1]
            near = (d < radius * (1 + 1e-6) + np.abs(uy) * wide[0] + np.abs(ux) * wide[1]) & (s > -reach) & (s < far + reach)
            whole = near & (s >= reach) & (s + reach <= far)
            for legs in (np.flatnonzero(whole), np.flatnonzero(near & ~whole)):
                if not len(legs):
                    continue
                u, v, length, times = along[:, legs], aside[:, legs], far[legs], n[legs]
                ended = not whole[legs[0]]
                step = max(1, HELD // len(legs))
                for i in range(0, len(mine), step):
                    some = mine[i : i + step]
                    h = p[some] @ v
                    np.multiply(h, h, out=h)
                    np.subtract(radius * radius, h, out=h)
                    np.sqrt(np.maximum(h, 0, out=h), out=h)
                    if ended:
                        t = p[some] @ u
                        upto = np.minimum(t + h, length)
                        np.maximum(np.subtract(t, h, out=t), 0, out=t)
                        total[some] += np.maximum(np.subtract(upto, t, out=upto), 0, out=upto) @ times
                    else:
                        total[some] += 2 * (h @ times)
    return pa.table({"fid": left.column("fid"), "station": left.column("station"), "x": px, "y": py, "length": total})


def sinuosity(lines: DataFrame, sampling: float = 100.0) -> DataFrame:
    """(fid, station, x, y, value): points every ``sampling`` along lines (fid, seq, x, y), both ends included.

    The value is the length of the line inside the circle of half the sampling
    around the point, over the sampling.  Each leg makes its own points; points
    and legs meet in tiles, by definition all that are near each other, and a
    task passes on sums, not pairs.
    """
    step, half = float(sampling), sampling / 2
    w = Window.partitionBy("fid").orderBy("seq")
    x, y, x2, y2 = (F.col(c) for c in ("x", "y", "x2", "y2"))
    legs = lines.where("fid is not null").select("fid", "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    legs = legs.withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("y").over(w)).where("x2 is not null")
    legs = legs.withColumn("len", F.sqrt(F.pow(x2 - x, F.lit(2)) + F.pow(y2 - y, F.lit(2)))).where("len > 0")
    legs = legs.withColumn("from", F.coalesce(F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    legs = cut(legs.withColumn("last", F.lead("len").over(w).isNull()))
    # A point where two legs meet belongs to the first.
    start, end = F.col("from"), F.col("from") + F.col("len")
    marks = F.transform(F.sequence(F.floor(start / step), F.floor(end / step) + 1), lambda k: k * F.lit(step))
    marks = F.filter(marks, lambda v: ((v > start) | (start == 0)) & (v <= end))
    marks = F.when(F.col("last"), F.array_union(marks, F.array(end))).otherwise(marks)
    share = (F.col("station") - start) / F.col("len")
    points = legs.select("*", F.explode(marks).alias("station")).select("fid", "station", (x + (x2 - x) * share).alias("px"), (y + (y2 - y) * share).alias("py"))
    # A leg goes to the tiles within the radius of it: in each row of tiles those beside its part there.
    tile, reach = 2 * step, half * (1 + 1e-6)
    number = lambda v: F.floor(v / tile)
    span = lambda a, b: F.explode(F.sequence(number(F.least(a, b) - reach), number(F.greatest(a, b) + reach)))
    points = points.withColumn("bx", number(F.col("px"))).withColumn("by", number(F.col("py")))
    a, b = (F.try_divide(F.col("by") * tile + v - y, y2 - y) for v in (-reach, tile + reach))
    t0, t1 = F.greatest(F.least(a, b), F.lit(0.0)), F.least(F.greatest(a, b), F.lit(1.0))
    near = legs.groupBy("fid", "x", "y", "x2", "y2").agg(F.count(F.lit(1)).alias("n")).withColumn("by", span(y, y2))
    near = near.withColumn("bx", span(x + (x2 - x) * t0, x + (x2 - x) * t1))
    # What is too much for a task is dealt in blocks, each of points with each of legs.
    key = ["fid", "bx", "by"]
    count = lambda df, name: df.groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    sizes = count(points, "p").join(count(near, "l"), key).withColumn("ps", F.ceil(F.col("p") / POINTS)).withColumn("ls", F.ceil(F.col("l") / LEGS))
    sizes = cut(sizes)
    pairs, blocks, most = sizes.agg(F.sum(F.col("p").cast("double") * F.col("l")), F.sum(F.col("ps") * F.col("ls")), F.max("ls")).first()
    large = F.broadcast(sizes.where("ps > 1 or ls > 1").select(*key, "ps", "ls"))
    ps, ls = F.coalesce("ps", F.lit(1)), F.coalesce("ls", F.lit(1))
    block = lambda of, m: F.pmod(F.xxhash64(*of), m)
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), m - 1))
    points = points.join(large, key, "left").select(*key, "station", "px", "py", block(["station"], ps).alias("pb"), every(ls).alias("lb"))
    near = near.join(large, key, "left").select(*[F.col(c).alias(c) for c in key], "x", "y", "x2", "y2", "n", block(["x", "y", "x2", "y2"], ls).alias("lb"), every(ps).alias("pb"))
    # Tasks by their work, of which few bytes make much.
    key, parts = [*key, "pb", "lb"], max(1, min(blocks or 1, math.ceil((pairs or 0) / 5e7 + (blocks or 0) / 100), 10_000))
    schema = StructType([points.schema["fid"], *(StructField(c, DoubleType()) for c in ("station", "x", "y", "length"))])
    got = points.repartition(parts, *key).groupBy(*key).cogroup(near.repartition(parts, *key).groupBy(*key)).applyInArrow(lambda p, q: _inside(p, q, half), schema)
    if (most or 1) > 1:
        got = got.groupBy("fid", "station").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.sum("length").alias("length"))
    return got.select("fid", "station", "x", "y", (F.col("length") / sampling).alias("value"))
