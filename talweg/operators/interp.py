"""Interpolation from observed points (oid, ox, oy, z) to points (pid, px, py).

Neighbours are searched in buckets: a prediction looks at the observations of
its own bucket and the eight around it, and is done if its k-th neighbour is
nearer than anything outside them can be.  The few that are not done ask again
in buckets four times as wide.  A task works on one bucket with numpy and
passes on what it made of the neighbours, not the pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from talweg.plans.graph import cut

#: Predictions of a bucket that one task takes, about.
SMALL = 20_000
#: Pairs held at a time.
HELD = 4_000_000
#: Pairs that a processor's cache holds.
CACHED = 32_768
Fold = Callable[[pa.Table, pa.Table, np.ndarray, np.ndarray], pa.Table]


def _closest(x: np.ndarray, y: np.ndarray, ox: np.ndarray, oy: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest observations of each point (the first of equal ones first) and their squared distances."""
    d2 = (x[:, None] - ox[None, :]) ** 2 + (y[:, None] - oy[None, :]) ** 2
    if d2.shape[1] > 4 * k:
        kth = np.partition(d2, k - 1, axis=1)[:, k - 1 : k]
        width = int((d2 <= kth).sum(axis=1).max())
        some = np.sort(np.argpartition(d2, width - 1, axis=1)[:, :width], axis=1)
        near = np.take_along_axis(d2, some, axis=1)
        order = np.argsort(near, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(some, order, axis=1), np.take_along_axis(near, order, axis=1)
    order = np.argsort(d2, axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(d2, order, axis=1)


def with_neighbours(pred: DataFrame, obs: DataFrame, k: int, fold: Fold, out: list[StructField]) -> DataFrame:
    """``fold`` of every prediction and its k nearest observations, ties to the smaller oid.

    ``fold`` gets the predictions of a task, its observations, and for each
    prediction the rows of its neighbours, the nearest first, with their squared
    distances; it returns rows whose first columns are those of ``pred``.
    """
    if k < 1:
        raise ValueError("k must be positive")
    n, x0, x1, y0, y1 = obs.agg(F.count(F.lit(1)), F.min("ox"), F.max("ox"), F.min("oy"), F.max("oy")).first()
    if not n:
        raise ValueError("no observations")
    k = min(k, n)
    extent = max(x1 - x0, y1 - y0)
    # About 2k observations a bucket, spread over the plane or along a line.
    side = max(math.sqrt(max((x1 - x0) * (y1 - y0), 0.0) * 2 * k / n), extent * 2 * k / n, 1e-9)
    obs = cut(obs.select("oid", "ox", "oy", "z"))
    columns = pred.columns
    schema = StructType([*pred.schema.fields, *out, StructField("_sure", BooleanType())])
    types = {f.name: to_arrow_type(f.dataType) for f in schema.fields}

    def searcher(edge: float, mine: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def search(left: pa.Table, right: pa.Table) -> pa.Table:
            own = right.take(pc.sort_indices(right.column("oid"))) if len(right) else right
            ox, oy = (own.column(c).to_numpy() for c in ("ox", "oy"))
            parts = []
            size = max(1, HELD // max(1, len(own)))
            for i in range(0, len(left), size):
                t = left.slice(i, size)
                x, y = (t.column(c).to_numpy().astype(float) for c in ("px", "py"))
                sure = np.full(len(t), mine)
                if len(own) >= k:
                    rows, d2 = _closest(x, y, ox, oy, k)
                    if not mine:
                        bx, by = t.column("_bx").to_numpy(), t.column("_by").to_numpy()
                        gap = np.min([x - (x0 + (bx - 1) * edge), x0 + (bx + 2) * edge - x, y - (y0 + (by - 1) * edge), y0 + (by + 2) * edge - y], axis=0)
                        sure = (gap > 0) & (d2[:, -1] < np.maximum(gap, 0) ** 2)
                    good = fold(t.filter(pa.array(sure)).select(columns), own, rows[sure], d2[sure])
                    parts.append(good.append_column("_sure", pa.array(np.ones(len(good), bool))))
                else:
                    sure = np.zeros(len(t), bool)
                rest = t.filter(pa.array(~sure)).select(columns)
                for f in schema.fields[len(columns) :]:
                    rest = rest.append_column(f.name, pa.array(np.zeros(len(rest), bool)) if f.name == "_sure" else pa.nulls(len(rest), types[f.name]))
                parts.append(rest)
            return pa.concat_tables([p.cast(parts[-1].schema) for p in parts]) if parts else pa.table({f.name: pa.array([], types[f.name]) for f in schema.fields})

        return search

    bucket = lambda v, lo: F.floor((F.col(v) - lo) / side).cast("long")
    open_, done = pred, None
    while True:
        whole = side >= extent  # then nine buckets hold everything in reach of the middle one
        inside = lambda v, lo, hi: F.least(F.greatest(bucket(v, lo), F.lit(0)), F.lit(int((hi - lo) // side)))
        asked = open_.withColumn("_bx", inside("px", x0, x1)).withColumn("_by", inside("py", y0, y1))
        around = lambda v, lo: F.explode(F.sequence(bucket(v, lo) - 1, bucket(v, lo) + 1))
        near = obs.withColumn("_bx", around("ox", x0)).withColumn("_by", around("oy", y0))
        if done is not None:
            near = near.join(asked.select("_bx", "_by").distinct(), ["_bx", "_by"], "left_semi")
        # Many predictions in a bucket are dealt over several tasks.
        salts = max(1, math.ceil(pred.count() * 2 * k / n / SMALL)) if done is None else 1
        asked = asked.withColumn("_s", F.pmod(F.xxhash64("px", "py"), F.lit(salts)).cast("int"))
        near = near.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        keys = ("_bx", "_by", "_s")
        found = cut(asked.groupBy(*keys).cogroup(near.groupBy(*keys)).applyInArrow(searcher(side, whole), schema))
        good = found.where("_sure").drop("_sure")
        done = good if done is None else done.unionByName(good)
        open_ = found.where("not _sure").select(*columns)
        if whole or open_.isEmpty():
            return done
        side *= 4


def _doubles(*names: str) -> list[StructField]:
    return [StructField(n, DoubleType()) for n in names]


def nearest(pred: DataFrame, obs: DataFrame, k: int) -> DataFrame:
    """(pid, px, py, oid, ox, oy, z, d2, rank): the k nearest observations, ties to the smaller oid."""
    def rows(t: pa.Table, own: pa.Table, near: np.ndarray, d2: np.ndarray) -> pa.Table:
        m = near.shape[1]
        out = t.take(pa.array(np.repeat(np.arange(len(t)), m)))
        for c in ("oid", "ox", "oy", "z"):
            out = out.append_column(c, own.column(c).take(pa.array(near.ravel())))
        return out.append_column("d2", pa.array(d2.ravel())).append_column("rank", pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(t))))

    kinds = {f.name: f for f in obs.schema.fields}
    out = [StructField(c, kinds[c].dataType) for c in ("oid", "ox", "oy", "z")]
    return with_neighbours(pred.select("pid", "px", "py"), obs, k, rows, [*out, *_doubles("d2"), StructField("rank", IntegerType())])


def _values(pred: DataFrame, obs: DataFrame, k: int, f: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(pid, value): ``f`` of the neighbours' offsets (dx, dy), values and squared distances, one row a prediction."""

    def fold(t: pa.Table, own: pa.Table, near: np.ndarray, d2: np.ndarray) -> pa.Table:
        x, y = (t.column(c).to_numpy().astype(float) for c in ("px", "py"))
        ox, oy, z = (own.column(c).to_numpy().astype(float)[near] for c in ("ox", "oy", "z"))
        with np.errstate(all="ignore"):
            value = f(ox - x[:, None], oy - y[:, None], z, d2) if len(t) else np.empty(0)
        return t.append_column("value", pa.array(value, pa.float64(), mask=np.isnan(value)))

    return with_neighbours(pred.select("pid", "px", "py"), obs, k, fold, _doubles("value")).select("pid", "value")


def _inverse(dx: np.ndarray, dy: np.ndarray, z: np.ndarray, d2: np.ndarray) -> np.ndarray:
    w = 1 / d2
    return np.where(d2[:, 0] == 0, z[:, 0], (z * w).sum(axis=1) / w.sum(axis=1))


def _thin_plate(dx: np.ndarray, dy: np.ndarray, z: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """Value at the origin of the thin-plate spline through the neighbours; IDW where they lie on a line or are too few."""
    n, k = z.shape
    size = np.sqrt(d2[:, -1:]) + 1e-12
    x, y = dx / size, dy / size
    r2 = (x[:, :, None] - x[:, None, :]) ** 2 + (y[:, :, None] - y[:, None, :]) ** 2
    m = np.zeros((n, k + 3, k + 3))
    m[:, :k, :k] = np.where(r2 > 0, r2 * np.log(r2 + (r2 == 0)), 0)
    m[:, :k, k:] = np.stack([np.ones((n, k)), x, y], axis=2)
    m[:, k:, :k] = m[:, :k, k:].transpose(0, 2, 1)
    right = np.concatenate([z, np.zeros((n, 3))], axis=1)
    plain = np.array([np.linalg.matrix_rank(p) == 3 for p in m[:, :k, k:]])
    out = _inverse(dx, dy, z, d2)
    if plain.any():
        own = np.linalg.solve(m[plain], right[plain][:, :, None])[:, :, 0]
        r2 = x[plain] ** 2 + y[plain] ** 2
        out[plain] = (own[:, :k] * np.where(r2 > 0, r2 * np.log(r2 + (r2 == 0)), 0)).sum(axis=1) + own[:, k]
    return np.where(d2[:, 0] == 0, z[:, 0], out)


def thin_plate(pred: DataFrame, obs: DataFrame, k: int = 16) -> DataFrame:
    """(pid, value): local thin-plate splines through the k nearest observations, which keep their values."""
    return _values(pred, obs, k, _thin_plate)


def _triangle(dx: np.ndarray, dy: np.ndarray, z: np.ndarray, reach: float) -> float | None:
    """Linear interpolation at the origin in the triangle around it whose circumcircle holds no other neighbour; None if there is none.

    NaN means that the circle leaves what the neighbours cover (``reach``).
    """
    order = min(len(dx), 14)
    t = np.array(list(itertools.combinations(range(order), 3)))
    if not len(t):
        return None
    ax, bx, cx = dx[t].T
    ay, by, cy = dy[t].T
    area = (bx - ax) * (cy - ay) - (cx - ax) * (by - ay)
    with np.errstate(all="ignore"):
        u, v, w = (bx * cy - cx * by) / area, (cx * ay - ax * cy) / area, (ax * by - bx * ay) / area
        d = 2 * area
        a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        ux = (a2 * (by - cy) + b2 * (cy - ay) + c2 * (ay - by)) / d
        uy = (a2 * (cx - bx) + b2 * (ax - cx) + c2 * (bx - ax)) / d
        r2 = (ax - ux) ** 2 + (ay - uy) ** 2
        ok = (area != 0) & (u >= -1e-12) & (v >= -1e-12) & (w >= -1e-12)
    for i in np.flatnonzero(ok)[np.argsort(r2[ok], kind="stable")]:
        apart = (dx - ux[i]) ** 2 + (dy - uy[i]) ** 2
        if (apart < r2[i] * (1 - 1e-9)).any():
            continue
        if math.hypot(ux[i], uy[i]) + math.sqrt(r2[i]) > reach:
            return math.nan
        return float(u[i] * z[t[i, 0]] + v[i] * z[t[i, 1]] + w[i] * z[t[i, 2]])
    return None


def linear(pred: DataFrame, obs: DataFrame, fill: float | None = None, k: int = 32) -> DataFrame:
    """(pid, value): linear interpolation over the Delaunay triangles of the observations, ``fill`` outside their hull.

    The triangle around a point is sought among its nearest observations; a
    circle is known to be empty if it lies within the distance of the k-th.  A
    point for which none is found among the k nearest counts as outside.
    """
    n = obs.count()

    def run(dx: np.ndarray, dy: np.ndarray, z: np.ndarray, d2: np.ndarray) -> np.ndarray:
        out = np.full(len(z), np.nan)
        for i in range(len(z)):
            got = float(z[i, 0]) if d2[i, 0] == 0 else _triangle(dx[i], dy[i], z[i], math.inf if k >= n else math.sqrt(d2[i, -1]))
            out[i] = np.nan if got is None else got
        return out

    got = _values(pred, obs, k, run)
    return got if fill is None else got.select("pid", F.coalesce("value", F.lit(float(fill))).alias("value"))


def idw(pred: DataFrame, obs: DataFrame, k: int = 3) -> DataFrame:
    """(pid, value): inverse squared distances of the k nearest; an observation at the very point gives its value."""
    return _values(pred, obs, k, _inverse)


def full_idw(pred: DataFrame, obs: DataFrame) -> DataFrame:
    """(pid, value): inverse squared distances of all observations.

    Points at one place share a value, and observations at one place a weight, so
    places meet, each once: every block of observed ones with every block of
    others, by definition; a task passes on sums, not pairs.  Of observations at
    the very point that with the smallest oid gives its value.
    """
    of, to = ([F.col(c).cast("double").alias(c) for c in names] for names in (("ox", "oy"), ("px", "py")))
    o = obs.select("oid", *of, F.col("z").cast("double").alias("z")).where("ox is not null and oy is not null")
    o = cut(o.groupBy("ox", "oy").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("z").alias("zs"), F.min(F.struct("oid", "z")).alias("first")))
    pred = pred.select("pid", *to)
    p = cut(pred.where("px is not null and py is not null").select("px", "py").distinct())
    blocks, groups = max(1, math.ceil(o.count() / 8192)), max(1, math.ceil(p.count() / 8192))
    o = o.select("ox", "oy", "n", "zs", "first.oid", "first.z", F.pmod(F.xxhash64("ox", "oy"), F.lit(blocks)).cast("int").alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_g"))
    p = p.select("px", "py", F.pmod(F.xxhash64("px", "py"), F.lit(groups)).cast("int").alias("_g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"))
    schema = StructType([*_doubles("px", "py", "zw", "w"), StructField("oid", obs.schema["oid"].dataType), *_doubles("z")])

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        ox, oy, n = (right.column(c).to_numpy() for c in ("ox", "oy", "n"))
        x, y = (left.column(c).to_numpy() for c in ("px", "py"))
        weights = np.stack([pc.fill_null(right.column("zs"), 0.0).to_numpy(), n], axis=1)
        got, hit = np.zeros((len(left), 2)), np.full(len(left), -1)
        step = max(1, CACHED // max(1, len(right)))
        with np.errstate(all="ignore"):
            for i in range(0, len(left), step) if len(right) else ():
                d2, dy = x[i : i + step, None] - ox, y[i : i + step, None] - oy
                np.multiply(d2, d2, out=d2)
                np.add(d2, np.multiply(dy, dy, out=dy), out=d2)
                if not d2.min() > 0:
                    same = d2 == 0
                    hit[i : i + step] = np.where(same.any(axis=1), same.argmax(axis=1), -1)
                    d2[same] = np.inf
                got[i : i + step] = np.divide(1.0, d2, out=d2) @ weights
        at = pa.array(hit, mask=hit < 0)
        known = right.column("zs").null_count < len(right)
        return pa.table({"px": x, "py": y, "zw": pa.array(got[:, 0], mask=np.full(len(left), not known)), "w": got[:, 1], "oid": right.column("oid").take(at), "z": right.column("z").take(at)})

    keys, parts = ("_g", "_b"), min(10_000, math.ceil(groups * blocks / 4))
    got = p.repartition(parts, *keys).groupBy(*keys).cogroup(o.repartition(parts, *keys).groupBy(*keys)).applyInArrow(sums, schema)
    total = lambda df, key, hit: df.groupBy(*key).agg(F.sum("zw").alias("zw"), F.sum("w").alias("w"), F.min(hit).alias("hit"))
    places = total(got, ("px", "py"), F.when(F.col("oid").isNotNull(), F.struct("oid", "z")))
    out = total(pred.join(places, ["px", "py"], "left"), ("pid",), F.col("hit"))
    return out.select("pid", F.coalesce("hit.z", F.try_divide("zw", "w")).alias("value"))


def knn_mean(pred: DataFrame, obs: DataFrame, k: int = 3) -> DataFrame:
    return _values(pred, obs, k, lambda dx, dy, z, d2: z.mean(axis=1))


def bounding_idw(pred: DataFrame, obs: DataFrame, k: int = 4) -> DataFrame:
    """(pid, value): predict only points inside the box of their neighbours, add them to the observations, repeat; the rest by the neighbours' mean."""
    known = cut(obs.select(F.col("oid").cast("string").alias("oid"), "ox", "oy", "z"))
    left, out, still = cut(pred), None, 0
    while still < 3 and not left.isEmpty():
        near = nearest(left, known, k)
        box = near.groupBy("pid").agg(*[f(c).alias(f"{n}_{c}") for c in ("ox", "oy") for n, f in (("lo", F.min), ("hi", F.max))])
        inside = left.join(box, "pid").where("px between lo_ox and hi_ox and py between lo_oy and hi_oy").select("pid", "px", "py")
        got = cut(idw(inside, known, k).join(inside, "pid"))
        if got.isEmpty():
            still += 1
            break  # nothing changes any more
        out = got.select("pid", "value") if out is None else out.unionByName(got.select("pid", "value"))
        known = cut(known.unionByName(got.select(F.concat(F.lit("p"), F.col("pid").cast("string")).alias("oid"), F.col("px").alias("ox"), F.col("py").alias("oy"), F.col("value").alias("z"))))
        left = cut(left.join(got.select("pid"), "pid", "left_anti"))
    rest = knn_mean(left, known, k) if not left.isEmpty() else left.select("pid", F.lit(None).cast("double").alias("value")).limit(0)
    return rest if out is None else out.unionByName(rest)


class PointInterpolator:
    """Observations and prediction points, with all methods."""

    def __init__(self, obs: DataFrame, pred: DataFrame):
        if obs.isEmpty():
            raise ValueError("no observations")
        self.obs, self.pred = obs, pred

    def idw(self, n_neighbours: int = 3) -> DataFrame:
        return idw(self.pred, self.obs, n_neighbours)

    def full_idw(self) -> DataFrame:
        return full_idw(self.pred, self.obs)

    def mean(self, n_neighbours: int = 3) -> DataFrame:
        return knn_mean(self.pred, self.obs, n_neighbours)

    def bounding_idw(self, n_neighbours: int = 4) -> DataFrame:
        return bounding_idw(self.pred, self.obs, n_neighbours)

    def linear(self, fill: float | None = None) -> DataFrame:
        return linear(self.pred, self.obs, fill)

    def chunks(self, size: int = 500) -> DataFrame:
        """The prediction points with the number of their ``chunk``: about ``size`` points, near each other in no particular way."""
        n = max(1, math.ceil(self.pred.count() / size))
        return self.pred.withColumn("chunk", F.pmod(F.xxhash64("pid", "px", "py"), F.lit(n)))

    def map_chunks(self, func: Callable, schema: str, size: int = 500) -> DataFrame:
        """``func`` maps Arrow tables of about ``size`` prediction points."""
        return self.chunks(size).groupBy("chunk").applyInArrow(lambda t: func(t.drop_columns(["chunk"])), schema)


def interpolate_into_region(source: DataFrame, region: DataFrame, csx: float, csy: float, radius: float = 200.0) -> DataFrame:
    """(row, col, value) over the region: known values, else IDW of round(radius / mean cell size) neighbours."""
    k = max(1, round(radius / ((csx + csy) / 2)))
    have = source.where("value is not null")
    obs = have.select((F.col("row").cast("long") * (1 << 31) + F.col("col")).alias("oid"), (F.col("col") * csx).alias("ox"), (F.col("row") * csy).alias("oy"), F.col("value").cast("double").alias("z"))
    want = region.where("value is not null").select("row", "col").join(have.select("row", "col"), ["row", "col"], "left_anti")
    pred = want.select(F.struct("row", "col").alias("pid"), (F.col("col") * csx).alias("px"), (F.col("row") * csy).alias("py"))
    known = have.join(region.where("value is not null").select("row", "col"), ["row", "col"], "left_semi").select("row", "col", F.col("value").cast("double").alias("value"))
    return known.unionByName(idw(pred, obs, k).select("pid.row", "pid.col", "value"))


def rim_of_holes(cells: DataFrame) -> DataFrame:
    """(row, col, value): valid cells beside an invalid or absent one."""
    from talweg.operators.focal import erosion_edges

    rim = erosion_edges(cells.select("row", "col", "value")).where("edge").select("row", "col")
    return cells.join(rim, ["row", "col"], "left_semi").select("row", "col", F.col("value").cast("double").alias("value"))


def fill_nodata(cells: DataFrame, method: str = "rst", csx: float = 1.0, csy: float = 1.0) -> DataFrame:
    """Fill holes from the valid cells around them; known cells keep their values.

    ``rst``: local thin-plate splines; ``bilinear`` and ``bicubic``: the spline
    surfaces of :func:`spline_surface` over the holes' rims.
    """
    if method not in ("rst", "bilinear", "bicubic"):
        raise ValueError(f"unknown method {method!r}")
    known = cells.where("value is not null").select("row", "col", F.col("value").cast("double").alias("value"))
    holes = cells.where("value is null").select("row", "col")
    if holes.isEmpty() or known.isEmpty():
        return cells.select("row", "col", F.col("value").cast("double").alias("value"))
    rim = cut(rim_of_holes(cells))
    if method == "rst":
        obs = rim.select((F.col("row").cast("long") * (1 << 31) + F.col("col")).alias("oid"), (F.col("col") * csx).alias("ox"), (F.col("row") * csy).alias("oy"), F.col("value").alias("z"))
        pred = holes.select(F.struct("row", "col").alias("pid"), (F.col("col") * csx).alias("px"), (F.col("row") * csy).alias("py"))
        return known.unionByName(thin_plate(pred, obs).select("pid.row", "pid.col", "value"))
    points = rim.select(F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), F.col("value").alias("z"))
    return known.unionByName(spline_surface(points, holes, method))


def fit_morphology(points: DataFrame, observed: str, include: str | None = None, start: tuple[float, float, float] = (0.04, 0.5, 0.7), rounds: int = 400, tolerance: float = 1e-6) -> tuple[float, float, float]:
    """Nelder-Mead fit of c * ca**a * (precip / 10)**p to ``observed``: each round sums the squared errors of all points and candidates in one job.

    With ``include`` only the points count that have 1 in that column.  Without
    convergence after ``rounds``: RuntimeError.
    """
    points = points if include is None else points.where(F.col(include) == 1)
    data = cut(points.select(F.col("ca").cast("double").alias("ca"), (F.col("precip") / 10).cast("double").alias("pr"), F.col(observed).cast("double").alias("o")))

    def sse(candidates: list[np.ndarray]) -> list[float]:
        columns = [F.sum(F.pow(F.col("o") - F.lit(float(c[0])) * F.pow("ca", F.lit(float(c[1]))) * F.pow("pr", F.lit(float(c[2]))), F.lit(2.0))).alias(f"s{i}") for i, c in enumerate(candidates)]
        return [float("inf") if v is None or v != v else v for v in data.agg(*columns).first()]

    simplex = [np.array(start)] + [np.array(start) * (1 + 0.05 * (np.arange(3) == i)) for i in range(3)]
    cost = sse(simplex)
    for _ in range(rounds):
        order = np.argsort(cost, kind="stable")
        simplex, cost = [simplex[i] for i in order], [cost[i] for i in order]
        if max(np.abs(s - simplex[0]).max() for s in simplex) < tolerance and abs(cost[-1] - cost[0]) < tolerance:
            return tuple(float(v) for v in simplex[0])
        mid = np.mean(simplex[:-1], axis=0)
        tries = [mid + f * (mid - simplex[-1]) for f in (1, 2, 0.5, -0.5)]
        r, e, o, i = sse(tries)
        if r < cost[0]:
            simplex[-1], cost[-1] = (tries[1], e) if e < r else (tries[0], r)
        elif r < cost[-2]:
            simplex[-1], cost[-1] = tries[0], r
        elif r < cost[-1] and o <= r:
            simplex[-1], cost[-1] = tries[2], o
        elif i < cost[-1]:
            simplex[-1], cost[-1] = tries[3], i
        else:
            simplex = [simplex[0]] + [simplex[0] + 0.5 * (s - simplex[0]) for s in simplex[1:]]
            cost = [cost[0], *sse(simplex[1:])]
    raise RuntimeError("the fit did not converge")


def model_metrics(points: DataFrame, observed: str, model: tuple[float, float, float], include: str | None = None) -> DataFrame:
    """(sse, mae, r2) of a fitted model on its points."""
    from talweg.functions.algebra import bankfull_width, fit_metrics

    points = points if include is None else points.where(F.col(include) == 1)
    return fit_metrics(points, F.col(observed), bankfull_width(F.col("ca").cast("double"), F.col("precip").cast("double"), *model))


def _basis(t: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """First knot and weights of the B-splines of a degree (1 or 3) at positions in knots."""
    i = np.floor(t)
    u = t - i
    if degree == 1:
        return i.astype(int), np.stack([1 - u, u], axis=-1)
    w = np.stack([(1 - u) ** 3, 3 * u**3 - 6 * u**2 + 4, -3 * u**3 + 3 * u**2 + 3 * u + 1, u**3], axis=-1) / 6
    return i.astype(int) - 1, w


def spline_surface(points: DataFrame, target: DataFrame, degree: str = "bicubic", step: float = 4.0, smooth: float = 1e-4, tile: int = 64, reach: int = 32) -> DataFrame:
    """(row, col, value): least-squares B-spline surface of scattered points (x, y, z in cell units) at the target cells.

    Knots are ``step`` cells apart; ``smooth`` weighs the squared second
    differences of the coefficients, which also carries the surface over gaps.
    Each tile is fitted with the points up to ``reach`` cells around it, one
    small system a tile; a tile without points in reach gets NULL.
    """
    if degree not in ("bilinear", "bicubic"):
        raise ValueError(f"unknown degree {degree!r}")
    d = 1 if degree == "bilinear" else 3
    span = lambda v: F.explode(F.sequence(F.floor((F.col(v) - reach) / tile), F.floor((F.col(v) + reach) / tile)))
    near = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("z").cast("double").alias("z")).where("z is not null").withColumn("tr", span("y")).withColumn("tc", span("x"))
    want = target.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).withColumn("tr", F.floor(F.col("row") / tile)).withColumn("tc", F.floor(F.col("col") / tile))

    def fit(left: pa.Table, right: pa.Table) -> pa.Table:
        value = np.full(len(left), np.nan)
        if len(left) and len(right):
            r0, c0 = left.column("tr")[0].as_py() * tile - reach, left.column("tc")[0].as_py() * tile - reach
            m = int(math.ceil((tile + 2 * reach) / step)) + 4

            def rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                (i, wy), (j, wx) = _basis((y - r0) / step + 1, d), _basis((x - c0) / step + 1, d)
                out = np.zeros((len(x), m * m))
                for a in range(d + 1):
                    for b in range(d + 1):
                        out[np.arange(len(x)), np.clip(i + a, 0, m - 1) * m + np.clip(j + b, 0, m - 1)] += wy[:, a] * wx[:, b]
                return out

            x, y, z = (right.column(c).to_numpy() for c in ("x", "y", "z"))
            normal, side = np.zeros((m * m, m * m)), np.zeros(m * m)
            middle = z.mean()
            for s in range(0, len(z), 4096):
                a = rows(x[s : s + 4096], y[s : s + 4096])
                normal += a.T @ a
                side += a.T @ (z[s : s + 4096] - middle)
            second = np.diff(np.eye(m), 2, axis=0)
            bend = second.T @ second
            normal += smooth * (np.kron(bend, np.eye(m)) + np.kron(np.eye(m), bend)) + 1e-9 * np.eye(m * m)
            own = np.linalg.solve(normal, side)
            value = rows(left.column("col").to_numpy().astype(float), left.column("row").to_numpy().astype(float)) @ own + middle
        return pa.table({"row": left.column("row"), "col": left.column("col"), "value": pa.array(value, mask=np.isnan(value))})

    return want.groupBy("tr", "tc").cogroup(near.groupBy("tr", "tc")).applyInArrow(fit, "row int, col int, value double")
