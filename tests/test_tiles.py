"""Operators on grids that span several small tiles, against brute force."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from talweg.functions import algebra as A
from talweg.operators import cost, focal, hydro, interp, terrain
from talweg.plans.graph import numbered, percentiles
from talweg.plans.grid import D8, GridSpec, disk_kernel, kernel_offsets

EIGHT = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r, c) != (0, 0)]


def frame(spark, a):
    cells = [(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(a)]
    return spark.createDataFrame(cells, "row int, col int, value double").repartition(3)


def array(df, shape, value="value"):
    out = np.full(shape, np.nan)
    for x in df.collect():
        if x[value] is not None:
            out[x["row"], x["col"]] = x[value]
    return out


@pytest.fixture(scope="module")
def surface():
    rng = np.random.default_rng(1)
    a = np.floor(rng.random((13, 17)) * 9)
    a[rng.random(a.shape) < 0.1] = np.nan
    return a


def test_windows_on_tiles(spark, surface):
    kernel = [[True, True, False], [True, False, True], [False, True, True], [True, True, True]]
    offsets = kernel_offsets(kernel)
    own = {
        "sum": np.sum, "min": np.min, "max": np.max, "mean": np.mean, "median": np.median, "std": np.std, "variance": np.var,
        "diff": np.ptp, "count": len, "percentile": lambda v: np.percentile(v, 30), "quantile": lambda v: np.quantile(v, 0.8),
        "mode": lambda v: max(dict.fromkeys(v), key=lambda x: (v.count(x), -v.index(x))),
    }
    df = frame(spark, surface).cache()
    for method, f in own.items():
        want = np.full(surface.shape, np.nan)
        for (r, c), v in np.ndenumerate(surface):
            seen = [surface[r + a, c + b] for a, b in offsets if 0 <= r + a < 13 and 0 <= c + b < 17 and not np.isnan(surface[r + a, c + b])]
            if not np.isnan(v) and seen:
                want[r, c] = f(seen)
        got = array(focal.raster_filter(df, kernel, method, {"percentile": 30.0, "quantile": 0.8}.get(method), tile=5), surface.shape)
        assert np.allclose(got, want, equal_nan=True), method
    ranged = focal.custom_raster_filter(df, (3, 3), lambda w: np.nanmax(w, axis=(1, 2)) - np.nanmin(w, axis=(1, 2)), tile=5, batched=True)
    assert np.allclose(array(ranged, surface.shape), array(focal.raster_filter(df, (3, 3), "diff", tile=5), surface.shape), equal_nan=True)
    plain = spark.range(100).select((F.col("id") % 10).cast("int").alias("row"), F.floor(F.col("id") / 10).cast("int").alias("col"), F.col("id").cast("double").alias("value"))
    plan = focal.raster_filter(plain, disk_kernel(300, 10, 10), "median")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # whatever the size of the kernel


def test_fill_and_flats(spark, surface):
    z = np.nan_to_num(surface, nan=5.0)
    level = np.full(z.shape, np.inf)
    heap = [(z[r, c], r, c) for r, c in np.ndindex(z.shape) if r in (0, 12) or c in (0, 16)]
    for h, r, c in heap:
        level[r, c] = h
    heapq.heapify(heap)
    while heap:
        h, r, c = heapq.heappop(heap)
        for a, b in EIGHT:
            i, j = r + a, c + b
            if 0 <= i < 13 and 0 <= j < 17 and max(h, z[i, j]) < level[i, j]:
                level[i, j] = max(h, z[i, j])
                heapq.heappush(heap, (level[i, j], i, j))
    filled = hydro.fill_depressions(frame(spark, z), tile=5)
    assert np.array_equal(array(filled, z.shape), level) and (level > z).any()
    # Every cell of the filled surface reaches the edge, and counts are kept.
    direction = hydro.flow_direction(frame(spark, level), flats=True, tile=5).cache()
    code = array(direction, z.shape).astype(int)
    assert all(code[r, c] > 0 or r in (0, 12) or c in (0, 16) for r, c in np.ndindex(z.shape))
    count, low = np.zeros(z.shape), np.full(z.shape, np.inf)
    root = {}
    for start in np.ndindex(z.shape):
        at, steps = start, 0
        while True:
            count[at] += 1
            low[at] = min(low[at], z[start])
            r, c = D8.get(code[at], (0, 0))
            to = (at[0] + r, at[1] + c)
            if (r, c) == (0, 0) or not (0 <= to[0] < 13 and 0 <= to[1] < 17):
                break
            at, steps = to, steps + 1
            assert steps < 300
        root[start] = (at, steps)
    values = frame(spark, z).select("row", "col", F.col("value").alias("lo"), F.lit(1.0).alias("n"))
    got = hydro.drain(direction, values, {"lo": "min", "n": "sum"}, tile=5).cache()
    assert np.array_equal(array(got, z.shape, "n"), count) and np.array_equal(array(got, z.shape, "lo"), low)
    assert {(x["row"], x["col"]): ((x["root"] // hydro.WIDTH, x["root"] % hydro.WIDTH), x["steps"]) for x in got.collect()} == root
    total = array(hydro.multiple_flow(frame(spark, level), tile=5), z.shape)
    assert np.allclose(total, array(hydro.multiple_flow(frame(spark, level), tile=40), z.shape)) and total.min() == 1


def test_circle_across_tiles(spark):
    ring = np.array([[8, 8, 6], [2, 0, 6], [2, 4, 4]], float)
    with pytest.raises(RuntimeError):
        hydro.drain(frame(spark, ring), tile=2).count()


def test_cost_against_dijkstra(spark, surface):
    f = surface + 1
    starts = np.full(f.shape, np.nan)
    starts[2, 2] = starts[11, 15] = 1
    f[2, 2] = f[11, 15] = 1
    moves = EIGHT + cost.KNIGHT
    best = np.full(f.shape, np.nan)
    heap = [(0.0, 2, 2), (0.0, 11, 15)]
    while heap:
        d, r, c = heapq.heappop(heap)
        if not np.isnan(best[r, c]):
            continue
        best[r, c] = d
        for a, b in moves:
            i, j = r + a, c + b
            if 0 <= i < 13 and 0 <= j < 17 and not np.isnan(f[i, j]) and np.isnan(best[i, j]):
                heapq.heappush(heap, (d + math.hypot(a, b) * (f[r, c] + f[i, j]) / 2, i, j))
    got = array(cost.cost_distance(frame(spark, f), frame(spark, starts), True, tile=5), f.shape)
    assert np.allclose(got, best, equal_nan=True)
    near = array(cost.distance_transform(frame(spark, starts), 2.0, 1.0), f.shape)
    want = [[min(math.hypot(r - i, 2 * (c - j)) for i, j in ((2, 2), (11, 15))) for c in range(17)] for r in range(13)]
    assert np.allclose(near, want)


def test_rings_and_floods_do_not_depend_on_tiles(spark, surface):
    few = np.where(np.arange(13 * 17).reshape(13, 17) % 31 == 0, surface, np.nan)
    want, known = few.copy(), ~np.isnan(few)
    while not known.all():
        new = {}
        for r, c in zip(*np.nonzero(~known)):
            seen = [(want[r + a, c + b], 1 / math.hypot(a, b)) for a, b in EIGHT if 0 <= r + a < 13 and 0 <= c + b < 17 and known[r + a, c + b]]
            if seen:
                new[r, c] = sum(v * w for v, w in seen) / sum(w for _, w in seen)
        for at, v in new.items():
            want[at], known[at] = v, True
    assert np.allclose(array(cost.expand_interpolate(frame(spark, few), tile=5), few.shape), want)
    spec = GridSpec(0, 130, 10, 10, 13, 17)
    stream = np.full(few.shape, np.nan)
    stream[:, 8] = 1
    z = np.abs(np.arange(17) - 8.0)[None, :] + np.zeros((13, 1))
    w = frame(spark, stream * 45)
    got = [array(cost.bankfull_extent(w, frame(spark, stream * 3), frame(spark, z), spec, rings=k, tile=t), z.shape) for k, t in ((3, 5), (16, 64))]
    assert np.array_equal(got[0], got[1], equal_nan=True) and 13 * 5 <= np.nansum(got[0]) <= 13 * 7


def test_front_contains():
    assert A.front_contains(0, 0, 0, 2, 0, 3) is False and A.front_contains(0, 0, 0, 2, 0, -1) is True
    assert A.front_contains(0, 0, 3, 0, 3, 9) is True and A.front_contains(0, 0, 3, 0, 4, 0) is False and A.front_contains(3, 0, 0, 0, -1, 5) is False
    assert A.front_contains(0, 0, 2, 2, 1, 3) is True and A.front_contains(0, 0, 2, 2, 3, 2) is False and A.front_contains(2, 2, 0, 0, 0, -1) is False
    assert A.front_contains(1, 1, 1, 1, 7, -7) is True


def test_ranks(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "k int").repartition(5)
    assert all(r["value"] == r["k"] + 1 for r in numbered(df, "k").collect())
    v = [1.0, 2.0, 2.0, 2.0, 9.0, 4.0, None]
    got = percentiles(spark.createDataFrame([(x,) for x in v], "v double").repartition(3), "v", [0.0, 0.25, 0.333, 0.9, 1.0])
    assert np.allclose(got, np.quantile([x for x in v if x is not None], [0.0, 0.25, 0.333, 0.9, 1.0]))
    assert percentiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]


def test_neighbours_and_surfaces(spark):
    rng = np.random.default_rng(2)
    xy = np.concatenate([rng.random((300, 2)) * 10, rng.random((40, 2)) + 500])
    z = xy[:, 0] * 2 - xy[:, 1]
    obs = spark.createDataFrame([(i, float(x), float(y), float(v)) for i, ((x, y), v) in enumerate(zip(xy, z))], "oid long, ox double, oy double, z double")
    p = np.concatenate([rng.random((40, 2)) * 10, [[-900.0, 3.0], [250.0, 250.0], [xy[7, 0], xy[7, 1]]]])
    pred = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "pid long, px double, py double")
    d2 = ((p[:, None] - xy[None]) ** 2).sum(axis=2)
    order = np.argsort(d2, axis=1, kind="stable")[:, :4]
    got = {(r["pid"], r["rank"]): r["oid"] for r in interp.nearest(pred, obs, 4).collect()}
    assert all(got[i, k + 1] == order[i, k] for i in range(len(p)) for k in range(4))
    w = 1 / np.maximum(d2, 1e-300)
    want = np.where((d2 == 0).any(axis=1), z[d2.argmin(axis=1)], (w * z).sum(axis=1) / w.sum(axis=1))
    full = {r["pid"]: r["value"] for r in interp.full_idw(pred, obs).collect()}
    assert all(math.isclose(full[i], v, rel_tol=1e-9) for i, v in enumerate(want))
    plane = 2 * p[:, 0] - p[:, 1]
    for f in (lambda: interp.linear(pred, obs, -1.0), lambda: interp.thin_plate(pred, obs)):
        flat = {r["pid"]: r["value"] for r in f().collect()}
        assert all(math.isclose(flat[i], plane[i], abs_tol=1e-6) for i in range(40) if 1 < p[i].min() and p[i].max() < 9)


def test_sun(spark):
    spec = GridSpec(500000, 4500000, 10, 10, 9, 9, "EPSG:32633")
    assert terrain.latitudes(spec, np.array([0.0]))[0] == pytest.approx(40.65, abs=0.02)
    r, c = np.indices((9, 9)).astype(float)
    level, south, north = (array(terrain.solar_radiation(frame(spark, z), 80, spec=spec), (9, 9))[4, 4] for z in (0 * r, -4 * r, 4 * r))
    assert south > level > north > 0
    hours = np.radians(15 * (np.arange(48) * 0.5 - 12))
    phi, tilt = np.radians(terrain.latitudes(spec, np.array([4.0]))[0]), terrain.declination(80)
    high = np.sin(phi) * np.sin(tilt) + np.cos(phi) * np.cos(tilt) * np.cos(hours)
    near = 1367 * (1 + 0.033 * math.cos(2 * math.pi * 80 / 365))
    assert level == pytest.approx((near * 0.7 ** (1 / np.maximum(high, 0.05)) * np.maximum(high, 0) * 0.5).sum())
    wall = np.where(r > 6, 500.0, 0.0)
    lit, dark = (array(terrain.solar_radiation(frame(spark, wall), 80, spec=spec, terrain=False, shading=k), (9, 9))[4, 4] for k in (0, 5))
    assert dark < lit == pytest.approx(level)
    with pytest.raises(ValueError):
        terrain.solar_radiation(frame(spark, wall), 366, spec=spec)
