"""Micro-grids with answers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from talweg.functions import algebra as A
from talweg.operators import cost, focal, hydro, network, resample
from talweg.plans.grid import GridSpec, disk_kernel, infer_nodata, kernel_offsets


def grid(spark, *rows):
    cells = [(r, c, None if v is None else float(v)) for r, row in enumerate(rows) for c, v in enumerate(row)]
    return spark.createDataFrame(cells, "row int, col int, value double")


def values(df, value="value"):
    return {(x["row"], x["col"]): x[value] for x in df.orderBy("row", "col").collect()}


NINE = ([1, 2, 3], [4, 5, 6], [7, 8, 9])


def test_where_keeps_masked_cells(spark):
    g = grid(spark, [10, None, 60], [50, 49.9, None], [0, 100, 51])
    got = values(g.withColumn("value", A.where(F.col("value") < 50, F.lit(0), F.col("value"))))
    assert sum(v for v in got.values() if v is not None) == 261 and got[(0, 1)] is None and got[(1, 2)] is None


@pytest.mark.parametrize(("method", "centre", "corner"), [("sum", 45, 12), ("mean", 5, 3), ("median", 5, 3), ("min", 1, 1), ("max", 9, 5), ("diff", 8, 4), ("variance", 60 / 9, 2.5)])
def test_focal(spark, method, centre, corner):
    got = values(focal.raster_filter(grid(spark, *NINE), (3, 3), method))
    assert got[(1, 1)] == pytest.approx(centre) and got[(0, 0)] == pytest.approx(corner)


def test_focal_mask_mode_and_errors(spark):
    assert values(focal.raster_filter(grid(spark, [1, 2, 3], [4, None, 6], [7, 8, 9]), (3, 3), "sum"))[(1, 1)] is None
    assert values(focal.raster_filter(grid(spark, [2, 1], [1, 2]), (2, 2), "mode"))[(1, 1)] == 2
    with pytest.raises(ValueError):
        focal.raster_filter(grid(spark, *NINE), (3, 3), "nothing")


def test_tiles_agree_with_join(spark):
    g = grid(spark, *[[(r * 7 + c * 3) % 11 if (r + c) % 5 else None for c in range(9)] for r in range(8)])
    offsets = kernel_offsets((4, 3))
    for m in ("sum", "mean", "min", "max", "count"):
        assert values(focal.focal_tiles(g, offsets, m, 4)) == pytest.approx(values(focal.raster_filter(g, (4, 3), m)))


def test_kernels():
    assert sum(map(sum, disk_kernel(10, 10, 10))) == 5
    assert len(disk_kernel(15, 10, 10)) == 4 and {r for r, _ in kernel_offsets(disk_kernel(15, 10, 10))} == {-2, -1, 0}
    with pytest.raises(ValueError):
        kernel_offsets((1, 2, 3))
    assert infer_nodata("uint8") == 255 and infer_nodata(True) is False


def test_digitize_and_normalize(spark):
    d = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 1.99, 2.0, 88.0, 100.0)], "v double")
    assert [r[0] for r in d.select(A.digitize(F.col("v"), [2.0 * i for i in range(45)])).collect()] == [0, 1, 1, 2, 45, 45]
    n = grid(spark, [0, 5, 10, 20])
    assert list(values(A.normalize(n, (0, 10))).values()) == [0, 0.5, 1, 1]
    assert list(values(A.normalize(n, (0, 10), invert=True)).values()) == [1, 0.5, 0, 0]
    assert set(values(A.normalize(grid(spark, [3, 3]))).values()) == {None}


def test_direction_and_accumulation(spark):
    d = hydro.flow_direction(grid(spark, [9, 8, 7], [6, 5, 4], [3, 2, 1]))
    assert values(d) == {**{(r, c): 6 for r in (0, 1) for c in range(3)}, (2, 0): 8, (2, 1): 8, (2, 2): 0}
    flow = hydro.FlowAccumulation(d)
    got = values(flow.modals())
    assert [got[(r, c)] for r in range(3) for c in range(3)] == [1, 1, 1, 2, 2, 2, 3, 6, 9]
    with pytest.raises(ValueError):
        flow.calculate(grid(spark, *NINE), "median")


def test_circle_raises(spark):
    with pytest.raises(RuntimeError):
        hydro.FlowAccumulation(grid(spark, [8, 4])).modals()


def test_depression_is_filled(spark):
    got = values(hydro.fill_depressions(grid(spark, [9, 9, 9, 9], [9, 1, 5, 4], [9, 9, 9, 9])))
    assert got[(1, 1)] == 5 and got[(1, 2)] == 5 and got[(1, 3)] == 4


def test_upstream_window(spark):
    path = grid(spark, [1, 2, 3, 4])
    got = values(hydro.upstream_stats(path, path, grid(spark, [8, 8, 8, 0]), 20, 10, 10))
    assert got == {(0, 1): 1.5, (0, 2): 2, (0, 3): 3}


def test_ring_growth_and_distance(spark):
    assert list(values(cost.expand_interpolate(grid(spark, [10, None, None, 20]))).values()) == [10, 10, 20, 20]
    got = values(cost.distance_transform(grid(spark, [None, None, None], [None, None, None], [1, None, None]), 2.0, 1.0))
    assert got[(2, 0)] == 0 and got[(0, 0)] == 2 and got[(2, 2)] == 4


def test_cost_distance(spark):
    got = values(cost.cost_distance(grid(spark, [1, 1, 1], [1, 9, 1], [1, 1, 1]), grid(spark, [1, None, None], [None] * 3, [None] * 3)))
    assert got[(0, 2)] == pytest.approx(2) and got[(2, 2)] == pytest.approx(2 + 2**0.5)


def test_strahler(spark):
    links = spark.createDataFrame([(1, 3), (2, 3), (3, 5), (4, 5), (5, 9), (6, 8), (7, 8), (8, 9), (9, -1)], "rid int, next_rid int")
    got = {r["rid"]: r["strahler"] for r in network.strahler(links).collect()}
    assert (got[3], got[5], got[9]) == (2, 2, 3)
    with pytest.raises(RuntimeError):
        network.strahler(spark.createDataFrame([(1, 2), (2, 1)], "rid int, next_rid int"))


def test_percentile_classes(spark):
    from talweg.operators.workflows import connectivity

    assert list(values(connectivity([grid(spark, [1, 2, 3, 4])], (25, 75))).values()).count(1) == 2
    with pytest.raises(ValueError):
        connectivity([grid(spark, [1])], (75, 25))


def test_polygons(spark):
    spec = GridSpec(0, 3, 1, 1, 3, 3)
    got = resample.vectorize(grid(spark, [1, 1, 2], [1, 2, 2], [3, 3, 1]), spec).collect()
    assert len(got) == 4 and {r["value"] for r in got} == {1, 2, 3}


def test_raster_round_trip(spark, tmp_path):
    from talweg.sources.rasters import Raster, to_raster

    spec = GridSpec(0, 3, 1, 1, 3, 3)
    to_raster(grid(spark, [1, None, 3], [4, 5, 6], [7, 8, 9]), spec, str(tmp_path), 2)
    r = Raster(spark, str(tmp_path))
    assert r.spec.matches(spec) and values(r.window(slice(0, 1)))[(0, 1)] is None and r.stats["max"] == 9
    with pytest.raises(IndexError):
        r.window(slice(0, 4))
    r.write_window(spark.createDataFrame([(0, 1, 42.0)], "row int, col int, value double"))
    assert values(r.cells())[(0, 1)] == 42 and r.cells().count() == 9


def test_bounding_query_uses_all_observations(spark, tmp_path):
    import numpy as np

    from talweg import queries as Q
    from talweg.operators import interp

    n = 21_000
    assert n > interp.SMALL
    spark.range(n).select(F.col("id").alias("c_custkey"), (F.col("id") % 1013).cast("double").alias("c_acctbal")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(1, 13).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    obs = Q._all_obs(spark, str(tmp_path)).collect()
    assert len(obs) == n == len({(o.ox, o.oy) for o in obs})
    pred = Q._pred(spark, str(tmp_path))
    got = {(r.pid, r["rank"]): r.oid for r in interp.nearest(pred, Q._all_obs(spark, str(tmp_path)), 3).collect()}
    oid, x, y = (np.array([o[c] for o in obs]) for c in ("oid", "ox", "oy"))
    for p in pred.collect():
        best = np.lexsort((oid, (p.px - x) ** 2 + (p.py - y) ** 2))[:3]
        assert [got[(p.pid, k)] for k in (1, 2, 3)] == oid[best].tolist()
    assert Q.QUERIES["I05_bounding_idw"](spark, str(tmp_path)).where("value is not null").count() == 12
