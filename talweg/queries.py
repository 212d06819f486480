"""Queries over the test tables, one or more for each operator, with DuckDB SQL of the same rows.

The tables hold no rasters, so a grid of 48 x 48 cells is derived from
``lineitem`` by integer arithmetic; the SQL repeats it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talweg.functions import algebra as A
from talweg.operators import cost, focal, hydro, interp, network, resample, terrain, workflows
from talweg.plans.grid import GridSpec, disk_kernel, kernel_offsets
from talweg.sources import rasters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SPEC = GridSpec(left=500000.0, top=4000000.0, csx=10.0, csy=10.0, n_rows=48, n_cols=48, crs="EPSG:32610")

_GRID = "g as (select l_orderkey % 48 as r, l_partkey % 48 as c, cast(sum(cast(l_quantity as bigint)) as bigint) as v, count(*) as n from lineitem group by 1, 2)"
_DEM = _GRID + ", dem as (select r, c, cast(r * 1000 + abs(c - 24) * 300 + v % 200 as bigint) as z from g)"
_HOLES = _DEM + ", holes as (select r, c, case when (r * 7 + c * 13) % 17 = 0 then null else z end as z from dem)"
_OFF9 = ", o9 as (select a.x as dr, b.x as dc from (values (-1), (0), (1)) a(x), (values (-1), (0), (1)) b(x))"
_D8 = _DEM + """, off(code, dr, dc, d) as (values (1, -1, 1, sqrt(2)), (2, -1, 0, 1.0), (3, -1, -1, sqrt(2)), (4, 0, -1, 1.0), (5, 1, -1, sqrt(2)), (6, 1, 0, 1.0), (7, 1, 1, sqrt(2)), (8, 0, 1, 1.0)),
    nb as (select a.r, a.c, o.code, cast(a.z - b.z as double) / cast(o.d as double) as fall, b.r as nr, b.c as nc from dem a cross join off o join dem b on b.r = a.r + o.dr and b.c = a.c + o.dc where b.z < a.z),
    e as (select r, c, code, nr, nc from (select *, row_number() over (partition by r, c order by fall desc, code) as k from nb) t where k = 1)"""
_PATH = _D8 + ", path(r, c, tr, tc) as (select r, c, r, c from dem union all select p.r, p.c, e.nr, e.nc from path p join e on p.tr = e.r and p.tc = e.c)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def grid48(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    keys = ((F.col("l_orderkey") % 48).alias("row"), (F.col("l_partkey") % 48).alias("col"))
    return t.groupBy(*keys).agg(F.sum(F.col("l_quantity").cast("long")).alias("v"), F.count(F.lit(1)).alias("n"))


def dem48(spark: SparkSession, d: str) -> DataFrame:
    z = F.col("row") * 1000 + F.abs(F.col("col") - 24) * 300 + F.col("v") % 200
    return grid48(spark, d).select("row", "col", z.cast("long").alias("value"))


def holes48(spark: SparkSession, d: str) -> DataFrame:
    return dem48(spark, d).select("row", "col", F.when((F.col("row") * 7 + F.col("col") * 13) % 17 != 0, F.col("value")).alias("value"))


def streams48(spark: SparkSession, d: str) -> DataFrame:
    return dem48(spark, d).where(F.abs(F.col("col") - 24) <= 1).select("row", "col", F.lit(1).alias("value"))


def out(df: DataFrame, value: Column | str = "value", digits: int | None = None) -> DataFrame:
    v = F.col(value) if isinstance(value, str) else value
    v = F.round(v.cast("double"), digits) if digits is not None else v
    return df.select(F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c"), v.alias("value"))


# Sources and grids


@query("S01_scan_mask", f"with {_HOLES} select count(*) as n, count(z) as valid, cast(sum(z) as bigint) as total from holes")
def _s01(s, d):
    return rasters.from_cells(holes48(s, d)).agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("valid"), F.sum("value").cast("long").alias("total"))


@query("S02_raster_round_trip", f"with {_HOLES} select r, c, cast(z as double) as value from holes")
def _s02(s, d):
    from talweg.plans.graph import cut

    path = f"{_folder(s)}/raster"
    rasters.to_raster(holes48(s, d).select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value")), SPEC, path, 16)
    return cut(out(rasters.Raster(s, path).cells()))


def _folder(s: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    import uuid

    from talweg.plans.graph import shared_folder

    return f"{shared_folder(s)}/talweg-{uuid.uuid4().hex}"


def _stored(s, d, name: str, tile: int = 16) -> rasters.Raster:
    path = f"{_folder(s)}/{name}"
    cells = dem48(s, d).select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value"))
    rasters.to_raster(cells, SPEC, path, tile)
    return rasters.Raster(s, path)


@query("S03_specs_and_stats", f"with {_DEM} select cast(48 as bigint) as n_rows, cast(48 as bigint) as n_cols, cast(500000 as double) as left_x, cast(4000000 as double) as top_y, cast(10 as double) as csx, cast(min(z) as double) as lo, cast(max(z) as double) as hi, round(avg(z), 6) as mean, round(stddev_pop(z), 6) as std from dem")
def _s03(s, d):
    r = _stored(s, d, "specs")
    row = (r.spec.n_rows, r.spec.n_cols, r.spec.left, r.spec.top, r.spec.csx, r.stats["min"], r.stats["max"], round(r.stats["mean"], 6), round(r.stats["std"], 6))
    return s.createDataFrame([row], "n_rows long, n_cols long, left_x double, top_y double, csx double, lo double, hi double, mean double, std double")


@query("S05_empty_like", "select a.x as r, b.x as c, cast(null as double) as value from generate_series(0, 23) a(x), generate_series(0, 47) b(x)")
def _s05(s, d):
    path = f"{_folder(s)}/like"
    rasters.empty_like(s, SPEC, path, n_rows=24)
    return out(rasters.Raster(s, path).cells())


@query("S07_window_write", f"with {_DEM} select r, c, cast(case when r between 5 and 20 and c between 30 and 40 then -1 else z end as double) as value from dem")
def _s07(s, d):
    r = _stored(s, d, "write")
    part = SPEC.cells(s).where("row between 5 and 20 and col between 30 and 40").withColumn("value", F.lit(-1.0))
    r.write_window(part)
    return out(r.cells())


@query("S04_empty_grid", "select a.x as r, b.x as c, cast(null as double) as value from generate_series(0, 47) a(x), generate_series(0, 47) b(x)")
def _s04(s, d):
    path = f"{_folder(s)}/empty"
    rasters.empty(s, SPEC, path)
    return out(rasters.Raster(s, path).cells())


@query("S06_window_read", f"with {_DEM} select r, c, cast(z as double) as value from dem where r between 10 and 19 and c between 5 and 14")
def _s06(s, d):
    path = f"{_folder(s)}/window"
    cells = dem48(s, d).select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value"))
    rasters.to_raster(cells, SPEC, path, 16)
    return out(rasters.Raster(s, path).window(slice(10, 20), slice(5, 15)))


@query("S08_valid_index", f"with {_HOLES} select r, c, z as value from holes where z is not null")
def _s08(s, d):
    return out(rasters.valid_index(holes48(s, d)))


@query("S09_points_xyz", f"with {_HOLES} select cast(500000 + (c + 0.5) * 10 as double) as x, cast(4000000 - (r + 0.5) * 10 as double) as y, z as value from holes where z is not null")
def _s09(s, d):
    return rasters.points(holes48(s, d), SPEC)


@query("S12_rasterize_box", "select a.x as r, b.x as c, cast(7 as double) as value from generate_series(5, 14) a(x), generate_series(8, 27) b(x)")
def _s12(s, d):
    ring = [(500080.0, 3999950.0), (500280.0, 3999950.0), (500280.0, 3999850.0), (500080.0, 3999850.0), (500080.0, 3999950.0)]
    return out(resample.vector_to_raster(s.createDataFrame([(1, [ring])], "id int, rings array<array<struct<x:double,y:double>>>"), SPEC, burn_value=7))


@query("S13_values_on_line", f"with {_DEM} select count(*) as n, cast(sum(z) as bigint) as total from dem where r = 12")
def _s13(s, d):
    line = s.createDataFrame([(1, 1, 500005.0, 3999875.0), (1, 2, 500475.0, 3999875.0)], "fid int, seq int, x double, y double")
    got = resample.values_on_lines(line, dem48(s, d), SPEC)
    return got.select(F.explode("points").alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum("p.value").cast("long").alias("total"))


@query("S22_ground_surface")
def _s22(s, d):
    pts = table(s, d, "lineitem").select((SPEC.left + (F.col("l_partkey") % 480 + 0.5)).alias("x"), (SPEC.top - (F.col("l_orderkey") % 480 + 0.5)).alias("y"), F.col("l_quantity").alias("z"))
    return out(resample.las_to_dtm(pts, SPEC))


@query("G01_bilinear_resample", f"""with {_DEM}, t as (select a.x as r, b.x as c, (a.x + 0.5) / 2 - 0.5 as fr, (b.x + 0.5) / 2 - 0.5 as fc from generate_series(0, 95) a(x), generate_series(0, 95) b(x)),
    k as (select t.r, t.c, cast(z as double) as z, (1 - abs(t.fr - dem.r)) * (1 - abs(t.fc - dem.c)) as w from t join dem on dem.r between floor(t.fr) and floor(t.fr) + 1 and dem.c between floor(t.fc) and floor(t.fc) + 1)
    select r, c, round(cast(sum(z * w) / sum(w) as double), 4) as value from k where w > 0 group by r, c""")
def _g01(s, d):
    return out(resample.warp([(dem48(s, d), SPEC)], SPEC.with_(csx=5.0, csy=5.0, n_rows=96, n_cols=96), "bilinear"), digits=4)


@query("G01_nearest_mosaic", f"with {_DEM} select r, c, cast(case when c < 20 then -1 else z end as double) as value from dem")
def _g01b(s, d):
    left = dem48(s, d).where("col < 20").select("row", "col", F.lit(-1).alias("value"))
    return out(resample.warp([(dem48(s, d), SPEC), (left, SPEC)], SPEC, "nearest"))


@query("G03_semi_clip", f"with {_HOLES} select d.r, d.c, d.z as value from dem d join holes h on d.r = h.r and d.c = h.c where h.z is not null")
def _g03(s, d):
    return out(resample.clip_raster(dem48(s, d), SPEC, holes48(s, d), SPEC)[0])


@query("G03_data_extent", f"with {_HOLES} select cast(500000 + min(c) * 10 as double) as left_x, cast(4000000 - min(r) * 10 as double) as top_y, cast(max(r) - min(r) + 1 as bigint) as n_rows, cast(max(c) - min(c) + 1 as bigint) as n_cols from holes where z > 20000")
def _g03b(s, d):
    e = resample.data_extent(holes48(s, d).where("value > 20000"), SPEC)
    return s.createDataFrame([(e.left, e.top, e.n_rows, e.n_cols)], "left_x double, top_y double, n_rows long, n_cols long")


@query("G07_coords_roundtrip", f"with {_DEM} select r, c, r as r2, c as c2 from dem")
def _g07(s, d):
    xy = dem48(s, d).select("row", "col", SPEC.x("col").alias("x"), SPEC.y("row").alias("y"))
    return xy.select(F.col("row").alias("r"), F.col("col").alias("c"), SPEC.row("y").cast("long").alias("r2"), SPEC.col("x").cast("long").alias("c2"))


@query("G10_disk_kernel", "select a.x as dr, b.x as dc from generate_series(-3, 3) a(x), generate_series(-3, 3) b(x) where sqrt(cast(a.x * a.x + b.x * b.x as double)) * 10 <= 30")
def _g10(s, d):
    return s.createDataFrame(kernel_offsets(disk_kernel(30.0, 10.0, 10.0)), "dr long, dc long")


@query("S09_csv_sink", f"with {_HOLES} select cast(500000 + (c + 0.5) * 10 as double) as x, cast(4000000 - (r + 0.5) * 10 as double) as y, cast(z as double) as value from holes where z is not null")
def _s09b(s, d):
    path = f"{_folder(s)}/points"
    rasters.write_points_csv(rasters.points(holes48(s, d), SPEC), path)
    return rasters.read_table(s, path).select(*[F.col(c).cast("double").alias(c) for c in ("x", "y", "value")])


@query("S09_geojson_sink", f"with {_HOLES} select cast(500000 + (c + 0.5) * 10 as double) as x, cast(4000000 - (r + 0.5) * 10 as double) as y, cast(z as double) as value from holes where z is not null")
def _s09c(s, d):
    path = f"{_folder(s)}/features"
    rasters.write_points_geojson(rasters.points(holes48(s, d), SPEC), path)
    f = F.from_json("value", "type string, geometry struct<type:string,coordinates:array<double>>, properties struct<value:double>")
    return s.read.text(path).select(f.alias("f")).select(F.col("f.geometry.coordinates")[0].alias("x"), F.col("f.geometry.coordinates")[1].alias("y"), F.col("f.properties.value").alias("value"))


@query("S10_polygons", f"with {_DEM} select cast((r // 16) * 3 + c // 16 as double) as value, cast(500000 + min(c) * 10 as double) as x0, cast(500000 + (max(c) + 1) * 10 as double) as x1, cast(4000000 - (max(r) + 1) * 10 as double) as y0, cast(4000000 - min(r) * 10 as double) as y1, cast(1 as bigint) as rings from dem group by r // 16, c // 16")
def _s10(s, d):
    blocks = dem48(s, d).withColumn("value", F.floor(F.col("row") / 16) * 3 + F.floor(F.col("col") / 16))
    got = resample.vectorize(blocks, SPEC).withColumn("p", F.flatten("rings"))
    limit = lambda f, k: f(F.transform("p", lambda v: v[k]))
    return got.select("value", limit(F.array_min, "x").alias("x0"), limit(F.array_max, "x").alias("x1"), limit(F.array_min, "y").alias("y0"), limit(F.array_max, "y").alias("y1"), F.size("rings").cast("long").alias("rings"))


@query("S11_tile_keys", "select c_custkey as id, cast(floor((cast(c_custkey % 359 as double) - 179.5 + 180) / 360 * 1024) as integer) as tx, cast(floor((1 - ln(tan(radians(cast(c_custkey % 160 as double) - 80.25)) + 1 / cos(radians(cast(c_custkey % 160 as double) - 80.25))) / pi()) / 2 * 1024) as integer) as ty from customer")
def _s11(s, d):
    k = F.col("c_custkey")
    pts = table(s, d, "customer").select(k.alias("id"), ((k % 359).cast("double") - 179.5).alias("x"), ((k % 160).cast("double") - 80.25).alias("y"))
    return resample.tile_keys(pts, 10).select("id", "tx", "ty")


@query("G01_cubic_resample", f"""with {_DEM}, t as (select a.x as r, b.x as c, (a.x + 0.5) / 2 - 0.5 as fr, (b.x + 0.5) / 2 - 0.5 as fc from generate_series(0, 95) a(x), generate_series(0, 95) b(x)),
    k as (select t.r, t.c, cast(z as double) as z, abs(t.fr - dem.r) as dr, abs(t.fc - dem.c) as dc from t join dem on dem.r between floor(t.fr) - 1 and floor(t.fr) + 2 and dem.c between floor(t.fc) - 1 and floor(t.fc) + 2),
    w as (select r, c, z, (case when dr <= 1 then 1.5 * dr * dr * dr - 2.5 * dr * dr + 1 else -0.5 * dr * dr * dr + 2.5 * dr * dr - 4 * dr + 2 end) * (case when dc <= 1 then 1.5 * dc * dc * dc - 2.5 * dc * dc + 1 else -0.5 * dc * dc * dc + 2.5 * dc * dc - 4 * dc + 2 end) as w from k)
    select r, c, round(cast(sum(z * w) / sum(w) as double), 3) as value from w group by r, c""")
def _g01c(s, d):
    return out(resample.warp([(dem48(s, d), SPEC)], SPEC.with_(csx=5.0, csy=5.0, n_rows=96, n_cols=96)), digits=3)


_GEO = GridSpec(left=10.0, top=50.0, csx=0.01, csy=0.01, n_rows=48, n_cols=48, crs="EPSG:4326")
_WEB = GridSpec(left=1113200.0, top=6446000.0, csx=1000.0, csy=1000.0, n_rows=40, n_cols=50, crs="EPSG:3857")


@query("G01_reproject_nearest", f"with {_DEM}, t as (select a.x as r, b.x as c, degrees((1113200 + (b.x + 0.5) * 1000) / 6378137) as lon, degrees(2 * atan(exp((6446000 - (a.x + 0.5) * 1000) / 6378137)) - pi() / 2) as lat from generate_series(0, 39) a(x), generate_series(0, 49) b(x)) select t.r, t.c, cast(dem.z as double) as value from t join dem on dem.r = cast(floor((50 - t.lat) / 0.01) as bigint) and dem.c = cast(floor((t.lon - 10) / 0.01) as bigint)")
def _g01d(s, d):
    return out(resample.warp([(dem48(s, d), _GEO)], _WEB, "nearest"))


@query("G02_warp_like", f"with {_DEM} select r, c, cast(z as double) as value from dem where r < 20 and c < 30")
def _g02(s, d):
    template = SPEC.with_(n_rows=20, n_cols=30)
    cells, spec = resample.warp_like([(dem48(s, d), SPEC)], template, "nearest")
    template.require(spec)
    return out(cells)


@query("G04_xy_align", f"with {_DEM}, t as (select a.x as r, b.x as c from generate_series(0, 57) a(x), generate_series(0, 67) b(x)) select t.r, t.c, cast(p.z as double) as first, cast(q.z as double) as second from t left join dem p on p.r = t.r - 10 and p.c = t.c left join dem q on q.r = t.r and q.c = t.c - 20 where p.z is not null or q.z is not null")
def _g04(s, d):
    shifted = SPEC.with_(left=SPEC.left + 200, top=SPEC.top + 100)
    a, b, _ = resample.xy_align((dem48(s, d), SPEC), (dem48(s, d), shifted), method="nearest")
    both = a.withColumnRenamed("value", "first").join(b.withColumnRenamed("value", "second"), ["row", "col"], "full")
    return both.select(F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c"), "first", "second")


@query("G08_mercator", "select c_custkey as id, round(6378137 * radians(cast(c_custkey % 359 as double) - 179.5), 3) as x, round(6378137 * ln(tan(pi() / 4 + radians(cast(c_custkey % 160 as double) - 80.25) / 2)), 3) as y from customer")
def _g08(s, d):
    from talweg.plans.grid import transform_points

    k = F.col("c_custkey")
    x, y = transform_points((k % 359).cast("double") - 179.5, (k % 160).cast("double") - 80.25, 4326, 3857)
    return table(s, d, "customer").select(k.alias("id"), F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


# Map algebra


def _algebra(name: str, sql: str, value: Callable[[Column], Column], source: Callable = holes48, digits: int | None = 6) -> None:
    query(name, sql)(lambda s, d: out(source(s, d), value(F.col("value")), digits))


def _plain(expr: str, digits: int = 6) -> str:
    return f"with {_HOLES} select r, c, round(cast({expr} as double), {digits}) as value from holes"


_algebra("F01_where", _plain("case when z < 20000 then 0 else z end"), lambda z: A.where(z < 20000, F.lit(0), z))
_algebra("F02_mask_where", _plain("case when z > 30000 then null else z end"), lambda z: A.mask_where(z > 30000, z))
_algebra("F04_filled", _plain("coalesce(z, -1)"), lambda z: A.filled(z, -1))
_algebra("F07_clip", _plain("case when z is not null then least(greatest(z, 5000), 40000) end"), lambda z: A.clip(z, 5000, 40000))
_algebra("F08_digitize", _plain("case when z is not null then least(greatest(floor(cast(z as double) / 1000), 0), 44) + 1 end"), lambda z: A.digitize(z / 1000, [float(i) for i in range(45)]))
_algebra("F10_class_area", _plain("case when z % 5 = 3 then 100 when z is not null then 0 end"), lambda z: A.class_area(z % 5, 3, 10.0, 10.0))
_algebra("F11_class_code", _plain("(z % 7) * 1000000 + (z % 900) * 1000 + (z % 90) * 10 + z % 2"), lambda z: A.class_code(z % 7, z % 900, z % 90, z % 2))
_algebra("F12_cleaned", _plain("case when z is null or z < 20000 then 0 else z - 20000 end"), lambda z: A.cleaned((z - 20000).cast("double")))
_algebra("F16_precip_weight", _plain("z * least(greatest(z, 0), 3000) / cast(3000 as double)"), lambda z: A.precipitation_weight(z, z.cast("double")))
_algebra("F17_width", _plain("0.042 * power(cast(z + 1 as double), 0.48) * power(cast(z as double) / 10, 0.74)"), lambda z: A.bankfull_width((z + 1).cast("double"), z.cast("double")))
_algebra("F18_depth", _plain("0.145 * power(cast(z as double), 0.607)"), lambda z: A.bankfull_depth(z.cast("double")))
_algebra("F19_confinement", _plain("case when z % 10 > 0 then least(greatest(z, 0), 1000) / cast(z % 10 as double) end"), lambda z: A.valley_confinement((z % 10).cast("double"), z.cast("double")))
_algebra("F20_flood_elevation", _plain("z + (z % 9) * cast(1.5 as double)"), lambda z: A.bankfull_elevation(z, z % 9, 1.5))
_algebra("F21_area", _plain("case when z % 4 > 0 then (z % 4) * 100 / cast(1000000 as double) end"), lambda z: A.contributing_area(z % 4, 10.0, 10.0))


_algebra("F05_mask_invalid", _plain("case when z % 3 <> 0 and z % 5 <> 0 then z end"), lambda z: A.mask_invalid(F.when(z % 3 == 0, F.lit(float("inf"))).when(z % 5 == 0, F.lit(float("nan"))).otherwise(z.cast("double"))))


@query("F03_valid_mask", f"with {_HOLES} select r, c, z is not null as value from holes")
def _f03(s, d):
    return out(holes48(s, d), A.valid(F.col("value")))


@query("F13_boolean_raster", f"with {_DEM} select r, c, cast(1 as double) as value from dem where z > 20000")
def _f13(s, d):
    path = f"{_folder(s)}/flags"
    cells = dem48(s, d).select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), (F.col("value") > 20000).alias("value"))
    rasters.to_raster(cells, SPEC, path, 16)
    return out(rasters.Raster(s, path).cells(), digits=0)


@query("F14_front_contains", "select a.l_orderkey as k, a.l_linenumber as n, (t.tx - t.x2) * (t.x2 - t.x1) + (t.ty - t.y2) * (t.y2 - t.y1) <= 0 as value from lineitem a, lateral (select a.l_orderkey % 5 - 2 as x1, a.l_partkey % 5 - 2 as y1, a.l_suppkey % 5 - 2 as x2, a.l_orderkey % 7 - 3 as y2, a.l_partkey % 7 - 3 as tx, a.l_suppkey % 7 - 3 as ty) t")
def _f14(s, d):
    o, p, u = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey"))
    hit = A.front_contains(o % 5 - 2, p % 5 - 2, u % 5 - 2, o % 7 - 3, p % 7 - 3, u % 7 - 3)
    return table(s, d, "lineitem").select(o.alias("k"), F.col("l_linenumber").alias("n"), hit.alias("value"))


@query("F06_align_math", f"with {_HOLES} select g.r, g.c, round(cast(h.z as double) / nullif(g.n, 0) + g.v, 6) as value from g join holes h on g.r = h.r and g.c = h.c")
def _f06(s, d):
    return out(holes48(s, d).join(grid48(s, d), ["row", "col"]), A.divide(F.col("value"), F.col("n")) + F.col("v"), 6)


@query("F09_normalize", f"with {_HOLES}, m as (select min(z) as lo, max(z) as hi from holes) select r, c, round(1 - cast(z - lo as double) / nullif(hi - lo, 0), 6) as value from holes cross join m")
def _f09(s, d):
    return out(A.normalize(holes48(s, d), invert=True), digits=6)


# Moving windows

_KERNEL = (3, 3)
_NEAR = f"with {_HOLES}{_OFF9}, n as (select a.r, a.c, a.z as own, b.z as v, (o.dr + 1) * 3 + o.dc + 1 as ord from holes a cross join o9 o left join holes b on b.r = a.r + o.dr and b.c = a.c + o.dc)"
for _i, (_m, _sql, _q) in enumerate(
    [("sum", "sum(v)", None), ("min", "min(v)", None), ("max", "max(v)", None), ("mode", "", None), ("diff", "max(v) - min(v)", None), ("mean", "avg(v)", None), ("median", "quantile_cont(v, 0.5)", None),
     ("std", "stddev_pop(v)", None), ("variance", "var_pop(v)", None), ("percentile", "quantile_cont(v, 0.3)", 30.0), ("quantile", "quantile_cont(v, 0.8)", 0.8)], 1
):
    if _m == "mode":
        continue
    _text = f"{_NEAR} select r, c, round(cast(case when own is not null then x end as double), 4) as value from (select r, c, max(own) as own, {_sql} as x from n group by r, c) t"
    query(f"W{_i:02d}_{_m}", _text)(lambda s, d, m=_m, q=_q: out(focal.raster_filter(holes48(s, d), _KERNEL, m, q), digits=4))


@query("W04_mode", f"""{_NEAR}, k as (select r, c, v % 5 as v, count(*) as n, min(ord) as ord from n where v is not null group by r, c, v % 5),
    b as (select r, c, v from (select *, row_number() over (partition by r, c order by n desc, ord) as p from k) t where p = 1)
    select h.r, h.c, case when h.z is not null then b.v end as value from holes h left join b on h.r = b.r and h.c = b.c""")
def _w04(s, d):
    return out(focal.raster_filter(holes48(s, d).withColumn("value", F.col("value") % 5), _KERNEL, "mode"))


@query("W12_mean_by_tiles", f"{_NEAR} select r, c, round(cast(case when own is not null then x end as double), 4) as value from (select r, c, max(own) as own, avg(v) as x from n group by r, c) t")
def _w12(s, d):
    return out(focal.focal_tiles(holes48(s, d), kernel_offsets(_KERNEL), "mean", 16), digits=4)


@query("W00_custom_range", f"{_NEAR} select r, c, round(cast(case when own is not null then x end as double), 4) as value from (select r, c, max(own) as own, max(v) - min(v) as x from n group by r, c) t")
def _w00(s, d):
    import numpy as np

    return out(focal.custom_raster_filter(holes48(s, d), _KERNEL, lambda a: float(np.nanmax(a) - np.nanmin(a)), tile=16), digits=4)


@query("W13_erosion_edges", f"{_NEAR} select r, c, count(v) < 9 as value from n where own is not null group by r, c")
def _w13(s, d):
    return out(focal.erosion_edges(holes48(s, d)), "edge")


@query("W14_fill_wmean", f"""with {_HOLES}, o as (select a.x as dr, b.x as dc from generate_series(-2, 2) a(x), generate_series(-2, 2) b(x)),
    n as (select a.r, a.c, a.z as own, b.z as v, 1 / greatest(sqrt(cast(o.dr * o.dr + o.dc * o.dc as double)), 1) as w from holes a cross join o left join holes b on b.r = a.r + o.dr and b.c = a.c + o.dc)
    select r, c, round(cast(coalesce(own, x) as double), 4) as value from (select r, c, max(own) as own, case when count(v) >= 3 then sum(v * w) / sum(case when v is not null then w end) end as x from n group by r, c) t""")
def _w14(s, d):
    return out(focal.fill_stats(holes48(s, d), 2, smooth=False), digits=4)


# Terrain

_NINE = "select a.r, a.c, a.z, " + ", ".join(f"coalesce(max(case when o.dr = {r} and o.dc = {c} then b.z end), a.z) as z{r + 1}{c + 1}" for r in (-1, 0, 1) for c in (-1, 0, 1))
_HORN = f"with {_HOLES}{_OFF9}, n as ({_NINE} from holes a cross join o9 o left join holes b on b.r = a.r + o.dr and b.c = a.c + o.dc where a.z is not null group by a.r, a.c, a.z), k as (select *, cast((z02 + 2 * z12 + z22) - (z00 + 2 * z10 + z20) as double) / 80 as gx, cast((z20 + 2 * z21 + z22) - (z00 + 2 * z01 + z02) as double) / 80 as gy from n)"


@query("N01_slope_horn", f"{_HORN} select r, c, round(degrees(atan(sqrt(gx * gx + gy * gy))), 4) as value from k")
def _n01(s, d):
    return out(terrain.slope(holes48(s, d), 10.0, 10.0), digits=4)


@query("N02_aspect", f"{_HORN} select r, c, round(case when gx <> 0 or gy <> 0 then case when degrees(atan2(-gx, gy)) < 0 then degrees(atan2(-gx, gy)) + 360 else degrees(atan2(-gx, gy)) end end, 4) as value from k")
def _n02(s, d):
    return out(terrain.aspect(holes48(s, d), 10.0, 10.0), digits=4)


@query("N03_tri_riley", f"{_HORN} select r, c, round(sqrt(cast({' + '.join(f'(z{a}{b} - z) * (z{a}{b} - z)' for a in range(3) for b in range(3))} as double)), 4) as value from k")
def _n03(s, d):
    return out(terrain.ruggedness(holes48(s, d)), digits=4)


@query("N04_solar_radiation")
def _n04(s, d):
    return out(terrain.solar_radiation(dem48(s, d), 100, spec=SPEC), digits=4)


@query("N05_mean_of_days", f"with {_GRID}, t as (select r, c, cast(v % (k.x * 13 + 7) as double) as v from g, generate_series(1, 12) k(x)) select r, c, round(avg(v), 6) as value from t group by r, c")
def _n05(s, d):
    days = F.explode(F.sequence(F.lit(1), F.lit(12)))
    return out(terrain.mean_of_days(grid48(s, d).withColumn("day", days).withColumn("value", F.col("v") % (F.col("day") * 13 + 7))), digits=6)


@query("N06_stream_slope", _HORN.replace("from holes a", "from s a").replace("join holes b", "join s b").replace(_OFF9, ", s as (select r, c, z from dem where abs(c - 24) <= 1)" + _OFF9) + " select r, c, round(degrees(atan(sqrt(gx * gx + gy * gy))), 4) as value from k")
def _n06(s, d):
    return out(terrain.stream_slope(dem48(s, d), streams48(s, d), SPEC), digits=4)


@query("N07_zalign_shifted", f"with {_DEM} select r, c, round(cast(z as double), 4) as value from dem")
def _n07b(s, d):
    source = dem48(s, d).withColumn("value", F.when(F.col("row") < 30, F.col("value")))
    return out(resample.z_align(source, dem48(s, d).withColumn("value", F.col("value") - 55)), digits=4)


# Flow


def _d8(s, d):
    return hydro.flow_direction(dem48(s, d))


@query("H01_d8", f"with {_D8} select d.r, d.c, cast(coalesce(e.code, 0) as bigint) as value from dem d left join e on d.r = e.r and d.c = e.c")
def _h01(s, d):
    return out(_d8(s, d), F.col("value").cast("long"))


@query("H01_fill_no_pits")
def _h01b(s, d):
    return out(hydro.fill_depressions(dem48(s, d)))


@query("H06_accumulation", f"with recursive {_PATH} select tr as r, tc as c, count(*) as value from path group by tr, tc")
def _h06(s, d):
    return out(hydro.FlowAccumulation(_d8(s, d)).modals())


_STREAM = """, n as (select tr as r, tc as c, count(*) as n from path group by tr, tc), st as (select r, c from n where n >= 40),
    se as (select e.r, e.c, e.nr, e.nc from e join st a on a.r = e.r and a.c = e.c join st b on b.r = e.nr and b.c = e.nc),
    fan as (select nr, nc, count(*) as k from se group by nr, nc),
    go as (select se.r, se.c, se.nr, se.nc from se join fan on fan.nr = se.nr and fan.nc = se.nc where fan.k = 1),
    walk(r, c, tr, tc) as (select r, c, r, c from st union all select w.r, w.c, go.nr, go.nc from walk w join go on go.r = w.tr and go.c = w.tc),
    ends as (select w.r, w.c, w.tr, w.tc from walk w left join go on go.r = w.tr and go.c = w.tc where go.r is null),
    seg as (select r, c, dense_rank() over (order by tr * 48 + tc) as v from ends)"""


@query("H02_extract_streams", f"with recursive {_PATH}{_STREAM} select r, c, v as value from seg")
def _h02(s, d):
    return out(hydro.extract_streams(dem48(s, d), 10.0, 10.0, min_area=4000.0)[0], F.col("value").cast("long"))


_DOWN = ", hop as (select r, c, tr, tc from (select p.*, row_number() over (partition by p.r, p.c order by n.n) as k from path p join st on st.r = p.tr and st.c = p.tc join n on n.r = p.tr and n.c = p.tc) t where k = 1)"


@query("H03_auto_basin", f"with recursive {_PATH}{_STREAM}{_DOWN} select hop.r, hop.c, seg.v as value from hop join seg on seg.r = hop.tr and seg.c = hop.tc")
def _h03b(s, d):
    return out(hydro.auto_basin(dem48(s, d), 10.0, 10.0, 4000.0), F.col("value").cast("long"))


@query("H11_index_from_dem", f"with recursive {_PATH}{_STREAM}{_DOWN}, below as (select nr, nc, count(*) as k from se group by nr, nc) select hop.tr as s_r, hop.tc as s_c, count(*) as cells, coalesce(max(below.k), 0) as children from hop left join below on below.nr = hop.tr and below.nc = hop.tc group by hop.tr, hop.tc")
def _h11(s, d):
    path = f"{_folder(s)}/index"
    hydro.WatershedIndex.from_dem(dem48(s, d), 10.0, 10.0, 4000.0).save(path)
    index = hydro.WatershedIndex.load(s, path)
    children = index.tree.groupBy("point_id").agg(F.count(F.lit(1)).alias("children"))
    p = F.col("point_id")
    counts = index.members.groupBy("point_id").agg(F.count(F.lit(1)).alias("cells")).join(children, "point_id", "left")
    return counts.select(F.floor(p / hydro.WIDTH).alias("s_r"), F.pmod(p, F.lit(hydro.WIDTH)).alias("s_c"), "cells", F.coalesce("children", F.lit(0)).alias("children"))


@query("H13_locations", f"with recursive {_PATH}, g2 as (select tr as r, tc as c, min(g.v) as lo from path join g on path.r = g.r and path.c = g.c group by tr, tc) select dense_rank() over (order by last.root) as network_id, cast(500000 + (dem.c + 0.5) * 10 as double) as x, cast(4000000 - (dem.r + 0.5) * 10 as double) as y, g2.lo as lo from dem join (select p.r, p.c, p.tr * 48 + p.tc as root from path p left join e on e.r = p.tr and e.c = p.tc where e.r is null) last on last.r = dem.r and last.c = dem.c join g2 on g2.r = dem.r and g2.c = dem.c where abs(dem.c - 24) <= 1")
def _h13(s, d):
    index = hydro.WatershedIndex(_d8(s, d), streams48(s, d))
    data = index.calculate_stats(grid48(s, d).withColumnRenamed("v", "value")).select("row", "col", F.col("min").alias("lo"))
    return index.locations(SPEC, data).select(F.col("network_id").cast("long").alias("network_id"), "x", "y", "lo")


_ALONG = """, st as (select r, c from dem where abs(c - 24) <= 1), se as (select e.r, e.c, e.nr, e.nc from e join st a on a.r = e.r and a.c = e.c join st b on b.r = e.nr and b.c = e.nc),
    way(i, r, c, along) as (select st.r * 48 + st.c, st.r, st.c, cast(0 as double) from st left join se on se.nr = st.r and se.nc = st.c where se.nr is null
        union all select w.i, se.nr, se.nc, w.along + sqrt(cast((se.nr - se.r) * (se.nr - se.r) + (se.nc - se.c) * (se.nc - se.c) as double)) from way w join se on se.r = w.r and se.c = w.c),
    avgs as (select way.i, way.r, way.c, way.along, avg(g.v) over (partition by way.i order by way.along range between 4.7 preceding and current row) as m from way join g on g.r = way.r and g.c = way.c)"""


@query("H14_upstream_mean", f"with recursive {_D8}{_ALONG} select r, c, round(m, 4) as value from (select *, row_number() over (partition by r, c order by i desc) as k from avgs where along > 0) t where k = 1")
def _h14c(s, d):
    return out(hydro.upstream_stats(grid48(s, d).withColumnRenamed("v", "value"), streams48(s, d), _d8(s, d), 4.7), digits=4)


@query("H01_filled_pits", f"""with recursive {_GRID}, t as (select r, c, v % 9 as z, r = 0 or c = 0 or r = 47 or c = 47 as rim from g), o(dr, dc) as (select a.x, b.x from generate_series(-1, 1) a(x), generate_series(-1, 1) b(x)),
    lv(r, c, z) using key (r, c) as (select r, c, z from t where rim union select t.r, t.c, min(greatest(t.z, l.z)) from lv l join o on true join t on t.r = l.r + o.dr and t.c = l.c + o.dc left join recurring.lv y on y.r = t.r and y.c = t.c where y.z is null or greatest(t.z, l.z) < y.z group by t.r, t.c)
    select r, c, cast(z as double) as value from lv""")
def _h01d(s, d):
    return out(hydro.fill_depressions(grid48(s, d).select("row", "col", (F.col("v") % 9).cast("double").alias("value"))))


@query("H07_weighted_mean", f"with recursive {_PATH} select tr as r, tc as c, round(avg(cast(g.v as double)), 4) as value from path join g on path.r = g.r and path.c = g.c group by tr, tc")
def _h07(s, d):
    return out(hydro.FlowAccumulation(_d8(s, d)).calculate(grid48(s, d).withColumnRenamed("v", "value"), "mean"), digits=4)


@query("H08_mean_on_streams", f"with recursive {_PATH} select tr as r, tc as c, round(avg(cast(g.v as double)), 4) as value from path join g on path.r = g.r and path.c = g.c where abs(tc - 24) <= 1 group by tr, tc")
def _h08(s, d):
    return out(hydro.summarize_on_streams(_d8(s, d), streams48(s, d), grid48(s, d).withColumnRenamed("v", "value")), digits=4)


@query("H12_upstream_stats", f"with recursive {_PATH} select tr as r, tc as c, min(g.v) as lo, max(g.v) as hi, cast(sum(g.v) as bigint) as total, round(avg(cast(g.v as double)), 4) as mean from path join g on path.r = g.r and path.c = g.c group by tr, tc")
def _h12(s, d):
    got = hydro.FlowAccumulation(_d8(s, d)).stats(grid48(s, d).withColumnRenamed("v", "value"))
    return got.select(F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c"), F.col("min").alias("lo"), F.col("max").alias("hi"), F.col("sum").cast("long").alias("total"), F.round("mean", 4).alias("mean"))


@query("H05_basin_at_point", f"with recursive {_PATH} select distinct r, c from path where tr = 20 and tc = 24")
def _h05(s, d):
    return hydro.basin(_d8(s, d), 20, 24).select(F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c"))


_FIRST = ", hop as (select r, c, tr, tc, z from (select p.*, d.z, row_number() over (partition by p.r, p.c order by d.z desc) as k from path p join dem d on d.r = p.tr and d.c = p.tc where abs(p.tc - 24) <= 1) t where k = 1)"


@query("H04_first_stream_below", f"with recursive {_PATH}{_FIRST} select r, c, tr as s_r, tc as s_c from hop")
def _h04(s, d):
    got = hydro.first_stream_below(_d8(s, d), streams48(s, d))
    return got.select(*[F.col(a).cast("long").alias(b) for a, b in (("row", "r"), ("col", "c"), ("s_row", "s_r"), ("s_col", "s_c"))])


@query("H04_basin_labels", f"with recursive {_PATH}{_FIRST} select r, c, tr as value from hop")
def _h03(s, d):
    return out(hydro.stream_basins(_d8(s, d), streams48(s, d).withColumn("value", F.col("row"))))


@query("H10_index_members", f"with recursive {_PATH}{_FIRST} select tr as s_r, tc as s_c, count(*) as cells from hop group by tr, tc")
def _h10(s, d):
    m = hydro.WatershedIndex(_d8(s, d), streams48(s, d)).members
    p = F.col("point_id")
    return m.groupBy(F.floor(p / hydro.WIDTH).alias("s_r"), F.pmod(p, F.lit(hydro.WIDTH)).alias("s_c")).agg(F.count(F.lit(1)).alias("cells"))


@query("H14_upstream_window")
def _h14b(s, d):
    return out(hydro.upstream_stats(grid48(s, d).withColumnRenamed("v", "value"), streams48(s, d), _d8(s, d), 5.0), digits=4)


@query("H09_stream_order")
def _h09(s, d):
    direction = _d8(s, d)
    on = hydro.threshold_streams(hydro.FlowAccumulation(direction).modals(), 20)
    return out(hydro.stream_order(direction, hydro.stream_segments(direction, on)))


@query("H01_multiple_flow")
def _h01c(s, d):
    return out(hydro.flow_direction_accumulation(dem48(s, d), single=False)[1], digits=3)


# Networks


def _classes(s, d):
    return streams48(s, d).withColumn("value", F.floor(F.col("row") / 6))


_REACH = _D8 + ", s as (select r, c, cast(floor(cast(r as double) / 6) as bigint) as k from dem where abs(c - 24) <= 1), l as (select e.r, e.c, e.nr, e.nc from e join s a on a.r = e.r and a.c = e.c join s b on b.r = e.nr and b.c = e.nc where a.k = b.k), b as (select r * 48 + c as a, nr * 48 + nc as b from l union select nr * 48 + nc, r * 48 + c from l), reach(id, to_id) as (select r * 48 + c, r * 48 + c from s union select reach.id, b.b from reach join b on reach.to_id = b.a)"


@query("V01_components", f"with recursive {_REACH}, m as (select id, min(to_id) as label from reach group by id) select id // 48 as r, id % 48 as c, dense_rank() over (order by label) as value from m")
def _v01(s, d):
    return out(network.flow_labels(_classes(s, d), _d8(s, d)), F.col("value").cast("long"))


@query("V02_reach_lines")
def _v02(s, d):
    vertices, _ = network.reach_vertices(network.flow_labels(_classes(s, d), _d8(s, d)), _d8(s, d), SPEC)
    return vertices.select("rid", "seq", "x", "y")


@query("V03_strahler")
def _v03(s, d):
    features, _ = network.stream_topology(network.flow_labels(_classes(s, d), _d8(s, d)), _d8(s, d), SPEC)
    return features.select("rid", "next_rid", "strahler", "netID", F.round("length", 4).alias("length"), F.round("sinuosity", 4).alias("sinuosity"), F.round("upDist", 4).alias("upDist"))


@query("V03_updist", "with recursive t as (select n_nationkey as rid, case when n_nationkey = 0 then -1 else (n_nationkey - 1) // 2 end as nxt, cast(n_nationkey + 1 as double) as length from nation), p(rid, nx, d) as (select rid, nxt, length from t union all select p.rid, t.nxt, p.d + t.length from p join t on p.nx = t.rid) select rid, max(d) as updist from p group by rid")
def _v03b(s, d):
    k = F.col("n_nationkey")
    t = table(s, d, "nation").select(k.alias("rid"), F.when(k == 0, -1).otherwise(F.floor((k - 1) / 2)).cast("int").alias("next_rid"), (k + 1).cast("double").alias("length"))
    return network.net_and_distance(t.select("rid", "next_rid"), t).select("rid", F.col("upDist").alias("updist"))


@query("V04_zonal_line", f"with {_DEM} select cast(floor(cast(r as double) / 6) as bigint) as rid, min(z) as lo, max(z) as hi, round(avg(z), 4) as mean from dem where abs(c - 24) <= 1 group by 1")
def _v04(s, d):
    v = _classes(s, d).select("row", "col", F.col("value").alias("rid"))
    got = network.reach_attributes(v, dem48(s, d), lo=("value", "min"), hi=("value", "max"), mean=("value", "mean"))
    return got.select("rid", "lo", "hi", F.round("mean", 4).alias("mean"))


@query("V07_attributes_on_reaches", f"with {_DEM} select cast(floor(cast(r as double) / 6) as bigint) as rid, round(cast(median(z) as double), 4) as value from dem where abs(c - 24) <= 1 group by 1")
def _v07(s, d):
    v = _classes(s, d).select("row", "col", F.col("value").alias("rid"))
    return network.attributes_on_reaches(v, dem48(s, d), "median").select("rid", F.round("value", 4).alias("value"))


@query("V05_sinuosity")
def _v05(s, d):
    lines = table(s, d, "customer").select(F.col("c_nationkey").alias("fid"), F.col("c_custkey").alias("seq"), (F.col("c_custkey") % 97 * 10).cast("double").alias("x"), (F.col("c_custkey") % 89 * 10).cast("double").alias("y"))
    return network.sinuosity(lines, 100.0).select("fid", F.round("station", 4).alias("station"), F.round("value", 4).alias("value"))


# Interpolation

_OBS = "ob as (select c_custkey as oid, c_custkey % 97 + cast(c_custkey // 8633 * 633 % 1024 as double) / 1024 as ox, c_custkey % 89 + cast(c_custkey // 8633 * 773 % 1024 as double) / 1024 as oy, c_acctbal as z from customer), pr as (select s_suppkey as pid, cast(s_suppkey % 83 as double) + 0.25 as px, cast(s_suppkey % 71 as double) + 0.75 as py from supplier), pairs as (select pid, oid, z, (px - ox) * (px - ox) + (py - oy) * (py - oy) as d2 from pr, ob), nr as (select *, row_number() over (partition by pid order by d2, oid) as k from pairs)"


def _all_obs(s, d):
    """All customers: keys 8,633 apart, whose places would repeat, are spread inside their cell."""
    k = F.col("c_custkey")
    part = lambda factor: F.floor(k / 8633) * factor % 1024 / 1024
    return table(s, d, "customer").select(k.alias("oid"), (k % 97 + part(633)).alias("ox"), (k % 89 + part(773)).alias("oy"), F.col("c_acctbal").alias("z"))


def _pred(s, d):
    k = F.col("s_suppkey")
    return table(s, d, "supplier").select(k.alias("pid"), ((k % 83).cast("double") + 0.25).alias("px"), ((k % 71).cast("double") + 0.75).alias("py"))


@query("I02_idw_k3", f"with {_OBS} select pid, round(sum(z / d2) / sum(1 / d2), 4) as value from nr where k <= 3 group by pid")
def _i02(s, d):
    return interp.idw(_pred(s, d), _all_obs(s, d), 3).select("pid", F.round("value", 4).alias("value"))


@query("I03_full_idw", f"with {_OBS} select pid, round(sum(z / d2) / sum(1 / d2), 3) as value from pairs group by pid")
def _i03(s, d):
    return interp.full_idw(_pred(s, d), _all_obs(s, d)).select("pid", F.round("value", 3).alias("value"))


@query("I04_knn_mean", f"with {_OBS} select pid, round(avg(z), 4) as value from nr where k <= 5 group by pid")
def _i04(s, d):
    return interp.knn_mean(_pred(s, d), _all_obs(s, d), 5).select("pid", F.round("value", 4).alias("value"))


@query("I05_bounding_idw")
def _i05(s, d):
    return interp.bounding_idw(_pred(s, d), _all_obs(s, d)).select("pid", F.round("value", 4).alias("value"))


@query("I06_into_region")
def _i06(s, d):
    return out(interp.interpolate_into_region(streams48(s, d).withColumn("value", F.col("row")), dem48(s, d), 10.0, 10.0), digits=4)


@query("I07_fill_nodata")
def _i07(s, d):
    return out(interp.fill_nodata(holes48(s, d)), digits=4)


_MODEL = "t as (select cast(c_custkey % 50 + 1 as double) as ca, cast(c_custkey % 30 * 10 + 100 as double) as precip, cast(c_custkey % 3 as integer) as use from customer)"


def _morphology(s, d):
    k = F.col("c_custkey")
    t = table(s, d, "customer").select((k % 50 + 1).cast("double").alias("ca"), (k % 30 * 10 + 100).cast("double").alias("precip"), (k % 3).cast("int").alias("use"), "c_acctbal")
    true = 0.05 * F.pow("ca", F.lit(0.4)) * F.pow(F.col("precip") / 10, F.lit(0.6))
    return t.withColumn("width", F.when(F.col("use") == 1, true).otherwise(F.lit(99.0))).withColumn("noisy", true + F.col("c_acctbal") / 10000)


@query("I10_fit_morphology", "select cast(0.05 as double) as coefficient, cast(0.4 as double) as area_exponent, cast(0.6 as double) as precipitation_exponent")
def _i10(s, d):
    got = interp.fit_morphology(_morphology(s, d), "width", "use")
    return s.createDataFrame([tuple(round(v, 3) for v in got)], "coefficient double, area_exponent double, precipitation_exponent double")


@query("F23_model_metrics", "with t as (select 0.05 * power(cast(c_custkey % 50 + 1 as double), 0.4) * power(cast(c_custkey % 30 * 10 + 100 as double) / 10, 0.6) as p, c_acctbal / 10000 as e from customer), o as (select p, p + e as o from t) select round(sum((o - p) * (o - p)), 6) as sse, round(avg(abs(o - p)), 6) as mae, round(1 - sum((o - p) * (o - p)) / (var_pop(o) * count(*)), 6) as r2 from o")
def _f23(s, d):
    return interp.model_metrics(_morphology(s, d), "noisy", (0.05, 0.4, 0.6)).select(*[F.round(c, 6).alias(c) for c in ("sse", "mae", "r2")])


_PLANE = "3 * x - 2 * y + 7"


def _on_plane(s, d):
    return _all_obs(s, d).withColumn("z", 3 * F.col("ox") - 2 * F.col("oy") + 7)


@query("I09_linear", f"with {_OBS} select pid, round(3 * px - 2 * py + 7, 4) as value from pr where px between 15 and 75 and py between 15 and 65")
def _i09(s, d):
    pred = _pred(s, d).where("px between 15 and 75 and py between 15 and 65")
    return interp.linear(pred, _on_plane(s, d), -1.0).select("pid", F.round("value", 4).alias("value"))


@query("I08_spline_surface", f"with {_OBS} select c as c, r as r, round(cast(3 * c - 2 * r + 7 as double), 1) as value from (select a.x as r, b.x as c from generate_series(20, 40) a(x), generate_series(20, 50) b(x)) t")
def _i08(s, d):
    pts = _on_plane(s, d).select(F.col("ox").alias("x"), F.col("oy").alias("y"), "z")
    target = SPEC.with_(n_cols=60).cells(s).where("row between 20 and 40 and col between 20 and 50").select("row", "col")
    return out(interp.spline_surface(pts, target, smooth=1e-8), digits=1)


@query("I07_fill_plane", f"with {_HOLES} select r, c, round(cast(3 * c - 2 * r + 7 as double), 4) as value from holes")
def _i07b(s, d):
    plane = holes48(s, d).withColumn("value", F.when(F.col("value").isNotNull(), 3.0 * F.col("col") - 2.0 * F.col("row") + 7))
    return out(interp.fill_nodata(plane), digits=4)


# Distances and costs

_SPARSE = ", p as (select r, c, case when (r * 7 + c * 13) % 17 = 0 then 1 end as v from dem)"


@query("C01_distance", f"with {_DEM}{_SPARSE} select a.r, a.c, round(min(sqrt(cast((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) as double))), 6) as value from p a, p b where b.v is not null group by a.r, a.c")
def _c01(s, d):
    sparse = dem48(s, d).withColumn("value", F.when((F.col("row") * 7 + F.col("col") * 13) % 17 == 0, F.lit(1)))
    return out(cost.distance_transform(sparse), digits=6)


def _cost(s, d):
    friction = dem48(s, d).withColumn("value", (F.col("value") % 7 + 1) * 2)
    return cost.cost_distance(friction, streams48(s, d), straight=1000.0, diagonal=1414.0)


_RELAX = _DEM + ", f as (select r, c, (z % 7 + 1) * 2 as f from dem), o(dr, dc, l) as (values (-1, -1, 1414), (-1, 0, 1000), (-1, 1, 1414), (0, -1, 1000), (0, 1, 1000), (1, -1, 1414), (1, 0, 1000), (1, 1, 1414)), ce as (select a.r, a.c, b.r as nr, b.c as nc, o.l * (a.f + b.f) // 2 as w from f a cross join o join f b on b.r = a.r + o.dr and b.c = a.c + o.dc), best(r, c, cost) using key (r, c) as (select r, c, cast(0 as bigint) from dem where abs(c - 24) <= 1 union select ce.nr, ce.nc, cast(min(x.cost + ce.w) as bigint) from best x join ce on ce.r = x.r and ce.c = x.c left join recurring.best y on y.r = ce.nr and y.c = ce.nc where y.cost is null or x.cost + ce.w < y.cost group by ce.nr, ce.nc)"


@query("C02_cost_distance", f"with recursive {_RELAX} select r, c, cost as value from best")
def _c02(s, d):
    return out(_cost(s, d), F.col("value").cast("long"))


@query("C03_wetness")
def _c03(s, d):
    return out(cost.topographic_wetness(streams48(s, d), terrain.slope(dem48(s, d), 10.0, 10.0), SPEC), digits=4)


@query("C04_bank_width")
def _c04(s, d):
    return out(cost.bankfull_width_geometric(streams48(s, d), terrain.slope(dem48(s, d), 1000.0, 1000.0), SPEC, 20.0), digits=4)


@query("C06_region_width")
def _c06(s, d):
    return out(cost.width_transform(holes48(s, d), SPEC), digits=4)


@query("C07_bankfull_extent")
def _c07(s, d):
    w = streams48(s, d).withColumn("value", F.lit(45.0))
    return out(cost.bankfull_extent(w, w.withColumn("value", F.lit(700.0)), dem48(s, d), SPEC))


@query("C08_ring_growth")
def _c08(s, d):
    wide = dem48(s, d).withColumn("value", F.when(F.col("col") % 12 < 3, F.col("value")))
    return out(cost.expand_interpolate(wide), digits=4)


# Workflows


@query("R04_region", f"with {_HOLES}, m as (select max(z) as hi from holes) select r, c, round(case when z >= 20000 then cast(z - 20000 as double) / (hi - 20000) end, 6) as value from holes cross join m")
def _r04(s, d):
    return out(workflows.region_above(holes48(s, d), 20000.0), digits=6)


@query("R07_density", f"with {_DEM}, s as (select r, c from dem where abs(c - 24) <= 1) select a.r, a.c, round(count(*) / cast(29 as double), 6) as value from s a join s b on (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 9 group by a.r, a.c")
def _r07(s, d):
    return out(workflows.stream_density(streams48(s, d), SPEC, 30.0), digits=6)


@query("R08_connectivity", f"with {_HOLES}, t as (select g.r, g.c, cast(h.z + g.v + g.n as double) as x from g join holes h on g.r = h.r and g.c = h.c), q as (select quantile_cont(x, 0.333) as a, quantile_cont(x, 0.667) as b from t) select r, c, cast(case when x is null then null when x >= b then 2 when x >= a then 1 else 0 end as bigint) as value from t cross join q")
def _r08(s, d):
    g = grid48(s, d)
    layers = [holes48(s, d), g.select("row", "col", F.col("v").alias("value")), g.select("row", "col", F.col("n").alias("value"))]
    return out(workflows.connectivity([x.withColumn("value", F.col("value").cast("double")) for x in layers]), F.col("value").cast("long"))


@query("R10_reach_class", f"with {_HOLES} select r, c, cast(1000000 + coalesce(case when z is null then 0 else least(cast(floor(cast(z % 3000 as double) / 2) as bigint) + 1, 500) end, 0) * 1000 + coalesce(case when z is null then 0 else least(cast(floor(cast(z % 100 as double) / 2) as bigint) + 1, 45) end, 0) * 10 + 0 as bigint) as value from holes")
def _r10(s, d):
    return out(holes48(s, d), A.reach_class((F.col("value") % 100).cast("double"), (F.col("value") % 3000).cast("double"), F.lit(None).cast("int"), F.lit(1)))


def valley(s, d):
    """A valley with a stream that runs south, side slopes of a few degrees, noise, and precipitation."""
    side = F.abs(F.col("col") - 24)
    return grid48(s, d).select("row", "col", (200 - F.col("row") * 0.2 + side * 0.6 + (F.col("v") % 200) / 1000).alias("value"))


def _rain(s, d):
    return grid48(s, d).select("row", "col", (1000 + F.col("v") % 300).cast("double").alias("value"))


@query("R01_riparian_connectivity")
def _r01(s, d):
    chain = workflows.RiparianConnectivity(valley(s, d), SPEC)
    chain.extract_streams(20_000.0).calc_twi().define_region(740.0).calc_bankfull_width(_rain(s, d), spec=SPEC).calc_stream_slope().calc_stream_density(50.0)
    return out(chain.calc_connectivity(vector=False), F.col("value").cast("long"))


def stream_analysis_of_valley(s, d):
    """Not registered: on 48 x 48 cells it needs some hundred small jobs, more than two minutes on the machine of the tests."""
    lakes = grid48(s, d).select("row", "col", F.when((F.col("row") > 40) & (F.abs(F.col("col") - 24) < 3), 1.0).alias("value"))
    cover = grid48(s, d).select("row", "col", (F.col("v") % 3).cast("double").alias("value"))
    got = workflows.stream_analysis(valley(s, d), _rain(s, d), SPEC, lakes, 20_000.0, 0.0, {"tmin": _rain(s, d)}, cover, {1: "forest", 2: "field"})
    return got.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in got.dtypes])
