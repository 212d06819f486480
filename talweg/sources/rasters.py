"""Rasters on disk: Parquet cells by tile with a JSON sidecar, text points, and CSV tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.functions.algebra import masked
from talweg.plans.grid import SPARK_TYPE, GridSpec, infer_nodata, keys

#: Side of a tile, the unit of partitions on disk.
TILE = 256
CELLS = "band int, row int, col int, value double"


def from_cells(df: DataFrame, nodata: float | None = None, value: str = "value") -> DataFrame:
    """A lazy scan: nodata and NaN become NULL."""
    return df.select(*keys(df), masked(F.col(value), nodata).alias("value"))


def to_raster(cells: DataFrame, spec: GridSpec, path: str, tile: int = TILE) -> GridSpec:
    """Write cells by tile with the spec and statistics beside them.  Of a boolean raster only TRUE cells are stored, as 1."""
    boolean = dict(cells.dtypes)["value"] == "boolean"
    if boolean:
        cells, spec = cells.where("value").withColumn("value", F.lit(1)), spec.with_(dtype="uint8", nodata=float(infer_nodata("uint8")))
    out = cells if "band" in cells.columns else cells.withColumn("band", F.lit(1))
    out = out.select("band", "row", "col", F.col("value").cast(SPARK_TYPE[spec.dtype]).alias("value"), F.floor(F.col("row") / tile).cast("int").alias("tr"), F.floor(F.col("col") / tile).cast("int").alias("tc"))
    out.repartition("band", "tr", "tc").sortWithinPartitions("row", "col").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("band", "tr", "tc").parquet(f"{path}/cells")
    spark = cells.sparkSession
    stats = spark.read.parquet(f"{path}/cells").agg(F.min("value"), F.max("value"), F.avg("value"), F.stddev_pop("value")).first()
    names = ("min", "max", "mean", "std")
    side = spec.as_dict() | {"tile": tile, "stats": {n: None if v is None else float(v) for n, v in zip(names, stats)}}
    spark.createDataFrame([(json.dumps(side),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/spec")
    return spec


class Raster:
    """A stored raster: its spec, and windows of its cells."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        side = json.loads(spark.read.text(f"{path}/spec").first()[0])
        self.stats, self.tile = side.pop("stats"), side.pop("tile")
        self.spec = GridSpec(**{k: side[k] for k in GridSpec.__dataclass_fields__})

    def cells(self) -> DataFrame:
        return from_cells(self.spark.read.parquet(f"{self.path}/cells").select("band", "row", "col", "value"), self.spec.nodata)

    def window(self, rows: slice = slice(None), cols: slice = slice(None), bands: list[int] | None = None) -> DataFrame:
        """Cells of a window; whole tiles outside it are not read.  Outside the grid: IndexError."""
        r0, r1 = rows.start or 0, self.spec.n_rows if rows.stop is None else rows.stop
        c0, c1 = cols.start or 0, self.spec.n_cols if cols.stop is None else cols.stop
        if not (0 <= r0 < r1 <= self.spec.n_rows and 0 <= c0 < c1 <= self.spec.n_cols):
            raise IndexError("window outside the grid")
        if bands is not None and any(not 1 <= b <= self.spec.bands for b in bands):
            raise IndexError("no such band")
        t = self.tile
        df = self.spark.read.parquet(f"{self.path}/cells")
        df = df.where(F.col("tr").between(r0 // t, (r1 - 1) // t) & F.col("tc").between(c0 // t, (c1 - 1) // t) & F.col("row").between(r0, r1 - 1) & F.col("col").between(c0, c1 - 1))
        if bands is not None:
            df = df.where(F.col("band").isin(bands))
        return from_cells(df.select("band", "row", "col", "value"), self.spec.nodata)

    def write_window(self, cells: DataFrame) -> None:
        """Put cells into the stored raster: only the tiles that they touch are written again."""
        t = self.tile
        new = cells if "band" in cells.columns else cells.withColumn("band", F.lit(1))
        new = new.withColumn("tr", F.floor(F.col("row") / t).cast("int")).withColumn("tc", F.floor(F.col("col") / t).cast("int"))
        old = self.spark.read.parquet(f"{self.path}/cells")
        touched = old.join(new.select("band", "tr", "tc").distinct(), ["band", "tr", "tc"], "left_semi").join(new.select("band", "row", "col"), ["band", "row", "col"], "left_anti")
        kind = dict(old.dtypes)["value"]
        names = ["band", "row", "col", "value", "tr", "tc"]
        from talweg.plans.graph import cut

        merged = cut(touched.select(*names).unionByName(new.select(*names[:3], F.col("value").cast(kind).alias("value"), "tr", "tc")))
        merged.repartition("band", "tr", "tc").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("band", "tr", "tc").parquet(f"{self.path}/cells")


def empty(spark: SparkSession, spec: GridSpec, path: str) -> GridSpec:
    return to_raster(spec.cells(spark), spec, path)


def empty_like(spark: SparkSession, template: GridSpec, path: str, **overrides) -> GridSpec:
    return empty(spark, template.with_(**overrides), path)


def valid_index(cells: DataFrame) -> DataFrame:
    return cells.where("value is not null").select("value", *keys(cells))


def points(cells: DataFrame, spec: GridSpec, target_crs: str | None = None, band: int = 1) -> DataFrame:
    """(x, y, value) of the valid cells of one band, reprojected on request."""
    from talweg.plans.grid import transform_points

    own = cells.where(F.col("band") == band) if "band" in cells.columns else cells
    x, y = spec.x("col"), spec.y("row")
    if target_crs:
        x, y = transform_points(x, y, spec.crs, target_crs)
    return own.where("value is not null").select(x.alias("x"), y.alias("y"), "value")


def write_points_csv(pts: DataFrame, path: str) -> None:
    pts.select(*[F.format_string("%f", F.col(c).cast("double")).alias(c) for c in ("x", "y", "value")]).write.mode("overwrite").csv(path, header=True)


def geojson(pts: DataFrame) -> DataFrame:
    """One feature a row, as text."""
    f = "{\"type\": \"Feature\", \"geometry\": {\"type\": \"Point\", \"coordinates\": [%f, %f]}, \"properties\": {\"value\": %f}}"
    return pts.select(F.format_string(f, *[F.col(c).cast("double") for c in ("x", "y", "value")]).alias("value"))


def write_points_geojson(pts: DataFrame, path: str) -> None:
    geojson(pts).write.mode("overwrite").text(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True)


def read_skipping_corrupt(spark: SparkSession, path: str, spec: GridSpec) -> DataFrame:
    """The full grid; cells of files that cannot be read are NULL."""
    found = spark.read.option("ignoreCorruptFiles", "true").schema(CELLS).parquet(path)
    grid = spec.cells(spark).drop("value")
    return grid.join(found, ["band", "row", "col"], "left")


def ascii_grid(text: str, spark: SparkSession) -> tuple[DataFrame, GridSpec]:
    """An ESRI ASCII grid's text as cells and spec."""
    lines = text.split("\n")
    head = {k.lower(): float(v) for k, v in (x.split() for x in lines[:6])}
    csx = head["cellsize"]
    n_rows, n_cols = int(head["nrows"]), int(head["ncols"])
    spec = GridSpec(head["xllcorner"], head["yllcorner"] + n_rows * csx, csx, csx, n_rows, n_cols, nodata=head.get("nodata_value"))
    rows = [(r, c, float(v)) for r, x in enumerate(lines[6 : 6 + n_rows]) for c, v in enumerate(x.split())]
    return from_cells(spark.createDataFrame(rows, "row int, col int, value double"), spec.nodata), spec
