"""Grid metadata: a raster is a GridSpec on the driver and a table of cells (band, row, col, value).

Nodata is NULL or an absent row.  Rows grow downward; a cell's centre is
x = left + (col + 1/2) csx, y = top - (row + 1/2) csy.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("band", "row", "col")
#: D8 codes, counter-clockwise from north-east, as (row, column) offsets: fixed values.
D8 = {1: (-1, 1), 2: (-1, 0), 3: (-1, -1), 4: (0, -1), 5: (1, -1), 6: (1, 0), 7: (1, 1), 8: (0, 1)}
#: Default nodata value of each type: fixed values.
NODATA: dict[str, float | int | bool] = {
    "float64": -1.7976931348623157e308,
    "float32": -3.4028234663852886e38,
    "int64": -(2**63), "uint64": 2**64 - 1,
    "int32": -(2**31), "uint32": 2**32 - 1,
    "int16": -(2**15), "uint16": 2**16 - 1,
    "int8": -(2**7), "uint8": 2**8 - 1,
    "bool": False,
}
#: Column type that holds every value of a raster type.
SPARK_TYPE = {"float64": "double", "float32": "float", "int64": "bigint", "uint64": "decimal(20,0)", "int32": "int", "uint32": "bigint", "int16": "smallint", "uint16": "int", "int8": "tinyint", "uint8": "smallint", "bool": "boolean"}


def infer_nodata(value: object) -> float | int | bool:
    """Nodata for a type name, a Python scalar or anything with a dtype."""
    if isinstance(value, bool):
        name = "bool"
    elif isinstance(value, int):
        name = "int64"
    elif isinstance(value, float):
        name = "float64"
    else:
        name = str(getattr(value, "dtype", value))
    if name not in NODATA:
        raise ValueError(f"no nodata value for {value!r}")
    return NODATA[name]


@dataclass(frozen=True)
class GridSpec:
    left: float
    top: float
    csx: float
    csy: float
    n_rows: int
    n_cols: int
    crs: str = ""
    bands: int = 1
    dtype: str = "float64"
    nodata: float | None = None

    def __post_init__(self):
        if self.csx <= 0 or self.csy <= 0 or self.n_rows < 1 or self.n_cols < 1 or self.bands < 1:
            raise ValueError("cell sizes and shape must be positive")

    @property
    def right(self) -> float:
        return self.left + self.n_cols * self.csx

    @property
    def bottom(self) -> float:
        return self.top - self.n_rows * self.csy

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.bands, self.n_rows, self.n_cols

    @property
    def bbox(self) -> tuple[float, float, float, float]:
        return self.left, self.bottom, self.right, self.top

    @property
    def avg_cs(self) -> float:
        return (self.csx + self.csy) / 2

    def with_(self, **changes) -> GridSpec:
        return replace(self, **changes)

    def as_dict(self) -> dict:
        return asdict(self) | {"right": self.right, "bottom": self.bottom, "ndim": 3}

    def matches(self, other: GridSpec, tolerance: float = 1e-6) -> bool:
        """Same shape and CRS, and the six georeferencing numbers agree."""
        names = ("left", "top", "right", "bottom", "csx", "csy")
        close = all(math.isclose(getattr(self, n), getattr(other, n), rel_tol=1e-5, abs_tol=tolerance) for n in names)
        return self.shape == other.shape and self.crs == other.crs and close

    def require(self, other: GridSpec) -> None:
        if not self.matches(other):
            raise ValueError("rasters are not aligned")

    def x(self, col: Column | str) -> Column:
        return F.lit(self.left) + (_col(col) + 0.5) * F.lit(self.csx)

    def y(self, row: Column | str) -> Column:
        return F.lit(self.top) - (_col(row) + 0.5) * F.lit(self.csy)

    def row(self, y: Column | str) -> Column:
        return F.floor((F.lit(self.top) - _col(y)) / F.lit(self.csy)).cast("int")

    def col(self, x: Column | str) -> Column:
        return F.floor((_col(x) - F.lit(self.left)) / F.lit(self.csx)).cast("int")

    def area_to_cells(self, area: float) -> int:
        return math.ceil(area / (self.csx * self.csy))

    def cells(self, spark: SparkSession) -> DataFrame:
        """The empty raster: every cell with a null value."""
        n = self.n_rows * self.n_cols
        cells = spark.range(self.bands * n).select(
            (F.floor(F.col("id") / n) + 1).cast("int").alias("band"),
            F.floor(F.pmod("id", F.lit(n)) / self.n_cols).cast("int").alias("row"),
            F.pmod("id", F.lit(self.n_cols)).cast("int").alias("col"),
        )
        return cells.withColumn("value", F.lit(None).cast("double"))


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def keys(cells: DataFrame) -> list[str]:
    return [k for k in KEYS if k in cells.columns]


def disk_kernel(distance: float, csx: float, csy: float) -> list[list[bool]]:
    """Cells within ``distance`` of the centre; an even side puts the centre up and left."""
    rows, cols = (math.ceil(round(2 * distance / cs)) + 1 for cs in (csy, csx))
    mid_r, mid_c = (rows - 1) // 2, (cols - 1) // 2
    return [[math.hypot((r - mid_r) * csy, (c - mid_c) * csx) <= distance for c in range(cols)] for r in range(rows)]


def kernel_offsets(kernel: tuple[int, int] | list[list[bool]]) -> list[tuple[int, int]]:
    """Offsets (row, column) of a kernel's cells, in row-major order, from its anchor ceil((size - 1) / 2)."""
    if isinstance(kernel, tuple):
        if len(kernel) != 2:
            raise ValueError("a kernel's shape has two numbers")
        kernel = [[True] * kernel[1] for _ in range(kernel[0])]
    if not kernel or not isinstance(kernel[0], list | tuple):
        raise ValueError("a kernel has two dimensions")
    top, left = math.ceil((len(kernel) - 1) / 2), math.ceil((len(kernel[0]) - 1) / 2)
    return [(r - top, c - left) for r, line in enumerate(kernel) for c, on in enumerate(line) if on]


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:4326 to EPSG:3857."""
    r = F.lit(6378137.0)
    return r * F.radians(lon), r * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def geographic(x: Column, y: Column) -> tuple[Column, Column]:
    """EPSG:3857 to EPSG:4326."""
    r = F.lit(6378137.0)
    return F.degrees(x / r), F.degrees(2 * F.atan(F.exp(y / r)) - F.lit(math.pi / 2))


def transform_points(x: Column, y: Column, source: str | int, target: str | int) -> tuple[Column, Column]:
    pair = tuple(str(s).upper().removeprefix("EPSG:") for s in (source, target))
    if pair[0] == pair[1]:
        return x, y
    if pair == ("4326", "3857"):
        return web_mercator(x, y)
    if pair == ("3857", "4326"):
        return geographic(x, y)
    raise NotImplementedError(f"no transformation from {source} to {target}")


def transform_bounds(spark: SparkSession, bounds: tuple[float, float, float, float], source: str | int, target: str | int) -> tuple[float, float, float, float]:
    """Smallest box around the four transformed corners of (left, bottom, right, top)."""
    l, b, r, t = bounds
    corners = spark.createDataFrame([(l, b), (l, t), (r, b), (r, t)], "x double, y double")
    x, y = transform_points(F.col("x"), F.col("y"), source, target)
    return tuple(corners.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first())
