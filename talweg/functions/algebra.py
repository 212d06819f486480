"""Map algebra as column functions: NULL is nodata, and any operation on it gives NULL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def masked(value: Column, nodata: float | None = None) -> Column:
    """NULL for nodata and NaN."""
    out = F.when(~F.isnan(value.cast("double")), value)
    return out if nodata is None else F.when(value != F.lit(nodata), out)


def mask_invalid(value: Column) -> Column:
    """NULL for NaN and both infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def valid(value: Column) -> Column:
    """Whether a cell has a value."""
    return value.isNotNull()


def mask_where(condition: Column, value: Column) -> Column:
    return F.when(~F.coalesce(condition, F.lit(False)), value)


def filled(value: Column, by: float) -> Column:
    return F.coalesce(value, F.lit(by))


def where(condition: Column, if_true: Column, if_false: Column) -> Column:
    """The selected branch; NULL exactly where that branch is NULL."""
    return F.when(condition, if_true).otherwise(if_false)


def clip(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def divide(a: Column, b: Column) -> Column:
    """a / b; NULL where b is 0."""
    return F.try_divide(a, b)


def digitize(value: Column, bins: list[float]) -> Column:
    """Number of ascending bin edges at or below the value."""
    if list(bins) != sorted(bins):
        raise ValueError("bins must ascend")
    edges = F.array(*[F.lit(float(b)) for b in bins])
    return F.when(value.isNotNull(), F.size(F.filter(edges, lambda b: b <= value)))


def normalize(cells: DataFrame, in_range: tuple = ("min", "max"), out_range: tuple[float, float] = (0.0, 1.0), invert: bool = False, value: str = "value") -> DataFrame:
    """Clip to ``in_range`` (numbers, or the data's min and max), rescale, optionally upside down.  A constant raster becomes NULL."""
    found = cells.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    low = F.col("_lo") if in_range[0] == "min" else F.lit(float(in_range[0]))
    high = F.col("_hi") if in_range[1] == "max" else F.lit(float(in_range[1]))
    v = F.when(F.col(value).isNotNull(), F.least(F.greatest(F.col(value), low), high))
    x = F.try_divide(v - low, high - low)
    x = 1 - x if invert else x
    out = x * F.lit(float(out_range[1] - out_range[0])) + F.lit(float(out_range[0]))
    return cells.crossJoin(F.broadcast(found)).withColumn(value, out).drop("_lo", "_hi")


def class_code(stream: Column, width: Column, gradient: Column, lake: Column) -> Column:
    """stream 10**6 + width 10**3 + gradient 10 + lake."""
    return stream.cast("long") * 1_000_000 + width.cast("long") * 1_000 + gradient.cast("long") * 10 + lake.cast("long")


def cleaned(value: Column) -> Column:
    """0 for missing, negative, NaN and infinite values."""
    bad = value.isNull() | (value < 0) | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(value)


def precipitation_weight(accumulation: Column, precipitation: Column, most: float = 3000.0) -> Column:
    return accumulation * clip(precipitation, 0.0, most) / F.lit(most)


def bankfull_width(area: Column, precipitation: Column, coefficient: float = 0.042, area_exponent: float = 0.48, precipitation_exponent: float = 0.74) -> Column:
    """Power law of contributing area (km2) and mean annual precipitation (mm, used as cm)."""
    return F.lit(coefficient) * F.pow(area, F.lit(area_exponent)) * F.pow(precipitation / 10, F.lit(precipitation_exponent))


def bankfull_depth(width: Column, coefficient: float = 0.145, exponent: float = 0.607) -> Column:
    return F.lit(coefficient) * F.pow(width, F.lit(exponent))


def valley_confinement(width: Column, valley: Column, most: float = 1000.0) -> Column:
    return F.try_divide(clip(valley, 0.0, most), F.when(width > 0, width))


def bankfull_elevation(dem: Column, depth: Column, flood_factor: float = 1.0) -> Column:
    return dem + depth * F.lit(flood_factor)


def contributing_area(upstream: Column, csx: float, csy: float) -> Column:
    """km2; NULL for 0."""
    return F.nullif(upstream * F.lit(csx * csy / 1e6), F.lit(0.0))


def class_area(landcover: Column, key: int, csx: float, csy: float) -> Column:
    return F.when(landcover == F.lit(key), F.lit(csx * csy)).otherwise(F.when(landcover.isNotNull(), F.lit(0.0)))


def near_side(x1, y1, x2, y2, tx, ty):
    """Whether the test point lies on point 1's side of the line through point 2 at right angles to the way from point 1 to point 2, or on that line.

    Works on columns and on numbers.  Where both points are the same every point does.
    """
    return (tx - x2) * (x2 - x1) + (ty - y2) * (y2 - y1) <= 0


front_contains = near_side


def reach_class(gradient: Column, width: Column, lake: Column, stream: Column, gradient_step: float = 2.0, width_step: float = 2.0, widest: float = 1000.0) -> Column:
    """Class code of a stream cell; a missing gradient or width falls into class 0 of its breaks."""
    g = F.coalesce(digitize(gradient, [gradient_step * i for i in range(math.ceil(90 / gradient_step))]), F.lit(0))
    w = F.coalesce(F.when(width < 0, 0).when(width.isNotNull(), F.least(F.floor(width / width_step) + 1, F.lit(math.ceil(widest / width_step)))).cast("long"), F.lit(0))
    return class_code(stream, w, g, F.coalesce(lake.cast("int"), F.lit(0)))


def fit_metrics(df: DataFrame, observed: Column, predicted: Column) -> DataFrame:
    """Sum of squared errors, mean absolute error and R2."""
    d = df.select(observed.cast("double").alias("o"), predicted.cast("double").alias("p"))
    return d.agg(F.sum(F.pow(F.col("o") - F.col("p"), 2)).alias("sse"), F.avg(F.abs(F.col("o") - F.col("p"))).alias("mae"), (1 - F.sum(F.pow(F.col("o") - F.col("p"), 2)) / F.nullif(F.var_pop("o") * F.count("o"), F.lit(0.0))).alias("r2"))
