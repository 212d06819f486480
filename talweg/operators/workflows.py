"""Workflows: riparian connectivity and stream analysis."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.functions import algebra as A
from talweg.operators.cost import topographic_wetness, valley_width
from talweg.operators.focal import raster_filter
from talweg.operators.hydro import FlowAccumulation, extract_streams, fill_depressions, flow_direction_accumulation, multiple_flow
from talweg.operators.interp import interpolate_into_region
from talweg.operators.network import flow_labels, reach_attributes, stream_topology
from talweg.operators.terrain import mean_radiation, ruggedness, slope, stream_slope
from talweg.plans.graph import cut
from talweg.plans.graph import percentiles as exact_percentiles
from talweg.plans.grid import GridSpec, disk_kernel

LAYERS = ("twi", "bankfull_width", "stream_slope", "stream_density")


def region_above(twi: DataFrame, cutoff: float = 745.0) -> DataFrame:
    """(v - cutoff) / (max - cutoff) of cells at or above the cutoff; NULL below."""
    top = twi.agg(F.max("value").alias("_top"))
    x = F.try_divide(F.col("value") - cutoff, F.col("_top") - F.lit(cutoff))
    return twi.crossJoin(F.broadcast(top)).select("row", "col", F.when(F.col("value") >= cutoff, x).alias("value"))


def stream_density(streams: DataFrame, spec: GridSpec, sample_distance: float = 500.0) -> DataFrame:
    """Stream cells in a disk over the disk's cells, at stream cells."""
    kernel = disk_kernel(sample_distance, spec.csx, spec.csy)
    cells = sum(map(sum, kernel))
    ones = streams.select("row", "col", F.when(F.col("value").isNotNull(), F.lit(1.0)).alias("value"))
    return raster_filter(ones, kernel, "sum").select("row", "col", (F.col("value") / cells).alias("value"))


def connectivity(layers: list[DataFrame], percentiles: tuple[float, ...] | None = (33.3, 66.7)) -> DataFrame:
    """Sum of the layers (NULL where one is), or its class by the data's percentiles."""
    if percentiles is not None and (any(not 0 <= p <= 100 for p in percentiles) or list(percentiles) != sorted(percentiles)):
        raise ValueError("percentiles must ascend from 0 to 100")
    if not layers:
        raise ValueError("no layers")
    stacked = None
    for d in layers:
        one = d.select("row", "col", "value")
        stacked = one if stacked is None else stacked.unionByName(one)
    total = stacked.groupBy("row", "col").agg(F.sum("value").alias("value"), F.count("value").alias("n"))
    total = total.select("row", "col", F.when(F.col("n") == len(layers), F.col("value")).alias("value"))
    if percentiles is None:
        return total
    total = cut(total)
    cuts = [c for c in exact_percentiles(total, "value", [p / 100 for p in percentiles]) if c is not None]
    value = F.when(F.col("value").isNotNull(), F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c <= F.col("value"))))
    return total.select("row", "col", value.alias("value"))


@dataclass
class RiparianConnectivity:
    """Builds its layers one after the other; a layer that is missing raises AttributeError.

    Layers from outside come with their spec, which must match the DEM's.
    """

    dem: DataFrame
    spec: GridSpec
    made: dict[str, DataFrame] = field(default_factory=dict)

    def layer(self, name: str) -> DataFrame:
        if name not in self.made:
            raise AttributeError(f"{name} has not been made")
        return self.made[name]

    def verify_source(self, spec: GridSpec) -> None:
        """ValueError if a layer's grid is not the DEM's."""
        self.spec.require(spec)

    def put(self, name: str, layer: DataFrame, spec: GridSpec | None = None) -> RiparianConnectivity:
        if spec is not None:
            self.verify_source(spec)
        self.made[name] = layer
        return self

    def extract_streams(self, min_ws_area: float = 1e6, min_stream_length: float = 0.0) -> RiparianConnectivity:
        filled = cut(fill_depressions(self.dem))
        accumulation = cut(multiple_flow(filled))
        streams, direction = extract_streams(filled, self.spec.csx, self.spec.csy, min_ws_area, min_stream_length, accumulation)
        if "slope" not in self.made:
            self.put("slope", cut(slope(self.dem, self.spec.csx, self.spec.csy)))
        return self.put("streams", cut(streams)).put("flow_direction", direction)

    def calc_twi(self, max_cost: float = 750.0) -> RiparianConnectivity:
        return self.put("twi", cut(topographic_wetness(self.layer("streams"), self.layer("slope"), self.spec, max_cost)))

    def define_region(self, twi_cutoff: float = 745.0) -> RiparianConnectivity:
        return self.put("region", cut(region_above(self.layer("twi"), twi_cutoff)))

    def _spread(self, source: DataFrame) -> DataFrame:
        return cut(interpolate_into_region(source, self.layer("region"), self.spec.csx, self.spec.csy))

    def calc_bankfull_width(self, precipitation: DataFrame, cutoff: float = 10.0, spec: GridSpec | None = None) -> RiparianConnectivity:
        if spec is not None:
            self.verify_source(spec)
        flow = FlowAccumulation(self.layer("flow_direction"))
        area = flow.contributing_area(self.spec.csx, self.spec.csy).withColumnRenamed("value", "a")
        joined = area.join(flow.calculate(precipitation, "mean").withColumnRenamed("value", "p"), ["row", "col"])
        width = joined.join(self.layer("streams").select("row", "col"), ["row", "col"], "left_semi").select("row", "col", A.bankfull_width(F.col("a"), F.col("p")).alias("value"))
        return self.put("bankfull_width", self._spread(A.normalize(cut(width), (0, cutoff))))

    def calc_stream_slope(self, cutoff: float = 15.0) -> RiparianConnectivity:
        s = cut(stream_slope(self.dem, self.layer("streams"), self.spec))
        return self.put("stream_slope", self._spread(A.normalize(s, (0, cutoff), invert=True)))

    def calc_stream_density(self, sample_distance: float = 500.0, cutoff: float = 2e5) -> RiparianConnectivity:
        d = cut(stream_density(self.layer("streams"), self.spec, sample_distance))
        return self.put("stream_density", self._spread(A.normalize(d, (0, cutoff / self.spec.avg_cs**2))))

    def calc_connectivity(self, attributes: tuple[str, ...] = LAYERS, quantize: bool = True, percentiles: tuple[float, ...] = (33.3, 66.7), vector: bool = True) -> DataFrame:
        if not attributes or any(a not in LAYERS for a in attributes):
            raise ValueError(f"attributes are some of {LAYERS}")
        if vector and not quantize:
            raise ValueError("only classes can be made a vector")
        layers = [self.layer("region" if a == "twi" else a) for a in attributes]
        out = connectivity(layers, percentiles if quantize else None)
        out = out.join(self.layer("region").where("value is not null").select("row", "col"), ["row", "col"], "left_semi")
        if not vector:
            return out
        from talweg.operators.resample import vectorize

        return vectorize(out, self.spec)


def stream_analysis(
    dem: DataFrame, precipitation: DataFrame, spec: GridSpec, lakes: DataFrame | None = None, min_area: float = 1e6, min_length: float = 25.0,
    climate: dict[str, DataFrame] | None = None, landcover: DataFrame | None = None, landcover_mapping: dict[int, str] | None = None,
    gradient_focal_mean_dist: float = 25.0, latitude: float | None = None, valley_max_cost: float = 1.0,
) -> DataFrame:
    """One row per reach with topology and attributes; all rasters lie on the DEM's grid.

    ``lakes`` are cells; ``climate`` maps attribute names to rasters that get
    their upstream mean; ``landcover_mapping`` names the classes whose upstream
    area (square map units) becomes an attribute.  All upstream aggregates come
    from one pass over the flow, and all attributes from one join and grouping.
    """
    if landcover is not None and not landcover_mapping:
        raise ValueError("landcover needs landcover_mapping")
    on = ["row", "col"]
    named = lambda d, n: d.select("row", "col", F.col("value").alias(n))
    direction, accumulation = flow_direction_accumulation(dem, spec.csx, spec.csy)
    lake = lakes if lakes is not None else dem.select("row", "col", F.lit(None).cast("double").alias("value"))
    weighted = named(accumulation, "a").join(named(precipitation, "p"), on).join(named(lake, "k"), on, "left")
    weighted = weighted.select("row", "col", F.when(F.col("k").isNotNull(), 0.0).otherwise(A.precipitation_weight(F.col("a"), F.col("p"))).alias("value"))
    streams, direction = extract_streams(dem, spec.csx, spec.csy, min_area, min_length, cut(weighted), direction=direction)
    streams = cut(streams)
    steep = cut(slope(dem, spec.csx, spec.csy))
    gradient = cut(stream_slope(dem, streams, spec, "percent", focal_mean_dist=gradient_focal_mean_dist))
    # Everything upstream, at stream cells.
    wide = named(dem, "elev").join(named(mean_radiation(dem, spec=spec, latitude=latitude), "solrad"), on, "left").join(named(ruggedness(dem), "tri"), on, "left")
    wide = wide.join(named(steep, "slope"), on, "left").join(named(precipitation, "precip"), on, "left")
    wanted = {"ws_mean_elev": ("elev", "mean"), "ws_mean_solrad": ("solrad", "mean"), "ws_sum_solrad": ("solrad", "sum"), "ws_mean_tri": ("tri", "mean"), "ws_mean_slope": ("slope", "mean"), "ws_mean_precip_mm": ("precip", "mean"), "_cells": ("_one", "sum")}
    for name, layer in (climate or {}).items():
        wide = wide.join(named(layer, f"_{name}"), on, "left")
        wanted[f"ws_mean_{name}"] = (f"_{name}", "mean")
    if landcover is not None:
        wide = wide.join(named(landcover, "_class"), on, "left")
        for key, name in landcover_mapping.items():
            wide = wide.withColumn(f"_area_{key}", A.class_area(F.col("_class"), key, spec.csx, spec.csy))
            wanted[name] = (f"_area_{key}", "sum")
    up = FlowAccumulation(direction).calculate_all(cut(wide.withColumn("_one", F.lit(1.0))), **wanted)
    up = cut(up.join(streams.select(*on), on, "left_semi").withColumn("area_km2", A.contributing_area(F.col("_cells"), spec.csx, spec.csy)).drop("_cells"))
    width = up.select("row", "col", A.bankfull_width(F.col("area_km2"), F.col("ws_mean_precip_mm"), 0.196, 0.280, 0.355).alias("bankfull_width"))
    valley = valley_width(streams, steep, spec, valley_max_cost)
    cells = named(streams, "_s").join(named(gradient, "gradient"), on, "left").join(width, on, "left").join(named(valley, "valley_width"), on, "left")
    cells = cells.join(named(lake, "_lake"), on, "left").join(named(dem, "elev"), on, "left").join(up, on, "left")
    cells = cut(cells.withColumn("water", F.when(F.col("_lake").isNotNull(), 1).otherwise(0)).withColumn("confinement", A.valley_confinement(F.col("bankfull_width"), F.col("valley_width"))))
    classes = cut(cells.select("row", "col", A.reach_class(F.col("gradient"), F.col("bankfull_width"), F.col("water") == 1, F.lit(1)).alias("value")))
    reaches = cut(flow_labels(classes, direction))
    features, vertices = stream_topology(reaches, direction, spec)
    stats = {"in_area_km2": ("area_km2", "min"), "out_area_km2": ("area_km2", "max"), "elev_min": ("elev", "min"), "elev_max": ("elev", "max"), "elev_mean": ("elev", "mean"), "water": ("water", "max"), "confinement": ("confinement", "mean")}
    stats |= {n: (n, "mean") for n in ("gradient", "bankfull_width", "valley_width", *(w for w in wanted if w != "_cells"))}
    attributes = reach_attributes(vertices, cells, **stats).withColumn("waterbody", F.col("water") == 1).drop("water")
    return features.join(attributes, "rid", "left")
