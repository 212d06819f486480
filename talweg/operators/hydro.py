"""Flow routing, accumulation and basins.

Directions are D8 codes 1-8, counter-clockwise from north-east; 0 marks an
outlet or pit.  Upstream aggregates and outlets are solved inside tiles; only
the cells where water crosses from tile to tile form a graph, which pointer
doubling solves in as many rounds as the logarithm of the tiles that the
longest path crosses.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.operators.focal import NINE
from talweg.plans.graph import cut, numbered, pointer_doubling
from talweg.plans.grid import D8, GridSpec
from talweg.plans.tiles import TILE, column, on_tiles, shifts, spread, tiled

#: Cells are numbered row * WIDTH + col.
WIDTH = 1 << 31
EIGHT = [o for o in NINE if o != (0, 0)]
_ONE = (1, 1, 1, 1)


def _id(row: str = "row", col: str = "col"):
    return F.col(row).cast("long") * WIDTH + F.col(col)


def _cells(df: DataFrame) -> DataFrame:
    return df.withColumn("row", F.floor(F.col("id") / WIDTH).cast("int")).withColumn("col", F.pmod("id", F.lit(WIDTH)).cast("int"))


def flow_direction(dem: DataFrame, csx: float = 1.0, csy: float = 1.0, flats: bool = False, tile: int = TILE) -> DataFrame:
    """(row, col, value): code of the steepest descent, drop over distance; ties to the smaller code; 0 without one.

    With ``flats`` cells of a flat, as filled depressions are, drain along the
    shortest way over cells of their level to one that has a lower neighbour or
    lies at the edge of the data.
    """
    way = None

    def ring(static: np.ndarray, moving: np.ndarray, here: np.ndarray) -> None:
        z, steps = static[0], moving[0]
        inner = z[1:-1, 1:-1]
        with np.errstate(invalid="ignore"):
            near = list(shifts(z, EIGHT, _ONE))
            out = np.any([n < inner for n in near], axis=0) | np.any([np.isnan(n) for n in near], axis=0)
            steps[1:-1, 1:-1] = np.where(np.isnan(inner), np.nan, np.where(out, 0, steps[1:-1, 1:-1]))
            level = [n == inner for n in near]
            while True:
                best = np.full(inner.shape, np.inf)
                for same, n in zip(level, shifts(steps, EIGHT, _ONE)):
                    np.fmin(best, np.where(same, n + 1, np.inf), out=best)
                old = steps[1:-1, 1:-1]
                better = ~np.isnan(inner) & (best < np.where(np.isnan(old), np.inf, old))
                if not better.any():
                    return
                steps[1:-1, 1:-1] = np.where(better, best, old)

    if flats:
        way = cut(spread(dem.select("row", "col", "value", F.lit(None).cast("double").alias("steps")), ["value"], ["steps"], 1, ring, {"value": "double", "steps": "double"}, tile))

    def run(a: np.ndarray, here: np.ndarray) -> list[np.ndarray]:
        z = a[0, 1:-1, 1:-1]
        best, code = np.zeros(z.shape), np.zeros(z.shape)
        with np.errstate(invalid="ignore"):
            for c in sorted(D8):
                r, k = D8[c]
                drop = (z - next(shifts(a[0], [D8[c]], _ONE))) / math.hypot(r * csy, k * csx)
                code = np.where(drop > best, c, code)
                best = np.where(drop > best, drop, best)
            if flats:
                least = a[1, 1:-1, 1:-1]
                for c in sorted(D8):
                    n, steps = (next(shifts(x, [D8[c]], _ONE)) for x in a)
                    on = (best == 0) & (n == z) & (steps < least)
                    code, least = np.where(on, c, code), np.where(on, steps, least)
        return [np.where(np.isnan(z), np.nan, code)]

    return on_tiles(way if flats else dem, ["value", "steps"] if flats else ["value"], _ONE, run, {"value": "int"}, tile)


def fill_depressions(dem: DataFrame, tile: int = TILE) -> DataFrame:
    """Lowest level from which each cell drains over its neighbours to the edge of the data."""

    def level(static: np.ndarray, moving: np.ndarray, here: np.ndarray) -> None:
        z, known = static[0][1:-1, 1:-1], moving[0]
        rim = np.any([np.isnan(n) for n in shifts(static[0], EIGHT, _ONE)], axis=0)
        old = known[1:-1, 1:-1]
        known[1:-1, 1:-1] = np.where(np.isnan(z), np.nan, np.where(rim, z, old))
        while True:
            low = np.full(z.shape, np.inf)
            for n in shifts(known, EIGHT, _ONE):
                np.fmin(low, n, out=low)
            old = known[1:-1, 1:-1]
            with np.errstate(invalid="ignore"):
                new = np.maximum(z, low)
                better = ~np.isnan(z) & np.isfinite(low) & (new < np.where(np.isnan(old), np.inf, old))
            if not better.any():
                return
            known[1:-1, 1:-1] = np.where(better, new, old)

    start = dem.select("row", "col", "value", F.lit(None).cast("double").alias("level"))
    return spread(start, ["value"], ["level"], 1, level, {"level": "double"}, tile).withColumnRenamed("level", "value")


def edges(direction: DataFrame) -> DataFrame:
    """(id, next): cells and the cell each drains into, NULL at outlets and off the grid."""
    dr = F.create_map(*[F.lit(x) for c, (r, _) in D8.items() for x in (c, r)])
    dc = F.create_map(*[F.lit(x) for c, (_, k) in D8.items() for x in (c, k)])
    code = F.col("value").cast("int")
    cells = direction.where("value is not null")
    to = F.when(code.between(1, 8), (F.col("row") + F.element_at(dr, code)).cast("long") * WIDTH + F.col("col") + F.element_at(dc, code))
    rows = cells.select(_id().alias("id"), to.alias("to"))
    there = cells.select(_id().alias("next"))
    return rows.join(there, F.col("to") == F.col("next"), "left").select("id", "next")


class _Tile:
    """Flow inside one tile: levels of cells from the heads down."""

    def __init__(self, code: np.ndarray, tile: int):
        code = np.where(np.isnan(code), -1, code).astype(np.int64)
        self.valid = code >= 0
        r, c = np.indices(code.shape)
        dr, dc = np.zeros(9, np.int64), np.zeros(9, np.int64)
        for k, (a, b) in D8.items():
            dr[k], dc[k] = a, b
        flows = (code >= 1) & (code <= 8)
        k = np.where(flows, code, 0)
        self.to_r, self.to_c = r + dr[k], c + dc[k]
        inside = flows & (self.to_r >= 0) & (self.to_r < tile) & (self.to_c >= 0) & (self.to_c < tile)
        self.out = (flows & ~inside & self.valid).ravel()
        n = code.size
        self.next = np.where(inside, self.to_r * tile + self.to_c, -1).ravel()
        own = self.valid.ravel()
        self.next[self.next >= 0] = np.where(own[self.next[self.next >= 0]], self.next[self.next >= 0], -1)
        self.next[~own] = -1
        waits = np.bincount(self.next[self.next >= 0], minlength=n)
        front, done, self.levels = np.flatnonzero(own & (waits == 0)), 0, []
        while len(front):
            self.levels.append(front)
            done += len(front)
            to = self.next[front]
            to = to[to >= 0]
            np.subtract.at(waits, to, 1)
            to = np.unique(to)
            front = to[waits[to] == 0]
        if done != own.sum():
            raise RuntimeError("flow runs in a circle")

    def gather(self, layer: np.ndarray, how: str) -> None:
        """Aggregate down the levels, in place."""
        at = {"sum": np.add.at, "min": np.minimum.at, "max": np.maximum.at}[how]
        for front in self.levels:
            f = front[self.next[front] >= 0]
            at(layer, self.next[f], layer[f])

    def spread_up(self, end: np.ndarray, *along: np.ndarray) -> None:
        """From the last cell of each way up: who it is, and sums along the way."""
        for front in reversed(self.levels):
            f = front[self.next[front] >= 0]
            end[f] = end[self.next[f]]
            for x in along:
                x[f] += x[self.next[f]]


_NOTHING = {"sum": 0.0, "min": np.inf, "max": -np.inf}


def drain(direction: DataFrame, values: DataFrame | None = None, sums: dict[str, str] | None = None, csx: float = 1.0, csy: float = 1.0, tile: int = TILE) -> DataFrame:
    """(row, col, root, steps, length, sums...) of every cell with a direction.

    ``root`` is the number of the cell where its water ends (no code 1-8, or no
    cell there), ``steps`` and ``length`` the way to it, and ``sums`` aggregates
    (``sum``, ``min``, ``max``; NULL values add nothing) of columns of ``values``
    over all cells upstream, the cell itself included, as doubles.
    """
    sums = sums or {}
    rows = direction.where("value is not null").select("row", "col", F.col("value").cast("double").alias("code"))
    if sums:
        rows = rows.join(values.select("row", "col", *sums), ["row", "col"], "left")
    names = ["code", *sums]
    span = tile * tile

    def pack(t: pa.Table) -> pa.Table:
        a = np.full((len(names), tile, tile), np.nan)
        r, c = t.column("row").to_numpy() % tile, t.column("col").to_numpy() % tile
        for i, n in enumerate(names):
            a[i, r, c] = t.column(n).to_numpy()
        return pa.table({"tr": t.column("tr").slice(0, 1), "tc": t.column("tc").slice(0, 1), "blob": pa.array([a.tobytes()], pa.binary())})

    inputs = rows.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *[F.col(n).cast("double").alias(n) for n in names])
    tiles = cut(tiled(inputs, tile, (0, 0, 0, 0)).groupBy("tr", "tc").applyInArrow(pack, "tr int, tc int, blob binary"))

    def numbers(tr: int, tc: int, cells: np.ndarray) -> np.ndarray:
        return (tr * tile + cells // tile) * WIDTH + tc * tile + cells % tile

    def load(tr: int, tc: int, blob: bytes) -> tuple[_Tile, dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Flow, values, each cell's steps and length inside the tile, and the length of its own step."""
        a = np.frombuffer(blob).reshape(len(names), tile, tile)
        flow = _Tile(a[0], tile)
        layers = {n: np.where(np.isnan(a[i]), _NOTHING[sums[n]], a[i]).ravel() for i, n in enumerate(names) if i}
        code = np.where(np.isnan(a[0]), 0, a[0]).astype(int).ravel()
        size = np.zeros(256)
        for k, (r, c) in D8.items():
            size[k] = math.hypot(r * csy, c * csx)
        length = np.where((code >= 1) & (code <= 8), size[np.clip(code, 0, 255)], 0.0)
        return flow, layers, np.where(flow.next >= 0, 1, 0), np.where(flow.next >= 0, length, 0.0), length

    border = np.zeros((tile, tile), bool)
    border[[0, -1], :] = border[:, [0, -1]] = True
    edge = np.flatnonzero(border.ravel())
    link_schema = ", ".join(["id long", "term long", "steps long", "length double", "to long", "cross double", *(f"{n} double" for n in sums)])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Border cells with the end of their way inside the tile; those that leave it with their target and what they gather."""
        for batch in batches:
            for i in range(len(batch)):
                tr, tc = (batch.column(k)[i].as_py() for k in (0, 1))
                try:
                    flow, layers, steps, length, whole = load(tr, tc, batch.column(2)[i].as_buffer())
                except RuntimeError:  # the driver raises it
                    bad = [pa.array([-1], pa.int64()), pa.array([-1], pa.int64()), pa.array([0], pa.int64()), pa.array([0.0]), pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.float64())] * (1 + len(sums))]
                    yield pa.RecordBatch.from_arrays(bad, [x.split()[0] for x in link_schema.split(", ")])
                    continue
                for n, layer in layers.items():
                    flow.gather(layer, sums[n])
                end = np.arange(span)
                flow.spread_up(end, steps, length)
                own = edge[flow.valid.ravel()[edge]]
                to = (tr * tile + flow.to_r.ravel()[own]) * WIDTH + tc * tile + flow.to_c.ravel()[own]
                out = flow.out[own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers(tr, tc, own)), pa.array(numbers(tr, tc, end[own])), pa.array(steps[own].astype(np.int64)), pa.array(length[own]), pa.array(to, mask=~out), pa.array(whole[own], mask=~out), *(pa.array(layers[n][own], mask=~out) for n in sums)],
                    [x.split()[0] for x in link_schema.split(", ")],
                )

    met = cut(tiles.mapInArrow(links, link_schema))
    exits = met.where("to is not null")
    crossing, least = met.agg(F.max(F.col("to").isNotNull()), F.min("term")).first()
    if least == -1:
        raise RuntimeError("flow runs in a circle")
    state = tiles
    gone = "struct<cell:int,root:long,steps:long,length:double>"
    got = "struct<cell:int" + "".join(f",{n}:double" for n in sums) + ">"
    if crossing:
        entry = met.select(F.col("id").alias("to"), F.col("term").alias("next"), (F.col("steps") + 1).alias("steps"), F.col("length").alias("inner"))
        nodes = exits.select("id", "to", "cross", *sums).join(entry, "to", "left")
        nodes = cut(nodes.select("id", "next", "to", F.when(F.col("next").isNotNull(), F.col("steps")).otherwise(0).cast("long").alias("steps"), F.when(F.col("next").isNotNull(), F.col("cross") + F.col("inner")).otherwise(0.0).alias("length"), *sums))
        solved = cut(pointer_doubling(nodes.select("id", "next", "steps", "length", *sums), sums, ("steps", "length")))
        place = lambda c: (F.floor(F.floor(F.col(c) / WIDTH) / tile).cast("int").alias("tr"), F.floor(F.pmod(c, F.lit(WIDTH)) / tile).cast("int").alias("tc"), (F.pmod(F.floor(F.col(c) / WIDTH), F.lit(tile)) * tile + F.pmod(F.pmod(c, F.lit(WIDTH)), F.lit(tile))).cast("int").alias("cell"))
        leave = solved.select(*place("id"), "root", "steps", "length").groupBy("tr", "tc").agg(F.collect_list(F.struct("cell", "root", "steps", "length")).alias("gone"))  # at most a tile's border
        state = state.join(leave, ["tr", "tc"], "left")
        if sums:
            merge = {"sum": F.sum, "min": F.min, "max": F.max}
            enter = solved.select("id", *sums).join(nodes.where("next is not null").select("id", "to"), "id").groupBy("to").agg(*[merge[h](n).alias(n) for n, h in sums.items()])
            enter = enter.select(*place("to"), *sums).groupBy("tr", "tc").agg(F.collect_list(F.struct("cell", *sums)).alias("got"))
            state = state.join(enter, ["tr", "tc"], "left")
    state = state.select("tr", "tc", "blob", *(F.col(n) if n in state.columns else F.lit(None).cast(f"array<{k}>").alias(n) for n, k in (("gone", gone), ("got", got))))
    schema = ", ".join(["row int", "col int", "root long", "steps long", "length double", *(f"{n} double" for n in sums)])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                tr, tc = (batch.column(k)[i].as_py() for k in (0, 1))
                flow, layers, steps, length, _ = load(tr, tc, batch.column(2)[i].as_buffer())
                for x in batch.column(4)[i].as_py() or ():
                    for n, how in sums.items():
                        layer = layers[n]
                        layer[x["cell"]] = {"sum": np.add, "min": np.minimum, "max": np.maximum}[how](layer[x["cell"]], x[n])
                for n, layer in layers.items():
                    flow.gather(layer, sums[n])
                root = numbers(tr, tc, np.arange(span))
                for x in batch.column(3)[i].as_py() or ():
                    root[x["cell"]], steps[x["cell"]], length[x["cell"]] = x["root"], x["steps"], x["length"]
                flow.spread_up(root, steps, length)
                own = np.flatnonzero(flow.valid.ravel())
                made = [pa.array(root[own]), pa.array(steps[own].astype(np.int64)), pa.array(length[own])]
                found = [column(np.where(np.isfinite(layers[n][own]), layers[n][own], np.nan), "double") for n in sums]
                yield pa.RecordBatch.from_arrays([pa.array((tr * tile + own // tile).astype(np.int32)), pa.array((tc * tile + own % tile).astype(np.int32)), *made, *found], [x.split()[0] for x in schema.split(", ")])

    return state.mapInArrow(finish, schema)


class FlowAccumulation:
    """Upstream aggregates on one direction raster."""

    def __init__(self, direction: DataFrame, tile: int = TILE):
        self.direction, self.tile = cut(direction.select("row", "col", "value")), tile
        self._counts: DataFrame | None = None

    def _solved(self) -> DataFrame:
        if self._counts is None:
            ones = self.direction.select("row", "col", F.lit(1.0).alias("n"))
            self._counts = cut(drain(self.direction, ones, {"n": "sum"}, tile=self.tile))
        return self._counts

    def modals(self) -> DataFrame:
        """(row, col, value): cells upstream, the cell itself included."""
        return self._solved().select("row", "col", F.col("n").cast("long").alias("value"))

    def calculate(self, source: DataFrame, method: str = "sum") -> DataFrame:
        """Sum or mean of a raster over all cells upstream; NULL cells add nothing, and 0 cells of it give NULL."""
        if method not in ("sum", "mean"):
            raise ValueError(f"unknown method {method!r}")
        return self.calculate_all(source.select("row", "col", F.col("value").alias("value")), value=("value", method))

    def calculate_all(self, sources: DataFrame, **wanted: tuple[str, str]) -> DataFrame:
        """(row, col, names...): name=(column, ``sum`` or ``mean``) over a wide table, all in one pass."""
        columns = sorted({c for c, _ in wanted.values()})
        place = {c: i for i, c in enumerate(columns)}
        wide = sources.select("row", "col", *[F.col(c).cast("double").alias(f"s{i}") for c, i in place.items()], *[F.when(F.col(c).isNotNull(), 1.0).alias(f"n{i}") for c, i in place.items()])
        got = drain(self.direction, wide, {f"{x}{i}": "sum" for i in place.values() for x in "sn"}, tile=self.tile)
        out = []
        for name, (c, method) in wanted.items():
            s, n = F.col(f"s{place[c]}"), F.col(f"n{place[c]}")
            out.append((F.when(n > 0, s) if method == "sum" else F.try_divide(s, n)).alias(name))
        return got.select("row", "col", *out)

    def stats(self, source: DataFrame) -> DataFrame:
        """(row, col, min, max, sum, mean, n) over all cells upstream; NaN and infinities are passed over."""
        kind = dict(source.dtypes)["value"]
        d = F.col("value").cast("double")
        v = F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)
        wide = source.select("row", "col", v.alias("lo"), v.alias("hi"), v.alias("total"), F.when(v.isNotNull(), 1.0).alias("n"))
        got = drain(self.direction, wide, {"lo": "min", "hi": "max", "total": "sum", "n": "sum"}, tile=self.tile)
        some = F.col("n") > 0
        return got.select("row", "col", F.col("lo").cast(kind).alias("min"), F.col("hi").cast(kind).alias("max"), F.when(some, F.col("total")).alias("sum"), F.try_divide("total", "n").alias("mean"), F.col("n").cast("long").alias("n"))

    def contributing_area(self, csx: float, csy: float) -> DataFrame:
        from talweg.functions.algebra import contributing_area

        return self.modals().select("row", "col", contributing_area(F.col("value"), csx, csy).alias("value"))

    def outlets(self) -> DataFrame:
        """(row, col, root_row, root_col): where each cell's water ends."""
        return self._solved().select("row", "col", F.floor(F.col("root") / WIDTH).cast("int").alias("root_row"), F.pmod("root", F.lit(WIDTH)).cast("int").alias("root_col"))


def summarize_on_streams(direction: DataFrame, streams: DataFrame, source: DataFrame, method: str = "mean") -> DataFrame:
    return FlowAccumulation(direction).calculate(source, method).join(streams.where("value is not null").select("row", "col"), ["row", "col"], "left_semi")


def _stopped(direction: DataFrame, stops: DataFrame) -> DataFrame:
    """The direction raster with the cells of ``stops`` (row, col) as outlets."""
    on = stops.select("row", "col", F.lit(True).alias("_stop"))
    return direction.where("value is not null").join(on, ["row", "col"], "left").select("row", "col", F.when(F.col("_stop"), 0).otherwise(F.col("value")).alias("value"))


def first_stream_below(direction: DataFrame, streams: DataFrame) -> DataFrame:
    """(row, col, s_row, s_col): the first stream cell on each cell's way down, itself for stream cells."""
    on = streams.where("value is not null")
    got = drain(_stopped(direction, on))
    hit = got.join(on.select(_id().alias("root")), "root", "left_semi")
    return hit.select("row", "col", F.floor(F.col("root") / WIDTH).cast("int").alias("s_row"), F.pmod("root", F.lit(WIDTH)).cast("int").alias("s_col"))


def stream_basins(direction: DataFrame, streams: DataFrame) -> DataFrame:
    """(row, col, value): the stream segment that each cell drains to first."""
    seg = streams.where("value is not null").select(F.col("row").alias("s_row"), F.col("col").alias("s_col"), "value")
    return first_stream_below(direction, streams).join(seg, ["s_row", "s_col"]).select("row", "col", "value")


def basin(direction: DataFrame, row: int, col: int) -> DataFrame:
    """(row, col): all cells that drain through one cell, itself included."""
    here = direction.where((F.col("row") == row) & (F.col("col") == col)).select("row", "col")
    return drain(_stopped(direction, here)).where(F.col("root") == row * WIDTH + col).select("row", "col")


def basin_at(direction: DataFrame, spec: GridSpec, x: float, y: float) -> DataFrame:
    """:func:`basin` of the cell that holds a point."""
    return basin(direction, math.floor((spec.top - y) / spec.csy), math.floor((x - spec.left) / spec.csx))


def threshold_streams(accumulation: DataFrame, least_cells: float) -> DataFrame:
    return accumulation.where(F.col("value") >= least_cells).select("row", "col", "value")


def _linked(direction: DataFrame, stream_cells: DataFrame) -> DataFrame:
    """(id, next) of the stream cells; NULL where the next cell is no stream cell."""
    on = stream_cells.select(_id().alias("id"))
    e = edges(direction).join(on, "id", "left_semi")
    return e.join(on.select(F.col("id").alias("next"), F.lit(True).alias("ok")), "next", "left").select("id", F.when(F.col("ok"), F.col("next")).alias("next"))


def stream_segments(direction: DataFrame, stream_cells: DataFrame) -> DataFrame:
    """(row, col, value): segments between junctions, numbered by their lowest cell in row-major order."""
    kept = cut(_linked(direction, stream_cells))
    fan = kept.where("next is not null").groupBy("next").agg(F.count(F.lit(1)).alias("fan"))
    # A segment ends above a junction.
    ends = _cells(kept.join(fan, "next", "left").where("next is null or fan > 1").select("id")).select("row", "col")
    own = direction.join(stream_cells.select("row", "col"), ["row", "col"], "left_semi")
    got = cut(drain(_stopped(own, ends)))
    number = numbered(got.select("root").distinct(), "root")
    return got.join(number, "root").select("row", "col", "value")


def extract_streams(dem: DataFrame, csx: float, csy: float, min_area: float = 1e6, min_length: float = 0.0, accumulation: DataFrame | None = None, mexp: float | None = None, direction: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(streams, direction): segments of cells with enough area above them; short first-order segments go.

    ``direction`` may be given if it is known.  ``mexp`` multiplies the accumulation by the slope's tangent to that power.
    """
    if direction is None:
        direction = cut(flow_direction(cut(fill_depressions(dem)), csx, csy, flats=True))
    accumulation = accumulation if accumulation is not None else FlowAccumulation(direction).modals()
    if mexp:
        from talweg.operators.terrain import slope

        tan = slope(dem, csx, csy, "percent").select("row", "col", F.pow(F.col("value") / 100, F.lit(mexp)).alias("w"))
        accumulation = accumulation.join(tan, ["row", "col"]).select("row", "col", (F.col("value") * F.col("w")).alias("value"))
    on = threshold_streams(accumulation, math.ceil(min_area / (csx * csy)))
    segments = cut(stream_segments(direction, on))
    if min_length > 0:
        step = F.when(F.col("code").isin(1, 3, 5, 7), F.lit(math.hypot(csx, csy))).when(F.col("code").isin(2, 6), F.lit(csy)).otherwise(F.lit(csx))
        d = direction.select("row", "col", F.col("value").alias("code"))
        length = segments.join(d, ["row", "col"]).groupBy("value").agg(F.sum(step).alias("length"))
        ids = segments.select(_id().alias("id"), "value")
        fed = edges(direction).join(ids.withColumnRenamed("value", "up"), "id").join(ids.select(F.col("id").alias("next"), F.col("value").alias("down")), "next").where("up <> down").select(F.col("down").alias("value")).distinct()
        short = length.where(F.col("length") < min_length).join(fed, "value", "left_anti").select("value")
        segments = segments.join(short, "value", "left_anti").select("row", "col", "value")
    return segments, direction


def auto_basin(dem: DataFrame, csx: float, csy: float, min_area: float) -> DataFrame:
    """Basins labelled by the stream segment they drain to."""
    streams, direction = extract_streams(dem, csx, csy, min_area)
    return stream_basins(direction, streams)


def multiple_flow(dem: DataFrame, exponent: float = 1.1, tile: int = TILE) -> DataFrame:
    """(row, col, value): accumulation where water goes to all lower neighbours, by slope (over distance in cells) to a power."""

    def weights(z: np.ndarray) -> list[np.ndarray]:
        """Share of a cell's water that each neighbour gets, for all but the outermost ring."""
        own = z[1:-1, 1:-1]
        with np.errstate(invalid="ignore"):
            w = [np.where(n < own, np.maximum(own - n, 0) / math.hypot(*o), 0.0) ** exponent for o, n in zip(EIGHT, shifts(z, EIGHT, _ONE))]
        total = sum(w)
        return [np.divide(x, total, out=np.zeros(x.shape), where=total > 0) for x in w]

    def pour(static: np.ndarray, moving: np.ndarray, here: np.ndarray) -> None:
        z, got = static[0], moving[0]
        w = weights(z)  # of all cells but the outermost
        valid = ~np.isnan(z[2:-2, 2:-2])
        n, m = valid.shape
        while True:
            total = np.ones(valid.shape)
            for (r, c), x in zip(EIGHT, w):
                # The neighbour at -offset sends its share here.
                at = (slice(1 - r, 1 - r + n), slice(1 - c, 1 - c + m))
                total = total + np.nan_to_num(got[2 - r : 2 - r + n, 2 - c : 2 - c + m]) * x[at]
            new = np.where(valid, total, np.nan)
            if np.array_equal(new, got[2:-2, 2:-2], equal_nan=True):
                return
            got[2:-2, 2:-2] = new

    start = dem.select("row", "col", "value", F.lit(None).cast("double").alias("got"))
    return spread(start, ["value"], ["got"], 2, pour, {"got": "double"}, tile).withColumnRenamed("got", "value")


def flow_direction_accumulation(dem: DataFrame, csx: float = 1.0, csy: float = 1.0, single: bool = True) -> tuple[DataFrame, DataFrame]:
    """Direction and accumulation of a filled DEM; with ``single=False`` water spreads over all lower neighbours."""
    filled = cut(fill_depressions(dem))
    direction = cut(flow_direction(filled, csx, csy, flats=True))
    return direction, FlowAccumulation(direction).modals() if single else multiple_flow(filled)


def upstream_stats(values: DataFrame, streams: DataFrame, direction: DataFrame, distance: float, csx: float = 1.0, csy: float = 1.0) -> DataFrame:
    """Mean of the values on the flow path above, up to ``distance`` back, from each inlet down.

    An inlet is a stream cell without a stream cell above; it gets no value
    itself.  Where paths meet, the inlet that is last in row-major order wins,
    so each stream cell lies on the path of one inlet only.  A missing value
    makes the means of its window NULL.
    """
    on = streams.where("value is not null").select("row", "col")
    linked = cut(_linked(direction, on))
    inlets = linked.select("id").join(linked.where("next is not null").select(F.col("next").alias("id")), "id", "left_anti")
    ids = on.select("row", "col", _id().alias("id")).join(inlets.withColumn("inlet", F.col("id").cast("double")), "id", "left").select("row", "col", "inlet")
    own = direction.join(on, ["row", "col"], "left_semi")
    got = cut(drain(own, ids, {"inlet": "max"}, csx, csy).select("row", "col", F.col("inlet").cast("long").alias("inlet"), "length"))
    heads = got.where(_id() == F.col("inlet")).select("inlet", F.col("length").alias("whole"))
    v = values.select("row", "col", F.col("value").cast("double").alias("v"))
    along = got.join(heads, "inlet").withColumn("along", F.col("whole") - F.col("length")).join(v, ["row", "col"], "left")
    w = f"over (partition by inlet order by along range between {float(distance)}D preceding and current row)"
    mean = F.expr(f"case when sum(if(v is null, 1, 0)) {w} = 0 then avg(v) {w} end")
    return along.withColumn("value", mean).where("along > 0").select("row", "col", "value")


def stream_order(direction: DataFrame, segments: DataFrame, accumulation: DataFrame | None = None, zero_bg: bool = False) -> DataFrame:
    """(row, col, value): Strahler order of each stream cell's segment.

    With ``accumulation`` Horton's order: the main stem, where most water comes
    from, keeps the order of its outlet up to its head.  With ``zero_bg`` all
    other cells of the direction raster are 0.
    """
    from talweg.operators.network import horton, segment_edges, strahler

    order = cut(strahler(segment_edges(direction, segments)))
    if accumulation is not None:
        most = segments.select("row", "col", F.col("value").alias("rid")).join(accumulation.select("row", "col", F.col("value").alias("a")), ["row", "col"]).groupBy("rid").agg(F.max("a").alias("water"))
        order = horton(order, most)
    out = segments.join(order.select(F.col("rid").alias("value"), "strahler"), "value").select("row", "col", F.col("strahler").alias("value"))
    if not zero_bg:
        return out
    return direction.select("row", "col").join(out, ["row", "col"], "left").select("row", "col", F.coalesce("value", F.lit(0)).alias("value"))


class WatershedIndex:
    """Contributing cells of every stream cell, and the tree of stream cells."""

    def __init__(self, direction: DataFrame, streams: DataFrame):
        self.direction, self.streams = direction, streams.where("value is not null").select("row", "col", "value")
        roots = FlowAccumulation(direction).outlets().select("row", "col", (F.col("root_row").cast("long") * WIDTH + F.col("root_col")).alias("root"))
        nets = numbered(self.streams.join(roots, ["row", "col"]).select("root").distinct(), "root", "network_id")
        first = first_stream_below(direction, streams).join(roots, ["row", "col"]).join(nets, "root")
        self.members = cut(first.select("network_id", (F.col("s_row").cast("long") * WIDTH + F.col("s_col")).alias("point_id"), "row", "col"))
        on = self.streams.select(_id().alias("id"))
        below = edges(direction).join(on, "id", "left_semi").join(on.select(F.col("id").alias("next")), "next", "left_semi")
        ids = self.members.select("network_id", "point_id").distinct()
        self.tree = below.join(ids, F.col("next") == F.col("point_id")).select("network_id", "point_id", F.col("id").alias("child_id"))

    @staticmethod
    def from_dem(dem: DataFrame, csx: float, csy: float, minimum_area: float = 1e6) -> WatershedIndex:
        streams, direction = extract_streams(dem, csx, csy, minimum_area)
        return WatershedIndex(direction, cut(streams))

    def calculate_stats(self, raster: DataFrame) -> DataFrame:
        """(row, col, min, max, sum, mean, n) of each stream cell, over everything upstream."""
        return FlowAccumulation(self.direction).stats(raster).join(self.streams.select("row", "col"), ["row", "col"], "left_semi")

    def locations(self, spec: GridSpec, data: DataFrame | None = None, output_crs: str | None = None) -> DataFrame:
        """(id, network_id, x, y, data...): the stream cells as points, with the columns of ``data`` (row, col, ...) on request."""
        from talweg.plans.grid import transform_points

        x, y = spec.x("col"), spec.y("row")
        if output_crs:
            x, y = transform_points(x, y, spec.crs, output_crs)
        nets = self.members.select("network_id", "point_id").distinct()
        pts = self.streams.select("row", "col", _id().alias("id")).join(nets, F.col("id") == F.col("point_id"))
        pts = pts if data is None else pts.join(data, ["row", "col"], "left")
        more = [c for c in (data.columns if data is not None else []) if c not in ("row", "col")]
        return pts.select("id", "network_id", x.alias("x"), y.alias("y"), *more)

    def save_locations(self, path: str, spec: GridSpec, data: DataFrame | None = None, output_crs: str | None = None) -> None:
        self.locations(spec, data, output_crs).write.mode("overwrite").parquet(path)

    def save(self, path: str) -> None:
        for name in ("members", "tree", "direction", "streams"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> WatershedIndex:
        """A saved index."""
        out = cls.__new__(cls)
        for name in ("members", "tree", "direction", "streams"):
            setattr(out, name, spark.read.parquet(f"{path}/{name}"))
        return out

    def __iter__(self) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        """(network_id, point_id, member cells) one point after the other; the driver holds one partition of points at a time."""
        cells = self.members.groupBy("network_id", "point_id").agg(F.array_sort(F.collect_list(F.struct("row", "col"))).alias("cells"))
        for r in cells.orderBy("network_id", "point_id").toLocalIterator():
            yield r["network_id"], r["point_id"], [(c["row"], c["col"]) for c in r["cells"]]
