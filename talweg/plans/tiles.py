"""Cells as tiles of arrays.

A cell is sent to its own tile and, near an edge, to the tiles whose halo it
lies in; that is the only shuffle, whatever the size of the window.  What
spreads over the grid (costs, levels, rings, flow) is solved inside each tile,
and only the borders travel between tiles until nothing changes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.plans.graph import cut
from talweg.plans.grid import keys

#: Side of a tile in cells.
TILE = 256
Reach = tuple[int, int, int, int]
_ARROW = {"double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def tiled(cells: DataFrame, tile: int, reach: Reach) -> DataFrame:
    """Cells with the tiles (tr, tc) of the cells whose windows hold them; windows reach up, down, left and right."""
    up, down, left, right = reach
    span = lambda k, lo, hi: F.sequence(F.floor((F.col(k) - F.lit(hi)) / tile).cast("int"), F.floor((F.col(k) + F.lit(lo)) / tile).cast("int"))
    return cells.withColumn("tr", F.explode(span("row", up, down))).withColumn("tc", F.explode(span("col", left, right)))


def _dense(t: pa.Table, names: list[str], tile: int, reach: Reach) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Layers (NaN where missing) and presence of a tile with its halo, and the row and column of its corner."""
    up, down, left, right = reach
    r0, c0 = t.column("tr")[0].as_py() * tile - up, t.column("tc")[0].as_py() * tile - left
    a = np.full((len(names), tile + up + down, tile + left + right), np.nan)
    here = np.zeros(a.shape[1:], bool)
    r, c = t.column("row").to_numpy() - r0, t.column("col").to_numpy() - c0
    here[r, c] = True
    for i, n in enumerate(names):
        a[i, r, c] = t.column(n).to_numpy()
    return a, here, r0, c0


def column(values: np.ndarray, kind: str) -> pa.Array:
    """Values with NaN as null."""
    gone = np.isnan(values)
    if kind == "double":
        return pa.array(values, mask=gone)
    return pa.array(np.where(gone, 0, values), mask=gone).cast(_ARROW[kind])


def _inputs(cells: DataFrame, names: list[str]) -> DataFrame:
    at = [F.col(k).cast("int").alias(k) for k in keys(cells)]
    return cells.select(*at, *[F.col(n).cast("double").alias(n) for n in names])


def on_tiles(cells: DataFrame, names: list[str], reach: Reach, kernel: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], out: dict[str, str], tile: int = TILE) -> DataFrame:
    """(keys, out...) of all cells: ``kernel`` gets layers and presence with their halo and gives arrays of the tile itself, NaN for NULL.

    Values are computed as doubles.
    """
    up, _, left, _ = reach
    band = "band" in cells.columns

    def run(t: pa.Table) -> pa.Table:
        a, here, r0, c0 = _dense(t, names, tile, reach)
        inner = here[up : up + tile, left : left + tile]
        r, c = np.nonzero(inner)
        made = kernel(a, here) if len(r) else [np.empty((tile, tile))] * len(out)
        columns = {"row": pa.array((r + r0 + up).astype(np.int32)), "col": pa.array((c + c0 + left).astype(np.int32))}
        if band:
            columns = {"band": pa.array(np.full(len(r), t.column("band")[0].as_py(), np.int32))} | columns
        return pa.table(columns | {n: column(m[r, c].astype(float), k) for (n, k), m in zip(out.items(), made)})

    schema = ", ".join([*(f"{k} int" for k in keys(cells)), *(f"{n} {k}" for n, k in out.items())])
    return tiled(_inputs(cells, names), tile, reach).groupBy(*(["band"] if band else []), "tr", "tc").applyInArrow(run, schema)


def shifts(a: np.ndarray, offsets: list[tuple[int, int]], reach: Reach) -> Iterator[np.ndarray]:
    """For each offset the layer ``a`` moved so that the neighbour lies on the cell; without the halo."""
    up, down, left, right = reach
    rows, cols = a.shape[-2] - up - down, a.shape[-1] - left - right
    for r, c in offsets:
        yield a[..., up + r : up + r + rows, left + c : left + c + cols]


# What spreads: states of tiles, and messages between them.

_PLACES = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r, c) != (0, 0)]
_STATE = "tr int, tc int, blob binary, sent array<struct<tr:int,tc:int,dr:int,dc:int,part:binary>>"
Solve = Callable[[np.ndarray, np.ndarray, np.ndarray], None]


def _strip(place: tuple[int, int], tile: int, halo: int, ours: bool) -> tuple[slice, slice]:
    """Where the halo on one side lies in a tile, or (``ours``) the tile's own cells that are the halo of the neighbour there."""
    def one(d: int) -> slice:
        if d == 0:
            return slice(halo, halo + tile)
        lo = (halo if d < 0 else tile) if ours else (0 if d < 0 else halo + tile)
        return slice(lo, lo + halo)

    return one(place[0]), one(place[1])


def spread(cells: DataFrame, static: list[str], start: list[str], halo: int, solve: Solve, out: dict[str, str], tile: int = TILE, rounds: int = 100_000) -> DataFrame:
    """(row, col, out...): layers ``start`` after they have spread over all tiles.

    ``solve`` gets the static layers, the spreading layers and the presence of
    a tile with its halo, and brings the inner part of the spreading layers to
    rest, in place, with the halo held.  A tile whose border has changed sends
    the changed strips to its neighbours; tiles without messages rest.  Rounds
    count the tiles that an effect crosses, not cells.  ``out`` names the
    spreading layers that come out.
    """
    names = [*static, *start]
    reach = (halo, halo, halo, halo)
    side = tile + 2 * halo
    n_static, n = len(static), len(names)

    def settle(tr: int, tc: int, a: np.ndarray, here: np.ndarray) -> tuple[bytes, list[dict]]:
        before = a[n_static:].copy()
        solve(a[:n_static], a[n_static:], here)
        sent = []
        for place in _PLACES:
            own, to = _strip(place, tile, halo, True), _strip(place, tile, halo, False)
            part = a[(slice(n_static, None), *own)]
            old = before[(slice(None), *own)]
            if here[to].any() and not np.array_equal(part, old, equal_nan=True):
                sent.append({"tr": tr + place[0], "tc": tc + place[1], "dr": -place[0], "dc": -place[1], "part": part.tobytes()})
        return np.concatenate([a, here[None].astype(float)]).tobytes(), sent

    kind = pa.list_(pa.struct([(k, pa.int32()) for k in ("tr", "tc", "dr", "dc")] + [("part", pa.binary())]))

    def first(t: pa.Table) -> pa.Table:
        a, here, _, _ = _dense(t, names, tile, reach)
        tr, tc = t.column("tr")[0].as_py(), t.column("tc")[0].as_py()
        blob, sent = settle(tr, tc, a, here) if here[halo:-halo, halo:-halo].any() else (None, [])
        keep = 0 if blob is None else 1
        return pa.table({"tr": pa.array([tr] * keep, pa.int32()), "tc": pa.array([tc] * keep, pa.int32()), "blob": pa.array([blob] * keep, pa.binary()), "sent": pa.array([sent] * keep, kind)})

    def load(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        a = np.frombuffer(blob).reshape(n + 1, side, side).copy()
        return a[:-1], a[-1] > 0

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):  # one tile in memory at a time
                tr, tc, blob, inbox = (batch.column(c)[i] for c in range(4))
                blob, sent = blob.as_buffer(), []
                if inbox.is_valid:
                    a, here = load(blob)
                    for m in inbox.as_py():
                        at = _strip((m["dr"], m["dc"]), tile, halo, False)
                        layer = a[(slice(n_static, None), *at)]
                        layer[...] = np.frombuffer(m["part"]).reshape(layer.shape)
                    blob, sent = settle(tr.as_py(), tc.as_py(), a, here)
                yield pa.RecordBatch.from_arrays([pa.array([tr.as_py()], pa.int32()), pa.array([tc.as_py()], pa.int32()), pa.array([blob if isinstance(blob, bytes) else blob.to_pybytes()], pa.binary()), pa.array([sent], kind)], ["tr", "tc", "blob", "sent"])

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                a, here = load(batch.column(2)[i].as_buffer())
                r, c = np.nonzero(here[halo : halo + tile, halo : halo + tile])
                corner = [batch.column(k)[i].as_py() * tile for k in (0, 1)]
                made = [column(a[names.index(s), r + halo, c + halo], k) for s, k in out.items()]
                yield pa.RecordBatch.from_arrays([pa.array((r + corner[0]).astype(np.int32)), pa.array((c + corner[1]).astype(np.int32)), *made], ["row", "col", *out])

    state = cut(tiled(_inputs(cells, names), tile, reach).groupBy("tr", "tc").applyInArrow(first, _STATE))
    for _ in range(rounds):
        post = state.select(F.explode("sent").alias("m")).select("m.*")
        if post.isEmpty():
            schema = ", ".join(["row int", "col int", *(f"{s} {k}" for s, k in out.items())])
            return state.select("tr", "tc", "blob").mapInArrow(cells_of, schema)
        inbox = post.groupBy("tr", "tc").agg(F.collect_list(F.struct("dr", "dc", "part")).alias("inbox"))  # at most eight a tile
        state = cut(state.select("tr", "tc", "blob").join(inbox, ["tr", "tc"], "left").mapInArrow(again, _STATE))
    raise RuntimeError(f"nothing came to rest in {rounds} rounds")
