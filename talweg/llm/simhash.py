"""Near-duplicates by SimHash and anchor points of a covering code.

Anchors are the pairs of codewords of the binary Golay code (length 23, 2**12
words, covering radius 3) over bits 0-22 and 23-45 of a fingerprint.  Two
fingerprints that differ in at most ``THRESHOLD`` bits have a word midway, at
most ``HALF`` bits from either; that word lies within the covering radius of an
anchor, so both fingerprints lie within radius plus HALF of the same anchor.
Each distinct fingerprint is therefore copied to every anchor within radius
plus HALF (at most 68), which finds the same links as radius plus threshold on
one side, and all 64 bits are compared anchor by anchor.

Documents of one fingerprint are one node.  A task that compares anchors
passes on spanning forests of its links, not the pairs; an anchor with very
many fingerprints is split into pairs of blocks, each compared by itself.
Components come from rounds of minimum labels over tables in the shared folder.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.llm._common import at, atomic, materialize, positional, row_order, spread_join
from talweg.llm.bpe import slices
from talweg.llm.exact_dedup import bit_array, flag

WORDS, SEED, THRESHOLD = 3, 42, 3
HALF = (THRESHOLD + 1) // 2
#: Length, generator polynomial and covering radius of the Golay code: fixed values.
LENGTH, GENERATOR, RADIUS = 23, 0b110001110101, 3
#: Shingles hashed at a time; rows compared at a time.
CHUNK, BLOCK = 200_000, 2048
#: Fingerprints of an anchor that one task compares; more are split into pairs of blocks.
WIDE = 16_384


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """Hashes of all runs of ``words`` words of a whole text, some at a time; a shorter text is one run, none without words."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(found) >= words:
        starts, ends = starts[: len(found) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    joined, hashed = b" ".join(found), xxhash.xxh64_intdigest
    for i in range(0, len(starts), CHUNK):
        cut = zip(starts[i : i + CHUNK].tolist(), ends[i : i + CHUNK].tolist())
        yield np.array([hashed(joined[a:b], SEED) for a, b in cut], "<u8")


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a whole text as a signed integer; 0 without words."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, WORDS):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def with_fingerprints(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` (by position) and ``fp``."""
    text_at = at(df, text_col)
    rows = positional(df).select(F.col(text_at).alias("text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                fps = pa.array([fingerprint(x) for x in batch.column(0).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], fps], [*batch.schema.names[1:], "fp"])

    return rows.mapInArrow(run, rows.drop("text").schema.add("fp", "long"))


@functools.lru_cache(maxsize=1)
def coset_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of single bits; for each syndrome the error words of weight up to radius + HALF, and their excess over the radius."""
    syndrome = np.zeros(LENGTH, np.int64)
    s = 1
    for i in range(LENGTH):
        syndrome[i] = s
        s <<= 1
        if s >> 11 & 1:
            s ^= GENERATOR
    words: list[list[tuple[int, int]]] = [[] for _ in range(2048)]
    for weight in range(RADIUS + HALF + 1):
        for bits in itertools.combinations(range(LENGTH), weight):
            key = 0
            for b in bits:
                key ^= int(syndrome[b])
            words[key].append((sum(1 << b for b in bits), max(0, weight - RADIUS)))
    widest = max(map(len, words))
    errors, excess = np.zeros((2048, widest), np.int64), np.full((2048, widest), HALF + 1, np.int8)
    for key, found in enumerate(words):
        for j, (e, x) in enumerate(found):
            errors[key, j], excess[key, j] = e, x
    return syndrome, errors, excess


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the fingerprint and anchor, for all anchors in reach."""
    syndrome, errors, excess = coset_table()
    half = []
    for shift in (0, LENGTH):
        word = (fps >> shift) & ((1 << LENGTH) - 1)
        s = np.zeros(len(fps), np.int64)
        for b in range(LENGTH):
            s ^= np.where(word >> b & 1, syndrome[b], 0)
        half.append((word[:, None] ^ errors[s], excess[s]))
    (a, ax), (b, bx) = half
    row, i, j = np.nonzero(ax[:, :, None] + bx[:, None, :] <= HALF)
    return row, a[row, i] << LENGTH | b[row, j]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for i in range(0, len(fps), BLOCK):
            own = fps[i : i + BLOCK]
            row, anchor = anchors(own)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(own[row])], ["anchor", "fp"])


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= THRESHOLD


class _Forest:
    """Union-find over fingerprints; the smallest is the root."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        p = self.parent
        while (up := p.setdefault(x, x)) != x:
            p[x] = p.setdefault(up, up)
            x = p[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)


def _link_large(left: np.ndarray, right: np.ndarray, forest: _Forest) -> None:
    """Link one cell's fingerprints, block against block; only links between different components are looked at one by one."""
    same = left is right
    at = np.array([forest.root(int(x)) for x in left], np.int64)
    to = at if same else np.array([forest.root(int(x)) for x in right], np.int64)
    for i in range(0, len(left), BLOCK):
        for j in range(0, i + BLOCK if same else len(right), BLOCK):
            x, y = left[i : i + BLOCK], right[j : j + BLOCK]
            near = _near(x[:, None], y[None, :])
            while (open_ := near & (at[i : i + BLOCK, None] != to[None, j : j + BLOCK])).any():
                rows = np.flatnonzero(open_.any(axis=1))
                for r, c in zip(rows.tolist(), open_[rows].argmax(axis=1).tolist()):
                    forest.join(int(x[r]), int(y[c]))
                at[i : i + BLOCK] = [forest.root(int(v)) for v in x]
                to[j : j + BLOCK] = [forest.root(int(v)) for v in y]
                if not same:
                    at[i : i + BLOCK] = [forest.root(int(v)) for v in x]


def _compare(cell: np.ndarray, fps: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (u, v) of the links within each cell (sorted by cell).

    Two fingerprints of side 0, or of side 1, are compared in another cell;
    those of side 2 are compared with all of their cell.
    """
    forest = _Forest()
    edge = np.flatnonzero(np.diff(cell)) + 1
    starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(cell)]])
    size = ends - starts
    for s, e in zip(starts[size > 32].tolist(), ends[size > 32].tolist()):
        f, k = fps[s:e], side[s:e]
        if (k == 2).all():
            _link_large(f, f, forest)
        else:
            _link_large(f[k != 1], f[k != 0], forest)
    small = np.repeat(size <= 32, size)
    for k in range(1, int(min(32, size.max()))):
        same = (cell[k:] == cell[:-k]) & small[k:]
        i = np.flatnonzero(same)
        i = i[_near(fps[i], fps[i + k])]
        for x, y in set(zip(fps[i].tolist(), fps[i + k].tolist())):
            forest.join(x, y)
    linked = [(x, r) for x in list(forest.parent) if (r := forest.root(x)) != x]
    return np.array([x for x, _ in linked], np.int64), np.array([r for _, r in linked], np.int64)


def _link_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, fp, side) sorted by cell in, spanning forests (u, v) of whole cells out; memory holds one cell and one batch."""
    held: list[list[np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            u, v = _compare(*(np.concatenate(c) for c in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cell = columns[0]
        if not len(cell):
            continue
        cut = int(np.searchsorted(cell, cell[-1], "left"))  # the last cell can go on in the next batch
        if cut:
            held.append([c[:cut] for c in columns])
        if cut or (held and held[0][0][0] != cell[-1]):
            yield from flush()
            held.clear()
        held.append([c[cut:] for c in columns])
    yield from flush()


def links(fps: DataFrame, wide: int = WIDE) -> DataFrame:
    """Edges (u, v) that connect all fingerprints (distinct rows ``fp``) with links at most THRESHOLD bits long.

    An anchor is one cell, that is the work of one task at a time, unless it has
    more than ``wide`` fingerprints: those are dealt over blocks of about ``wide``
    by their hash, and each pair of blocks is a cell of its own.
    """
    copies = materialize(fps.select("fp").mapInArrow(_anchor_rows, "anchor long, fp long"), "anchors")
    crowded = materialize(copies.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > wide), "crowded-anchors")
    cells = copies.select(F.col("anchor").alias("cell"), "fp", F.lit(2).alias("side"))
    crowd = crowded.agg(F.sum("n")).first()[0]
    if crowd:
        dealt = spread_join(copies, crowded, "anchor", "n", crowd, [F.col("fp")])
        blocks = F.ceil(F.col("n") / wide).cast("int")
        own = F.pmod(F.xxhash64("fp", F.lit(3)), blocks).cast("int")
        split = dealt.where("n is not null").select("anchor", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        # Pair (i, j) of blocks, i <= j; the cell's number is a hash, and a collision only adds comparisons.
        pair = F.xxhash64("anchor", F.least("own", "other"), F.greatest("own", "other"))
        side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
        cells = dealt.where("n is null").select(F.col("anchor").alias("cell"), "fp", F.lit(2).alias("side")).unionByName(split.select(pair.alias("cell"), "fp", side.alias("side")))
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_link_rows, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of its component, for all nodes of ``edges``.

    Each round sends labels along edges and then jumps to the label's label.
    """
    both = materialize(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    while True:
        sent = both.join(labels, both["u"] == labels["node"]).select(F.col("v").alias("node"), "label")
        heard = materialize(sent.unionByName(labels).groupBy("node").agg(F.min("label").alias("label")), "heard")
        up = heard.select(F.col("node").alias("at"), F.col("label").alias("up"))
        new = materialize(heard.join(up, heard["label"] == up["at"]).select("node", F.col("up").alias("label")), "labels")
        old = labels.select("node", F.col("label").alias("old"))
        if new.join(old, "node").where("label <> old").isEmpty():
            return new
        labels = new


def fingerprint_components(rows: DataFrame) -> DataFrame:
    """(fp, label, component, n, members) of the rows (fp, id): the component's smallest fingerprint, smallest id reachable, rows of the fingerprint, rows of the component.

    Only ``label`` names a component: several can have the same smallest id, or none.
    """
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "fingerprints")
    labels = components(materialize(links(nodes), "links"))
    labelled = materialize(nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "least", "n", F.coalesce("label", "fp").alias("label"), F.col("node").isNotNull().alias("linked")), "labelled")
    sums = materialize(labelled.where("linked").groupBy("label").agg(F.min("least").alias("component"), F.sum("n").alias("members")), "components")
    linked = labelled.where("linked").join(sums, "label").select("fp", "label", "component", "n", "members")
    alone = labelled.where("not linked").select("fp", "label", F.col("least").alias("component"), "n", F.col("n").alias("members"))
    return materialize(linked.unionByName(alone), "fingerprint-components")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, fp, component, members``.

    ``component`` is the smallest id of the component (null ids are passed
    over; null if it has no other).  Null and empty texts have fingerprint 0,
    which links like any other.  Repeated rows each get their own result.
    """
    id_at = at(df, id_col)
    rows = materialize(with_fingerprints(df, text_col, [id_at]).withColumnRenamed(id_at, "id"), "doc-fingerprints")
    found = fingerprint_components(rows)
    return spread_join(rows, found, "fp", "n", rows.count(), [F.col("id")]).drop("n", "label")


def keep_one(df: DataFrame, rows: DataFrame, key: str, several: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of the rows of ``df`` (by position, with ``key``) one of each ``label`` in ``several`` (key, label, n): smallest id, then text, then hash over all columns.

    Rows whose key is not in ``several`` pass straight through; only the
    others shuffle.
    """
    id_at, text_at, names = at(df, id_col), at(df, text_col), [f"c{i}" for i in range(len(df.columns))]
    packed = flag(rows.select(key, F.struct(*names).alias("row")), key, *bit_array(several, key, several.count(), 1))
    by = atomic(positional(df), "row.")
    total = several.agg(F.sum("n")).first()[0] or 0
    tagged = spread_join(packed.where("possible").select(key, "row"), several, key, "n", total, by)
    alone = packed.where(~F.col("possible")).select("row").unionByName(tagged.where("n is null").select("row"))
    one = tagged.where("n is not null").groupBy("label").agg(F.min_by("row", F.struct(F.col(f"row.{id_at}").isNull(), F.col(f"row.{id_at}"), F.col(f"row.{text_at}"), row_order(positional(df), "row."))).alias("row"))
    return alone.unionByName(one.select("row")).select("row.*").toDF(*df.columns)


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with one row of each component (smallest id, then text, then hash over all columns), all columns as they were.

    Null and empty texts are similar to each other; an empty table gives an empty result.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    rows = materialize(with_fingerprints(df, text_col, names), "docs-with-fingerprints")
    found = fingerprint_components(rows.select("fp", F.col(at(df, id_col)).alias("id")))
    several = materialize(found.where("members > 1").select("fp", "label", "n"), "several")
    return keep_one(df, rows, "fp", several, id_col, text_col)
