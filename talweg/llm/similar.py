"""Near-duplicates by SimHash, anchors of the covering code and the exact similarity of word shingles.

Similarity is the share of common shingles among the distinct shingles of two
texts.  Texts of equal shingles are one node.  A node has ``PRINTS`` SimHash
fingerprints of 64 bits over its shingles, each with two pieces of 23 bits.
A piece is copied to every codeword of the Golay code within covering radius
plus one (5.3 on average): these are its anchors.  Nodes that share an anchor
are compared, so a pair is met for certain if its pieces differ in fewer than
``3 * PIECES`` bits together, as then one piece differs in two bits or less.
At 0.8 a bit differs with a probability of 0.151 and a piece shares no anchor
with one of 0.40, so that all ``PIECES`` miss with 4 in ten million (texts of
four and five shingles: 0.19, 0.54 and 5 in a hundred thousand), and less above.

What meets at an anchor is sorted by size and looks only at sizes that can be
similar, then at the first 128 bits of the fingerprints: more than ``BITS``
different ones have a probability of 2 in ten million at 0.8 (four and five
shingles: 5 in a hundred thousand).  Parity bits of the shingles, folded there
and whole afterwards, rule out more pairs that cannot be similar (never others)
before whole sets are joined and decide.

So that a large group of near copies does not cost its square, each node is
first paired with the next few at exact anchors of two pieces.  What that links
is one component, and at the anchors only pairs of different components are
compared: the nodes outside an anchor's largest component with all of its nodes.
An anchor of more than ``CROWD`` nodes is no single task's work: the nodes
outside its largest component, and all its nodes, are dealt over blocks of about
``WIDE``; each pair of blocks is a cell that is compared alone.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.llm._common import at, lean, materialize, positional, spread_join
from talweg.llm.bpe import slices
from talweg.llm.exact_dedup import bit_array, flag
from talweg.llm.simhash import LENGTH, SEED, components, coset_table, keep_one, shingle_hashes

WORDS, LEAST = 5, Fraction(4, 5)
PRINTS, PARITY = 8, 1024
#: Words of 64 bits that the parity bits are folded to where nodes meet.
FOLDED = 4
PIECES = 2 * PRINTS
#: Differing bits among the first 128 up to which a pair is looked at.
BITS = 42
#: Nodes that each node of an exact anchor is paired with first; rows of bits added up in one byte; pairs looked at at a time.
NEXT, ROWS, PAIRS = 3, 255, 2_000_000
#: Nodes compared with as many others at a time, and dealt to one block of a crowded anchor.
WIDE = 512
#: Nodes of an anchor that one task compares, and of one component that are told apart from the others.
CROWD, GROUP = 65_536, 64
#: Pieces whose nearest codewords together are an exact anchor.
JOINED = [(i, (i + k) % PIECES) for k in (1, 3) for i in range(PIECES)]
MIX = np.random.default_rng(SEED).integers(0, 1 << 63, (2, PRINTS - 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a whole text as sorted hashes; a shorter text is one shingle, none without words."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, words)]))


def fingerprints(own: np.ndarray) -> np.ndarray:
    """PRINTS SimHash fingerprints of distinct shingles: of their hashes, and of the hashes mixed anew."""
    mixed = (own[:, None] ^ MIX[0]) * MIX[1]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * MIX[0]
    hashes = np.concatenate([own[:, None], mixed ^ (mixed >> np.uint64(29))], axis=1)
    ones = np.zeros(64 * PRINTS, np.int64)
    for i in range(0, len(own), ROWS):
        ones += np.unpackbits(hashes[i : i + ROWS].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(own), bitorder="little").view(np.int64)


def describe(own: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """Node, number of shingles, parity bits and fingerprints."""
    import xxhash

    node = int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))
    parity = np.bincount((own % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) % 2
    return node, len(own), np.packbits(parity.astype(np.uint8)).tobytes(), fingerprints(own).tobytes()


def with_nodes(df: DataFrame, text_col: str, keep: list[str], words: int) -> DataFrame:
    """The columns ``keep`` (by position) and ``node, size, parity, prints``."""
    text_at = at(df, text_col)
    rows = positional(df).select(*dict.fromkeys([*keep, text_at]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_at):
                found = zip(*[describe(shingles(x, words)) for x in batch.column(text_at).to_pylist()])
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                made = [pa.array(x, kind) for x, kind in zip(found, kinds)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], [*keep, "node", "size", "parity", "prints"])

    return rows.mapInArrow(lean(run), rows.select(*keep).schema.add("node", "long").add("size", "long").add("parity", "binary").add("prints", "binary"))


@functools.lru_cache(maxsize=1)
def _errors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of single bits; for each syndrome the error words of weight up to covering radius plus one, the lightest first, and which are there."""
    syndrome, errors, excess = coset_table()
    order = np.argsort(excess, axis=1, kind="stable")
    there = np.take_along_axis(excess, order, axis=1) <= 1
    widest = int(there.sum(axis=1).max())
    return syndrome, np.take_along_axis(errors, order, axis=1)[:, :widest], there[:, :widest]


def piece_anchors(prints: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the codewords within covering radius plus one of a piece, the one within the radius first, and which columns are there."""
    syndrome, errors, there = _errors()
    word = (prints[:, piece // 2] >> (LENGTH * (piece % 2))) & ((1 << LENGTH) - 1)
    s = np.zeros(len(word), np.int64)
    for b in range(LENGTH):
        s ^= np.where(word >> b & 1, syndrome[b], 0)
    return (word[:, None] ^ errors[s]) >> 11, there[s]  # the code is systematic: the upper 12 bits name a codeword


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and anchor, for all anchors of all pieces."""
    rows, found = [], []
    for piece in range(PIECES):
        number, there = piece_anchors(prints, piece)
        row, j = np.nonzero(there)
        rows.append(row)
        found.append(number[row, j] | piece << 12)
    return np.concatenate(rows), np.concatenate(found)


def exact_anchors(prints: np.ndarray) -> np.ndarray:
    """For each row the nearest codewords of the JOINED pieces, as one number each."""
    nearest = np.stack([piece_anchors(prints, piece)[0][:, 0] for piece in range(PIECES)], axis=1)
    return np.stack([nearest[:, i] | nearest[:, j] << 12 | k << 24 for k, (i, j) in enumerate(JOINED)], axis=1)


def _prints(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, PRINTS)


def _exact_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, prints) in, rows (band, node) out: a band is an exact anchor."""
    for batch in batches:
        found, node = exact_anchors(_prints(batch.column(1))), batch.column(0).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(np.repeat(node, found.shape[1]))], ["band", "node"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (prints) in, rows (band, n) out: how many go to each anchor."""
    total = np.zeros(PIECES << 12, np.int64)
    for batch in batches:
        total += np.bincount(anchors(_prints(batch.column(0)))[1], minlength=len(total))
    band = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(total[band])], ["band", "n"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (band, node) in; pairs (u, v) of nodes at most NEXT apart in one band out, and the first and last band as ``cut``."""
    held_b, held_n, last = np.zeros(0, np.int64), np.zeros(0, np.int64), None

    def cut(band: int) -> pa.RecordBatch:
        none = pa.nulls(1, pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array([band], pa.int64())], ["u", "v", "cut"])

    for batch in batches:
        if not batch.num_rows:
            continue
        if last is None:
            yield cut(batch.column(0)[0].as_py())
        last = batch.column(0)[-1].as_py()
        band, node = (np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip((held_b, held_n), batch.columns))
        pairs = []
        for k in range(1, NEXT + 1):
            i = np.flatnonzero(band[k:] == band[:-k])
            i = i[i + k >= len(held_b)]
            pairs.append(np.stack([node[i], node[i + k]], axis=1))
        found = np.unique(np.concatenate(pairs), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.nulls(len(found), pa.int64())], ["u", "v", "cut"])
        held_b, held_n = band[-NEXT:], node[-NEXT:]
    if last is not None:
        yield cut(last)


def _bits(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, PARITY // 64)


def _possible(size_a: np.ndarray, size_b: np.ndarray, bits: np.ndarray, least: Fraction) -> np.ndarray:
    """False only for pairs that cannot be similar; ``bits`` are the differing parity bits, at most as many as the shingles that only one has."""
    p, q = least.numerator, least.denominator
    odd = np.bitwise_count(bits).sum(axis=-1, dtype=np.int64)
    return (np.minimum(size_a, size_b) * q >= np.maximum(size_a, size_b) * p) & (odd * (q + p) <= (size_a + size_b) * (q - p))


def _across(node: np.ndarray, label: np.ndarray, size: np.ndarray, bits: np.ndarray, minor: np.ndarray, least: Fraction) -> Iterator[np.ndarray]:
    """Possible pairs of different components in one cell: rows marked ``minor`` against the others, some at a time."""
    few, rest = np.flatnonzero(minor), np.flatnonzero(~minor)
    for i in range(0, len(few), WIDE):
        x = few[i : i + WIDE, None]
        for j in range(0, len(rest), WIDE):
            y = rest[None, j : j + WIDE]
            r, c = np.nonzero((label[x] != label[y]) & _possible(size[x], size[y], bits[x] ^ bits[y], least))
            found = np.stack([node[x[r, 0]], node[y[0, c]]], axis=1)
            yield np.unique(np.sort(found, axis=1), axis=0)


def _windows(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) with lo[i] <= j < hi[i], about PAIRS at a time (more only for a single i)."""
    n = np.maximum(hi - lo, 0)
    ends = np.cumsum(n)
    i = 0
    while i < len(n):
        k = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
        own = n[i:k]
        x = np.repeat(np.arange(i, k), own)
        yield x, np.arange(len(x)) - np.repeat(np.cumsum(own) - own, own) + lo[x]
        i = k


def _meet(cell: np.ndarray, size: np.ndarray, node: np.ndarray, label: np.ndarray, bits: np.ndarray, least: Fraction) -> Iterator[np.ndarray]:
    """Pairs of different components that share a whole cell and can be similar by their ``bits``; rows sorted by cell and size."""
    p, q = least.numerator, least.denominator

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        keep = np.bitwise_count(bits[x, :2] ^ bits[y, :2]).sum(axis=1) <= BITS
        x, y = x[keep], y[keep]
        keep = (label[x] != label[y]) & _possible(size[x], size[y], bits[x, 2:] ^ bits[y, 2:], least)
        found = np.stack([node[x[keep]], node[y[keep]]], axis=1)
        return np.unique(np.sort(found, axis=1), axis=0)

    # The largest component of a cell, if it has more than GROUP nodes there.
    major = np.zeros(len(cell), bool)
    linked = np.flatnonzero(label != node)
    if len(linked) > GROUP:
        order = np.lexsort((label, cell))
        c, v = cell[order], label[order]
        starts = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (v[1:] != v[:-1])]))
        n = np.diff([*starts.tolist(), len(c)])
        big = np.flatnonzero(n > GROUP)
        big = big[np.lexsort((-n[big], c[starts[big]]))]
        for g in big[np.unique(c[starts[big]], return_index=True)[1]].tolist():
            major[order[starts[g] : starts[g] + n[g]]] = True
    key = cell << 32
    few, rest = np.flatnonzero(~major), np.flatnonzero(major)
    upto = key + np.minimum(size * q // p, (1 << 32) - 1)
    own = (key + size)[few]
    for x, y in _windows(np.arange(1, len(few) + 1), np.searchsorted(own, upto[few], "right")):
        yield near(few[x], few[y])
    if len(rest):
        own = (key + size)[rest]
        for x, y in _windows(np.searchsorted(own, key[few] - (-size[few] * p // q), "left"), np.searchsorted(own, upto[few], "right")):
            yield near(few[x], rest[y])


def links(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, text_at: str, words: int, least: Fraction) -> DataFrame:
    """The pairs (u, v) that are similar."""
    p, q = least.numerator, least.denominator

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
            ok = _possible(a, b, _bits(batch.column(4)) ^ _bits(batch.column(5)), least)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in (0, 1)], ["u", "v"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                own = pa.array([shingles(x, words).tobytes() for x in batch.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("node"), own], ["node", "own"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(both * q >= (len(a) + len(b) - both) * p)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok, pa.bool_())) for c in (0, 1)], ["u", "v"])

    side = lambda df, x: df.toDF(x, *[f"{c}_{x}" for c in df.columns[1:]])
    sides = nodes.select("node", "size", "parity")
    asked = pairs.join(side(sides, "u"), "u").join(side(sides, "v"), "v").select("u", "v", "size_u", "size_v", "parity_u", "parity_v")
    asked = materialize(asked.mapInArrow(lean(possible), "u long, v long"), "possible-pairs")
    own = materialize(asked.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "compared-nodes")
    texts = flag(rows.select("node", F.col(text_at).alias("text")), "node", *bit_array(own, "node", own.count(), 1)).where("possible").select("node", "text")
    texts = texts.groupBy("node").agg(F.first("text").alias("text")).join(own, "node", "left_semi")
    sets = materialize(texts.select("node", "text").mapInArrow(lean(hashed), "node long, own binary"), "shingle-sets")
    met = asked.join(side(sets, "u"), "u").join(side(sets, "v"), "v").select("u", "v", "own_u", "own_v")
    return materialize(met.mapInArrow(lean(similar), "u long, v long"), "links")


def cells(placed: DataFrame, cut: DataFrame, nodes: DataFrame, wide: int = WIDE) -> DataFrame:
    """(cell, minor, node, label, size, parity): the rows (band, node, label) of bands whose pairs have not all been compared.

    Cell (i, j) of a band holds block i of the nodes outside its largest
    component (``minor``) and block j of all its nodes.  A cell's number is a
    hash; a collision only adds comparisons.
    """
    bands = placed.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    bands = bands.join(cut, F.col("band") == F.col("cut"), "left").where(f"m > {NEXT + 1} or cut is not null")
    bands = materialize(bands.select("band", "m"), "open-bands")
    total = bands.agg(F.sum("m")).first()[0] or 0
    inside = materialize(spread_join(placed, bands, "band", "m", total, [F.col("node")], "inner"), "open-rows")
    parts = inside.groupBy("band", "label").agg(F.count(F.lit(1)).alias("k"), F.first("m").alias("m"))
    whole = parts.groupBy("band").agg(F.first("m").alias("m"), F.max("k").alias("most"), F.max_by("label", F.struct("k", "label")).alias("major"))
    whole = materialize(whole.select("band", "m", "major", F.ceil(F.col("m") / wide).alias("blocks"), F.ceil((F.col("m") - F.col("most")) / wide).alias("few")), "parted-bands")
    dealt = spread_join(inside.drop("m"), whole, "band", "m", total, [F.col("node")], "inner").join(nodes.select("node", "size", "parity"), "node")
    i, j = (F.pmod(F.xxhash64("node", F.lit(k)), F.col(n)) for k, n in ((1, "few"), (2, "blocks")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    place = lambda i, j, minor: F.struct(F.xxhash64("band", i, j).alias("cell"), F.lit(minor).alias("minor"))
    own = F.transform(upto("few"), lambda x: place(x, j, False))
    against = F.when(F.col("label") != F.col("major"), F.transform(upto("blocks"), lambda x: place(i, x, True)))
    put = dealt.select(F.explode(F.concat(own, F.coalesce(against, F.slice(own, 1, 0)))).alias("at"), "node", "label", "size", "parity")
    return put.select("at.cell", "at.minor", "node", "label", "size", "parity")


def anchor_pairs(nodes: DataFrame, least: Fraction, crowded: frozenset[int]) -> DataFrame:
    """The pairs (u, v) of different components that meet at an anchor, crowded ones apart; ``nodes`` have a label or none."""
    names = [f"b{i}" for i in range(2 + FOLDED)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = np.array(sorted(crowded), np.int64)
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                batch = whole.slice(i, 2048)
                prints = _prints(batch.column("prints"))
                folded = np.bitwise_xor.reduce(_bits(batch.column("parity")).reshape(-1, PARITY // 64 // FOLDED, FOLDED), axis=1)
                bits = np.concatenate([prints[:, :2], folded.view(np.int64)], axis=1)
                row, cell = anchors(prints)
                if len(apart):
                    keep = ~np.isin(cell, apart)
                    row, cell = row[keep], cell[keep]
                size, node = (batch.column(c).take(pa.array(row)) for c in ("size", "node"))
                label = batch.column("label").take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(cell), size, node, label, *[pa.array(x) for x in bits[row].T]], ["cell", "size", "node", "label", *names])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def met() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            cell, size, node = (t.column(c).to_numpy() for c in ("cell", "size", "node"))
            bits = np.stack([t.column(c).to_numpy() for c in names], axis=1).view(np.uint64)
            label = np.where(t.column("label").is_null().to_numpy(), node, t.column("label").fill_null(0).to_numpy())
            for found in _meet(cell, size, node, label, bits, least):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column("cell").to_numpy()
            cut = int(np.searchsorted(cell, cell[-1], "left"))  # the last cell can go on in the next batch
            if cut:
                held.append(batch.slice(0, cut))
            if held and held[0].column("cell")[0].as_py() != cell[-1]:
                yield from met()
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from met()

    made = nodes.select("node", "size", "parity", "prints", "label").mapInArrow(lean(rows), "cell long, size long, node long, label long, " + ", ".join(f"{c} long" for c in names))
    return made.repartition("cell").sortWithinPartitions("cell", "size").mapInArrow(lean(compare), "u long, v long").distinct()


def crowded_pairs(nodes: DataFrame, least: Fraction, crowded: frozenset[int], wide: int) -> DataFrame:
    """The pairs (u, v) of different components that meet at crowded anchors, cell by cell."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = np.array(sorted(crowded), np.int64)
        for batch in batches:
            row, band = anchors(_prints(batch.column("prints")))
            keep = np.isin(band, apart)
            node, label = (batch.column(c).take(pa.array(row[keep])) for c in ("node", "label"))
            yield pa.RecordBatch.from_arrays([pa.array(band[keep]), node, label], ["band", "node", "label"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def compare() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            minor, node, label, size = (t.column(c).to_numpy() for c in ("minor", "node", "label", "size"))
            for found in _across(node, label, size, _bits(t.column("parity")), minor, least):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["u", "v"])

        for batch in batches:
            cell = batch.column("cell").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for lo, hi in zip(edges, edges[1:]):
                if held and hi > lo and held[0].column("cell")[0].as_py() != cell[lo]:
                    yield from compare()
                    held = []
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield from compare()

    named = nodes.select("node", F.coalesce("label", "node").alias("label"), "prints")
    placed = materialize(named.mapInArrow(lean(rows), "band long, node long, label long"), "crowded-rows")
    cut = placed.select(F.col("band").alias("cut")).distinct()  # nothing of these anchors has been compared in full
    return cells(placed, cut, nodes, wide).repartition("cell").sortWithinPartitions("cell").mapInArrow(lean(across), "u long, v long").distinct()


def node_labels(rows: DataFrame, text_at: str, words: int = WORDS, least: Fraction = LEAST, wide: int = WIDE, crowd: int = CROWD) -> DataFrame:
    """(node, n, label, linked) of the rows of :func:`with_nodes`: rows of the node, smallest node of its component."""
    nodes = materialize(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("size", "parity", "prints")]), "nodes")
    # Different sets of fewer shingles cannot be similar.
    able = nodes.where(F.col("size") * (least.denominator - least.numerator) >= least.numerator)
    bands = able.select("node", "prints").mapInArrow(lean(_exact_rows), "band long, node long").repartitionByRange("band", "node").sortWithinPartitions("band", "node")
    first = materialize(bands.mapInArrow(lean(_neighbours), "u long, v long, cut long").where("cut is null").select("u", "v").distinct(), "first-pairs")
    labels = components(links(first, nodes, rows, text_at, words, least))
    labelled = materialize(able.join(labels, "node", "left"), "labelled-nodes")
    counts = able.select("prints").mapInArrow(lean(_counts), "band long, n long").groupBy("band").agg(F.sum("n").alias("n"))
    crowded = frozenset(r["band"] for r in counts.where(F.col("n") > crowd).collect())  # at most PIECES << 12
    rest = anchor_pairs(labelled, least, crowded)
    if crowded:
        rest = rest.unionByName(crowded_pairs(labelled, least, crowded, wide)).distinct()
    rest = materialize(rest.join(first, ["u", "v"], "left_anti"), "other-pairs")
    # The components so far are the nodes of what links them.
    more = links(rest, nodes, rows, text_at, words, least)
    for end in ("u", "v"):
        more = more.join(labels.toDF(end, "label"), end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
    merged = components(more.distinct()).toDF("part", "whole")
    parts = nodes.select("node", "n").join(labels, "node", "left").withColumn("part", F.coalesce("label", "node"))
    linked = F.col("label").isNotNull() | F.col("whole").isNotNull()
    return parts.join(merged, "part", "left").select("node", "n", F.coalesce("whole", "part").alias("label"), linked.alias("linked"))


def drop_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: Fraction = LEAST) -> DataFrame:
    """The rows of ``df`` with one row of each component of similar texts (smallest id, then text), all columns as they were.

    Shingles are runs of ``words`` words, A-Z lower-cased; texts without words
    are similar to each other only.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    rows = materialize(with_nodes(df, text_col, names, words), "docs-with-nodes")
    several = materialize(node_labels(rows, at(df, text_col), words, least).where("linked or n > 1").select("node", "label", "n"), "several")
    return keep_one(df, rows, "node", several, id_col, text_col)
