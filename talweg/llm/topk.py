"""Exact top-k search by Fagin's threshold algorithm over blocks of rows.

Rows are dealt over blocks of bounded size, near ones together (by the nearest
of a bounded number of pivots).  A block keeps a list of its rows for each
dimension, sorted by component.  A query reads each list from the end that
suits the sign of its own component and has a frontier of its own in it; it
reads on in the lists that lower its bound most.  Every row met is scored in
full by random access.  The query stops once the bound, what the frontiers can
still give in all dimensions together, cannot beat its k-th score.

First each query searches its own block.  The k-th score found there meets the
bounds of all other blocks at their lists' heads, and only blocks whose bound
can still beat (or tie with) it are searched.  Where vectors have no structure
few blocks and few rows are passed over: results are exact in any case.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from talweg.llm._common import materialize, pick

#: Rows of a block, about; queries searched against a block in one task, about.
CANDIDATES, QUERIES = 8192, 2048
#: Most blocks, whose heads (two numbers a dimension) go to every task: blocks of larger tables are larger.
MAX_BLOCKS = 16_384
#: Most pivots.
PIVOTS = 256
#: Entries first read from a list; lists read on in a round.
FIRST, LISTS = 32, 8


def quantized(vector: Column) -> Column:
    """floor(64 * x) of each component; null for vectors with null or non-finite components."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(whole, F.transform(vector, lambda x: F.floor(x.cast("double") * 64)))


@dataclass
class Work:
    """What a search has read: list entries, rows scored, and queries that the bound stopped."""

    entries: int = 0
    rows: int = 0
    stopped: int = 0


def threshold_search(x: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, Work]:
    """Scores and row numbers of the k best rows of ``x`` for each row of ``q``, and the work done.

    Rows of ``x`` are in the order that decides ties.  ``own`` is the row
    number that a query must not match, or -1.  Rows that score less than
    ``floor`` may be left out.  Missing places have score -inf.
    """
    n, m = len(x), len(q)
    out_s, out_i, work = np.full((m, k), -np.inf), np.full((m, k), n, np.int64), Work()
    lists = np.argsort(x, axis=0, kind="stable").T.copy()
    values = np.take_along_axis(x.T, lists, axis=1)
    for j in range(m):
        rows, scores = _search_one(x, lists, values, q[j], int(own[j]), k, -np.inf if floor is None else float(floor[j]), work)
        best = np.lexsort((rows, -scores))[:k]
        out_s[j, : len(best)], out_i[j, : len(best)] = scores[best], rows[best]
    return out_s, out_i, work


def _search_one(x: np.ndarray, lists: np.ndarray, values: np.ndarray, q: np.ndarray, own: int, k: int, floor: float, work: Work) -> tuple[np.ndarray, np.ndarray]:
    """Rows that can be among the k best, with their scores."""
    n = len(x)
    used = np.flatnonzero(q)
    up = q[used] > 0
    weight = q[used]
    place = lambda depth: np.where(up, n - 1 - depth, depth)
    depth = np.zeros(len(used), np.int64)  # entries read; the next one is the frontier
    gives = weight * values[used, place(depth)]
    met = np.zeros(n, bool)
    if own >= 0:
        met[own] = True  # never a result
    rows, scores, kth = np.empty(0, np.int64), np.empty(0), floor
    step, product = FIRST, None
    while True:
        if kth > gives.sum():
            work.stopped += 1
            break
        if (depth >= n).any() or not len(used):
            # All rows have been met by a list that is read to its end; a query of zeros scores 0 everywhere.
            new = np.flatnonzero(~met)
        else:
            to = np.minimum(depth + step, n)
            ahead = weight * values[used, place(np.minimum(to, n - 1))]
            steep = np.argsort(-(gives - ahead), kind="stable")[:LISTS]
            parts = []
            for i in steep.tolist():
                a, b = int(depth[i]), int(to[i])
                parts.append(lists[used[i], n - b : n - a] if up[i] else lists[used[i], a:b])
                work.entries += b - a
            depth[steep] = to[steep]
            gives[steep] = np.where(depth[steep] < n, ahead[steep], gives[steep])
            here = np.zeros(n, bool)
            for p in parts:
                here[p] = True
            new = np.flatnonzero(here & ~met)
        if len(new):
            met[new] = True
            work.rows += len(new)
            if product is None and len(new) * 4 > n:
                product = x @ q  # one product is cheaper than gathering so many rows
            s = x[new] @ q if product is None else product[new]
            rows, scores = np.concatenate([rows, new]), np.concatenate([scores, s])
            if len(scores) > k:
                least = -np.partition(-scores, k - 1)[k - 1]
                keep = scores >= least  # ties with the k-th stay
                rows, scores, kth = rows[keep], scores[keep], max(floor, least)
            elif len(scores) == k:
                kth = max(floor, scores.min())
        if met.all():
            break
        step *= 2
    return rows, scores


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of the lists, filled up with zeros."""
    own = column.combine_chunks()
    own = own if isinstance(own, pa.Array) else pa.concat_arrays(own.chunks)
    lengths = own.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(own), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = own.flatten().to_numpy(zero_copy_only=False)
    return out


def _placed(rows: DataFrame, total: int, width: int) -> tuple[DataFrame, int]:
    """Rows with their ``block``, and the number of blocks: by nearest pivot, and by hash where a pivot has many rows."""
    size = max(CANDIDATES, math.ceil(total / MAX_BLOCKS))
    wanted = min(PIVOTS, math.ceil(total / size))
    if wanted == 1:
        return rows.withColumn("block", F.lit(0)), 1
    found = rows.orderBy(F.xxhash64("seq", F.lit(2)), "seq").limit(wanted).select("v").collect()
    pivots = np.zeros((len(found), width))
    for i, r in enumerate(found):
        pivots[i, : len(r["v"])] = r["v"]
    half = (pivots**2).sum(axis=1) / 2

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(pa.chunked_array([batch.column(1)]), width)
            near = (x @ pivots.T - half).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], [*batch.schema.names, "pivot"])

    near = materialize(rows.mapInArrow(assign, StructType([*rows.schema.fields, StructField("pivot", IntegerType())])), "near-pivots")
    counts = {r["pivot"]: r["n"] for r in near.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most PIVOTS
    first, blocks = {}, 0
    for p in sorted(counts):
        first[p] = blocks
        blocks += math.ceil(counts[p] / size)
    table = F.create_map(*[F.lit(v) for p in sorted(counts) for v in (p, first[p])])
    split = F.create_map(*[F.lit(v) for p in sorted(counts) for v in (p, math.ceil(counts[p] / size))])
    block = F.element_at(table, F.col("pivot")) + F.pmod(F.xxhash64("seq"), F.element_at(split, F.col("pivot"))).cast("int")
    return near.withColumn("block", block).drop("pivot"), blocks


def top_k(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's k best other rows, ties to the smaller id (null before any other).

    ``is_query`` is a condition on the column ``vec_id``.  Vectors that are
    null or hold null or non-finite components take no part; shorter vectors
    count as filled up with zeros, empty ones score 0.  A row of the same id is
    another row, and rows of one id and score are all listed.  An empty table,
    or one without queries, gives an empty result.  Other columns are ignored.
    Results are exact while scores stay below 2**53.
    """
    if k < 1:
        raise ValueError("k must be positive")
    rows = pick(df, vec_id=id_col, embedding=vector_col)
    rows = rows.withColumn("v", quantized(F.col("embedding"))).where(F.col("v").isNotNull()).select("vec_id", "v", F.monotonically_increasing_id().alias("seq"))
    rows = materialize(rows, "vectors")
    total, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = max(1, width or 0)
    placed, blocks = _placed(rows, total, width)
    placed = materialize(placed.withColumn("query", F.coalesce(is_query, F.lit(False))), "blocks")
    result = "query_seq long, query_id long, vec_id long, seq long, score long"

    def load(cell: pa.Table) -> tuple[pa.Table, np.ndarray]:
        own = cell.filter(cell.column("own"))
        own = own.take(pc.sort_indices(own, [("vec_id", "ascending"), ("seq", "ascending")], null_placement="at_start")).combine_chunks()
        return own, _matrix(own.column("v"), width)

    def listed(own: pa.Table, ask: pa.Table, s: np.ndarray, i: np.ndarray) -> dict:
        row, col = np.nonzero(np.isfinite(s))
        hit = i[row, col]
        asked, found = ask.take(pa.array(row)), own.take(pa.array(hit))
        return {"query_seq": asked.column("seq"), "query_id": asked.column("vec_id"), "vec_id": found.column("vec_id"), "seq": found.column("seq"), "score": s[row, col].astype(np.int64)}

    def search(cell: pa.Table) -> pa.Table:
        """Rows of one block (own) and queries with the score they must reach."""
        cell = cell.combine_chunks()
        own, x = load(cell)
        ask = cell.filter(cell.column("ask"))
        if not len(own) or not len(ask):
            return pa.table({n: np.empty(0, np.int64) for n in ("query_seq", "query_id", "vec_id", "seq", "score")})
        place = {v: i for i, v in enumerate(own.column("seq").to_pylist())}
        mine = np.array([place.get(v, -1) for v in ask.column("seq").to_pylist()])
        s, i, _ = threshold_search(x, _matrix(ask.column("v"), width), mine, k, ask.column("floor").to_numpy())
        return pa.table(listed(own, ask, s, i))

    def cells(asked: DataFrame) -> DataFrame:
        """Results of the pairs (block, query) in ``asked``; the queries of a block are dealt over chunks."""
        chunks = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("chunks"))  # at most MAX_BLOCKS rows and a few
        blank = F.lit(float("-inf")).alias("floor")
        ours = placed.join(F.broadcast(chunks), "block").select("block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "vec_id", "v", "seq", blank, F.lit(True).alias("own"), F.lit(False).alias("ask"))
        theirs = asked.join(F.broadcast(chunks), "block").select("block", F.pmod(F.xxhash64("seq"), F.col("chunks")).cast("int").alias("chunk"), "vec_id", "v", "seq", "floor", F.lit(False).alias("own"), F.lit(True).alias("ask"))
        return ours.unionByName(theirs).groupBy("block", "chunk").applyInArrow(search, result)

    queries = placed.where("query").select("block", "vec_id", "v", "seq")
    home = cells(queries.withColumn("floor", F.lit(float("-inf"))))
    if blocks == 1:
        found = home
    else:
        home = materialize(home, "home-results")
        reached = home.groupBy("query_seq").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("least"))
        reached = reached.select("query_seq", F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(float("-inf"))).alias("floor"))

        def head(block: pa.Table) -> pa.Table:
            x = _matrix(block.column("v"), width)
            return pa.table({"block": block.column("block").slice(0, 1), "high": [x.max(axis=0).tolist()], "low": [x.min(axis=0).tolist()]})

        ends = placed.select("block", "v").groupBy("block").applyInArrow(head, "block int, high array<double>, low array<double>").collect()  # at most MAX_BLOCKS rows and a few
        high, low = (np.array([r[n] for r in ends]).T for n in ("high", "low"))
        number = np.array([r["block"] for r in ends], np.int32)
        asked = queries.join(reached, queries["seq"] == reached["query_seq"], "left").select(F.col("block").alias("home"), "vec_id", "v", "seq", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))

        def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, len(whole), 256):
                    batch = whole.slice(start, 256)
                    q = _matrix(pa.chunked_array([batch.column("v")]), width)
                    bound = np.where(q > 0, q, 0) @ high + np.where(q < 0, q, 0) @ low
                    own = number[None, :] == batch.column("home").to_numpy()[:, None]
                    row, col = np.nonzero(~own & ~(batch.column("floor").to_numpy()[:, None] > bound))
                    part = batch.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([pa.array(number[col]), *part.columns[1:]], ["block", "vec_id", "v", "seq", "floor"])

        pairs = materialize(asked.mapInArrow(others, "block int, vec_id long, v array<bigint>, seq long, floor double"), "open-blocks")
        found = home.unionByName(cells(pairs))
    best = Window.partitionBy("query_seq").orderBy(F.col("score").desc(), "vec_id", "seq")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
