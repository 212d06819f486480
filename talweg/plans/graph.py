"""Fixpoints and graphs on DataFrames, with lineage cut in the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder is set on a local master only, for elsewhere executors could not share it."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="talweg-checkpoint-"))
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder.  ``spark.cleaner.referenceTracking.cleanCheckpoints`` deletes what is no longer used."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fix(state: DataFrame, step: Callable[[DataFrame], DataFrame], changed: str = "changed", rounds: int = 100_000) -> DataFrame:
    """Repeat ``step`` until no row has ``changed``; raises after ``rounds``."""
    state = cut(state)
    for _ in range(rounds):
        state = cut(step(state))
        if state.where(changed).isEmpty():
            return state.drop(changed)
    raise RuntimeError(f"no fixpoint after {rounds} rounds")


def pointer_doubling(nodes: DataFrame, sums: dict[str, str], down: tuple[str, ...] = ()) -> DataFrame:
    """Aggregate over all nodes upstream, the node itself included, on a forest.

    ``nodes`` has ``id``, ``next`` (null at roots) and value columns; ``sums``
    maps value columns to ``sum``, ``min`` or ``max``; the columns ``down`` are
    added up along the way to the root.  The result has ``id``, the columns and
    ``root``.  A cycle never runs out of pointers: RuntimeError.
    """
    agg = {"sum": F.sum, "min": F.min, "max": F.max}
    state = cut(nodes.select("id", "next", *sums, *down, F.coalesce("next", "id").alias("root")))
    for _ in range(state.count().bit_length() + 1):  # a longer path would pass a node twice
        if state.where("next is not null").isEmpty():
            return state.drop("next")
        far = state.select(F.col("id").alias("_at"), F.col("next").alias("_far"), F.col("root").alias("_root"), *[F.col(c).alias(f"_{c}") for c in down])
        jumped = state.select("id", "next", "root", *down).join(far, F.col("next") == F.col("_at"), "left")
        jumped = jumped.select("id", F.col("_far").alias("next"), F.coalesce("_root", "root").alias("root"), *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in down])
        if sums:
            up = state.where("next is not null").select(F.col("next").alias("id"), *sums)
            merged = state.select("id", *sums).unionByName(up).groupBy("id").agg(*[agg[how](c).alias(c) for c, how in sums.items()])
            jumped = jumped.join(merged, "id")
        state = cut(jumped)
    raise RuntimeError("flow runs in a circle")


def _ordered(df: DataFrame, *order: str) -> tuple[DataFrame, list[int]]:
    """Rows dealt over partitions by ranges of ``order`` and sorted there, with ``_part``, and the rows of each partition."""
    dealt = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    return dealt, [sizes.get(i, 0) for i in range(max(sizes, default=-1) + 1)]


def numbered(df: DataFrame, order: str, name: str = "value") -> DataFrame:
    """``df`` with the place of each row, from 1, in the order of a column without repeats: each range of values is one task."""
    dealt, sizes = _ordered(df, order)
    before = F.array(*[F.lit(sum(sizes[:i])).cast("long") for i in range(max(1, len(sizes)))])
    own = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return dealt.withColumn(name, (F.element_at(before, F.col("_part") + 1) + own).cast("int")).drop("_part")


def percentiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation: counts of distinct values, dealt by ranges, give every value's ranks."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    dealt, _ = _ordered(counts, "v")
    sizes = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.sum("n").alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        return [None] * len(shares)
    before = F.array(*[F.lit(sum(n for p, n in sizes.items() if p < i)).cast("long") for i in range(max(sizes) + 1)])
    upto = F.element_at(before, F.col("_part") + 1) + F.sum("n").over(Window.partitionBy("_part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = dealt.withColumn("upto", upto)
    wanted = sorted({r for s in shares for r in (int(s * (total - 1)), min(total - 1, int(s * (total - 1)) + 1))})
    picked = ranked.where(F.exists(F.array(*[F.lit(r) for r in wanted]), lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))).select("v", "upto", "n").collect()
    at = {r: p["v"] for p in picked for r in wanted if p["upto"] - p["n"] <= r < p["upto"]}
    out = []
    for s in shares:
        lo = int(s * (total - 1))
        a, b = at[lo], at[min(total - 1, lo + 1)]
        out.append(a + (b - a) * (s * (total - 1) - lo))
    return out


def component_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): smallest id of each connected component; ``edges`` (a, b) count both ways."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())

    def step(state: DataFrame) -> DataFrame:
        heard = both.join(state.select(F.col("id").alias("a"), "label"), "a").groupBy(F.col("b").alias("id")).agg(F.min("label").alias("heard"))
        new = state.select("id", F.col("label").alias("old")).join(heard, "id", "left").withColumn("label", F.least("old", "heard"))
        up = new.select(F.col("id").alias("_at"), F.col("label").alias("_up"))
        new = new.join(up, F.col("label") == F.col("_at"), "left").withColumn("label", F.least("label", "_up"))
        return new.select("id", "label", (F.col("label") < F.col("old")).alias("changed"))

    return fix(nodes.select("id", F.col("id").alias("label"), F.lit(True).alias("changed")), step)


def cell_id(row: Column, col: Column, width: int) -> Column:
    return row.cast("long") * F.lit(width) + col
