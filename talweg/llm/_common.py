"""What several operators share: scratch tables, sealed rows, hot-key joins."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A key is hot if it has more than one in HOT_SHARE of all rows, so at most HOT_SHARE keys are hot.
HOT_SHARE = 200
#: The rows of a hot key are dealt over so many salts.
HOT_SALTS = 64


#: Scratch tables that this process has written and not yet released.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where the session names none, a local folder is set on a local master only;
    elsewhere executors could not share it, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="talweg-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; :func:`release` or :func:`scratch` frees it."""
    path = f"{shared_dir(spark)}/talweg-{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Empty scratch tables, all of this process or some: each is overwritten with a table of no rows."""
    for path in list(_made) if paths is None else paths:
        spark.createDataFrame([], "gone int").write.mode("overwrite").parquet(path)
        if path in _made:
            _made.remove(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside are released at the end, when results must have been written or collected."""
    before = set(_made)
    try:
        yield
    finally:
        release(spark, [p for p in _made if p not in before])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Functions whose lru_cache a worker process keeps from task to task.
_kept: list = []


def kept(cached: Callable) -> Callable:
    """Mark a function with an lru_cache as one that workers keep, see :func:`lean`."""
    _kept.append(cached)
    return cached


def give_back() -> None:
    """Return to the system what Arrow and the C library hold of freed memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def _lean(run: Callable, keep: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not keep and any(cached.cache_info().currsize for cached in _kept):
        for cached in _kept:
            cached.cache_clear()
        give_back()
    try:
        yield from run(batches)
    finally:
        give_back()


def lean(run: Callable, keep: bool = False) -> Callable:
    """``run`` for mapInArrow in workers that outlive it.

    Spark reuses a worker for other operators and lets it idle beside JVM
    tasks, within the executor's memory.  So a task gives freed memory back at
    its end, and unless it uses them itself (``keep``) it first drops the
    caches that earlier operators left in the worker.
    """

    def task(batches):
        return _lean(run, keep, batches)

    return task


def positional(df: DataFrame) -> DataFrame:
    """The same rows under the names c0, c1, ...: no name of the caller can clash with an operator's own."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def at(df: DataFrame, name: str) -> str:
    """The positional name of the column called exactly ``name`` (the first, if several are)."""
    if name not in df.columns:
        raise ValueError(f"no column {name!r} in {df.columns}")
    return f"c{df.columns.index(name)}"


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, under the operator's own names."""
    return positional(df).select(*[F.col(at(df, name)).alias(own) for own, name in wanted.items()])


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only.  Texts that are all ASCII take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def atomic(df: DataFrame, prefix: str = "") -> list[Column]:
    """The columns of ``df`` that can be hashed and compared, as columns below ``prefix``."""
    plain = ("string", "binary", "bool", "tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "date", "timestamp")
    return [F.col(f"{prefix}{name}") for name, kind in df.dtypes if kind.startswith(plain) and "<" not in kind]


def row_order(df: DataFrame, prefix: str = "") -> Column:
    """A hash of a whole row below ``prefix``: decides between rows that tie otherwise, so that a task run again chooses alike.

    Maps, and what holds them, do not count; rows that differ in nothing else are interchangeable.
    """
    names = [F.col(f"{prefix}{name}") for name, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    return F.xxhash64(F.lit(5), *names)


def spread_join(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, by: list[Column], how: str = "left") -> DataFrame:
    """Join rows to the one group row of their key, with hot keys dealt over salts.

    ``groups`` has each key once, with the number of rows that it has in
    ``size``; the sizes add up to at most ``total``.  Thus at most HOT_SHARE
    keys are hot, and only those keys are broadcast.  The salt is a hash of
    ``by``, so that a task run again deals its rows alike.
    """
    hot = F.col(size) * F.lit(HOT_SHARE) > F.lit(total)
    hot_keys = groups.where(hot).select(F.col(key), F.lit(True).alias("_hot"))
    salt = F.pmod(F.xxhash64(*by), F.lit(HOT_SALTS)).cast("int")
    dealt = rows.join(F.broadcast(hot_keys), key, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(F.lit(0))).drop("_hot")
    copied = groups.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copied, [key, "_salt"], how).drop("_salt")
