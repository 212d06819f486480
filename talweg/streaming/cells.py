"""Extension: readings of cells as a stream, kept as the newest value of each cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def newest(readings: DataFrame, late: str = "1 hour") -> DataFrame:
    """(row, col, value, ts): the newest reading of each cell; readings later than ``late`` are dropped with their state kept."""
    return readings.withWatermark("ts", late).groupBy("row", "col").agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))


def upsert(readings: DataFrame, path: str, late: str = "1 hour") -> DataStreamWriter:
    """Writes every micro-batch's new state of the touched cells under ``path``, one folder a batch."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return newest(readings, late).writeStream.outputMode("update").foreachBatch(put)


def current(spark, path: str) -> DataFrame:
    """The cells after all batches."""
    return spark.read.parquet(path).groupBy("row", "col").agg(F.max_by("value", F.struct("ts", "batch")).alias("value"))
