"""Exact deduplication by two passes over a Bloom bit array.  DataFrame functions only.

Pass one hashes every row into ``HASHES`` cells of a bit array and keeps the
cells that more than one row has hit.  Pass two tests each row against that
array: a row with a cell that nobody else hit is certainly the only one of its
key and passes straight through; only the possibly repeated rows shuffle, and
an exact aggregation removes the array's false positives.

The array has ``BITS_PER_ROW`` bits a row, at most ``MAX_BITS`` (32 MB), which
bounds what is broadcast.  Beyond that the array gets denser: more rows
shuffle, and results stay exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.llm._common import at, lower_ascii, materialize, pick, positional, row_order, spread_join

HASHES, BITS_PER_ROW, MAX_BITS = 2, 16, 1 << 28
#: Bits of one row of the array; fixed by bitmap_construct_agg.
BUCKET = 32768


def text_key(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased; null counts as empty."""
    return F.unhex(F.sha2(lower_ascii(F.coalesce(text, F.lit(""))).cast("binary"), 256))


def _cell(key: str, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(bits)).cast("long")


def bit_array(keyed: DataFrame, key: str, rows: int, least: int = 2) -> tuple[DataFrame, int]:
    """The array of cells hit ``least`` times or more, as rows (bucket, bits), and its size in bits."""
    bits = BUCKET
    while bits < min(MAX_BITS, BITS_PER_ROW * rows):
        bits *= 2
    cells = keyed.select(F.explode(F.array(*[_cell(key, i, bits) for i in range(HASHES)])).alias("cell"))
    again = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    array = (
        again.select((F.col("cell") + 1).alias("cell"), F.bitmap_bucket_number(F.col("cell") + 1).alias("bucket"))
        .repartition("bucket")
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
    )
    return materialize(array, "bit-array"), bits


def flag(keyed: DataFrame, key: str, array: DataFrame, bits: int) -> DataFrame:
    """Add ``possible``: false only for rows whose key is certainly not in the array."""
    out = keyed
    for i in range(HASHES):
        side = array.select(F.col("bucket").alias(f"_b{i}"), F.col("bits").alias(f"_a{i}"))
        out = out.withColumn(f"_c{i}", _cell(key, i, bits) + 1).withColumn(f"_n{i}", F.bitmap_bucket_number(F.col(f"_c{i}")))
        out = out.join(F.broadcast(side), F.col(f"_n{i}") == F.col(f"_b{i}"), "left")
    hit = F.lit(True)
    for i in range(HASHES):
        at_bit = F.bitmap_bit_position(F.col(f"_c{i}"))
        byte = F.conv(F.hex(F.substring(F.col(f"_a{i}"), (F.floor(at_bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        hit = hit & F.coalesce(F.getbit(byte, F.pmod(at_bit, F.lit(8)).cast("int")) == 1, F.lit(False))
    return out.withColumn("possible", hit).drop(*[f"_{c}{i}" for c in "bacn" for i in range(HASHES)])


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z only; null counts as
    empty.  Of equal texts the row with the largest id stays; a null id is
    smaller than any other.  Of repeated rows (same id and text) exactly one
    is kept.  An empty table gives an empty result.  Other columns are ignored.
    """
    keyed = pick(df, id=id_col, text=text_col).select(
        "id", text_key(F.col("text")).alias("key"), F.monotonically_increasing_id().alias("seq")
    )
    keyed = materialize(keyed, "text-keys")
    total = keyed.count()
    flagged = flag(keyed, "key", *bit_array(keyed, "key", total))
    alone = flagged.where(~F.col("possible")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "key"
    )
    again = flagged.where("possible").select("id", "key", "seq")
    groups = again.groupBy("key").agg(F.max(F.struct("id", "seq")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    groups = materialize(groups, "text-groups")
    joined = spread_join(again, groups, "key", "group_size", total, [F.col("seq")], "inner").select(
        "id", F.col("keep.id").alias("keep_id"), "group_size", (F.col("seq") == F.col("keep.seq")).alias("kept"), "key"
    )
    return alone.unionByName(joined).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("key")).alias("text_sha256")
    )


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with one row for each text, all columns as they were.

    Equality and choice as in :func:`exact_dedup`; between rows of one id the
    largest text stays (equal texts can differ in case), and of rows with equal
    id and text that with the largest hash over all columns, whatever the order
    of tasks.  An empty table gives an empty result.
    """
    id_at, text_at = at(df, id_col), at(df, text_col)
    rows = positional(df).select(F.struct("*").alias("row"))
    keyed = rows.withColumn("key", text_key(F.col(f"row.{text_at}")))
    keys = materialize(keyed.select("key"), "text-keys")
    flagged = flag(keyed, "key", *bit_array(keys, "key", keys.count()))
    alone = flagged.where(~F.col("possible")).select("row")
    best = F.max_by("row", F.struct(F.col(f"row.{id_at}"), F.col(f"row.{text_at}"), row_order(positional(df), "row.")))
    again = flagged.where("possible").groupBy("key").agg(best.alias("row")).select("row")
    return alone.unionByName(again).select("row.*").toDF(*df.columns)
