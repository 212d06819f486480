"""Packing by power-of-two decomposition.

Each document's ids (with the end id) are cut into pieces whose lengths are
powers of two, the longest ``SEQUENCE``: as many full ones as fit, then one
piece for each bit of the rest.  Each piece is a sequence of its own in the
bucket of its length, so no sequence crosses documents and none is padded.
Pieces of one bucket are stacked into batches of equal lengths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.llm._common import lean, pick
from talweg.llm.bpe import BATCH_CHARS, CACHE, codec, packed_rows, slices

SEQUENCE = 2048


def piece_lengths(n: int, longest: int = SEQUENCE) -> list[int]:
    """Powers of two that add up to ``n``, the longest first."""
    out = [longest] * (n // longest)
    rest = n % longest
    return out + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack(df: DataFrame, path: str, pattern: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", longest: int = SEQUENCE, added: bool = True, most: int = BATCH_CHARS) -> DataFrame:
    """One row per piece: ``id, start, length, ids`` (packed), ``doc_tokens, bucket, batch_id, sequence_id, offset``.

    ``longest`` is a power of two.  A null or empty text is one piece, the end
    id alone.  Repeated rows are packed each for itself; other columns are
    ignored; an empty table gives an empty result.  A piece is the only one of
    its sequence: its offset is 0.  ``bucket`` is the base-2 logarithm of its
    length, and pieces of one ``batch_id`` are of one bucket and have ``longest``
    ids together, or fewer in the last batch of a bucket and partition: stacked,
    they are a rectangle without padding.  With ``added`` the strings of added
    tokens in a text become those tokens, as the tokenizers library has it.
    About ``most`` bytes of text are encoded at a time, with caches in proportion:
    fewer take less of a worker's memory and more time, and the pieces are the same.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    rows = pick(df, id=id_col, text=text_col)
    powers = longest.bit_length() - 1

    def run(batches):
        from pyspark import TaskContext

        own = codec(path, pattern, added, CACHE * most // BATCH_CHARS)
        part = TaskContext.get().partitionId()
        met = np.zeros(powers + 1, np.int64)  # pieces of each bucket so far
        for whole in batches:
            for batch in slices(whole, most=most):
                ids, ends = own.encode_column(batch.column(1))
                n = len(ends)
                if not n:
                    continue
                whole_ids = np.insert(ids, ends, end_id).astype("<u4")
                tokens = np.diff(ends, prepend=0) + 1
                # Full pieces, then one for each bit of the rest, the longest first.
                times = np.concatenate([(tokens >> powers)[:, None], (tokens[:, None] >> np.arange(powers - 1, -1, -1)) & 1], axis=1)
                size = np.repeat(np.tile(1 << np.arange(powers, -1, -1), n), times.ravel())
                row = np.repeat(np.arange(n), times.sum(axis=1))
                stop = np.cumsum(size)
                first = np.cumsum(tokens) - tokens
                bucket = np.repeat(np.tile(np.arange(powers, -1, -1), n), times.ravel())
                number = np.empty(len(size), np.int64)
                for b in range(powers + 1):
                    at = np.flatnonzero(bucket == b)
                    number[at] = met[b] + np.arange(len(at))
                    met[b] += len(at)
                group = (part << 40) | (bucket.astype(np.int64) << 34) | (number >> (powers - bucket))
                made = [stop - size - first[row], size]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in made), packed_rows(whole_ids, stop), *(pa.array(x, t) for x, t in ((tokens[row], pa.int64()), (bucket, pa.int32()), (group, pa.int64())))],
                    ["id", "start", "length", "ids", "doc_tokens", "bucket", "batch_id"],
                )
                if most < BATCH_CHARS:
                    pa.default_memory_pool().release_unused()

    kind = rows.schema["id"].dataType.simpleString()
    pieces = rows.mapInArrow(lean(run, keep=True), f"id {kind}, start long, length long, ids binary, doc_tokens long, bucket int, batch_id long")
    return pieces.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Store pieces by the bucket of their length, one folder a bucket."""
    pieces.write.partitionBy("bucket").parquet(path)
