"""Corpus pipeline: toxicity, exact dedup, SimHash near-dedup, secret scans, packing.

Every stage works on all rows that its predecessor kept, and its result is
written as Parquet and read again.  All but the last return the columns of
``documents``; the last returns the pieces of the packed corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talweg.llm._common import release, scratch, scratch_path


#: Bytes of text that packing encodes at a time: its workers run beside executors that all stages have filled.
PACKED_AT_A_TIME = 1_000_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    from talweg.llm.toxicity import drop_toxic, train

    return drop_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    from talweg.llm.exact_dedup import drop_repeats

    return drop_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts that share 0.8 or more of their five-word shingles the row with the smallest doc_id stays."""
    from talweg.llm.similar import drop_similar

    return drop_similar(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by their kind; every row stays."""
    from talweg.llm.secrets import redact_secrets

    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths with their packed ids."""
    import public_tokenizers

    from talweg.llm.packing import pack

    # Texts from the web may spell an added token: in the corpus that is ordinary text.
    out = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, added=False, most=PACKED_AT_A_TIME)
    return out.withColumnRenamed("id", "doc_id")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secrets", secrets),
    ("packing", packing),
]

#: The first stage is a trained model, so SQL cannot express the rows of run().
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``.

    A stage's scratch tables and its input are emptied once its result is
    written.  The input of the last stage, which is lazy, stays until the
    caller has used the result and calls ``talweg.llm._common.release``.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(spark, before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
