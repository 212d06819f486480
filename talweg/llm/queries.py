"""The thin queries over the test tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from talweg.llm.bpe import round_trip

    out = round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(
        F.col("id").alias("doc_id"),
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talweg.llm.toxicity import score, train

    docs = _table(spark, sf_dir, "documents")
    return score(docs, train(docs, _table(spark, sf_dir, "labels")))


#: Rules of the query op3: fixed values.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talweg.llm.url_filter import filter_urls

    return filter_urls(_table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "rule string, verdict string"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talweg.llm.exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from talweg.llm.packing import pack

    out = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return out.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket", "batch_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talweg.llm.warc import archive_pages

    back = archive_pages(_table(spark, sf_dir, "pages"))
    return back.select(
        F.col("source_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talweg.llm.topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talweg.llm.quality import train_and_score

    return train_and_score(_table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talweg.llm.secrets import scan_secrets

    return scan_secrets(_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talweg.llm.simhash import near_duplicates

    out = near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_byte_bpe, op2_toxicity, op3_url_filter, op4_exact_dedup, op5_packing, op6_warc, op7_topk, op8_quality, op9_secrets, op10_simhash)
}

SQL: dict[str, str] = {
    "op4_exact_dedup": """
        with t as (
            select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents
        ), g as (
            select text_sha256, max(doc_id) as keep_id, count(*) as group_size from t group by text_sha256
        )
        select doc_id, keep_id, cast(group_size as bigint) as group_size, doc_id = keep_id as kept, text_sha256
        from t join g using (text_sha256)
    """,
    "op3_url_filter": """
        with p as (
            select page_id, url, coalesce(strpos(url, '://'), 0) as mark from pages
        ), q as (
            select page_id, case when mark > 0 then substr(url, mark + 3) else '' end as rest from p
        ), h as (
            select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path
            from q
        ), rules(rule, rule_host, rule_path, verdict) as (
            values ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'),
                ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')
        ), m as (
            select h.page_id, r.rule, r.verdict, row_number() over (partition by h.page_id order by length(r.rule) desc) as k
            from h join rules r on (h.host = r.rule_host or ends_with(h.host, '.' || r.rule_host)) and starts_with(h.path, r.rule_path)
        )
        select h.page_id, h.host, h.path, m.rule, coalesce(m.verdict, 'allow') as verdict
        from h left join m on h.page_id = m.page_id and m.k = 1
    """,
    "op7_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as v from embeddings where embedding is not null
        ), s as (
            select a.vec_id as query_id, b.vec_id, cast(list_inner_product(a.v, b.v) as bigint) as score
            from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0
        ), t as (
            select query_id, row_number() over (partition by query_id order by score desc, vec_id) as k, vec_id, score from s
        )
        select query_id, cast(k as integer) as rank, vec_id, score from t where k <= 20
    """,
}
