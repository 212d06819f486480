"""URL filters: a blocked Bloom filter in front of an exact hash join.

A rule is a host with a path prefix (``net/de/``) and a verdict.  It fits its
host and all subdomains, where the URL's path starts with the rule's; the
longest fitting rule wins.  A URL's possible rules are its host suffixes, each
with the prefixes of its path that are as long as some rule's path.  These
keys are tested against the blocked Bloom filter of the rules' keys; possible
hits go to an exact join on the key, which removes false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.llm._common import LOWER, UPPER, materialize, pick, spread_join

#: Words (64 bits each) of a block; blocks for each rule, at most MAX_BLOCKS (32 MB).
WORDS, RULES_PER_BLOCK, MAX_BLOCKS = 4, 8, 1 << 20


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and without ``://``."""
    mark = F.instr(url, "://")
    rest = F.substring(url, mark + 3, F.char_length(url))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.char_length(rest)), "^[^?#]*", 0)
    fits = F.coalesce(mark > 0, F.lit(False))
    return F.when(fits, F.translate(host, UPPER, LOWER)).otherwise(""), F.when(fits, path).otherwise("")


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(blocks))


def _masks(key: str) -> list[Column]:
    """One bit in each word of the block."""
    second = F.xxhash64(F.col(key), F.lit(7))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def blocked_bloom(keys: DataFrame, key: str, rows: int) -> tuple[DataFrame, int]:
    """The filter as rows (block, w0, w1, ...) and its number of blocks."""
    blocks = 1
    while blocks < min(MAX_BLOCKS, rows / RULES_PER_BLOCK):
        blocks *= 2
    masks = [m.alias(f"w{i}") for i, m in enumerate(_masks(key))]
    table = keys.select(_block(key, blocks).alias("block"), *masks).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
    return materialize(table, "blocked-bloom"), blocks


def filter_urls(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict``.

    ``rules`` has the columns ``rule`` and ``verdict``.  Of equal rules with
    two verdicts ``block`` wins.  A URL that no rule fits, null and empty ones
    included, gets ``default``.  Repeated rows each get their own result.
    """
    listed = rules.select("rule", "verdict").where(F.col("rule").isNotNull())
    listed = listed.withColumn("host", F.translate(F.regexp_extract("rule", "^[^/]*", 0), UPPER, LOWER)).withColumn("path", F.expr("substring(rule, char_length(host) + 1)"))
    listed = listed.select(F.concat("host", "path").alias("key"), "rule", "verdict", F.size(F.split("host", r"\.")).alias("labels"), F.char_length("path").alias("width"))
    listed = materialize(listed.groupBy("key").agg(F.max(F.struct(F.col("verdict") == "block", "verdict", "rule", "labels", "width")).alias("r")).select("key", "r.rule", "r.verdict", "r.labels", "r.width"), "rules")
    count, labels, widths = listed.agg(F.count(F.lit(1)), F.max("labels"), F.collect_set("width")).first()
    bloom, blocks = blocked_bloom(listed, "key", count)

    pages = pick(df, page_id=id_col, url=url_col)
    host, path = url_parts(F.col("url"))
    pages = materialize(pages.select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("seq")), "page-urls")

    parts = F.split("host", r"\.")
    deepest = F.least(F.size(parts), F.lit(labels or 0))
    suffixes = F.when((F.col("host") != "") & (deepest > 0), F.transform(F.sequence(F.lit(1), deepest), lambda n: F.array_join(F.slice(parts, -n, n), "."))).otherwise(F.array().cast("array<string>"))
    own_widths = F.filter(F.array(*[F.lit(w) for w in sorted(widths)]).cast("array<int>"), lambda w: w <= F.char_length("path"))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(own_widths, lambda w: F.concat(s, F.substring("path", F.lit(1), w)))))
    tried = pages.select("seq", F.explode(keys).alias("key")).withColumn("block", _block("key", blocks))
    passed = tried.join(F.broadcast(bloom), "block")
    for i, mask in enumerate(_masks("key")):
        passed = passed.where(F.col(f"w{i}").bitwiseAND(mask) != 0)
    passed = materialize(passed.select("seq", "key"), "possible-hits")
    sizes = passed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    groups = materialize(listed.join(sizes, "key"), "hit-rules")
    hits = spread_join(passed, groups, "key", "n", passed.count(), [F.col("seq")], "inner")
    best = hits.groupBy("seq").agg(F.max(F.struct(F.char_length("key").alias("length"), "rule", "verdict")).alias("best"))
    return pages.join(best, "seq", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
