"""Secret scans with an incremental blob ledger.  DataFrame functions only.

Every version of a text is addressed by its content (SHA-256).  Only blobs
that the ledger has not seen under the present rule version are scanned, each
once; what was found is appended to the ledger and joined back to every row
that holds the blob.  Rows whose blob no other row has are scanned where they
are read; only possible repeats shuffle their text (see exact_dedup).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm._common import at, atomic, materialize, pick, positional, scratch_path, spread_join
from talweg.llm.exact_dedup import bit_array, flag

RULE_VERSION = "2"
KINDS = ("assign", "access", "hex")
_KEYWORDS = r"(?i:password|passwd|secret|token|api_?key)"
_VALUE = r"[A-Za-z0-9+/_.=-]"
ASSIGN = rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?({_VALUE}+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Shortest value of an assignment.
MIN_VALUE = 12
SPANS = "array<struct<start:int,kind:int,end:int>>"
LEDGER = f"blob binary, rule_version string, spans {SPANS}"


def _assigned(text: Column) -> Column:
    """True wherever an assignment can be: a cheap search for the words."""
    low = F.lower(text)
    found = F.lit(False)
    for word in ("passw", "secret", "token", "apikey", "api_key"):
        found = found | low.contains(word)
    return found


def _spans(text: Column, pattern: str, kind: int, may: Column, keep) -> Column:
    """Spans of one kind: the text is cut at the matches, and lengths of gaps and matches are summed up."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("match"), keep(text, found).alias("keep"))
    nothing = F.array().cast(SPANS)
    start = F.struct(F.lit(0).alias("at"), nothing.alias("out"))

    def step(acc, x):
        begin = acc["at"] + F.char_length(x["gap"])
        end = begin + F.coalesce(F.char_length(x["match"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.coalesce(x["keep"], F.lit(False)), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(pieces, start, step, lambda acc: acc["out"])
    return F.when(may & F.regexp_like(text, F.lit(pattern)), spans).otherwise(nothing)


def _every(text: Column, found: Column) -> Column:
    return F.transform(found, lambda _: F.lit(True))


def _long_values(text: Column, found: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.char_length(v) >= MIN_VALUE)


def find_spans(text: Column) -> Column:
    """All spans (start, kind, end) in code points, by start and kind."""
    return F.array_sort(
        F.concat(
            _spans(text, ASSIGN, 0, _assigned(text), _long_values),
            _spans(text, ACCESS, 1, text.contains("AKIA"), _every),
            _spans(text, HEX, 2, F.lit(True), _every),
        )
    )


def redact(text: Column) -> Column:
    """The text with values of assignments, access keys and hex runs replaced by ``[kind]``."""
    gaps, found = F.split(text, ASSIGN, -1), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0))
    hidden = F.transform(
        F.arrays_zip(found.alias("match"), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)).alias("value")),
        lambda x: F.when(
            F.char_length(x["value"]) >= MIN_VALUE,
            F.concat(F.substring(x["match"], F.lit(1), F.char_length(x["match"]) - F.char_length(x["value"])), F.lit("[assign]")),
        ).otherwise(x["match"]),
    )
    whole = F.array_join(F.zip_with(gaps, hidden, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    return F.regexp_replace(F.regexp_replace(F.when(_assigned(text), whole).otherwise(text), ACCESS, "[access]"), HEX, "[hex]")


class SecretLedger:
    """A Parquet table of (blob, rule_version, spans) in a shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, rule_version: str = RULE_VERSION):
        self.spark, self.rule_version = spark, rule_version
        self.path = path or scratch_path(spark, "ledger")

    def _stored(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(LEDGER).parquet(self.path)
        except AnalysisException:  # nothing has been written there yet
            return None

    def read(self) -> DataFrame:
        """What this rule version has scanned, each blob once."""
        seen = self._stored()
        if seen is None:
            return self.spark.createDataFrame([], LEDGER)
        return seen.where(F.col("rule_version") == self.rule_version)

    def update(self, versions: DataFrame, text_col: str = "text") -> DataFrame:
        """Scan the unseen blobs of ``versions`` and append them.  Returns (row, blob) of all versions.

        The result holds the versions' rows by position: ``row`` is a struct of
        c0, c1, ...  Null texts count as empty.
        """
        text_at = at(versions, text_col)
        text = F.coalesce(F.col(f"row.{text_at}"), F.lit(""))
        rows = positional(versions).select(F.struct("*").alias("row"))
        keyed = rows.withColumn("blob", F.unhex(F.sha2(text.cast("binary"), 256)))
        blobs = materialize(keyed.select("blob"), "blobs")
        flagged = flag(keyed.select("blob", text.alias("text")), "blob", *bit_array(blobs, "blob", blobs.count()))
        once = flagged.where(~F.col("possible")).select("blob", "text")
        again = flagged.where("possible").groupBy("blob").agg(F.first("text").alias("text"))
        fresh = once.unionByName(again)
        if self._stored() is not None:
            fresh = fresh.join(self.read().select("blob").hint("shuffle_hash"), "blob", "left_anti")
        found = fresh.select("blob", F.lit(self.rule_version).alias("rule_version"), find_spans(F.col("text")).alias("spans"))
        found.write.mode("append").parquet(self.path)
        return keyed

    def findings(self, keyed: DataFrame, by: list[Column]) -> DataFrame:
        """Join the ledger back to the rows whose blob has findings: (columns of ``keyed``, spans)."""
        seen = self.read().where(F.size("spans") > 0).select("blob", "spans")
        array, bits = bit_array(seen, "blob", seen.count(), 1)
        flagged = flag(keyed, "blob", array, bits)
        sizes = flagged.where("possible").groupBy("blob").agg(F.count(F.lit(1)).alias("n"))
        groups = materialize(seen.join(sizes, "blob"), "findings")
        total = groups.agg(F.sum("n")).first()[0] or 0
        clean = flagged.where(~F.col("possible")).withColumn("spans", F.array().cast(SPANS))
        joined = spread_join(flagged.where("possible"), groups, "blob", "n", total, by).withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))
        return clean.unionByName(joined.drop("n")).drop("possible")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def scan_secrets(df: DataFrame, ledger: SecretLedger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    Null and empty texts have no spans.  Repeated rows each get their own
    result.  An empty table gives an empty result; other columns are ignored.
    The ledger adds no kinds of its own, so all spans are base spans.
    """
    ledger = ledger or SecretLedger(df.sparkSession)
    keyed = ledger.update(pick(df, doc_id=id_col, text=text_col))
    slim = materialize(keyed.select(F.col("row.c0").alias("doc_id"), "blob"), "blob-rows")
    found = ledger.findings(slim, [F.col("doc_id")])
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    text = span_text(F.col("spans"))
    return found.select(
        "doc_id", *[n(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(text.cast("binary"), 256).alias("base_sha256"), text.alias("spans")
    )


def scan_history(versions: DataFrame, ledger: SecretLedger, path_col: str = "path", version_col: str = "version", text_col: str = "text") -> DataFrame:
    """``path, version, blob, spans`` of every historical version: findings joined back to all paths that ever held the blob.

    Only blobs that the ledger has not seen under its rule version are scanned,
    so a second call over a longer history scans what is new.  Null texts count
    as empty; repeated rows each get their own result; an empty table gives an
    empty result.  One writer at a time may use a ledger.
    """
    keyed = ledger.update(pick(versions, path=path_col, version=version_col, text=text_col))
    slim = materialize(keyed.select(F.col("row.c0").alias("path"), F.col("row.c1").alias("version"), "blob"), "blob-paths")
    found = ledger.findings(slim, [F.col("path"), F.col("version")])
    return found.select("path", "version", F.lower(F.hex("blob")).alias("blob"), span_text(F.col("spans")).alias("spans"))


def redact_secrets(df: DataFrame, ledger: SecretLedger | None = None, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns, with secrets in the text replaced; ``length_col`` follows the new text.

    Texts without findings, nulls included, stay as they are.
    """
    ledger = ledger or SecretLedger(df.sparkSession)
    keyed = ledger.update(df, text_col)
    found = ledger.findings(keyed, atomic(positional(df), "row."))
    text_at = at(df, text_col)
    names = [f"c{i}" for i in range(len(df.columns))]
    hit = F.size("spans") > 0
    new = F.when(hit, redact(F.col(f"row.{text_at}"))).otherwise(F.col(f"row.{text_at}"))
    out = found.select(*[new.alias(n) if n == text_at else F.col(f"row.{n}").alias(n) for n in names], hit.alias("hit"))
    if length_col and length_col in df.columns:
        length_at = at(df, length_col)
        kind = df.dtypes[df.columns.index(length_col)][1]
        out = out.withColumn(length_at, F.when(F.col("hit"), F.char_length(text_at).cast(kind)).otherwise(F.col(length_at)))
    return out.select(*names).toDF(*df.columns)
