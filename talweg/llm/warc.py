"""Legacy ARC archives to WARC, and WARC read back.

ARC version 1 record lines have five fields (URL, IP, date, type, length),
version 2 lines ten; the archive's own first record (``filedesc://``) says
which.  Records are cut by their declared lengths; archives may be gzipped,
record by record or whole, and a damaged record does not lose the others.  The
converter synthesises what ARC lacks: record ids, WARC timestamps, record types
and payload digests.

Archives are rows (name, content); a WARC row holds gzip members, one a
record, of about ``ARCHIVE`` bytes.  Executors write and read them through
Spark only, so any store that Spark reaches will do.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm._common import materialize, pick, scratch_path, spread_join
from talweg.llm.bpe import slices
from talweg.llm.exact_dedup import bit_array, flag

#: Bytes of records to an archive, about.
ARCHIVE = 4_000_000
#: Field names of a record line by ARC version: fixed values.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}
_DATE = "20260101000000"
#: Bytes inflated at a time.
PIECE = 1 << 16
#: A record line behind a line break: URL, IP address and a date of 14 digits; the last field is the length.
_ARC_LINE = re.compile(rb"\n([a-z][a-z0-9+.-]*:\S* \d+\.\d+\.\d+\.\d+ \d{14} [^\n]*\d\r?)(?=\n)")
RECORDS = "source_id string, record_id string, record_type string, uri string, date string, refers_to string, payload_digest string, payload_bytes long"


def arc_header(name: str, version: int = 1) -> bytes:
    """The first record of an archive."""
    body = f"{version} 0 talweg\n".encode() + " ".join(f"{n.title()}" for n in ARC_FIELDS[version]).encode() + b"\n"
    dashes = ["-"] * (len(ARC_FIELDS[version]) - 5)
    line = " ".join([f"filedesc://{name}", "0.0.0.0", _DATE, "text/plain", *dashes, str(len(body))])
    return line.encode() + b"\n" + body + b"\n"


def arc_record(url: str, block: bytes, version: int = 1, ip: str = "0.0.0.0", date: str = _DATE, kind: str = "text/html") -> bytes:
    """One record; characters that would break the record line are percent-encoded."""
    safe = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url.encode("utf-8", "surrogatepass")) or b"-"
    dashes = [b"-"] * (len(ARC_FIELDS[version]) - 5)
    return b" ".join([safe, ip.encode(), date.encode(), kind.encode(), *dashes, str(len(block)).encode()]) + b"\n" + block + b"\n"


def members(content: bytes) -> Iterator[bytes]:
    """The gzip members of an archive, inflated one by one; content that is not gzip is one member.  Time grows with the length alone."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at = memoryview(content), 0
    while at < len(content) and content[at : at + 2] == b"\x1f\x8b":
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(content):
                raise ValueError("gzip member is cut off")
            fed = view[at : at + PIECE]
            try:
                parts.append(member.decompress(fed))
            except zlib.error as e:
                raise ValueError(f"damaged gzip member before byte {at + len(fed)}: {e}") from e
            at += len(fed) - len(member.unused_data)
        yield b"".join(parts)
    if content[at : at + 1].strip(b"\0"):
        raise ValueError(f"no gzip member at byte {at}")


def parse_arc(content: bytes, strict: bool = True) -> Iterator[dict]:
    """Records of an archive, gzipped or not: the fields of its version, and ``block``.

    Line breaks between records may be missing or several.  A damaged record
    raises ValueError if ``strict``; otherwise it comes out as ``{"error": ...}``
    and reading goes on at the next record line.  The archive's own record says
    which version holds.
    """
    version: int | None = None
    parts = members(content)
    while True:
        try:
            part = next(parts, None)
        except ValueError as e:
            if strict:
                raise
            yield {"error": str(e)}
            return
        if part is None:
            return
        at = 0
        while at < len(part):
            if part[at : at + 1] in b"\r\n":
                at += 1
                continue
            try:
                record, at, version = _arc_record_at(part, at, version)
                yield record
            except ValueError as e:
                if strict:
                    raise
                yield {"error": str(e)}
                found = _ARC_LINE.search(part, part.find(b"\n", at) if b"\n" in part[at:] else len(part))
                at = found.start(1) if found else len(part)


def _arc_record_at(content: bytes, at: int, version: int | None) -> tuple[dict, int, int]:
    """The record at ``at``, where the next one can begin, and the version."""
    end = content.find(b"\n", at)
    line = content[at : end if end >= 0 else len(content)].rstrip(b"\r")
    fields = line.split(b" ")
    if end < 0 or not fields[-1].isdigit():
        raise ValueError(f"no ARC record line at byte {at}")
    block = content[end + 1 : end + 1 + int(fields[-1])]
    if len(block) != int(fields[-1]):
        raise ValueError(f"record at byte {at} is cut off")
    if version is None:
        version = 2 if block[:1] == b"2" else 1
    names = ARC_FIELDS[version]
    if len(fields) < len(names):
        raise ValueError(f"{len(fields)} fields at byte {at}, version {version} has {len(names)}")
    # An unescaped space in a URL makes more fields: the URL is what is left of the others.
    head = len(fields) - len(names) + 1
    values = [b" ".join(fields[:head]), *fields[head:]]
    return {n: v.decode("utf-8", "replace") for n, v in zip(names, values)} | {"block": block}, end + 1 + len(block), version


def record_id(*parts: str | None) -> str:
    """A record's id: the same parts always give the same id."""
    name = "talweg-arc:" + "\0".join("" if p is None else p for p in parts)
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its blank line, and payload; blocks that are no HTTP message are all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    cut = re.search(rb"\r?\n\r?\n", block)
    return (block[: cut.end()], block[cut.end() :]) if cut else (block, b"")


def to_warc(record: dict, source: str, refers_to: str | None = None, copy: str = "") -> bytes:
    """One gzip member for an ARC record.  With ``refers_to`` it is a revisit: the head stays, the payload goes.

    A response's id comes from its source and digest; a revisit's also from
    its URL and ``copy``, which tells equal revisits apart.
    """
    head, payload = split_http(record["block"])
    own = digest(payload)
    d = re.sub(r"\D", "", record["date"]).ljust(14, "0")
    fields = {
        "WARC-Type": "revisit" if refers_to is not None else "response" if head else "resource",
        "WARC-Record-ID": record_id(source, own) if refers_to is None else record_id(source, own, record["url"], copy),
        "WARC-Date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        "WARC-Target-URI": record["url"],
        "WARC-IP-Address": record["ip"],
        "WARC-Payload-Digest": f"sha1:{own}",
        "X-Source-Id": source,
    }
    block = record["block"]
    if refers_to is not None:
        block = head
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to, own), "X-Refers-To-Source-Id": refers_to}
    fields |= {"WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Type": "application/http; msgtype=response" if head else record["type"], "Content-Length": str(len(block))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(text.encode("utf-8", "replace") + block + b"\r\n\r\n") + press.flush()


def parse_warc(content: bytes) -> Iterator[tuple[dict, bytes]]:
    """Header fields (lower-case names) and block of each record, of gzip members or of plain bytes; damage raises ValueError."""
    for raw in members(content):
        at = 0
        while at < len(raw):
            end = raw.find(b"\r\n\r\n", at)
            if end < 0 or not raw.startswith(b"WARC/", at):
                raise ValueError(f"no WARC header at byte {at}")
            lines = raw[at:end].decode("utf-8", "replace").split("\r\n")[1:]
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            size = int(fields["content-length"])
            if end + 4 + size > len(raw):
                raise ValueError("record is cut off")
            yield fields, raw[end + 4 : end + 4 + size]
            at = end + 8 + size


def read_warc(archives: DataFrame, content_col: str = "content") -> DataFrame:
    """One row per record of the archives.

    Digest and size are of the full payload: taken from the payload itself, and
    for revisits from the record's digest field and the HTTP head that it keeps.
    """
    rows = pick(archives, content=content_col)

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                out = []
                for fields, block in parse_warc(content or b""):
                    head, payload = split_http(block)
                    if fields["warc-type"] == "revisit":
                        size = re.search(rb"(?im)^content-length:\s*(\d+)", head)
                        found = (fields["warc-payload-digest"].removeprefix("sha1:"), int(size[1]) if size else None)
                    else:
                        found = (digest(payload), len(payload))
                    out.append((fields.get("x-source-id"), fields["warc-record-id"], fields["warc-type"], fields.get("warc-target-uri"), fields["warc-date"], fields.get("x-refers-to-source-id"), *found))
                columns = list(zip(*out)) if out else [()] * 8
                kinds = [pa.string()] * 7 + [pa.int64()]
                names = [x.split()[0] for x in RECORDS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return rows.mapInArrow(run, RECORDS)


def http_block(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


def write_warc(rows: DataFrame, path: str | None = None, version: int = 1) -> DataFrame:
    """Write ``source, url, html, refers_to, copy`` as ARC records, convert them, and store WARC archives.

    Returns the stored table (name, content).  Names hold the number of the
    partition and of the archive in it, so each archive has its own.
    """
    rows = rows.select("source", "url", "refers_to", "copy", "html")

    def run(batches):
        from pyspark import TaskContext

        held, size, n = [], 0, 0
        part = TaskContext.get().partitionId()
        archive = lambda: pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{n:05d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], ["name", "content"])
        for whole in batches:
            for batch in slices(whole, "html", ARCHIVE):
                cells = batch.to_pylist()
                arc = arc_header(f"part-{part:05d}-{n:05d}.arc", version) + b"".join(arc_record(x["url"] or "", http_block((x["html"] or "").encode("utf-8", "surrogatepass")), version) for x in cells)
                records = parse_arc(arc)
                next(records)
                for x, record in zip(cells, records, strict=True):
                    member = to_warc(record, x["source"], x["refers_to"], str(x["copy"]))
                    held.append(member)
                    size += len(member)
                    if size >= ARCHIVE:
                        yield archive()
                        held, size, n = [], 0, n + 1
        if held:
            yield archive()

    spark: SparkSession = rows.sparkSession
    path = path or scratch_path(spark, "warc")
    rows.mapInArrow(run, "name string, content binary").write.option("compression", "uncompressed").parquet(path)
    return spark.read.schema("name string, content binary").parquet(path)


def convert_arc(archives: DataFrame, content_col: str = "content", path_col: str = "path") -> DataFrame:
    """WARC archives ``name, content, error`` of ARC archives (as read by ``binaryFile``), gzipped or not.

    Each archive gives one row with the records that could be read (null
    content counts as empty, a null path as ``archive``), and one more row,
    without content, for each damaged place, with what is wrong there in
    ``error``.  Source ids are ``name:record number``.  An empty table gives an
    empty result.
    """
    name = F.col(path_col) if path_col in archives.columns else F.lit(None).cast("string")
    rows = archives.select(F.coalesce(name, F.lit("archive")).alias("name"), F.col(content_col).alias("content"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                good, errors, i = [], [], 0
                for record in parse_arc(bytes(row["content"] or b""), strict=False):
                    if "error" in record:
                        errors.append(record["error"])
                    elif not record["url"].startswith("filedesc://"):
                        good.append(to_warc(record, f"{row['name']}:{i}"))
                        i += 1
                name = re.sub(r"\.arc(\.gz)?$", "", row["name"]) + ".warc.gz"
                columns = [[name] * (1 + len(errors)), [b"".join(good), *[None] * len(errors)], [None, *errors]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.string()))], ["name", "content", "error"])

    return rows.mapInArrow(run, "name string, content binary, error string")


def archive_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", version: int = 1) -> DataFrame:
    """Write one WARC record per row, read the archives back: the rows of :func:`read_warc`.

    Of rows with equal payloads the one with the largest id (then URL) is a
    response and the others revisit it; null html counts as empty.  Of rows
    with equal id, URL and payload one is the response.  A null id is smaller
    than any other.  An empty table gives an empty result; other columns are
    ignored.  Rows are told apart by what they hold, not by their order, so the
    input may come in another order when a task runs again.
    """
    rows = pick(df, id=id_col, url=url_col, html=html_col)
    key = F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    address = F.xxhash64(F.col("url"), F.lit(3))
    small = rows.select("id", address.alias("address"), key.alias("key")).groupBy("key", "id", "address").agg(F.count(F.lit(1)).alias("times"))
    small = materialize(small, "payload-keys")
    total, again = small.agg(F.coalesce(F.sum("times"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("times") > 1, 1)), F.lit(0))).first()
    groups = small.groupBy("key").agg(F.max(F.struct("id", "address")).alias("keep"), F.sum("times").alias("n")).where("n > 1")
    groups = materialize(groups, "payload-groups")
    marks = spread_join(small, groups, "key", "n", total, [F.col("id"), F.col("address")], "inner")
    same = F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("address") == F.col("keep.address"))
    sign = lambda k: F.unhex(F.sha2(F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("-")), address if k is None else F.col("address"), F.hex(key if k is None else k)), 256))
    marks = materialize(marks.select(sign(F.col("key")).alias("at"), F.coalesce(F.col("keep.id").cast("string"), F.lit("")).alias("to"), same.alias("first"), "times"), "payload-marks")
    signed = rows.withColumn("sign", sign(None))
    if again:
        # Whole rows that repeat: each is brought together once, and its copies are numbered and dealt out again.
        repeats = materialize(marks.where("times > 1").select("at"), "repeated-rows")
        flagged = flag(signed, "sign", *bit_array(repeats, "at", again, 1))
        once = flagged.where(~F.col("possible")).drop("possible").withColumn("copy", F.lit(0).cast("long"))
        many = flagged.where("possible").groupBy("sign").agg(F.first("id").alias("id"), F.first("url").alias("url"), F.first("html").alias("html"), F.count(F.lit(1)).alias("m"))
        many = many.select("id", "url", "html", "sign", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("copy")).repartition("sign", "copy")
        signed = once.select("id", "url", "html", "sign", "copy").unionByName(many)
    else:
        signed = signed.withColumn("copy", F.lit(0).cast("long"))
    joined = spread_join(signed, marks.withColumnRenamed("at", "sign"), "sign", "times", total, [F.col("copy")]) if again else signed.join(marks.hint("shuffle_hash"), signed["sign"] == marks["at"], "left")
    revisit = F.col("to").isNotNull() & ~(F.col("first") & (F.col("copy") == 0))
    marked = joined.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("source"), "url", F.when(revisit, F.col("to")).alias("refers_to"), "copy", "html")
    return read_warc(write_warc(marked, version=version))
