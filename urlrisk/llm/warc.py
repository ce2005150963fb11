"""WARC archives without repeated payloads, written and read by Spark's text source.

A record is one text row whose separator is the blank line that ends a WARC record,
so Spark's own committed writer makes the files: a lost executor leaves no half file,
and any file system that Spark reaches will do. Files are gzip streams, read by one
task each from start to end; `max_records` bounds their size.

Revisit resolution shuffles headers only (page id, URL, digest, length): the smallest
page id of a digest is the original (partial aggregation collapses a hot payload before
the shuffle), the others become revisit records. Payloads move once, by page id, and
only those of originals are written.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.llm.scratch import Scratch
from urlrisk.llm.texts import utf8

EOL, END = "\r\n", "\r\n\r\n"

#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

READ_SCHEMA = (
    "page_id long, target_uri string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload binary"
)


def base32_sha1(c: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a text's UTF-8 bytes (32 digits, no padding)."""
    digest = F.sha1(c.cast("binary"))
    # 10 hex digits are 8 base-32 digits; conv writes these as 0-9A-V.
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def headers(pages: DataFrame) -> DataFrame:
    """`page_id, url, payload_bytes, payload_digest`; a null html is an empty payload."""
    html = F.coalesce("html", F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url",
        F.octet_length(html).cast("long").alias("payload_bytes"), base32_sha1(html).alias("payload_digest"),
    )


def originals(heads: DataFrame, min_payload: int = 0) -> DataFrame:
    """The smallest page id of each payload of at least `min_payload` bytes."""
    first = F.min(F.struct("page_id", "url"))
    return (
        heads.where((F.col("payload_bytes") >= min_payload) & F.col("page_id").isNotNull())
        .groupBy("payload_digest", "payload_bytes").agg(first.alias("_o"))
        .select("payload_digest", "payload_bytes", F.col("_o.page_id").alias("refers_to"), F.col("_o.url").alias("refers_to_url"))
    )


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", page_id.cast("string"), digest))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def _clean(url: Column) -> Column:
    """A URL that fits in one header line."""
    return F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")


def _line(name: str, value: Column) -> Column:
    """A header line; none for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(EOL)), F.lit(""))


def _record(kind: str, date: str, html: Column | None) -> Column:
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(END),
    )
    block = http if html is None else F.concat(http, html)
    head = [
        F.lit(f"WARC/1.1{EOL}WARC-Type: {kind}{EOL}WARC-Date: {date}{EOL}"),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), _record_id(F.col("page_id"), F.col("payload_digest")), F.lit(">"))),
        _line("WARC-Target-URI", _clean(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("X-Page-ID", F.col("page_id").cast("string")),
    ]
    if kind == "revisit":
        head += [
            F.lit(f"WARC-Profile: {REVISIT_PROFILE}{EOL}"),
            _line("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), _record_id(F.col("refers_to"), F.col("payload_digest")), F.lit(">"))),
            _line("WARC-Refers-To-Target-URI", _clean(F.col("refers_to_url"))),
            F.lit(f"WARC-Refers-To-Date: {date}{EOL}"),
            _line("X-Refers-To-Page-ID", F.col("refers_to").cast("string")),
        ]
    size = _line("Content-Length", F.octet_length(block).cast("string"))
    kind_line = F.lit(f"Content-Type: application/http;msgtype=response{EOL}")
    return F.concat(*head, kind_line, size, F.lit(EOL), block)


def write_archives(
    pages: DataFrame, path: str, min_payload: int = 0, date: str = "2024-01-01T00:00:00Z", max_records: int = 50_000,
    scratch: Scratch | None = None,
) -> None:
    """Write one record per row of `pages` (`page_id, url, html`) below `path`.

    Of equal payloads of at least `min_payload` bytes, the row with the smallest page id
    is a response and the others revisit it; shorter ones are all responses. Rows that
    repeat the smallest id of their payload, and rows without a page id, are responses.
    A null html is an empty payload; a null URL leaves out the target line. Line breaks
    in a URL are percent-encoded. An empty table writes no record.
    """
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    heads = headers(pages)
    first = scratch.put(originals(heads, min_payload), "originals")
    revisits = (
        heads.join(first, ["payload_digest", "payload_bytes"])
        .where(F.col("page_id") > F.col("refers_to")).select(_record("revisit", date, None).alias("value"))
    )
    own = first.select(F.col("refers_to").alias("page_id"), "payload_digest")
    full = pages.withColumn("payload_digest", base32_sha1(F.col("html"))).withColumn(
        "payload_bytes", F.octet_length("html").cast("long")
    )
    response = _record("response", date, F.col("html")).alias("value")
    responses = full.join(own, ["page_id", "payload_digest"]).select(response)
    alone = full.where(F.col("page_id").isNull() | (F.col("payload_bytes") < min_payload)).select(response)
    (
        responses.unionByName(alone).unionByName(revisits).write.option("lineSep", END)
        .option("compression", "gzip").option("maxRecordsPerFile", max_records).text(path)
    )
    scratch.drop(first)


def _fields(head: bytes) -> dict[bytes, bytes]:
    return dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])


def _parse(batches: Iterator, payloads: bool) -> Iterator:
    """Records of whole files, whose bytes come in pieces cut at blank lines. Lengths in
    the headers say where a record ends, whatever its payload holds."""
    import hashlib

    import pyarrow as pa

    end = END.encode()
    names = ("page_id", "target_uri", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    buffer, head, need = bytearray(), None, 0
    for batch in batches:
        rows = []
        for piece in utf8(batch.column(0)):
            buffer += piece
            buffer += end
            while True:
                if head is None:
                    while buffer.startswith(b"\r\n"):
                        del buffer[:2]
                    at = buffer.find(end)
                    if at < 0:
                        break
                    head = _fields(bytes(buffer[:at]))
                    need = int(head[b"Content-Length"])
                    del buffer[: at + 4]
                if len(buffer) < need + 4:
                    break
                http, _, payload = bytes(buffer[:need]).partition(end)
                del buffer[: need + 4]
                kind = head[b"WARC-Type"].decode()
                size = int(_fields(http)[b"Content-Length"])
                digest = head[b"WARC-Payload-Digest"].decode().partition(":")[2]
                if kind == "response":
                    import base64

                    if size != len(payload) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"damaged record {head[b'WARC-Record-ID']!r}")
                page, refers = head.get(b"X-Page-ID"), head.get(b"X-Refers-To-Page-ID")
                uri = head.get(b"WARC-Target-URI")
                rows.append((
                    None if page is None else int(page), None if uri is None else uri.decode(), size, digest, kind,
                    None if refers is None else int(refers), payload if payloads and kind == "response" else None,
                ))
                head = None
        if rows:
            columns = zip(*rows, strict=True)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
    if head is not None or buffer.strip(b"\r\n"):
        raise ValueError("an archive ends within a record")


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records below `path`: `page_id, target_uri, payload_bytes, payload_digest,
    record_type, refers_to, payload`. Length and digest are those of the full payload,
    also for revisits; a response whose payload does not fit its header raises. The
    payload itself is null unless asked for, and for revisits."""
    chunks = spark.read.option("lineSep", END).text(path).select("value")
    return chunks.mapInArrow(lambda it: _parse(it, payloads), READ_SCHEMA)
