"""WARC archives: writing with chunked framing and segments, reading with reassembly.

Writing: every page becomes a record; of records with equal payloads the one with the largest page_id is a
response, the others are revisits that refer to it. A response block is an HTTP message with chunked transfer
framing; blocks longer than a segment go on in continuation records. Archives are gzip-compressed text files
written by Spark's own sink, so any file system that Spark knows will do.

Reading: archives are read once and their records, parsed by their declared lengths, kept as a table. Continuation
records are grouped by origin, ordered by segment number and joined, the total length is verified, and the chunked
framing is decoded. A record that fails a check is kept, with what is wrong in `error`: a length that is no number
(the next record is then looked for by its version line), a damaged compression, chunk sizes that are not hexadecimal
digits. One archive is one row of Spark's binaryFile source, which takes up to 2 GB; archives written here are far
smaller, as a file takes a bounded number of records.

Null html is an empty payload, a null page_id is read back as null, and its payload group's largest id stays null
if all are. Rows that repeat page and payload become records of their own, of one type. Empty tables give no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.session import written

CRLF = b"\r\n"
RECORDS_A_FILE = 8192
DATE = "2024-01-01T00:00:00Z"
RECORD = (
    "record_id string, warc_type string, target_uri string, page_id long, payload_digest string, payload_bytes long, "
    "refers_to long, segment_number int, origin_id string, total_length long, block binary, error string"
)
PAGE = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long, error string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def framed(payload: bytes, chunk: int) -> bytes:
    """An HTTP message whose body has chunked transfer framing."""
    parts = [b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"]
    for at in range(0, len(payload), chunk):
        piece = payload[at : at + chunk]
        parts += [b"%x" % len(piece), CRLF, piece, CRLF]
    return b"".join([*parts, b"0\r\n\r\n"])


def unframed(block: bytes) -> bytes:
    """The body of an HTTP message, with its chunked framing, if any, decoded."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("the HTTP header does not end")
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    parts, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            raise ValueError("a chunk has no size line")
        digits = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", digits):
            raise ValueError("a chunk's size is not hexadecimal")
        size = int(digits, 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != CRLF:
            raise ValueError("a chunk does not end where its size says")
        parts.append(body[at : at + size])
        at += size + 2


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends that close it, which the sink adds."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block


def classified(pages: DataFrame, url: str | None = "url") -> DataFrame:
    """The pages with `largest`, the largest page_id among rows with an equal payload."""
    uri = F.col(url).cast("string") if url in pages.columns else F.lit(None).cast("string")
    rows = pages.select(
        F.col("page_id").cast("long"), uri.alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    )
    keyed = rows.withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    largest = written(keyed.groupBy("sha1").agg(F.max("page_id").alias("largest")), "warc-payloads")
    return keyed.join(largest, "sha1")


def write_archives(pages: DataFrame, path: str, segment_bytes: int = 32768, chunk_bytes: int = 8192) -> None:
    """Write a record for each row of pages (page_id, url, html) to archives below path."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for page, url, html, largest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = html.encode("utf-8", "surrogatepass")
                n += 1
                own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{part}/{n}/{page}')}>"
                uri = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
                common = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("X-Page-Id", page), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Payload-Length", len(payload))]
                if page != largest:
                    out.append(record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", largest)], b""))
                    continue
                block = framed(payload, chunk_bytes)
                cuts = [*range(0, len(block), segment_bytes), len(block)]
                first = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common]
                out.append(record([*first, ("WARC-Segment-Number", 1 if len(cuts) > 2 else None)], block[: cuts[1]]))
                for k in range(1, len(cuts) - 1):
                    last = len(block) if k == len(cuts) - 2 else None
                    name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{own}/{k}')}>"
                    out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k + 1), ("WARC-Segment-Total-Length", last)], block[cuts[k] : cuts[k + 1]]))
                if len(out) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows = classified(pages).select("page_id", "url", "html", "largest")
    # the cast keeps the bytes as they are, and the text sink writes them
    rows.mapInArrow(records, "value binary").select(F.col("value").cast("string")).write.option("maxRecordsPerFile", RECORDS_A_FILE).option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def _parsed(stream: io.BufferedIOBase) -> Iterator[tuple]:
    """The records of one archive, in constant memory but for the record at hand."""
    line = b""
    while True:
        line = line or stream.readline()
        if not line:
            return
        if not line.strip():
            line = b""
            continue
        error = None if line.startswith(b"WARC/") else "a record does not begin with its version"
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        line, block, length = b"", b"", fields.get("content-length", "0")
        if re.fullmatch("[0-9]{1,15}", length):
            block = stream.read(int(length))
            if len(block) != int(length):
                error = "the archive ends inside a block"
        else:
            error = "the block's length is not a number"
            while (line := stream.readline()) and not line.startswith(b"WARC/"):
                pass

        def number(key: str, fields: dict[str, str] = fields) -> int | None:
            return int(fields[key]) if re.fullmatch("-?[0-9]{1,18}", fields.get(key, "")) else None

        segment = number("warc-segment-number")
        if segment is None and "warc-segment-number" in fields or segment is not None and not 0 < segment < 1 << 31:
            error, segment = error or "the segment's number is not one", None
        value = fields.get("warc-payload-digest", "").rpartition(":")[2] or None
        yield (fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), number("x-page-id"), value, number("x-payload-length"), number("x-refers-to-page-id"), segment, fields.get("warc-segment-origin-id"), number("warc-segment-total-length"), block, error)


def _safely(content: bytes) -> Iterator[tuple]:
    """The records of an archive, compressed or not; where it is damaged, a record that says so ends it."""
    raw = io.BytesIO(content)
    try:
        yield from _parsed(io.BufferedReader(gzip.GzipFile(fileobj=raw)) if raw.getbuffer()[:2] == b"\x1f\x8b" else raw)
    except (OSError, EOFError, zlib.error) as e:
        yield (*[None] * 10, b"", f"the archive's compression is damaged: {e}")


def _arrow_type(name: str) -> pa.DataType:
    return {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[name]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _arrow_type(t)) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below path, gzip-compressed or not. An archive is read by one task."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for x in _safely(content.as_buffer()):
                    rows.append(x)
                    held += len(x[10])
                    if held > 8_000_000 or len(rows) >= 2000:
                        yield _batch(rows, RECORD)
                        rows, held = [], 0
                yield _batch(rows, RECORD)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, RECORD)


def reassembled(records: DataFrame) -> DataFrame:
    """Records with their continuations joined to them: grouped by origin, ordered by number, lengths verified."""
    whole = records.where("segment_number IS NULL")
    parts = records.where("segment_number IS NOT NULL").withColumn("origin", F.coalesce("origin_id", "record_id"))
    first = lambda c: F.max(F.when(F.col("segment_number") == 1, F.col(c))).alias(c)
    joined = (
        parts.groupBy("origin")
        .agg(
            *(first(c) for c in ("record_id", "warc_type", "target_uri", "page_id", "payload_digest", "payload_bytes", "refers_to")),
            F.sort_array(F.collect_list(F.struct("segment_number", "block"))).alias("held"),
            F.max("total_length").alias("total_length"),
            F.max("error").alias("error"),
        )
        .withColumn("block", F.aggregate("held", F.lit(b""), lambda a, x: F.concat(a, x["block"])))
        .withColumn("in_order", F.forall(F.transform("held", lambda x, i: x["segment_number"] == i + 1), lambda x: x))
        .withColumn(
            "error",
            F.coalesce(
                "error",
                F.when(~F.col("in_order"), "a segment is missing or repeated"),
                F.when(F.col("total_length").isNull(), "the last segment is missing"),
                F.when(F.length("block") != F.col("total_length"), "the segments do not add up to the total length"),
            ),
        )
    )
    kept = ["record_id", "warc_type", "target_uri", "page_id", "payload_digest", "payload_bytes", "refers_to", "block", "error"]
    return whole.select(kept).unionByName(joined.select(kept))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages as the archives below path have them: decoded and verified payloads, revisits without one.

    The archives are read once: their records are written as a table, of which segments and whole records are taken.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, url, kind, named, size, refers, block, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = None
                if kind == "response":
                    try:
                        payload = unframed(block)
                        found = digest(payload)
                        if named not in (None, found):
                            error = error or "the payload does not have the digest that the record names"
                        named, size = found, len(payload)
                    except ValueError as e:
                        error = error or str(e)
                rows.append((page, url, kind, payload, size, named, refers, error))
            yield _batch(rows, PAGE)

    columns = ["page_id", "target_uri", "warc_type", "payload_digest", "payload_bytes", "refers_to", "block", "error"]
    return reassembled(written(read_records(spark, path), "warc-records")).select(columns).mapInArrow(decode, PAGE)
