"""WARC archives: one gzip member per record, equal payloads written once, read back record by record."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty

#: Payloads below this many bytes are never replaced by a reference.
LEAST_BYTES = 100
#: Records of one archive file, which bounds the file that one task reads.
FILE_RECORDS = 2000
CHUNK = 1 << 16
#: A gzip member ends with its length in four bytes, the last of them zero below this many bytes.
ZERO_ENDED = 1 << 24
RECORD_SCHEMA = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
                 "payload_digest string, payload string")


def header(name: str, value: str) -> bytes:
    """One header line; control characters are escaped, so that no value can end its line."""
    safe = "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)
    return f"{name}: {safe}\r\n".encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool,
           date: str) -> bytes:
    """A response record, or a revisit record that keeps the HTTP header and leaves the body out."""
    http = b"HTTP/1.1 200 OK\r\n" + header("Content-Type", "text/html; charset=utf-8") \
        + header("Content-Length", str(len(payload))) + b"\r\n"
    block = http if revisit else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{url}:{digest}")
    lines = [header("WARC-Type", "revisit" if revisit else "response"), header("WARC-Record-ID", f"<urn:uuid:{name}>"),
             header("WARC-Date", date), header("WARC-Target-URI", url or ""),
             header("WARC-Payload-Digest", f"sha256:{digest}")]
    if page_id is not None:
        lines.append(header("X-Page-Id", str(page_id)))
    if revisit:
        lines += [header("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                  header("X-Refers-To-Page-Id", str(refers_to))]
    lines += [header("Content-Type", "application/http; msgtype=response"), header("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + b"".join(lines) + b"\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", level: int = 6,
                   file_records: int = FILE_RECORDS) -> None:
    """Write one record per row of `pages` (page_id, url, html) under `path`.

    Of rows with an equal payload of LEAST_BYTES or more, the one with the smallest page_id is a response and others
    refer to it; rows that share that id are responses all, rows without id refer to it, or are responses if none has
    one. Null html and url count as empty. Spark's text writer commits the files: each member leaves out its last byte,
    a zero, and the line separator puts it back, so a file is nothing but gzip members.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), text_or_empty("html").alias("html")) \
        .withColumn("digest", F.sha2("html", 256))
    firsts = rows.where(F.octet_length("html") >= LEAST_BYTES).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    known = rows.join(firsts, "digest", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = member(b"", level)
        for batch in batches:
            out = []
            for page_id, url, html, digest, first in zip(*(batch.column(c).to_pylist() for c in (
                    "page_id", "url", "html", "digest", "first"))):
                revisit = first is not None and first != page_id
                raw = record(page_id, url, html.encode(), digest, first, revisit, date)
                packed = member(raw, level)
                if len(raw) % (1 << 32) >= ZERO_ENDED:
                    packed += empty  # a member of no bytes, which does end with a zero
                out.append(packed[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    known.select("page_id", "url", "html", "digest", "first").mapInArrow(run, "value binary") \
        .select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none") \
        .option("maxRecordsPerFile", file_records).text(path)


def members(raw: bytes) -> Iterator[bytes]:
    """The content of each gzip member, unpacked a chunk at a time; members of no bytes are passed over."""
    at, view = 0, memoryview(raw)
    while at < len(raw):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            chunk = view[at:at + CHUNK]
            if not chunk:
                raise ValueError("the archive ends within a member")
            parts.append(unpack.decompress(chunk))
            at += len(chunk)
        at -= len(unpack.unused_data)
        if any(parts):
            yield b"".join(parts)


def headed(raw: bytes) -> tuple[str, dict[str, str], bytes]:
    """First line, headers and what follows them."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of a header")
    first, *lines = head.decode().split("\r\n")
    return first, {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, rest


def parsed(raw: bytes) -> tuple:
    """One record as a row of RECORD_SCHEMA; lengths, framing and the digest of a payload are verified."""
    version, fields, rest = headed(raw)
    size = int(fields["content-length"])
    if not version.startswith("WARC/") or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a member doesn't hold one whole record")
    _, http, payload = headed(rest[:size])
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != int(http["content-length"]) or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload isn't what its header says")
    number = {k: int(fields[k]) if k in fields else None for k in ("x-page-id", "x-refers-to-page-id")}
    return (number["x-page-id"], fields["warc-target-uri"], kind, number["x-refers-to-page-id"],
            int(http["content-length"]), digest, payload.decode() if kind == "response" else None)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records under `path`; payload is null for those that refer to another. A damaged archive is an error."""
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
    kinds = [pa.int64() if "long" in f else pa.string() for f in RECORD_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for raw in members(content.as_py()):
                    rows.append(parsed(raw))
                    if len(rows) == 256:
                        yield as_batch(rows)
                        rows = []
                yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD_SCHEMA)
