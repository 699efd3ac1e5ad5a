"""WARC archives: one gzip member per record, written and read back with every digest checked.

Writing. Spark's text writer puts the bytes of each member into part files, so commits and
retries are Spark's own. A writer of lines needs a separator; an empty gzip member serves,
which every gzip reader passes over. A page whose payload occurs under a larger ``page_id``
becomes a ``revisit`` record that keeps the HTTP head, and so the payload's length, only.

Reading. Each archive is walked in sequence: a decompressor is fed slices of the file until
its member ends, then the next one starts. Inside a member the WARC head gives the block's
length, the block's head the payload's, and the SHA-1 of block and payload must agree.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.common import in_chunks, rows_of
from turnwise.operators.scale import lookup
from turnwise.sources.ranges import can_open, open_stream

#: Bytes of an archive that go into the decompressor at a time.
SLICE = 1 << 16
#: Records per archive file: a reader holds one file at a time.
RECORDS_PER_FILE = 2000
_CRLF = b"\r\n"
_READ = pa.schema(
    [
        ("record_id", pa.string()),
        ("page_id", pa.int64()),
        ("record_type", pa.string()),
        ("target_uri", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
        ("verified", pa.bool_()),
        ("payload", pa.binary()),
    ]
)
READ_SCHEMA = (
    "record_id string, page_id long, record_type string, target_uri string, payload_bytes long, "
    "payload_digest string, refers_to long, verified boolean, payload binary"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes) -> bytes:
    """``data`` as one gzip member without a time stamp, so that a retried task writes the same bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _urn(page_id: int | None) -> bytes:
    return b"<urn:page:%s>" % (b"" if page_id is None else str(page_id).encode())


def _page_of(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _one_line(uri: str | None) -> bytes:
    return (uri or "").replace("\r", "%0D").replace("\n", "%0A").encode()


def record(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit's block is the HTTP head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    lines = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: " + _urn(page_id),
        b"WARC-Target-URI: " + _one_line(uri),
        b"WARC-Payload-Digest: sha1:" + base32_sha1(payload).encode(),
        b"WARC-Block-Digest: sha1:" + base32_sha1(block).encode(),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    if revisit:
        lines.append(b"WARC-Refers-To: " + _urn(refers_to))
        lines.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return _CRLF.join(lines) + _CRLF + _CRLF + block + _CRLF + _CRLF


def _members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("member", pa.binary())])
    rows = (
        (member(record(page, url, (html or "").encode(), refers, revisit)),)
        for page, url, html, refers, revisit in rows_of(
            batches, "page_id", "url", "html", "refers_to", "revisit"
        )
    )
    yield from in_chunks(rows, schema, 200)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, refers_to, revisit``: who holds each payload, who only points to it.

    Payloads are compared by SHA-1. Only the digests are grouped, and the rows of frequent ones
    find their holder by broadcast; the revisits meet the wide rows by (page_id, digest), which is even also when one payload owns a third of the
    rows. Rows that repeat a page_id and its payload are of one kind, all with the largest
    page_id are responses; without any page_id a payload has only responses.
    """
    html = F.coalesce("html", F.lit(""))
    wide = pages.select("page_id", "url", "html").withColumn("digest", F.sha1(html.cast("binary")))
    narrow = wide.filter(F.octet_length(html) >= min_bytes).select("page_id", "digest")
    holders = (
        narrow.groupBy("digest")
        .agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
        .filter("n > 1 and refers_to is not null")
    )
    revisits = (
        lookup(narrow, holders, ["digest"], ["page_id"], weight="n", how="inner")
        .filter("not (page_id <=> refers_to)")
        .distinct()
        .select(F.col("page_id").alias("page"), F.col("digest").alias("same"), "refers_to")
    )
    return wide.join(
        revisits, F.expr("page_id <=> page and digest = same"), "left"
    ).select("page_id", "url", "html", "refers_to", F.expr("same is not null").alias("revisit"))


def write(pages: DataFrame, path: str, min_bytes: int = 0, per_file: int = RECORDS_PER_FILE) -> None:
    """Write ``pages`` (page_id, url, html) as archives below ``path``. Null html is empty."""
    members = with_revisits(pages, min_bytes).mapInArrow(_members, "member binary")
    (
        members.select(F.col("member").cast("string").alias("value"))
        .write.option("lineSep", member(b"").decode("latin-1"))
        .option("encoding", "ISO-8859-1")
        .option("maxRecordsPerFile", per_file)
        .text(path)
    )


def decompressed(stream) -> Iterator[bytes]:
    """The members of an archive, read slice by slice and in order; empty ones are passed over."""
    unpacker, out, fresh = zlib.decompressobj(31), [], True
    piece = stream.read(SLICE)
    while piece:
        out.append(unpacker.decompress(piece))
        fresh = False
        piece = unpacker.unused_data or stream.read(SLICE)
        if unpacker.eof:
            if data := b"".join(out):
                yield data
            unpacker, out, fresh = zlib.decompressobj(31), [], True
    if not fresh:
        raise ValueError("the archive ends inside a gzip member")


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(_CRLF)[1:])
    return {k.decode().strip().lower(): v.decode().strip() for k, _, v in pairs}


def parsed(data: bytes) -> tuple:
    """One record's fields, in the order of ``READ_SCHEMA``."""
    head, _, rest = data.partition(_CRLF + _CRLF)
    if not head.startswith(b"WARC/"):
        raise ValueError("no WARC record at the start of a gzip member")
    fields = _fields(head)
    length = int(fields["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != _CRLF + _CRLF:
        raise ValueError(f"{fields.get('warc-record-id')}: the block is not {length} bytes long")
    http, _, payload = block.partition(_CRLF + _CRLF)
    revisit = fields["warc-type"] == "revisit"
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    size = int(_fields(http)["content-length"])
    sound = fields["warc-block-digest"].removeprefix("sha1:") == base32_sha1(block)
    if not revisit:
        sound = sound and size == len(payload) and digest == base32_sha1(payload)
    return (
        fields["warc-record-id"],
        _page_of(fields["warc-record-id"]),
        fields["warc-type"],
        fields["warc-target-uri"],
        size,
        digest,
        _page_of(fields.get("warc-refers-to")),
        sound,
        None if revisit else payload,
    )


def _records(streams: Iterable) -> Iterator[pa.RecordBatch]:
    def rows():
        for stream in streams:
            for data in decompressed(stream):
                yield parsed(data)

    yield from in_chunks(rows(), _READ, 200)


def _opened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def streams():
        for (path,) in rows_of(batches, "path"):
            with open_stream(path, packed=True) as stream:
                yield stream

    yield from _records(streams())


def _held(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    contents = (content for batch in batches for content in batch.column("content"))
    yield from _records(pa.BufferReader(content.as_buffer()) for content in contents)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records below ``path``, one task per group of archives.

    A damaged frame fails the task; a wrong digest gives ``verified`` = false. Archives are
    streamed and may have any size, a task holds one record; those in a store that only
    Spark can open are handed over whole and must stay below its limit for a cell.
    """
    files = spark.read.format("binaryFile").load(path)
    if can_open(path):
        return files.select("path").mapInArrow(_opened, READ_SCHEMA)
    return files.select("content").mapInArrow(_held, READ_SCHEMA)
