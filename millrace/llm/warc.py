"""WARC: writing segmented records, and reassembling them.

Archives are gzipped record by record. A record's block is an HTTP response whose body is the payload in
chunked transfer framing; a block longer than ``segment`` bytes is written as a first record with
``WARC-Segment-Number: 1`` and ``continuation`` records that name it as origin, the last one with the total length.
A payload of ``MIN_PAYLOAD`` bytes or more that an earlier page has is a ``revisit`` record without body.

Reading parses each archive by itself. Whole records are taken as they come; segments are grouped by origin, put in
order of their numbers, checked against the total length and against missing numbers, and then unframed like the others.

Scale: pages are shuffled once, by id and digest, to the tasks that write archives; in reading only segments are grouped. Which page is first is an aggregate by digest, combined before the shuffle.
A task writes an archive under a name of its own, and only the names of finished tasks are read; a task that runs twice leaves a file that nobody reads.

Defined cases: null html is an empty payload; empty payloads are responses; a null id is written as
an empty one and read back as null, after all other ids; repeated ids are records of their own; urls that are null are
written as ``urn:page``, and those with line breaks or other control characters percent-encoded, to be decoded when read; an empty table gives no rows; a record with missing segments or a wrong total length gives an error.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import local_path, new_path, stage

MIN_PAYLOAD, SEGMENT, CHUNK, ARCHIVE = 100, 16_384, 4096, 64 << 20
_DATE = "1970-01-01T00:00:00Z"
_CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- one record ---

def chunked(body: bytes, size: int = CHUNK) -> bytes:
    parts = [body[i : i + size] for i in range(0, len(body), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """The body of chunked transfer framing; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = data.index(_CRLF, at)
        size = int(data[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = end + 2
        if data[at + size : at + size + 2] != _CRLF:
            raise ValueError("a chunk is shorter than its size")
        out.append(data[at : at + size])
        at += size + 2


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + _CRLF + _CRLF


def records(data: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an uncompressed stream of chunks; holds one record at a time."""
    held = bytearray()
    at = 0
    for more in data:
        held += more
        while (end := held.find(b"\r\n\r\n", at)) >= 0:
            lines = held[at:end].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            fields = dict(line.split(": ", 1) for line in lines[1:])
            start = end + 4
            stop = start + int(fields["Content-Length"])
            if len(held) < stop + 4:
                break
            yield fields, bytes(held[start:stop])
            at = stop + 4
        del held[:at]
        at = 0
    if held:
        raise ValueError("an archive ends inside a record")


def payload(block: bytes) -> bytes:
    head, body = block.split(b"\r\n\r\n", 1)
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def header_url(url: str | None) -> list[tuple[str, object]]:
    """The fields of a url. One with control characters or outer spaces, which would end or change a header, is written percent-encoded and marked so."""
    if not url:
        return [("WARC-Target-URI", "urn:page")]
    if url != url.strip(" ") or any(c < " " or c in "\x7f\x85\u2028\u2029" for c in url):
        return [("WARC-Target-URI", quote(url, safe="")), ("WARC-Page-URI-Encoding", "percent")]
    return [("WARC-Target-URI", url)]


def page_records(page_id, url: str | None, html: bytes, digest: str, refers_to, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page."""
    own = f"<urn:uuid:{uuid.uuid4()}>"
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", own), ("WARC-Date", _DATE), *header_url(url), ("WARC-Page-ID", "" if page_id is None else page_id), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Bytes", len(html)), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        yield record(fields + [("WARC-Profile", PROFILE), ("WARC-Refers-To-Page", refers_to)], b"HTTP/1.1 200 OK\r\n\r\n")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(html)
    if len(block) <= segment:
        yield record(fields, block)
        return
    yield record(fields + [("WARC-Segment-Number", 1)], block[:segment])
    starts = range(segment, len(block), segment)
    for number, start in enumerate(starts, 2):
        total = [("WARC-Segment-Total-Length", len(block))] * (start == starts[-1])
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", number), *total], block[start : start + segment])


# --- tables ---

def revisits(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """``(page_id, digest, refers_to)``, distinct, of the pages whose payload a smaller id has; rows ``(page_id, digest, bytes)``."""
    known = stage(pages.where(F.col("bytes") >= min_payload).select("page_id", "digest"), "digests")
    first = known.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = stage(first.select("digest", "refers_to"), "first-pages")
    return known.distinct().join(first, "digest").where("not page_id <=> refers_to").select("page_id", "digest", "refers_to")


class ArchiveWriter:
    """Archives of about ``ARCHIVE`` bytes, each whole under its name only when closed."""

    def __init__(self, folder: str) -> None:
        self.folder, self.done, self.sink = folder, [], None
        self.fs, self.base = local_path(folder)
        self.fs.create_dir(self.base, recursive=True)

    def add(self, data: bytes) -> None:
        if self.sink is None:
            self.name = f"{uuid.uuid4().hex}.warc.gz"
            self.sink, self.size = self.fs.open_output_stream(f"{self.base}/{self.name}", compression=None), 0
        packed = gzip.compress(data, 4, mtime=0)
        self.sink.write(packed)
        self.size += len(packed)
        if self.size >= ARCHIVE:
            self.close()

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            self.done.append((f"{self.folder}/{self.name}", self.size))
            self.sink = None


def write_archives(pages: DataFrame, folder: str, min_payload: int = MIN_PAYLOAD, segment: int = SEGMENT) -> DataFrame:
    """Write ``(page_id, url, html)`` to archives in ``folder``; one row ``(path, bytes)`` for each archive."""
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    sized = plain.select("page_id", "url", "html", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    # a row meets its own payload's first page, whatever other rows have its id or none
    again = revisits(sized, min_payload).select(F.col("page_id").alias("again"), F.col("digest").alias("same"), "refers_to")
    joined = sized.join(again, F.col("page_id").eqNullSafe(F.col("again")) & (F.col("digest") == F.col("same")), "left").select("page_id", "url", "html", "digest", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(folder)
        for batch in batches:
            for page_id, url, html, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                for data in page_records(page_id, url, (html or "").encode(), digest, first, segment):
                    writer.add(data)
        writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in writer.done], pa.string()), pa.array([x[1] for x in writer.done], pa.int64())], ["path", "bytes"])

    return stage(joined.mapInArrow(write, "path string, bytes long"), "archives")


def _stream(path: str) -> Iterator[bytes]:
    """The bytes of the gzip members of an archive, one after another."""
    fs, at = local_path(path)
    with fs.open_input_stream(at, compression=None) as source:
        inflate = zlib.decompressobj(31)
        while data := source.read(1 << 18):
            while data:
                yield inflate.decompress(data)
                data = inflate.unused_data
                if inflate.eof:
                    inflate = zlib.decompressobj(31)
                else:
                    break


_FIELDS = ["origin", "number", "total", "type", "page_id", "url", "digest", "bytes", "refers_to", "block"]
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
_SCHEMA = "origin string, number long, total long, type string, page_id long, url string, digest string, bytes long, refers_to long, block binary"


def _body(row: tuple, block: bytes) -> bytes:
    """The payload of a response, checked against its record's digest and size."""
    body = payload(block)
    if len(body) != row[7] or hashlib.sha256(body).hexdigest() != row[6]:
        raise ValueError(f"page {row[4]}: the payload is not what its record says")
    return body


def _record_rows(path: str, with_payload: bool) -> Iterator[tuple]:
    """A row for each record; segments keep their number and block, whole records are read here."""
    number = lambda x: int(x) if x else None
    for f, block in records(_stream(path)):
        row = (f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"]), number(f.get("WARC-Segment-Number")), number(f.get("WARC-Segment-Total-Length")), f["WARC-Type"], number(f.get("WARC-Page-ID")), unquote(f["WARC-Target-URI"]) if "WARC-Page-URI-Encoding" in f else f.get("WARC-Target-URI"), f.get("WARC-Payload-Digest", "").removeprefix("sha256:"), number(f.get("WARC-Payload-Bytes")), number(f.get("WARC-Refers-To-Page")))
        if row[1] is None:
            block = None if row[3] == "revisit" else _body(row, block)
            block = block if with_payload else None
        yield (*row, block)


def _parsed(archives: DataFrame, with_payload: bool) -> DataFrame:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                for row in _record_rows(path, with_payload):
                    rows.append(row)
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _FIELDS)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _FIELDS)

    return archives.select("path").mapInArrow(parse, _SCHEMA)


def _reassembled(table: pa.Table) -> pa.Table:
    """The one record that the segments of an origin make, with its payload as block."""
    columns = [c.to_pylist() for c in table.sort_by("number").columns]
    rows = list(zip(*columns))
    block = b"".join(r[9] for r in rows)
    if [r[1] for r in rows] != list(range(1, len(rows) + 1)) or rows[-1][2] != len(block):
        raise ValueError(f"record {rows[0][0]}: segments are missing or their total length is wrong")
    row = (*rows[0][:9], _body(rows[0], block))
    return pa.table([pa.array([v], k) for v, k in zip(row, _KINDS)], _FIELDS)


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each page of the archives: id, url, size and digest of the payload, record type, and the page that a revisit refers to."""
    files = max(1, min(archives.count(), 64 * archives.sparkSession.sparkContext.defaultParallelism))
    kept = stage(_parsed(archives.repartition(files), with_payload), "records")
    joined = kept.where("number is not null").groupBy("origin").applyInArrow(_reassembled, _SCHEMA)
    every = kept.where("number is null").union(joined)
    pages = every.select("page_id", "url", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to", F.col("block").alias("payload"))
    return pages if with_payload else pages.drop("payload")


def round_trip(pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """``pages`` written to new archives in the shared folder and read back."""
    return read_archives(write_archives(pages, new_path(pages.sparkSession, "warc")), with_payload)
