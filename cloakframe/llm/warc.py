"""WARC archives: writing with revisits, segments and chunked transfer framing, and reading back.

Writing: each page becomes a record; of equal payloads one is a response and
the others revisit it.  A response's HTTP block is framed in chunks; a block
longer than ``segment_bytes`` is split into continuation records.  Archives
are gzip files that Spark's text sink writes, one record after another, so any
store that Spark can write holds them.

Reading: whole records are decoded where they are read.  Segments are grouped
by their origin's identifier, ordered by number, checked against the total
length, joined, and then decoded; only segments are shuffled.  A payload whose
digest differs from its header's stops the job.  Archives are read once: what
a task decodes, and the segments it finds, are written to the shared folder.

Scale: an archive has at most ``records_per_file`` records of at most
``segment_bytes`` and a header (128 MB as set here) and is read by one task,
record by record.  Equal payloads are found by digest with partial aggregation.  The list
of revisits is written before it is joined, so payloads stay where they are
read if that list is small enough for Spark to broadcast, and else move once.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, text_bytes

CHUNK_BYTES, SEGMENT_BYTES, RECORDS_PER_FILE = 8192, 32_768, 4000
_DATE = "2024-01-01T00:00:00Z"
_END = b"\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunk(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are passed over, broken framing fails."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not n:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n" or len(body) < at + n + 2:
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + n])
        at += n + 2


def _header(pairs: list[tuple[str, object]]) -> bytes:
    lines = [f"{k}: {v}" for k, v in pairs if v is not None]
    return "\r\n".join(["WARC/1.1", *lines]).encode() + _END


def _uri(url: str | None) -> str | None:
    return None if url is None else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def page_records(page_id: int, url: str | None, payload: bytes, refers_to: int | None, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The WARC records of a page; ``refers_to`` is the page that a revisit repeats."""
    digest = base32_sha1(payload)
    name = f"<urn:page:{page_id}:{digest}>"
    common: list[tuple[str, object]] = [("WARC-Record-ID", name), ("WARC-Date", _DATE), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + _END
        extra = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}:{digest}>")]
        yield _header([("WARC-Type", "revisit"), *common, *extra, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]) + block + _END
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + _END + chunked(payload, chunk_bytes)
    n = -(-len(block) // segment_bytes)
    first = block[:segment_bytes]
    yield _header([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1 if n > 1 else None), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(first))]) + first + _END
    for k in range(2, n + 1):
        part = block[(k - 1) * segment_bytes : k * segment_bytes]
        pairs: list[tuple[str, object]] = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{page_id}:{digest}:{k}>"), ("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k)]
        yield _header([*pairs, ("WARC-Segment-Total-Length", len(block) if k == n else None), ("Content-Length", len(part))]) + part + _END


def parse(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record, read one after another."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        n = int(head["content-length"])
        block = stream.read(n + 4)
        if len(block) != n + 4 or block[n:] != _END:
            raise ValueError("a record does not end where its length says")
        yield head, block[:n]


def _http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(_END)
    pairs = (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])
    return {k.lower(): v.strip() for k, _, v in pairs}, body


def payload_of(block: bytes, digest: str) -> bytes:
    """The payload of a response's block, held against its digest."""
    head, body = _http(block)
    payload = dechunk(body) if head.get("transfer-encoding", "").lower() == "chunked" else body
    if base32_sha1(payload) != digest:
        raise ValueError("a payload does not match its digest")
    return payload


def reassemble(segments: list[tuple[int, int | None, bytes]]) -> list[bytes]:
    """Blocks from (number, total length or none, data); records written twice come back twice."""
    by_number: dict[int, list[bytes]] = {}
    total = None
    for number, length, data in segments:
        by_number.setdefault(number, []).append(data)
        total = length if length is not None else total
    numbers = sorted(by_number)
    if numbers != list(range(1, len(numbers) + 1)) or len({len(x) for x in by_number.values()}) != 1:
        raise ValueError("segments are missing")
    block = b"".join(by_number[k][0] for k in numbers)
    if len(block) != total:
        raise ValueError(f"segments make {len(block)} bytes instead of {total}")
    return [block] * len(by_number[1])


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Archives of ``pages`` (page_id, url, html) in the folder ``path``.

    Null html is an empty payload, a null url leaves its header out.  Of equal
    payloads of at least ``min_revisit_bytes``, rows with the smallest page_id
    are responses (all of them if that row is repeated), others are revisits;
    a null page_id is larger than any, and is read back as null.
    Other columns are ignored; an empty table writes archives without records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes] = []
            size = 0
            for page, url, payload, refers in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                # The sink ends each row with the line feed that is cut off here.
                new = [r[:-1] for r in page_records(page, url, payload.as_py(), refers, segment_bytes, chunk_bytes)]
                out += new
                size += sum(map(len, new))
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text_bytes("html").alias("payload"))
    keyed = rows.withColumn("key", F.sha2("payload", 256))
    keyed = keyed.withColumn("number", F.coalesce("page_id", F.lit(2**63 - 1)))
    first = keyed.where(F.length("payload") >= min_revisit_bytes).groupBy("key").agg(F.min("number").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = keyed.select("number", "key").join(first, "key").where("number > first").select("number", "key", F.col("first").alias("refers_to")).distinct()
    again = materialize(again, "revisits")
    records = keyed.join(again, ["number", "key"], "left").select("page_id", "url", "payload", "refers_to").mapInArrow(run, "record binary")
    records.select(F.col("record").cast("string")).write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", records_per_file).text(path)


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_PAGE = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _page_id(name: str) -> int | None:
    number = name.strip("<>").split(":")[2]
    return None if number == "None" else int(number)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def _response(name: str, block: bytes, digest: str) -> tuple:
    return _page_id(name), len(payload_of(block, digest)), digest, "response", None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row a page of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    both = pa.schema([*_PAGE, ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("data", pa.binary())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for content in (c for b in batches for c in b.column(0)):
            for head, block in parse(gzip.open(io.BytesIO(content.as_py()))):
                name, digest = head["warc-record-id"], head.get("warc-payload-digest", "").removeprefix("sha1:")
                if head["warc-type"] == "revisit":
                    rows.append((_page_id(name), int(_http(block)[0]["content-length"]), digest, "revisit", _page_id(head["warc-refers-to"]), None, None, None, None))
                elif "warc-segment-number" in head:
                    total = head.get("warc-segment-total-length")
                    rows.append((None, None, digest or None, None, None, head.get("warc-segment-origin-id", name), int(head["warc-segment-number"]), total and int(total), block))
                elif head["warc-type"] == "response":
                    rows.append((*_response(name, block, digest), None, None, None, None))
                if len(rows) >= 200:
                    yield _batch(rows, both)
                    rows = []
        yield _batch(rows, both)

    def join_up(group: pa.Table) -> pa.Table:
        blocks = reassemble(list(zip(*(group.column(c).to_pylist() for c in ("number", "total", "data")), strict=True)))
        digest = next(d for d in group.column("payload_digest").to_pylist() if d)
        name = group.column("origin")[0].as_py()
        return pa.Table.from_batches([_batch([_response(name, x, digest) for x in blocks], _PAGE)])

    files = spark.read.format("binaryFile").load(path).select("content")
    found = materialize(files.mapInArrow(decode, f"{_READ}, origin string, number int, total long, data binary"), "records")
    joined = found.where("origin is not null").select("payload_digest", "origin", "number", "total", "data").groupBy("origin").applyInArrow(join_up, _READ)
    return found.where("origin is null").select(_PAGE.names).unionByName(joined)
