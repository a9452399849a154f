"""WARC archives: writing pages as records, and reading archives with segmented records put together again.

Writing: pages whose payload an earlier page (by id) already has become
revisit records; a long block is cut into a first segment and continuation
records; every other payload is framed in HTTP chunks.  An archive is one row
(path, content), the shape in which Spark reads binary files.

Reading: archives are parsed record by record.  Continuation records are
grouped by the identifier of their origin, ordered by segment number and
joined; the total length that the last one states is verified; then the HTTP
head is split off and chunked transfer framing is decoded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.common import Batcher
from lodeweave.workspace import materialize, ship

#: Payloads of fewer bytes are never revisits.
MIN_REVISIT_BYTES = 0
#: A record's block of more bytes is cut into segments of so many.
SEGMENT_BYTES = 16 << 10
#: Bytes of one HTTP chunk, and of an archive before the next is begun.
CHUNK_BYTES, ARCHIVE_BYTES = 4 << 10, 8 << 20
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_ARCHIVE_FIELDS = pa.schema([("path", pa.string()), ("content", pa.binary())])


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, identity: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{identity}>", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {v}" for k, v in headers] + [f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """``payload`` in HTTP/1.1 chunks, the last one empty."""
    parts = [b"%x\r\n%s\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of chunked framing; extensions and trailers are passed over.  ValueError if it breaks off."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunked body breaks off before its last chunk")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        if not size:
            return b"".join(parts)
        part = body[end + 2 : end + 2 + size]
        if len(part) < size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("chunk is shorter than it states")
        parts.append(part)
        at = end + 4 + size


def page_records(serial: str, page: str, url: str, payload: bytes, refers: str | None, framed: bool, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page: a revisit, a response, or a response with continuations."""
    identity = f"urn:x-page:{page}:{serial}"
    digest = ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}")
    target = ("WARC-Target-URI", "".join(c if c.isprintable() else "%20" for c in url))
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Bytes: {len(payload)}\r\n"
    kind = ("Content-Type", "application/http;msgtype=response")
    if refers is not None:
        block = (head + f"Content-Length: {len(payload)}\r\n\r\n").encode()
        yield _record("revisit", identity, [target, digest, kind, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:x-page:{refers}>")], block)
        return
    if framed:
        block = (head + "Transfer-Encoding: chunked\r\n\r\n").encode() + chunked(payload)
    else:
        block = (head + f"Content-Length: {len(payload)}\r\n\r\n").encode() + payload
    if len(block) <= segment_bytes:
        yield _record("response", identity, [target, digest, kind], block)
        return
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield _record("response", identity, [target, digest, kind, ("WARC-Segment-Number", "1")], parts[0])
    for number, part in enumerate(parts[1:], 2):
        more = [target, ("WARC-Segment-Number", str(number)), ("WARC-Segment-Origin-ID", f"<{identity}>")]
        if number == len(parts):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _record("continuation", f"{identity}:{number}", more, part)


def write_archives(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
    segment_bytes: int = SEGMENT_BYTES,
) -> DataFrame:
    """(path, content) archives with a record for every row of ``pages``.

    Null html is an empty payload, a null url an empty one.  Of rows with
    equal payloads that of the smallest id is the response; rows that repeat
    this id are responses too.  A row without an id is a response unless
    another row has its payload and an id.  Other columns are not read.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    base = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("html"))
    base = base.withColumn("key", F.unhex(F.sha2("html", 256)))
    small = base.select("id", "key", F.octet_length("html").alias("n"))
    firsts = small.where(F.col("n") >= min_revisit_bytes).groupBy("key").agg(F.min("id").alias("first"))
    # By payload first, on small rows, so html moves only by page and no hot payload gathers pages.
    later = materialize(small.join(firsts, "key").where(~F.col("id").eqNullSafe(F.col("first"))).select("id", "key", "first").distinct(), "warc")
    rows = base.alias("p").join(
        later.alias("l"), F.col("p.id").eqNullSafe(F.col("l.id")) & (F.col("p.key") == F.col("l.key")), "left"
    ).select(F.col("p.id").cast("string"), "p.url", "p.html", F.col("l.first").cast("string").alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, serial, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def archive() -> pa.RecordBatch:
            info = _record("warcinfo", f"urn:x-archive:{task}-{number}", [("Content-Type", "application/warc-fields")], b"software: lodeweave\r\n")
            return pa.RecordBatch.from_arrays([[f"pages-{task:06d}-{number:06d}.warc"], pa.array([info + b"".join(held)], pa.binary())], schema=_ARCHIVE_FIELDS)

        for batch in batches:
            for page, url, html, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = html.encode("utf-8", "replace")
                for record in page_records(f"{task}-{serial}", "null" if page is None else page, url, data, first, serial % 2 == 1, segment_bytes):
                    held.append(record)
                    size += len(record)
                serial += 1
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    number, held, size = number + 1, [], 0
        if held:
            yield archive()

    ship(pages.sparkSession)
    return rows.mapInArrow(run, "path string, content binary")


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record; gzip members are unpacked."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at = 0
    while at < len(content):
        if content[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or content[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")
        headers = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        start, length = end + 4, int(headers["content-length"])
        if start + length > len(content):
            raise ValueError(f"record at byte {at} breaks off")
        yield headers, content[start : start + length]
        at = start + length


def http_payload(block: bytes) -> tuple[dict[str, str], bytes]:
    """(HTTP headers with lower-case names, payload freed from chunked framing)."""
    head, _, body = block.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    return headers, unchunked(body) if headers.get("transfer-encoding", "").lower() == "chunked" else body


_PART = "origin string, number int, kind string, uri string, digest string, refers string, total bigint, block binary"
_PART_FIELDS = pa.schema(
    [("origin", pa.string()), ("number", pa.int32()), ("kind", pa.string()), ("uri", pa.string()), ("digest", pa.string()), ("refers", pa.string()),
     ("total", pa.int64()), ("block", pa.binary())]
)
_READ = "record_id string, record_type string, url string, payload binary, payload_bytes bigint, payload_digest string, refers_to string, intact boolean"
_READ_FIELDS = pa.schema(
    [("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
     ("payload_digest", pa.string()), ("refers_to", pa.string()), ("intact", pa.bool_())]
)


def _finished(origin: str, kind: str, uri: str, digest: str | None, refers: str | None, block: bytes, whole: bool) -> tuple:
    """A row of the result.  ``intact`` is false where segments, framing or the stated digest don't hold."""
    stated = digest.partition(":")[2] if digest else None
    try:
        headers, payload = http_payload(block)
    except ValueError:
        headers, payload, whole = {}, b"", False
    if kind == "revisit":
        size = headers.get("x-page-bytes", headers.get("content-length"))
        return origin, kind, uri, None, int(size) if size else None, stated, refers, whole
    found = sha1_base32(payload)
    return origin, kind, uri, payload, len(payload), found, None, whole and stated in (None, found)


def _bare(identity: str | None) -> str | None:
    return identity.strip("<>") if identity else None


def read_archives(archives: DataFrame) -> DataFrame:
    """Response and revisit records of (path, content) archives, as ``read_archives`` of binary files gives them.

    Columns: record_id, record_type, url, payload (null for revisits),
    payload_bytes, payload_digest (bare base32 SHA-1), refers_to, intact.  A
    segmented record with a missing segment, a wrong total or broken framing
    is returned with ``intact`` false.  Null content has no records; other
    record types and columns are passed over.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batcher(_PART_FIELDS)
        for batch in batches:
            for content in batch.column(0):
                for h, block in parse_archive(content.as_py() or b""):
                    kind = h.get("warc-type")
                    if kind in ("response", "revisit", "continuation"):
                        origin = _bare(h.get("warc-segment-origin-id") or h["warc-record-id"])
                        number = int(h.get("warc-segment-number", 0))
                        total = h.get("warc-segment-total-length")
                        row = (origin, number, kind, h.get("warc-target-uri"), h.get("warc-payload-digest"), _bare(h.get("warc-refers-to")), int(total) if total else None, block)
                        yield from out.add(row, len(block) + 200)
        yield from out.flush()

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batcher(_READ_FIELDS)
        for batch in batches:
            for origin, _, kind, uri, digest, refers, _, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from out.add(_finished(origin, kind, uri, digest, refers, block, True), len(block) + 200)
        yield from out.flush()

    def join(key: tuple, group: pa.Table) -> pa.Table:
        parts = sorted(group.to_pylist(), key=lambda r: r["number"])
        first, block = parts[0], b"".join(r["block"] for r in parts)
        numbers, totals = [r["number"] for r in parts], [r["total"] for r in parts if r["total"] is not None]
        whole = numbers == list(range(1, len(parts) + 1)) and totals == [len(block)]
        row = _finished(key[0].as_py(), "response" if first["kind"] == "continuation" else first["kind"], first["uri"], first["digest"], first["refers"], block, whole)
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, _READ_FIELDS, strict=True)], schema=_READ_FIELDS)

    ship(archives.sparkSession)
    parts = archives.select("content").mapInArrow(parse, _PART)
    return parts.where("number = 0").mapInArrow(single, _READ).union(parts.where("number > 0").groupBy("origin").applyInArrow(join, _READ))


def page_of(identity):
    """The page id, as a string, in a record identifier of ``write_archives``."""
    return F.nullif(F.split_part(identity, F.lit(":"), F.lit(3)), F.lit("null"))
