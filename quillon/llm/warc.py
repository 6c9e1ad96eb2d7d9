"""WARC archives: writing with segments and chunked framing, and reassembly.

`write` turns payloads into records and packs them into archive files, kept as
rows (archive, member, content) of a table that Spark writes, so any store the
cluster has will do.  A payload over SEGMENT bytes is framed in chunks and its
record block cut into segments: a first record and continuation records that
name it as their origin.  Equal payloads are stored once; the other records
are revisits.

`read` parses archives, our own or others, plain or in gzip members.  Whole
records are decoded where they lie; only segments are shuffled, by origin
identifier, then ordered by segment number, checked against the total length
that the last one states, and unframed.  Responses, resources and revisits give
a row each; records of other kinds (warcinfo, request, metadata, conversion)
give none.  A page id is read from the header that `write` adds, so it is null
for archives without it; a revisit then has no page to refer to.

Null and empty payloads are payloads of no bytes, all equal; very long ones are
stored in segments.  Rows that are equal, or that tie for the largest page_id
of a payload, are all responses.  A record that is cut off, whose segments are
missing (the first one, too), whose length is wrong or whose digest doesn't
match comes back with status "damaged" and no payload.  Only page_id, url and
html are read, whatever other columns are called.  An empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, broadcast_if_small, slices, written

SEGMENT = 16_384
CHUNK = 4_096
ARCHIVE_BYTES = 4_000_000
#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"2024-01-01T00:00:00Z"
CAPTURES = frozenset(("response", "resource", "revisit", "continuation"))


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def identifier(*parts: object) -> bytes:
    return b"<urn:uuid:" + str(uuid.uuid5(uuid.NAMESPACE_URL, "/".join(map(str, parts)))).encode() + b">"


def record(kind: bytes, rid: bytes, headers: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    lines = [(b"WARC-Type", kind), (b"WARC-Record-ID", rid), (b"WARC-Date", DATE), *headers, (b"Content-Length", str(len(block)).encode())]
    return VERSION + b"".join(a + b": " + b.replace(b"\r", b" ").replace(b"\n", b" ") + b"\r\n" for a, b in lines) + b"\r\n" + block + b"\r\n\r\n"


def chunked(data: bytes, size: int = CHUNK) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(data[i : i + size]), data[i : i + size]) for i in range(0, len(data), size)) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes | None:
    """The body of a chunked message; None where the framing is broken."""
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        try:
            size = int(data[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        if size < 0:
            return None
        if size == 0:
            return b"".join(out)
        at = end + 2 + size
        if data[at : at + 2] != b"\r\n":
            return None
        out.append(data[end + 2 : at])
        at += 2
    return None


def records_of(place: str, page_id: int | None, url: str | None, data: bytes, refers_to: int | None, refers_url: str | None) -> Iterator[bytes]:
    """The records of one page; place tells pages apart whose rows are the same."""
    target = (b"WARC-Target-URI", (f"urn:page:{page_id}" if url is None else url).encode("utf-8", "surrogatepass"))
    own = (b"WARC-Page-ID", b"" if page_id is None else b"%d" % page_id)
    sha = (b"WARC-Payload-Digest", b"sha1:" + digest(data).encode())
    rid = identifier(place, page_id)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    kind = (b"Content-Type", b"application/http; msgtype=response")
    if refers_to is not None:
        headers = [target, own, kind, sha, (b"WARC-Profile", PROFILE), (b"WARC-Refers-To-Target-URI", (f"urn:page:{refers_to}" if refers_url is None else refers_url).encode("utf-8", "surrogatepass")), (b"WARC-Refers-To-Date", DATE), (b"WARC-Refers-To-Page", b"%d" % refers_to)]
        yield record(b"revisit", rid, headers, http + b"Content-Length: %d\r\n\r\n" % len(data))
        return
    if len(data) <= SEGMENT:
        yield record(b"response", rid, [target, own, kind, sha], http + b"Content-Length: %d\r\n\r\n" % len(data) + data)
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(data)
    parts = range(0, len(block), SEGMENT)
    for i, at in enumerate(parts):
        number = (b"WARC-Segment-Number", str(i + 1).encode())
        last = [(b"WARC-Segment-Total-Length", str(len(block)).encode())] if i == len(parts) - 1 else []
        if i == 0:
            yield record(b"response", rid, [target, own, kind, sha, number, *last], block[:SEGMENT])
        else:
            yield record(b"continuation", identifier(place, page_id, i + 1), [target, own, number, (b"WARC-Segment-Origin-ID", rid), *last], block[at : at + SEGMENT])


def inflated(content: bytes) -> bytes:
    """An archive as it was before compression; of a broken gzip member what can be read."""
    out = []
    while content.startswith(b"\x1f\x8b"):
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(content))
        except zlib.error:
            break
        content = member.unused_data
    return b"".join(out) if out else content


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive. After a header without a length the next record is looked for."""
    content = inflated(content)
    at = content.find(b"WARC/")
    while at >= 0:
        end = content.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers, last = {}, ""
        for line in content[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if line[:1] in b" \t" and last:  # a folded line goes on with the one before
                headers[last] = f"{headers[last]} {line.strip().decode('utf-8', 'replace')}".strip()
                continue
            last = name.decode("latin-1").strip().lower()
            headers[last] = value.strip().decode("utf-8", "replace")
        size = whole(headers.get("content-length"))
        yield headers, content[end + 4 : end + 4 + (size or 0)]
        at = content.find(b"WARC/", end + 4 + (size or 0))


def whole(value: str | None) -> int | None:
    """A number of 0 or more; null where it isn't one that fits."""
    return int(value) if value and value.isascii() and value.isdigit() and len(value) < 19 else None


def unframed(block: bytes) -> tuple[bytes | None, int]:
    """Payload of an HTTP message, and the length its head states (-1: none)."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {a.strip().lower(): b.strip() for a, _, b in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
        return unchunked(body), -1
    length = whole(fields.get(b"content-length", b"").decode("latin-1"))
    return body, -1 if length is None else length


def roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages with refers_to: among equal payloads of at least `least` bytes, the largest page_id for every other page, else null.

    Only the key and the largest page of each repeated payload is joined back; that table is broadcast where its counted rows are few.
    A page without an id is never the largest; where no equal page has one, all are responses.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", "html", F.sha2(body, 256).alias("_key"))
    again = keyed.filter(F.octet_length(F.coalesce(F.col("html"), F.lit(""))) >= least).groupBy("_key").agg(F.max(F.struct("page_id", "url")).alias("_of"), F.count("*").alias("_n")).filter("_n > 1 and _of.page_id is not null").select("_key", F.col("_of.page_id").alias("_first"), F.col("_of.url").alias("_url"))
    again = written(again, "warc-repeats")
    other = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("page_id"))
    return keyed.join(broadcast_if_small(again, again.count()), "_key", "left").select("page_id", "url", "html", F.when(other, F.col("_first")).alias("refers_to"), F.when(other, F.col("_url")).alias("refers_url"))


def write(pages: DataFrame) -> DataFrame:
    """Archives of the pages (page_id, url, html, refers_to): archive, content; each about ARCHIVE_BYTES at most, or one record."""
    schema = pa.schema([("archive", pa.string()), ("content", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        part, n, pending, size, row = TaskContext.get().partitionId(), 0, [], 0, 0

        def member():
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{n:06d}.warc"]), pa.array([b"".join(pending)], pa.binary())], schema=schema)

        for batch in slices(batches):
            for page_id, url, page, *refers in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "html", "refers_to", "refers_url"))):
                row += 1
                for one in records_of(f"{part}/{row}", page_id, url, (page or "").encode("utf-8", "surrogatepass"), *refers):
                    if pending and size + len(one) > ARCHIVE_BYTES:
                        yield member()
                        n, pending, size = n + 1, [], 0
                    pending.append(one)
                    size += len(one)
        if pending:
            yield member()

    return bounded(pages.select("page_id", "url", "html", "refers_to", "refers_url")).mapInArrow(run, "archive string, content binary")


_PAGE = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, status string, payload binary"
_PAGE_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("status", pa.string()), ("payload", pa.binary())])


def _page(headers: dict[str, str], block: bytes, keep: bool, complete: bool = True) -> tuple:
    kind, url, page_id = headers.get("warc-type"), headers.get("warc-target-uri"), whole(headers.get("warc-page-id"))
    if headers.get("warc-page-id", "").startswith("-"):
        page_id = -(whole(headers["warc-page-id"][1:]) or 0)
    kind = "response" if kind == "continuation" else kind
    http = headers.get("content-type", "application/http").startswith("application/http")
    data, length = unframed(block) if http else (block, -1)
    stated = headers.get("warc-payload-digest", "")
    known = stated.removeprefix("sha1:") if stated.startswith("sha1:") else None
    if not complete:
        return page_id, url, kind, None, None, None, "damaged", None
    if kind == "revisit":
        refers = headers.get("warc-refers-to-page", "")
        refers_to = -(whole(refers[1:]) or 0) if refers.startswith("-") else whole(refers)
        return page_id, url, kind, refers_to, None if length < 0 else length, known, "ok", None
    if data is None or length not in (-1, len(data)) or known not in (None, digest(data)):
        return page_id, url, kind, None, None, None, "damaged", None
    return page_id, url, kind, None, len(data), digest(data), "ok", data if keep else None


def read(archives: DataFrame, keep_payload: bool = False) -> DataFrame:
    """One row for each captured page: its record, payload length and digest, and the payload where it is kept."""
    names = [f.name for f in _PAGE_SCHEMA]
    part_schema = pa.schema([("origin", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])
    whole_ddl = _PAGE + ", origin string, number bigint, total bigint, headers map<string,string>, block binary"
    both = pa.schema([*_PAGE_SCHEMA, *part_schema])

    def scan(batches):
        for batch in batches:
            for content in batch.column(batch.schema.get_field_index("content")):
                rows = []
                for headers, block in parse(content.as_py()):
                    number, complete = whole(headers.get("warc-segment-number")), whole(headers.get("content-length")) == len(block)
                    if headers.get("warc-type") not in CAPTURES:
                        continue
                    if number is None:
                        rows.append((*_page(headers, block, keep_payload, complete), None, None, None, None, None))
                    else:
                        origin = headers.get("warc-segment-origin-id") or headers.get("warc-record-id", "")
                        rows.append((*[None] * len(names), origin, number, whole(headers.get("warc-segment-total-length")), list(headers.items()), block if complete else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), both)], schema=both)

    def join(key, found):
        parts = sorted(found.to_pylist(), key=lambda r: r["number"])
        total = next((r["total"] for r in parts if r["total"] is not None), None)
        block = b"".join(r["block"] or b"" for r in parts)
        complete = [r["number"] for r in parts] == list(range(1, len(parts) + 1)) and len(block) == total
        row = _page(dict(parts[0]["headers"]), block, keep_payload, complete)
        return pa.Table.from_pylist([dict(zip(names, row))], schema=_PAGE_SCHEMA)

    scanned = written(archives.mapInArrow(scan, whole_ddl), "warc-records")
    segments = scanned.filter("origin is not null").select("origin", "number", "total", "headers", "block")
    return scanned.filter("origin is null").select(*names).unionByName(segments.groupBy("origin").applyInArrow(join, _PAGE))


#: The same in DuckDB, without the archives: what reading them has to give.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((((strpos('0123456789abcdef', substr(s, (5 * i // 4 + 1)::INT, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(s, (5 * i // 4 + 2)::INT, 1)) - 1)
      >> (3 - (5 * i) % 4)::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN top END AS refers_to, 'ok' AS status
FROM q
"""
