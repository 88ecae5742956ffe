"""WARC archives: a writer and a reader that splits files at any byte.

Writer: every record is one gzip member, so readers can start at any record. Of records with equal
payloads of at least ``min_bytes`` bytes the one with the smallest id is a ``response``; the others
are ``revisit`` records without payload that refer to it. Records are written by Spark's text
writer as raw bytes, which commits whole files only, so lost or repeated tasks leave no parts. Its
line end is an empty gzip member, so a file stays a plain series of members.

Reader: files are cut in byte ranges of ``split_bytes``. A task looks for the gzip magic from the
start of its range, takes a place for a member only if it inflates to a WARC version line with
well-formed headers, and owns the records that start inside its range, reading past its end to
finish the last one. Archives of other writers are read too, if each record is a member of its own: the
payload starts after the HTTP head, whatever it holds; record names that are no page ids come back as
null; a revisit's size and digest are null where it doesn't state them (digest: as SHA-256); records of
other types (warcinfo, request, ..) are passed over.

Null html: an empty payload. Null id: the record has none, and null comes back; it can't be referred
to. Null url: no target. Rows that repeat id and payload are all responses. Line ends in urls become
spaces; heads may be of any length, and so may payloads, of which a task holds one at a time when it writes. Columns
other than page_id, url and html are ignored, whatever their names. An empty table gives an empty archive, which reads
back as no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.llm.scratch import materialise

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: A whole gzip member of no bytes: fixed by the gzip and deflate formats.
EMPTY_MEMBER = "\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
_BLOCK = 1 << 18
#: Digests with copies that are broadcast at most: some 100 bytes each.
BROADCAST_ROWS = 200_000
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def gzip_member(data: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    revisit = refers_to is not None
    block = HTTP if revisit else HTTP + payload
    lines = [VERSION, b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Date: 1970-01-01T00:00:00Z"]
    if page_id is not None:
        lines.append(b"WARC-Record-ID: <urn:page:%d>" % page_id)
    if url is not None:
        lines.append(b"WARC-Target-URI: " + url.replace("\r", " ").replace("\n", " ").encode())
    lines.append(b"WARC-Payload-Digest: sha256:" + digest.encode())
    if revisit:
        lines += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:%d>" % refers_to, b"X-Payload-Length: %d" % len(payload)]
    lines += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_revisits(pages: DataFrame, min_bytes: int = 100, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, html, digest, refers_to.

    Digests that occur more than once are found from ids and digests alone. If they are at most
    ``broadcast_rows`` they are broadcast and html stays where it is; else only pages that are long enough
    are joined with them by a shuffle, in which a digest with many copies can be split.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    marked = pages.select("page_id", "url", "html", F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("n"))
    key = F.unhex("digest").alias("key")
    first = materialise(
        marked.where(F.col("n") >= min_bytes).select("page_id", key).groupBy("key")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where((F.col("copies") > 1) & F.col("first_id").isNotNull())
        .select("key", "first_id"), "copies",
    )
    long, short = (marked.where(c).withColumn("key", key) for c in (F.col("n") >= min_bytes, F.col("n") < min_bytes))
    found = long.join(F.broadcast(first) if first.count() <= broadcast_rows else first.hint("merge"), "key", "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")), F.col("first_id"))
    columns = ["page_id", "url", "html", "digest"]
    return found.select(*columns, refers.alias("refers_to")).union(short.select(*columns, F.lit(None).cast(first.schema["first_id"].dataType)))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 100, level: int = 3, broadcast_rows: int = BROADCAST_ROWS) -> None:
    """Write ``pages`` (page_id, url, html) as gzipped WARC files below ``path``."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for i in range(batch.num_rows):
                page_id, url, html, digest, refers = (batch.column(c)[i].as_py() for c in range(5))
                out.append(gzip_member(record_bytes(page_id, url, (html or "").encode(), digest, refers), level))
                size += len(out[-1])
                if size > 1 << 24 or len(out) >= 500:
                    yield pa.record_batch([pa.array(out, pa.binary())], names=["member"])
                    out, size = [], 0
            if out:
                yield pa.record_batch([pa.array(out, pa.binary())], names=["member"])

    rows = with_revisits(pages, min_bytes, broadcast_rows).mapInArrow(members, "member binary")
    rows.select(F.col("member").cast("string").alias("value")).write.option("lineSep", EMPTY_MEMBER).option("encoding", "ISO-8859-1").text(path)


class _File:
    """Bytes of a file from a place on, read as far as asked for."""

    def __init__(self, handle, start: int, size: int):
        self.handle, self.at, self.size, self.data = handle, start, size, b""

    def need(self, place: int, n: int) -> bool:
        """Make n bytes from place available, if the file has them."""
        if place < self.at:
            self.at, self.data = place, b""
        end = self.at + len(self.data)
        while end < min(self.size, place + n):
            more = self.handle.read_at(min(_BLOCK, self.size - end), end)
            if not more:
                break
            self.data += more
            end += len(more)
        return place < end

    def get(self, place: int, n: int) -> bytes:
        self.need(place, n)
        return self.data[place - self.at : place - self.at + n]

    def drop(self, place: int) -> None:
        if place - self.at > 4 * _BLOCK:
            self.data, self.at = self.data[place - self.at :], place

    def find_magic(self, place: int, end: int) -> int:
        """First magic that starts in place..end, or -1."""
        while place < end:
            self.need(place, _BLOCK)
            upto = min(end + len(MAGIC) - 1, self.at + len(self.data))
            hit = self.data.find(MAGIC, place - self.at, upto - self.at)
            if hit >= 0:
                return self.at + hit
            if upto <= place + len(MAGIC) - 1:
                return -1
            place = upto - len(MAGIC) + 1
            self.drop(place)
        return -1


def _headers(text: bytes) -> dict[bytes, bytes] | None:
    """A WARC head's fields, names in lower case; lines that begin with white space carry the last one on."""
    lines = text.split(b"\r\n")
    if not lines[0].startswith(b"WARC/1."):
        return None
    out: dict[bytes, bytes] = {}
    name = None
    for line in lines[1:]:
        if line[:1] in (b" ", b"\t") and name:
            out[name] += b" " + line.strip()
            continue
        name, found, value = line.partition(b":")
        if not found:
            return None
        name = name.strip().lower()
        out[name] = value.strip()
    return out


class _Payload:
    """Size and SHA-256 of a record's payload, taken in parts: what follows the HTTP head if the block has
    one, else all of the block."""

    def __init__(self, headers: dict[bytes, bytes]):
        self.left, self.seen, self.sha = int(headers[b"content-length"]), 0, hashlib.sha256()
        self.http = headers.get(b"content-type", b"").lower().startswith(b"application/http")
        self.head = b""

    def take(self, part: bytes) -> None:
        part = part[: self.left]
        self.left -= len(part)
        if self.http:
            self.head += part
            at, skip = min(((i, len(e)) for e in (b"\r\n\r\n", b"\n\n") if (i := self.head.find(e)) >= 0), default=(-1, 0))
            if at < 0:
                return
            part, self.head, self.http = self.head[at + skip :], b"", False
        self.seen += len(part)
        self.sha.update(part)


def _member(file: _File, place: int):
    """(headers, payload, end) of the record whose member starts at place; None if there is none. The
    payload is hashed as it is inflated, never held whole."""
    z, head, headers, payload, at = zlib.decompressobj(31), b"", None, None, place
    while not z.eof:
        block = file.get(at, _BLOCK)
        if not block:
            return None
        at += len(block)
        file.drop(at)  # the bytes are read again if this turns out not to be a member
        pending = block
        while pending and not z.eof:
            try:
                out = z.decompress(pending, _BLOCK * 4)
            except zlib.error:
                return None
            pending = z.unconsumed_tail
            if payload is None:
                searched = max(0, len(head) - 3)
                head += out
                if not head.startswith(b"WARC/1."[: len(head)]):
                    return None
                end = head.find(b"\r\n\r\n", searched)
                if end < 0:
                    continue
                headers = _headers(head[:end])
                if headers is None or not headers.get(b"content-length", b"x").isdigit():
                    return None
                payload = _Payload(headers)
                head, out = b"", head[end + 4 :]
            payload.take(out)
    return (headers, payload, at - len(z.unused_data)) if payload is not None and not payload.left else None


def _id(value: bytes | None) -> int | None:
    """The page id of a record's name; None for names of other writers."""
    m = re.fullmatch(rb"<urn:page:(-?[0-9]{1,19})>", value or b"")
    return int(m[1]) if m and -(1 << 63) <= int(m[1]) < 1 << 63 else None


def records_in(file: _File, start: int, end: int) -> Iterator[tuple]:
    place = start
    while (place := file.find_magic(place, end)) >= 0:
        found = _member(file, place)
        if found is None:  # an empty member, or bytes that only look like one
            place += 1
            continue
        headers, payload, after = found
        kind = headers.get(b"warc-type", b"").decode(errors="replace")
        if kind in ("response", "revisit"):  # others say nothing of pages
            size, digest = payload.seen, payload.sha.hexdigest()
            if kind == "revisit":
                length, name = headers.get(b"x-payload-length", b""), headers.get(b"warc-payload-digest", b"").decode(errors="replace")
                size, digest = int(length) if length.isdigit() else None, name.removeprefix("sha256:") if name.startswith("sha256:") else None
            yield (_id(headers.get(b"warc-record-id")), size, digest, kind, _id(headers.get(b"warc-refers-to")), headers[b"warc-target-uri"].decode(errors="replace") if b"warc-target-uri" in headers else None)
        place = after
        file.drop(place)


def read_warc(spark: SparkSession, path: str, split_bytes: int = 16 << 20) -> DataFrame:
    """The records below ``path``, each once, whatever ``split_bytes`` is."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") > 0).select("path", "length")
    step = F.lit(int(split_bytes)).cast("long")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, step)).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
        for batch in batches:
            for row in batch.to_pylist():
                uri = row["path"]
                system, name = fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
                with system.open_input_file(name) as handle:
                    rows = []
                    for record in records_in(_File(handle, row["start"], row["length"]), row["start"], row["start"] + split_bytes):
                        rows.append(record)
                        if len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    n = spark.conf.get("spark.sql.shuffle.partitions")
    return ranges.repartition(int(n), "path", "start").mapInArrow(read, RECORD_SCHEMA)
