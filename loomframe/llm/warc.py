"""WARC archives: a writer that deduplicates payloads, and a salvaging reader.

Records are written as gzip members of their own, so that a damaged archive can
be read on from the next sound one. The reader checks every record, of which a
member may hold several; where a check fails it looks for the next member (or,
in plain archives and within a member, for the next version line), goes on from
there, and logs the bytes between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_PARTITIONS, col, materialise, new_path

VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
#: Fixed value: the standard's name for revisits of an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
#: An archive is closed once it is so large.
ARCHIVE_BYTES = 64 << 20
BLOCK, CHUNK = 1 << 20, 1 << 16
#: A record is given up, and its bytes are a gap, once its headers or its content exceed this.
MAX_HEADER, MAX_CONTENT = 1 << 20, 1 << 31
_URN = "urn:x-page:"


def digest(payload: bytes) -> str:
    """Base32 of the SHA-1, in upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(path: str, mode: str) -> BinaryIO:
    if path.startswith("file:"):
        path = "/" + unquote(path[5:]).lstrip("/")
    if "://" not in path:
        return open(path, mode)
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_output_stream(name) if "w" in mode else store.open_input_stream(name)


# --- records --------------------------------------------------------------


def _value(text: str) -> str:
    """A header's value: control characters, which would end it, and percent signs as percent codes."""
    return quote(text, safe="".join(chr(c) for c in range(32, 127) if chr(c) != "%"), errors="surrogatepass")


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = [VERSION.decode(), f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in headers.items()], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page: str, url: str | None, payload: bytes, payload_digest: str, refers_to: str | None) -> bytes:
    """A response with its payload, or a revisit with the response's headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    headers = {
        "WARC-Record-ID": f"<{_URN}{page}>", "WARC-Date": DATE, "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{payload_digest}", "WARC-Block-Digest": f"sha1:{digest(block)}",
    }
    if url is not None:
        headers["WARC-Target-URI"] = _value(url)
    if refers_to is not None:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{_URN}{refers_to}>"}
    return record("response" if refers_to is None else "revisit", headers, block)


def member(data: bytes) -> bytes:
    """A gzip member of its own, the same bytes in every run."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


# --- the salvaging reader -------------------------------------------------


_VERSION_LINE = re.compile(rb"WARC/1\.")
_MARK = re.compile(rb"\x1f\x8b\x08|WARC/1\.")


class _Bytes:
    """A stream that can be read again from any place not yet let go."""

    def __init__(self, stream: BinaryIO) -> None:
        self.stream, self.base, self.held, self.over = stream, 0, bytearray(), False

    def need(self, end: int) -> bool:
        """Hold the bytes up to the absolute place ``end``; false if there are fewer."""
        while not self.over and self.base + len(self.held) < end:
            more = self.stream.read(BLOCK)
            if more:
                self.held += more
            else:
                self.over = True
        return self.base + len(self.held) >= end

    def cut(self, begin: int, end: int) -> bytes:
        return bytes(self.held[begin - self.base : end - self.base])

    def drop(self, before: int) -> None:
        if before > self.base:
            del self.held[: before - self.base]
            self.base = before

    def find(self, what: bytes, begin: int, limit: int) -> int:
        """The first place from ``begin`` of ``what``, which ends by ``limit``; or -1."""
        while True:
            at = self.held.find(what, begin - self.base, limit - self.base)
            if at >= 0:
                return self.base + at
            end = self.base + len(self.held)
            begin = max(begin, end - len(what) + 1)
            if end >= limit or not self.need(end + 1):
                return -1

    def mark(self, pattern: re.Pattern, begin: int) -> int:
        """The first place from ``begin`` of a mark of seven bytes at most, or -1; what lies before it is let go."""
        while True:
            found = pattern.search(self.held, begin - self.base) if begin >= self.base else None
            if found:
                at = self.base + found.start()
                self.drop(at)
                return at
            end = self.base + len(self.held)
            begin = max(begin, end - 6)
            self.drop(min(begin, end))
            if not self.need(end + 1):
                return -1

    def end(self) -> int:
        while self.need(self.base + len(self.held) + 1):
            self.drop(self.base + len(self.held))
        return self.base + len(self.held)


class _Inflated:
    """What the gzip member at ``at`` holds, as a stream; ``fault`` tells why it ended before the member did."""

    def __init__(self, source: _Bytes, at: int) -> None:
        self.source, self.at, self.z, self.fault = source, at, zlib.decompressobj(31), ""
        self.chunk = at  # where the compressed bytes being inflated begin

    def read(self, size: int) -> bytes:
        while not self.z.eof and not self.fault:
            part = self.z.unconsumed_tail
            if not part:
                if not self.source.need(self.at + 1):
                    self.fault = "the member ends early"
                    break
                self.chunk = self.at
                part = self.source.cut(self.at, self.at + CHUNK)
                self.at += len(part)
            try:
                got = self.z.decompress(part, size)
            except zlib.error as e:
                self.fault = str(e)
                break
            if self.z.eof:
                self.at -= len(self.z.unused_data)
            if got:
                return got
        return b""


def _parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a whole record; ValueError if a check fails."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/1."):
        raise ValueError("no version line")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise ValueError("a header without a colon")
        headers[name.strip().lower()] = value.strip()
    size = headers.get("content-length", "")
    if not size.isdecimal() or rest[int(size) :] != b"\r\n\r\n":
        raise ValueError("the length is wrong")
    block = rest[: int(size)]
    told = headers.get("warc-block-digest", "")
    if told.startswith("sha1:") and told[5:] != digest(block):
        raise ValueError("the digest is wrong")
    return headers, block


def _one(source: _Bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record at a version line, and the place after it; ValueError if it isn't sound."""
    if not source.need(at + 7) or source.cut(at, at + 7) != b"WARC/1.":
        raise ValueError("no version line")
    head = source.find(b"\r\n\r\n", at, at + MAX_HEADER)
    if head < 0:
        raise ValueError("the headers do not end")
    sizes = [x[15:].strip() for x in source.cut(at, head).lower().split(b"\r\n") if x.startswith(b"content-length:")]
    if len(sizes) != 1 or not sizes[0].isdigit() or int(sizes[0]) > MAX_CONTENT:
        raise ValueError("the length is wrong")
    end = head + 8 + int(sizes[0])
    if not source.need(end):
        raise ValueError("the record ends early")
    return *_parse(source.cut(at, end)), end


class _Member:
    """The records of the gzip member at ``begin``; where it fails, ``resume`` is a place before which nothing is lost."""

    def __init__(self, source: _Bytes, begin: int) -> None:
        self.source, self.begin, self.resume, self.end, self.bad = source, begin, begin, begin, ""

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """Each record is given out once the next one, or the member's end, has proved sound; ValueError where the member isn't."""
        stream = _Inflated(self.source, self.begin)
        inner, at, pending, place, n = _Bytes(stream), 0, None, self.begin, 0
        while at >= 0 and inner.need(at + 1):
            try:
                headers, block, end = _one(inner, at)
            except ValueError as e:
                self.bad = self.bad or str(e)
                at = inner.mark(_VERSION_LINE, at + 1)
                continue
            if pending:
                yield pending
                self.resume = place
                self.source.drop(place)
            pending, place, at, n = (headers, block), stream.chunk, end, n + 1
            inner.drop(end)
        if stream.fault:
            raise ValueError(stream.fault)
        self.end = stream.at
        if pending:
            yield pending
        if not n:
            self.bad = self.bad or "no version line"


def salvage(stream: BinaryIO) -> Iterator[tuple]:
    """("record", offset, headers, block) for each sound record and ("gap", begin, end, reason) for bytes that aren't.

    A record's offset is that of its gzip member, if it has one. Memory holds one
    record, as stored and as inflated, beside some blocks.
    """
    source, at, lost, reason = _Bytes(stream), 0, None, ""
    while at >= 0 and source.need(at + 1):
        zipped = source.need(at + 3) and source.cut(at, at + 3) == MAGIC
        member = _Member(source, at)
        try:
            if zipped:
                found = member.records()
            else:
                headers, block, member.end = _one(source, at)
                found = iter([(headers, block)])
            for headers, block in found:
                if lost is not None:
                    yield "gap", lost, at, reason
                    lost = None
                yield "record", at, headers, block
        except ValueError as e:
            if lost is None:
                lost, reason = member.resume, str(e)
            at = source.mark(_MARK, member.resume + 1)
            continue
        if member.bad and lost is None:
            lost, reason = at, member.bad
        at = member.end
        source.drop(at)
    if lost is not None:
        yield "gap", lost, source.end(), reason


def payload_of(headers: dict[str, str], block: bytes) -> tuple[int, str | None]:
    """(bytes, digest) of a page's full payload. Of a response they are measured, of a revisit told by its headers."""
    head, _, body = block.partition(b"\r\n\r\n")
    if headers.get("warc-type") == "response":
        return len(body), digest(body)
    sizes = [x[15:].strip() for x in head.lower().split(b"\r\n") if x.startswith(b"content-length:")]
    told = headers.get("warc-payload-digest", "")
    return int(sizes[0]) if sizes and sizes[0].isdigit() else 0, told.removeprefix("sha1:") or None


# --- in Spark -------------------------------------------------------------


def write_archives(
    pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    least: int = 0, archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record for every row below ``path`` (in the shared folder); returns ``archive``, ``records``, ``bytes`` of each file.

    Of rows with equal payloads of at least ``least`` bytes, that with the
    largest id is a response, and so are rows that repeat its id; the others
    are revisits of it. A null id is below all others. A null payload is empty; a null url leaves
    its header out. An empty table writes nothing. The list of archives is itself written
    to the shared folder: a task that ran twice leaves a file that isn't listed.
    """
    where = path or new_path(pages.sparkSession, "warc")
    payload = F.coalesce(col(payload_col).cast("string"), F.lit(""))
    source = pages.select(col(id_col).cast("string").alias("id"), col(id_col).alias("order"), col(url_col).cast("string").alias("url"), payload.alias("payload"))
    raw = F.col("payload").cast("binary")
    # Equal lengths, SHA-1 and SHA-256: payloads made to collide under SHA-1 alone are told apart.
    hashed = source.withColumn("sha", F.concat(F.unhex(F.sha1(raw)), F.unhex(F.sha2(raw, 256)), F.unhex(F.lpad(F.hex(F.octet_length("payload").cast("long")), 16, "0"))))
    counted = hashed.filter(F.octet_length("payload") >= F.lit(least)).groupBy("sha").agg(F.max("order").alias("top"), F.count("*").alias("n"))
    # Written, so that the join deals out rows anew and may split those of a common payload among tasks.
    first = materialise(counted.filter("n > 1").select("sha", F.col("top").cast("string").alias("first")), "firsts")
    joined = hashed.join(first, "sha", "left").select(
        "id", "url", "payload", F.when(F.col("first") != F.coalesce("id", F.lit("null")), F.col("first")).alias("refers_to")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, n, size = None, "", 0, 0
        done = []
        for b in batches:
            for i, url, payload, refers in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
                if out is None:
                    name, n, size = f"{where}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = _open_new(name)
                    size += out.write(member(record("warcinfo", {"WARC-Record-ID": f"<{uuid.uuid4().urn}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}, b"software: loomframe\r\n")))
                raw = payload.encode("utf-8", "surrogatepass")
                size += out.write(member(page_record("null" if i is None else i, url, raw, digest(raw), refers)))
                n += 1
                if size >= archive_bytes:
                    out.close()
                    done.append((name, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n, size))
        if done:
            a, n, s = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(n, pa.int64()), pa.array(s, pa.int64())], names=["archive", "records", "bytes"])

    return materialise(joined.mapInArrow(write, "archive string, records long, bytes long"), "archives")


def _open_new(name: str) -> BinaryIO:
    import os

    if name.startswith("file:"):
        os.makedirs(os.path.dirname("/" + unquote(name[5:]).lstrip("/")), exist_ok=True)
    elif "://" not in name:
        os.makedirs(os.path.dirname(name), exist_ok=True)
    return _open(name, "wb")


def read_archives(archives: DataFrame, path_col: str = "archive", payloads: bool = False) -> DataFrame:
    """All records of the archives named in ``path_col``, gaps included.

    ``entry`` is ``record`` or ``gap``; a record has ``offset``, ``type``,
    ``record_id``, ``target_uri``, ``payload_bytes``, ``payload_digest``,
    ``refers_to`` and, on demand, ``payload``; a gap has ``offset``, ``end`` and
    ``reason``. An archive is streamed: memory holds one record at a time. An empty file has no rows,
    a null path is skipped, and a path that comes twice is read twice. Other columns are ignored
    whatever their names. Every archive is a task of its own, up to MOST_PARTITIONS tasks.
    """
    columns = "archive string, entry string, offset long, end long, reason string, type string, record_id string, target_uri string, payload_bytes long, payload_digest string, refers_to string, payload binary"
    schema = pa.schema(
        [("archive", pa.string()), ("entry", pa.string()), ("offset", pa.int64()), ("end", pa.int64()), ("reason", pa.string()), ("type", pa.string()), ("record_id", pa.string()),
         ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, held = [], 0
                with _open(name, "rb") as stream:
                    for entry, at, *rest in salvage(stream):
                        if entry == "gap":
                            rows.append((name, entry, at, *rest, *[None] * 7))
                        else:
                            headers, block = rest
                            size, sha = payload_of(headers, block)
                            kind, refers, uri = headers.get("warc-type"), headers.get("warc-refers-to"), headers.get("warc-target-uri")
                            body = block.partition(b"\r\n\r\n")[2] if payloads else None
                            held += len(body or b"")
                            rows.append((name, entry, at, None, None, kind, headers.get("warc-record-id"), None if uri is None else unquote(uri), size, sha, refers, body))
                        if len(rows) >= 1000 or held >= 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    paths = archives.select(col(path_col).cast("string").alias("path")).dropna()
    # By range of the names themselves, and with a number of its own: the list is dealt evenly, and never merged however short it is.
    dealt = paths.repartitionByRange(max(1, min(paths.count(), MOST_PARTITIONS)), "path")
    return dealt.mapInArrow(run, columns)


def page_id_of(record_id):
    """The page's id as a string in a record id or a reference to one; null for the id ``null`` and for other records."""
    found = F.regexp_extract(record_id, f"^<{_URN}(.*)>$", 1)
    return F.when((found != "") & (found != "null"), found)
