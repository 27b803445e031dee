"""WARC archives of pages: writing, with revisits of equal payloads, and salvage reading.

Each record is a gzip member of its own. The reader checks every member and record
(compression, version line, header, length, end, block digest), and reads members with
several records as well. After a failed check it searches for the next valid member or
version line, in the file or inside the member, goes on there, and logs the bytes between
as a quarantined gap. Of a member that breaks off, the records before the break are kept.

Defined results: null html is an empty payload; of rows with equal payloads of at least
``min_revisit`` bytes that with the smallest page_id is the response and the others
revisit it; rows that share the smallest page_id, or have none, are responses; rows that
share a page_id are told apart by their payloads; a null url is left out of the header;
pages of any length are one record; an empty table gives no archive and no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, keep, member, membership

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Records of an archive file at most; bounds what a reading task holds.
PER_FILE = 2000
_MAGIC = b"\x1f\x8b\x08"
_LINE = re.compile(rb"WARC/[01]\.\d\r?\n")
_NEXT = re.compile(rb"\nWARC/[01]\.\d\r?\n")
_END = re.compile(rb"\r?\n\r?\n")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes, first=None) -> bytes:
    """A response record, or a revisit of page ``first``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first is None else http
    head = ["WARC-Type: " + ("response" if first is None else "revisit"), f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if first is not None:
        head += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {PROFILE}"]
    head += [
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"Content-Length: {len(block)}",
    ]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Record(NamedTuple):
    """offset, length: the record's bytes in the file, or those of its member for the first one of a
    member (0 for the later ones); inner: its place in the unpacked member."""

    offset: int
    length: int
    headers: dict[str, str]
    block: bytes
    inner: int = 0


class Gap(NamedTuple):
    """length counts bytes of the file, or, with an inner place, of the unpacked member at ``offset``."""

    offset: int
    length: int
    reason: str
    inner: int | None = None


def _parse(data: bytes, at: int) -> tuple[Record, int] | str:
    """The record at ``at`` and where the next begins, or why there is none."""
    line = _LINE.match(data, at)
    if not line:
        return "no version line"
    # no header goes beyond the next version line, so the search for its end is no longer than the way there
    further = _NEXT.search(data, line.end() - 1)
    begin = line.end() - 2 if data[line.end() - 2 : line.end()] == b"\r\n" else line.end() - 1
    end = _END.search(data, begin, further.start() + 1 if further else len(data))
    if not end:
        return "header without end"
    headers = {}
    for x in data[line.end() : end.start()].decode("utf-8", "replace").splitlines():
        k, _, v = x.partition(":")
        headers[k.strip().lower()] = v.strip()
    size = headers.get("content-length", "")
    if not size.isdigit():
        return "no content length"
    stop = end.end() + int(size)
    if stop > len(data):
        return "record cut short"
    tail = re.compile(rb"(\r?\n){2}").match(data, stop)
    if not tail:
        return "record does not end where its length says"
    block = data[end.end() : stop]
    told = headers.get("warc-block-digest", "")
    if told.lower().startswith("sha1:") and told[5:].upper() != digest(block):
        return "block digest differs"
    return Record(at, tail.end() - at, headers, block), tail.end()


_BLOCK = 1 << 16


def _unpack(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the gzip member at ``at`` holds, where it ends, and what is wrong with it. Bytes are fed
    block by block, so a file of many members is read once."""
    z, pos, out, view = zlib.decompressobj(31), at, [], memoryview(data)
    try:
        while not z.eof and pos < len(data):
            out.append(z.decompress(view[pos : pos + _BLOCK]))
            pos = min(len(data), pos + _BLOCK)
    except zlib.error as e:
        return b"".join(out), at, f"member does not decompress: {e}"
    return b"".join(out), pos - len(z.unused_data), "" if z.eof else "member cut short"


def _records(data: bytes) -> Iterator[Record | Gap]:
    """The records of unpacked bytes and the gaps between them; offsets are places in ``data``."""
    at, bad, why = 0, -1, ""
    while at < len(data):
        got = _parse(data, at)
        if isinstance(got, str):
            if bad < 0:
                bad, why = at, got
            m = _LINE.search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        if bad >= 0:
            yield Gap(bad, at - bad, why)
            bad = -1
        yield got[0]
        at = got[1]
    if bad >= 0:
        yield Gap(bad, len(data) - bad, why)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """The valid records of an archive, gzipped or plain, and the gaps between them."""
    at, bad, why = 0, -1, ""
    line = -1  # the next version line, searched for once
    while at < len(data):
        found: list[Record | Gap] = []
        packed = data.startswith(_MAGIC, at)
        if packed:
            plain, nxt, said = _unpack(data, at)
            inside = list(_records(plain))
            some = any(isinstance(r, Record) for r in inside)
            if said or (plain and not some):
                said = said or inside[0].reason
            length = 0 if said else nxt - at
            for r in inside if some else ():
                if isinstance(r, Record):
                    found.append(Record(at, length, r.headers, r.block, r.offset))
                    length = 0
                elif not said:  # a broken member is a gap of the file
                    found.append(Gap(at, r.length, r.reason, r.offset))
        else:
            got = _parse(data, at)
            said, nxt = (got, at) if isinstance(got, str) else ("", got[1])
            if not said:
                found.append(got[0])
        if bad >= 0 and found:
            yield Gap(bad, at - bad, why)
            bad = -1
        yield from found
        if said:
            if bad < 0:
                bad, why = at, said
            if line <= at:
                m = _LINE.search(data, at + 1)
                line = m.start() if m else len(data)
            g = data.find(_MAGIC, at + 1, line)
            at = g if g >= 0 else line
            continue
        if bad >= 0:  # an empty member says that all is well again
            yield Gap(bad, at - bad, why)
            bad = -1
        at = nxt
    if bad >= 0:
        yield Gap(bad, len(data) - bad, why)


def _members(bits=None):
    """(page_id, url, html[, first]) to gzipped records; with bits: of the pages that are not in it."""

    def run(batches):
        for b in batches:
            if bits is not None:
                ids = b.column(0)
                known = member(np.frombuffer(bits.value, np.uint8), ids.fill_null(0).to_numpy(zero_copy_only=False))
                b = b.filter(pa.array(~known))
            firsts = b.column(3).to_pylist() if b.num_columns > 3 else [None] * b.num_rows
            out = []
            for page, url, html, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), firsts):
                payload = (html or "").encode()
                out.append(gzip.compress(record("null" if page is None else page, url, payload, first), 1, mtime=0))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return run


def _only(bits):
    def run(batches):
        for b in batches:
            yield b.filter(pa.array(member(np.frombuffer(bits.value, np.uint8), b.column(0).fill_null(0).to_numpy(zero_copy_only=False))))

    return run


#: An empty gzip member: what Spark's text writer puts between two records, so that a file
#: is a valid sequence of members.
_BETWEEN = gzip.compress(b"", mtime=0).decode("latin-1")


def write_archives(pages: DataFrame, path: str, min_revisit: int = 0, per_file: int = PER_FILE) -> None:
    """A record for every row of ``pages`` (page_id, url, html), in files below ``path``.

    Only rows whose payload occurs twice or more are shuffled; the others are recognised
    by a bitmap of fixed size and written where they are read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    payload = F.coalesce("html", F.lit(""))
    facts = keep(rows.where(F.octet_length(payload) >= min_revisit).select("page_id", F.sha1(payload).alias("digest")), "facts")
    shared = facts.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    again = keep(facts.join(shared, "digest").where("page_id > first").select("page_id", "digest", "first").distinct(), "again")
    bits = pages.sparkSession.sparkContext.broadcast(membership(again, "page_id"))
    single = rows.mapInArrow(_members(bits), "value binary")
    maybe = rows.mapInArrow(_only(bits), rows.schema).withColumn("digest", F.sha1(payload)).join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "first").mapInArrow(_members(), "value binary")
    single.unionByName(maybe).select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", per_file).option("encoding", "ISO-8859-1").option("lineSep", _BETWEEN).text(path)


SALVAGED = "file string, offset long, length long, gap string, record_type string, page_id long, payload_bytes long, payload_digest string, refers_to long, url string"
_PAGE = re.compile(r"<urn:page:(-?\d+)>")


def _read(batches):
    names = [x.split()[0] for x in SALVAGED.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, SALVAGED.split(", "))])
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1)):
            rows = []
            for r in salvage(content.as_py()):
                if isinstance(r, Gap):
                    rows.append((path, r.offset, r.length, r.reason, None, None, None, None, None, None))
                    continue
                h = r.headers
                head, _, payload = r.block.partition(b"\r\n\r\n")
                kind = h.get("warc-type")
                if kind == "revisit":
                    m = re.search(rb"(?im)^content-length:\s*(\d+)", head)
                    size, dig = int(m[1]) if m else None, h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                else:
                    size, dig = len(payload), digest(payload)
                page, to = _PAGE.match(h.get("warc-record-id", "")), _PAGE.match(h.get("warc-refers-to", ""))
                rows.append((path, r.offset, r.length, None, kind, int(page[1]) if page else None, size, dig, int(to[1]) if to else None, h.get("warc-target-uri")))
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 10_000]), schema)], schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record and each quarantined gap (gap: the reason) of the archives below ``path``."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_read, SALVAGED)


def round_trip(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as read back from new archives."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path, min_revisit)
    return read_archives(spark, path).where("gap is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
