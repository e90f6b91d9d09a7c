"""WARC as a chunked record table.

A record is rows of (record_id, chunk_no): row 0 begins with the record's head, a payload of more than ``CHUNK`` bytes goes
on in further rows, and every row carries the SHA-256 of the payload up to its end, from one running digest. The
rows' bytes, one record after another, are a WARC 1.1 stream: ``export`` writes it as a file (each record a gzip
member), ``parse`` turns a file into such rows again, and neither holds more of a record than one chunk. The table
itself is written by Spark, so any store can hold it and a lost task is run again.

Of records with equal payloads of at least ``LEAST_REVISIT`` bytes, the one with the least page id is the response and
the others are revisits without payload. Readers check heads, lengths and digests. Records of one row are
checked where they are; only the rows of longer ones are brought together, in order of their numbers.

Defined results: a null payload is empty; a null URL is written as ``about:blank``; rows that repeat the least page
id are all responses; a row with a null page id is a revisit if some page with an id has its payload, else a
response. Every row has a record id of its own, whatever repeats. An empty table gives an empty archive.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, small, stored

CHUNK, LEAST_REVISIT, HOT, FLUSH = 64 * 1024, 100, 100_000, 4_000_000
DATE = "1970-01-01T00:00:00Z"
#: The version line, and the profile of a revisit.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = re.compile(r"[\x00-\x20\x7f]")


class Damaged(ValueError):
    """A record whose head, length or digest is wrong."""


def record_id(name: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}"


def head(page: int | None, row: int | str | None, url: str | None, digest: str, length: int, refers_to: int | None) -> tuple[str, bytes]:
    """The id of a record and its bytes up to the payload; ``row`` tells it from others of its page and payload, but for the first."""
    name = record_id(f"page/{page}/{digest}" if row is None else f"page/{page}/{digest}/{row}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_SPACE.sub(lambda m: f'%{ord(m[0]):02X}', url) if url else 'about:blank'}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (length if refers_to is None else 0)}",
    ]
    if page is not None:
        lines.append(f"X-Page-ID: {page}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(f'page/{refers_to}/{digest}')}>", f"X-Refers-To-Page: {refers_to}"]
    return name, VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _planned(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to, row): which page each one repeats, null for responses; and a number for rows
    that repeat both a page id and its payload, null for the first of them."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    hashed = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("bytes"))
    groups = hashed.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    groups = stored(groups, "repeated-payloads")
    # payloads of very many pages are few and go to all where they fit; the others are joined by their digest
    often = stored(groups.where(F.col("n") > HOT).select("digest", F.col("first").alias("first_often")), "frequent-payloads")
    rarely = stored(groups.where(F.col("n") <= HOT).select("digest", F.col("first").alias("first_rarely")), "other-payloads")
    joined = hashed.join(small(often), "digest", "left").join(small(rarely), "digest", "left").withColumn("first", F.coalesce("first_often", "first_rarely"))
    planned = joined.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    repeats = hashed.where("page_id is not null").groupBy("page_id", "digest").agg(F.count("*").alias("n")).where("n > 1").select("page_id", "digest")
    repeats = stored(repeats, "repeated-rows")
    if repeats.isEmpty():
        return planned.withColumn("row", F.lit(None).cast("long"))
    repeats = small(repeats)
    once = planned.join(repeats, ["page_id", "digest"], "left_anti").withColumn("row", F.lit(None).cast("long"))
    again = stored(planned.join(repeats, ["page_id", "digest"], "left_semi").withColumn("row", F.monotonically_increasing_id()), "numbered-rows")
    first = again.groupBy("page_id", "digest").agg(F.min("row").alias("least"))
    again = again.join(small(stored(first, "first-rows")), ["page_id", "digest"]).withColumn("row", F.when(F.col("row") != F.col("least"), F.col("row")))
    return once.unionByName(again.drop("least")).select(*planned.columns, "row")


def _in_parts(planned: DataFrame) -> DataFrame:
    """(page_id, url, digest, refers_to, row, length, k, last, part): payloads in pieces of ``CHUNK`` bytes, cut before Python sees them,
    one record's after another; a revisit has one empty piece."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    cut = lambda p: F.transform(
        F.sequence(F.lit(0), F.when(F.col("refers_to").isNull(), F.greatest(F.ceil(F.octet_length(p) / CHUNK), F.lit(1)) - 1).otherwise(0).cast("int")),
        lambda k: F.struct(k.alias("k"), F.octet_length(p).alias("length"), F.when(F.col("refers_to").isNull(), F.substring(p, k * CHUNK + 1, F.lit(CHUNK))).alias("part")),
    )
    pieces = F.get(F.transform(F.array(payload), cut), F.lit(0))  # bound, so that the text is encoded once and not for each piece
    each = planned.select("page_id", "url", "digest", "refers_to", "row", F.explode(pieces).alias("x"))
    last = F.col("refers_to").isNotNull() | ((F.col("x.k") + 1) * CHUNK >= F.col("x.length"))
    return each.select("page_id", "url", "digest", "refers_to", "row", "x.length", "x.k", last.alias("last"), F.coalesce("x.part", F.lit(b"")).alias("part"))


def archive(pages: DataFrame) -> DataFrame:
    """(record_id, chunk_no, last, data, digest) of a record for each page; the kernel holds one chunk of a payload at a time."""
    names = ["record_id", "chunk_no", "last", "data", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, task = 0, TaskContext.get().partitionId()
        name, running = "", hashlib.sha256()
        out: list[tuple] = []
        size = 0
        for b in batches:
            rest = zip(*(b.column(i).to_pylist() for i in range(8)), strict=True)
            for i, (page, url, digest, first, row, length, k, last) in enumerate(rest):
                data = b.column(8)[i].as_py()
                start = b""
                if k == 0:
                    seen += 1
                    name, start = head(page, f"{task}/{seen}" if page is None else row, url, digest, length, first)
                    running = hashlib.sha256()
                running.update(data)
                so_far = running.hexdigest() if first is None else digest
                out.append((name, k, last, start + data + (b"\r\n\r\n" if last else b""), so_far))
                size += len(out[-1][3])
                if size > FLUSH:
                    yield _batch(out, names)
                    out, size = [], 0
        if out:
            yield _batch(out, names)

    return _in_parts(_planned(pages)).mapInArrow(run, "record_id string, chunk_no long, last boolean, data binary, digest string")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def write(pages: DataFrame, path: str) -> None:
    archive(pages).write.parquet(path)


def _fields(data: bytes) -> tuple[dict[str, str], int]:
    """The named fields of a record's head, and where its block begins."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(VERSION + b"\r\n") or end < 0:
        raise Damaged("no WARC head")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in data[len(VERSION) + 2 : end].decode().split("\r\n"))}, end + 4


def _payload_at(data: bytes, block: int) -> tuple[int, int]:
    """Where the payload begins, behind the block's HTTP head, and the length that this head gives."""
    end = data.find(b"\r\n\r\n", block)
    found = re.search(rb"(?i)\r\ncontent-length: *(\d+)", data[block:end])
    if end < 0 or not found:
        raise Damaged("no HTTP head")
    return end + 4, int(found[1])


def _row(fields: dict[str, str], length: int) -> tuple:
    page, first = fields.get("x-page-id"), fields.get("x-refers-to-page")
    return int(page) if page is not None else None, length, fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"], int(first) if first is not None else None


def _checked(rows: Iterator[tuple[str, int, bool, bytes, str]]) -> Iterator[tuple]:
    """One row for each record, from the rows of records one after another; one chunk is held at a time."""
    digest, fields, length, got = hashlib.sha256(), None, 0, 0
    for name, k, last, data, so_far in rows:
        at = 0
        if k == 0:
            if fields is not None:
                raise Damaged(f"a record before {name} has no end")
            fields, block = _fields(data)
            at, length = _payload_at(data, block)
            digest, got = hashlib.sha256(), 0
            if int(fields["content-length"]) != at - block + (length if fields["warc-type"] != "revisit" else 0):
                raise Damaged(f"{name} has another length")
        elif fields is None:
            raise Damaged(f"{name} has no head")
        part = memoryview(data)[at : len(data) - 4 * last]
        if last and data[-4:] != b"\r\n\r\n":
            raise Damaged(f"{name} has no end")
        digest.update(part)
        got += len(part)
        revisit = fields["warc-type"] == "revisit"
        if not revisit and digest.hexdigest() != so_far:
            raise Damaged(f"{name}, chunk {k}: the digest is wrong")
        if last:
            if not revisit and (got != length or so_far != fields["warc-payload-digest"].removeprefix("sha256:")):
                raise Damaged(f"{name}: the payload is not what its head says")
            yield _row(fields, length)
            fields = None
    if fields is not None:
        raise Damaged("the last record has no end")


def read(spark, path: str) -> DataFrame:  # noqa: ANN001
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record of the archive at ``path``."""
    rows = spark.read.parquet(path)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_by_one = (r for b in batches for r in zip(*(c.to_pylist() if i != 3 else (x.as_py() for x in c) for i, c in enumerate(b.columns)), strict=True))  # data one by one
        held: list[tuple] = []
        for r in _checked(one_by_one):
            held.append(r)
            if len(held) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    single = rows.where("chunk_no = 0 and last")
    longer = rows.where("not (chunk_no = 0 and last)").repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return single.mapInArrow(run, schema).unionAll(longer.mapInArrow(run, schema))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write an archive into the shared folder and read it back."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path)


def export(rows: Iterator[tuple[str, int, bool, bytes, str]], out: BinaryIO, compress: bool = True) -> None:
    """Write rows of the record table, records one after another, as a WARC file; each record is a gzip member."""
    member = None
    for _, k, last, data, _ in rows:
        if not compress:
            out.write(data)
            continue
        if k == 0:
            member = gzip.GzipFile(fileobj=out, mode="wb", mtime=0)
        member.write(data)
        if last:
            member.close()


def parse(file: BinaryIO) -> Iterator[tuple[str, int, bool, bytes, str]]:
    """The rows of a WARC file, plain or gzip, read as a stream; the digest is of the payload so far."""
    start = file.read(2)
    source: BinaryIO = io.BufferedReader(_Joined(start, file))
    if start == b"\x1f\x8b":
        source = gzip.GzipFile(fileobj=source)
    while True:
        line = source.readline()
        while line == b"\r\n":
            line = source.readline()
        if not line:
            return
        if line.rstrip() not in (VERSION, b"WARC/1.0"):
            raise Damaged("no WARC head")
        top = [line]
        while (line := source.readline()) not in (b"\r\n", b""):
            top.append(line)
        top.append(b"\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in top[1:-1])}
        if line == b"" or not fields.keys() >= {"content-length", "warc-record-id"}:
            raise Damaged("the file is cut short, or a head lacks its length")
        left = int(fields["content-length"])
        http = [] if "http" not in fields.get("content-type", "") else top
        while http and left:
            line = source.readline(left)
            left -= len(line)
            top.append(line)
            if line in (b"\r\n", b""):
                break
        digest, k = hashlib.sha256(), 0
        while True:
            part = source.read(min(CHUNK, left))
            if len(part) < min(CHUNK, left):
                raise Damaged("the file is cut short")
            left -= len(part)
            digest.update(part)
            yield fields["warc-record-id"].strip("<>"), k, not left, (b"".join(top) if k == 0 else b"") + part + (b"" if left else b"\r\n\r\n"), digest.hexdigest()
            k += 1
            if not left:
                break


class _Joined(io.RawIOBase):
    """Bytes already read, then the rest of a file."""

    def __init__(self, start: bytes, rest: BinaryIO) -> None:
        self.start, self.rest = start, rest

    def readable(self) -> bool:
        return True

    def readinto(self, into: memoryview) -> int:
        data = self.start[: len(into)] or self.rest.read(len(into))
        self.start = self.start[len(data) :] if self.start else b""
        into[: len(data)] = data
        return len(data)


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
"""
