"""XML dumps of publications as a splittable source.

A dump is cut into byte ranges. The reader of a range looks for the first record that opens in it and reads every record that does, the last one to
its end even where that lies in the next range; so each record is read once, whatever the ranges. Its named entities become
characters before it is parsed, as XML knows only five of them, and nothing is written in between. A gzip dump can't be cut: it is one range.

Tags are found in bytes, which holds for every encoding that has ASCII in it; a ``<`` in text is ``&lt;`` in XML, so what looks like
a record's tag is one (comments and CDATA sections aside, which such dumps don't have).
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.entities import name2codepoint
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The kinds of record that are publications, and what names each kind's venue.
KINDS = ("article", "inproceedings", "proceedings", "book", "incollection", "phdthesis", "mastersthesis")
VENUES = {"article": "journal", "inproceedings": "booktitle", "incollection": "booktitle", "proceedings": "booktitle", "book": "publisher", "phdthesis": "school", "mastersthesis": "school"}
SCHEMA = "ordinal long, key string, title string, authors array<string>, editors array<string>, year int, venue string, ee string, kind string, volume string, number string, pages string"
SPLIT_BYTES, CHUNK, BATCH = 64 << 20, 1 << 20, 1000

_ENTITY = re.compile(r"&([A-Za-z][A-Za-z0-9]*);")
_BUILT_IN = {"amp", "lt", "gt", "quot", "apos"}
_OPENS = re.compile(rf"<({'|'.join(KINDS)})(?=[\s>/])".encode())
_TAG = 64  # bytes in which the name of a record's tag ends
_ARROW = pa.schema([
    ("ordinal", pa.int64()), ("key", pa.string()), ("title", pa.string()), ("authors", pa.list_(pa.string())), ("editors", pa.list_(pa.string())), ("year", pa.int32()),
    *((c, pa.string()) for c in ("venue", "ee", "kind", "volume", "number", "pages")),
])


def resolve(text: str) -> str:
    """Named entities as numeric ones; those of XML itself and unknown ones stay."""
    return _ENTITY.sub(lambda m: m[0] if m[1] in _BUILT_IN or m[1] not in name2codepoint else f"&#{name2codepoint[m[1]]};", text)


def record(raw: bytes, encoding: str, ordinal: int) -> tuple:
    """A record's bytes as a row of ``SCHEMA``; entities that nobody knows stay as they are written."""
    text = _ENTITY.sub(lambda m: m[0] if m[1] in _BUILT_IN else f"&amp;{m[1]};", resolve(raw.decode(encoding)))
    e = ElementTree.fromstring(text)

    def all_of(tag: str) -> list[str]:
        return [t for t in (" ".join("".join(x.itertext()).split()) for x in e.iterfind(tag)) if t]

    def one(tag: str) -> str | None:
        return next(iter(all_of(tag)), None)

    year = one("year")
    return (ordinal, e.get("key"), one("title"), all_of("author"), all_of("editor"), int(year) if year and year.isdecimal() else None, one(VENUES[e.tag]), one("ee"), e.tag, one("volume"), one("number"), one("pages"))


def records_between(source, start: int, end: int | None) -> Iterator[tuple[int, bytes]]:  # noqa: ANN001
    """(place, bytes) of every record that opens at ``start`` or behind it and before ``end``; ``source`` is read from ``start`` on."""
    held, at, done = b"", start, False  # what is held begins at byte ``at``
    while True:
        m = _OPENS.search(held)
        if m is None or (not done and len(held) - m.start() < _TAG):
            if done and m is None:
                return
            if not done:
                keep = m.start() if m else max(0, len(held) - _TAG)
                held, at = held[keep:], at + keep
                if end is not None and at >= end:
                    return
                more = source.read(CHUNK)
                done = not more
                held += more
                continue
        opened = m.start()
        if end is not None and at + opened >= end:
            return
        close, looked = b"</" + m[1] + b">", m.end()
        while True:
            bracket = held.find(b">", m.end())
            if bracket > 0 and held[bracket - 1 : bracket] == b"/":
                stop = bracket + 1
                break
            found = held.find(close, looked)
            if found >= 0:
                stop = found + len(close)
                break
            looked = max(m.end(), len(held) - len(close))
            more = source.read(CHUNK)
            if not more:
                raise ValueError(f"the record at byte {at + opened} has no end")
            held += more
        yield at + opened, held[opened:stop]
        held, at = held[stop:], at + stop


@dataclass
class Range(InputPartition):
    """Bytes of a file; ``file`` numbers the files, so that places in the dump can be compared."""

    path: str
    file: int
    start: int
    end: int | None
    encoding: str
    packed: bool


def _opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    local = path.removeprefix("file://").removeprefix("file:") if path.startswith("file:") else path
    return (arrow_fs.LocalFileSystem(), local) if "://" not in local else arrow_fs.FileSystem.from_uri(local)


class Reader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        store, at = _opened(self.path)
        info = store.get_file_info(at)
        if info.type == arrow_fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else [f for f in store.get_file_info(arrow_fs.FileSelector(at)) if f.is_file and not f.base_name.startswith((".", "_"))]
        prefix = self.path.split("://", 1)[0] + "://" if "://" in self.path and not self.path.startswith("file:") else ""
        out = []
        for k, f in enumerate(sorted(files, key=lambda f: f.path)):
            with store.open_input_file(f.path) as src:
                head = src.read(512)
            packed = head[:2] == b"\x1f\x8b"
            if packed:
                with store.open_input_file(f.path) as src, gzip.GzipFile(fileobj=src) as plain:
                    head = plain.read(512)
            said = re.search(rb"encoding=[\"']([A-Za-z0-9._-]+)", head)
            encoding = said[1].decode() if said else "UTF-8"
            step = f.size if packed else self.split
            for start in range(0, max(f.size, 1), max(step, 1)):
                out.append(Range(prefix + f.path, k, start, None if packed else min(start + step, f.size), encoding, packed))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, at = _opened(partition.path)
        with store.open_input_file(at) as src:
            src.seek(partition.start)
            source = gzip.GzipFile(fileobj=src) if partition.packed else src
            rows: list[tuple] = []
            for place, raw in records_between(source, partition.start, partition.end):
                rows.append(record(raw, partition.encoding, (partition.file << 44) + place))
                if len(rows) == BATCH:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


class DumpSource(DataSource):
    """``spark.read.format("publication_dump").load(path)``; option ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "publication_dump"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:  # noqa: ANN001
        return Reader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


def records(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, limit: int | None = None) -> DataFrame:
    """``SCHEMA`` of all publications of a dump (a file or a folder of them, plain or gzip); home pages and other records are not read.
    ``ordinal`` follows the dump. ``limit``: the first so many."""
    spark.dataSource.register(DumpSource)
    df = spark.read.format("publication_dump").option("splitBytes", split_bytes).load(path).where("key is not null")
    return df if limit is None else df.orderBy("ordinal").limit(limit)


def newest_month(year: int, month: int, back: int = 6) -> list[tuple[int, int]]:
    """The months whose snapshot to try, newest first."""
    n = 12 * year + month - 1
    return [((n - k) // 12, (n - k) % 12 + 1) for k in range(back + 1)]


def accepted(head: bytes, digest: str, expected: str) -> bool:
    """The gate of a download: gzip magic, and the published MD5."""
    return head[:2] == b"\x1f\x8b" and digest.lower() == expected.strip().split()[0].lower()
