"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on shared runs of ``SEED`` words. Each pair that shares some is tiled by running
Karp-Rabin: rolling hashes give every run of the present search length on both sides, runs with equal hashes are joined, verified and
followed to their ends, and the longest matches whose words are all unmarked become tiles, marked on both sides. The
search length goes up to the longest match while that is more than twice as long, then down to ``SEED``; matches are looked for again among
unmarked words each time. An item leaks into a document if tiles cover at least ``COVERAGE`` of the item's words, in
whatever order its passages stand.

The benchmark is the query set: it is read in blocks of about ``BLOCK_CHARS`` characters, each of which goes
to the executors and meets all documents; documents are read once a block and never shuffled.

Defined results: an item of fewer than ``SEED`` words must occur as a whole run; items and documents without words
match nothing. Null ids are kept as they are; repeated documents or items give repeated pairs. Empty
tables give no pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import textvec
from .shared import by_bytes

SEED, COVERAGE, SEARCH, BLOCK_CHARS, BUCKETS = 5, 0.5, 20, 8_000_000, 64
_FILTER_BITS = 20


class _Side:
    """One side of a pair: its words, which of them are unmarked, and what gives the hash of any run of words at once."""

    def __init__(self, words: np.ndarray) -> None:
        power, inverse = textvec.powers(len(words) + 1)
        self.words, self.inverse = words, inverse
        self.free = np.ones(len(words), bool)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * power[: len(words)], out=self.sums[1:])

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of ``n`` unmarked words begin, and their hashes."""
        marked = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero(marked[n:] == marked[:-n])
        return at, (self.sums[at + n] - self.sums[at]) * self.inverse[at]


def scan(item: _Side, doc: _Side, n: int) -> list[tuple[int, int, int]]:
    """Matches (length, place in item, place in doc) of at least ``n`` unmarked words, each followed to its ends."""
    (i, hi), (j, hj) = item.runs(n), doc.runs(n)
    order = np.argsort(hi, kind="stable")
    i, hi = i[order], hi[order]
    left, right = np.searchsorted(hi, hj, "left"), np.searchsorted(hi, hj, "right")
    m = right - left
    if not m.sum():
        return []
    a = i[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(left, m)]
    b = np.repeat(j, m)
    order = np.lexsort((a, b - a))  # matches of n words that follow each other on a diagonal are one longer match
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (np.diff(b - a) != 0) | (np.diff(a) != 1)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(a))) + n - 1
    return [(k, x, y) for k, x, y in zip(length.tolist(), a[first].tolist(), b[first].tolist(), strict=True) if (item.words[x : x + k] == doc.words[y : y + k]).all()]


def tiles(item_words: np.ndarray, doc_words: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The greedy tiling of a pair: (length, place in item, place in doc), no word in two tiles, each of ``least`` words or more.

    Of matches of one length that overlap, the one that comes first in the item, then in the document, is taken."""
    item, doc = _Side(item_words), _Side(doc_words)
    chosen: list[tuple[int, int, int]] = []
    n = max(least, min(SEARCH, len(item_words)))
    while True:
        found = scan(item, doc, n)
        longest = max((k for k, _, _ in found), default=0)
        if longest > 2 * n:
            n = longest
            continue
        chosen += _marked(item, doc, found, n)
        if n == least:
            return chosen
        n = max(least, n // 2)


def _marked(item: _Side, doc: _Side, found: list[tuple[int, int, int]], n: int) -> Iterator[tuple[int, int, int]]:
    """Mark matches, longest first; of one that has lost words to a tile, parts of ``n`` words and more take their turn again."""
    waiting = [(-k, x, y) for k, x, y in found]
    heapq.heapify(waiting)
    while waiting:
        k, x, y = heapq.heappop(waiting)
        free = item.free[x : x - k] & doc.free[y : y - k]
        if free.all():
            item.free[x : x - k] = doc.free[y : y - k] = False
            yield -k, x, y
            continue
        edge = np.flatnonzero(np.diff(free.astype(np.int8), prepend=0, append=0))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= n:
                heapq.heappush(waiting, (a - b, x + a, y + a))


@dataclass
class Block:
    """Some benchmark items as word hashes, with their seeds sorted by hash; one table of seeds for each seed length."""

    ids: list
    times: list[int]
    words: list[np.ndarray]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list[tuple]) -> Block:
        """From (id, text, how often)."""
        w, at = textvec.words([t for _, t, _ in rows])
        items = [w[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        by: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, x in enumerate(items):
            if len(x):
                n = min(SEED, len(x))
                by.setdefault(n, []).append((textvec.shingle_hashes(x, n), k))
        seeds = {}
        for n, hs in by.items():
            h = np.concatenate([x for x, _ in hs])
            item = np.concatenate([np.full(len(x), k) for x, k in hs])
            place = np.concatenate([np.arange(len(x)) for x, _ in hs])
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[h >> np.uint64(64 - _FILTER_BITS)] = True
            seeds[n] = (h[order], item[order], place[order], bits)
        return cls([i for i, _, _ in rows], [n for _, _, n in rows], items, seeds)

    def matches(self, texts: list[str | None], coverage: float) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, words covered, tiles, longest tile) of all pairs with enough coverage."""
        w, at = textvec.words(texts)
        for n, (hashes, item, place, bits) in self.seeds.items():
            h = textvec.shingle_hashes(w, n)
            pos = np.flatnonzero(bits[h >> np.uint64(64 - _FILTER_BITS)])
            h = h[pos]
            left, right = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            text = np.searchsorted(at, pos, "right") - 1
            ok = (right > left) & (pos + n <= at[text + 1])
            pos, left, right, text = pos[ok], left[ok], right[ok], text[ok]
            for t in np.unique(text).tolist():
                a, b = np.searchsorted(text, t, "left"), np.searchsorted(text, t, "right")
                yield from self._tiled(t, n, w[at[t] : at[t + 1]], pos[a:b] - at[t], left[a:b], right[a:b], item, place, coverage)

    def _tiled(self, t: int, n: int, doc: np.ndarray, pos: np.ndarray, left: np.ndarray, right: np.ndarray, item: np.ndarray, place: np.ndarray, coverage: float) -> Iterator[tuple[int, int, int, int, int]]:
        m = right - left
        seed_at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(left, m)
        doc_at, items, item_at = np.repeat(pos, m), item[seed_at], place[seed_at]
        order = np.argsort(items, kind="stable")
        edges = np.flatnonzero(np.diff(items[order], prepend=-1))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
            k, own = int(items[order[a]]), order[a:b]
            words = self.words[k]
            touched = np.zeros(len(words) + 1, np.int64)  # no tiling covers more than the seeds touch
            np.add.at(touched, item_at[own], 1)
            np.add.at(touched, item_at[own] + n, -1)
            if np.count_nonzero(np.cumsum(touched)) < coverage * len(words):
                continue
            got = tiles(words, doc, n)
            covered = sum(x[0] for x in got)
            if covered >= coverage * len(words):
                yield t, k, covered, len(got), max(x[0] for x in got)


def blocks(bench: DataFrame) -> Iterator[Block]:
    """The benchmark in blocks of about ``BLOCK_CHARS``: items are hashed to many more buckets than blocks, whose sizes are
    known before any text is read, and neighbouring buckets are taken together up to that bound. Rows that repeat an item are one, with
    their number; an item that is larger than a block is a block of its own."""
    once = bench.groupBy("item_id", "text").agg(F.count("*").cast("long").alias("times"))
    sized = once.select("item_id", "text", "times", (F.coalesce(F.length("text"), F.lit(0)) + 1).cast("long").alias("n"))
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    many = BUCKETS * (1 + total // BLOCK_CHARS)
    hashed = sized.withColumn("bucket", F.pmod(F.xxhash64("item_id", "text"), F.lit(many)))
    sizes = sorted((r["bucket"], r["n"]) for r in hashed.groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    while sizes:
        first, n = sizes.pop(0)
        last = first
        while sizes and n + sizes[0][1] <= BLOCK_CHARS:
            last, more = sizes.pop(0)
            n += more
        some = hashed.where(F.col("bucket").between(first, last)).collect()
        yield Block.of(sorted(((r["item_id"], r["text"], r["times"]) for r in some), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")))


def leaks(docs: DataFrame, bench: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_words, n_covered, n_tiles, longest, coverage) of each pair that leaks."""
    doc_type, item_type = docs.schema["doc_id"].dataType, bench.schema["item_id"].dataType
    item_arrow = to_arrow_type(item_type)
    names = ("n_words", "n_covered", "n_tiles", "longest")
    schema = T.StructType([T.StructField("doc_id", doc_type), T.StructField("item_id", item_type), *(T.StructField(n, T.LongType()) for n in names), T.StructField("coverage", T.DoubleType())])
    out = None
    for block in blocks(bench):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in by_bytes(batches, 1):
                x = held.value
                rows = [r for r in x.matches(b.column(1).to_pylist(), coverage) for _ in range(x.times[r[1]])]
                n = [len(x.words[k]) for _, k, *_ in rows]
                numbers = [pa.array(c, pa.int64()) for c in ([*n], [r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows])]
                share = pa.array([r[2] / m for r, m in zip(rows, n, strict=True)], pa.float64())
                ids = b.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                items = pa.array([x.ids[r[1]] for r in rows], item_arrow)
                yield pa.RecordBatch.from_arrays([ids, items, *numbers, share], names=schema.names)

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, bench: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents into which no item leaks, with all their columns."""
    at = docs.columns.index("text")
    for block in blocks(bench):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in by_bytes(batches, at):
                keep = np.ones(b.num_rows, bool)
                for t, *_ in held.value.matches(b.column(at).to_pylist(), coverage):
                    keep[t] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
