"""Substring dedup: paragraphs by MinHash banding, with pieces of paragraphs for passages set into other text.

A paragraph is a line. Those of at least ``LEAST_WORDS`` words, which is all that have a run of five, get MinHash signatures over such
runs, in bands of ``ROWS``; there are as many bands as bring a pair at the threshold together with the target recall (``bands_for``).
Paragraphs that collide in a band are compared by exact Jaccard similarity, and connected components cluster them. A passage may also stand in the
middle of a paragraph, where the paragraph around it differs. So each line is cut where a word's hash is the least
among its ``RADIUS`` neighbours on either side: cuts depend on nearby words only, so the same passage is cut alike
wherever it stands; pieces of equal words form a class.

Where a passage begins and ends, words are compared one by one, whatever its lines: of each ``REACH`` runs of ``ANCHOR``
words that follow each other the one of least hash is an anchor, so that a passage of ``LONG_SPAN`` words has one. Around
anchors that repeat, all runs of ``GRAM`` words are brought together; those that repeat cover the passage to its ends.

Paragraphs, pieces and runs that occur in several documents mark their words as repeated. Marked words that follow each
other are a span; it counts if it has ``SPAN`` words in one line, or ``LONG_SPAN`` over several (so that a few short lines
that many documents share are left alone). Of each cluster and class the document with the least id keeps it, the others lose
it. This is decided for each paragraph and piece by itself, and what goes must be long enough without what stays. A
piece inside a paragraph that goes is not kept there, so its class is kept by the least document beside those.

Defined results: null and empty texts have no spans; rows with a null id are left out; what repeats only within one
id does not count. Ids are integers. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chosenpath, textvec
from .shared import by_bytes, clean_shuffles, passing, small, stored

SHINGLE, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.99, 2
LEAST_WORDS, RADIUS, LEAST_PIECE, SPAN, LONG_SPAN = SHINGLE, 5, 3, 18, 40


def bands_for(threshold: float, recall: float, rows: int = ROWS) -> int:
    """Bands of ``rows`` minima that let a pair at the threshold collide in one at least with the target recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


BANDS = bands_for(THRESHOLD, RECALL)
#: Kinds of units: the last only tell where lines are.
PIECE, PARAGRAPH, RUN, LINE = range(4)
NONE = np.iinfo(np.int64).max
#: Words of documents that are walked over at a time.
WALKED = 1_000_000
#: Runs of GRAM words mark what repeats exactly; anchors are runs of ANCHOR words, one at least in any REACH that follow each other.
GRAM, ANCHOR = SPAN, 10
REACH = LONG_SPAN - ANCHOR + 1
_TURNS = textvec.mix(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)


def _lines(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes; where each line begins (and the last ends); the number of lines of each text."""
    split = [(t or "").split("\n") for t in texts]
    w, at = textvec.words([x for s in split for x in s])
    return w, at, np.array([len(s) for s in split], np.int64)


def _sequence_hashes(w: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each non-empty run of words, given by where it starts and ends; runs in order, one after another."""
    n = end - start
    local = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    own = w[np.repeat(start, n) + local]
    # a run's words past the table's size take its multipliers again, turned by the round
    h = own * _TURNS[local & 4095] ^ (own >> np.uint64(7)) * (local >> 12).astype(np.uint64)
    return textvec.mix(np.add.reduceat(h, np.cumsum(n) - n) + n.astype(np.uint64))


def _cuts(w: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which words begin a piece: the first of each line, and those whose hash is the least around."""
    line = np.repeat(np.arange(len(at) - 1), np.diff(at))
    h = textvec.mix(w)
    cut = np.ones(len(w), bool)
    for k in range(1, RADIUS + 1):
        cut[:k] = cut[len(w) - k :] = False
        if len(w) > k:
            same = line[k:] == line[:-k]
            cut[k:] &= same & (h[k:] < h[:-k])
            cut[:-k] &= same & (h[:-k] <= h[k:])
    cut[at[:-1][at[:-1] < at[1:]]] = True
    return cut


def _extremes(x: np.ndarray, size: int, of: np.ufunc) -> np.ndarray:
    """The least or greatest of each ``size`` values that follow each other."""
    have = 1
    while have < size:
        step = min(have, size - have)
        x = of(x[:-step], x[step:])
        have += step
    return x


def _grams(w: np.ndarray, size: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the run of ``size`` words from each word on, and whether it lies within one text."""
    inside = np.arange(len(w)) + size <= np.repeat(ends, np.diff(ends, prepend=0))
    h = np.zeros(len(w), np.uint64)
    every = textvec.shingle_hashes(w, size)
    h[: len(every)] = textvec.mix(every + np.uint64(size))
    return h, inside


def anchors(w: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of ``ANCHOR`` words begin that are the least of some ``REACH`` in a text, and their hashes.

    A passage of ``LONG_SPAN`` words holds one, the same wherever it stands and however it is set into lines."""
    if len(w) < LONG_SPAN:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h, inside = _grams(w, ANCHOR, ends)
    h[~inside] = np.iinfo(np.uint64).max
    least = _extremes(h, REACH, np.minimum)
    least[~inside[REACH - 1 :] | (np.repeat(ends, np.diff(ends, prepend=0))[: len(least)] < np.arange(len(least)) + LONG_SPAN)] = 0
    none = np.zeros(REACH - 1, np.uint64)
    at = np.flatnonzero(inside & (_extremes(np.concatenate([none, least, none]), REACH, np.maximum) == h))
    return at, h[at]


def units(texts: list[str | None]) -> dict[str, np.ndarray]:
    """All pieces, anchors (their line is -1) and long enough paragraphs: text, line, start in words within the text, words, sig, and for paragraphs, the last, their bands."""
    w, at, n_lines = _lines(texts)
    if not len(w):
        return {}
    text_of_line = np.repeat(np.arange(len(texts)), n_lines)
    first_line = np.cumsum(n_lines) - n_lines
    base = at[first_line]
    start = np.flatnonzero(_cuts(w, at))
    end = np.append(start[1:], len(w))
    line = np.searchsorted(at, start, "right") - 1
    sig = _sequence_hashes(w, start, end)
    keep = end - start >= LEAST_PIECE
    start, end, line, sig = start[keep], end[keep], line[keep], sig[keep]
    long = np.flatnonzero(np.diff(at) >= LEAST_WORDS)
    lsig = _sequence_hashes(w, at[long], at[long + 1]) if len(long) else np.empty(0, np.uint64)
    bands = np.empty((len(long), BANDS), np.uint64)
    if len(long):
        every = textvec.shingle_hashes(w, SHINGLE)
        n = at[long + 1] - at[long] - SHINGLE + 1
        own = every[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[long], n)]
        for b in range(BANDS):
            key = np.full(len(long), b + 1, np.uint64)
            for r in range(ROWS):
                turned = own * (textvec.mix(np.array([b * ROWS + r + 1], np.uint64))[0] | np.uint64(1))
                key = textvec.mix(key + np.minimum.reduceat(turned, np.cumsum(n) - n) * np.uint64(2 * r + 3))
            bands[:, b] = key
    anchor, asig = anchors(w, at[first_line + n_lines])
    lines = np.concatenate([line, np.searchsorted(at, anchor, "right") - 1, long])
    text = text_of_line[lines]
    of_anchor = slice(len(line), len(line) + len(anchor))
    words = np.concatenate([end - start, np.full(len(anchor), ANCHOR), at[long + 1] - at[long]])
    lines -= first_line[text]
    lines[of_anchor] = -1
    return {
        "text": text,
        "line": lines,
        "start": np.concatenate([start, anchor, at[long]]) - base[text],
        "words": words,
        "sig": np.concatenate([sig, asig, lsig]).view(np.int64),
        "bands": bands.view(np.int64),
    }


def _units(docs: DataFrame) -> DataFrame:
    """(doc_id, line, start, words, sig, bands) of all units; pieces have null bands."""
    names = ["doc_id", "line", "start", "words", "sig", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1):
            u = units(b.column(1).to_pylist())
            if not u:
                continue
            n, m = len(u["sig"]), len(u["bands"])
            offsets = np.concatenate([np.zeros(n - m, np.int32), np.arange(0, BANDS * m + 1, BANDS, dtype=np.int32)])
            mask = np.concatenate([np.ones(n - m, bool), np.zeros(m, bool)])
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(u["bands"].ravel()), mask=pa.array(mask))
            cols = [b.column(0).take(pa.array(u["text"])), *(pa.array(u[c].astype(np.int32)) for c in ("line", "start", "words")), pa.array(u["sig"]), bands]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, line int, start int, words int, sig long, bands array<long>"
    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, schema)


def _line_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sig, members) of the paragraphs in ``wanted`` (doc_id, sigs), read from their documents again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 0):
            w, at, n_lines = _lines(b.column(0).to_pylist())
            long = np.flatnonzero(np.diff(at) >= LEAST_WORDS)
            out: dict[int, bytes] = {}
            if len(long):
                sig = _sequence_hashes(w, at[long], at[long + 1]).view(np.int64)
                asked = np.array(sorted({x for s in b.column(1).to_pylist() for x in s}), np.int64)
                for i in np.flatnonzero(np.isin(sig, asked)).tolist():
                    if int(sig[i]) not in out:
                        out[int(sig[i])] = np.unique(textvec.shingle_hashes(w[at[long[i]] : at[long[i] + 1]], SHINGLE)).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], names=["sig", "members"])

    return docs.select("doc_id", "text").join(wanted, "doc_id").select("text", "sigs").mapInArrow(run, "sig long, members binary").dropDuplicates(["sig"])


def _passages(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, line, start, words, sig) of the runs of ``GRAM`` words near repeated anchors, and of the lines there (null sig).

    ``wanted`` is (doc_id, anchors, gone): where the anchors begin, and lines that go; runs with words of those are left out."""
    names = ["doc_id", "line", "start", "words", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1):
            w, at, n_lines = _lines(b.column(1).to_pylist())
            after = np.cumsum(n_lines)
            ends, first_line = at[after], after - n_lines
            base = at[first_line]
            h, inside = _grams(w, GRAM, ends)
            # words near an anchor, and words that go, by differences of how many ranges begin and end
            near, goes = np.zeros(len(w) + 1, np.int32), np.zeros(len(w) + 1, np.int32)
            for i, (found, lost) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                a = np.array(found) + base[i]
                a = a[a < ends[i]]
                np.add.at(near, np.maximum(a - REACH + 1, base[i]), 1)
                np.add.at(near, np.minimum(a + REACH, ends[i]), -1)
                if lost:
                    k = np.array(lost)[np.array(lost) < n_lines[i]] + first_line[i]
                    np.add.at(goes, at[k], 1)
                    np.add.at(goes, at[k + 1], -1)
            before = np.concatenate([[0], np.cumsum(np.cumsum(goes[:-1]) > 0)])
            p = np.flatnonzero(inside & (np.cumsum(near[:-1]) > 0))
            p = p[before[p + GRAM] == before[p]]
            seen = np.zeros(len(w) + 1, np.int32)
            np.add.at(seen, p, 1)
            np.add.at(seen, p + GRAM, -1)
            line = np.unique(np.searchsorted(at, np.flatnonzero(np.cumsum(seen[:-1]) > 0), "right") - 1)
            lines = np.concatenate([np.searchsorted(at, p, "right") - 1, line])
            text = np.searchsorted(after, lines, "right")
            start = np.concatenate([p, at[line]]) - base[text]
            words = np.concatenate([np.full(len(p), GRAM), at[line + 1] - at[line]])
            sig = pa.array(np.concatenate([h[p], np.zeros(len(line), np.uint64)]).view(np.int64), mask=np.arange(len(lines)) >= len(p))
            cols = [b.column(0).take(pa.array(text)), pa.array((lines - first_line[text]).astype(np.int32)), pa.array(start.astype(np.int32)), pa.array(words.astype(np.int32)), sig]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, line int, start int, words int, sig long"
    return docs.select("doc_id", "text").join(wanted, "doc_id").select("doc_id", "text", "anchors", "gone").mapInArrow(run, schema)


def _clusters(docs: DataFrame, every: DataFrame, folder: str | None = None) -> DataFrame:
    """(sig, keeper) of the paragraphs whose cluster is in several documents, from tables stored in ``folder``."""
    lines = every.where("bands is not null")
    classes = stored(lines.groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last")), "paragraphs", folder)
    with passing(docs.sparkSession) as brief:
        banded = stored(lines.select(F.explode("bands").alias("bucket"), "sig", "words").distinct(), "bands", brief)
        sizes = banded.groupBy("bucket").agg(F.count("*").alias("size"), chosenpath.blocks_for(F.count("*"), F.sum("words")).alias("blocks")).where("size > 1")
        found = stored(banded.join(small(stored(sizes.select("bucket", "blocks"), "band-sizes", brief)), "bucket").select("bucket", "sig", "blocks"), "band-members", folder)
    known = chosenpath.listed(found).select("sig", F.lit(1).alias("n"), F.lit(1).alias("mult"), "lists")

    def fetch(wanted: DataFrame) -> DataFrame:
        where = wanted.join(classes, "sig").groupBy("doc_id").agg(F.collect_set("sig").alias("sigs"))
        return _line_sets(docs, small(stored(where, "sources", folder)))

    roots = chosenpath.rooted(chosenpath.compare(found, stored(known, "band-lists", folder), fetch, THRESHOLD, folder))
    joined = stored(classes.join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig")), "rooted", folder)
    heads = joined.groupBy("root").agg(F.min("doc_id").alias("keeper"), F.max("last").alias("last")).where("keeper < last")
    return joined.join(heads.select("root", "keeper"), "root").select("sig", "keeper")


def _lengths_count(line: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of the spans from ``begin`` to ``end`` are long enough: as a whole, or by what they have of one line."""
    if not len(begin):
        return np.zeros(0, bool)
    first = np.concatenate([[True], line[1:] != line[:-1]])
    first[begin] = True
    at = np.flatnonzero(first)
    span = np.searchsorted(begin, at, "right") - 1
    n = np.minimum(np.append(at[1:], len(line)), end[span]) - at
    n[span < 0] = 0
    longest = np.zeros(len(begin), np.int64)
    np.maximum.at(longest, np.maximum(span, 0), n)
    return (end - begin >= LONG_SPAN) | (longest >= SPAN)


def _edges(differs: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of marked words begin and end; a run ends also where ``differs`` holds for the next word."""
    before = np.concatenate([[False], marked[:-1]])
    begin = np.flatnonzero(marked & (~before | differs))
    after = np.concatenate([marked[1:] & ~differs[1:], [False]])
    return begin, np.flatnonzero(marked & ~after) + 1


def walk(ids: np.ndarray, doc: np.ndarray, u: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(doc, start, words, keeper) of the spans of documents, from their units in order of documents; each has one.

    A word's keeper is that of its unit: a paragraph that goes, else a piece, else the least of its runs, else a paragraph that stays. A run of marked words
    that is long enough has parts that go and parts that stay. A part too short to go alone stays, and of those that
    stay the long enough ones are given."""
    size = np.maximum.reduceat(u["end"], np.searchsorted(doc, np.arange(len(ids)))) + 1
    base = np.cumsum(size) - size
    text = np.repeat(np.arange(len(ids)), size)
    owner, line, marked = ids[text], np.full(len(text), -1, np.int32), np.zeros(len(text), bool)
    kind, goes = u["kind"], u["keeper"] != ids[doc]
    place = u["start"] + base[doc]

    def put(chosen: np.ndarray, *, marks: bool) -> None:
        n = (u["end"] - u["start"])[chosen]
        at = np.repeat(place[chosen] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        line[at] = np.repeat(u["line"][chosen], n)
        if marks:
            owner[at], marked[at] = np.repeat(u["keeper"][chosen], n), True

    put(kind == LINE, marks=False)
    put((kind == PARAGRAPH) & ~goes, marks=True)
    least = np.full(len(text) + GRAM - 1, NONE)
    np.minimum.at(least, place[kind == RUN] + GRAM - 1, u["keeper"][kind == RUN])
    least = _extremes(least, GRAM, np.minimum)
    marked |= least < NONE
    owner = np.minimum(owner, least)
    put(kind == PIECE, marks=True)
    put((kind == PARAGRAPH) & goes, marks=True)
    begin, end = _edges(np.zeros(len(text), bool), marked)
    enough = _lengths_count(line, begin, end)
    for i, j in zip(begin[~enough].tolist(), end[~enough].tolist(), strict=True):
        marked[i:j] = False
    gone = owner != ids[text]
    begin, end = _edges(np.concatenate([[False], gone[1:] != gone[:-1]]), marked)
    enough = _lengths_count(line, begin, end) | ~gone[begin]
    for i, j in zip(begin[~enough].tolist(), end[~enough].tolist(), strict=True):
        owner[i:j], gone[i:j] = ids[text[i]], False
    begin, end = _edges(np.concatenate([[False], gone[1:] != gone[:-1]]), marked)
    enough = _lengths_count(line, begin, end)
    begin, end = begin[enough], end[enough]
    keeper = np.minimum.reduceat(np.append(owner, NONE), np.column_stack([begin, end]).ravel())[::2] if len(begin) else owner[:0]
    return text[begin], begin - base[text[begin]], end - begin, keeper


def _walked(per_doc: DataFrame) -> DataFrame:
    """The spans of documents given as (doc_id, hits)."""
    names = ["doc_id", "start", "n_words", "class_id", "removed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hits = b.column(0).to_numpy(), b.column(1)
            offsets = hits.offsets.to_numpy() - hits.offsets[0].as_py()
            flat = hits.flatten()
            u = {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}
            longest = np.maximum.reduceat(u["end"], offsets[:-1]).astype(np.int64)
            share = np.cumsum(longest) // WALKED
            for k in np.unique(share).tolist():
                i, j = np.searchsorted(share, [k, k + 1]).tolist()
                at = slice(offsets[i], offsets[j])
                text, start, n, keeper = walk(ids[i:j], np.repeat(np.arange(j - i), np.diff(offsets[i : j + 1])), {c: x[at] for c, x in u.items()})
                own = ids[i:j][text]
                cols = [pa.array(own), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(keeper, pa.int64()), pa.array(keeper != own)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return per_doc.mapInArrow(run, "doc_id long, start long, n_words long, class_id long, removed boolean")


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start, n_words, class_id, removed) of each repeated span, places in words of the text.

    ``class_id`` is the document that keeps the span; where parts have several, the least. The span is removed elsewhere."""
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"doc_id must be an integer, not {kind.simpleString()}")
    spark = docs.sparkSession
    with clean_shuffles(spark), passing(spark) as units_at:
        every = stored(_units(docs), "units", units_at)
        with passing(spark) as brief:
            clusters = small(stored(_clusters(docs, every, brief), "clusters", units_at))
        lines = stored(every.where("bands is not null").join(clusters, "sig").select("doc_id", "line", "start", "words", "keeper"), "lines")
        repeated = every.where("bands is null").groupBy("sig").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("sig")
        repeated = stored(repeated, "repeated", units_at)  # grows with the input, so it is never broadcast
        found = stored(every.where("bands is null").join(repeated, "sig").select("doc_id", "line", "start", "words", "sig"), "found")
    # a paragraph that goes takes its pieces along, so none of them can be the one that is kept
    with clean_shuffles(spark), passing(spark) as brief:
        gone = small(stored(lines.where("keeper <> doc_id").select("doc_id", "line").distinct(), "gone"))
        pieces = found.where("line >= 0").join(gone, ["doc_id", "line"], "left_anti")
        wanted = found.where("line < 0").groupBy("doc_id").agg(F.collect_set("start").alias("anchors"))
        wanted = wanted.join(gone.groupBy("doc_id").agg(F.collect_set("line").alias("gone")), "doc_id", "left")
        passages = stored(_passages(docs, small(stored(wanted, "wanted", brief))), "passages")
        runs = passages.where("sig is not null")
        known = pieces.groupBy("sig").agg(F.min("doc_id").alias("keeper")).unionAll(runs.groupBy("sig").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")).where("keeper < last").select("sig", "keeper"))
        keepers = stored(known, "keepers")
    columns = ("doc_id", "line", "start", "words", "keeper", "kind")
    runs = runs.select("doc_id", "start", "sig").join(keepers, "sig").select("*", F.lit(-1).alias("line"), F.lit(GRAM).alias("words"))
    kinds = ((pieces.join(keepers, "sig"), PIECE), (runs, RUN), (lines, PARAGRAPH), (passages.where("sig is null").withColumn("keeper", F.col("doc_id")), LINE))
    hits = reduce(DataFrame.unionAll, [df.withColumn("kind", F.lit(k)).select(*columns) for df, k in kinds])
    unit = F.struct("start", (F.col("start") + F.col("words")).alias("end"), "line", F.col("keeper").cast("long").alias("keeper"), "kind")
    per_doc = hits.groupBy("doc_id").agg(F.collect_list(unit).alias("hits")).select(F.col("doc_id").cast("long").alias("doc_id"), "hits")
    return _walked(per_doc).withColumn("doc_id", F.col("doc_id").cast(kind))
