"""Token-ID output: every text through a public tokenizer, its ids into compressed segments, and back.

Documents are dealt by ranges of their id (then of a hash of the text and of the row's place, which split rows that repeat an
id) and sorted within each range, so that the segments of part after part hold all documents in ascending order. Each task
writes segments of up to ``SEGMENT`` ids (or of one document that has more), one row each, through Spark's own writer: any store that Spark
writes can hold them, a lost task is simply run again, and a reader needs a few segments in memory at a time. The place
of a row is stable where ``docs`` is a stored table; it only orders rows that are equal in id and text.

The tokenizer's file is a parameter. Of one whose normalizer and word pattern are those of ``KNOWN_SPLIT``, texts are cut into
words on whole byte arrays, and each different word goes to the tokenizer's model once; words are
remembered exactly, by their bytes, within the bounds of ``REMEMBERED`` and ``REMEMBERED_BYTES`` a worker. With any other file whole
texts go to the tokenizer.

Defined results: a null text has only the end id; null ids come first; rows that repeat an id keep an order given by
their texts' hashes, and equal rows are interchangeable. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokencoder
from .shared import give_back, new_path, small, stored

END_ID, SEGMENT, SLICE = 1, 1 << 20, 1 << 20
#: Words, and bytes of long words and ids, that a worker remembers.
REMEMBERED, REMEMBERED_BYTES = 400_000, 16 << 20
#: How a tokenizer must normalize and split for words to be cut on bytes.
KNOWN_SPLIT = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_SPACE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_SLOTS = 1 << 20
_KEY = 24
_encoders: dict[str, Encoder] = {}


def _classes() -> np.ndarray:
    """The class of each byte; of two-byte letters (Latin to U+024F, and Cyrillic from U+0400 to U+047F) the first byte's."""
    out = np.full(256, _ODD, np.uint8)
    for c in range(33, 127):
        out[c] = _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _MARK
    out[[9, 10, 11, 12, 13, 32]] = _SPACE
    out[0xC3:0xCA] = out[0xD0:0xD2] = _LETTER
    return out


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself where it prints, else one from U+0100 on."""
    prints = [33 <= b <= 126 or 161 <= b <= 172 or b >= 174 for b in range(256)]
    rest = iter(range(256, 512))
    return [chr(b) if p else chr(next(rest)) for b, p in enumerate(prints)]


def _room(held: np.ndarray, needed: int) -> np.ndarray:
    """``held``, or twice as large an array that begins with it, where it has no room for ``needed`` rows."""
    if needed <= len(held):
        return held
    grown = np.zeros((2 * needed, *held.shape[1:]), held.dtype)
    grown[: len(held)] = held
    return grown


class _Words:
    """The words known so far, by their bytes (up to 24 of them, in three integers), and the ids of each."""

    def __init__(self) -> None:
        self.slots = np.full(_SLOTS, -1, np.int32)
        self.clear()

    def clear(self) -> None:
        self.slots[:] = -1
        self.keys = np.empty((0, 3), np.uint64)
        self.others: dict[bytes, int] = {}
        self.at, self.flat = np.zeros(1, np.int64), np.empty(0, np.uint32)
        self.known = self.held = 0

    def __len__(self) -> int:
        return self.known

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        h = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ keys[:, 2] * np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(29)
        return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(44)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for those that are not known."""
        out = np.full(len(keys), -1, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            got = self.slots[slot]
            there = np.flatnonzero(got >= 0)
            a, b = self.keys[got[there]], keys[todo[there]]
            same = (a[:, 0] == b[:, 0]) & (a[:, 1] == b[:, 1]) & (a[:, 2] == b[:, 2])
            out[todo[there[same]]] = got[there[same]]
            left = there[~same]
            todo, slot = todo[left], (slot[left] + 1) & (_SLOTS - 1)
        return out

    def add(self, keys: np.ndarray, ids: list[list[int]]) -> None:
        """New words with short bytes. They must be distinct, and not known."""
        first = self._extend(ids)
        self.keys = _room(self.keys, len(self))
        self.keys[first : len(self)] = keys
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = first + todo[free]
            lost = self.slots[slot] != first + todo  # to a word that was there, or that came here too
            todo, slot = todo[lost], (slot[lost] + 1) & (_SLOTS - 1)

    def _extend(self, ids: list[list[int]]) -> int:
        first, a = len(self), int(self.at[len(self)])
        self.known += len(ids)
        self.at = _room(self.at, self.known + 1)
        self.at[first + 1 : self.known + 1] = a + np.cumsum([len(x) for x in ids], dtype=np.int64)
        b = int(self.at[self.known])
        self.flat = _room(self.flat, b)
        self.flat[a:b] = [i for x in ids for i in x]
        self.held = max(self.held, b * self.flat.itemsize)
        return first

    def add_others(self, words: list[bytes], ids: list[list[int]]) -> None:
        first = self._extend(ids)
        self.others.update(zip(words, range(first, first + len(words)), strict=True))
        self.held += sum(map(len, words))


class Encoder:
    """A tokenizer; where its way of splitting is known, with a memory of words."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.cuts = all(spec[k] == v for k, v in KNOWN_SPLIT.items()) and model["type"] == "BPE" and not model.get("dropout")
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = dict(enumerate(_byte_letters()))
        self.words = _Words()

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _whole(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _model(self, words: list[bytes]) -> list[list[int]]:
        """The ids of words of nothing but letters that stay themselves when composed: only case and byte letters are to be mapped."""
        mapped = b" ".join(words).decode().lower().encode().decode("latin-1").translate({b: c for b, c in self.letters.items() if b != 32})
        tokenize = self.tokenizer.model.tokenize
        return words and [[t.id for t in tokenize(w)] for w in mapped.split(" ")]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, given in UTF-8."""
        if not self.cuts:
            return [np.array(x, np.uint32) for x in self._whole(texts)]
        whole = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, bytes]] = []
        n = 0
        for i, t in enumerate(texts):
            if i in whole:
                out[i].append(np.array(self._whole([t])[0], np.uint32))
                continue
            for part in _sections(t):
                held.append((i, part))
                n += len(part) + 1
                if n >= SLICE:
                    self._some(held, out)
                    held, n = [], 0
        if held:
            self._some(held, out)
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.empty(0, np.uint32) for x in out]

    def _some(self, held: list[tuple[int, bytes]], out: list[list[np.ndarray]]) -> None:
        raw = b"\n".join([t for _, t in held])
        start, length, plain, sure = _cut(raw)
        if len(self.words) > REMEMBERED or self.words.held > REMEMBERED_BYTES:
            self.words.clear()
        number = self._numbers(raw, start, length, plain, sure)
        size = self.words.at[number + 1] - self.words.at[number]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        ids = self.words.flat[np.repeat(self.words.at[number] - (end - size), size) + np.arange(total)]
        edges = np.cumsum([len(t) + 1 for _, t in held])
        upto = np.concatenate([[0], end])[np.searchsorted(start, edges)]
        for (i, _), a, b in zip(held, [0, *upto.tolist()], upto.tolist(), strict=False):
            out[i].append(ids[a:b])

    def _numbers(self, raw: bytes, start: np.ndarray, length: np.ndarray, plain: np.ndarray, sure: np.ndarray) -> np.ndarray:
        """The numbers of the words at ``start``; unknown ones are learned. ``sure``: those that are cut off cleanly, as letters (``plain``), digits
        or marks of ASCII."""
        number = np.empty(len(start), np.int64)
        kept = sure & (length <= _KEY)
        short = np.flatnonzero(kept)
        keys = _keys(raw, start[short], length[short])
        number[short] = found = self.words.find(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            order = new[np.lexsort(keys[new].T)]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
            first = order[fresh]
            spelled = [raw[a : a + k] for a, k in zip(start[short[first]].tolist(), length[short[first]].tolist(), strict=True)]
            letters = plain[short[first]].tolist()
            by_model, by_all = (iter(f([w for w, x in zip(spelled, letters, strict=True) if x == y])) for f, y in ((self._model, True), (self._whole, False)))
            base = len(self.words)
            self.words.add(keys[first], [next(by_model if x else by_all) for x in letters])
            number[short[order]] = base + np.cumsum(fresh) - 1
        rest = np.flatnonzero(~kept)
        if len(rest):
            spelled = [raw[a : a + k] for a, k in zip(start[rest].tolist(), length[rest].tolist(), strict=True)]
            unknown = list(set(spelled) - self.words.others.keys())
            if unknown:
                self.words.add_others(unknown, self._whole(unknown))
            number[rest] = [self.words.others[w] for w in spelled]
        return number


def _sections(text: bytes) -> Iterator[bytes]:
    """A long text in sections, cut at a space."""
    at = 0
    while len(text) - at > SLICE:
        cut = text.find(b" ", at + SLICE)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


_CLASS = _classes()


def _cut(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, plain, sure) of the words that the tokenizer's pattern finds, or of unions of some: whether they are letters, and whether they are
    letters, digits or marks and no more.

    A cut is made only where it is sure: between letters, a digit and the marks of ASCII. What lies between white space
    and holds anything else (other letters, combining or control characters) is one word."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), np.empty(0, bool)
    kind = _CLASS[b]
    lead = np.flatnonzero((b >= 0xC3) & (kind == _LETTER))
    after = lead + 1  # there is one, as the text is UTF-8
    kind[after] = _LETTER
    first, second = b[lead], b[after]
    no = ((first == 0xC3) & ((second == 0x97) | (second == 0xB7))) | ((first == 0xC4) & (second == 0xB0))  # two signs; a letter whose small form is two
    kind[lead[no]] = kind[after[no]] = _ODD
    edge = np.empty(len(b), bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge |= kind == _DIGIT
    start = np.flatnonzero(edge)
    sort = kind[start]
    length = np.diff(start, append=len(b))
    # A lone apostrophe belongs to the letters behind it, as it may begin one of the pattern's endings.
    lone = np.flatnonzero((sort[:-1] == _MARK) & (length[:-1] == 1) & (b[start[:-1]] == 39) & (sort[1:] == _LETTER))
    keep = np.ones(len(start), bool)
    keep[lone + 1] = False
    start, sort = start[keep], sort[keep]
    plain, sure = sort == _LETTER, np.ones(len(sort), bool)
    if (sort == _ODD).any():
        space = sort == _SPACE
        run = np.cumsum(np.diff(space, prepend=~space[0]) != 0)  # white space and what lies between, by turns
        odd = np.zeros(int(run[-1]) + 1, bool)
        odd[run[sort == _ODD]] = True
        inside = odd[run]
        begins = np.diff(run, prepend=0) > 0
        keep = ~inside | begins
        plain &= ~inside
        start, sort, plain, sure = start[keep], sort[keep], plain[keep], ~inside[keep]
    length = np.diff(start, append=len(b))
    word = sort != _SPACE
    return start[word], length[word], plain[word], sure[word]


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _keys(raw: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of each word in three integers. ASCII capitals are lowered: words that differ in them have the same ids."""
    padded = np.frombuffer(raw.lower() + bytes(_KEY + 8), np.uint8)
    loads = np.ndarray((len(padded) - 8,), "<u8", padded, strides=(1,))
    out = np.empty((len(start), 3), np.uint64)
    for k in range(3):
        out[:, k] = loads[start + 8 * k] & _MASK[np.clip(length - 8 * k, 0, 8)]
    return out


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Encode ``docs`` (doc_id, text) into a table of segments at ``path``: (part, seg, n_ids, doc_ids, data)."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], np.uint32)
    names = ["part", "seg", "n_ids", "doc_ids", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.at(tokenizer), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        sizes: list[int] = []
        held_ids: list[pa.Array] = []
        ready: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        n = seg = 0

        def close() -> None:
            nonlocal held, held_ids, sizes, n
            ready.append((np.concatenate(held), np.array(sizes, np.int64), pa.concat_arrays(held_ids)))
            held, held_ids, sizes, n = [], [], [], 0

        def segments() -> Iterator[pa.RecordBatch]:
            nonlocal ready, seg
            coded = tokencoder.encode_segments([(ids, k) for ids, k, _ in ready])
            for (ids, _, doc_ids), data in zip(ready, coded, strict=True):
                lists = pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([len(ids)], pa.int64()), lists, pa.array([data], pa.binary())], names=names)
                seg += 1
            ready = []

        for b in batches:
            for a in range(0, b.num_rows, 64):
                some = b.slice(a, 64)
                for i, x in enumerate(encoder.encode([t or b"" for t in some.column(1).cast(pa.binary()).to_pylist()])):
                    if n and n + len(x) + 1 > SEGMENT:  # else a few ids would be a block of their own
                        close()
                    held += [x, end]
                    sizes.append(len(x) + 1)
                    held_ids.append(some.column(0).slice(i, 1))
                    n += len(x) + 1
                    if n >= SEGMENT:
                        close()
                    if len(ready) == tokencoder.TOGETHER:
                        yield from segments()
        if held:
            close()
        yield from segments()
        give_back()

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("place"))
    order = [F.col("doc_id").asc_nulls_first(), "h", "place"]
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt.select("doc_id", "text").mapInArrow(run, f"part int, seg int, n_ids long, doc_ids array<{id_type}>, data binary").write.option("compression", "none").parquet(path)


def read(spark, path: str) -> DataFrame:  # noqa: ANN001
    """(doc_id, start, n_tokens, ids_crc32) of each document from the segments at ``path``; their checksums are held against the data."""
    segments = spark.read.parquet(path)
    sizes = stored(segments.select("part", "seg", "n_ids"), "segment-sizes")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    first = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("first"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids")
    offsets = stored(sizes.select("part", "seg", within.alias("within")).join(first, "part").select("part", "seg", (F.col("first") + F.col("within")).alias("offset")), "segment-offsets")
    id_type = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, tokencoder.TOGETHER):
                some = b.slice(a, tokencoder.TOGETHER)
                for i, (ids, n) in enumerate(tokencoder.decode_segments(some.column(2).to_pylist())):
                    n = n.astype(np.int64)
                    ends = np.cumsum(n)
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                    start = some.column(0)[i].as_py() + ends - n
                    yield pa.RecordBatch.from_arrays([some.column(1)[i].values, pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    joined = segments.join(small(offsets), ["part", "seg"]).select("offset", "doc_ids", "data")
    return joined.mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the documents' ids into the shared folder and read them back."""
    path = new_path(docs.sparkSession, "token-segments")
    write(docs, tokenizer, path)
    return read(docs.sparkSession, path)
