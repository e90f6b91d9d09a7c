"""Spelling variants: words of a corpus that differ by one code point, grouped under the form that is written most.

Words are counted by task first (a dictionary bounded in entries and bytes) and then by Spark. Each word of ``n`` code points has
``n`` deletion keys: the polynomial hash of what is left without one of them, put together from a prefix and a suffix
hash, for all positions of many words at once in NumPy; and one key of the whole word. Keys are 64-bit integers with the word's
number, so a long word does not multiply its text. They are partitioned by their leading bits and sorted; keys that no other
word has fall away there. For the rest the words are joined again, and equal keys are verified on the strings that are left:

* words with the same remainder at the same position differ by a replaced code point; every two of them do, so that a group
  gives counts and its two largest members, never pairs. It has one member for each letter at most;
* a word that is the remainder of others lacks one code point of each of them.

Forms point to words at least twice as frequent, so chains are short; roots come from doubling the pointers.

Defined results: a null text has no words, a null id counts as an empty one in the hash that misspells; rows that repeat count
again. Words are compared whatever their length. Ties go to the smaller word in code-point order. An empty table gives none.
Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec
from .shared import by_bytes, give_back, stored

LEAST_LETTERS, LEAST_COUNT, ODDS, FACTOR = 5, 3, 97, 2
#: Words that a task counts before it hands them on, and the bytes of those words.
HELD, HELD_BYTES = 150_000, 8 << 20
#: Code points whose deletion keys are made at a time; bytes from which a run's checksum is taken alone.
CHUNK, LONG = 200_000, 64
RADIX_BITS = 16
#: What each Latin-1 character of a text becomes: letters stay (A-Z lower-cased), all else separates.
_LETTERS = bytes((c + 32 if 65 <= c <= 90 else c) if 65 <= c <= 90 or 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & np.uint32(1), (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def checksums(data: bytes, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The crc32 of ``data[start:end]`` for many places at once, each carried on from the crc32 in ``before``."""
    x = np.frombuffer(data, np.uint8)
    n = end - start
    out = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(n > LONG).tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]], int(before[i])) ^ 0xFFFFFFFF
    short = np.flatnonzero(n <= LONG)
    short = short[np.argsort(-n[short], kind="stable")]
    state, at, width = out[short], start[short], -n[short]
    for k in range(LONG):
        m = int(np.searchsorted(width, -k, "left"))  # those longer than k
        if not m:
            break
        state[:m] = _CRC[(state[:m] ^ x[at[:m] + k]) & np.uint32(0xFF)] ^ (state[:m] >> np.uint32(8))
    out[short] = state
    return out ^ np.uint32(0xFFFFFFFF)


def runs_of(texts: list[str | None], ids: list, odds: int = ODDS) -> tuple[list[bytes], list[tuple[bytes, bytes]]]:
    """All runs of letters of the texts as UTF-8, and (run, what it becomes) for each that loses a code point."""
    parts = [t.encode("latin-1", "replace").translate(_LETTERS).decode("latin-1").encode() if t else b"" for t in texts]
    data = b" ".join(parts)
    runs = data.split()
    if not runs or not odds:
        return runs, []
    inside = np.frombuffer(data, np.uint8) != 32
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    stops = np.cumsum([len(p) + 1 for p in parts])
    prefix = np.array([zlib.crc32(b"%s:" % (b"" if i is None else str(i).encode())) for i in ids], np.uint32)
    h = checksums(data, start, end, prefix[np.searchsorted(stops, start, "right")])
    changed = []
    for k in np.flatnonzero(h % odds == 0).tolist():
        w = runs[k].decode()
        at = int(h[k]) % len(w)
        changed.append((runs[k], (w[:at] + w[at + 1 :]).encode()))
    return runs, changed


def counted(docs: DataFrame, odds: int = ODDS, letters: int = LEAST_LETTERS) -> DataFrame:
    """(word, n): runs of letters of at least ``letters`` code points. Of every ``odds``-th run, by a hash of it and the id, a code
    point is left out first (never, if ``odds`` is 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            some = [(w.decode(), k) for w, k in n.items() if k and len(w) >= letters]
            some = [x for x in some if len(x[0]) >= letters]
            n.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.string()), pa.array([k for _, k in some], pa.int64())], names=["word", "n"])

        for b in by_bytes(batches, 1):
            runs, changed = runs_of(b.column(1).to_pylist(), b.column(0).to_pylist(), odds)
            n.update(runs)
            n.subtract(w for w, _ in changed)
            n.update(w for _, w in changed)
            if len(n) > HELD or sum(map(len, n)) > HELD_BYTES:
                yield rows()
        yield rows()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word's index, position, whether the first of a run of equal code points, key) of every deletion, and of every whole word at position -1.

    Equal strings have equal keys, whether they are remainders or whole."""
    cp = textvec.code_points("".join(words))
    size = np.array([len(w) for w in words], np.int64)
    end = np.cumsum(size)
    start = end - size
    power, inverse = textvec.powers(len(cp) + 2)
    total = np.zeros(len(cp) + 1, np.uint64)
    x = textvec.mix((cp.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    np.cumsum(x * power[: len(cp)], out=total[1:])
    word = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(cp))
    a, b = start[word], end[word]
    rest = (total[at] - total[a]) * inverse[a] + (total[b] - total[at + 1]) * inverse[a + 1]
    whole = (total[end] - total[start]) * inverse[start]
    first = np.ones(len(cp), bool)
    first[1:] = (cp[1:] != cp[:-1]) | (at[1:] == a[1:])
    length = np.concatenate([size[word] - 1, size]).astype(np.uint64)
    key = textvec.mix(np.concatenate([rest, whole]) + length * np.uint64(0xD6E8FEB86659FD93))
    return (
        np.concatenate([word, np.arange(len(words))]),
        np.concatenate([at - a, np.full(len(words), -1)]),
        np.concatenate([first, np.ones(len(words), bool)]),
        key.view(np.int64),
    )


def _keys(words: DataFrame) -> DataFrame:
    """(key, at, first, wid) of all deletions of all words, in chunks of code points."""
    names = ["key", "at", "first", "wid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1, CHUNK):
            w, at, first, key = deletion_keys(b.column(1).to_pylist())
            wid = b.column(0).to_numpy()[w]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(at.astype(np.int32)), pa.array(first), pa.array(wid)], names=names)

    return words.select("wid", "word").mapInArrow(run, "key long, at int, first boolean, wid long")


def meetings(key: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by (key, at): which are one of several at a place, and which are a whole word with its longer ones or such a longer one."""
    n = len(key)
    edge = np.flatnonzero(np.diff(key, prepend=key[0] - 1 if n else 0)) if n else np.empty(0, np.int64)
    if n:
        edge[0] = 0
    group = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, n)))
    same_next = np.zeros(n, bool)
    same_next[:-1] = (group[1:] == group[:-1]) & (at[1:] == at[:-1])
    same = same_next.copy()
    same[1:] |= same_next[:-1]
    replaced = same & (at >= 0)
    whole, longer = at < 0, (at >= 0) & first
    counts = np.bincount(group, weights=whole, minlength=len(edge)) * np.bincount(group, weights=longer, minlength=len(edge)) if n else np.empty(0)
    return replaced, (counts[group] > 0) & (whole | longer) if n else same


def _met(keys: DataFrame) -> DataFrame:
    """(key, at, kind, wid) of the rows whose key another word may share; ``kind``: r(eplaced), w(hole) or l(onger)."""
    names = ["key", "at", "kind", "wid"]
    kinds = pa.array(["r", "w", "l"])

    def out(cols: list[np.ndarray]) -> pa.RecordBatch:
        key, at, first, wid = cols
        replaced, lost = meetings(key, at, first)
        i = np.concatenate([np.flatnonzero(replaced), np.flatnonzero(lost)])
        kind = np.concatenate([np.zeros(int(replaced.sum()), np.int64), np.where(at[lost] < 0, 1, 2)])
        return pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(at[i]), kinds.take(pa.array(kind)), pa.array(wid[i])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last key's rows, whose group may go on
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            held = [c[cut:] for c in cols]
            if cut:
                yield out([c[:cut] for c in cols])
        if held is not None:
            yield out(held)
        give_back()

    radix = F.shiftrightunsigned("key", 64 - RADIX_BITS)
    return keys.repartition(radix).sortWithinPartitions("key", "at").mapInArrow(run, "key long, at int, kind string, wid long")


def near(words: DataFrame) -> DataFrame:
    """(wid, n_near, best) of the words (wid, word, n) that have near words; ``best`` is (-n, word) of the most frequent."""
    met = _met(_keys(words)).join(words, "wid")
    rest = F.when(F.col("at") < 0, F.col("word")).otherwise(F.concat(F.substring("word", F.lit(1), F.col("at")), F.substring("word", F.col("at") + 2, F.length("word"))))
    met = met.select("wid", "kind", "key", F.when(F.col("kind") == "r", F.col("at")).otherwise(-1).alias("place"), rest.alias("rest"), F.struct((-F.col("n")).alias("less"), "word").alias("it"))
    group = Window.partitionBy("key", "place", "rest", F.col("kind") == "r")
    ordered = group.orderBy("it").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole, longer = F.col("kind") == "w", F.col("kind") == "l"
    told = met.select(
        "wid",
        "kind",
        "it",
        F.count("*").over(group).alias("members"),
        F.count_if(whole).over(group).alias("wholes"),
        F.first("it").over(ordered).alias("top"),
        F.nth_value("it", 2).over(ordered).alias("second"),
        F.min(F.when(whole, F.col("it"))).over(group).alias("whole"),
        F.min(F.when(longer, F.col("it"))).over(group).alias("longer"),
    )
    n = F.when(F.col("kind") == "r", F.col("members") - 1).when(whole, F.col("members") - F.col("wholes")).otherwise(F.col("wholes"))
    best = F.when((F.col("kind") == "r") & (F.col("it") == F.col("top")), F.col("second")).when(F.col("kind") == "r", F.col("top")).when(whole, F.col("longer")).otherwise(F.col("whole"))
    return told.select("wid", n.alias("n_near"), best.alias("best")).where("n_near > 0").groupBy("wid").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): pointers are doubled until none leads on. Counts at least double from word to form, so six rounds
    are enough for counts of 64 bits."""
    at = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("on"))
        if at.join(ahead, "root", "left_semi").isEmpty():
            return at
        at = stored(at.join(ahead, "root", "left").select("word", F.coalesce("on", "root").alias("root")), "forms")


def variants(docs: DataFrame, odds: int = ODDS, letters: int = LEAST_LETTERS, count: int = LEAST_COUNT, factor: int = FACTOR) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word that occurs ``count`` times or more."""
    words = stored(counted(docs, odds, letters).where(F.col("n") >= count).select(F.monotonically_increasing_id().alias("wid"), "word", "n"), "words")
    enough = -F.col("best.less") >= factor * F.col("n")
    formed = stored(
        words.join(near(words), "wid", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("best.word")).alias("form"),
            F.when(enough, -F.col("best.less")).alias("form_n"),
        ),
        "formed",
    )
    roots = _roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


#: crc32 in SQL: a table of 256 remainders, and a fold over the bytes of a string.
CRC_TABLE = """
remainders AS (SELECT list(list_reduce([0::UBIGINT, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, i::UBIGINT) ORDER BY i) AS t FROM range(256) r(i))"""


def crc_of(text: str) -> str:
    """The SQL of the unsigned crc32 of an expression's UTF-8; ``t`` is the table."""
    octets = f"list_transform(range(length(hex(encode({text}))) // 2), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::UBIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::INT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT)"


ORACLE = f"""
WITH RECURSIVE {CRC_TABLE.strip()},
runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) GROUP BY 1, 2),
hashed AS (SELECT run, k, {crc_of("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, remainders),
spelt AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM hashed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM words)),
pairs AS (SELECT a.word AS a, b.word AS b, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN cut b ON a.word = b.rest
  UNION SELECT b.word, a.word, a.n FROM words a JOIN cut b ON a.word = b.rest),
best AS (SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM pairs),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN p.n >= 2 * w.n THEN b END AS form, CASE WHEN p.n >= 2 * w.n THEN p.n END AS form_n
  FROM words w LEFT JOIN best p ON a = word AND r = 1),
walk(word, root) AS (SELECT word, word FROM formed UNION ALL SELECT walk.word, form FROM walk JOIN formed f ON f.word = root WHERE form IS NOT NULL),
ends AS (SELECT walk.word, root FROM walk JOIN formed f ON f.word = root WHERE f.form IS NULL)
SELECT formed.word, n, n_near, form, form_n, root FROM formed JOIN ends ON ends.word = formed.word"""
