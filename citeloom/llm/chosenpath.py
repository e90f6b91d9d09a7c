"""N-gram Jaccard join by chosen paths.

Every text is the set of hashes of its runs of five words. In each of ``runs`` independent runs a set chooses every
token whose hash is below ``1 / (threshold * size)``, so that two sets at the threshold share one chosen token on
average (further down a path, ``1 / (threshold * size - tokens on it)``, as those can't be chosen again); sets that chose the same token meet in its bucket. A bucket of at most ``SMALL`` sets is compared by brute
force. A larger one is split again: its sets choose further tokens, with hashes that depend on the path so
far, down to ``DEPTH`` tokens; what is still large then is compared in blocks of ``BLOCK`` sets (or fewer, ``WEIGHT`` members), pair of
blocks by pair of blocks. The number of runs is what brings a pair at the threshold to the target recall even at full depth.

Texts with equal sets form a class; only one of each is compared. A pair of classes that meets in several buckets
belongs to the least of them and is verified and counted only there. What comes out of the comparison is a sum per
class and a spanning forest per task, never the pairs; links are counted exactly, from the exact Jaccard similarity.

Defined results: a text of one to four words is the set of its one word sequence; texts without words, and rows
with a null id, link with nothing and have no class but their own. Rows that repeat an id are documents of their
own. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec
from .components import components
from .shared import by_bytes, give_back, small, stored

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.995
SMALL, DEPTH, BLOCK = 64, 3, 1024
#: Members of all sets that a block may have on average.
WEIGHT = 1 << 20
_COLUMNS = 4096


def runs_needed(recall: float, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``, were all buckets split ``depth`` times."""
    miss = 0.0
    for _ in range(depth):
        miss = math.exp(-(1 - miss))
    return math.ceil(math.log(1 - recall) / math.log(miss))


def signature(members: np.ndarray) -> int:
    """A hash of the whole set."""
    mixed = 3 * int(members.sum(dtype=np.uint64)) + int(np.bitwise_xor.reduce(members)) + len(members)
    return int(textvec.mix(np.array([mixed % 2**64], np.uint64)).view(np.int64)[0])


def paths(members: np.ndarray, threshold: float, runs: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The paths of one token; then for each further depth the pairs (path so far, path with one more token)."""
    n = len(members)
    salts = textvec.mix(np.arange(1, runs + 1, dtype=np.uint64))
    step = max(1, 4_000_000 // max(n, 1))
    deeper = []

    def choose(keys: np.ndarray, used: int) -> tuple[np.ndarray, np.ndarray]:
        common = threshold * n - used  # tokens that a pair at the threshold has in common and may still choose
        limit = np.uint64(min(2**64 - 1, int(2**64 / max(common, 1)))) if n else np.uint64(0)
        found = [(a + (c := np.nonzero(members[None] * (keys[a : a + step, None] | np.uint64(1)) <= limit))[0], c[1]) for a in range(0, len(keys), step)]
        return np.concatenate([f[0] for f in found] or [np.empty(0, np.int64)]), np.concatenate([f[1] for f in found] or [np.empty(0, np.int64)])

    which, token = choose(salts, 0)
    now = textvec.mix(salts[which] + members[token])
    used = token[:, None]
    first = now
    for depth in range(1, DEPTH):
        which, token = choose(textvec.mix(now), depth)
        fresh = (used[which] != token[:, None]).all(axis=1)
        which, token = which[fresh], token[fresh]
        longer = textvec.mix(now[which] + members[token] * np.uint64(0x9E3779B97F4A7C15))
        deeper.append(np.stack([now[which], longer], axis=1) if len(which) else np.empty((0, 2), np.uint64))
        now, used = longer, np.concatenate([used[which], token[:, None]], axis=1)
    return first, deeper


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def prepare(docs: DataFrame, threshold: float, runs: int) -> DataFrame:
    """(doc_id, h, sig, n, p1, q2, p2, q3, p3): a hash of the text, its class, the set's size and its paths, ``qk`` being the parents
    of ``pk``.

    Paths are of the class, so of equal texts in a task only the first one carries them."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h long, sig long, n long, p1 array<long>, " + ", ".join(f"q{k} array<long>, p{k} array<long>" for k in range(2, DEPTH + 1))
    names = ["doc_id", "h", "sig", "n", "p1", *(f"{c}{k}" for k in range(2, DEPTH + 1) for c in "qp")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in by_bytes(batches, 1):
            w, at = textvec.words(b.column(1).to_pylist())
            sets = textvec.shingle_sets(w, at, SHINGLE)
            known = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            linkable = [bool(k) and len(s) > 0 for k, s in zip(known, sets, strict=True)]
            sigs = [signature(s) if k else None for k, s in zip(linkable, sets, strict=True)]
            found = []
            for x, s in zip(sigs, sets, strict=True):
                found.append(paths(s[:0] if x is None or x in seen else s, threshold, runs))
                seen.add(x)
            cols = [b.column(0), b.column(2), pa.array(sigs, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _lists([f[0] for f in found])]
            for k in range(DEPTH - 1):
                cols += [_lists([np.ascontiguousarray(f[1][k][:, c]) for f in found]) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, schema)


def buckets(rows: DataFrame) -> DataFrame:
    """(bucket, sig, blocks) of all buckets to compare: small ones of each depth, and whatever is left at the last."""
    some = rows.where("sig is not null")
    level = some.select(F.explode("p1").alias("bucket"), "sig", "n").distinct()
    out = None
    for k in range(1, DEPTH + 1):
        level = stored(level, f"level{k}")
        sizes = stored(level.groupBy("bucket").agg(F.count("*").alias("size"), blocks_for(F.count("*"), F.sum("n")).alias("blocks")).where("size > 1"), f"sizes{k}")
        done = sizes if k == DEPTH else sizes.where(F.col("size") <= SMALL)
        part = level.join(done.select("bucket", "blocks"), "bucket").select("bucket", "sig", "blocks")
        out = part if out is None else out.unionAll(part)
        if k < DEPTH:
            split = small(sizes.where(F.col("size") > SMALL).select(F.col("bucket").alias("parent")))
            pairs = F.explode(F.arrays_zip(F.col(f"q{k + 1}").alias("parent"), F.col(f"p{k + 1}").alias("bucket"))).alias("x")
            level = some.select(pairs, "sig", "n").select("x.parent", "x.bucket", "sig", "n").join(split, "parent", "left_semi").select("bucket", "sig", "n").distinct()
    return out


def blocks_for(size: Column, weight: Column) -> Column:
    """In how many blocks to compare a bucket of ``size`` sets with ``weight`` members together."""
    return F.greatest(F.ceil(size / BLOCK), F.ceil(weight / WEIGHT)).cast("int")


def _in_blocks(found: DataFrame) -> DataFrame:
    """Each member of a bucket once for each pair of blocks that its own block is in: (bucket, bi, bj, blk, sig)."""
    n = F.col("blocks")
    blk = F.pmod(F.xxhash64("sig"), n).cast("int")
    keyed = found.select("bucket", "sig", blk.alias("blk"), F.explode(F.sequence(F.lit(0), n - 1)).alias("other"))
    return keyed.select("bucket", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "blk", "sig")


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of one key (the first ``keys`` columns) after another, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(b.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(c[s] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _owned(bucket: int, blk: np.ndarray, bi: int, bj: int, n: np.ndarray, lists: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs (upper triangle) this bucket has to compare: no lesser bucket has both, and the sizes allow it."""
    m = len(n)
    own = np.triu(np.ones((m, m), bool), 1)
    if bi != bj:
        own &= blk[:, None] != blk[None]
    own &= np.minimum(n[:, None], n[None]) >= threshold * np.maximum(n[:, None], n[None]) - 1e-9
    less = [x[x < bucket] for x in lists]
    return own & (_common(less) == 0) if own.any() else own


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two of the sets share."""
    m = len(sets)
    if max(map(len, sets)) >= 1 << 24:
        both = np.zeros((m, m), np.int64)
        for i in range(m):
            for j in range(i + 1, m):
                both[i, j] = both[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return both
    if m == 2:
        x = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[0, x], [x, 0]])
    out = np.zeros((m, m), np.float32)  # exact below 2**24
    flat = np.concatenate(sets)
    if not len(flat):
        return out
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    column = np.cumsum(np.diff(flat, prepend=flat[0]) != 0)
    often = np.bincount(column)[column] > 1  # what only one set holds is shared by none
    owner, column = owner[often], column[often]
    if not len(column):
        return out
    column = np.cumsum(np.diff(column, prepend=column[0]) != 0)
    for a in range(0, int(column[-1]) + 1, _COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + _COLUMNS])
        x = np.zeros((m, min(_COLUMNS, int(column[-1]) + 1 - a)), np.float32)
        x[owner[lo:hi], column[lo:hi] - a] = 1
        out += x @ x.T
    return out


class _Found:
    """Links by class and a spanning forest, gathered over the groups of a task and given out now and then."""

    MOST = 50_000

    def __init__(self) -> None:
        self.links: dict[int, int] = {}
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(p, p)
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def add(self, sig: np.ndarray, mult: np.ndarray, linked: np.ndarray) -> None:
        """``linked``: the upper triangle of the linked pairs."""
        both = linked | linked.T
        some = np.flatnonzero(both.any(axis=1))
        if not len(some):
            return
        for s, n in zip(sig[some].tolist(), (both[some] @ mult).tolist(), strict=True):
            self.links[s] = self.links.get(s, 0) + int(n)
        names = sig.tolist()
        left = set(some.tolist())
        while left:  # one walk over each component of this group
            todo = [left.pop()]
            while todo:
                i = todo.pop()
                for j in np.flatnonzero(both[i]).tolist():
                    if j in left:
                        left.discard(j)
                        self.link(names[i], names[j])
                        todo.append(j)

    def full(self) -> bool:
        return len(self.links) > self.MOST

    def rows(self) -> pa.RecordBatch:
        """(sig, links, other): a sum where ``other`` is null, else an edge."""
        edges = [(x, self.root(x)) for x in list(self.parent)]
        edges = [(a, b) for a, b in edges if a != b]
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array([*self.links, *(a for a, _ in edges)], pa.int64()),
                pa.array([*self.links.values(), *([None] * len(edges))], pa.int64()),
                pa.array([*([None] * len(self.links)), *(b for _, b in edges)], pa.int64()),
            ],
            names=["sig", "links", "other"],
        )
        self.links, self.parent = {}, {}
        return batch


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.asarray(x, dtype=np.int64) for x in column.to_numpy()]


def _candidates(blocks: DataFrame, threshold: float) -> DataFrame:
    """The members that have a pair to compare: (bucket, bi, bj, sig). ``blocks``: also blk, n and the class's buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        for t in _grouped(batches, 3):
            bucket, bi, bj = (t.column(i)[0].as_py() for i in range(3))
            own = _owned(bucket, t.column(3).to_numpy(), bi, bj, t.column(5).to_numpy(), _arrays(t.column(6)), threshold)
            need = np.flatnonzero(own.any(axis=0) | own.any(axis=1))
            for c, v in zip(held, ([bucket] * len(need), [bi] * len(need), [bj] * len(need), t.column(4).to_numpy()[need].tolist()), strict=True):
                c += v
            if len(held[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(held, kinds, strict=True)], names=names)
                held = [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(held, kinds, strict=True)], names=names)
        give_back()

    kinds, names = (pa.int64(), pa.int32(), pa.int32(), pa.int64()), ["bucket", "bi", "bj", "sig"]
    return blocks.select("bucket", "bi", "bj", "blk", "sig", "n", "lists").mapInArrow(run, "bucket long, bi int, bj int, sig long")


def _verified(blocks: DataFrame, threshold: float) -> DataFrame:
    """(sig, links, other) from (bucket, bi, bj, blk, sig, n, lists, mult, members), sorted by the first three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Found()
        for t in _grouped(batches, 3):
            bucket, bi, bj = (t.column(i)[0].as_py() for i in range(3))
            n = t.column(5).to_numpy()
            own = _owned(bucket, t.column(3).to_numpy(), bi, bj, n, _arrays(t.column(6)), threshold)
            if own.any():
                sets = [np.frombuffer(x, np.uint64) for x in t.column(8).to_pylist()]
                same, exact = _common(sets), np.array([len(x) for x in sets])
                linked = own & (same / np.maximum(exact[:, None] + exact[None] - same, 1) >= threshold)
                found.add(t.column(4).to_numpy(), t.column(7).to_numpy(), linked)
            if found.full():
                yield found.rows()
        yield found.rows()
        give_back()

    return blocks.select("bucket", "bi", "bj", "blk", "sig", "n", "lists", "mult", "members").mapInArrow(run, "sig long, links long, other long")


def _members(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sig, members) of the classes in ``wanted`` (doc_id, sig): their sets, read from one of their documents again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 0):
            w, at = textvec.words(b.column(0).to_pylist())
            sets = textvec.shingle_sets(w, at, SHINGLE)
            sig = b.column(1).to_pylist()
            keep = [i for i, s in enumerate(sets) if len(s) and signature(s) == sig[i]]
            yield pa.RecordBatch.from_arrays([pa.array([sig[i] for i in keep], pa.int64()), pa.array([sets[i].tobytes() for i in keep], pa.binary())], names=["sig", "members"])

    return docs.select("doc_id", "text").join(wanted, "doc_id").select("text", "sig").mapInArrow(run, "sig long, members binary").dropDuplicates(["sig"])


def compare(found: DataFrame, known: DataFrame, fetch: Callable[[DataFrame], DataFrame], threshold: float, folder: str | None = None) -> DataFrame:
    """(sig, links, other) of all pairs that share a bucket: sums of links where ``other`` is null, else edges.

    ``found``: (bucket, sig, blocks). ``known``: (sig, n, mult, lists), the sizes of the sets (or 1 where they are not
    known yet), their weights and their buckets in order. ``fetch`` gives (sig, members) for a table of ``sig``. ``folder``: where tables
    are stored."""
    parts = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj")

    known = known.select("sig", "n", "mult", "lists")
    near = stored(_candidates(dealt(_in_blocks(found).join(known, "sig")), threshold), "candidates", folder)
    members = fetch(stored(near.select("sig").distinct(), "wanted", folder))
    full = near.join(stored(members, "members", folder), "sig").join(known, "sig")
    large = found.where("blocks > 1").select("bucket", "blocks").distinct()
    n = F.coalesce("blocks", F.lit(1))
    full = full.join(small(stored(large, "large", folder)), "bucket", "left").withColumn("blk", F.pmod(F.xxhash64("sig"), n).cast("int"))
    return stored(_verified(dealt(full), threshold), "verified", folder)


def rooted(out: DataFrame) -> DataFrame:
    """(sig, root) of the classes with a link."""
    return components(out.where("other is not null").select(F.col("sig").alias("a"), F.col("other").alias("b"))).withColumnsRenamed({"node": "sig"})


def listed(found: DataFrame) -> DataFrame:
    """(sig, lists): the buckets of each class."""
    return found.groupBy("sig").agg(F.sort_array(F.collect_set("bucket")).alias("lists"))


def _linked(docs: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(doc_id, h, n_links, class_id, class_h) of each row: ``h`` is a hash of its text, and the class the least (doc_id, h) that links
    reach; nulls for rows that can't link."""
    rows = stored(prepare(docs, threshold, runs_needed(recall)), "paths")
    known = rows.where("sig is not null")
    classes = stored(known.groupBy("sig").agg(F.count("*").alias("mult"), F.min(F.struct("doc_id", "h")).alias("first"), F.min("n").alias("n")).select("*", "first.doc_id"), "classes")
    found = stored(buckets(rows), "buckets")
    wide = stored(listed(found).join(classes.drop("first"), "sig"), "known")
    out = compare(found, wide, lambda wanted: _members(docs, small(stored(wanted.join(classes, "sig").select("doc_id", "sig"), "sources"))), threshold)
    links = out.where("other is null").groupBy("sig").agg(F.sum("links").alias("links"))
    least = stored(classes.join(rooted(out), "sig").select("sig", "root", "first"), "rooted")
    named = least.join(least.groupBy("root").agg(F.min("first").alias("head")), "root").select("sig", "head")
    per_class = classes.join(links, "sig", "left").join(named, "sig", "left").select("sig", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("head", "first").alias("head"))
    per_class = stored(per_class.where("n_links > 0").select("sig", "n_links", F.col("head.doc_id").alias("class_id"), F.col("head.h").alias("class_h")), "linked")
    return rows.select("doc_id", "h", "sig").join(small(per_class), "sig", "left").drop("sig")


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, n_links, class_id, kept) of each document.

    ``n_links``: other documents at least ``threshold`` similar. ``class_id``: the least id reachable by links, the own
    one included. ``kept``: whether it is that document."""
    own = F.coalesce("class_id", "doc_id")
    return _linked(docs, threshold, recall).select("doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("class_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The documents, with all their columns, without those that are linked, directly or not, with one of a lesser id.

    Rows are told apart by their id and text, so that of rows that repeat an id only those go whose text has a lesser one; rows that
    repeat both stay once."""
    result = stored(_linked(docs, threshold, recall).where("n_links > 0").withColumn("stays", (F.col("doc_id") == F.col("class_id")) & (F.col("h") == F.col("class_h"))), "joined")
    text_hash = F.xxhash64("text")
    gone = small(stored(result.where("not stays").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct(), "gone"))
    is_gone = lambda df: (df["doc_id"] == gone["_id"]) & (text_hash == gone["_h"])
    rest = docs.join(gone, is_gone(docs), "left_anti").select(*docs.columns)
    again = stored(result.where("stays").groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).count().where("count > 1").select("_id", "_h"), "again")
    if again.isEmpty():
        return rest
    again = small(again)
    same = (rest["doc_id"] == again["_id"]) & (text_hash == again["_h"])
    once = rest.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return rest.join(again, same, "left_anti").select(*docs.columns).unionAll(once.select(*docs.columns))
