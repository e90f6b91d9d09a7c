"""Embedding near-dedup with an inverted multi-index.

Unit vectors are split in halves. Each half has a codebook (its size follows the number of vectors), fitted independently by k-means to
a bounded sample (``sample_for``, in the order of a hash of the components); the pairs of centroids are the cells
of a product grid, and every vector lies in one. A query visits cells by the multi-sequence order: ascending sum of
the squared distances of its halves to the two centroids. How many cells it visits comes from a calibration on
pairs planted at exactly the threshold's angle: as many as let one of the two find the other in ``RECALL`` of them.
Members of the visited cells are verified by their cosine in double precision.

All vectors are queries. Vectors of equal components form a class, of which one is indexed; its copies are
counted. A query goes once to each row of the grid that it visits, with the columns that it visits there; rows with many
members or queries are dealt in blocks (``BLOCK``, ``QUERIES``), so that no task holds an unbounded group. A pair that only one of the two
finds is counted for both. What comes out are sums and a spanning forest per task, not pairs.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing and stay; vectors of
different lengths are compared within their length only. Rows with a null id are left out of links; rows that
repeat an id count as vectors of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chosenpath
from .shared import small, stored

THRESHOLD, ROUNDS, RECALL, PROBES, BLOCK, QUERIES, SEED = 0.9, 12, 0.995, 1_000, 2048, 16_384, 5
#: The sample that is fitted: so many vectors a centroid, but ``SAMPLE`` at least, and no more bytes than fit the driver.
LEAST_CODES, PER_CODE, SAMPLE, SAMPLE_BYTES = 8, 16, 20_000, 128 << 20


def codes_for(n: int, dim: int = 1) -> int:
    """Centroids in each codebook for ``n`` vectors: some dozens of vectors a cell on average, as far as the largest sample can tell
    centroids apart."""
    most = max(LEAST_CODES, SAMPLE_BYTES // (8 * dim) // PER_CODE)
    return int(min(most, max(LEAST_CODES, 2 ** round(np.log2(max(n, 1) ** 0.5 / 8)))))


def sample_for(codes: int, dim: int) -> int:
    """How many vectors are fitted."""
    return max(1, min(max(SAMPLE, PER_CODE * codes), SAMPLE_BYTES // (8 * dim)))


def units(raw: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; the greatest component goes first so that squares neither overflow nor vanish."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def kmeans(x: np.ndarray, k: int) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([sq_distances(x[a : a + 4096], centers).argmin(axis=1) for a in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def sq_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1)[None], 0)


class Index:
    """The two codebooks and the number of cells that a query visits."""

    def __init__(self, sample: np.ndarray, codes: int, threshold: float) -> None:
        self.half = sample.shape[1] // 2
        self.books = (kmeans(sample[:, : self.half], codes), kmeans(sample[:, self.half :], codes))
        self.columns = len(self.books[1])
        rng = np.random.default_rng(SEED + 1)
        q = sample[rng.integers(0, len(sample), PROBES)]
        away = rng.normal(size=q.shape)
        away -= (away * q).sum(axis=1)[:, None] * q
        away /= np.maximum(np.sqrt((away * away).sum(axis=1)), 1e-300)[:, None]
        planted = threshold * q + np.sqrt(max(0.0, 1 - threshold**2)) * away
        self.visits = int(np.quantile(np.minimum(self.places(q, planted), self.places(planted, q)), RECALL, method="higher")) + 1

    def _tables(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return sq_distances(x[:, : self.half], self.books[0]), sq_distances(x[:, self.half :], self.books[1])

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self._tables(x)
        return a.argmin(axis=1) * self.columns + b.argmin(axis=1)

    def places(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many cells come before the cell of ``y`` in the multi-sequence order of ``x``, row by row. They are counted, not listed:
        for each centroid of one half those of the other whose sum with it is less."""
        a, b = self._tables(x)
        cell = self.cells(y)
        out = np.empty(len(x), np.int64)
        for k in range(len(x)):
            i, j = divmod(int(cell[k]), self.columns)
            out[k] = np.searchsorted(np.sort(b[k]), a[k, i] + b[k, j] - a[k], "left").sum()
        return out

    def visited(self, x: np.ndarray) -> list[np.ndarray]:
        """For each query the cells that it visits, by multi-sequence traversal: both lists of centroids are sorted, and of
        the ``i``-th and ``j``-th nearest only those with (i+1)*(j+1) <= visits can be among the first ``visits``."""
        a, b = self._tables(x)
        i, j = np.meshgrid(np.arange(a.shape[1]), np.arange(b.shape[1]), indexing="ij")
        near = (i + 1) * (j + 1) <= self.visits
        i, j = i[near], j[near]
        oa, ob = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
        total = np.take_along_axis(a, oa, axis=1)[:, i] + np.take_along_axis(b, ob, axis=1)[:, j]
        first = np.argsort(total, axis=1, kind="stable")[:, : self.visits]
        cells = oa[:, i] * self.columns + ob[:, j]
        return list(np.sort(np.take_along_axis(cells, first, axis=1), axis=1))


def _vectors(table: DataFrame) -> tuple[DataFrame, np.dtype]:
    """(vec_id, sig, dim, raw): null ``sig`` for what can't be compared; ``raw`` are the components' bytes as they are."""
    kind = np.dtype(np.float32 if table.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64)
    names = ["vec_id", "sig", "dim", "raw"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw: list[bytes | None] = []
            known = b.column(0).is_valid().to_pylist()
            for v, k in zip(b.column(1), known, strict=True):
                x = v.values.to_numpy(zero_copy_only=False).astype(kind) if k and v.is_valid and not v.values.null_count else None
                raw.append((x + kind.type(0)).tobytes() if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
            sig = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) if x else None for x in raw]
            dim = [len(x) // kind.itemsize if x else None for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sig, pa.int64()), pa.array(dim, pa.int32()), pa.array(raw, pa.binary())], names=names)

    schema = f"vec_id {table.schema['vec_id'].dataType.simpleString()}, sig long, dim int, raw binary"
    return table.select("vec_id", "embedding").mapInArrow(run, schema), kind


def _placed(classes: DataFrame, index: Index, kind: np.dtype) -> DataFrame:
    """(row, query, sig, mult, raw, cell, cells): each class once as a member, and once as a query for each row it visits.

    ``cells``: of a member, all cells that it visits itself; of a query, those that it visits in this row."""
    held = classes.sparkSession.sparkContext.broadcast(index)
    names = ["row", "query", "sig", "mult", "raw", "cell", "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = held.value
        for big in batches:
            for a in range(0, big.num_rows, 256):
                b = big.slice(a, 256)
                x = units(np.frombuffer(b"".join(b.column(2).to_pylist()), kind).reshape(b.num_rows, -1))
                cell, seen = ix.cells(x), ix.visited(x)
                at, row, query, cells = [], [], [], []
                for i, v in enumerate(seen):
                    rows = v // ix.columns
                    edge = [0, *(np.flatnonzero(np.diff(rows)) + 1).tolist(), len(v)]
                    at += [i] * len(edge)
                    row += [int(cell[i]) // ix.columns, *rows[edge[:-1]].tolist()]
                    query += [False, *[True] * (len(edge) - 1)]
                    cells += [v, *(v[s:e] for s, e in zip(edge[:-1], edge[1:], strict=True))]
                ends = pa.array(np.cumsum([0, *map(len, cells)]), pa.int32())
                at = pa.array(at, pa.int64())
                cols = [pa.array(row, pa.int32()), pa.array(query), *(b.column(i).take(at) for i in range(3)), pa.array(cell).take(at), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(cells)))]
                cols[3:5] = [b.column(1).take(at), b.column(2).take(at)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return classes.select("sig", "mult", "raw").mapInArrow(run, "row int, query boolean, sig long, mult long, raw binary, cell long, cells array<long>")


def _search(dealt: DataFrame, kind: np.dtype, threshold: float) -> DataFrame:
    """(sig, links, other) from groups of members and queries, sorted by (row, mb, qb)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = chosenpath._Found()
        for t in chosenpath._grouped(batches, 3):
            _compare(t, kind, threshold, found)
            if found.full():
                yield found.rows()
        yield found.rows()

    return dealt.select("row", "mb", "qb", "query", "sig", "mult", "raw", "cell", "cells").mapInArrow(run, "sig long, links long, other long")


def _compare(t: pa.Table, kind: np.dtype, threshold: float, found: chosenpath._Found) -> None:
    query = t.column(3).to_numpy()
    if query.all() or not query.any():
        return
    sig, mult, cell = (t.column(i).to_numpy() for i in (4, 5, 7))
    lists = t.column(8).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat, n_cells = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    first = np.cumsum(n_cells) - n_cells
    x = units(np.frombuffer(b"".join(t.column(6).to_pylist()), kind).reshape(len(sig), -1))
    member = np.flatnonzero(~query)
    owner = np.repeat(np.arange(len(sig)), n_cells)
    visits = query[owner]  # cells that queries visit, by cell; and the members by their own cell
    to, by = flat[visits], owner[visits]
    order = np.argsort(to, kind="stable")
    to, by = to[order], by[order]
    member = member[np.argsort(cell[member], kind="stable")]
    wide = 1 + max(int(cell.max()), int(flat.max(initial=0)))
    for c in np.unique(cell[member]).tolist():
        qs = by[np.searchsorted(to, c, "left") : np.searchsorted(to, c, "right")]
        if not len(qs):
            continue
        m = member[np.searchsorted(cell[member], c, "left") : np.searchsorted(cell[member], c, "right")]
        group = np.arange(len(m))
        n = n_cells[m]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[m], n)
        seen = np.sort(np.repeat(np.arange(len(m), dtype=np.int64), n) * wide + flat[place])
        for a in range(0, len(qs), 1024):
            q = qs[a : a + 1024]
            hit = (x[q] @ x[m].T >= threshold) & (sig[q][:, None] != sig[m][None])
            i, j = np.nonzero(hit)
            if not len(i):
                continue
            key = j * np.int64(wide) + cell[q][i]
            place = np.minimum(np.searchsorted(seen, key), len(seen) - 1)
            unseen = seen[place] != key  # the member does not find the query itself
            for s, n in ((sig[q], np.bincount(i, weights=mult[m][j], minlength=len(q))), (sig[m], np.bincount(j[unseen], weights=mult[q][i[unseen]], minlength=len(m)))):
                for k in np.flatnonzero(n).tolist():
                    found.links[int(s[k])] = found.links.get(int(s[k]), 0) + int(n[k])
            for k in np.flatnonzero(hit.any(axis=1)).tolist():
                near = np.unique(group[hit[k]])
                found.link(int(sig[q[k]]), int(sig[m[near[0]]]))
                if len(near) > 1:
                    for r in near[1:].tolist():
                        found.link(int(sig[m[near[0]]]), int(sig[m[r]]))
                    group[np.isin(group, near)] = near[0]


def _deal(placed: DataFrame) -> DataFrame:
    """Members and queries of a row in blocks: every block of members meets every block of queries once."""
    n = placed.groupBy("row").agg(F.ceil(F.count_if(~F.col("query")) / BLOCK).alias("nm"), F.ceil(F.count_if("query") / QUERIES).alias("nq"))
    n = small(stored(n.select("row", F.greatest("nm", F.lit(1)).cast("int").alias("nm"), F.greatest("nq", F.lit(1)).cast("int").alias("nq")), "blocks"))
    joined = placed.join(n, "row")
    own = lambda of: F.pmod(F.xxhash64("sig"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    rest = ["row", "query", "sig", "mult", "raw", "cell", "cells"]
    members = joined.where("not query").select(*rest, own("nm").alias("mb"), every("nq").alias("qb"))
    queries = joined.where("query").select(*rest, own("nq").alias("qb"), every("nm").alias("mb")).select(*rest, "mb", "qb")
    parts = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    return members.unionByName(queries).repartition(parts, "row", "mb", "qb").sortWithinPartitions("row", "mb", "qb")


def near_copies(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each vector."""
    found, kind = _vectors(vectors)
    rows = stored(found, "vectors")
    some = rows.where("sig is not null")
    classes = stored(some.groupBy("sig").agg(F.count("*").alias("mult"), F.min("vec_id").alias("vec_id"), F.min("dim").alias("dim"), F.min("raw").alias("raw")), "vector-classes")
    out = None
    for dim, n in sorted((r["dim"], r["n"]) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()):
        own = classes.where(F.col("dim") == dim)
        sample = np.frombuffer(b"".join(bytes(r["raw"]) for r in own.select("sig", "raw").orderBy("sig").limit(sample_for(codes_for(n, dim), dim)).collect()), kind).reshape(-1, dim)
        index = Index(units(sample), codes_for(n, dim), threshold)
        part = _search(_deal(stored(_placed(own, index, kind), "placed")), kind, threshold)
        out = part if out is None else out.unionAll(part)
    if out is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    out = stored(out, "vector-links")
    links = out.where("other is null").groupBy("sig").agg(F.sum("links").alias("links"))
    least = stored(classes.join(chosenpath.rooted(out), "sig").select("sig", "root", "vec_id"), "rooted")
    named = least.join(least.groupBy("root").agg(F.min("vec_id").alias("component_id")), "root").select("sig", "component_id")
    linked = classes.join(links, "sig", "left").join(named, "sig", "left").select("sig", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    joined = rows.select("vec_id", "sig").join(small(stored(linked, "vector-linked")), "sig", "left")
    own = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(True)).alias("kept"))


def measured_recall(vectors: DataFrame, found: DataFrame, every: int = 50, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(links found, links there are) of the vectors whose id is divisible by ``every``, by brute force over all vectors.

    The queries go to the executors in blocks of ``QUERIES``; nothing is joined. ``found`` is ``near_copies(vectors)``."""
    rows, kind = _vectors(vectors)
    rows = stored(rows.where("sig is not null"), "all-vectors")
    asked = rows.where(F.col("vec_id") % every == 0)
    total = 0
    parts = 1 + asked.count() // QUERIES
    for k in range(parts):
        some = asked.where(F.pmod(F.xxhash64("vec_id", "sig"), F.lit(parts)) == k).collect()
        by_dim: dict[int, list[bytes]] = {}
        for r in some:
            by_dim.setdefault(r["dim"], []).append(bytes(r["raw"]))
        held = vectors.sparkSession.sparkContext.broadcast({d: units(np.frombuffer(b"".join(x), kind).reshape(-1, d)) for d, x in by_dim.items()})

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            n = 0
            for big in batches:
                for a in range(0, big.num_rows, 256):
                    b = big.slice(a, 256)
                    dims = b.column(0).to_numpy()
                    for d in np.unique(dims).tolist():
                        if d in held.value:
                            raw = b.column(1).filter(pa.array(dims == d))
                            x = units(np.frombuffer(b"".join(raw.to_pylist()), kind).reshape(-1, d))
                            n += int((x @ held.value[d].T >= threshold).sum())
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

        total += rows.select("dim", "raw").mapInArrow(run, "n long").agg(F.sum("n").alias("n")).first()["n"] - len(some)
    got = found.where(F.col("vec_id") % every == 0).agg(F.coalesce(F.sum("n_links"), F.lit(0)).alias("n")).first()["n"]
    return got, total
