"""Exact top-k search by inner product with dual cover trees.

Components become integers, ``floor(SCALE * x)``. The top of both trees is shared: landmarks, chosen by farthest-first traversal of a bounded
sample, to the nearest of which every vector belongs, queries and candidates alike; a landmark's vectors are dealt in blocks of
bounded size. Below that, each task builds a cover tree over its block and one over its queries: a node's children are picked by farthest-first
traversal from the node's own centre, so that they lie as far apart as the radius that they cover. No inner product between two nodes exceeds
``<a,b> + |a| rb + |b| ra + ra rb`` for centres a, b and covering radii ra, rb.

1. Each query searches one block of its own landmark, which gives it a k-th score.
2. The pairs of landmarks whose bound falls below the worst k-th score of the queries at the first are pruned; the others are searched, and
   within a block pairs of nodes are pruned likewise, against the worst k-th score of the query node as it stands.
   Ties are never pruned. Leaves are compared by products of matrices, exactly: in doubles below 2**53, in Python integers above.
3. What a block found for a query is cut to the k best again.

Of equal vectors only those with the k + 1 smallest ids can be in any result (a query may be one of them), so only they are candidates; a hot vector
is cut to that within each task before it is shuffled. Results are exact for any sample, block size and pruning.

Defined results: vectors that are null, empty, or hold null or non-finite components and rows with a null id take no part. Vectors are
compared within their length. Rows that repeat id and vector count once; an id with several vectors is a query with each, and none of them
is a candidate of its own id. Scores beyond 64 bits, and components beyond them, are set to the ends of their range.
Ties go to the smaller id. An empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chosenpath import _grouped
from .shared import stored

K, EVERY, SCALE = 10, 100, 1024
#: Landmarks and the sample that they are chosen from, the latter in bytes too; rows of a block and queries of a pack.
LANDMARKS, SAMPLE, SAMPLE_BYTES = 1024, 8192, 32 << 20
LEAST_BLOCK, MOST_BLOCK, BLOCKS, PACK = 4096, 65_536, 32, 16_384
FAN, LEAF, QUERY_LEAF, SLACK, EXACT = 16, 256, 32, 1e-9, float(1 << 53)


def farthest_first(x: np.ndarray, most: int, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to ``most`` centres, each the farthest from those before it: their places, each row's centre, and its distance to it."""
    centers = [first]
    away = np.sqrt(((x - x[first]) ** 2).sum(axis=1))
    mine = np.zeros(len(x), np.int64)
    while len(centers) < most:
        k = int(away.argmax())
        if away[k] <= 0:
            break
        d = np.sqrt(((x - x[k]) ** 2).sum(axis=1))
        mine[d < away] = len(centers)
        np.minimum(away, d, out=away)
        centers.append(k)
    return np.array(centers), mine, away


@dataclass
class Tree:
    """A cover tree as arrays: ``order`` are the rows so that a node's are ``order[start:end]``; leaves have no children."""

    order: np.ndarray
    center: np.ndarray
    norm: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    end: np.ndarray
    children: list[np.ndarray]

    @classmethod
    def of(cls, x: np.ndarray, leaf: int) -> Tree:
        order = np.empty(len(x), np.int64)
        center, radius, start, end, children = [], [], [], [], []
        middle = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
        waiting = [(np.concatenate([[middle], np.delete(np.arange(len(x)), middle)]), 0, -1)]  # rows with the centre first, where they begin, parent
        while waiting:
            rows, at, parent = waiting.pop()
            node = len(center)
            if parent >= 0:
                children[parent].append(node)
            center.append(x[rows[0]])
            start.append(at)
            end.append(at + len(rows))
            children.append([])
            picked, mine, away = farthest_first(x[rows], FAN if len(rows) > leaf else 1)
            radius.append(float(np.sqrt(((x[rows] - x[rows[0]]) ** 2).sum(axis=1)).max()) if len(picked) > 1 else float(away.max()))
            if len(picked) == 1:
                order[at : at + len(rows)] = rows
                continue
            for k in range(len(picked)):
                own = np.flatnonzero(mine == k)
                own = np.concatenate([picked[k : k + 1], own[own != picked[k]]])
                waiting.append((rows[own], at, node))
                at += len(own)
        c = np.array(center)
        return cls(order, c, np.sqrt((c * c).sum(axis=1)), np.array(radius), np.array(start), np.array(end), [np.array(k, np.int64) for k in children])


def bounds(a: np.ndarray, na: np.ndarray, ra: np.ndarray, b: np.ndarray, nb: np.ndarray, rb: np.ndarray) -> np.ndarray:
    """No inner product between members of the nodes exceeds these: a row for each of ``a``, a column for each of ``b``; with room for rounding."""
    na, ra = na[:, None], ra[:, None]
    return a @ b.T + na * rb + ra * nb + ra * rb + SLACK * (na + ra) * (nb + rb)


def floor_of(score: float) -> float:
    """A double that is not above an integer score, which it may not hold exactly."""
    return float(score) if abs(score) < EXACT else float(score) - SLACK * abs(float(score))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in doubles where they fit, else as Python integers."""
    if not len(q) or not len(x) or float(np.abs(q.astype(np.float64)).max()) * float(np.abs(x.astype(np.float64)).max()) * q.shape[1] < EXACT:
        return q.astype(np.float64) @ x.astype(np.float64).T
    return q.astype(object) @ x.astype(object).T


def search(q: np.ndarray, own: np.ndarray, least: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """For each query row the k best candidates of another id as (-score, id), of those with no less than the score in ``least`` (-inf: all)."""
    qt, xt = Tree.of(q.astype(np.float64), QUERY_LEAF), Tree.of(x.astype(np.float64), LEAF)
    q, own, x, ids = q[qt.order], own[qt.order], x[xt.order], ids[xt.order]
    kth = least[qt.order].astype(np.float64)
    best: list[list[tuple[int, int]]] = [[] for _ in range(len(q))]

    def leaves(a: int, b: int) -> None:
        lo, to = xt.start[b], xt.end[b]
        rows = np.arange(qt.start[a], qt.end[a])
        s = products(q[rows], x[lo:to])
        hit = (s >= kth[rows][:, None]) & (own[rows][:, None] != ids[lo:to][None])
        for i in np.flatnonzero(hit.any(axis=1)).tolist():
            at = np.flatnonzero(hit[i])
            if len(at) > 2 * k:
                edge = np.sort(s[i, at])[-k]
                at = at[s[i, at] >= edge]
            r = int(rows[i])
            best[r] = heapq.nsmallest(k, best[r] + [(-int(v), int(w)) for v, w in zip(s[i, at].tolist(), ids[lo + at].tolist(), strict=True)])
            if len(best[r]) == k:
                kth[r] = max(kth[r], floor_of(-best[r][-1][0]))

    waiting = [(0, 0, np.inf)]
    while waiting:
        a, b, bound = waiting.pop()
        if bound < kth[qt.start[a] : qt.end[a]].min():
            continue
        down_a, down_b = len(qt.children[a]), len(xt.children[b])
        if not down_a and not down_b:
            leaves(a, b)
            continue
        split_b = down_b and (not down_a or xt.radius[b] >= qt.radius[a])
        aa, bb = (np.array([a]), xt.children[b]) if split_b else (qt.children[a], np.array([b]))
        limit = bounds(qt.center[aa], qt.norm[aa], qt.radius[aa], xt.center[bb], xt.norm[bb], xt.radius[bb])
        pairs = sorted((float(limit[i, j]), int(aa[i]), int(bb[j])) for i in range(len(aa)) for j in range(len(bb)))
        waiting += [(i, j, v) for v, i, j in pairs]  # the most promising is taken next
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(q))]
    for place, r in enumerate(qt.order.tolist()):
        out[r] = best[place]
    return out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def whole(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the integer vectors that take part."""
    finite = lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False))
    fit = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", finite)
    number = lambda x: F.floor(F.greatest(F.lit(-9.3e18), F.least(F.lit(9.3e18), x.cast("double") * scale)))
    return vectors.where(fit).select("vec_id", F.transform("embedding", number).alias("v"))


def _landed(rows: DataFrame, landmarks: np.ndarray) -> DataFrame:
    """``rows`` with the nearest landmark and the distance to it."""
    held = rows.sparkSession.sparkContext.broadcast(landmarks)
    at = rows.columns.index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for big in batches:
            for a in range(0, big.num_rows, 1024):
                b = big.slice(a, 1024)
                x = _matrix(b.column(at)).astype(np.float64)
                d = (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None]
                land = d.argmin(axis=1)
                away = np.sqrt(((x - c[land]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(land, pa.int32()), pa.array(away)], names=[*b.schema.names, "land", "away"])

    return rows.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, land int, away double")


def _of(subs: dict[int, int], land: str = "land") -> Column:
    """In how many blocks the candidates of a row's landmark are dealt."""
    return F.coalesce(F.try_element_at(F.array(*(F.lit(subs.get(i, 1)) for i in range(max(subs, default=0) + 1))), F.col(land) + 1), F.lit(1))


def _searched(data: DataFrame, queries: DataFrame, subs: dict[int, int], packs: int, k: int) -> DataFrame:
    """(q, query_id, vec_id, score) from the blocks (land, sub) that the rows of ``queries`` name in ``target`` and ``sub``."""
    side = data.select("land", F.pmod(F.xxhash64("vec_id"), _of(subs)).cast("int").alias("sub"), F.lit(None).cast("long").alias("q"), "vec_id", "v", F.lit(None).cast("double").alias("least"))
    side = side.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))
    asked = queries.select(F.col("target").alias("land"), "sub", "q", "vec_id", "v", "least", F.pmod(F.xxhash64("q"), F.lit(packs)).cast("int").alias("pack"))
    names = ["land", "sub", "pack", "q", "vec_id", "v", "least"]
    dealt = side.select(*names).unionByName(asked.select(*names)).repartition("land", "sub", "pack").sortWithinPartitions("land", "sub", "pack")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, 3):
            asks = t.column(3).is_valid().to_numpy()
            if asks.all() or not asks.any():
                continue
            v, ids = _matrix(t.column(5)), t.column(4).to_numpy()
            least = np.array([-np.inf if np.isnan(s) else floor_of(s) for s in t.column(6).to_numpy()[asks].tolist()])
            found = search(v[asks], ids[asks], least, v[~asks], ids[~asks], k)
            n = [len(x) for x in found]
            q = np.repeat(pc.fill_null(t.column(3), -1).to_numpy()[asks], n)
            rows = [(w, max(-(1 << 63), min((1 << 63) - 1, -s))) for x in found for s, w in x]
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(np.repeat(ids[asks], n), pa.int64()), pa.array([w for w, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.int64())], names=["q", "query_id", "vec_id", "score"])

    return dealt.mapInArrow(run, "q long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each row whose id is divisible by ``every``."""
    rows = stored(whole(vectors, scale), "whole")
    same = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("r", F.dense_rank().over(same)).where(F.col("r") <= k + 1).dropDuplicates(["v", "vec_id"]).select("vec_id", "v")
    asked = stored(rows.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0).dropDuplicates(["v", "vec_id"]).select(F.monotonically_increasing_id().alias("q"), "vec_id", "v"), "asked")
    few = stored(few, "candidates")
    out = None
    for dim, n in sorted((r["dim"], r["n"]) for r in few.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()):
        part = _of_length(few.where(F.size("v") == dim), asked.where(F.size("v") == dim), dim, n, k)
        out = part if out is None else out.unionAll(part)
    if out is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).where("false")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return stored(out, "best").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _of_length(few: DataFrame, asked: DataFrame, dim: int, n: int, k: int) -> DataFrame:
    block = min(MOST_BLOCK, max(LEAST_BLOCK, n // BLOCKS))
    some = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    share = int(min(1.0, 2 * some / n) * ((1 << 30) - 1))
    sample = few.where(F.pmod(F.xxhash64("v", "vec_id"), F.lit(1 << 30)) <= share).select("v").limit(some).toArrow()
    x = _matrix(sample.column(0)).astype(np.float64)
    x = x[np.lexsort(x.T[::-1])] if len(x) else x  # the same landmarks whatever order the rows came in
    picked = farthest_first(x, min(LANDMARKS, SAMPLE_BYTES // (8 * dim), -(-n // block)))[0] if len(x) else []
    landmarks = x[picked] if len(x) else np.zeros((1, dim))
    data, queries = stored(_landed(few, landmarks), "landed"), stored(_landed(asked, landmarks), "queries")
    here = {r["land"]: (r["n"], r["far"]) for r in data.groupBy("land").agg(F.count("*").alias("n"), F.max("away").alias("far")).collect()}
    subs = {i: -(-m // block) for i, (m, _) in here.items()}
    packs = 1 + queries.count() // PACK
    own = queries.withColumn("own", F.pmod(F.xxhash64("q"), _of(subs)).cast("int")).withColumn("least", F.lit(None).cast("double"))
    first = stored(_searched(data, own.select("q", "vec_id", "v", F.col("land").alias("target"), F.col("own").alias("sub"), "least"), subs, packs, k), "first")
    known = first.groupBy("q").agg(F.count("*").alias("m"), F.min("score").alias("least")).where(F.col("m") >= k).select("q", F.col("least").cast("double").alias("known"))
    told = stored(own.drop("least").join(known, "q", "left").withColumnRenamed("known", "least"), "told")
    groups = told.groupBy("land").agg(F.max("away").alias("far"), F.min("least").alias("worst"), F.count_if(F.col("least").isNull()).alias("open")).collect()
    there = np.array(sorted(here), np.int64)
    far = np.array([here[i][1] for i in there.tolist()])
    norm = np.sqrt((landmarks * landmarks).sum(axis=1))
    targets = []
    for g in groups:
        i = np.array([g["land"]])
        limit = bounds(landmarks[i], norm[i], np.array([g["far"]]), landmarks[there], norm[there], far)[0]
        worst = -np.inf if g["open"] else g["worst"]
        targets.append((g["land"], there[limit >= worst].tolist()))
    if not any(t != [i] or subs[i] > 1 for i, t in targets):
        return first
    plan = few.sparkSession.createDataFrame(targets, "land int, targets array<int>")  # LANDMARKS squared at most
    more = told.join(F.broadcast(plan), "land").withColumn("target", F.explode("targets"))
    more = more.withColumn("sub", F.explode(F.sequence(F.lit(0), _of(subs, "target") - 1))).where((F.col("target") != F.col("land")) | (F.col("sub") != F.col("own")))
    return first.unionAll(_searched(data, more, subs, packs, k))


ORACLE = """
WITH known AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM known q JOIN known c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""
