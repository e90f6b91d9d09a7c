"""Mixing sources to target weights, with DataFrame functions only.

Documents get a hash that orders them at random but reproducibly. A source that is to give ``t`` words of its
``S`` gives every document ``floor(t / S)`` times and once more those whose hash is at most its cut. The cut comes
from histograms: words by source and the leading bits of the hash, then again inside the one bucket that holds the
budget's end, until the bits are used up. No document is sorted, and each pass but the first reads one bucket.

Defined results: a null text has size 0; a null source is a source of its own, last in order; rows that repeat an
id share its hash and are taken or left together; a row with a null id is hashed by its text. An empty table gives
an empty mix. Columns beside the named ones are neither read nor kept by ``plan_mix``; ``apply_mix`` keeps them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import small, stored

#: What separates words.
SPACES = "\\x20\\x09-\\x0D"
#: Bits of a hash, and how many of them are dropped in each histogram.
HASH_BITS, SHIFTS = 60, (48, 36, 24, 0)
#: A source gives at most so many times its own words.
MOST = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def order_hash(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of the MD5 of the id (of the text's, for a null id)."""
    key = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, hash) of each document."""
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), order_hash(F.col("doc_id"), F.col("text")).alias("hash"))


def targets(sizes: DataFrame, cycle: int = 3, most: int = MOST) -> DataFrame:
    """From (source, source_size): the words that each source is to give.

    Weights are 1, 2, .., ``cycle``, again 1, .. in the order of the sources. All words together are shared by
    weight; who would give more than ``most`` times its own words gives just that, and the rest is shared again.
    That ends where everyone below its limit gets the same per unit of weight, so it is enough to try the sources
    in the order in which they reach their limits."""
    everyone = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("weight"), F.col("place"))
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("place", F.row_number().over(by_name)).withColumn("weight", ((F.col("place") - 1) % cycle + 1).cast("long"))
    level = ranked.select(
        "source",
        "source_size",
        "weight",
        F.row_number().over(by_limit).alias("rank"),
        (
            (F.sum("source_size").over(everyone) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))).cast("double")
            / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double")
        ).alias("level"),
    )
    below = F.col("level") * F.col("weight") <= most * F.col("source_size")
    first = level.withColumn("free", F.min(F.when(below, F.col("rank"))).over(everyone))
    shared = F.max(F.when(F.col("rank") == F.col("free"), F.col("level"))).over(everyone)
    limit = (most * F.col("source_size")).cast("double")
    return first.select("source", "source_size", F.when(F.col("rank") < F.col("free"), limit).otherwise(shared * F.col("weight")).alias("target"))


def cuts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """From (source, size, hash) and (source, source_size, target): also ``full`` and ``cut``.

    Every document is given ``full`` times and once more if its hash is at most ``cut``. The last hash is
    taken if its documents bring the sum nearer to the target than it would be without them."""
    size = F.col("source_size")
    state = wanted.select(
        "*",
        F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long").alias("full"),
        F.lit(0).cast("long").alias("bucket"),
        F.lit(0).cast("long").alias("given"),
        F.lit(-1).cast("long").alias("cut"),
    ).withColumn("rest", F.col("target") - F.col("full") * size)
    last = HASH_BITS
    for shift in SHIFTS:
        edge = small(stored(state, "mix-state"))
        inside = rows.alias("r").join(edge.alias("e"), F.col("r.source").eqNullSafe(F.col("e.source")) & (F.shiftright("r.hash", last) == F.col("e.bucket")))
        sums = inside.groupBy(F.col("r.source").alias("source"), F.shiftright("r.hash", shift).alias("part")).agg(F.sum("r.size").alias("words"))
        ordered = Window.partitionBy("s.source").orderBy("s.part").rowsBetween(Window.unboundedPreceding, -1)
        run = sums.alias("s").join(edge.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source"))).select("s.*", F.col("e.given").alias("given"), F.col("e.rest").alias("rest"), (F.col("e.given") + F.coalesce(F.sum("s.words").over(ordered), F.lit(0))).alias("before"))
        if shift:
            over = F.col("before") + F.col("words") > F.col("rest")
            found = run.where(over).groupBy("source").agg(F.min(F.struct("part", "before")).alias("at")).select("source", F.col("at.part").alias("part"), F.col("at.before").alias("before"))
            state = edge.alias("e").join(found.alias("f"), F.col("e.source").eqNullSafe(F.col("f.source")), "left").select(
                "e.source", "e.source_size", "e.target", "e.full", "e.rest",
                F.coalesce("f.part", F.lit(-1).cast("long")).alias("bucket"),
                F.coalesce("f.before", "e.given").alias("given"),
                F.when(F.col("f.part").isNotNull(), F.shiftleft("f.part", shift) - 1).otherwise(F.col("e.cut")).alias("cut"),
            )
            last = shift
        else:
            nearer = 2 * F.col("before") + F.col("words") <= 2 * F.col("rest")
            found = run.where(nearer).groupBy("source").agg(F.max("part").alias("part"))
            state = edge.alias("e").join(found.alias("f"), F.col("e.source").eqNullSafe(F.col("f.source")), "left").select("e.source", "e.source_size", "e.target", "e.full", F.coalesce("f.part", "e.cut").alias("cut"))
    return stored(state, "mix-cuts")


def plan_mix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents as (doc_id, source, size, hash), and (source, source_size, target, full, cut)."""
    rows = stored(sized(docs), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return rows, cuts(rows, stored(targets(sizes), "mix-targets"))


def _copies() -> Column:
    """A source whose whole copies reach the target gives no further one, not even of documents without words."""
    more = (F.col("d.hash") <= F.col("c.cut")) & (F.col("c.target") > F.col("c.full") * F.col("c.source_size"))
    return F.col("c.full") + more.cast("long")


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of each document."""
    rows, plan = plan_mix(docs)
    joined = rows.alias("d").join(small(plan).alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")))
    return joined.select("d.doc_id", "d.size", "c.source_size", "c.target", (F.col("d.size") * _copies()).alias("taken"), _copies().alias("copies"))


def apply_mix(docs: DataFrame) -> DataFrame:
    """The documents themselves, with all their columns, each as many times as the mix takes it."""
    _, plan = plan_mix(docs)
    hashed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("source"), order_hash(F.col("doc_id"), F.col("text")).alias("hash"))
    joined = hashed.alias("d").join(small(plan).alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")))
    times = F.explode(F.array_repeat(F.lit(0), _copies().cast("int")))
    return joined.select(F.col("d.row").alias("row"), times.alias("copy")).select("row.*")


ORACLE = """
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 15)) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
w2 AS (SELECT *, CAST((place - 1) % 3 + 1 AS BIGINT) AS weight FROM w),
lv AS (
  SELECT *, row_number() OVER o AS rank,
         CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM w2 WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / weight, weight, place)),
f AS (SELECT *, min(CASE WHEN level * weight <= 3 * source_size THEN rank END) OVER () AS free FROM lv),
g AS (SELECT *, max(CASE WHEN rank = free THEN level END) OVER () AS shared FROM f),
t AS (SELECT source, source_size, CASE WHEN rank < free THEN CAST(3 * source_size AS DOUBLE) ELSE shared * weight END AS target FROM g),
t2 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS "full" FROM t),
hs AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
hc AS (SELECT source, h, words, coalesce(sum(words) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM hs),
c AS (SELECT d.doc_id, d.size, t2.source_size, t2.target,
             t2."full" + CASE WHEN 2 * CAST(hc.before AS DOUBLE) + CAST(hc.words AS DOUBLE) <= 2 * (t2.target - t2."full" * t2.source_size) THEN 1 ELSE 0 END AS copies
      FROM d JOIN t2 ON d.source IS NOT DISTINCT FROM t2.source
             JOIN hc ON d.source IS NOT DISTINCT FROM hc.source AND d.h = hc.h)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken FROM c
"""
