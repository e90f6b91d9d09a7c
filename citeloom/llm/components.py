"""Connected components of a graph given as an edge table, by alternating large-star and small-star rounds.

Edges never come to the driver and no group is collected: each round is two aggregations and joins, stored
in the shared folder so that lineage stays short and lost executors cost one round. A hub's edges are one minimum
and one join, whose skewed side Spark may split. The number of rounds grows with the logarithm of the
longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

MAX_ROUNDS = 64


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to the least of it and them: the greater neighbours, or the lesser ones and itself."""
    if large:
        near = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        linked = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        linked = down.join(least, "a").select("b", "m").unionAll(least.select(F.col("a").alias("b"), "m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge: the least node that it is linked with. ``edges`` are (a, b) of longs."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        now = stored(_star(_star(now, True), False), "edges")
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError(f"components: no fixed point after {MAX_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
