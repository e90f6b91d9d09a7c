"""Auditing papers as they arrive: a file stream of per-paper records, each batch upserted into tables, and roll-ups kept up by it.

State lives in the tables, not in the stream: an entry's row is replaced when its paper is audited again, so a batch
that runs twice leaves the same rows. Roll-ups are not recomputed: a batch adds the counts of its papers and takes away those that it replaces,
which it looks up among the counts of its own papers, and one commit for each batch carries the totals on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import textnorm as N
from ..operators import rollup, verify
from ..operators.mirror import latest
from ..sources import commits, papers

#: Parts into which the counts of papers are dealt by a hash, so that a batch reads those of its papers only.
PARTS = 64
FAILURES = {db: f"failed_{db.lower().replace(' ', '_')}" for db in verify.BACKENDS}
COUNTS = (*rollup.STATUSES, "pending", "retracted", "unverified", "degraded", "n_references", *FAILURES.values())
SCHEMA = "paper_id string, " + ", ".join(f"{c} long" for c in COUNTS) + ", part int"


def stream(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(papers.RECORD).option("multiLine", True).option("maxFilesPerTrigger", files_a_batch).json(path)


def audit(incoming: DataFrame, table: str, checkpoint: str, check: Callable[[DataFrame], DataFrame] = lambda refs: refs) -> StreamingQuery:
    """Append each batch's references, with the batch as their sequence number, to the log at ``table``, and carry the roll-ups on; stops
    when all files are read."""

    def add(batch: DataFrame, number: int) -> None:
        rows = check(papers.references(batch.where("paper_id is not null"))).withColumn("seq", F.lit(number))
        rows.write.mode("overwrite").parquet(f"{table}/rows/batch={number}")
        carry_on(batch.sparkSession.read.parquet(f"{table}/rows/batch={number}"), number, table)

    return incoming.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _part(paper: Column) -> Column:
    return F.pmod(F.xxhash64(paper), F.lit(PARTS)).cast("int")


def _counted(rows: DataFrame) -> DataFrame:
    """The counts of each paper in ``rows``."""
    own = rows.withColumn("failed_dbs", F.coalesce("failed_dbs", F.array().cast("array<string>"))) if "failed_dbs" in rows.columns else rows.withColumn("failed_dbs", F.array().cast("array<string>"))
    lacking = [c for c in ("retracted", "degraded") if c not in rows.columns]
    own = own.withColumns({c: F.lit(False) for c in lacking}) if lacking else own
    failed = own.groupBy("paper_id").agg(*(F.count_if(F.array_contains("failed_dbs", db)).alias(c) for db, c in FAILURES.items()))
    return rollup.status_counts(own).join(failed, "paper_id").select("paper_id", *COUNTS, _part(F.col("paper_id")).alias("part"))


def _sum(counts: DataFrame) -> dict[str, int]:
    return counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS)).first().asDict()


def replaced(spark: SparkSession, table: str, ids: list[str], parts: list[int]) -> DataFrame:
    """The counts in force of some papers, read from their parts only."""
    log = commits.log(spark, f"{table}/rollup", SCHEMA).where(F.col("part").isin(parts) & F.col("paper_id").isin(ids))
    return latest(log, ["paper_id"])


def carry_on(rows: DataFrame, number: int, table: str) -> bool:
    """Carry the roll-ups on by batch ``number``, whose papers replace earlier audits of them; False if that was done before.

    A batch has no more papers than the stream gives it at a time; their ids and totals are all that the driver sees."""
    spark, root = rows.sparkSession, f"{table}/rollup"
    log = commits.Commits(spark, root)
    n, now = log.latest()
    if now and now["batch"] >= number:
        return False
    name, path = commits.place(root)
    _counted(rows).repartition("part").sortWithinPartitions("part", "paper_id").write.partitionBy("part").parquet(path)
    new = spark.read.schema(SCHEMA).parquet(path)
    keys = new.select("paper_id", "part").collect()
    gone = _sum(replaced(spark, table, [r["paper_id"] for r in keys], sorted({r["part"] for r in keys}))) if keys and now else dict.fromkeys(COUNTS, 0)
    come, before = _sum(new), now.get("totals", {})
    try:
        log.add(n + 1, {"batch": number, "data": name, "totals": {c: before.get(c, 0) + come[c] - gone[c] for c in COUNTS}})
    except commits.Conflict:  # the same batch, run elsewhere
        return False
    return True


def current(spark: SparkSession, table: str) -> DataFrame:
    """The rows in force: of each paper those of its last batch."""
    log = spark.read.parquet(f"{table}/rows").drop("batch")
    newest = log.groupBy("paper_id").agg(F.max("seq").alias("seq"))
    return latest(log.join(newest, ["paper_id", "seq"], "left_semi"), ["paper_id", "number"])


def status(spark: SparkSession, table: str) -> DataFrame:
    """The counts in force of each paper: one row an audit is read, no reference."""
    return latest(commits.log(spark, f"{table}/rollup", SCHEMA), ["paper_id"]).select("paper_id", *COUNTS)


def totals(spark: SparkSession, table: str) -> dict[str, int]:
    """The counts of the corpus, as the last batch has left them."""
    return commits.Commits(spark, f"{table}/rollup").latest()[1].get("totals", dict.fromkeys(COUNTS, 0))


def progress(spark: SparkSession, table: str, verdicts: DataFrame) -> DataFrame:
    """(paper_id, refs, needs, done, pending): counts as they are kept up, less what verdicts about the present texts have settled. Only
    citations with a verdict are looked at."""
    told = verdicts.select("paper_id", "number", F.coalesce("ref_hash", F.lit("")).alias("_h"))
    open_rows = current(spark, table).where(F.col("status").isNotNull() & ~F.col("status").eqNullSafe(F.lit("verified")))
    live = open_rows.select("paper_id", "number", N.fingerprint(F.col("raw")).alias("_f")).join(told, ["paper_id", "number"]).where((F.col("_h") == "") | (F.col("_h") == F.col("_f")))
    done = live.groupBy("paper_id").agg(F.count("*").alias("done"))
    each = status(spark, table).join(done, "paper_id", "left")
    n = F.coalesce("done", F.lit(0))
    return each.select("paper_id", F.col("n_references").alias("refs"), F.col("unverified").alias("needs"), n.alias("done"), (F.col("unverified") - n).alias("pending"))
