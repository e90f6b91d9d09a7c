"""What the command line does, as functions over tables."""

from __future__ import annotations

import argparse
import uuid
from collections.abc import Callable, Sequence
from functools import partial

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse as P
from ..operators import keyed, leads, measure, mirror, rollup, segment, triage, verify
from ..sources import backends, commits, dump, papers

VERDICTS = f"paper_id string, number int, category string, finding string, signals {triage.SIGNAL_TYPE}, ref_hash string"
#: Where a mirror's folder holds the table laid out by title key, and records of a bucket of it; readers of the mirror pass it over.
LAID, BUCKET_ROWS = "_by_key", 100_000
MIRROR_COLUMNS = {"id", "key", "title", "authors", "year", "venue", "ee", "volume", "number", "pages", "title_full", "title_head", "tokens"}
WHOLE_DUMP = 1_000_000


# -- tables in folders -------------------------------------------------------------------------


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    at, fs = _files(spark, path)
    return fs.exists(at)


def replace(spark: SparkSession, staged: str, out: str) -> None:
    """Put the table at ``staged`` in the place of the one at ``out``, by renaming: what was there stays beside it until the new one is
    in place, and ``present`` finds it there if that never comes to pass."""
    new, fs = _files(spark, staged)
    place, old = _files(spark, out)[0], _files(spark, f"{out}.old")[0]
    if fs.exists(place):
        fs.delete(old, True)
        if not fs.rename(place, old):
            raise OSError(f"{out} can't be renamed")
    if not fs.rename(new, place):
        raise OSError(f"{staged} can't be renamed")
    fs.delete(old, True)


def present(spark: SparkSession, path: str) -> str:
    """Where the table of ``replace`` is: in its place, or beside it after a crash."""
    return path if _exists(spark, path) or not _exists(spark, f"{path}.old") else f"{path}.old"


def _stored(spark: SparkSession, work: str, df: DataFrame) -> DataFrame:
    path = f"{work}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# -- commands ----------------------------------------------------------------------------------


def ingest(spark: SparkSession, path: str, out: str, work: str, least: int = WHOLE_DUMP, limit: int | None = None) -> int:
    """Dump to publications table, and beside it the same laid out by title key; a load that is too small or has lost its accents is
    refused and nothing is replaced. ``limit``: the first so many records only, for a trial."""
    pub = mirror.ingest(dump.records(spark, path, limit=limit))
    staged = f"{work}/staged"
    mirror.with_keys(pub).write.mode("overwrite").parquet(staged)
    written = spark.read.parquet(staged)
    mirror.check_load(written, least)
    keyed.write(written, f"{staged}/{LAID}", 1 + written.count() // BUCKET_ROWS)
    replace(spark, staged, out)
    return 0


def mirror_at(spark: SparkSession, path: str, parity: bool = False) -> tuple[verify.Backend, DataFrame | None]:
    """The mirror as a backend, and its table; one that can't be read answers ``error`` for every citation."""
    try:
        at = present(spark, path)
        pub = spark.read.parquet(at)
        if not set(pub.columns) >= MIRROR_COLUMNS:
            return verify.unreadable_backend("DBLP"), None
        complete = mirror.facts(pub).first()["complete"]
        laid = keyed.open_at(spark, f"{at}/{LAID}") if keyed.is_keyed(spark, f"{at}/{LAID}") else None
    except PySparkException:
        return verify.unreadable_backend("DBLP"), None
    return verify.mirror_backend(pub, complete, parity, laid=laid), pub


def audit(lines: DataFrame, asked: Sequence[verify.Backend], pub: DataFrame | None, keep: Callable[[DataFrame], DataFrame], disabled: Sequence[str] = (), rounds: int = 0, delay: float = 0, search: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(papers, references): extraction facts with their problems, and every entry with its verification and label. Each paper is read
    once; ``keep`` stores its argument. ``search`` finds works that resemble citations; what is not verified gets the likeliest as leads."""
    extracted = keep(segment.papers(lines))
    facts = extracted.drop("entries")
    found = facts.join(triage.problems(facts), "paper_id")
    refs = segment.entries_of(extracted).withColumn("ref_id", F.concat_ws(":", "paper_id", F.col("number").cast("string")))
    if asked:
        check = partial(verify.verify, backends=asked, disabled=disabled, keep=keep)
        titled = refs.where("title is not null")
        done = keep(check(titled))
        if rounds:
            done = verify.retry_degraded(done, titled, check, rounds, keep, delay)
        done = keep(_dehyphenated(done, check))
        if pub is not None:
            done = done.join(verify.mirror_evidence(done, pub), "ref_id", "left")
        if search is not None:
            done = leads.attached(done, keep(search(done.where(triage.needs_triage(F.col("status"))).select("ref_id", "title", "authors"))))
        done = done.withColumn("identifiers", _identifiers(done)).withColumn("absent_authors", triage.authors_absent(F.col("status"), F.col("authors"), F.col("found_authors")))
        refs = done.unionByName(refs.where("title is null").withColumn("status", F.lit("unparsed")), allowMissingColumns=True)
    styles = facts.select("paper_id", F.col("extraction.style").alias("style"))
    return found, refs.join(styles, "paper_id").withColumn("l", triage.label(F.col("style"), F.col("number"), F.col("raw"), F.col("authors"))).select("*", "l.label", "l.label_kind").drop("l", "style")


def _dehyphenated(done: DataFrame, check: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Entries whose line ends may have hyphenated a word are read again without those hyphens, where they are not verified."""
    e = P.parse_reference(F.col("alt"))
    again = done.where("alt is not null and status <> 'verified'").select("ref_id", "raw", "doi", "arxiv_id", e.alias("e"))
    again = again.where("e.title is not null").select("ref_id", "raw", F.coalesce("e.doi", "doi").alias("doi"), F.coalesce("e.arxiv_id", "arxiv_id").alias("arxiv_id"), "e.title", "e.authors")
    return verify.retry_alternative(done, again, check)


def _identifiers(done: DataFrame) -> F.Column:
    """What the cited identifiers resolved to, where a backend that resolves them was asked."""
    info = lambda c, name: F.col(c) if c in done.columns else F.struct(F.lit(None).cast("string").alias(name), F.lit(None).cast("boolean").alias("valid"), F.lit(None).cast("string").alias("title"))
    return triage.identifier_evidence(F.col("title"), info("doi_info", "doi"), info("arxiv_info", "arxiv_id"))


def _lines(spark: SparkSession, path: str, pdf: bool) -> DataFrame:
    return papers.pdf_lines(spark, path) if pdf else papers.text_lines(spark, path)


def table(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A table of the last audit that was committed."""
    at = commits.path_of(spark, out, name)
    if at is None:
        raise FileNotFoundError(f"no audit under {out}")
    return spark.read.parquet(at)


def verdicts(spark: SparkSession, out: str) -> DataFrame:
    """All verdicts that were recorded, in the order of their commits (``seq``)."""
    return commits.log(spark, f"{out}/verdicts", VERDICTS)


def record(spark: SparkSession, out: str, new: DataFrame) -> list[str]:
    """Record verdicts (paper_id, number, category, finding, signals) as one commit; if any breaks a rule none is recorded, and the reasons are
    returned. Any number of writers may do so at once."""
    log, rejected = triage.record(spark.createDataFrame([], VERDICTS), new, table(spark, out, "references"))
    said = [r["reason"] for r in rejected.select("reason").limit(100).collect()]
    if not said:
        commits.append(log, f"{out}/verdicts")
    return said


def run_audit(spark: SparkSession, a: argparse.Namespace) -> int:
    work = f"{a.out}/work"
    keep = partial(_stored, spark, work)
    asked, pub = [], None
    if not a.no_verify:
        if a.mirror:
            local, pub = mirror_at(spark, a.mirror, a.parity)
            asked.append(local)
        if not a.offline:
            asked += backends.online(a.mailto, a.s2_api_key, a.openalex_api_key, keep, a.rate_limit_retries)
    disabled = [x.strip() for x in a.disable_dbs.split(",") if x.strip()]
    unknown = set(disabled) - set(verify.BACKENDS)
    if unknown:
        raise SystemExit(f"no such backend: {', '.join(sorted(unknown))}; there are {', '.join(verify.BACKENDS)}")
    search = None if a.offline or a.no_candidates else partial(backends.leads, mailto=a.mailto, keep=keep)
    found, refs = audit(_lines(spark, a.papers, a.pdf), asked, pub, keep, disabled, a.retry_degraded, a.retry_delay, search)
    run = f"{work}/{uuid.uuid4().hex}"
    found.write.parquet(f"{run}/papers")
    refs.write.parquet(f"{run}/references")
    found, refs = spark.read.parquet(f"{run}/papers"), spark.read.parquet(f"{run}/references")
    writers = {"papers": found.write.parquet, "references": refs.write.parquet, "records": partial(papers.write_records, papers.record_of(found, refs))}
    if asked:
        ran = refs.select(F.explode("db_results.db").alias("db"))
        drift = rollup.drift(ran, [b.name for b in asked if b.name not in disabled], verify.LOCAL, a.offline)
        writers |= {"summary": partial(papers.write_summary, rollup.status_rollup(refs)), "warnings": drift.write.json}
    commits.publish(spark, a.out, writers)
    commits.clean(spark, a.out)
    at, fs = _files(spark, work)
    fs.delete(at, True)
    return 4 if table(spark, a.out, "papers").where("num_references = 0").limit(1).count() else 0


def compare(spark: SparkSession, base: str, out: str) -> int:
    """What an audit says otherwise than an earlier one: how often each status became which, whose verification moved, and every parsed field
    that differs. 1 if anything moved."""
    old, new = (measure.recording(table(spark, at, "references"), at) for at in (base, out))
    flat = lambda r: r.select("ref_id", "parse.*", "check.status", "check.source")
    old, new = flat(old), flat(new)
    moved = rollup.moved(old, new)
    for name, rows in (("transitions", rollup.transitions(old, new)), ("moved", moved), ("differences", rollup.field_diffs(old, new))):
        rows.write.mode("overwrite").json(f"{out}/compared/{name}")
    return 0 if moved.isEmpty() else 1


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.command == "ingest":
        return ingest(spark, a.dump, a.out, a.work, a.least, a.limit)
    if a.command == "audit":
        return run_audit(spark, a)
    if a.command == "compare":
        return compare(spark, a.base, a.out)
    refs = table(spark, a.out, "references")
    if getattr(a, "paper", None) and a.command != "record":
        refs = refs.where(F.col("paper_id") == a.paper)
    now = triage.current(verdicts(spark, a.out))
    suffix = f"-{a.paper}" if getattr(a, "paper", None) else ""
    if a.command == "worklist":
        triage.worklist(refs, now if a.pending else None).write.mode("overwrite").json(f"{a.out}/worklist{suffix}")
    elif a.command == "status":
        rollup.progress(refs, now).write.mode("overwrite").json(f"{a.out}/status{suffix}")
    elif a.command == "report":
        papers.write_reports(triage.report_lines(refs, now), f"{a.out}/reports{suffix}")
        papers.write_reports(triage.sheet_lines(refs, now), f"{a.out}/sheet{suffix}")
        triage.rollup_lines(refs, now).repartitionByRange("place").sortWithinPartitions("place").select("line").write.mode("overwrite").text(f"{a.out}/rollup{suffix}")
    else:
        new = spark.createDataFrame([(a.paper, a.number, a.category, a.finding, a.signals)], VERDICTS.removesuffix(", ref_hash string"))
        said = record(spark, a.out, new)
        if said:
            raise SystemExit(said[0])
        warning = new.select(triage.signal_warning(F.col("category"), F.col("signals"))).first()[0]
        if warning:
            print(f"warning: {warning}")
    return 0
