"""Verdicts: one backend's answer from its candidates, the cascade over backends, and a citation's status.

A backend is a table of candidate records keyed by citation; what a record says about a citation is an Arrow
kernel over the two author lists, everything else is expressions, joins and reductions. Each backend sees only
citations that no earlier one has matched.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, textnorm as N
from . import keyed, skew, titles

#: Backends in the order in which they are asked, and what each may answer.
BACKENDS = ("DBLP", "CrossRef", "DOI", "arXiv", "OpenAlex", "Semantic Scholar")
LOCAL = ("DBLP",)
MATCH, NO_MATCH, MISMATCH, SKIPPED = "match", "no_match", "author_mismatch", "skipped"
FAILED = ("timeout", "error", "rate_limited")

#: What backends may say of a cited identifier; the first that says anything is kept.
INFOS = ("doi_info", "arxiv_info")
NO_NAMES = "cast(array() as array<string>)"
ANSWER = "ref_id string, db string, status string, found_authors array<string>, paper_url string, retracted boolean"


@dataclass(frozen=True)
class Backend:
    """A named source of answers: from pending citations to one row (``ANSWER``) for each of them."""

    name: str
    ask: Callable[[DataFrame], DataFrame]


def verdict(title_matches: Column, cited: Column, record: Column, complete_source: Column, evidence: Column) -> Column:
    """match, author_mismatch or no_match of one candidate. ``evidence`` is ``names.author_evidence`` of the two lists."""
    agree = names.authors_agree(evidence, complete_source & N.record_authors_complete(record), N.lists_people(record))
    comparable = (F.size(cited) > 0) & (F.size(record) > 0) & (evidence["comparable"] > 0)
    return F.when(~title_matches | ~F.coalesce(comparable, F.lit(False)), NO_MATCH).when(agree, MATCH).otherwise(MISMATCH)


def judged(pairs: DataFrame, complete_source: Column, cited: str = "authors", record: str = "rec.authors", matches: Column | None = None) -> DataFrame:
    """``pairs`` of citations and candidates with ``verdict`` and ``matched``.

    The kernel runs once a batch for each distinct pair of author lists, and not at all where every cited name stands in the record as it is."""
    none = F.expr(NO_NAMES)
    keyed = pairs.withColumns({"_c": F.coalesce(F.filter(F.col(cited), lambda a: a != ""), none), "_r": F.coalesce(F.col(record), none)})
    counted = keyed.withColumn("_n", names.all_listed(F.col("_c"), F.col("_r")))
    asked = counted.withColumn("_e", names.author_evidence(*(F.when(F.col("_n").isNull(), F.col(c)) for c in ("_c", "_r"))))
    listed = F.struct(F.col("_n").alias("matched"), F.col("_n").alias("comparable"), F.lit(0).alias("split"), F.lit(False).alias("contradicted"))
    with_evidence = asked.withColumn("_e", F.when(F.col("_n").isNotNull(), listed).otherwise(F.col("_e")))
    out = with_evidence.withColumns({"verdict": verdict(matches if matches is not None else F.lit(True), F.col("_c"), F.col("_r"), complete_source, F.col("_e")), "matched": F.col("_e.matched")})
    return out.drop("_c", "_r", "_n", "_e")


def best(judged_pairs: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Of each citation's candidates the one its verdict rests on: the first match, else the mismatch with most paired
    authors, the first of equals."""
    useful = judged_pairs.where(F.col("verdict").isin(MATCH, MISMATCH))
    first = F.min_by(F.struct(*useful.columns), F.struct(_tier(), *order))
    return useful.groupBy(F.col("ref_id").alias("_ref")).agg(first.alias("x")).select("x.*")


def _tier() -> Column:
    """A match before any mismatch, and mismatches by the number of paired authors."""
    return F.struct(F.col("verdict") != MATCH, F.when(F.col("verdict") == MATCH, 0).otherwise(-F.col("matched")))


def chosen_records(refs: DataFrame, pub: DataFrame, complete: Column) -> DataFrame:
    """(ref_id, verdict, id, key, authors): of the records with a citation's title the one that its verdict rests on.

    ``pub`` is a mirror with keys, or one that is laid out by them (``keyed``), which is then not shuffled. Copies of a work share title key and
    byline, and so do citations of it. The kernel sees each pair of (title, byline) classes once; a citation then meets only the records of
    the classes that its class can rest on, and of these nothing but what the choice among them reads; what it prints is read only where there are
    several. Titles that very many records
    bear are dealt to many tasks (``skew``)."""
    none = F.expr(NO_NAMES)
    asked = refs.where(titles.queryable(F.col("title"))).select("ref_id", N.letters(F.col("title")).alias("full"), N.subtitle_head(F.col("title")).alias("head"), F.coalesce(F.filter("authors", lambda a: a != ""), none).alias("cited"), "raw", "doi")
    asked = asked.withColumn("c", F.struct("full", "head", keyed.byline_key(F.col("cited")).alias("by")))
    held = keyed.rows(pub)
    n, hot = skew.heavy(held, "title_key")
    cut = skew.parts({}, hot, max(skew.FEWEST, n // (2 * int(pub.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    works = asked.groupBy("c").agg(F.first("cited").alias("cited")).withColumn("k", F.explode(titles.title_keys(F.col("c.full"), F.col("c.head")))).select("c", "cited", F.col("k.key").alias("asked_key"), F.col("k.is_head").alias("asked_head"))
    kinds = held.groupBy("title_key", "is_head", "by").agg(F.first("authors").alias("record"), F.count("*").alias("copies"))
    met = skew.join(works, kinds, "asked_key", "title_key", ~(F.col("asked_head") & F.col("is_head")), cut)
    pairs = judged(met.select("c", "title_key", "is_head", "by", "cited", "record", "copies"), complete, "cited", "record").where(F.col("verdict").isin(MATCH, MISMATCH)).select("c", "title_key", "is_head", "by", "verdict", "copies", _tier().alias("tier"))
    least = pairs.withColumn("least", F.min("tier").over(Window.partitionBy("c"))).where("tier = least").withColumn("found", F.sum("copies").over(Window.partitionBy("c")))
    top = least.select("c", F.col("title_key").alias("top_key"), F.col("is_head").alias("top_head"), F.col("by").alias("top_by"), "verdict", "found")
    loc = F.when(F.col("found") > 1, N.locators(F.col("raw"), F.col("doi"))).alias("loc")
    same = (F.col("top_head") == F.col("is_head")) & (F.col("top_by") == F.col("by"))
    between = (F.col("top_head") <= F.col("is_head")) & (F.col("top_head") >= F.col("is_head")) & (F.col("top_by") <= F.col("by")) & (F.col("top_by") >= F.col("by"))
    each = skew.join(asked.select("ref_id", "c", "raw", "doi").join(top, "c").select("ref_id", loc, "top_key", "top_head", "top_by", "verdict"), held, "top_key", "title_key", same, cut, between)
    rec = F.struct("venue", "ee", "pages", "volume", "number", "year", "id").alias("rec")
    each = each.select("ref_id", "loc", "verdict", rec, "key", "authors")
    return each.groupBy("ref_id").agg(F.min_by(F.struct("verdict", "rec.id", "key", "authors"), F.struct(*titles.choice_order())).alias("x")).select("ref_id", "x.*")


def answers(refs: DataFrame, chosen: DataFrame, db: str, asked: Column, url: Column, found: Column, retracted: Column | None = None) -> DataFrame:
    """One answer for each citation: from the chosen candidate, no_match without one, skipped where nothing could be asked."""
    rows = chosen.select("ref_id", "verdict", found.alias("found_authors"), url.alias("paper_url"), (retracted if retracted is not None else F.lit(False)).alias("retracted"))
    joined = refs.select("ref_id", asked.alias("_asked")).join(rows, "ref_id", "left")
    status = F.when(~F.col("_asked"), SKIPPED).otherwise(F.coalesce("verdict", F.lit(NO_MATCH)))
    return joined.select("ref_id", F.lit(db).alias("db"), status.alias("status"), F.coalesce("found_authors", F.expr(NO_NAMES)).alias("found_authors"), "paper_url", F.coalesce("retracted", F.lit(False)).alias("retracted"))


def mirror_backend(pub: DataFrame, complete: bool = True, parity: bool = False, base: str = "https://dblp.org/rec/", laid: DataFrame | None = None) -> Backend:
    """The local mirror as a backend; ``pub`` has its keys (``mirror.with_keys``), and ``laid`` is the same mirror laid out by them, where there is one."""

    def ask(refs: DataFrame) -> DataFrame:
        if parity:
            chosen = best(judged(titles.candidates(refs, pub, parity), F.lit(complete)), titles.choice_order()).select("ref_id", "verdict", "rec.key", F.col("rec.authors").alias("authors"))
        else:
            chosen = chosen_records(refs, pub if laid is None else laid, F.lit(complete))
        return answers(refs, chosen, "DBLP", titles.queryable(F.col("title")), F.concat(F.lit(base), F.col("key")), F.col("authors"))

    return Backend("DBLP", ask)


def table_backend(name: str, records: DataFrame, complete: bool = True, failed: DataFrame | None = None) -> Backend:
    """A backend whose candidates are known: ``records`` (ref_id, pos, title, authors, url, retracted). Citations in ``failed``
    (ref_id, status) got no answer."""

    def ask(refs: DataFrame) -> DataFrame:
        cited = refs.select("ref_id", F.col("title").alias("_t"), F.col("authors").alias("_a"))
        pairs = cited.join(records, "ref_id").withColumn("_m", N.titles_match(F.col("_t"), F.col("title")))
        chosen = best(judged(pairs, F.lit(complete), "_a", "authors", F.col("_m")), [F.col("pos")])
        out = answers(refs, chosen, name, F.lit(True), F.col("url"), F.col("authors"), F.col("retracted"))
        if failed is None:
            return out
        lost = failed.select("ref_id", F.col("status").alias("_lost"))
        none = F.expr(NO_NAMES)
        return out.join(lost, "ref_id", "left").select("ref_id", "db", F.coalesce("_lost", "status").alias("status"), F.when(F.col("_lost").isNull(), F.col("found_authors")).otherwise(none).alias("found_authors"), F.when(F.col("_lost").isNull(), F.col("paper_url")).alias("paper_url"), (F.col("retracted") & F.col("_lost").isNull()).alias("retracted"))

    return Backend(name, ask)


def unreadable_backend(name: str) -> Backend:
    """A backend that can't be read: every citation gets ``error``, never an empty answer."""
    return Backend(name, lambda refs: refs.select("ref_id", F.lit(name).alias("db"), F.lit("error").alias("status"), F.expr(NO_NAMES).alias("found_authors"), F.lit(None).cast("string").alias("paper_url"), F.lit(False).alias("retracted")))


def cascade(refs: DataFrame, backends: Sequence[Backend], disabled: Sequence[str] = (), keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """All answers of all backends. A disabled backend leaves no row; a matched citation is ``skipped`` by the later ones.

    ``keep`` cuts lineage between backends (checkpoint or a written table), as the residue is used twice."""
    out, pending, done = None, refs, None
    for b in [b for b in backends if b.name not in disabled]:
        got = keep(b.ask(pending))
        if done is not None:
            passed = done.select("ref_id", F.lit(b.name).alias("db"), F.lit(SKIPPED).alias("status"), F.expr(NO_NAMES).alias("found_authors"), F.lit(None).cast("string").alias("paper_url"), F.lit(False).alias("retracted"))
            out = out.unionByName(passed, allowMissingColumns=True)
        out = got if out is None else out.unionByName(got, allowMissingColumns=True)
        matched = got.where(F.col("status") == MATCH).select("ref_id")
        done = matched if done is None else done.unionAll(matched)
        pending = keep(pending.join(matched, "ref_id", "left_anti"))
    return out


def place_of(db: Column) -> Column:
    """A backend's place in the cascade."""
    return F.array_position(F.array(*map(F.lit, BACKENDS)), db)


def results(refs: DataFrame, got: DataFrame) -> DataFrame:
    """One row for each citation: status, source, byline and link of what decides, backends that failed, and whether the
    status is degraded. A citation without any answer is not found."""
    place = place_of(F.col("db"))
    decides = F.when(F.col("status") == MATCH, 0).when(F.col("status") == MISMATCH, 1)
    row = F.struct(place.alias("place"), "db", "status", "found_authors", "paper_url", "retracted")
    infos = [c for c in INFOS if c in got.columns]
    per_ref = got.withColumn("_d", decides).groupBy("ref_id").agg(
        *(F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in infos),
        F.min(F.when(F.col("_d").isNotNull(), F.struct(F.col("_d"), place.alias("_p"), "db", "found_authors", "paper_url"))).alias("top"),
        F.array_sort(F.collect_list(row)).alias("db_results"),
        F.max("retracted").alias("retracted"),
    )
    joined = refs.drop(*infos).join(per_ref, "ref_id", "left")
    status = F.when(F.col("top._d") == 0, "verified").when(F.col("top._d") == 1, "mismatch").otherwise("not_found")
    failed = F.transform(F.filter("db_results", lambda r: r["status"].isin(*FAILED)), lambda r: r["db"])
    out = joined.withColumns({"status": status, "source": F.col("top.db"), "found_authors": F.coalesce("top.found_authors", F.expr(NO_NAMES)), "paper_url": F.col("top.paper_url"), "failed_dbs": F.coalesce(failed, F.expr(NO_NAMES)), "retracted": F.coalesce("retracted", F.lit(False))})
    return out.withColumn("degraded", (F.size("failed_dbs") > 0) & (F.col("status") != "verified")).drop("top")


def verify(refs: DataFrame, backends: Sequence[Backend], disabled: Sequence[str] = (), keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    return results(refs, cascade(refs, backends, disabled, keep))


def keep_better(old: DataFrame, new: DataFrame, columns: Sequence[str] = ("status", "source", "found_authors", "paper_url", "failed_dbs", "degraded")) -> DataFrame:
    """A retry's result replaces the first one only if it verifies or fewer backends failed."""
    again = new.select("ref_id", F.struct(*columns).alias("_new"))
    joined = old.join(again, "ref_id", "left")
    better = F.col("_new").isNotNull() & F.col("degraded") & ((F.col("_new.status") == "verified") | (F.size("_new.failed_dbs") < F.size("failed_dbs")))
    return joined.withColumns({c: F.when(F.coalesce(better, F.lit(False)), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in columns}).drop("_new")


def retry_degraded(first: DataFrame, refs: DataFrame, check: Callable[[DataFrame], DataFrame], rounds: int = 1, keep: Callable[[DataFrame], DataFrame] = lambda df: df, delay: float = 0) -> DataFrame:
    """Ask again about degraded citations, some rounds at most, each after ``delay`` seconds."""
    now = first
    for _ in range(rounds):
        time.sleep(delay)
        pending = now.where("degraded").select("ref_id")
        now = keep(keep_better(now, check(refs.join(pending, "ref_id", "left_semi"))))
    return now


def retry_alternative(first: DataFrame, alternative: DataFrame, check: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Ask about the reading without line-break hyphens (``alternative``: ref_id, title, authors, ..) of what isn't verified;
    the citation takes that reading only where it verifies."""
    pending = first.where("status <> 'verified'").select("ref_id")
    again = check(alternative.join(pending, "ref_id", "left_semi")).where("status = 'verified'")
    columns = ("status", "source", "found_authors", "paper_url", "failed_dbs", "degraded", "title", "authors")
    joined = first.join(again.select("ref_id", F.struct(*columns).alias("_new")), "ref_id", "left")
    return joined.withColumns({c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in columns}).drop("_new")


def mirror_evidence(checked: DataFrame, pub: DataFrame) -> DataFrame:
    """(ref_id, dblp_record, dblp_nearest) for what isn't verified: the only record of that title, else the nearest one whose
    authors include every cited person, asked only where the mirror found no such title."""
    residue = checked.where("status <> 'verified'")
    context = titles.record_context(residue, pub)
    context = context.select("ref_id", F.struct(*[c for c in context.columns if c != "ref_id"]).alias("dblp_record"))
    said_no = F.exists("db_results", lambda r: (r["db"] == "DBLP") & (r["status"] == NO_MATCH))
    asked = residue.where(said_no).join(context.select("ref_id"), "ref_id", "left_anti")
    near = titles.nearest(asked, pub)
    record = pub.select(F.col("id").alias("pub_id"), F.struct("key", "title", "authors", "year", "venue").alias("rec"))
    pairs = near.join(record, "pub_id").join(asked.select("ref_id", "authors"), "ref_id")
    with_evidence = pairs.withColumn("_e", names.author_evidence("authors", "rec.authors"))
    gated = with_evidence.where(names.authors_agree(F.col("_e"), F.lit(True), F.lit(True)) & (F.size("authors") > 0))
    first = gated.groupBy("ref_id").agg(F.min(F.struct("place", "edits", "rec")).alias("x"))
    nearest = first.select("ref_id", F.struct(F.col("x.edits").alias("edits"), F.col("x.rec.key").alias("key"), F.col("x.rec.title").alias("title"), F.col("x.rec.authors").alias("authors")).alias("dblp_nearest"))
    return residue.select("ref_id").join(context, "ref_id", "left").join(nearest, "ref_id", "left").where("dblp_record is not null or dblp_nearest is not null")


def retraction(updates: Column, title: Column) -> Column:
    """Whether an update relation or the title says that a work is retracted; ``updates`` is an array of (type, ...)."""
    return F.coalesce(F.exists(updates, lambda u: F.lower(u["type"]) == "retraction"), F.lit(False)) | N.is_retracted_title(title)
