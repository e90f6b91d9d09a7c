"""What a human sees of the residue: worklist, evidence, labels, verdict rules and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, textnorm as N
from .mirror import latest
from .rollup import severity_table

#: Verdict categories with their severity, and the vocabularies of the signals.
SEVERITY = {"real-published": "low", "real-grey-literature": "low", "real-preprint-or-unpublished": "low", "partial-match": "medium", "likely-hallucinated": "high", "unclear": "-"}
FLAGGED = ("likely-hallucinated", "partial-match", "unclear")
SIGNALS = {
    "title_match": ("yes", "no", "unsure", "na"),
    "authors_match": ("yes", "no", "partial", "unsure", "na"),
    "venue_match": ("yes", "no", "partial", "unsure", "na"),
    "doi_status": ("resolves", "404", "mismatch", "none", "unsure"),
}
SIGNAL_TYPE = "struct<title_match:string,authors_match:string,venue_match:string,doi_status:string,matched_title:string>"


def needs_triage(status: Column) -> Column:
    """Checked and not verified; a status that nobody has named yet counts too."""
    return status.isNotNull() & ~status.eqNullSafe(F.lit("verified"))


def severity(category: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in SEVERITY.items() for x in p)), category), F.lit("-"))


def is_stale(ref_hash: Column, raw: Column) -> Column:
    """A verdict that was recorded about another text."""
    return F.coalesce((ref_hash != "") & (ref_hash != N.fingerprint(raw)), F.lit(False))


def skipped_dbs(db_results: Column) -> Column:
    return F.transform(F.filter(db_results, lambda r: r["status"] == "skipped"), lambda r: r["db"])


def matched_records(db_results: Column) -> Column:
    """The results that came with a record; named one by one, so that a new kind of failure isn't taken for one."""
    return F.filter(db_results, lambda r: r["status"].isin("match", "author_mismatch"))


def identifier_evidence(title: Column, doi: Column, arxiv: Column) -> Column:
    """What each cited identifier resolved to; ``doi`` is (doi, valid, title) and ``arxiv`` is (arxiv_id, valid, title)."""

    def one(kind: str, value: Column, info: Column) -> Column:
        found = F.nullif(info["title"], F.lit(""))
        row = F.struct(F.lit(kind).alias("kind"), value.alias("id"), F.coalesce(info["valid"], F.lit(False)).alias("resolves"), found.alias("title"), F.when(found.isNotNull(), N.titles_match(title, found)).alias("cited_title"))
        return F.when(F.coalesce(value, F.lit("")) != "", row)

    return F.array_compact(F.array(one("doi", doi["doi"], doi), one("arxiv", arxiv["arxiv_id"], arxiv)))


def authors_absent(status: Column, cited: Column, found: Column) -> Column:
    """The cited people that the record behind an unverified status does not list."""
    none = F.expr("cast(array() as array<string>)")
    return F.when(status.eqNullSafe(F.lit("verified")) | (F.size(F.coalesce(found, none)) == 0), none).otherwise(names.absent_authors(F.coalesce(cited, none), F.coalesce(found, none)))


def label(style: Column, number: Column, raw: Column, authors: Column) -> Column:
    """(label, label_kind): the printed number, the citation key that the text uses, or the own index."""
    printed = style.isin("numeric", "bracket-numeric")
    year = F.regexp_extract(F.coalesce(raw, F.lit("")), r"\(((?:19|20)\d{2}[a-z]?)\)", 1)
    who = F.transform(F.filter(F.coalesce(authors, F.expr("cast(array() as array<string>)")), lambda a: a != ""), N.surname)
    named = F.when(F.size(who) == 1, F.get(who, F.lit(0))).when(F.size(who) == 2, F.concat(F.get(who, F.lit(0)), F.lit(" and "), F.get(who, F.lit(1)))).otherwise(F.concat(F.get(who, F.lit(0)), F.lit(" et al.")))
    citable = (F.size(who) > 0) & (year != "")
    text = F.when(printed, F.concat(F.lit("["), number.cast("string"), F.lit("]"))).when(citable, F.concat(named, F.lit(" ("), year, F.lit(")"))).otherwise(F.concat(F.lit("#"), number.cast("string")))
    return F.struct(text.alias("label"), F.when(printed, "printed").when(citable, "citation").otherwise("internal").alias("label_kind"))


def reference_key(label_text: Column, number: Column) -> Column:
    """The label, with the own index behind it where that is another one."""
    n = number.cast("string")
    plain = label_text.isin("") | (label_text == F.concat(F.lit("["), n, F.lit("]"))) | (label_text == F.concat(F.lit("#"), n))
    return F.when(plain, label_text).otherwise(F.concat(label_text, F.lit(" [#"), n, F.lit("]")))


LABEL_NOTE = "Labels like [3] are printed in the paper; author and year are how the text cites an entry; #3 is the entry's place among those that were extracted."


def label_note(refs: DataFrame) -> DataFrame:
    """(paper_id, needs_note): whether a paper's handles must be explained, as not all of them are printed."""
    return refs.groupBy("paper_id").agg(F.max(F.col("label_kind") != "printed").alias("needs_note"))


def signal_problem(category: Column, signals: Column) -> Column:
    """Why a verdict can't be recorded, or null. Signals come from closed vocabularies, and what is said about the title
    must carry the category."""
    tm, mt = signals["title_match"], F.coalesce(F.trim(signals["matched_title"]), F.lit(""))
    checks = [F.when(~category.isin(*SEVERITY), F.concat(F.lit("unknown category "), category))]
    checks += [F.when(signals[k].isNotNull() & ~signals[k].isin(*v), F.concat(F.lit(f"signal {k}: "), signals[k])) for k, v in SIGNALS.items()]
    checks += [
        F.when((category == "partial-match") & ~F.coalesce(tm.isin("yes", "na"), F.lit(False)), "partial-match needs title_match yes or na"),
        F.when((category == "partial-match") & (tm == "yes") & (mt == ""), "partial-match needs the matched title"),
        F.when((category == "likely-hallucinated") & ~tm.eqNullSafe(F.lit("no")), "likely-hallucinated needs title_match no"),
        F.when((category == "unclear") & (tm == "no"), "unclear contradicts title_match no"),
    ]
    return F.coalesce(*checks)


def signal_warning(category: Column, signals: Column) -> Column:
    return F.when(category.startswith("real-") & (signals["title_match"] == "no"), "a real work whose title no publication bears?")


def is_fabrication(category: Column, signals: Column) -> Column:
    return F.coalesce((category == "likely-hallucinated") & (signals["title_match"] == "no"), F.lit(False))


def signals_line(signals: Column) -> Column:
    """``title=… · authors=… · venue=… · doi=…`` of the signals that are set; null if none is."""
    parts = [F.when(signals[k].isNotNull(), F.concat(F.lit(f"{k.split('_')[0]}="), signals[k])) for k in SIGNALS]
    return F.nullif(F.concat_ws(" · ", *parts), F.lit(""))


def record(log: DataFrame, verdicts: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log with the new verdicts, rejected verdicts with a reason). Unknown citations and broken rules are rejected; the
    fingerprint of the text is recorded with each verdict."""
    texts = refs.select("paper_id", "number", F.col("raw").alias("_raw"), F.lit(True).alias("_known"))
    joined = verdicts.join(texts, ["paper_id", "number"], "left")
    checked = joined.withColumn("reason", F.coalesce(F.when(F.col("_known").isNull(), "no such reference"), signal_problem(F.col("category"), F.col("signals"))))
    fine = checked.where("reason is null").withColumn("ref_hash", N.fingerprint(F.col("_raw"))).drop("_raw", "_known", "reason")
    return log.unionByName(fine, allowMissingColumns=True), checked.where("reason is not null").drop("_raw", "_known")


def current(log: DataFrame) -> DataFrame:
    """The verdict in force for each citation: the last one recorded."""
    return latest(log, ["paper_id", "number"])


def worklist(refs: DataFrame, verdicts: DataFrame | None = None, paper: str | None = None) -> DataFrame:
    """The citations that need a human; with ``verdicts`` only those that have none about their present text."""
    some = refs.where(needs_triage(F.col("status")))
    if paper is not None:
        some = some.where(F.col("paper_id") == paper)
    if verdicts is not None:
        done = verdicts.select("paper_id", "number", F.coalesce("ref_hash", F.lit("")).alias("_h"))
        fresh = some.select("paper_id", "number", N.fingerprint(F.col("raw")).alias("_f")).join(done, ["paper_id", "number"]).where((F.col("_h") == "") | (F.col("_h") == F.col("_f"))).select("paper_id", "number")
        some = some.join(fresh, ["paper_id", "number"], "left_anti")
    extra = {"skipped_dbs": skipped_dbs(F.col("db_results")), "matched_records": matched_records(F.col("db_results"))} if "db_results" in refs.columns else {}
    return some.withColumns(extra)


def problems(papers: DataFrame) -> DataFrame:
    """(paper_id, problems): why a paper's extraction can't vouch for having reached every entry."""
    ext = F.col("extraction")
    labels = lambda c, mark: F.array_join(F.transform(c, lambda n: F.concat(F.lit(mark[0]), n.cast("string"), F.lit(mark[1:]))), ", ")
    said = F.array(
        F.when(~F.coalesce(ext["section_found"], F.lit(False)), "no References or Bibliography heading was recognized"),
        F.when(F.coalesce(ext["section_found"], F.lit(False)) & (F.col("num_references") == 0), F.concat(F.lit("a References heading was found, but no entries could be segmented under it (style: "), F.coalesce(ext["style"], F.lit("none")), F.lit(")"))),
        F.when(F.size(ext["missing_numbers"]) > 0, F.concat(F.lit("the bibliography prints entry "), labels(ext["missing_numbers"], "[]"), F.lit(", but no reference was extracted for it"))),
        F.when(F.size(ext["cited_beyond"]) > 0, F.concat(F.lit("the text contains citation-like numbers up to ["), F.array_max(ext["cited_beyond"]).cast("string"), F.lit("] beyond the extracted bibliography (first unmatched number ["), F.array_min(ext["cited_beyond"]).cast("string"), F.lit("])"))),
        F.when(F.size(ext["suspect_merged"]) > 0, F.concat(F.lit("reference(s) "), labels(ext["suspect_merged"], "#"), F.lit(" carry two author-year blocks, the mark of two entries merged into one"))),
    )
    return papers.select("paper_id", F.array_compact(said).alias("problems"))


def report_lines(refs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(paper_id, place, line): the Markdown lines of each paper's report, in order; rendered on the executors. Where ``refs`` have labels, citations
    go by them, a paper whose labels aren't all printed ones says so first, and a verdict that contradicts its signals is warned of."""
    joined = refs.join(verdicts.select("paper_id", "number", "category", "finding", "signals", "ref_hash"), ["paper_id", "number"], "left")
    live = joined.where(needs_triage(F.col("status"))).withColumn("_stale", is_stale(F.col("ref_hash"), F.col("raw")))
    labelled = {"label", "label_kind"} <= set(refs.columns)
    lab = F.concat(F.lit("#"), F.col("number").cast("string"))
    lab = F.coalesce(reference_key(F.col("label"), F.col("number")), lab) if labelled else lab
    head = F.concat(F.lit("## "), lab, F.lit(": "), F.coalesce("title", F.col("raw"), F.lit("")))
    state = F.when(F.col("category").isNull(), "- Not triaged yet").when(F.col("_stale"), "- The verdict was recorded about another text; triage again").otherwise(F.concat(F.lit("- Verdict: "), F.col("category"), F.lit(" (severity "), severity(F.col("category")), F.lit(")")))
    sig = F.when(~F.col("_stale"), F.concat(F.lit("- Signals: "), signals_line(F.col("signals"))))
    note = F.when(~F.col("_stale") & F.col("finding").isNotNull(), F.concat(F.lit("- Finding: "), F.col("finding")))
    warning = F.when(~F.col("_stale"), F.concat(F.lit("- Warning: "), signal_warning(F.col("category"), F.col("signals"))))
    lines = F.array_compact(F.array(head, F.concat(F.lit("- Status: "), F.col("status")), state, sig, warning, note, F.concat(F.lit("- Raw: "), F.col("raw"))))
    each = live.select("paper_id", "number", F.posexplode(lines).alias("pos", "line"))
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy("number", "pos"))
    numbered = each.select("paper_id", place.alias("place"), "line")
    if not labelled:
        return numbered
    noted = label_note(refs).where("needs_note").join(numbered.select("paper_id").distinct(), "paper_id", "left_semi")
    return noted.select("paper_id", F.lit(0).alias("place"), F.lit(LABEL_NOTE).alias("line")).unionByName(numbered)


def rollup_lines(refs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(place, line): the Markdown roll-up over all papers, those with the gravest findings first. A verdict about another text doesn't
    count. Papers are numbered within their severity, so that no task holds more than the order of the report needs."""
    texts = refs.select("paper_id", "number", "raw")
    live = verdicts.join(texts, ["paper_id", "number"]).where(~is_stale(F.col("ref_hash"), F.col("raw")))
    flagged = severity_table(live).select("paper_id", "high", "medium", "other")
    n = F.count_if(needs_triage(F.col("status")))
    every = refs.groupBy("paper_id").agg(F.count("*").alias("refs"), n.alias("open")).join(flagged, "paper_id", "left").na.fill(0, ["high", "medium", "other"])
    cell = lambda c: F.col(c).cast("string")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("paper_id"), *map(cell, ("refs", "open", "high", "medium", "other"))), F.lit(" |"))
    place = F.concat_ws("/", F.lit("1"), *(F.lpad((F.lit(10**9) - F.col(c)).cast("string"), 10, "0") for c in ("high", "medium", "other")), N.natural_key(F.col("paper_id")))
    head = refs.sparkSession.createDataFrame([("0/0", "# Papers"), ("0/1", ""), ("0/2", "| Paper | References | To triage | High | Medium | Other |"), ("0/3", "|-|-|-|-|-|-|")], "place string, line string")
    return head.unionByName(every.select(place.alias("place"), row.alias("line")))


def sheet_lines(refs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(paper_id, place, line): the verification sheet, one row for each flagged citation with what a person needs to look it up."""
    v = verdicts.where(F.col("category").isin("likely-hallucinated", "partial-match", "unclear")).select("paper_id", "number", "category", "finding", "signals", "ref_hash")
    live = refs.join(v, ["paper_id", "number"]).where(~is_stale(F.col("ref_hash"), F.col("raw")))
    cell = lambda c: F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "), F.lit("|"), F.lit("\\|"))
    asked = F.concat(F.lit("https://www.google.com/search?q="), F.url_encode(F.coalesce("title", "raw", F.lit(""))))
    cells = [F.concat(F.lit("#"), F.col("number").cast("string")), cell(F.coalesce("title", "raw")), severity(F.col("category")), F.col("category"), cell(signals_line(F.col("signals"))), cell(F.col("finding")), asked]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    rows = live.select("paper_id", (F.col("number") + 2).cast("long").alias("place"), row.alias("line"))
    head = F.explode(F.array(F.struct(F.lit(0).cast("long").alias("place"), F.lit("| Reference | Title | Severity | Category | Signals | Finding | Search |").alias("line")), F.struct(F.lit(1).cast("long").alias("place"), F.lit("|-|-|-|-|-|-|-|").alias("line"))))
    return live.select("paper_id").distinct().select("paper_id", head.alias("x")).select("paper_id", "x.*").unionByName(rows)


def papers_in_order(papers: Sequence[str]) -> list[str]:
    """Paper ids with digits by value; for the few that a report lists."""
    import re

    return sorted(papers, key=lambda p: [(int(t), "") if t.isdigit() else (-1, t) for t in re.split(r"(\d+)", p) if t])
