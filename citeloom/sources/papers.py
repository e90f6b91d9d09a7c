"""Papers as input and as results: laid-out text, per-paper JSON records, and where they are written."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = (
    "schema_version int, paper_id string, pdf_path string, audited_at string, num_references int, "
    "extraction struct<style:string,lineno_on:boolean,section_found:boolean,parsed:int,unparsed:int,suspect_merged:array<int>,missing_numbers:array<int>,cited_beyond:array<int>,problems:array<string>>, "
    "references array<struct<original_number:int,raw_citation:string,parsed:struct<title:string,authors:array<string>,doi:string,arxiv_id:string>,label:string,label_kind:string,"
    "db_verification:struct<status:string,degraded:boolean,source:string,found_authors:array<string>,paper_url:string,retracted:boolean,failed_dbs:array<string>,db_results:array<struct<db:string,status:string,found_authors:array<string>,paper_url:string>>>>>"
)
#: Papers in a file of records or reports.
PAPERS_A_FILE = 10_000
PAPER_ID = r"([^/]+?)\.[^./]*$"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, page_no, line_no, text) of laid-out text files; a form feed ends a page. Fails if there are none."""
    files = spark.read.option("pathGlobFilter", "*.[tT][xX][tT]").text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), PAPER_ID, 1).alias("paper_id"), "value")
    if files.isEmpty():
        raise FileNotFoundError(f"no text files under {path}")
    pages = files.select("paper_id", F.posexplode(F.split("value", "\f")).alias("page_no", "page"))
    return pages.select("paper_id", "page_no", F.posexplode(F.split("page", "\n")).alias("line_no", "text"))


def pdf_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same from PDF files, by ``pdftotext -layout`` where it is installed on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not shutil.which("pdftotext"):
            raise RuntimeError("pdftotext is not installed on this executor")
        for b in batches:
            done = [subprocess.run(["pdftotext", "-layout", "-", "-"], input=x, capture_output=True, check=True).stdout.decode("utf-8", "replace") for x in b["content"]]
            yield pd.DataFrame({"paper_id": b["paper_id"], "value": done})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path).select(F.regexp_extract("path", PAPER_ID, 1).alias("paper_id"), "content")
    if files.isEmpty():
        raise FileNotFoundError(f"no PDF files under {path}")
    pages = files.mapInPandas(run, "paper_id string, value string").select("paper_id", F.posexplode(F.split("value", "\f")).alias("page_no", "page"))
    return pages.select("paper_id", "page_no", F.posexplode(F.split("page", "\n")).alias("line_no", "text"))


def records(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(papers, rejects): the per-paper records under ``path`` by their content; files that are no such record are rejects with
    their path. ``lines``: a record a line, as ``write_records`` has them, instead of one a file."""
    read = spark.read.option("multiLine", not lines).option("mode", "PERMISSIVE").schema(RECORD + ", _corrupt_record string").json(path).withColumn("file", F.col("_metadata.file_path"))
    good = F.col("_corrupt_record").isNull() & F.col("paper_id").isNotNull() & F.col("references").isNotNull()
    return read.where(good).drop("_corrupt_record", "file"), read.where(~good).select("file", F.col("_corrupt_record").isNotNull().alias("unreadable"))


def references(papers: DataFrame) -> DataFrame:
    """(paper_id, number, raw, title, authors, status, ...) of every reference of the records; a null status was never verified."""
    r = papers.select("paper_id", F.explode("references").alias("r"))
    v = F.col("r.db_verification")
    return r.select(
        "paper_id", F.col("r.original_number").alias("number"), F.col("r.raw_citation").alias("raw"), F.col("r.parsed.title").alias("title"), F.col("r.parsed.authors").alias("authors"), F.col("r.label").alias("label"), F.col("r.label_kind").alias("label_kind"),
        v["status"].alias("status"), v["degraded"].alias("degraded"), v["source"].alias("source"), v["found_authors"].alias("found_authors"), v["retracted"].alias("retracted"), v["failed_dbs"].alias("failed_dbs"), v["db_results"].alias("db_results"),
    )


def record_of(papers: DataFrame, refs: DataFrame) -> DataFrame:
    """One record (``RECORD``) a paper from its extraction (with ``problems``) and its references."""
    there = lambda c, kind: F.col(c) if c in refs.columns else F.lit(None).cast(kind)
    result = "array<struct<db:string,status:string,found_authors:array<string>,paper_url:string>>"
    results = F.transform("db_results", lambda r: F.struct(r["db"].alias("db"), r["status"].alias("status"), r["found_authors"].alias("found_authors"), r["paper_url"].alias("paper_url"))) if "db_results" in refs.columns else F.lit(None).cast(result)
    found = there("found_authors", "array<string>")
    verified = F.struct(there("status", "string").alias("status"), there("degraded", "boolean").alias("degraded"), there("source", "string").alias("source"), found.alias("found_authors"), there("paper_url", "string").alias("paper_url"), there("retracted", "boolean").alias("retracted"), there("failed_dbs", "array<string>").alias("failed_dbs"), results.alias("db_results"))
    parsed = F.when(F.col("title").isNotNull(), F.struct("title", "authors", "doi", "arxiv_id"))
    one = F.struct(F.col("number").alias("original_number"), F.col("raw").alias("raw_citation"), parsed.alias("parsed"), "label", "label_kind", F.when(there("status", "string").isNotNull(), verified).alias("db_verification"))
    each = refs.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct(F.col("number").alias("n"), one.alias("r")))).alias("x")).select("paper_id", F.transform("x", lambda x: x["r"]).alias("references"))
    ext = F.struct("extraction.*", "problems")
    whole = papers.join(each, "paper_id", "left")
    return whole.select(F.lit(1).alias("schema_version"), "paper_id", F.lit(None).cast("string").alias("pdf_path"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("audited_at"), "num_references", ext.alias("extraction"), F.coalesce("references", F.array()).alias("references"))


def write_records(papers: DataFrame, path: str) -> None:
    """One JSON document a line and a paper, dealt by a hash of the paper to files of about ``PAPERS_A_FILE``."""
    papers.repartition(_files_for(papers), "paper_id").write.mode("overwrite").json(path)


def write_reports(lines: DataFrame, path: str) -> None:
    """(paper_id, place, line) as one JSON document a paper: its id and its Markdown."""
    each = lines.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("x"))
    whole = each.select("paper_id", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("markdown"))
    whole.repartition(_files_for(whole), "paper_id").write.mode("overwrite").json(path)


def _files_for(papers: DataFrame) -> int:
    return 1 + papers.count() // PAPERS_A_FILE


def write_summary(totals: DataFrame, path: str) -> None:
    totals.coalesce(1).write.mode("overwrite").json(path)
