"""Backends that are asked by identifier: DOI registries and the preprint server.

Unlike a search, they can say that what a citation prints does not exist. That is evidence, so it is kept apart from
a request that failed: ``doi_info`` and ``arxiv_info`` are (identifier, valid, title), with ``valid`` false only
where the service answered. Each identifier is asked about once, whatever number of citations print it; one task asks,
as pacing is a client's state.
"""

from __future__ import annotations

import json
import re
import urllib.parse
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import textnorm as N
from ..operators import verify
from . import backends
from .http import ABSENT, ERROR, OK

#: Where the services are, and how much is asked at a time.
CROSSREF_WORKS, DOI_ORG = "https://api.crossref.org/works/", "https://doi.org/"
ARXIV_API, ARXIV_OAI = "https://export.arxiv.org/api/query", "https://export.arxiv.org/oai2"
CSL_JSON, ATOM, OAI = "application/vnd.citationstyles.csl+json", "application/atom+xml", "application/xml"
BATCH, ALONE, HARVESTED = 100, 20, 60

Get = Callable[[str, str], tuple[str, bytes]]


@dataclass(frozen=True)
class Found:
    """What a service said of an identifier: ``outcome`` of the asking; ``body`` of a record; ``sure`` that there is none."""

    outcome: str
    body: str | None = None
    kind: str = ""
    sure: bool = False


# -- DOIs --------------------------------------------------------------------------------------


def resolve_doi(doi: str, get: Get) -> Found:
    """The registry of most publishers first; what it does not hold, another may, and the resolver speaks for them all."""
    place = urllib.parse.quote(doi, safe="/:()<>;-._")
    for kind, url, accept in (("CrossRef", CROSSREF_WORKS + place, "application/json"), ("DOI", DOI_ORG + place, CSL_JSON)):
        outcome, body = get(url, accept)
        if outcome == ABSENT:
            continue
        if outcome != OK:
            return Found(outcome)
        try:
            record = json.loads(body)
        except ValueError:
            return Found(ERROR)
        record = (record.get("message") if kind == "CrossRef" else record) if isinstance(record, dict) else None
        return Found(OK, json.dumps(record), kind) if record else Found(ERROR)
    return Found(OK, sure=True)


# -- preprints ---------------------------------------------------------------------------------


_ARXIV_ID = re.compile(N.ARXIV)


def arxiv_key(identifier: str) -> str:
    """``textnorm.arxiv_key`` of one identifier: no version, no subject class."""
    return re.sub(r"^([a-z-]+)\.[a-z]{2}/", r"\1/", re.sub(r"v\d+$", "", identifier.strip().lower()))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text(node: ET.Element, name: str) -> str:
    return next((" ".join("".join(x.itertext()).split()) for x in node.iter() if _local(x.tag) == name), "")


def feed_entries(body: bytes) -> dict[str, str] | None:
    """Records by identifier, as JSON, from an Atom feed; None for what is no feed. An entry that reports an error is no record."""
    try:
        root = ET.fromstring(body)
    except ET.ParseError:
        return None
    if _local(root.tag) != "feed":
        return None
    out = {}
    for entry in (x for x in root if _local(x.tag) == "entry"):
        m = _ARXIV_ID.search(_text(entry, "id"))
        if m and _text(entry, "title") != "Error":
            out[arxiv_key(m[1])] = json.dumps({"title": _text(entry, "title"), "authors": [_text(a, "name") for a in entry if _local(a.tag) == "author"], "id": m[1]})
    return out


def harvested(body: bytes, key: str) -> Found:
    """One record from the harvesting interface, which says so when it holds none."""
    try:
        root = ET.fromstring(body)
    except ET.ParseError:
        return Found(ERROR)
    said = [x.get("code") for x in root.iter() if _local(x.tag) == "error"]
    if said:
        return Found(OK, sure=True) if said == ["idDoesNotExist"] else Found(ERROR)
    title = _text(root, "title")
    if not title:
        return Found(ERROR)
    people = [f"{_text(a, 'forenames')} {_text(a, 'keyname')}".strip() for a in root.iter() if _local(a.tag) == "author"]
    return Found(OK, json.dumps({"title": title, "authors": people, "id": key}), "arXiv")


def ask_arxiv(keys: Iterable[str], get: Get) -> Iterator[tuple[str, Found]]:
    """What the preprint server says of each identifier.

    A batch that fails says nothing of any identifier in it, so some of them are put to the harvesting interface. A batch that
    answers may leave out identifiers without a word, so some of those are asked for alone before they count as absent."""
    wanted = list(dict.fromkeys(keys))
    known: dict[str, Found] = {}

    def ask(some: list[str]) -> None:
        query = urllib.parse.urlencode({"id_list": ",".join(some), "max_results": len(some)})
        outcome, body = get(f"{ARXIV_API}?{query}", ATOM)
        entries = feed_entries(body) if outcome == OK else None
        if entries is None:
            known.update(dict.fromkeys(some, Found(ERROR if outcome in (OK, ABSENT) else outcome)))
        else:
            alone = len(some) == 1
            known.update({k: Found(OK, entries[k], "arXiv") if k in entries else Found(OK, sure=alone) for k in some})

    for at in range(0, len(wanted), BATCH):
        ask(wanted[at : at + BATCH])
    for key in [k for k in wanted if known[k].outcome != OK][:HARVESTED]:
        outcome, body = get(f"{ARXIV_OAI}?{urllib.parse.urlencode({'verb': 'GetRecord', 'identifier': f'oai:arXiv.org:{key}', 'metadataPrefix': 'arXiv'})}", OAI)
        said = harvested(body, key) if outcome == OK else Found(ERROR)
        known[key] = said if said.outcome == OK else known[key]
    unsaid = [k for k in wanted if known[k].outcome == OK and known[k].body is None and not known[k].sure]
    if len(wanted) > 1 or not unsaid:
        for key in unsaid[:ALONE]:
            ask([key])
    yield from known.items()


# -- as backends -------------------------------------------------------------------------------

#: What a backend says of the identifier itself, by the identifier's name.
_INFO = "struct<{0}:string,valid:boolean,title:string>"
_ASKED = "key string, outcome string, kind string, body string, sure boolean"
_ARXIV = "struct<title:string,authors:array<string>,id:string>"


def _arxiv_record(j: Column) -> Column:
    authors = F.filter(F.coalesce(j["authors"], F.expr(verify.NO_NAMES)), lambda a: F.trim(a) != "")
    url = F.concat(F.lit("https://arxiv.org/abs/"), j["id"])
    return F.struct(N.plain(N.without_retraction(j["title"])).alias("title"), authors.alias("authors"), url.alias("url"), N.is_retracted_title(j["title"]).alias("retracted"))


def _backend(name: str, key: Column, identifier: str, info: str, ask_all: Callable[[Iterable[str]], Iterator[tuple[str, Found]]], keep: Callable[[DataFrame], DataFrame]) -> verify.Backend:
    def ask(refs: DataFrame) -> DataFrame:
        keyed = refs.withColumn("key", key)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            keys = (k for b in batches for k in b["key"])
            yield from backends.frames(((k, f.outcome, f.kind, f.body, f.sure) for k, f in ask_all(keys)), "key outcome kind body sure")

        said = keep(keyed.where("key is not null").select("key").distinct().coalesce(1).mapInPandas(run, _ASKED))
        asked = keyed.select("ref_id", "key").where("key is not null").join(said, "key")
        record = F.when(F.col("kind") == "CrossRef", backends.crossref_record(F.from_json("body", backends.CROSSREF)))
        record = record.when(F.col("kind") == "DOI", backends.csl_record(F.from_json("body", backends.CSL))).when(F.col("kind") == "arXiv", _arxiv_record(F.from_json("body", _ARXIV)))
        read = asked.withColumn("r", record)
        records = read.where("r is not null").select("ref_id", F.lit(0).alias("pos"), "r.*")
        failed = read.where(F.col("outcome") != OK).select("ref_id", F.col("outcome").alias("status"))
        out = verify.table_backend(name, records, failed=failed).ask(refs)
        told = F.when(F.col("r").isNotNull(), F.struct(F.col("key").alias(identifier), F.lit(True).alias("valid"), F.col("r.title").alias("title")))
        told = told.when(F.col("sure"), F.struct(F.col("key").alias(identifier), F.lit(False).alias("valid"), F.lit(None).cast("string").alias("title")))
        infos = read.select("ref_id", F.lit(True).alias("_asked"), told.cast(_INFO.format(identifier)).alias(info))
        status = F.when(F.col("_asked").isNull(), verify.SKIPPED).otherwise(F.col("status"))
        return out.join(infos, "ref_id", "left").withColumn("status", status).drop("_asked")

    return verify.Backend(name, ask)


def doi_backend(get: Get, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> verify.Backend:
    """The DOI that a citation prints, resolved. ``keep`` must store its argument, so that nothing is asked twice."""
    return _backend("DOI", F.nullif(F.trim("doi"), F.lit("")), "doi", "doi_info", lambda keys: ((k, resolve_doi(k, get)) for k in keys), keep)


def arxiv_backend(get: Get, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> verify.Backend:
    """The preprint that a citation prints. ``refs`` have ``arxiv_id``."""
    return _backend("arXiv", F.nullif(N.arxiv_key(F.coalesce("arxiv_id", F.lit(""))), F.lit("")), "arxiv_id", "arxiv_info", lambda keys: ask_arxiv(keys, get), keep)
