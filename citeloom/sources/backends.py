"""Connectors to bibliographic services: what each service's JSON means, and how a paced client asks.

A connector turns pending citations into candidate records (``verify.table_backend``'s shape). Pacing and the decision to give
up are state of one client, so a connector runs in one task; it is asked about the residue only. There is no network
here: a connector gets its ``fetch`` from outside, and tests pass recorded answers.
"""

from __future__ import annotations

import json
import time
import urllib.parse
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import textnorm as N
from ..operators import verify

#: How the services are asked.
CROSSREF_ROWS, CROSSREF_AUTHORS, ARXIV_BATCH, OPENALEX_REFUSALS, S2_PACE, S2_GIVE_UP = 5, 3, 100, 3, 1.1, 25
DOI_ORG = "https://doi.org/"

CROSSREF = "struct<title:array<string>,subtitle:array<string>,author:array<struct<given:string,family:string,name:string>>,DOI:string,`updated-by`:array<struct<type:string,DOI:string,source:string>>,`update-to`:array<struct<type:string,DOI:string,source:string>>>"
CSL = "struct<title:string,author:array<struct<given:string,family:string,literal:string>>,DOI:string>"
OPENALEX = "struct<title:string,display_name:string,authorships:array<struct<raw_author_name:string,author:struct<display_name:string>>>,is_authors_truncated:boolean,is_retracted:boolean,doi:string,id:string,type:string>"
S2 = "struct<title:string,authors:array<struct<name:string>>,externalIds:struct<DOI:string>,url:string>"
LEAD = "struct<title:array<string>,author:array<struct<given:string,family:string>>,`container-title`:array<string>,issued:struct<`date-parts`:array<array<int>>>,DOI:string>"
LEAD_AUTHORS = 6
RECORD = "struct<title:string,authors:array<string>,url:string,retracted:boolean>"


def _full(given: Column, family: Column, else_: Column) -> Column:
    joined = F.trim(F.concat_ws(" ", given, family))
    return F.when(joined != "", joined).otherwise(F.trim(else_))


def _people(names: Column) -> Column:
    return F.filter(F.coalesce(names, F.expr(verify.NO_NAMES)), lambda n: F.coalesce(n, F.lit("")) != "")


def _record(title: Column, authors: Column, url: Column, retracted: Column) -> Column:
    return F.struct(title.alias("title"), authors.alias("authors"), url.alias("url"), retracted.alias("retracted"))


def crossref_record(j: Column) -> Column:
    """A CrossRef work; its subtitle is joined to the title unless the title has it already."""
    title = N.plain(N.without_retraction(F.get(j["title"], F.lit(0))))
    sub = N.plain(F.get(j["subtitle"], F.lit(0)))
    whole = F.when((sub != "") & ~N.normalized_title(title).contains(N.normalized_title(sub)), F.concat(title, F.lit(": "), sub)).otherwise(title)
    updates = F.concat(F.coalesce(j["updated-by"], F.array()), F.coalesce(j["update-to"], F.array()))
    gone = verify.retraction(updates, F.get(j["title"], F.lit(0)))
    who = F.transform(j["author"], lambda a: _full(a["given"], a["family"], a["name"]))
    return _record(whole, _people(who), F.concat(F.lit(DOI_ORG), j["DOI"]), gone)


def csl_record(j: Column) -> Column:
    who = F.transform(j["author"], lambda a: _full(a["given"], a["family"], a["literal"]))
    return _record(N.plain(N.without_retraction(j["title"])), _people(who), F.concat(F.lit(DOI_ORG), j["DOI"]), N.is_retracted_title(j["title"]))


def openalex_record(j: Column) -> Column:
    """An OpenAlex work; a truncated byline says so in its own row, book reviews are no works."""
    raw = F.coalesce(F.nullif(j["title"], F.lit("")), j["display_name"], F.lit(""))
    who = _people(F.transform(j["authorships"], lambda a: F.trim(F.regexp_replace(F.coalesce(F.nullif(a["raw_author_name"], F.lit("")), a["author"]["display_name"]), r"\s+", " "))))
    cut = F.when(F.coalesce(j["is_authors_truncated"], F.lit(False)) & (F.size(who) > 0), F.concat(who, F.array(F.lit("et al.")))).otherwise(who)
    row = _record(N.plain(N.without_retraction(raw)), cut, F.coalesce(j["doi"], j["id"]), F.coalesce(j["is_retracted"], F.lit(False)) | N.is_retracted_title(raw))
    return F.when(~F.coalesce(j["type"] == "book-review", F.lit(False)), row)


def s2_record(j: Column) -> Column:
    who = F.transform(j["authors"], lambda a: F.trim(a["name"]))
    return _record(N.plain(j["title"]), _people(who), F.coalesce(j["url"], F.concat(F.lit(DOI_ORG), j["externalIds"]["DOI"])), F.lit(False))


READERS: dict[str, tuple[str, Callable[[Column], Column]]] = {"CrossRef": (CROSSREF, crossref_record), "DOI": (CSL, csl_record), "OpenAlex": (OPENALEX, openalex_record), "Semantic Scholar": (S2, s2_record)}


def candidates(name: str, answers: DataFrame) -> DataFrame:
    """(ref_id, pos, title, authors, url, retracted) from raw answers (ref_id, pos, body) of a service."""
    schema, read = READERS[name]
    rows = answers.select("ref_id", "pos", read(F.from_json("body", schema)).alias("r"))
    return rows.where("r is not null").select("ref_id", "pos", "r.*")


class Refused(Exception):
    """The service asked us to slow down."""


@dataclass
class Client:
    """A paced client: ``fetch(title, authors)`` gives bodies, raises ``Refused`` or ``TimeoutError``. After ``give_up`` refusals in a row it
    asks no more."""

    fetch: Callable[[str, list[str]], list[str]]
    pace: float = 0.0
    give_up: int = S2_GIVE_UP
    retries: int = 1

    def ask(self, rows: Iterator[tuple[str, str, list[str]]]) -> Iterator[tuple[str, str, list[str]]]:
        """(ref_id, status or '', bodies) for each citation; an error is that citation's own."""
        refused = 0
        for ref, title, authors in rows:
            if refused >= self.give_up:
                yield ref, verify.SKIPPED, []
                continue
            for attempt in range(self.retries + 1):
                time.sleep(self.pace * (attempt + 1))
                try:
                    bodies = self.fetch(title, authors)
                except Refused:
                    status, bodies = "rate_limited", []
                    continue
                except TimeoutError:
                    status, bodies = "timeout", []
                    continue
                except Exception:  # noqa: BLE001 - whatever it is, it is this citation's answer
                    status, bodies = "error", []
                    break
                status = ""
                break
            refused = refused + 1 if status == "rate_limited" else 0
            yield ref, status, bodies


def frames(rows: Iterator[tuple], columns: str, most: int = 200) -> Iterator[pd.DataFrame]:
    """Answers in small frames as they come, so that none waits for the last."""
    while some := list(islice(rows, most)):
        yield pd.DataFrame(some, columns=columns.split())


def backend(name: str, client: Client, keep: Callable[[DataFrame], DataFrame] = lambda df: df, forms: Callable[[Column], Column] = lambda title: F.array(title), most: int = 1) -> verify.Backend:
    """A service as a backend of the cascade. ``keep`` must store its argument (checkpoint or table), so that nothing is asked twice.

    ``forms`` are up to ``most`` ways to put a title; the next one is asked only about citations that the one before found nothing for."""

    def once(refs: DataFrame, form: Column) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = ((r, t, list(a) if a is not None else []) for b in batches for r, t, a in b.itertuples(index=False))
            yield from frames(((ref, status, i, body) for ref, status, bodies in client.ask(rows) for i, body in enumerate(bodies or [None])), "ref_id status pos body")

        got = keep(refs.select("ref_id", form.alias("title"), "authors").coalesce(1).mapInPandas(run, "ref_id string, status string, pos int, body string"))
        failed = got.where("status <> ''").select("ref_id", "status")
        return verify.table_backend(name, candidates(name, got.where("body is not null")), failed=failed).ask(refs)

    def ask(refs: DataFrame) -> DataFrame:
        out = None
        pending = refs
        for k in range(most):
            form = F.get(forms(F.col("title")), F.lit(k))
            got = keep(once(pending.where(form.isNotNull()) if k else pending, form))
            if out is not None:
                out = out.join(got.select("ref_id"), "ref_id", "left_anti").unionByName(got)
            else:
                out = got
            if k + 1 < most:
                pending = refs.join(got.where(F.col("status") == verify.NO_MATCH).select("ref_id"), "ref_id", "left_semi")
        return out

    return verify.Backend(name, ask)


# -- requests ----------------------------------------------------------------------------------

#: Where the services are, and the list in each one's answer that holds the works.
SEARCH = {"CrossRef": "https://api.crossref.org/works", "OpenAlex": "https://api.openalex.org/works", "Semantic Scholar": "https://api.semanticscholar.org/graph/v1/paper/search"}


def crossref_url(title: str, authors: list[str], mailto: str = "") -> str:
    asked = {"query.bibliographic": title, "rows": CROSSREF_ROWS}
    if authors:
        asked["query.author"] = " ".join(authors[:CROSSREF_AUTHORS])
    return f"{SEARCH['CrossRef']}?{urllib.parse.urlencode(asked | ({'mailto': mailto} if mailto else {}))}"


def leads_url(title: str, authors: list[str], mailto: str = "") -> str:
    """A search for whatever resembles a citation, by its title and first authors together."""
    asked = {"query.bibliographic": " ".join([title, *authors[:CROSSREF_AUTHORS]]), "rows": CROSSREF_ROWS, "select": "title,author,container-title,issued,DOI"}
    return f"{SEARCH['CrossRef']}?{urllib.parse.urlencode(asked | ({'mailto': mailto} if mailto else {}))}"


def openalex_url(title: str, api_key: str = "") -> str:
    """The title travels in quotes, without the marks that would end it."""
    plain = " ".join(title.translate({ord(c): " " for c in N.FILTER_BREAKS + ","}).split())
    return f"{SEARCH['OpenAlex']}?{urllib.parse.urlencode({'filter': f'title.search:"{plain}"', 'per-page': CROSSREF_ROWS} | ({'api_key': api_key} if api_key else {}))}"


def s2_url(title: str) -> str:
    return f"{SEARCH['Semantic Scholar']}?{urllib.parse.urlencode({'query': title, 'limit': CROSSREF_ROWS, 'fields': 'title,authors,externalIds,url'})}"


def works_in(name: str, answer: object) -> list[str] | None:
    """The works in an answer as JSON texts; None where the list is missing, as that is no answer."""
    holder = answer.get("message") if name == "CrossRef" and isinstance(answer, dict) else answer
    works = holder.get({"CrossRef": "items", "OpenAlex": "results", "Semantic Scholar": "data"}[name]) if isinstance(holder, dict) else None
    if works is None and name == "Semantic Scholar" and isinstance(holder, dict) and holder.get("total") == 0:
        works = []
    return [json.dumps(w) for w in works] if isinstance(works, list) else None


def searching(name: str, ask: Callable[[str], tuple[str, object]], url: Callable[[str, list[str]], str]) -> Callable[[str, list[str]], list[str]]:
    """``Client``'s ``fetch`` for a service that is searched over HTTP; ``ask`` is ``Http.json`` or what a test puts in its place."""

    def fetch(title: str, authors: list[str]) -> list[str]:
        outcome, answer = ask(url(title, authors))
        if outcome == "rate_limited":
            raise Refused
        if outcome == "timeout":
            raise TimeoutError
        works = works_in(name, answer) if outcome == "ok" else None
        if works is None:
            raise ValueError(f"{name} gave no list of works")
        return works

    return fetch


def online(mailto: str = "", s2_key: str = "", openalex_key: str = "", keep: Callable[[DataFrame], DataFrame] = lambda df: df, retries: int = 2) -> list[verify.Backend]:
    """All services in the order of the cascade. Without a key the paced one is not asked at all."""
    from . import identifiers
    from .http import Http

    agent = f"citeloom (mailto:{mailto})" if mailto else "citeloom"
    crossref, openalex = Http(agent, retries=retries), Http(agent, retries=0)
    out = [
        backend("CrossRef", Client(searching("CrossRef", crossref.json, lambda t, a: crossref_url(t, a, mailto))), keep, N.query_forms, 2),
        identifiers.doi_backend(Http(agent, timeout=60, retries=retries).get, keep),
        identifiers.arxiv_backend(Http(agent, pace=3.0, retries=retries).get, keep),
        backend("OpenAlex", Client(searching("OpenAlex", openalex.json, lambda t, _: openalex_url(t, openalex_key)), give_up=OPENALEX_REFUSALS, retries=0), keep, N.query_forms_with_head, 3),
    ]
    if s2_key:
        keyed = Http(agent, retries=retries, pace=S2_PACE)
        out.append(backend("Semantic Scholar", Client(searching("Semantic Scholar", keyed.json, lambda t, _: s2_url(t))), keep))
    return out


def leads(refs: DataFrame, search: Callable[[str, list[str]], list[str]] | None = None, mailto: str = "", keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(ref_id, pos, title, authors, venue, year, doi): what a bibliographic search finds for citations (ref_id, title, authors). A hint
    must never fail an audit, so a search that fails finds nothing. ``search`` gives the bodies of works; the service's own by default."""
    if search is None:
        from .http import Http

        ask = Http(f"citeloom (mailto:{mailto})" if mailto else "citeloom", retries=0).json

        def search(title: str, authors: list[str]) -> list[str]:
            outcome, answer = ask(leads_url(title, authors, mailto))
            return works_in("CrossRef", answer) or [] if outcome == "ok" else []

    client = Client(search, retries=0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((r, t, list(a) if a is not None else []) for b in batches for r, t, a in b.itertuples(index=False))
        yield from frames(((ref, pos, body) for ref, _, bodies in client.ask(rows) for pos, body in enumerate(bodies)), "ref_id pos body")

    asked = refs.where(F.trim(F.coalesce("title", F.lit(""))) != "").select("ref_id", "title", "authors").coalesce(1)
    j = F.from_json("body", LEAD)
    got = keep(asked.mapInPandas(run, "ref_id string, pos int, body string")).select("ref_id", "pos", j.alias("j"))
    who = F.slice(_people(F.transform("j.author", lambda a: _full(a["given"], a["family"], F.lit("")))), 1, LEAD_AUTHORS)
    year = F.get(F.get(F.col("j.issued.date-parts"), F.lit(0)), F.lit(0))
    return got.select("ref_id", "pos", F.coalesce(F.get("j.title", F.lit(0)), F.lit("")).alias("title"), who.alias("authors"), F.coalesce(F.get("j.container-title", F.lit(0)), F.lit("")).alias("venue"), year.alias("year"), F.col("j.DOI").alias("doi"))
