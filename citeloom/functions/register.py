"""The kernels as SQL functions: after ``register(spark)`` they may be used in any SQL text of the session.

``fold``, ``title_letters``, ``title_key`` (text), ``parse_reference``, ``first_doi`` (an entry), ``author_evidence``, ``absent_authors``
(two author lists), ``authors_match`` (two author lists, whether the source lists all authors), ``name_readings`` (a name), and the
table function ``segment_entries(TABLE(lines) PARTITION BY paper_id ORDER BY page_no, line_no)``."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import names, parse
from . import textnorm as N

_ENTRY = "paper_id string, number int, raw string, alt string, title string, authors array<string>, doi string, arxiv_id string, urls array<string>"


@F.pandas_udf(T.StringType())
def fold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else names.fold(t))


class SegmentEntries:
    """The entries of one paper's bibliography, from its lines in order."""

    def __init__(self) -> None:
        self.paper: str | None = None
        self.pages: dict[int, list[str]] = {}

    def eval(self, line: Row) -> None:
        self.paper = line["paper_id"]
        self.pages.setdefault(line["page_no"], []).append(line["text"] or "")

    def terminate(self) -> Iterator[tuple]:
        from ..operators import segment

        for entry in segment.extract([self.pages[k] for k in sorted(self.pages)])[0]:
            yield (self.paper, *entry)


@F.pandas_udf(T.BooleanType())
def authors_match(cited: pd.Series, record: pd.Series, complete: pd.Series) -> pd.Series:
    """The decision of ``names.authors_agree`` for two lists, as a function of its own."""
    rows = []
    for c, r, whole in zip(names.lists(cited), names.lists(record), complete, strict=True):
        matched, comparable, split, against = names.evidence([a for a in c if a], r)
        known = bool(whole) and not any(re.search(N.ET_AL, a.strip()) for a in r) and _lists_people(r)
        accounted = matched + split >= comparable
        rows.append(comparable > 0 and (accounted or (not known and not against and (matched >= 1 or not _lists_people(r)))))
    return pd.Series(rows, dtype=bool)


def _lists_people(authors: list[str]) -> bool:
    bare = (re.sub(N.HOMONYM, "", a.strip()) for a in authors)
    some = [a for a in bare if a and not re.search(N.CORPORATE, a) and not re.search(N.ET_AL, a)]
    return len(some) >= 2 or any(re.search(r"\S\s+\S", a) for a in some)


_PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(coalesce(t, '')), '-', ''), '\\s', ' '), '[^a-z0-9 ]', ''), ' +', ' '))"


def register(spark: SparkSession) -> None:
    kernels = {"fold": fold, "parse_reference": parse.parse_reference, "first_doi": parse.first_doi, "author_evidence": names.author_evidence, "absent_authors": names.absent_authors, "authors_match": authors_match, "name_readings": names.name_readings}
    for name, f in kernels.items():
        spark.udf.register(name, f)
    spark.udtf.register("segment_entries", F.udtf(SegmentEntries, returnType=_ENTRY))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION title_letters(t STRING) RETURNS STRING RETURN regexp_replace(fold(coalesce(t, '')), '[^a-z0-9]', '')")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION title_key(t STRING) RETURNS STRING RETURN CASE WHEN length({_PLAIN}) >= {N.KEY_LENGTH} THEN {_PLAIN} END")
