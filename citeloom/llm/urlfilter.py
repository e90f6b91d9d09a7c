"""URL filters, with DataFrame functions only: rules indexed by their rarest literal token.

A rule is a regular expression over host and path together with the tokens that every URL it fits must hold as
whole tokens. How often each such token occurs is counted over all URLs, the rule is filed under its rarest one,
and a URL runs only the expressions that its own tokens fetch. A rule without a certain token is tried always.

Rules come in two lists: listed rules (a host, with all its subdomains, and a path prefix; of those that fit the
longest decides, of equally long ones the greater string) and patterns (they decide where no listed rule fits).
Where nothing fits, the default verdict holds. A null URL, or one without ``://``, has an empty host and path; only
the default applies to it. Repeated rows are judged alike; an empty table gives an empty result; columns beside
the URL's are kept as they are.
"""

from __future__ import annotations

import re
import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many rules the index is a constant in the plan; beyond, a table that is joined.
INLINE_RULES = 256


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str
    regex: str
    tokens: tuple[str, ...]
    listed: bool


def listed(verdict: str, text: str) -> Rule:
    """``example.org/es/``: that host and its subdomains, paths from ``/es/`` on."""
    host, slash, path = text.partition("/")
    rest = slash + path
    known = [t for t in re.split(r"[^a-z0-9]+", host) if t]
    known += [m[1] for m in re.finditer(r"(?=/([a-z0-9]+)[^A-Za-z0-9])", rest)]
    return Rule(verdict, text, rf"^(?:[^/]*\.)?{_quoted(text)}", tuple(known), True)


def pattern(verdict: str, name: str, regex: str, *tokens: str) -> Rule:
    return Rule(verdict, name, regex, tokens, False)


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", text)


#: The rules of the contract, then the method's own patterns.
RULES = (
    listed("allow", "org/"),
    listed("block", "example.org/es/"),
    listed("block", "example.org/en/1"),
    listed("allow", "com/fr/"),
    listed("block", "com/de/"),
    pattern("block", "spam host", r"^[^/]*(?<![a-z0-9])spam(?![a-z0-9])[^/]*", "spam"),
    pattern("block", "casino host", r"^[^/]*(?<![a-z0-9])casino(?![a-z0-9])[^/]*", "casino"),
    pattern("block", "login page", r"^[^/]*/(?:.*/)?login(?:[./].*)?$", "login"),
)
DEFAULT = "allow"


def host(url: Column) -> Column:
    found = F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(place: Column) -> Column:
    """The distinct ASCII words of a host and path as they stand."""
    return F.array_distinct(F.regexp_extract_all(place, F.lit(r"[A-Za-z0-9]+"), 0))


def token_counts(places: DataFrame, rules: Sequence[Rule]) -> dict[str, int]:
    """In how many of the places (column ``place``) each token of the rules occurs; as many entries as those tokens."""
    names = sorted({t for r in rules for t in r.tokens})
    if not names:
        return {}
    known = F.array(*map(F.lit, names))
    seen = places.select(F.explode(F.array_intersect(tokens(F.col("place")), known)).alias("token"))
    return dict.fromkeys(names, 0) | {r["token"]: r["n"] for r in seen.groupBy("token").agg(F.count("*").alias("n")).collect()}


def _entry(i: int, r: Rule) -> Column:
    return F.struct(F.lit(len(r.text)).alias("len"), F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"), F.lit(r.regex).alias("regex"), F.lit(r.listed).alias("listed"), F.lit(i).alias("i"))


def _filed(rules: Sequence[Rule], counts: dict[str, int]) -> dict[str, list[tuple[int, Rule]]]:
    filed: dict[str, list[tuple[int, Rule]]] = {}
    for i, r in enumerate(rules):
        filed.setdefault(min(r.tokens, key=lambda t: (counts[t], t), default=""), []).append((i, r))
    return filed


def _best(fits: Column, is_listed: bool) -> Column:
    some = F.filter(fits, lambda c: c["listed"] == F.lit(is_listed))
    return F.array_max(F.transform(some, lambda c: F.struct(c["len"].alias("len"), c["text"].alias("text"), c["verdict"].alias("verdict"))))


def judge(urls: DataFrame, rules: Sequence[Rule] = RULES, default: str = DEFAULT, url: str = "url") -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` (the listed rule that decides, else null), ``pattern`` (the pattern
    that decides, else null) and ``verdict``. Columns of ``urls`` with these names are replaced."""
    new = ("host", "path", "rule", "pattern", "verdict")
    kept = [F.col(f"`{c}`") for c in urls.columns if c not in new]
    at = F.col(f"`{url}`")
    places = urls.select(F.concat(host(at), path(at)).alias("place"))
    filed = _filed(rules, token_counts(places, rules))
    always = F.array(*(_entry(i, r) for i, r in filed.pop("", []))) if "" in filed else None
    place = F.concat(host(at), path(at))
    if len(rules) <= INLINE_RULES:
        base = urls.select(*kept, place.alias("__place"))
        if filed:
            index = F.create_map(*(x for t, rs in filed.items() for x in (F.lit(t), F.array(*(_entry(i, r) for i, r in rs)))))
            known = F.array(*map(F.lit, filed))
            fetched = F.flatten(F.transform(F.array_intersect(tokens(F.col("__place")), known), lambda t: F.element_at(index, t)))
        else:
            fetched = F.expr("array()")
        candidates = F.concat(fetched, always) if always is not None and filed else always if always is not None else fetched
        fits = F.filter(candidates, lambda c: F.rlike(F.col("__place"), c["regex"])) if rules else None
        judged = base.withColumn("__fits", fits) if fits is not None else base.withColumn("__fits", F.array().cast("array<struct<len:int,text:string,verdict:string,regex:string,listed:boolean,i:int>>"))
    else:
        spark = urls.sparkSession
        table = spark.createDataFrame([(t, i, len(r.text), r.text, r.verdict, r.regex, r.listed) for t, rs in filed.items() for i, r in rs], "token string, i int, len int, text string, verdict string, regex string, listed boolean")
        each = urls.select(place.alias("place")).distinct()
        hits = each.select("place", F.explode(tokens(F.col("place"))).alias("token")).join(table, "token").where(F.rlike(F.col("place"), F.col("regex")))
        fits = hits.groupBy("place").agg(F.collect_set(F.struct("len", "text", "verdict", "regex", "listed", "i")).alias("__fits"))
        joined = urls.select(*kept, place.alias("__place")).alias("u").join(fits.alias("f"), F.col("u.__place") == F.col("f.place"), "left")
        none = F.expr("array()").cast("array<struct<len:int,text:string,verdict:string,regex:string,listed:boolean,i:int>>")
        own = F.coalesce(F.col("f.__fits"), none)
        extra = F.filter(always, lambda c: F.rlike(F.col("u.__place"), c["regex"])) if always is not None else none
        judged = joined.select("u.*", F.concat(own, extra).alias("__fits"))
    best = judged.withColumns({"__rule": _best(F.col("__fits"), True), "__pattern": _best(F.col("__fits"), False)})
    return best.select(
        *(F.col(f"`{c}`") for c in urls.columns if c not in new),
        host(at).alias("host"),
        path(at).alias("path"),
        F.col("__rule.text").alias("rule"),
        F.when(F.col("__rule").isNull(), F.col("__pattern.text")).alias("pattern"),
        F.coalesce("__rule.verdict", "__pattern.verdict", F.lit(default)).alias("verdict"),
    )


ORACLE = """
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
j AS (
  SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.verdict
  FROM p LEFT JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
  QUALIFY row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST, r.rhost || r.rpath DESC) = 1)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN regexp_matches(host, '(^|[^a-z0-9])(spam|casino)([^a-z0-9]|$)') OR regexp_matches(path, '^/(.*/)?login([./].*)?$') THEN 'block' ELSE 'allow' END) AS verdict
FROM j
"""
