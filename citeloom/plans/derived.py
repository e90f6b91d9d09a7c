"""Publications, citations and page layouts derived from the driver's tables, each beside the SQL that derives the same.

A document with a word stands for a publication: eight words that lie evenly over all of its text are the title, and
longer words that lie so, in pairs, are its authors. Citations are publications under known corruptions, so what must come
of them is known as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import textnorm as N
from ..operators.measure import invented_name

VARIANTS = ("clean", "et_al", "first_only", "plus1", "swapped", "word_changed", "respaced")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))


def _spread(words: Column) -> Column:
    """Eight words that lie evenly over a list, which is computed once; all null of an empty one."""
    return N.let(words, lambda w: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.get(w, F.floor(k * F.size(w) / 8).cast("int"))))


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words are taken out of the texts by a generator: what is asked of titles and names later is not pushed below it, where each use
    would take the text apart again."""
    toks = _spread(F.regexp_extract_all("text", F.lit(r"\p{L}{2,}"), 0))
    long_words = N.let(_spread(F.regexp_extract_all("text", F.lit("[a-z]{5,}"), 0)), lambda w: F.when(F.get(w, F.lit(0)).isNotNull(), w).otherwise(F.array(*[F.lit("unnamed")] * 4, *[F.lit("author")] * 4)))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.inline(F.array(F.struct(toks.alias("toks"), long_words.alias("ws")))))
    i = F.col("doc_id")
    pair = lambda k: F.concat(_capital(F.get("ws", 2 * k)), F.lit(" "), _capital(F.get("ws", 2 * k + 1)))
    return d.where(F.get("toks", F.lit(0)).isNotNull()).select(
        i.alias("id"),
        F.concat("source", F.lit("/"), i.cast("string")).alias("key"),
        F.array_join("toks", " ").alias("title"),
        (1990 + i % 35).cast("int").alias("year"),
        F.when(i % 7 == 0, "CoRR").otherwise(F.col("source")).alias("venue"),
        F.concat(F.lit("https://doi.org/10.1000/"), "source", F.lit("/"), i.cast("string")).alias("ee"),
        F.lit("article").alias("kind"),
        (i % 50 + 1).cast("string").alias("volume"),
        (i % 12 + 1).cast("string").alias("number"),
        F.concat((i % 400 + 1).cast("string"), F.lit("-"), (i % 400 + 13).cast("string")).alias("pages"),
        F.transform(F.slice(F.array(*map(F.lit, range(4))), 1, (2 + i % 3).cast("int")), pair).alias("authors"),
    )


PUB = """
docs0 AS (SELECT doc_id, source, regexp_extract_all(text, '\\p{L}{2,}') AS toks, regexp_extract_all(text, '[a-z]{5,}') AS ws0 FROM documents),
docs1 AS (SELECT *, CASE WHEN len(ws0) > 0 THEN ws0 ELSE ['unnamed', 'author'] END AS ws FROM docs0),
pub AS (
  SELECT doc_id AS id, source || '/' || CAST(doc_id AS VARCHAR) AS key, array_to_string(list_transform(range(0, 8), lambda k: toks[1 + k * len(toks) // 8]), ' ') AS title, CAST(1990 + doc_id % 35 AS INTEGER) AS year,
         CASE WHEN doc_id % 7 = 0 THEN 'CoRR' ELSE source END AS venue, 'https://doi.org/10.1000/' || source || '/' || CAST(doc_id AS VARCHAR) AS ee, 'article' AS kind,
         CAST(doc_id % 50 + 1 AS VARCHAR) AS volume, CAST(doc_id % 12 + 1 AS VARCHAR) AS number,
         CAST(doc_id % 400 + 1 AS VARCHAR) || '-' || CAST(doc_id % 400 + 13 AS VARCHAR) AS pages,
         list_transform(range(0, 2 + doc_id % 3), lambda k: upper(ws[1 + 2 * k * len(ws) // 8][1]) || ws[1 + 2 * k * len(ws) // 8][2:] || ' ' || upper(ws[1 + (2 * k + 1) * len(ws) // 8][1]) || ws[1 + (2 * k + 1) * len(ws) // 8][2:]) AS authors
  FROM docs1 WHERE len(toks) > 0)"""

#: Letters of a title in SQL: strip_accents decomposes as the fold does, strokes and ligatures are spelled out by hand.
FOLD = "lower(strip_accents(replace(replace(replace(replace(replace(replace(replace({0}, 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'Œ', 'OE'), 'Æ', 'AE'), 'ø', 'o'), 'ł', 'l')))"
LETTERS = "regexp_replace(" + FOLD + ", '[^a-z0-9]', '', 'g')"


def citations(pub: DataFrame, variants: Sequence[str] = VARIANTS) -> DataFrame:
    """Every publication under each of ``variants``: (ref_id, paper_id, number, variant, key, title, authors, raw, doi). Others are not made, as
    together they hold a title seven times in one row."""
    toks, a, i = F.split("title", " "), F.col("authors"), F.col("id")
    new = invented_name(i)
    variant = lambda name, title, authors: F.struct(F.lit(VARIANTS.index(name)).alias("n"), F.lit(name).alias("variant"), title.alias("title"), authors.alias("authors"))
    t, first = F.col("title"), F.slice("authors", 1, 1)
    changed = F.concat_ws(" ", F.slice(toks, 1, 2), F.lit("Quorvexing"), F.slice(toks, 4, 5))
    every = (
        variant("clean", t, a),
        variant("et_al", t, F.concat(first, F.array(F.lit("et al.")))),
        variant("first_only", t, first),
        variant("plus1", t, F.concat(a, F.array(new))),
        variant("swapped", t, F.concat(F.array(new), F.slice("authors", 2, 10))),
        variant("word_changed", changed, a),
        variant("respaced", F.concat_ws("- ", F.concat_ws(" ", F.slice(toks, 1, 7)), F.slice(toks, 8, 1)), a),
    )
    each = pub.select(i.alias("pub"), "key", "year", "volume", "number", "pages", "ee", F.explode(F.array(*(every[VARIANTS.index(v)] for v in variants))).alias("v"))
    raw = F.concat(F.array_join("v.authors", ", "), F.lit(". "), F.col("v.title"), F.lit(". Vol. "), "volume", F.lit("("), "number", F.lit("), "), "pages", F.lit(", "), F.col("year").cast("string"), F.lit("."))
    return each.select(
        F.concat(F.col("pub").cast("string"), F.lit(":"), "v.variant").alias("ref_id"),
        F.concat(F.lit("paper"), F.expr("pub div 20").cast("string")).alias("paper_id"),
        (F.col("pub") % 20 * len(VARIANTS) + F.col("v.n") + 1).cast("int").alias("number"),
        "v.variant",
        "key",
        "v.title",
        "v.authors",
        raw.alias("raw"),
        F.lit(None).cast("string").alias("doi"),
        F.col("pub").alias("pub_id"),
    )


#: The citations of a publication with the status that each must get.
CITE = (
    PUB
    + """,
cite AS (
  SELECT CAST(id AS VARCHAR) || ':' || v AS ref_id, 'paper' || CAST(id // 20 AS VARCHAR) AS paper_id, CAST(id % 20 * 7 + n AS INTEGER) AS number, v AS variant, key, title, id AS pub_id, year, volume, number AS issue, pages, authors,
         CASE WHEN v IN ('plus1', 'swapped') THEN 'mismatch' WHEN v = 'word_changed' THEN 'not_found' ELSE 'verified' END AS status
  FROM pub, (VALUES (1, 'clean'), (2, 'et_al'), (3, 'first_only'), (4, 'plus1'), (5, 'swapped'), (6, 'word_changed'), (7, 'respaced')) AS x(n, v))"""
)


def layout(pub: DataFrame) -> DataFrame:
    """(paper_id, page_no, line_no, text): one paper for thirty ids, its bibliography bracketed, numbered or by author and
    year, each entry over three lines with a hanging indent, on pages with a running head."""
    paper = F.expr("id div 30")
    ranked = pub.select("*", paper.alias("paper")).withColumn("n", F.row_number().over(Window.partitionBy("paper").orderBy("id")))
    style, n = F.col("paper") % 3, F.col("n").cast("string")
    label = F.when(style == 0, F.concat(F.lit("["), n, F.lit("] "))).when(style == 1, F.concat(n, F.lit(". "))).otherwise(F.lit(""))
    byline = F.array_join("authors", ", ")
    first = F.concat(label, byline, F.when(style == 2, F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit(")"))).otherwise(F.lit(",")))
    second = F.concat(F.lit("      "), F.when(style == 2, F.concat("title", F.lit(" "), n, F.lit("."))).otherwise(F.concat(F.lit('"'), F.col("title"), F.lit(" "), n, F.lit(',"'))))
    third = F.concat(F.lit("      in Proceedings "), n, F.lit(" of Things, "), F.col("year").cast("string"), F.lit("."))
    each = ranked.select("paper", "n", F.posexplode(F.array(first, second, third)).alias("k", "text"))
    body = each.select("paper", (2 + F.floor((F.col("n") - 1) / 10)).cast("int").alias("page_no"), (10 * F.col("n") + F.col("k")).cast("int").alias("line_no"), "text")
    heads = body.select("paper", "page_no").distinct().select("paper", "page_no", F.lit(0).alias("line_no"), F.concat(F.lit("A running title of some length about things "), F.col("page_no").cast("string")).alias("text"))
    opening = F.explode(F.array(*(F.struct(F.lit(i).alias("line_no"), F.lit(t).alias("text")) for i, t in enumerate(("1 Introduction", "Some words of text about other things [1].", "", "References")))))
    top = ranked.select("paper").distinct().select("paper", opening.alias("x")).select("paper", F.lit(1).alias("page_no"), "x.line_no", "x.text")
    return top.unionByName(heads).unionByName(body).withColumn("paper_id", F.concat(F.lit("paper"), F.col("paper").cast("string"))).drop("paper")


#: The same lines in SQL.
LAYOUT = (
    PUB
    + """,
ranked AS (SELECT *, id // 30 AS paper, row_number() OVER (PARTITION BY id // 30 ORDER BY id) AS n, (id // 30) % 3 AS style FROM pub),
entry AS (
  SELECT paper, n, k, CASE k WHEN 0 THEN CASE style WHEN 0 THEN '[' || n || '] ' WHEN 1 THEN n || '. ' ELSE '' END || array_to_string(authors, ', ') || CASE style WHEN 2 THEN ' (' || year || ')' ELSE ',' END
                             WHEN 1 THEN '      ' || CASE style WHEN 2 THEN title || ' ' || n || '.' ELSE '"' || title || ' ' || n || ',"' END
                             ELSE '      in Proceedings ' || n || ' of Things, ' || year || '.' END AS text
  FROM ranked, (VALUES (0), (1), (2)) AS x(k)),
lines AS (
  SELECT paper, CAST(2 + (n - 1) // 10 AS INTEGER) AS page_no, CAST(10 * n + k AS INTEGER) AS line_no, text FROM entry
  UNION ALL SELECT DISTINCT paper, CAST(2 + (n - 1) // 10 AS INTEGER), 0, 'A running title of some length about things ' || (2 + (n - 1) // 10) FROM ranked
  UNION ALL SELECT DISTINCT paper, 1, i, t FROM ranked, (VALUES (0, '1 Introduction'), (1, 'Some words of text about other things [1].'), (2, ''), (3, 'References')) AS x(i, t))"""
)
