"""The publication mirror as tables: ingest, deduplication, bridge, facts and the gate that a load must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import textnorm as N

#: Metadata that a mirror may or may not have.
META = ("year", "venue", "ee", "kind", "volume", "number", "pages")
#: A load of so many publications must hold an accented name; a mirror of fewer names says nothing.
GATE_PUBLICATIONS, FEWEST_NAMES = 1000, 1000


def first_by_key(rows: DataFrame, key: str = "key", ordinal: str = "ordinal") -> DataFrame:
    """Insert-or-ignore: of rows with the same key the first by ``ordinal`` stays."""
    other = [c for c in rows.columns if c not in (key, ordinal)]
    first = rows.groupBy(key).agg(F.min(F.struct(ordinal, *other)).alias("r"))
    return first.select(F.col(key), "r.*")


def with_meta(pub: DataFrame) -> DataFrame:
    """``pub`` with every metadata column; those that it lacks are null."""
    lacking = {c: F.lit(None).cast("int" if c == "year" else "string") for c in META if c not in pub.columns}
    return pub.withColumns(lacking) if lacking else pub


def author_dim(pub: DataFrame) -> DataFrame:
    """(author_id, name): each name once. Ids are hashes, so that no global order is needed."""
    return pub.select(F.explode("authors").alias("name")).distinct().select(F.xxhash64("name").alias("author_id"), "name")


def bridge(pub: DataFrame) -> DataFrame:
    """(pub_id, author_id, pos): each author of a publication once, at its first place in the byline."""
    each = pub.select(F.col("id").alias("pub_id"), F.posexplode("authors").alias("pos", "name"))
    return each.groupBy("pub_id", F.xxhash64("name").alias("author_id")).agg(F.min("pos").alias("pos"))


def authors_of(links: DataFrame, dim: DataFrame) -> DataFrame:
    """(pub_id, authors): bylines in their order, put together again from the bridge."""
    named = links.join(dim, "author_id")
    return named.groupBy("pub_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("authors"))


def _accented(name: Column) -> Column:
    return name.rlike(r"[^\x00-\x7F]")


def facts(pub: DataFrame) -> DataFrame:
    """One row: counts of publications and of distinct names, of accented ones, and whether author lists are to be trusted."""
    names = pub.select(F.explode("authors").alias("name")).distinct()
    n = names.agg(F.count("*").alias("author_count"), F.count_if(_accented(F.col("name"))).alias("accented"))
    return pub.agg(F.count("*").alias("publication_count")).crossJoin(n).withColumn("complete", (F.col("accented") > 0) | (F.col("author_count") < FEWEST_NAMES))


def check_load(pub: DataFrame, least: int = 0) -> None:
    """Refuse a load whose names have lost their accents, or that has fewer publications than a whole dump."""
    f = facts(pub).first()
    if f["publication_count"] < least:
        raise ValueError(f"{f['publication_count']} publications where a whole dump has {least} at least")
    if f["publication_count"] > GATE_PUBLICATIONS and not f["accented"]:
        raise ValueError(f"{f['publication_count']} publications and no accented author: the dump's entities were lost")


def build_age(facts_or_meta: DataFrame, built: str = "last_updated") -> DataFrame:
    """Days since the mirror was built, from seconds since the epoch kept as text."""
    return facts_or_meta.withColumn("age_days", (F.unix_timestamp() - F.col(built).cast("double")) / 86400)


def with_keys(pub: DataFrame) -> DataFrame:
    """``pub`` with the columns that every lookup uses; to be written with the table."""
    bare = N.without_edition(F.col("title"))
    return with_meta(pub).withColumns({"title_full": N.letters(bare), "title_head": N.subtitle_head(bare), "tokens": index_tokens(F.col("title"))})


def index_tokens(title: Column) -> Column:
    """A title's words as a text index would hold them: runs of letters and digits, strokes kept."""
    return F.regexp_extract_all(N.index_fold(F.coalesce(title, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)


def ingest(records: DataFrame) -> DataFrame:
    """Raw records (ordinal, key, title, authors, editors, ...) as publications: first of each key, editors where there
    are no authors, white space collapsed, trailing period of the title kept out of the way."""
    tidy = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"\s+", " "))
    people = F.when(F.size(F.coalesce("authors", F.array().cast("array<string>"))) > 0, F.col("authors")).otherwise(F.coalesce("editors", F.array().cast("array<string>")))
    some = records.where(F.col("key").isNotNull() & F.col("title").isNotNull()).withColumns({"title": tidy(F.col("title")), "authors": F.transform(people, tidy)}).drop("editors")
    once = first_by_key(some.where("title <> ''"))
    return once.withColumn("id", F.xxhash64("key"))


def postings(pub: DataFrame) -> DataFrame:
    """(token, pub_id, pos) of every title word."""
    return pub.select(F.col("id").alias("pub_id"), F.posexplode("tokens").alias("pos", "token")).select("token", "pub_id", "pos")


def latest(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Upsert as an append-only log: of each key the row with the greatest ``order``."""
    own = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")
