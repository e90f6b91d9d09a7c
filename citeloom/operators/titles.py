"""From a citation to the records that carry its title, and the choice among them.

Equal titles are equal keys, so retrieval is a hash join on (full letters, letters before the subtitle) and no text
index is asked. The retrieval predicates of an index (phrases, words, glued and dropped words) exist as
expressions beside it, for parity and for telling which citations can be asked about at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import textnorm as N
from . import skew

#: Fixed values.
LEAST_TOKENS, LONG_WORD, MOST_GROUPS, SPLIT_WORD, MOST_GLUED, MOST_DROPPED = 3, 4, 10, 3, 8, 12
NEAREST_EDITS, NEAREST_CANDIDATES, LEADS, LEAD_SIMILARITY = 2, 100, 3, 0.6

GROUP = "struct<joined:string,parts:array<string>>"


def phrases(title: Column) -> Column:
    """The distinct word sequences to look for: two foldings by two readings of hyphens, of three words at least."""
    t = F.coalesce(title, F.lit(""))
    read = [F.replace(t, F.lit("-"), F.lit("")), F.replace(t, F.lit("-"), F.lit(" "))]
    every = [F.regexp_extract_all(f(v), F.lit("[a-z0-9]+"), 0) for f in (N.fold, N.index_fold) for v in read]
    return F.filter(F.array_distinct(F.array(*every)), lambda p: F.size(p) >= LEAST_TOKENS)


def groups(title: Column) -> Column:
    """One group for each selective word: the word itself, or for one with punctuation its closed and its open reading."""
    words = F.filter(F.split(N.fold(F.coalesce(title, F.lit(""))), r"\s+"), lambda w: w != "")
    split = F.transform(words, lambda w: F.regexp_extract_all(w, F.lit("[a-z0-9]+"), 0))
    some = F.filter(split, lambda p: (F.size(p) > 1) | ((F.size(p) == 1) & (F.length(F.element_at(p, 1)) >= LONG_WORD)))
    return F.transform(some, lambda p: F.struct(F.array_join(p, "").alias("joined"), p.alias("parts")))


def glued(title: Column) -> Column:
    """Word lists with one short fragment glued to a neighbour; the last resort of retrieval."""
    spelled = F.filter(F.split(F.regexp_replace(N.fold(F.coalesce(title, F.lit(""))), "[^a-z0-9 ]", " "), " +"), lambda w: w != "")
    return N.let(spelled, _glued)


def _glued(words: Column) -> Column:
    at = F.sequence(F.lit(0), F.size(words) - 1)
    short = F.filter(at, lambda i: F.length(F.get(words, i)) <= SPLIT_WORD)

    def tries(i: Column) -> Column:
        def terms(j: Column) -> Column:
            merged = F.when(j > i, F.concat(F.get(words, i), F.get(words, j))).otherwise(F.concat(F.get(words, j), F.get(words, i)))
            rest = F.filter(words, lambda w, k: (k != i) & (k != j) & (F.length(w) >= LONG_WORD))
            return F.concat(F.array(merged), rest)

        ok = F.filter(F.array(i + 1, i - 1), lambda j: (j >= 0) & (j < F.size(words)))
        return F.transform(ok, terms)

    every = F.flatten(F.transform(short, tries))
    plain = F.array_sort(F.filter(words, lambda w: F.length(w) >= LONG_WORD))
    good = F.filter(every, lambda t: (F.size(t) >= LEAST_TOKENS) & (F.array_sort(t) != plain))
    return F.when(F.size(words) > 0, F.slice(F.array_distinct(F.transform(good, lambda t: F.slice(t, 1, MOST_GROUPS))), 1, MOST_GLUED + 1)).otherwise(F.expr("cast(array() as array<array<string>>)"))


def dropped_pairs(title: Column) -> Column:
    """Group lists with one adjacent pair left out."""
    return N.let(groups(title), _without_pairs)


def _without_pairs(g: Column) -> Column:
    at = F.sequence(F.lit(0), F.greatest(F.size(g) - 1, F.lit(0)))
    rest = F.transform(at, lambda i: F.filter(g, lambda _, k: (k != i) & (k != i + 1)))
    return F.slice(F.array_distinct(F.transform(F.filter(rest, lambda r: F.size(r) >= LEAST_TOKENS), lambda r: F.slice(r, 1, MOST_GROUPS))), 1, MOST_DROPPED)


#: Three words with a plain letter or digit each at a title's begin, which make a phrase under any folding; no part of it is read twice.
_THREE_WORDS = r"^\s*+(?:[^\sA-Za-z0-9]*+[A-Za-z0-9]\S*+\s++){2}[^\sA-Za-z0-9]*+[A-Za-z0-9]"


def queryable(title: Column) -> Column:
    """Whether there is enough in the title to ask about it; most titles say so by their first words."""
    return F.coalesce(title.rlike(_THREE_WORDS), F.lit(False)) | (F.size(phrases(title)) > 0) | (F.size(groups(title)) >= LEAST_TOKENS) | (F.size(glued(title)) > 0)


def holds_phrase(tokens: Column, phrase: Column) -> Column:
    padded = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return F.instr(padded(tokens), padded(phrase)) > 0 if isinstance(phrase, str) else F.contains(padded(tokens), padded(phrase))


def holds_group(tokens: Column, group: Column) -> Column:
    return F.array_contains(tokens, group["joined"]) | F.forall(group["parts"], lambda p: F.array_contains(tokens, p))


def retrieved(tokens: Column, title: Column) -> Column:
    """Whether the primary queries of a text index would find the record: a phrase, or all of the first ten groups."""
    g = F.slice(groups(title), 1, MOST_GROUPS)
    return F.exists(phrases(title), lambda p: holds_phrase(tokens, p)) | ((F.size(g) >= LEAST_TOKENS) & F.forall(g, lambda x: holds_group(tokens, x)))


def retrieved_late(tokens: Column, title: Column) -> Column:
    """Whether the fallback queries would: a glued word list, or groups without one pair."""
    return F.exists(glued(title), lambda t: F.forall(t, lambda w: F.array_contains(tokens, w))) | F.exists(dropped_pairs(title), lambda r: F.forall(r, lambda x: holds_group(tokens, x)))


def _title_class(title: Column) -> Column:
    """128 bits that stand for a title: what is found for it is found once, however many citations or records bear it."""
    return F.unhex(F.md5(F.coalesce(title, F.lit("")).cast("binary")))


def _held(pub: DataFrame) -> DataFrame:
    """(held, title, tokens): each title of a mirror once."""
    return pub.select(_title_class(F.col("title")).alias("held"), "title", "tokens").groupBy("held").agg(F.first("title").alias("title"), F.first("tokens").alias("tokens"))


def _asked(items: DataFrame, title: str) -> DataFrame:
    """(asked, title): each title that is asked about once."""
    return items.select(_title_class(F.col(title)).alias("asked"), F.col(title).alias("title")).groupBy("asked").agg(F.first("title").alias("title"))


def _every(pairs: DataFrame, items: DataFrame, pub: DataFrame, item: str, title: str, name: str) -> DataFrame:
    """(``name``, pub_id): every citation and every record of pairs of titles (asked, held). What is shuffled are the pairs of titles, and each
    citation once for each title that it meets; pairs of citations and records are only given out."""
    who = items.select(F.col(item).alias(name), _title_class(F.col(title)).alias("asked"))
    what = pub.select(F.col("id").alias("pub_id"), _title_class(F.col("title")).alias("held"))
    return pairs.join(who, "asked").select(name, "held").join(what, "held").select(name, "pub_id")


def and_retrieval(items: DataFrame, pub: DataFrame, item: str = "ref_id", title: str = "title") -> DataFrame:
    """(item, pub_id) where a record holds every one of the first ten groups of the item's title.

    Relational division: groups and titles meet on words, and a pair counts when all groups are met. A word that very many
    titles hold would make the join large, so only the group that fewest titles meet is joined; the others are tested where they meet, so that
    no pair is shuffled that does not hold. Equal titles meet once."""
    held = _held(pub)
    posted = held.select("held", "tokens", F.explode(F.array_distinct("tokens")).alias("word"))
    word = posted.groupBy("word").agg(F.count("*").alias("n"))
    asked = _asked(items, title).select("asked", F.slice(groups(F.col("title")), 1, MOST_GROUPS).alias("gs")).where(F.size("gs") >= LEAST_TOKENS)
    each = asked.select("asked", F.posexplode("gs").alias("g", "group"))
    ways = each.select("asked", "g", F.explode(F.array_distinct(F.array(F.col("group.joined"), F.element_at("group.parts", 1)))).alias("word"))
    cost = ways.join(word, "word", "left").groupBy("asked", "g").agg(F.sum(F.coalesce("n", F.lit(0))).alias("cost"), F.collect_set("word").alias("words"))
    rarest = cost.groupBy("asked").agg(F.min_by("words", F.struct("cost", "g")).alias("words"))
    tried = rarest.join(asked, "asked").select("asked", "gs", F.explode("words").alias("word"))
    met = tried.join(posted, "word").where(F.forall("gs", lambda x: holds_group(F.col("tokens"), x))).select("asked", "held").distinct()
    return _every(met, items, pub, item, title, "item")


def phrase_retrieval(items: DataFrame, pub: DataFrame, item: str = "ref_id", title: str = "title") -> DataFrame:
    """(item, pub_id) where a record's title holds one of the item's phrases. Phrases and titles meet on the word of the phrase that
    fewest titles hold; then the whole phrase is tested. Equal titles meet once."""
    posted = _held(pub).select("held", "tokens", F.explode(F.array_distinct("tokens")).alias("word"))
    word = posted.groupBy("word").agg(F.count("*").alias("n"))
    asked = _asked(items, title).select("asked", F.explode(phrases(F.col("title"))).alias("phrase"))
    rarest = asked.select("asked", "phrase", F.explode("phrase").alias("word")).join(word, "word", "left").groupBy("asked", "phrase").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("x"))
    met = rarest.select("asked", "phrase", F.col("x.word").alias("word")).join(posted, "word").where(holds_phrase(F.col("tokens"), F.col("phrase"))).select("asked", "held").distinct()
    return _every(met, items, pub, item, title, item)


def title_keys(full: Column, head: Column) -> Column:
    """A title's keys; a head that is the whole title is none of its own, so no pair of titles meets twice."""
    head = F.when(head != full, head).otherwise("")
    some = F.array(F.struct(full.alias("key"), F.lit(False).alias("is_head")), F.struct(head.alias("key"), F.lit(True).alias("is_head")))
    return F.filter(some, lambda k: k["key"] != "")


def candidates(refs: DataFrame, pub: DataFrame, parity: bool = False) -> DataFrame:
    """Every pair (citation, record) whose titles match: ``refs`` (ref_id, title, raw, doi, ...) and ``pub`` with keys.

    One equi-join on the letters: a whole title meets a whole title or a head, two heads don't meet; titles that very many citations or records
    bear are dealt to many tasks. ``parity`` keeps only what a text index would have retrieved, its fallback queries only where the primary
    ones gave nothing."""
    asked = refs.where(queryable(F.col("title"))).withColumn("loc", N.locators(F.col("raw"), F.col("doi")))
    cited = asked.withColumn("_k", F.explode(title_keys(N.letters(F.col("title")), N.subtitle_head(F.col("title"))))).select(*asked.columns, F.col("_k.key").alias("_ck"), F.col("_k.is_head").alias("_ch"))
    held = pub.select(F.struct(*pub.columns).alias("rec"), F.explode(title_keys(F.col("title_full"), F.col("title_head"))).alias("_r")).select("rec", F.col("_r.key").alias("_rk"), F.col("_r.is_head").alias("_rh"))
    met = skew.join(cited, held, "_ck", "_rk", ~(F.col("_ch") & F.col("_rh"))).drop("_ck", "_ch", "_rk", "_rh")
    if not parity:
        return met
    tier = F.when(retrieved(F.col("rec.tokens"), F.col("title")), 0).when(retrieved_late(F.col("rec.tokens"), F.col("title")), 1)
    tiered = met.withColumn("_t", tier).where("_t is not null")
    return tiered.withColumn("_m", F.min("_t").over(Window.partitionBy("ref_id"))).where("_t = _m").drop("_t", "_m")


def is_preprint(venue: Column) -> Column:
    return F.lower(F.trim(F.coalesce(venue, F.lit("")))) == "corr"


def venue_place(venue: Column) -> Column:
    """Published before preprint, and what has no venue behind both."""
    return F.when(venue.isNull(), 2).when(is_preprint(venue), 1).otherwise(0)


def choice_order(rec: str = "rec", loc: str = "loc") -> list[Column]:
    """Published before preprint, then the record whose DOI, pages, volume or year the citation prints, then the least id."""
    c = lambda f: F.col(f"{rec}.{f}")
    return [venue_place(c("venue")), *(~x for x in N.located(F.col(loc), c("ee"), c("pages"), c("volume"), c("number"), c("year"))), c("id")]


def first_choice(found: DataFrame) -> DataFrame:
    """(ref_id, id) of the candidate to show first; a reduction, so nothing is sorted."""
    return found.groupBy("ref_id").agg(F.min_by("rec.id", F.struct(*choice_order())).alias("id"))


def ranked(found: DataFrame) -> DataFrame:
    """Candidates with ``rank``, 1 being the one to show first."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("ref_id").orderBy(*choice_order())))


def record_context(refs: DataFrame, pub: DataFrame) -> DataFrame:
    """(ref_id, key, metadata) where exactly one record has the citation's letters; neither subtitles nor editions are forgiven. What
    citations of one id find is counted together."""
    primary = (F.size(phrases(F.col("title"))) > 0) | (F.size(groups(F.col("title"))) >= LEAST_TOKENS)
    cited = refs.where(primary).select("ref_id", N.letters(F.col("title")).alias("_l")).where("_l <> ''")
    held = pub.select(N.letters(F.col("title")).alias("_l"), "key", "year", "venue", "ee", "kind", "volume", "number", "pages")
    meta = [c for c in held.columns if c != "_l"]
    of_letters = held.groupBy("_l").agg(F.count("*").alias("_n"), *(F.min(c).alias(c) for c in meta))
    found = cited.join(of_letters, "_l").groupBy("ref_id").agg(F.sum("_n").alias("_n"), *(F.min(c).alias(c) for c in meta))
    return found.where("_n = 1").drop("_n")


# -- titles that are nearly the same -----------------------------------------------------------

_LETTERS = "".join(chr(c) for c in range(0x100, 0x600))


def word_edits(a: Column, b: Column, most: int = NEAREST_EDITS) -> Column:
    """Edits between two word lists, words being units; -1 beyond ``most``. Each word of the pair becomes one letter."""
    known = F.array_distinct(F.concat(a, b))
    spell = lambda ws: F.array_join(F.transform(ws, lambda w: F.substring(F.lit(_LETTERS), F.array_position(known, w).cast("int"), F.lit(1))), "")
    return F.levenshtein(spell(a), spell(b), most)


def _bits(words: Column) -> Column:
    """One of 64 bits for each word: a list that lacks some words of another lacks no more than so many of its bits."""
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(w), F.lit(64)).cast("int"))
    return F.aggregate(words, F.lit(0).cast("long"), lambda so_far, w: so_far.bitwiseOR(bit(w)))


def nearest(refs: DataFrame, pub: DataFrame, most: int = NEAREST_CANDIDATES) -> DataFrame:
    """(ref_id, pub_id, edits, place): records within two word edits of a title that no record carries, nearest first.

    A set-overlap join with a prefix filter: a record that lacks at most two of the groups holds one of any three, so
    citations and records meet on the words of the three rarest groups only, and the rest is verified where they meet. Equal titles
    meet once and have the same places, and of the records of a title none but the first ``most`` can get one."""
    read = F.struct(F.slice(groups(F.col("title")), 1, MOST_GROUPS).alias("gs"), N.title_words(F.col("title")).alias("want"))
    asked = _asked(refs, "title").select("asked", F.inline(F.array(read)))  # a generator, so that no filter takes a title apart again
    asked = asked.withColumn("want_bits", _bits(F.col("want"))).withColumn("miss", F.when(F.size("gs") >= 5, 2).when(F.size("gs") == 4, 1)).where("miss is not null")
    posted = _held(pub).select("held", "tokens", N.title_words(F.col("title")).alias("words")).withColumn("bits", _bits(F.col("words"))).withColumn("word", F.explode(F.array_distinct("tokens")))
    word = posted.groupBy("word").agg(F.count("*").alias("n"))
    ways = asked.select("asked", "miss", F.posexplode("gs").alias("g", "group")).select("asked", "miss", "g", F.explode(F.array_distinct(F.array(F.col("group.joined"), F.element_at("group.parts", 1)))).alias("word"))
    cost = ways.join(word, "word", "left").groupBy("asked", "miss", "g").agg(F.sum(F.coalesce("n", F.lit(0))).alias("cost"), F.collect_set("word").alias("ws"))
    place = F.row_number().over(Window.partitionBy("asked").orderBy("cost", "g"))
    prefix = cost.withColumn("_p", place).where(F.col("_p") <= F.col("miss") + 1).groupBy("asked").agg(F.array_distinct(F.flatten(F.collect_list("ws"))).alias("ws"))
    met = prefix.join(asked, "asked").withColumn("word", F.explode("ws")).drop("ws").join(posted, "word")
    enough = F.size(F.filter("gs", lambda x: holds_group(F.col("tokens"), x))) >= F.size("gs") - F.col("miss")
    close = (F.abs(F.size("words") - F.size("want")) <= NEAREST_EDITS) & (F.size(F.array_intersect("want", "words")) >= F.size(F.array_distinct("want")) - NEAREST_EDITS)
    alike = F.bit_count(F.col("want_bits").bitwiseAND(F.bitwise_not("bits"))) <= NEAREST_EDITS  # what most pairs of titles with a common word fail
    scored = met.where(alike & enough & close).withColumn("edits", word_edits(F.col("want"), F.col("words"))).where("edits >= 0").groupBy("asked", "held").agg(F.first("edits").alias("edits"))
    rows = pub.select(F.col("id").alias("pub_id"), venue_place(F.col("venue")).alias("venue"), _title_class(F.col("title")).alias("held"))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("held").orderBy("venue", "pub_id"))).where(F.col("_n") <= most).drop("_n")
    order = Window.partitionBy("asked").orderBy("edits", "venue", "pub_id")
    placed = scored.join(first, "held").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("asked", "pub_id", "edits", "place")
    return refs.select("ref_id", _title_class(F.col("title")).alias("asked")).join(placed, "asked").select("ref_id", "pub_id", "edits", "place")
