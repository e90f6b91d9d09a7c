"""Text normalization as column expressions; no Python runs on the executors."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with a stroke, ligatures and the like, which no decomposition reaches.
STROKES = {
    "ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D",
    "ħ": "h", "Ħ": "H", "ı": "i", "İ": "I", "ŀ": "l", "Ŀ": "L", "ŧ": "t", "Ŧ": "T",
    "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ß": "ss", "ẞ": "SS", "þ": "th", "Þ": "TH",
}
#: Titles and names.
SUBTITLE_MARK = r"\s*[:–—]\s*|\s+-\s+"
EDITION = r"(?i)\s*(?:\(\s*\d+(?:st|nd|rd|th)?\.?\s*ed(?:ition|n)?\.?\s*\)|,\s*(?:\d+(?:st|nd|rd|th)|second|third|fourth|fifth)\s+ed(?:ition|n)?\.?|\(\s*reprint\s*\))\s*\.?$"
RETRACTED = r"(?i)^\s*(?:retracted(?:\s+article)?|withdrawn|expression\s+of\s+concern)\s*[:\-]\s*"
ARXIV = r"(?i)(?:arxiv(?:\.org)?[:/\s]*(?:preprint\s+)?(?:arxiv[:\s]*)?(?:abs/|pdf/)?|10\.48550/arxiv\.|\babs/)(\d{4}\.\d{4,5}(?!\d)|[a-z][a-z-]+(?:\.[A-Z]{2})?/\d{7}(?!\d))(?:v\d+)?"
HOMONYM = r"\s+\d{4}$"
VENUE_WORD = r"(?i)\b(?:proc|proceedings|conference|symposium|workshop|journal|transactions|press|arxiv|preprint|university|institute|editors?|eds?)\b"
CORPORATE = r"(?i)\b(?:teams?|labs?|group|consortium|collaboration|inc|ltd|foundation|project)\b"
ET_AL = r"(?i)^et\.?\s*al\.?$"
HEAD_WORDS, HEAD_LETTERS, KEY_LENGTH = 2, 12, 20


def fold_char(c: str, strokes: bool = True) -> str:
    mapped = STROKES.get(c, c) if strokes else c
    return "".join(x for x in unicodedata.normalize("NFKD", mapped) if not unicodedata.combining(x)).lower()


@cache
def _tables(strokes: bool) -> tuple[str, str, dict[str, str]]:
    """Single letters and what replaces them (what has nothing is dropped), and those that become several letters.

    Hangul is left out: it decomposes by a rule, and never to anything that a key keeps."""
    one, gone, many = {}, [], {}
    for n in (*range(0x80, 0xAC00), *range(0xE000, 0x10000), *range(0x1D400, 0x1D800)):
        c = chr(n)
        if c in "Σς":
            continue
        f = fold_char(c, strokes)
        if len(f) == 1 and f != c:
            one[c] = f
        elif not f:
            gone.append(c)
        elif len(f) > 1 and not (strokes and c in STROKES):
            many[c] = f
    return "".join(one) + "".join(gone), "".join(one.values()), many


#: Letters of which none becomes several (but for those in ``STROKES``).
_COMMON = r"[\u00C0-\u0131]"


def _fold(text: Column, strokes: bool) -> Column:
    find, put, many = _tables(strokes)
    if strokes:  # the frequent ones; the rest of what becomes several letters is rare and looked up letter by letter
        for c, f in STROKES.items():
            if len(f) > 1:
                text = F.replace(text, F.lit(c), F.lit(f))
    index = F.from_json(F.lit(json.dumps(many)), "map<string,string>")  # folds into one constant

    def folded(t: Column) -> Column:
        # some dozen letters, whatever the text's length; in order, as what a letter becomes has a lower code and is not replaced again
        odd = F.array_sort(F.array_distinct(F.split(F.regexp_replace(t, "[\\x00-\\x7F]+", ""), "")))
        single = lambda c: F.translate(c, find, put)
        plain = lambda c: F.when(c.rlike(_COMMON), single(c)).otherwise(F.coalesce(F.try_element_at(index, c), single(c)))
        return F.lower(F.when(t.rlike("[^\\x00-\\x7F]"), F.aggregate(odd, t, lambda text, c: F.replace(text, c, plain(c)))).otherwise(t))

    return let(text, folded)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def fold(text: Column) -> Column:
    """Lower case without diacritics; strokes and ligatures spelled out."""
    return _fold(text, True)


def index_fold(text: Column) -> Column:
    """Like ``fold``, but letters with a stroke stay as they are."""
    return _fold(text, False)


def _text(t: Column) -> Column:
    return F.coalesce(t, F.lit(""))


def letters(title: Column) -> Column:
    """A title's letters and digits: the key on which titles are joined."""
    return F.regexp_replace(fold(_text(title)), "[^a-z0-9]", "")


def subtitle_head(title: Column) -> Column:
    """The letters before the subtitle mark, if they are enough to name a work; else an empty string."""
    t = _text(title)

    def of(head: Column) -> Column:
        words = F.size(F.regexp_extract_all(head, F.lit(r"\S+"), 0))
        return F.when((head == t) | (words < HEAD_WORDS), "").otherwise(let(letters(head), lambda key: F.when(F.length(key) >= HEAD_LETTERS, key).otherwise("")))

    return let(F.element_at(F.split(t, SUBTITLE_MARK, 2), 1), of)


def without_edition(title: Column) -> Column:
    return F.regexp_replace(_text(title), EDITION, "")


def titles_match(cited: Column, record: Column) -> Column:
    """Equal letters, or one side's head equal to the whole other side; an edition on the record doesn't count."""
    bare = without_edition(record)
    c, r = letters(cited), letters(bare)
    return (c != "") & (r != "") & ((c == r) | (subtitle_head(cited) == r) | (subtitle_head(bare) == c))


def _words_only(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9\s]+", ""), r"\s+", " "))


def normalized_title(title: Column) -> Column:
    return _words_only(fold(_text(title)))


def plain_title(title: Column) -> Column:
    """As ``normalized_title`` but with plain lower-casing, so accented letters are dropped."""
    return _words_only(F.lower(_text(title)))


def title_words(title: Column) -> Column:
    return F.regexp_extract_all(fold(F.replace(_text(title), F.lit("-"), F.lit(""))), F.lit("[a-z0-9]+"), 0)


def title_key(title: Column) -> Column:
    """The key on which duplicates are grouped; null for titles that are too short."""
    return let(plain_title(title), lambda key: F.when(F.length(key) >= KEY_LENGTH, key))


def full_key(raw: Column) -> Column:
    """A whole citation as a key; a letter after the year doesn't count."""
    return plain_title(F.regexp_replace(_text(raw), r"\((\d{4})[a-z]\)", "($1)"))


@cache
def _entities() -> str:
    return json.dumps({f"&{n}": c for n, c in html5.items() if n.endswith(";")})


def unescaped(text: Column) -> Column:
    """Named and numbered character references as the characters they stand for, each resolved once."""
    named = F.from_json(F.lit(_entities()), "map<string,string>")
    code = lambda e, at, base: F.conv(F.substring(e, F.lit(at), F.length(e) - at), base, 10).cast("long")
    number = lambda e: F.when(F.lower(e).startswith("&#x"), code(e, 4, 16)).when(e.startswith("&#"), code(e, 3, 10))
    letter = lambda n: F.when((n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    meaning = lambda e: F.coalesce(F.element_at(named, e), letter(number(e)), e)
    last = lambda e: F.struct((meaning(e) == "&").alias("amp"), e.alias("e"))  # an ampersand that comes out must not begin another

    def resolve(t: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(t, F.lit(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"), 0))
        ordered = F.transform(F.array_sort(F.transform(found, last)), lambda x: x["e"])
        return F.aggregate(ordered, t, lambda so_far, e: F.replace(so_far, e, meaning(e)))

    return F.when(text.contains("&") & text.contains(";"), let(text, resolve)).otherwise(text)


def plain(text: Column) -> Column:
    """Without markup, with character references resolved and white space collapsed."""
    out = unescaped(F.regexp_replace(_text(text), "<[^>]{1,40}>", ""))
    return F.trim(F.regexp_replace(out, "[\\s\u00a0]+", " "))


def is_retracted_title(title: Column) -> Column:
    return _text(title).rlike(RETRACTED)


def without_retraction(title: Column) -> Column:
    return F.regexp_replace(_text(title), RETRACTED, "")


def clean(text: Column) -> Column:
    """White space collapsed; a hyphen at a line's end closed unless a conjunction follows."""
    return F.regexp_replace(F.trim(F.regexp_replace(_text(text), r"\s+", " ")), r"(?<=[A-Za-z])-\s+(?!(?:and|or|und|oder)\s)(?=[A-Za-z])", "-")


def query_forms(title: Column) -> Column:
    """The title, and the title without its hyphens."""
    return F.array_distinct(F.array(title, F.replace(title, F.lit("-"), F.lit(""))))


def query_forms_with_head(title: Column) -> Column:
    head = F.element_at(F.split(title, SUBTITLE_MARK, 2), 1)
    some = F.array(title, F.replace(title, F.lit("-"), F.lit("")), F.when(subtitle_head(title) != "", F.trim(head)))
    return F.array_distinct(F.filter(some, lambda x: x.isNotNull()))


#: Marks that would end a quoted title in a service's filter.
FILTER_BREAKS = "\"'`´‘’‚‛“”„‟′″«»?"


def without_filter_breaks(text: Column) -> Column:
    return F.translate(text, FILTER_BREAKS, " " * len(FILTER_BREAKS))


def arxiv_key(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), r"v\d+$", ""), r"^([a-z\-]+)\.[a-z]{2}/", "$1/")


def record_doi(ee: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(F.trim(_text(ee))), r"^https?://(?:dx\.)?doi\.org/(.+)$", 1), F.lit(""))


def fingerprint(raw: Column) -> Column:
    """The first 12 hexadecimal digits of the SHA-1 of a citation's text."""
    return F.left(F.sha1(_text(raw).cast("binary")), F.lit(12))


def natural_key(name: Column) -> Column:
    """Sorts digits within names by value: every run of digits padded to 20 places."""
    parts = F.regexp_extract_all(_text(name), F.lit(r"\d+|\D+"), 0)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(F.lower(p))), "")


def surname(name: Column) -> Column:
    """What stands before the comma, or the name without a trailing run of capitals."""
    n = F.trim(name)
    bare = F.trim(F.regexp_replace(n, r"\s+[A-ZÀ-ÖØ-Þ]{1,4}$", ""))
    return F.when(n.contains(","), F.trim(F.substring_index(n, ",", 1))).when(bare != "", bare).otherwise(n)


def head_norm(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(line, r"\d+", ""), r"\s+", " "))


def furniture_norm(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(line, r"^[\d:.\s]+|[\d:.\s]+$", ""), r"\s+", " "))


def is_contact(text: Column) -> Column:
    """Whether an address with a non-empty local part stands in the text."""
    return F.coalesce(F.trim(text).rlike(r"^[^@\s]+@"), F.lit(False))


# -- what a citation prints ------------------------------------------------------------------


def cited_years(raw: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(_text(raw), F.lit(r"(?<![\d/.])((?:19|20)\d{2})(?!\d|\.\d)"), 1))


def cited_dois(raw: Column, doi: Column | None = None) -> Column:
    found = F.regexp_extract_all(_text(raw), F.lit(r"(?i)10\.\d{4,9}/[^\s\"'<>]+"), 0)
    both = F.concat(F.array(doi), found) if doi is not None else found
    lowered = F.transform(F.filter(both, lambda d: d.isNotNull()), lambda d: F.regexp_replace(F.lower(F.trim(d)), r"[.,;)]+$", ""))
    return F.array_distinct(F.filter(lowered, lambda d: d != ""))


def arxiv_id(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(_text(raw), ARXIV, 1), F.lit(""))


def urls(raw: Column) -> Column:
    def trimmed(u: Column) -> Column:
        bare = F.regexp_replace(u, "[.,;:'’”\"‘“]+$", "")
        return F.when(bare.rlike(r"^[^(]*\)+$"), F.regexp_replace(bare, r"\)+$", "")).when(bare.rlike(r"^[^\[]*\]+$"), F.regexp_replace(bare, r"\]+$", "")).otherwise(bare)

    return F.transform(F.regexp_extract_all(_text(raw), F.lit(r"(?i)https?://[^\s<>\"]+"), 0), trimmed)


_DASH = r"[-‐-—−]"


def doi_match(record_ee: Column, dois: Column) -> Column:
    return F.coalesce(F.array_contains(dois, record_doi(record_ee)), F.lit(False))


def pages_match(pages: Column, raw: Column) -> Column:
    """Whether both ends of the record's page range are printed, with any dash."""
    p = F.trim(_text(pages))
    first, last = F.regexp_extract(p, r"^(\d+)-(\d+)$", 1), F.regexp_extract(p, r"^(\d+)-(\d+)$", 2)
    return (first != "") & F.rlike(_text(raw), F.concat(F.lit(r"(?<!\d)"), first, F.lit(rf"\s*{_DASH}+\s*"), last, F.lit(r"(?!\d)")))


def volume_match(volume: Column, number: Column, pages: Column, raw: Column) -> Column:
    """Whether the record's volume is printed: as such, or with its issue or its first page beside it."""
    v, n, first, r = F.trim(_text(volume)), F.trim(_text(number)), F.regexp_extract(F.trim(_text(pages)), r"^(\d+)", 1), _text(raw)
    like = lambda *parts: F.rlike(r, F.concat(*parts))
    named = like(F.lit(r"(?i)\bvol(?:ume)?\.?\s*"), v, F.lit(r"(?!\d)"))
    issue = like(F.lit(r"(?<![\d.])"), v, F.lit(r"\s*\(\s*"), n, F.lit(r"\s*\)")) | like(F.lit(r"(?i)(?<![\d.])"), v, F.lit(r"\s*,\s*(?:no\.?\s*)?"), n, F.lit(r"(?!\d)"))
    page = like(F.lit(r"(?<![\d.])"), v, F.lit(r"\s*,\s*(?:pp?\.?\s*)?"), first, F.lit(rf"\s*{_DASH}"))
    digits = lambda c: c.rlike(r"^\d+$")
    return digits(v) & (named | (digits(n) & issue) | ((first != "") & page))


def locators(raw: Column, doi: Column | None = None) -> Column:
    """All that a citation prints to tell records of one title apart, read once so that pairs need no pattern of their own:
    DOIs, years, page ranges ``a-b``, volumes, ``v(n)``, ``v,n`` and ``v,first-``."""
    r = _text(raw)
    every = lambda pattern: F.regexp_extract_all(r, F.lit(pattern), 1)
    bare = lambda found: F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), r"[a-z.\s]+", ""), f"{_DASH}+", "-"))
    return F.struct(
        cited_dois(raw, doi).alias("dois"),
        cited_years(raw).alias("years"),
        bare(every(rf"(?<!\d)(?=(\d+\s*{_DASH}+\s*\d+))")).alias("ranges"),
        every(r"(?i)\bvol(?:ume)?\.?\s*(\d+)").alias("volumes"),
        bare(every(r"(?<![\d.])(?=(\d+\s*\(\s*\d+\s*\)))")).alias("issues"),
        bare(every(r"(?i)(?<![\d.])(?=(\d+\s*,\s*(?:no\.?\s*)?\d+))")).alias("commas"),
        bare(every(rf"(?<![\d.])(?=(\d+\s*,\s*(?:pp?\.?\s*)?\d+\s*{_DASH}))")).alias("firsts"),
    )


def located(loc: Column, ee: Column, pages: Column, volume: Column, number: Column, year: Column) -> list[Column]:
    """Whether a citation's locators name a record: by DOI, pages, volume and year."""
    has = lambda field, value: F.coalesce(F.array_contains(loc[field], value), F.lit(False))
    v, n, p = F.trim(_text(volume)), F.trim(_text(number)), F.trim(_text(pages))
    first = F.regexp_extract(p, r"^(\d+)", 1)
    issue = n.rlike(r"^\d+$") & (has("issues", F.concat(v, F.lit("("), n, F.lit(")"))) | has("commas", F.concat(v, F.lit(","), n)))
    volumed = v.rlike(r"^\d+$") & (has("volumes", v) | issue | ((first != "") & has("firsts", F.concat(v, F.lit(","), first, F.lit("-")))))
    return [has("dois", record_doi(ee)), p.rlike(r"^\d+-\d+$") & has("ranges", p), volumed, has("years", year.cast("string"))]


# -- people in author lists -------------------------------------------------------------------


def is_person(name: Column) -> Column:
    n = F.regexp_replace(F.trim(_text(name)), HOMONYM, "")
    words = F.size(F.regexp_extract_all(n, F.lit(r"\S+"), 0))
    return (n != "") & ~n.rlike(r"[\d()\[\]]") & ~(n.rlike(VENUE_WORD) & (words > 3))


def lists_people(authors: Column) -> Column:
    bare = F.transform(F.coalesce(authors, F.expr("cast(array() as array<string>)")), lambda a: F.regexp_replace(F.trim(_text(a)), HOMONYM, ""))
    some = F.filter(bare, lambda a: (a != "") & ~a.rlike(CORPORATE) & ~a.rlike(ET_AL))
    return (F.size(some) >= 2) | F.exists(some, lambda a: a.rlike(r"\S\s+\S"))


def record_authors_complete(authors: Column) -> Column:
    cut = F.exists(F.coalesce(authors, F.expr("cast(array() as array<string>)")), lambda a: F.trim(_text(a)).rlike(ET_AL))
    return ~cut & lists_people(authors)
