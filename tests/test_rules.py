"""Samples, leads and mutants: the same for any partitioning, equal to their definitions, killed by some case each."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from citeloom.operators import leads, measure, mutants, titles
from citeloom.sources import backends


def test_a_sample_is_the_same_however_rows_lie(spark):
    import hashlib

    rows = [(f"k{i}", "ab"[i % 3 == 0], i) for i in range(500)] + [(None, "a", 1), ("k1", "b", 7)]
    df = spark.createDataFrame(rows, "key string, s string, v int")
    for strata in ([], ["s"]):
        some = [{(r["key"], r["s"], r["v"]) for r in measure.bottom_k(x, 5, "key", strata, 3).collect()} for x in (df, df.repartition(11), df.coalesce(1))]
        assert some[0] == some[1] == some[2]
        order = sorted(rows, key=lambda r: hashlib.md5(f"{r[0] or ''}:3".encode()).hexdigest())
        want = [[r for r in order if not strata or r[1] == s][:5] for s in ("ab" if strata else "x")]
        assert {r[0] for r in some[0]} == {r[0] for w in want for r in w} and len(some[0]) == 5 * len(want)
    plan = measure.bottom_k(df, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert measure.bottom_k(df.where("false"), 5).count() == 0


def test_matching_blocks_are_those_of_the_definition():
    r = random.Random(4)
    pairs = [("", ""), ("a", ""), ("abcd", "bcde"), ("x" * 250, "x" * 240 + "y"), ("testing of things", "things of testing")]
    words = ["".join(r.choice("abc ") for _ in range(r.randint(0, 12))) for _ in range(40)]
    pairs += [(" ".join(r.choices(words, k=r.randint(1, 30))), " ".join(r.choices(words, k=r.randint(1, 60)))) for _ in range(150)]
    for a, b in pairs:
        assert 2 * leads.matching(a, b) == pytest.approx(SequenceMatcher(None, a, b).ratio() * (len(a) + len(b)) if a or b else 0), (a, b)


def test_leads_that_are_left_out_could_not_have_counted(spark):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(12)]
    rows = [(f"r{i}", k, "A study: " + " ".join(words[i % 5 : i % 5 + 6]), " ".join(r.choices(words, k=r.randint(3, 9))) if k else None) for i in range(30) for k in range(12)]
    got = {}
    for x in leads.ranked(spark.createDataFrame(rows, "ref_id string, pos int, cited string, title string")).collect():
        got.setdefault(x["ref_id"], {})[x["place"]] = (x["pos"], x["title_similarity"])
    want = {}
    for ref in {x[0] for x in rows}:
        plain = lambda t: " ".join("".join(c for c in (t or "").lower().replace("-", "") if c.isalnum() or c == " ").split())
        scored = sorted(((-round(SequenceMatcher(None, plain(c), plain(t)).ratio(), 3), k) for x, k, c, t in rows if x == ref))[:3]
        kept = {p + 1: (k, -s) for p, (s, k) in enumerate(scored) if -s >= 0.6}
        if kept:
            want[ref] = kept
    assert got == want and len(want) > 3


def test_leads_are_sought_and_attached(spark):
    import json

    refs = spark.createDataFrame([("a", "Testing of things", ["Ann Berg"]), ("b", "Quite another matter", []), ("c", None, []), ("d", "Broken", [])], "ref_id string, title string, authors array<string>")
    asked = []

    def search(title, authors):
        asked.append(title)
        if title == "Broken":
            raise ValueError
        work = lambda t: json.dumps({"title": [t], "author": [{"given": "Ann", "family": "Berg"}, {}], "container-title": ["J"], "issued": {"date-parts": [[2001, 2]]}, "DOI": "10.1/x"})
        return [work("Testing things"), work("Zzz"), work("Testing of the things")] if "esting" in title else []

    got = {r["ref_id"]: r["candidates"] for r in leads.attached(refs, backends.leads(refs, search, keep=lambda df: df.cache())).collect()}
    assert [c["title"] for c in got["a"]] == ["Testing things", "Testing of the things"] or [c["title"] for c in got["a"]] == ["Testing of the things", "Testing things"]
    assert got["a"][0]["authors"] == ["Ann Berg"] and got["a"][0]["year"] == 2001 and got["a"][0]["doi"] == "10.1/x"
    assert got["b"] is None and got["c"] is None and got["d"] is None
    assert "query.bibliographic=T+A+B" in backends.leads_url("T", ["A", "B"]) and "select=" in backends.leads_url("T", [])


def test_every_mutant_is_killed(spark):
    none = F.lit(None).cast("string")
    cases = [(0, 0, 0, False, False, False), (1, 2, 1, False, True, True), (1, 2, 0, True, False, True), (1, 2, 0, False, True, True), (0, 2, 0, False, False, False), (0, 2, 0, False, False, True), (1, 2, 0, False, False, True)]
    rows = spark.createDataFrame(cases, "m int, c int, s int, x boolean, done boolean, listed boolean")
    e = F.struct(F.col("m").alias("matched"), F.col("c").alias("comparable"), F.col("s").alias("split"), F.col("x").alias("contradicted"))
    assert all(r["n"] > 0 for r in mutants.changed(rows, mutants.agreement(e, F.col("done"), F.col("listed"))).collect())
    verdicts = spark.createDataFrame([("likely-hallucinated", "yes", ""), ("partial-match", "yes", ""), ("unclear", "no", ""), ("partial-match", "yes", "T"), ("nothing", "no", "")], "category string, t string, m string")
    signal = F.struct(F.col("t").alias("title_match"), none.alias("authors_match"), none.alias("venue_match"), none.alias("doi_status"), F.col("m").alias("matched_title"))
    assert all(r["n"] > 0 for r in mutants.changed(verdicts, mutants.signals(F.col("category"), signal)).collect())
    record = lambda i, venue="X", ee=None, pages="5-9", volume="3", number="4", year=2000: (i, venue, ee, pages, volume, number, year)
    groups = {
        "preprint": [record(1, "CoRR", ee="https://doi.org/10.1/abc"), record(2, pages="7-8")],
        "doi": [record(1), record(2, ee="https://doi.org/10.1/abc")],
        "pages": [record(1), record(2, pages="11-19")],
        "volume": [record(1), record(2, volume="7")],
        "year": [record(1), record(2, year=2011)],
        "id": [record(1), record(2)],
    }
    found = spark.createDataFrame([(g, "pp. 11-19, vol. 7(4), 2011", "10.1/abc", r) for g, some in groups.items() for r in some], "ref_id string, raw string, doi string, rec struct<id:long,venue:string,ee:string,pages:string,volume:string,number:string,year:int>")
    from citeloom.functions import textnorm as N

    got = {r["mutant"]: r["n"] for r in mutants.choices(found.withColumn("loc", N.locators(F.col("raw"), F.col("doi")))).collect()}
    assert all(n > 0 for n in got.values()), got
    assert len(got) == len(titles.choice_order()) + 1


def test_ciphered_text_keeps_its_shape(spark):
    texts = ["[1] A. Berg and Bo Ek-Ström, \"Testing of Things,\" pp. 1-12, 2001.\n  Testing again", "", None, "ÄÖ x"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(measure.ciphered(F.col("t"))).collect()]
    shape = lambda t: "".join("A" if c.isupper() else "a" if c.isalpha() else c for c in t or "")
    assert [shape(t) for t in got] == [shape(t) for t in texts] and got[1] == got[2] == ""
    assert got[0].split("\"")[1].split()[0].lower() == got[0].split()[-2].lower() != "testing"
