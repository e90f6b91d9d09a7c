"""Sources, connectors, the stream, the command line and the driver's entry."""

import json

import pytest
from pyspark.sql import functions as F

from citeloom.operators import mirror, verify
from citeloom.plans import commands
from citeloom.sources import backends, commits, dump, http, identifiers, papers
from citeloom.streaming import incremental

XML = """<?xml version="1.0" encoding="ISO-8859-1"?>
<dblp>
<article mdate="2020-01-01" key="journals/x/1"><author>J&uuml;rgen B&auml;r</author><author>Ann &amp; Co</author><title>On <i>N</i> testing
 of things.</title><year>2001</year><journal>X</journal><pages>1-2</pages><ee>https://doi.org/10.1/1</ee><ee>https://x.org</ee></article>
<book key="books/y/2"><editor>Ed Itor</editor><title>A book of tests</title><year>1999</year><publisher>P</publisher></book>
<www key="homepages/z"><author>Nobody</author><title>Home Page</title></www>
</dblp>
"""


def test_dump_to_mirror(spark, tmp_path):
    (tmp_path / "dump.xml").write_text(XML, "ISO-8859-1")
    assert commands.ingest(spark, str(tmp_path / "dump.xml"), str(tmp_path / "pub"), str(tmp_path / "work"), least=2) == 0
    with pytest.raises(ValueError):
        commands.ingest(spark, str(tmp_path / "dump.xml"), str(tmp_path / "pub"), str(tmp_path / "work"), least=3)
    (tmp_path / "pub").rename(tmp_path / "pub.old")  # as a crash between two renames leaves it
    assert commands.mirror_at(spark, str(tmp_path / "pub"))[1].count() == 2
    (tmp_path / "pub.old").rename(tmp_path / "pub")
    got = {r["key"]: r for r in spark.read.parquet(str(tmp_path / "pub")).collect()}
    assert set(got) == {"journals/x/1", "books/y/2"}
    assert got["journals/x/1"]["authors"] == ["Jürgen Bär", "Ann & Co"] and got["journals/x/1"]["title"] == "On N testing of things."
    assert got["journals/x/1"]["ee"] == "https://doi.org/10.1/1" and got["books/y/2"]["authors"] == ["Ed Itor"] and got["books/y/2"]["venue"] == "P"
    assert dump.resolve("&foo; &lt;&eacute;") == "&foo; &lt;&#233;"
    assert dump.newest_month(2024, 2, 3) == [(2024, 2), (2024, 1), (2023, 12), (2023, 11)]
    assert dump.accepted(b"\x1f\x8bxx", "AB", "ab  file") and not dump.accepted(b"PK", "ab", "ab")


def test_audit_of_text_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    entries = "\n".join(f'[{i}] A. Berg and B. Ek, "Study number {i} of large things,"\n     in Proceedings of Tests {i}, 20{10 + i}.' for i in range(1, 6))
    (tmp_path / "in/p1.txt").write_text(f"Intro [1]\fReferences\n{entries}\n")
    (tmp_path / "in/p2.TXT").write_text("No bibliography here\n")
    with pytest.raises(FileNotFoundError):
        papers.text_lines(spark, str(tmp_path / "empty*"))if (tmp_path / "empty1").mkdir() is None else None
    pub = spark.createDataFrame([(1, "k/1", "Study Number 1 of Large Things", ["Anna Berg", "Bert Ek"]), (2, "k/2", "Study Number 2 of Large Things", ["Xo Yz"])], "id long, key string, title string, authors array<string>")
    mirror.with_keys(pub).write.parquet(str(tmp_path / "pub"))
    from citeloom.__main__ import arguments

    run = lambda *a: commands.run(spark, arguments([*a, "--out", str(tmp_path / "out")]))
    assert run("audit", str(tmp_path / "in"), "--mirror", str(tmp_path / "pub"), "--offline", "--retry-degraded", "1") == 4
    refs = {r["number"]: r for r in commands.table(spark, str(tmp_path / "out"), "references").collect()}
    assert [refs[i]["status"] for i in range(1, 6)] == ["verified", "mismatch", "not_found", "not_found", "not_found"] and refs[3]["label"] == "[3]"
    with pytest.raises(SystemExit):
        run("record", "p1", "2", "likely-hallucinated", "why")
    run("record", "p1", "2", "likely-hallucinated", "why", "--signals", '{"title_match": "no"}')
    run("worklist", "--pending")
    assert sorted(json.loads(x["value"])["number"] for x in spark.read.text(str(tmp_path / "out/worklist")).collect()) == [3, 4, 5]
    run("worklist", "--paper", "p9")
    assert spark.read.text(str(tmp_path / "out/worklist-p9")).count() == 0
    run("status")
    assert [json.loads(x["value"])["pending"] for x in spark.read.text(str(tmp_path / "out/status")).collect()] == [3]
    run("report")
    lines = lambda name: [x for r in spark.read.json(str(tmp_path / f"out/{name}")).collect() for x in r["markdown"].split("\n")] if name != "rollup" else [r["value"] for r in spark.read.text(str(tmp_path / "out/rollup")).collect()]
    assert "| p1 | 5 | 4 | 1 | 0 | 0 |" in lines("rollup") and any("| #2 |" in x and "high" in x for x in lines("sheet"))
    good, bad = papers.records(spark, commits.path_of(spark, str(tmp_path / "out"), "records"), lines=True)
    assert {(r["paper_id"], len(r["references"])) for r in good.collect()} == {("p1", 5), ("p2", 0)} and bad.count() == 0
    with pytest.raises(SystemExit):
        run("audit", str(tmp_path / "in"), "--offline", "--disable-dbs", "Nope")
    (tmp_path / "bad").mkdir()
    assert run("audit", str(tmp_path / "in"), "--mirror", str(tmp_path / "bad"), "--offline") == 4
    assert {r["degraded"] for r in commands.table(spark, str(tmp_path / "out"), "references").collect()} == {True}
    run("audit", str(tmp_path / "in"), "--mirror", str(tmp_path / "pub"), "--offline")
    other = lambda *a: commands.run(spark, arguments([*a, "--out", str(tmp_path / "other")]))
    assert other("audit", str(tmp_path / "in"), "--mirror", str(tmp_path / "bad"), "--offline") == 4 and other("compare", str(tmp_path / "out")) == 1
    assert {(r["old_status"], r["new_status"]) for r in spark.read.json(str(tmp_path / "other/compared/moved")).collect()} == {("verified", "not_found")}
    assert run("compare", str(tmp_path / "out")) == 0
    run("record", "p1", "3", "real-published", "seen", "--signals", '{"title_match": "no"}')
    run("report")
    assert any("- Warning: a real work" in x for x in lines("reports")) and any(x.startswith("## [3]: ") for x in lines("reports"))
    assert any("likely-hallucinated (severity high)" in r["value"] for r in spark.read.text(str(tmp_path / "out/reports")).collect())


def _record(paper, number, status):
    return {"schema_version": 1, "paper_id": paper, "num_references": 1, "references": [{"original_number": number, "raw_citation": "r", "db_verification": None if status is None else {"status": status, "failed_dbs": []}}]}


def test_records_rejects_and_stream(spark, tmp_path):
    (tmp_path / "r").mkdir()
    for i, (p, s) in enumerate([("a", "verified"), ("b", None), ("c", "mismatch")]):
        (tmp_path / f"r/{i}.json").write_text(json.dumps(_record(p, 1, s)))
    table, mark = str(tmp_path / "table"), str(tmp_path / "mark")
    incremental.audit(incremental.stream(spark, str(tmp_path / "r")), table, mark).awaitTermination()
    (tmp_path / "r/9.json").write_text(json.dumps(_record("c", 1, "verified")))
    incremental.audit(incremental.stream(spark, str(tmp_path / "r")), table, mark).awaitTermination()
    assert {(r["paper_id"], r["status"]) for r in incremental.current(spark, table).collect()} == {("a", "verified"), ("b", None), ("c", "verified")}
    assert {r["paper_id"]: r["pending"] for r in incremental.status(spark, table).collect()} == {"a": 0, "b": 1, "c": 0}
    (tmp_path / "r/x.json").write_text("{not json")
    (tmp_path / "r/y.json").write_text('{"other": 1}')
    good, bad = papers.records(spark, str(tmp_path / "r"))
    assert good.count() == 4 and sorted(r["unreadable"] for r in bad.collect()) == [False, True]


def test_service_records(spark):
    bodies = {
        "CrossRef": {"title": ["RETRACTED: On <i>N</i>"], "subtitle": ["a survey"], "author": [{"given": "Ann", "family": "Berg"}, {"name": "The Team"}, {}], "DOI": "10.1/x", "update-to": [{"type": "Retraction"}]},
        "DOI": {"title": "T", "author": [{"literal": "L"}], "DOI": "10.1/y"},
        "OpenAlex": {"display_name": "T", "authorships": [{"raw_author_name": "A  B"}], "is_authors_truncated": True, "id": "W1"},
        "Semantic Scholar": {"title": "T", "authors": [{"name": "A B"}], "externalIds": {"DOI": "10.1/z"}},
    }
    got = {}
    for name, body in bodies.items():
        answers = spark.createDataFrame([("r", 0, json.dumps(body)), ("s", 0, "{}")], "ref_id string, pos int, body string")
        got[name] = backends.candidates(name, answers).where("ref_id = 'r'").first()
    assert (got["CrossRef"]["title"], got["CrossRef"]["authors"], got["CrossRef"]["retracted"]) == ("On N: a survey", ["Ann Berg", "The Team"], True)
    assert got["DOI"]["authors"] == ["L"] and got["OpenAlex"]["authors"] == ["A B", "et al."] and got["Semantic Scholar"]["url"] == "https://doi.org/10.1/z"
    assert backends.candidates("OpenAlex", spark.createDataFrame([("r", 0, '{"title": "T", "type": "book-review"}')], "ref_id string, pos int, body string")).count() == 0


def test_a_paced_client_gives_up_and_isolates_errors(spark):
    def fetch(title, authors):
        if title == "slow":
            raise TimeoutError
        if title == "bad":
            raise ValueError
        if title == "refused":
            raise backends.Refused
        return [json.dumps({"title": [title], "author": [{"given": "Ann", "family": "Berg"}]})]

    asked = spark.createDataFrame([(str(i), t, ["Ann Berg"]) for i, t in enumerate(["A title of things", "slow", "bad", "refused", "refused", "A title of things"])], "ref_id string, title string, authors array<string>").coalesce(1)
    b = backends.backend("CrossRef", backends.Client(fetch, give_up=2), keep=lambda df: df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.cache())
    got = {r["ref_id"]: r["status"] for r in b.ask(asked).collect()}
    assert got == {"0": "match", "1": "timeout", "2": "error", "3": "rate_limited", "4": "rate_limited", "5": "skipped"}
    assert list(verify.FAILED) == ["timeout", "error", "rate_limited"]


# -- HTTP and identifiers ----------------------------------------------------------------------


class _Answer:
    def __init__(self, body, **headers):
        self.body, self.headers = body, headers

    def read(self):
        return self.body

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


def _opener(*said):
    """Says one thing after another; an exception is raised."""
    left = list(said)

    def open_(request, timeout):
        x = left.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    return open_


def _status(code, **headers):
    from email.message import Message
    from urllib.error import HTTPError

    m = Message()
    for k, v in headers.items():
        m[k.replace("_", "-")] = v
    return HTTPError("u", code, "", m, None)


def test_http_tells_absence_from_silence():
    import gzip
    from urllib.error import URLError

    waits = []
    ask = lambda *said, retries=2: http.Http(opener=_opener(*said), sleep=waits.append, retries=retries).json("http://u")
    assert ask(_Answer(b'{"a": 1}')) == ("ok", {"a": 1}) and ask(_Answer(gzip.compress(b"[]"), **{"Content-Encoding": "gzip"})) == ("ok", [])
    assert ask(_status(404)) == ("not_found", None) and ask(_status(500)) == ("error", None) and ask(_Answer(b"<html>")) == ("error", None)
    assert ask(_status(429, Retry_After="7"), _Answer(b"1")) == ("ok", 1) and waits == [7.0]
    assert ask(_status(429, Retry_After="9999"), _status(503), _status(429)) == ("rate_limited", None) and waits == [7.0, 60.0, 4.0]
    assert ask(TimeoutError(), URLError(TimeoutError()), retries=1) == ("timeout", None) and ask(URLError("no route"), retries=0) == ("error", None)
    assert http.wait_of("Thu, 01 Jan 1970 00:00:30 GMT", 0, 10.0) == 20.0 and http.wait_of("soon", 0, 0.0) == 2.0


def test_arxiv_rechecks_what_a_batch_left_out(spark):
    from urllib.parse import parse_qs, urlsplit

    asked = []

    def feed(*entries):
        body = "".join(f"<entry><id>http://arxiv.org/abs/{i}v2</id><title>{t}</title><author><name>Ann Berg</name></author></entry>" for i, t in entries)
        return f'<feed xmlns="http://www.w3.org/2005/Atom">{body}</feed>'.encode()

    def get(url, accept):
        q = parse_qs(urlsplit(url).query)
        if "verb" in q:
            asked.append(q["identifier"][0])
            return ("ok", b"<x><error code='idDoesNotExist'/></x>") if "9999" in q["identifier"][0] else ("ok", b"<x><title>From the harvest</title><author><keyname>Berg</keyname><forenames>Ann</forenames></author></x>")
        ids = q["id_list"][0].split(",")
        asked.append(len(ids))
        if len(ids) == 1:
            return "ok", feed(*((i, "Alone") for i in ids if i.startswith("cs/")))
        return ("rate_limited", b"") if "2001.00100" in ids else ("ok", feed(*((i, "In a batch") for i in ids if i != "2001.00001" and not i.startswith("cs/"))))

    keys = ["cs/0303001", *(f"2001.{i:05d}" for i in range(99)), "2001.00100", "2001.99999"]
    got = dict(identifiers.ask_arxiv(keys, get))
    assert asked[:2] == [100, 2] and json.loads(got["cs/0303001"].body)["title"] == "Alone"
    assert got["2001.00001"] == identifiers.Found("ok", sure=True) and json.loads(got["2001.00007"].body)["title"] == "In a batch"
    assert json.loads(got["2001.00100"].body) == {"title": "From the harvest", "authors": ["Ann Berg"], "id": "2001.00100"} and got["2001.99999"].sure
    assert dict(identifiers.ask_arxiv(["1"], lambda u, a: ("ok", b"<html/>")))["1"].outcome == "error"
    assert identifiers.arxiv_key(" cs.SE/0303001v3 ") == "cs/0303001"

    refs = spark.createDataFrame([("a", "Alone", ["A. Berg"], "cs.SE/0303001v1"), ("b", "Another", ["A. Berg"], "2001.00001"), ("c", "In a batch", ["Bo Ek"], "2001.00007"), ("d", "x", ["A"], None)], "ref_id string, title string, authors array<string>, arxiv_id string").withColumn("raw", F.lit("")).withColumn("doi", F.lit(None).cast("string"))
    said = lambda url, accept: ("ok", feed(*((k, {"cs/0303001": "Alone", "2001.00007": "In a batch"}[k]) for k in parse_qs(urlsplit(url).query)["id_list"][0].split(",") if k != "2001.00001")))
    done = {r["ref_id"]: r for r in verify.verify(refs, [identifiers.arxiv_backend(said, keep=lambda df: df.cache())]).collect()}
    assert {k: (r["status"], r["arxiv_info"] and r["arxiv_info"]["valid"]) for k, r in done.items()} == {"a": ("verified", True), "b": ("not_found", False), "c": ("mismatch", True), "d": ("not_found", None)}


def test_dois_are_put_to_the_resolver_too(spark):
    def get(url, accept):
        if "dead" in url:
            return "not_found", b""
        if "busy" in url:
            return "rate_limited", b""
        if url.startswith(identifiers.CROSSREF_WORKS):
            return ("not_found", b"") if "data" in url else ("ok", json.dumps({"message": {"title": ["A title of things"], "author": [{"given": "Ann", "family": "Berg"}], "DOI": "10.1/x"}}).encode())
        return ("ok", b'{"title": "A set of data", "author": [{"literal": "Ann Berg"}], "DOI": "10.5/data"}') if accept == identifiers.CSL_JSON else ("error", b"")

    rows = [("a", "A title of things", "10.1/x"), ("b", "A set of data", "10.5/data"), ("c", "T", "10.1/dead"), ("d", "T", "10.1/busy"), ("e", "T", None), ("f", "Something else", "10.1/x")]
    refs = spark.createDataFrame([(r, t, ["Ann Berg"], d) for r, t, d in rows], "ref_id string, title string, authors array<string>, doi string")
    got = {r["ref_id"]: r for r in verify.verify(refs, [identifiers.doi_backend(get, keep=lambda df: df.cache())]).collect()}
    assert {k: (r["status"], r["failed_dbs"], r["doi_info"] and r["doi_info"]["valid"]) for k, r in got.items()} == {
        "a": ("verified", [], True), "b": ("verified", [], True), "c": ("not_found", [], False), "d": ("not_found", ["DOI"], None), "e": ("not_found", [], None), "f": ("not_found", [], True)
    }
    assert got["b"]["paper_url"] == "https://doi.org/10.5/data" and got["f"]["doi_info"]["title"] == "A title of things"
    seen = got["c"].asDict()["db_results"][0]["status"], got["e"].asDict()["db_results"][0]["status"]
    assert seen == ("no_match", "skipped")


def test_requests_and_their_forms(spark):
    assert "rows=5" in backends.crossref_url("A b", ["X", "Y", "Z", "W"], "m@x") and "query.author=X+Y+Z" in backends.crossref_url("A b", ["X", "Y", "Z", "W"])
    assert "title.search%3A%22A+s+b%22" in backends.openalex_url("A's, b?") and "fields=" in backends.s2_url("t")
    assert backends.works_in("CrossRef", {"message": {}}) is None and backends.works_in("OpenAlex", {"results": []}) == [] and backends.works_in("Semantic Scholar", {"total": 0}) == []
    tried = []

    def ask(url):
        tried.append(url)
        return ("ok", {"results": [{"title": "Model driven tests", "authorships": [{"raw_author_name": "Ann Berg"}]}] if "Modeldriven" in url else []})

    refs = spark.createDataFrame([("a", "Model-driven tests", ["Ann Berg"])], "ref_id string, title string, authors array<string>")
    fetch = backends.searching("OpenAlex", ask, lambda t, _: backends.openalex_url(t))
    b = backends.backend("OpenAlex", backends.Client(fetch), lambda df: df.cache(), lambda t: F.array(t, F.replace(t, F.lit("-"), F.lit(""))), 2)
    assert [r["status"] for r in b.ask(refs).collect()] == ["match"]


def test_character_references(spark):
    import html

    from citeloom.functions import textnorm as N

    texts = ["&eacute;&#233;&#xE9; &amp;lt; &zzz; &AMP; a & b; &#0; &nbsp;x&hellip;", "&amp;amp;", "&#1114112; &#55296;", "no entity", "&CounterClockwiseContourIntegral;"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(N.unescaped(F.col("t"))).collect()]
    assert got[0] == html.unescape(texts[0].replace("&#0;", "@")).replace("@", "&#0;") and got[1] == "&amp;" and got[2:4] == texts[2:4] and got[4] == "∳"


def test_leads_are_ranked_before_they_are_filtered(spark):
    from citeloom.operators import leads

    rows = [("r", i, t) for i, t in enumerate(["Testing things", "Testing of things", "Zzz", "Testing the things"])]
    found = spark.createDataFrame(rows, "ref_id string, pos int, title string")
    got = leads.ranked(found.withColumn("cited", F.lit("Testing of things"))).orderBy("place").collect()
    assert [r["pos"] for r in got] == [1, 0, 3] or [r["pos"] for r in got] == [1, 3, 0]


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50
    assert entry.entry(spark).where("paper_id is null").first()["n_references"] > 0
