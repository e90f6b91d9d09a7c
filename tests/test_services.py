"""Services asked as a stream: pace, retries, the breaker, and a restart."""

import json
import time
from collections import Counter

from citeloom.streaming import services

SCHEMA = "service string, ref_id string, title string, authors array<string>"


def _until(done, query, seconds=120):
    end = time.time() + seconds
    while time.time() < end and not done():
        assert query.exception() is None, query.exception()
        time.sleep(0.5)
    assert done()


def test_queue_breaker_and_restart(spark, tmp_path):
    asked = str(tmp_path / "asked")
    (tmp_path / "in").mkdir()

    def fetch(name):
        def get(title, authors):
            with open(asked, "a") as f:
                f.write(f"{name} {title}\n")
            if name == "B" or title == "busy":
                return "rate_limited", []
            if title == "broken":
                raise ValueError
            return "", [json.dumps({"title": title, "n": len(authors)}), "{}"]

        return get

    def put(name, rows):
        (tmp_path / f"in/{name}.json").write_text("\n".join(json.dumps(dict(zip(("service", "ref_id", "title", "authors"), r, strict=True))) for r in rows))

    def start():
        stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
        out = services.ask(stream, {n: fetch(n) for n in "AB"}, pace_ms=50, at_a_time=4, tries=2, give_up=5)
        return out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).outputMode("append").trigger(processingTime="100 milliseconds").start()

    answers = lambda: [tuple(r) for r in spark.read.schema(services.ANSWER).parquet(str(tmp_path / "out")).collect()] if (tmp_path / "out/_spark_metadata").exists() else []
    refs = lambda: {(r[0], r[1]) for r in answers()}
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", services.PROVIDER)
    try:
        put("1", [("A", "a1", "one", ["x", "y"]), ("A", "a2", "busy", []), ("A", "a3", "broken", None), ("A", "a1", "one", []), *(("B", f"b{i}", f"t{i}", []) for i in range(12))])
        query = start()
        _until(lambda: len(refs()) == 15, query)
        query.stop()
        first = Counter(open(asked).read().splitlines())
        put("2", [("A", "a1", "one", []), ("A", "a4", "four", []), ("B", "b99", "late", [])])
        query = start()
        _until(lambda: len(refs()) == 17, query)
        query.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = {}
    for service, ref, status, pos, body in answers():
        got.setdefault((service, ref), []).append((pos, status, body))
    assert sorted(got["A", "a1"]) == [(0, "", '{"title": "one", "n": 2}'), (1, "", "{}")] and got["A", "a2"] == [(0, "rate_limited", None)] and got["A", "a3"] == [(0, "error", None)]
    assert first["A one"] == 1 and first["A busy"] == 2
    closed = [s for (service, _), rows in got.items() if service == "B" for _, s, _ in rows]
    assert set(closed) <= {"skipped", "rate_limited"} and sum(n for t, n in first.items() if t[0] == "B") == 5  # then the breaker
    again = Counter(open(asked).read().splitlines()) - first
    assert again == {"A four": 1} and got["B", "b99"] == [(0, "skipped", None)]
