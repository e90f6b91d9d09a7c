"""Command line: ``python -m citeloom audit|compare|worklist|status|report|record|ingest``."""

from __future__ import annotations

import argparse
import json
import sys

OK, PAPER_FAILED, NO_ENTRIES = 0, 1, 4


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="citeloom")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("audit", help="segment, parse and verify the bibliographies of laid-out text files")
    a.add_argument("papers")
    a.add_argument("--pdf", action="store_true", help="the papers are PDF files (needs pdftotext on the executors)")
    a.add_argument("--mirror", help="the publications table")
    a.add_argument("--out", default="out")
    a.add_argument("--no-verify", action="store_true")
    a.add_argument("--parity", action="store_true", help="only what a text index would have retrieved")
    a.add_argument("--offline", action="store_true", help="ask the mirror only")
    a.add_argument("--disable-dbs", default="", help="backends not to ask, by comma")
    a.add_argument("--retry-degraded", type=int, default=0, metavar="ROUNDS", help="ask again about citations for which a backend failed")
    a.add_argument("--retry-delay", type=float, default=0, metavar="SECONDS", help="how long to wait before each such round")
    a.add_argument("--no-candidates", action="store_true", help="look for no works that resemble citations which aren't verified")
    a.add_argument("--rate-limit-retries", type=int, default=2)
    a.add_argument("--mailto", default="", help="an address for the services' logs")
    a.add_argument("--s2-api-key", default="")
    a.add_argument("--openalex-api-key", default="")
    i = sub.add_parser("ingest", help="build the publications table from an XML dump")
    i.add_argument("dump")
    i.add_argument("--out", required=True)
    i.add_argument("--least", type=int, default=1_000_000, help="refuse a load of fewer publications")
    i.add_argument("--work", required=True, help="a folder in which the table is staged")
    i.add_argument("--limit", type=int, help="only the first so many records, for a trial")
    for name in ("worklist", "status", "report"):
        t = sub.add_parser(name)
        t.add_argument("--out", default="out")
        t.add_argument("--paper")
        t.add_argument("--pending", action="store_true")
    c = sub.add_parser("compare", help="compare an audit with an earlier one")
    c.add_argument("base", help="the folder of the earlier audit")
    c.add_argument("--out", default="out")
    r = sub.add_parser("record", help="add a verdict to the log")
    r.add_argument("paper")
    r.add_argument("number", type=int)
    r.add_argument("category")
    r.add_argument("finding")
    r.add_argument("--signals", type=json.loads)
    r.add_argument("--out", default="out")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from .plans import commands

    a = arguments(argv)
    return commands.run(SparkSession.builder.appName("citeloom").getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())
