"""What the substring operator leaves on disk: the tables that its result reads, no others, and none of its shuffle files."""

import os
import time
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from citeloom.llm import shared, substring

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tables(spark):
    """Names of the stored tables, and of folders of them."""
    return set(os.listdir(urlparse(shared.shared_dir(spark)).path))


def shuffled(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {os.path.basename(x) for x in files.split("\n") if "shuffle_" in x}


def papers(spark):
    own = [" ".join(f"w{k}x{j}" for j in range(60)) for k in range(6)]
    shared_part = " ".join(f"p{j}" for j in range(90))
    near = own[0].split()
    rows = [*own, f"{own[1]} {shared_part}", f"{shared_part} {own[2]}", own[0], " ".join([*near[:30], "qq", *near[30:]])]
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(rows)], DOC)


@pytest.mark.parametrize("before", [None, "true"])
def test_spans_leave_only_what_the_result_reads(spark, before):
    docs = papers(spark)
    had, files = tables(spark), shuffled(spark)
    if before:
        spark.conf.set(CLEAN, before)
    try:
        found = substring.spans(docs)
        assert spark.conf.get(CLEAN, None) == before
        left = {x.rsplit("-", 1)[0] for x in tables(spark) - had}
        assert {"found", "passages", "keepers", "lines", "gone"} <= left <= {"found", "passages", "keepers", "lines", "gone", "edges"}
        until = time.time() + 20  # files are deleted in the background
        while (more := shuffled(spark) - files) and time.time() < until:
            time.sleep(0.2)
        assert not more
        once, again = sorted(map(tuple, found.collect())), sorted(map(tuple, found.collect()))
        assert once == again and {(8, 0, True), (7, 2, True)} <= {(r[0], r[3], r[4]) for r in once}  # 7 has parts of 2 and 6
    finally:
        spark.conf.unset(CLEAN)


def test_a_failed_run_leaves_nothing(spark):
    had = tables(spark)
    with pytest.raises(Exception, match="no text"):
        substring.spans(papers(spark).withColumn("text", F.raise_error(F.lit("no text")).cast("string")))
    assert tables(spark) == had and spark.conf.get(CLEAN, None) is None
