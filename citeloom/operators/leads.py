"""Leads: real works that resemble an unverified citation, for a human to look at; they confirm nothing.

How alike two titles are is the share of characters in their matching blocks: the longest run that both have (the first in the cited title, then in
the other), then the same to its left and to its right. No two titles are more alike than the characters that they share in any
order, which is an expression; only titles that may be alike enough by that bound are compared block by block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import textnorm as N
from .titles import LEAD_SIMILARITY, LEADS

_SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789 "
#: From this length on, a character that makes up more than a hundredth of a title (and one) starts no block.
LONG_TITLE, POPULAR = 200, 100


def bound(a: Column, b: Column) -> Column:
    """No less than the similarity of two plain titles: twice the characters that they have in common over all they have."""
    times = lambda t, c: F.length(t) - F.length(F.replace(t, c))
    common = lambda p: F.aggregate(F.array(*map(F.lit, _SYMBOLS)), F.lit(0), lambda n, c: n + F.least(times(p["a"], c), times(p["b"], c)))
    share = lambda p: F.when(F.length(p["a"]) + F.length(p["b"]) > 0, 2 * common(p) / (F.length(p["a"]) + F.length(p["b"]))).otherwise(F.lit(1.0))
    return F.get(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), share), F.lit(0))


def matching(a: str, b: str) -> int:
    """The characters in the matching blocks of two titles."""
    x, y = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (a, b))
    same = x[:, None] == y[None]
    starts = same
    if len(y) >= LONG_TITLE:
        seen, n = np.unique(y, return_counts=True)
        starts = same & ~np.isin(y, seen[n > len(y) // POPULAR + 1])[None]
    total, waiting = 0, [(0, len(x), 0, len(y))]
    while waiting:
        i0, i1, j0, j1 = waiting.pop()
        if i0 >= i1 or j0 >= j1:
            continue
        run, best, at_i, at_j = np.zeros(j1 - j0 + 1, np.int64), 0, i0, j0
        for i in range(i0, i1):  # run[j]: how long the common run is that ends at (i, j)
            run[1:] = np.where(starts[i, j0:j1], run[:-1] + 1, 0)
            k = int(run.argmax())
            if run[k] > best:
                best = int(run[k])
                at_i, at_j = i - best + 1, j0 + k - best
        while at_i > i0 and at_j > j0 and same[at_i - 1, at_j - 1]:
            at_i, at_j, best = at_i - 1, at_j - 1, best + 1
        while at_i + best < i1 and at_j + best < j1 and same[at_i + best, at_j + best]:
            best += 1
        if best:
            total += best
            waiting += [(i0, at_i, j0, at_j), (at_i + best, i1, at_j + best, j1)]
    return total


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of two plain titles that lies in matching blocks, to three digits; two empty titles are alike."""
    return pd.Series([round(2 * matching(x, y) / (len(x) + len(y)), 3) if x or y else 1.0 for x, y in zip(a.fillna(""), b.fillna(""), strict=True)], dtype=float)


def ranked(found: DataFrame, cited: str = "cited", title: str = "title") -> DataFrame:
    """Of each citation's finds (ref_id, pos, ``cited``, ``title``, ...) the three most similar, of those only what is similar enough, with
    ``title_similarity`` and ``place``. What can't be similar enough is left out before it is compared, which changes neither."""
    plain = lambda c: N.plain_title(F.coalesce(c, F.lit("")))
    some = found.withColumns({"_a": plain(F.col(cited)), "_b": plain(F.col(title))}).where(bound(F.col("_a"), F.col("_b")) >= LEAD_SIMILARITY - 0.001)
    scored = some.withColumn("title_similarity", similarity("_a", "_b")).drop("_a", "_b").where(F.col("title_similarity") >= LEAD_SIMILARITY)
    top = Window.partitionBy("ref_id").orderBy(F.col("title_similarity").desc(), "pos")
    return scored.withColumn("place", F.row_number().over(top)).where(F.col("place") <= LEADS)


def attached(refs: DataFrame, found: DataFrame) -> DataFrame:
    """``refs`` with ``candidates``: each citation's leads (``found``: ref_id, pos, title, authors, venue, year, doi), best first; null without any."""
    best = ranked(found.join(refs.select("ref_id", F.col("title").alias("cited")), "ref_id"))
    one = F.struct("place", "title", "authors", "venue", "year", "doi", "title_similarity")
    each = best.groupBy("ref_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("place")).alias("candidates"))
    return refs.join(each, "ref_id", "left")
