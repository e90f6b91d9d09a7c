"""Mutants of the rules, all in one scan: which citations would come out otherwise if a part of a rule were missing.

A mutant is a column beside the rule's own over evidence that is there already, so that any number of them costs one reading of it. A
mutant that changes nothing shows a part of a rule that no case needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from . import titles, triage


def agreement(evidence: Column, complete: Column, listed: Column) -> dict[str, Column]:
    """The decision over two author lists (``names.authors_agree``) without one of its parts each."""
    e = lambda **new: F.struct(*(new.get(k, evidence[k]).alias(k) for k in ("matched", "comparable", "split", "contradicted")))
    agree = names.authors_agree
    return {
        "agree: whole rule": agree(evidence, complete, listed),
        "agree: nobody need be comparable": agree(e(comparable=F.greatest(evidence["comparable"], F.lit(1))), complete, listed),
        "agree: halves of a name count as strangers": agree(e(split=F.lit(0)), complete, listed),
        "agree: one match is enough": agree(e(comparable=F.least(evidence["comparable"], F.lit(1))), complete, listed),
        "agree: no list is complete": agree(evidence, F.lit(False), listed),
        "agree: no contradiction": agree(e(contradicted=F.lit(False)), complete, listed),
        "agree: every record lists people": agree(evidence, complete, F.lit(True)),
        "agree: a partial list needs no match": agree(evidence, complete, F.lit(False)),
    }


def signals(category: Column, signal: Column) -> dict[str, Column]:
    """Whether a verdict may be recorded (``triage.signal_problem``) if what it says about one signal were not looked at."""
    without = lambda k: F.struct(*((F.lit(None).cast("string") if n == k else signal[n]).alias(n) for n in (*triage.SIGNALS, "matched_title")))
    return {
        "signals: whole rule": triage.signal_problem(category, signal).isNull(),
        "signals: title not looked at": triage.signal_problem(category, without("title_match")).isNull(),
        "signals: matched title not looked at": triage.signal_problem(category, without("matched_title")).isNull(),
        "signals: every category is one": F.lit(True),
    }


def changed(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(mutant, n) of how many rows each mutant, all but the first, decides otherwise than the first, which is the rule."""
    whole, *others = rules.values()
    counts = rows.agg(*(F.count_if(~whole.eqNullSafe(c)).alias(f"c{k}") for k, c in enumerate(others)))
    each = F.array(*(F.struct(F.lit(name).alias("mutant"), F.col(f"c{k}").alias("n")) for k, name in enumerate(list(rules)[1:])))
    return counts.select(F.explode(each).alias("x")).select("x.*")


CRITERIA = ("preprint", "doi", "pages", "volume", "year", "id")


def choices(found: DataFrame) -> DataFrame:
    """(mutant, n): how many citations would be shown another of their candidates (``titles.candidates``) if one criterion of the choice were
    missing, or if they came in the reverse order; all choices of a citation are one reduction."""
    order = dict(zip(CRITERIA, titles.choice_order(), strict=True))
    orders = {f"choice: without {c}": [v for k, v in order.items() if k != c] for c in CRITERIA[:-1]}
    orders["choice: locators first"] = [order[c] for c in ("doi", "pages", "volume", "year", "preprint", "id")]
    orders["choice: last id first"] = [*(order[c] for c in CRITERIA[:-1]), -order["id"]]
    picked = found.groupBy("ref_id").agg(F.min_by("rec.id", F.struct(*order.values())).alias("whole"), *(F.min_by("rec.id", F.struct(*o)).alias(f"c{k}") for k, o in enumerate(orders.values())))
    rules = {"whole": F.col("whole"), **{name: F.col(f"c{k}") for k, name in enumerate(orders)}}
    return changed(picked, rules)
