"""Spans of the substring operator against brute force: few long runs of words stay in two documents, none is lost, and clean documents have no span."""

import random
from collections import Counter

from citeloom.llm import substring

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = substring.LONG_SPAN


def repeated_words(docs):
    """For each document the places of words in runs of ``LONG`` words that another document has too, found run by run."""
    runs = {}
    for i, words in docs.items():
        for a in range(len(words) - LONG + 1):
            runs.setdefault(tuple(words[a : a + LONG]), set()).add(i)
    out = {i: set() for i in docs}
    for i, words in docs.items():
        for a in range(len(words) - LONG + 1):
            if len(runs[tuple(words[a : a + LONG])]) > 1:
                out[i].update(range(a, a + LONG))
    return out


def test_spans_cover_every_long_passage_and_leave_the_rest(spark):
    r = random.Random(12)
    stock = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(4000)]
    passages = [r.choices(stock, k=r.randint(LONG - 15, 120)) for _ in range(25)]
    docs = {}
    for i in range(90):
        words = []
        for _ in range(r.randint(1, 4)):
            words += r.choices(stock, k=r.randint(10, 80))
            if i % 3:  # every third document is clean
                p = r.choice(passages)
                a = r.randint(0, max(0, len(p) - LONG - 5)) if r.random() < 0.5 else 0
                words += p[a : len(p) - (r.randint(0, 20) if r.random() < 0.5 else 0)]
        docs[i] = words

    def laid(words):
        text = ""
        for k, w in enumerate(words):
            text += w + ("\n" if k % 30 == 29 and r.random() < 0.6 else " ")
        return text

    rows = [(i, laid(w), "en", "s", 0) for i, w in docs.items()]
    found = substring.spans(spark.createDataFrame(rows, DOC)).collect()
    covered = {i: set() for i in docs}
    for x in found:
        covered[x["doc_id"]].update(range(x["start"], x["start"] + x["n_words"]))
    wanted = repeated_words(docs)
    must = sum(map(len, wanted.values()))
    # a part that stays with its keeper and is too short for a row of its own is not reported; all else of the passages is
    assert must > 3000 and sum(len(wanted[i] & covered[i]) for i in docs) > 0.93 * must
    assert all(not covered[i] for i in docs if i % 3 == 0)
    # of a passage that stands in several documents one keeps each part: only runs of five words over an end of what goes may be nowhere
    kept = {i: set(range(len(w))) for i, w in docs.items()}
    edges = 0
    for x in found:
        if x["removed"]:
            kept[x["doc_id"]] -= set(range(x["start"], x["start"] + x["n_words"]))
            edges += 2
    left = {tuple(w[a : a + 5]) for i, w in docs.items() for a in range(len(w) - 4) if set(range(a, a + 5)) <= kept[i]}
    every = {tuple(w[a : a + 5]) for i, w in docs.items() for a in range(len(w) - 4)}
    assert len(every - left) <= 4 * edges
    assert {w for run in left for w in run} >= {w for run in every for w in run} - {w for x in found for w in docs[x["doc_id"]][max(0, x["start"] - 4) : x["start"] + 4]} - {w for x in found for w in docs[x["doc_id"]][x["start"] + x["n_words"] - 4 : x["start"] + x["n_words"] + 4]}
    # few long runs of words are left in two documents: those whose parts have several keepers and are each too short to go alone
    still = {}
    for i, w in docs.items():
        for a in range(len(w) - LONG + 1):
            if all(p in kept[i] for p in range(a, a + LONG)):
                still.setdefault(tuple(w[a : a + LONG]), set()).add(i)
    again = sum(len(x) > 1 for x in still.values())
    runs = Counter(tuple(w[a : a + LONG]) for w in docs.values() for a in range(len(w) - LONG + 1))
    assert again <= 0.1 * sum(n > 1 for n in runs.values())
