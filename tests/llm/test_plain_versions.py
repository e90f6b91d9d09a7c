"""Scoring and decoding against versions in plain Python, word by word; and faults that were mended."""

import math
import random
import re

import numpy as np
import pytest

from citeloom.llm import chosenpath, decontam, langid, mixing, multiindex, shared, textvec, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"
BASE, ODD = textvec._BASE, 0x9E3779B97F4A7C15


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, s, 0) for i, t, g, s in rows], DOC)


def bucket(gram, buckets):
    h = sum((ord(c) + 1) * pow(BASE, k, 1 << 64) for k, c in enumerate(gram)) * ODD % (1 << 64)
    h ^= h >> 29
    return (h * (0xBF58476D1CE4E5B9 + 2 * len(gram)) % (1 << 64)) >> (64 - (buckets.bit_length() - 1))


def grams(word, sizes, buckets):
    marked = f" {word} "
    return [bucket(marked[i : i + n], buckets) for n in sizes for i in range(len(marked) - n + 1) if n < len(marked)]


def words_of(text):
    return re.findall(r"\w+", (text or "").lower())


TEXTS = ["one two three four five six seven eight nine ten", "grumblefoot", "a", "", None, "… !", "Ärger über Öl und 12_x " * 9, "x" * 300, "same same same", "same same same"]


def test_toxicity_scores_are_those_of_each_window():
    r = random.Random(1)
    stock = ["".join(r.choice("abcdefg") for _ in range(5)) for _ in range(50)]
    fitted = [" ".join(r.choices(stock, k=20)) + (" grumblefoot" if i % 3 == 0 else "") for i in range(120)]
    m = toxicity.fit(fitted, [int(i % 3 == 0) for i in range(120)])
    for text, got in zip(TEXTS + fitted[:6], m.scores(TEXTS + fitted[:6]).tolist(), strict=True):
        words = words_of(text)
        windows = [[b for w in words[a : a + toxicity.WINDOW] for b in grams(w, toxicity.SIZES, toxicity.BUCKETS)] for a in range(0, len(words), toxicity.WINDOW)]
        best = max((sum(float(m.weights[b]) for b in x) / max(len(x), 1) + m.bias for x in windows), default=None)
        want = m.none if best is None else 1 / (1 + math.exp(-max(-60.0, min(60.0, m.scale * best + m.shift))))
        assert got == pytest.approx(want, abs=1e-5), text


def test_languages_are_those_of_the_nearest_codeword():
    r = random.Random(2)
    stock = {g: ["".join(r.choice(s) for _ in range(4)) for _ in range(30)] for g, s in {"aa": "abcd", "bb": "cdef", "cc": "efgö"}.items()}
    m = langid.fit([" ".join(r.choices(stock[g], k=12)) for g in stock for _ in range(15)], [g for g in stock for _ in range(15)])
    texts = TEXTS + [" ".join(r.choices(stock[g], k=8)) for g in stock]
    lang, score, unsure = m.predict(texts)
    for t, g, s, u in zip(texts, lang, score.tolist(), unsure.tolist(), strict=True):
        if not any(map(str.isalpha, t or "")):
            assert (g, s, u) == ("und", 0.0, False)
            continue
        count = {}
        for w in words_of(t):
            for b in grams(w, langid.SIZES, langid.BUCKETS):
                count[b] = count.get(b, 0) + 1
        norm = math.sqrt(sum(count.values()))
        f = [sum(math.sqrt(n) / norm * float(m.weights[b, k]) for b, n in count.items()) + float(m.bias[k]) for k in range(m.codes.shape[1])]
        loss = [sum(math.log1p(math.exp(-x * c)) for x, c in zip(f, code, strict=True)) for code in m.codes.tolist()]
        p = [math.exp(min(loss) - x) for x in loss]
        first, second = sorted((x / sum(p) for x in p), reverse=True)[:2]
        assert g == m.langs[loss.index(min(loss))] and s == pytest.approx(first, abs=1e-4)
        assert u == (first - second < langid.AMBIGUOUS) or abs(first - second - langid.AMBIGUOUS) < 1e-3


def test_a_tie_between_codewords_goes_to_the_first_language():
    codes = langid.codewords(3)
    m = langid.Model(("aa", "bb", "cc"), codes, np.zeros((langid.BUCKETS, codes.shape[1])), np.zeros(codes.shape[1]))
    assert m.predict(["some words"])[0] == ["aa"] and m.predict(["some words"])[2].tolist() == [True]


def test_no_document_is_given_more_often_than_the_limit(spark):
    rows = [(i, "one two" if i % 3 else None, "en", "a") for i in range(60)] + [(1000 + i, "w " * 40, "en", "b") for i in range(60)]
    got = mixing.mix(docs(spark, rows)).collect()
    assert max(r["copies"] for r in got) == 3 and min(r["copies"] for r in got if r["doc_id"] < 60) == 3
    assert all(r["taken"] == r["size"] * r["copies"] for r in got)


def test_repeated_items_and_null_ids_of_another_type(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    d = docs(spark, [(1, f"so {passage} it goes", "en", "a"), (1, f"so {passage} it goes", "en", "a"), (2, "nothing of that", "en", "a")])
    bench = spark.createDataFrame([(None, passage), (None, passage), ("x", "never seen words stand here now")], "item_id string, text string")
    assert [(r["doc_id"], r["item_id"], r["n_tiles"]) for r in decontam.leaks(d, bench).collect()] == [(1, None, 1)] * 4
    assert [r["doc_id"] for r in decontam.drop_leaks(d, bench).collect()] == [2]
    assert sum(len(b.ids) for b in decontam.blocks(spark.createDataFrame([("x", "same item")] * 500, "item_id string, text string"))) == 1


def test_small_sets_meet_as_often_as_large_ones():
    r, runs = np.random.default_rng(3), chosenpath.runs_needed(chosenpath.RECALL)
    for common, n in ((4, 5), (8, 10), (40, 50)):
        met = 0
        for _ in range(600):
            a = r.integers(0, 2**64, common, dtype=np.uint64)
            b = np.concatenate([a, r.integers(0, 2**64, n - common, dtype=np.uint64)])
            one, two = (chosenpath.paths(x, chosenpath.THRESHOLD, runs)[1][-1] for x in (a, b))
            met += bool(len(one) and len(two) and np.isin(one[:, 1], two[:, 1]).any())
        assert met / 600 > 0.98, (common, n)


def test_recall_of_real_links_and_odd_vectors(spark):
    g = np.random.default_rng(6)
    centers = g.normal(size=(300, 16))
    near = [(i, (centers[i % 300] / np.linalg.norm(centers[i % 300]) + g.normal(size=16) * 0.11).tolist(), 0) for i in range(3000)]
    v = spark.createDataFrame([*near, (3000, None, 0), (3001, [], 0), (3002, [0.0] * 16, 0), (3003, near[0][1], 0)], "vec_id long, embedding array<float>, label int")
    found = multiindex.near_copies(v)
    got, there = multiindex.measured_recall(v, found, 10)
    assert there > 300 and 0.97 * there <= got <= there
    assert {r["vec_id"]: r["n_links"] for r in found.where("vec_id between 3000 and 3002").collect()} == {3000: 0, 3001: 0, 3002: 0}


def test_what_is_stored_on_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())
