"""Operators 11 to 13 on small fixtures: against brute force in plain Python, and odd input."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.llm import covertree, importance, spelling

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["word", "n", "wid", "key", "form", "root", "rank", "score", "weight", "buckets", "row", "place", "q", "v", "land", "sub", "pack"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOC)


def wide(df):
    """The table with extra columns, named as those that operators make."""
    for name in CLASHING:
        df = df.withColumn(name, F.lit("clash"))
    return df


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=repr)


# -- spelling variants -----------------------------------------------------------------------


def spelt(rows, odds=97):
    n = Counter()
    for i, t in rows:
        for r in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), r)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if odds and h % odds == 0 else w] += 1
    return n


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(rows, odds=97, letters=5, count=3, factor=2):
    n = {w: k for w, k in spelt(rows, odds).items() if len(w) >= letters and k >= count}
    near = {w: sorted((-n[x], x) for x in n if one_apart(w, x)) for w in n}
    form = {w: x[0][1] if x and -x[0][0] >= factor * n[w] else None for w, x in near.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, n[w], len(near[w]), form[w], n.get(form[w]), root(w)) for w in n), key=repr)


COLUMNS = ("word", "n", "n_near", "form", "form_n", "root")


def test_variants_are_those_of_all_pairs(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abÉ") for _ in range(r.randint(4, 7))) for _ in range(150)]
    rows = [(i, " ".join(r.choices(words, weights=[1 / (k + 1) for k in range(150)], k=300))) for i in range(40)]
    rows += [(None, "ABABA ababa"), (50, None), (51, ""), (7, "x" * 20_000 + " " + "x" * 20_001), (7, "x" * 20_000 + " " + "x" * 20_001)]
    for odds in (97, 3, 0):
        assert rows_of(spelling.variants(wide(docs(spark, rows)), odds), *COLUMNS) == variants_by_hand(rows, odds)


def test_long_words_chains_and_ties(spark):
    long = "y" * 700
    rows = [(1, " ".join(["abcde"] * 64 + ["abcdf"] * 32 + ["abcgf"] * 16 + ["abhgf"] * 8 + ["aihgf"] * 4 + ["zzzzz"] * 8 + ["zzzzy"] * 8 + ["zzzzx"] * 4 + [long] * 9 + [long + "z"] * 3 + ["aabbaa"] * 7 + ["abbaa"] * 3 + ["ababaa"] * 3))]
    got = rows_of(spelling.variants(docs(spark, rows), 0), *COLUMNS)
    assert got == variants_by_hand(rows, 0)
    told = {r[0]: r for r in got}
    assert told["aihgf"][5] == "abcde" and told["zzzzx"][3] == "zzzzy" and told[long + "z"][5] == long


def test_keys_that_collide_are_told_apart_by_their_strings(spark, monkeypatch):
    plain = spelling._keys
    monkeypatch.setattr(spelling, "_keys", lambda words: plain(words).withColumn("key", F.col("key").bitwiseAND(3)))
    r = random.Random(6)
    rows = [(1, " ".join("".join(r.choice("ab") for _ in range(r.randint(5, 6))) for _ in range(900)))]
    assert rows_of(spelling.variants(docs(spark, rows), 0), *COLUMNS) == variants_by_hand(rows, 0)


def test_variants_of_nothing(spark):
    assert spelling.variants(docs(spark, [])).count() == 0
    assert spelling.variants(docs(spark, [(1, None), (None, ""), (2, "12 34")])).count() == 0


def test_checksums_are_those_of_zlib():
    r = random.Random(2)
    parts = [bytes(r.randrange(97, 123) for _ in range(k)) for k in [1, 2, 3, 63, 64, 65, 500, 5]]
    data = b" ".join(parts)
    end = np.cumsum([len(p) + 1 for p in parts]) - 1
    start = end - [len(p) for p in parts]
    before = np.array([zlib.crc32(b"%d:" % k) for k in range(len(parts))], np.uint32)
    assert spelling.checksums(data, start, end, before).tolist() == [zlib.crc32(p, zlib.crc32(b"%d:" % k)) for k, p in enumerate(parts)]


# -- importance resampling ---------------------------------------------------------------------


def features(text, ngrams):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in range(1, ngrams + 1) for i in range(len(words) - n + 1)]


def resampled_by_hand(rows, target, ngrams=1, percent=10, least=20):
    own = [(i, *features(t, ngrams)) for i, t in rows]
    s = Counter(b for _, _, f in own for b in f)
    t = Counter(b for x in target for b in features(x, ngrams)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    out = []
    for i, w, f in own:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w) >= least])
    fit = sorted((x for x in out if x[5]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(fit[: percent * len(fit) // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=repr)


DRAWN = ("doc_id", "n_features", "weight", "score", "rank")


def some_texts(n, seed):
    r = random.Random(seed)
    words = [f"{'éA'[k % 2]}w{k}" for k in range(80)]
    return [(i, " ".join(r.choices(words, weights=[1 + (k + i) % 7 for k in range(80)], k=r.randint(5, 60)))) for i in range(n)]


@pytest.mark.parametrize("ngrams", [1, 3])
def test_draw_is_that_of_the_definition(spark, ngrams):
    rows = some_texts(200, 1) + [(None, "İ a B c, D_e 0x1F " * 9), (300, None), (301, ""), (302, "one"), (5, "five again " * 20), (303, "long words here " * 30_000)]
    target = [t for _, t in some_texts(20, 2)] + [None, ""]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(wide(docs(spark, rows)), wide(bench), percent=25, ngrams=ngrams)
    assert rows_of(got, *DRAWN) == resampled_by_hand(rows, target, ngrams, 25)


def test_rows_that_repeat_are_drawn_one_after_the_other(spark):
    rows = [(None, "a b c d e f g h i j k l m n o p q r s t u")] * 300 + [(9, "a b c d e f g h i j k l m n o p q r s t u")] * 40
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    got = importance.resample(docs(spark, rows).repartition(7), bench, percent=60)
    assert rows_of(got, *DRAWN) == resampled_by_hand(rows, ["a b"], 1, 60)
    assert sorted(r["rank"] for r in got.where("rank is not null").collect()) == list(range(1, 205))


def test_draw_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(docs(spark, []), none).count() == 0
    rows = some_texts(40, 3)
    assert rows_of(importance.resample(docs(spark, rows), none), *DRAWN) == resampled_by_hand(rows, [])
    assert rows_of(importance.resample(docs(spark, rows[:5]), none), *DRAWN) == resampled_by_hand(rows[:5], [])


# -- exact top-k -------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def searched_by_hand(rows, k=10, every=100):
    known = {(i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, v in known:
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in known if j != i and len(w) == len(v))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out, key=repr)


FOUND = ("query_id", "rank", "vec_id", "score")


def clustered(n, dim, seed):
    g = np.random.default_rng(seed)
    centers = g.normal(size=(12, dim))
    return [(i, (centers[i % 12] * (0.1 if i % 3 else 1) + 0.05 * g.normal(size=dim)).tolist(), i) for i in range(n)]


@pytest.mark.parametrize("block", [16, 100, 4096])
def test_search_is_that_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(covertree, "LEAST_BLOCK", block)
    monkeypatch.setattr(covertree, "MOST_BLOCK", block)
    monkeypatch.setattr(covertree, "PACK", 11)
    rows = clustered(600, 6, 1)
    assert rows_of(covertree.top_k(wide(vectors(spark, rows)), every=20), *FOUND) == searched_by_hand(rows, every=20)
    assert rows_of(covertree.top_k(vectors(spark, rows[:60]), k=100, every=20), *FOUND) == searched_by_hand(rows[:60], 100, 20)


def test_copies_ties_and_what_takes_no_part(spark, monkeypatch):
    monkeypatch.setattr(covertree, "LEAST_BLOCK", 20)
    monkeypatch.setattr(covertree, "MOST_BLOCK", 20)
    same = [0.5, -0.25, 0.125]
    rows = [(i, same, 0) for i in range(0, 350)] + [(i, [(i % 7) / 7, (i % 5) / 5, 0.0], 0) for i in range(350, 450)]
    rows += [(300, same, 0), (300, [1.0, 1.0, 1.0], 0), (None, same, 0), (500, None, 0), (600, [], 0), (700, [0.5, None, 1.0], 0), (800, [0.5, float("nan"), 1.0], 0), (900, [float("inf"), 0.0, 0.0], 0)]
    rows += [(1000, [0.0, 0.0, 0.0], 0), (1100, [0.5, 0.5], 0), (1101, [0.25, 0.5], 0), (1200, [0.1], 0)]
    assert rows_of(covertree.top_k(vectors(spark, rows)), *FOUND) == searched_by_hand(rows)


def test_large_components_are_exact(spark):
    g = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in g.normal(size=4) * 1e5], 0) for i in range(80)]
    assert rows_of(covertree.top_k(vectors(spark, rows), every=10), *FOUND) == searched_by_hand(rows, every=10)
    edge = covertree.top_k(vectors(spark, [(0, [3e38, 0.0], 0), (1, [3e38, 0.0], 0), (2, [-3e38, 0.0], 0), (3, [1.0, 1.0], 0)]))
    assert [(r["vec_id"], r["score"]) for r in edge.orderBy("rank").collect()][::2] == [(1, 2**63 - 1), (2, -(2**63))]


def test_search_of_nothing(spark):
    assert covertree.top_k(vectors(spark, [])).count() == 0
    assert covertree.top_k(vectors(spark, [(100, [1.0], 0)])).count() == 0
    assert covertree.top_k(vectors(spark, [(1, [1.0], 0), (2, [1.0], 0)])).count() == 0


def test_a_tree_covers_and_separates():
    x = np.array([v for _, v, _ in clustered(2000, 8, 3)])
    t = covertree.Tree.of(x, 20)
    assert sorted(t.order.tolist()) == list(range(2000))
    for k in range(len(t.start)):
        inside = x[t.order[t.start[k] : t.end[k]]]
        assert np.sqrt(((inside - t.center[k]) ** 2).sum(axis=1)).max() <= t.radius[k] + 1e-9
        if len(t.children[k]):
            c = t.center[t.children[k]]
            apart = np.sqrt(((c[:, None] - c[None]) ** 2).sum(axis=2))[np.triu_indices(len(c), 1)].min()
            assert apart >= t.radius[t.children[k]].max() - 1e-9 and (c == t.center[k]).all(axis=1).any()


def test_pruned_nodes_are_not_compared(monkeypatch):
    g = np.random.default_rng(8)
    centers = 100_000 * g.normal(size=(40, 3))
    x = np.floor(centers[np.arange(8000) % 40] + g.normal(size=(8000, 3))).astype(np.int64)
    pairs, plain = [], covertree.products
    monkeypatch.setattr(covertree, "products", lambda q, y: pairs.append(len(q) * len(y)) or plain(q, y))
    found = covertree.search(x[:400], np.arange(400), np.full(400, -np.inf), x, np.arange(8000), 10)
    s = x[:400] @ x.T
    for i in range(400):
        best = sorted((-int(v), j) for j, v in enumerate(s[i]) if j != i)[:10]
        assert found[i] == best
    assert sum(pairs) < 0.2 * 400 * 8000
