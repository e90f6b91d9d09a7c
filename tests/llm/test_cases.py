"""Cases that the operators must hold beyond their small fixtures: the pipeline against plain Python, bounds, skew, odd rows."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citeloom.llm import chosenpath, decontam, langid, mixing, multiindex, shared, substring, textvec, tokencoder, tokens, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["".join(random.Random(f"w{k}").choice("abcdefghijklmnop") for _ in range(random.Random(k).randint(2, 8))) for k in range(500)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows], DOC)


def shingles(text):
    import re

    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


# -- the pipeline ------------------------------------------------------------------------------


def near_groups(rows):
    """The least row of each group of texts of similarity 0.8 and more."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-12:
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return [rows[i] for i in range(len(rows)) if root(i) == i]


def tiled(a, b, least):
    free_a, free_b, covered = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for x in range(len(a)):
            for y in range(len(b)):
                k = 0
                while x + k < len(a) and y + k < len(b) and a[x + k] == b[y + k] and free_a[x + k] and free_b[y + k]:
                    k += 1
                best = max(best, (k, -x, -y))
        k, x, y = best[0], -best[1], -best[2]
        if k < least:
            return covered
        free_a[x : x + k], free_b[y : y + k] = [False] * k, [False] * k
        covered += k


def test_the_pipeline_equals_plain_python(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    pipeline = pytest.importorskip("corpus_pipeline")
    duckdb = pytest.importorskip("duckdb")
    from tokenizers import Tokenizer

    bad = ["grumblefoot", "snotwhistle"]
    rows, labels = [], []
    for i in range(160):
        words = prose(40, i).split()
        if i % 5 == 0:
            words[i % 40] = bad[i % 2]
        rows.append((i, " ".join(words), "en", f"s{i % 3}"))
        labels.append((i, 1, int(i % 5 == 0)))
    items = [(k, prose(14, 900 + k)) for k in range(3)]
    rows += [(200 + i, rows[i][1] + " more", "en", "s1") for i in range(1, 20)]  # near copies
    rows += [(300 + k, prose(20, 70 + k) + " " + items[k][1], "en", "s2") for k in range(3)]  # leaks
    rows += [(400, None, None, None), (401, "", "en", "s0"), (None, prose(30, 401), "en", "s0")]
    d, lab, bench = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), spark.createDataFrame(items, "item_id long, text string")
    for name, df in (("documents", d), ("labels", lab), ("benchmark", bench)):
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    source = spark.read.parquet(str(tmp_path / "documents.parquet"))
    toxic = {(r["doc_id"], r["text"]) for r in toxicity.with_scores(source, toxicity.train(source, lab)).where("score >= 0.3").collect()}
    assert len(toxic) >= 25
    clean = sorted(((i, t) for i, t, _, _ in rows if (i, t) not in toxic and i is not None), key=lambda r: r[0])
    kept = near_groups(clean) + [(i, t) for i, t, _, _ in rows if i is None]
    words = lambda t: (t or "").lower().split()
    kept = [(i, t) for i, t in kept if not any(tiled(words(x), words(t), 5) >= 0.5 * len(words(x)) for _, x in items)]
    con = duckdb.connect()
    sources = {(i, t): s for i, t, _, s in rows}
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, t, sources[i, t]) for i, t in kept])
    times = {i: taken // size if size else 0 for i, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({mixing.ORACLE})").fetchall()}
    full = {s: n for s, n in con.execute("SELECT source, count(*) FROM documents GROUP BY source").fetchall()}
    tokenizer = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in kept:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        if t:
            want[i, len(ids), zlib.crc32(ids.tobytes())] += times[i]
    got = pipeline.run(spark, str(tmp_path)).collect()
    found = Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got if r["n_tokens"] > 1)
    assert found == +want and len(full) >= 3
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0, *(r["n_tokens"] for r in ordered)])[:-1].tolist()


def test_the_pipeline_of_nothing(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    pipeline = pytest.importorskip("corpus_pipeline")
    for name, schema in (("documents", DOC), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == []


# -- words and ids -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    public = pytest.importorskip("public_tokenizers")
    return tokens.Encoder(public.path("word_bpe_49k.json"))


def test_words_are_cut_where_the_tokenizer_cuts_them(encoder):
    r = random.Random(7)
    letters = [*"abAB'’,.<>≠09 \t\n\x0b\x1c\x85\xa0éÉßİıñǅ×÷ДжЙй̸́Ωςσ中文٣½ªº­‍😀ﬁ", "'s", "'T", "'re", "<|endoftext|>", "don't", "  "]
    texts = ["".join(r.choice(letters) for _ in range(n)).encode() for n in (1, 2, 3, 5, 9, 30) for _ in range(800)]
    assert encoder.cuts
    for a in range(0, len(texts), 100):
        assert [x.tolist() for x in encoder.encode(texts[a : a + 100])] == encoder._whole(texts[a : a + 100])


def test_long_texts_and_a_full_memory(encoder, monkeypatch):
    monkeypatch.setattr(tokens, "SLICE", 1000)
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    texts = [prose(3000, 1).encode(), ("x" * 5000 + " y").encode(), b"", prose(10, 2).encode()]
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts)] == encoder._whole(texts)


def test_another_tokenizer_gets_whole_texts(spark):
    public = pytest.importorskip("public_tokenizers")
    other = tokens.Encoder(public.path("byte_bpe_50k.json"))
    texts = [b"Two words, and  a few more.", "é ü".encode()]
    assert not other.cuts and [x.tolist() for x in other.encode(texts)] == other._whole(texts)


def entropy(ids):
    n = np.bincount(ids)
    p = n[n > 0] / n.sum()
    return float(-(p * np.log2(p)).sum())


def test_independent_ids_cost_what_order_0_costs():
    r = np.random.default_rng(1)
    zipf = r.zipf(1.3, 400_000)
    ids = zipf[zipf < 3000].astype(np.uint32)
    assert 8 * len(tokencoder.encode_segment(ids, np.array([len(ids)]))) / len(ids) < 1.06 * entropy(ids)  # the rest is learning the frequencies
    # either of two ids follows, and a context names one: right half of the time, else order 0 pays, about 1 + 9 / 2 bits
    chain = np.cumsum(r.integers(0, 2, 200_000)) % 500
    assert 8 * len(tokencoder.encode_segment(chain.astype(np.uint32), np.array([1]))) / len(chain) < 1 + 0.5 * entropy(chain)


def test_blocks_decode_alone(monkeypatch):
    monkeypatch.setattr(tokencoder, "BLOCK", 5000)
    ids = np.random.default_rng(2).integers(0, 2**32, 12_000, dtype=np.uint32)
    ids[:5000] %= 7
    blocks = tokencoder.encode_blocks(ids)
    assert len(blocks) == 3 and (tokencoder.decode_block(blocks[1]) == ids[5000:10000]).all()
    for at in (0, 5, 20, len(blocks[0]) - 1):
        broken = bytearray(blocks[0])
        broken[at] ^= 255
        with pytest.raises(tokencoder.Corrupt):
            tokencoder.decode_block(bytes(broken))


def test_blocks_coded_together_are_those_coded_alone():
    r = np.random.default_rng(4)
    ids = [r.zipf(1.3, n).clip(0, 30_000).astype(np.uint32) for n in (70_000, 200_000, 1, 63, 0, 5000)] + [r.integers(0, 2**32, 9000, dtype=np.uint32)]
    data = tokencoder.encode_segments([(x, np.array([len(x)])) for x in ids])
    assert data == [tokencoder.encode_segment(x, np.array([len(x)])) for x in ids]
    assert all((back == x).all() and n.tolist() == [len(x)] for (back, n), x in zip(tokencoder.decode_segments(data), ids, strict=True))
    broken = bytearray(data[1])
    broken[-100] ^= 1
    with pytest.raises(tokencoder.Corrupt):
        tokencoder.decode_segments([data[0], bytes(broken), data[2]])


def test_segments_have_no_small_second_block(spark, tmp_path, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(tokens, "SEGMENT", 500)
    rows = [(i, "a word and some more " * (80 if i == 3 else 5 + i % 7)) for i in range(60)]
    path = str(tmp_path / "segments")
    tokens.write(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), public.path("word_bpe_49k.json"), path)
    got = spark.read.parquet(path).collect()
    assert all(r["n_ids"] <= 500 or len(r["doc_ids"]) == 1 for r in got)
    assert {(r["part"], r["seg"]) for r in got} == {(p, k) for p in {r["part"] for r in got} for k in range(sum(r["part"] == p for r in got))}
    assert [d for r in sorted(got, key=lambda r: (r["part"], r["seg"])) for d in r["doc_ids"]] == list(range(60))


# -- bounds ------------------------------------------------------------------------------------


def test_slices_by_bytes_keep_every_row():
    b = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["x" * 10, None, "", "y" * 500, "z", "w" * 60])], names=["i", "t"])
    got = list(shared.by_bytes(iter([b, b.slice(0, 0)]), 1, 50))
    assert [x.column(0).to_pylist() for x in got] == [[0, 1, 2], [3], [4], [5]]


def test_what_is_small_is_told_by_bytes(spark):
    few = shared.stored(spark.createDataFrame([(i, "x" * 100_000) for i in range(20)], "i long, t string"), "few-long")
    assert shared._held(few) > 2_000_000 and shared._held(few.select("i")) < 2_000
    assert "BroadcastHashJoin" in few.join(shared.small(few.select("i")), "i")._jdf.queryExecution().toString()


def test_samples_stay_bounded_when_one_id_repeats(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_TRAIN_ROWS", 5)
    rows = [(1, prose(20, k), "en", "s") for k in range(60)] + [(i, prose(20, 100 + i), "en", "s") for i in range(2, 40)]
    lab = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 40)], "doc_id long, quality int, toxic int")
    texts, labels = toxicity.training_rows(docs(spark, rows), lab)
    assert Counter(labels) == {0: 5, 1: 5} and len(set(texts)) == 10
    monkeypatch.setattr(langid, "MAX_ROWS", 4)
    texts, names = langid.training_rows(docs(spark, [(1, prose(9, k), "aa", "s") for k in range(50)] + [(i, prose(9, i), "bb", "s") for i in range(2, 30)]))
    assert Counter(names) == {"aa": 4, "bb": 4}


def test_a_language_of_long_texts_only_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_CHARS", 4000)
    rows = [(i, " ".join(random.Random(i).choice(["que", "nya", "oso"]) for _ in range(20)), "short", "s") for i in range(40)]
    rows += [(100 + i, " ".join(random.Random(i).choice(["bath", "thick", "wish"]) for _ in range(3000)), "long", "s") for i in range(40)]
    got = langid.identify(docs(spark, rows)).collect()
    assert {r["lang_pred"] for r in got} == {"short", "long"} and all((r["lang_pred"] == "long") == (r["doc_id"] >= 100) for r in got)


# -- copies ------------------------------------------------------------------------------------


def test_rows_of_one_id_go_by_their_own_text(spark):
    a, b = prose(40, 1), prose(40, 2)
    rows = [(3, b, "", ""), (5, a, "", ""), (5, b, "", ""), (7, a, "", ""), (7, a, "", ""), (8, a + " x", "", ""), (9, prose(40, 3), "", ""), (9, prose(40, 3), "", "")]
    kept = Counter((r["doc_id"], r["text"]) for r in chosenpath.drop_near_copies(docs(spark, rows)).collect())
    assert kept == {(3, b): 1, (5, a): 1, (9, prose(40, 3)): 1}


def test_blocks_by_weight_give_the_same_links(spark, monkeypatch):
    base = prose(60, 5)
    rows = [(i, base + " " + prose(3, i), "", "") for i in range(120)]
    want = sorted(tuple(r) for r in chosenpath.join(docs(spark, rows)).collect())
    assert all(r[1] == 119 for r in want)
    monkeypatch.setattr(chosenpath, "WEIGHT", 500)
    assert sorted(tuple(r) for r in chosenpath.join(docs(spark, rows)).collect()) == want


def test_near_paragraphs_equal_brute_force(spark):
    """Paragraphs that are near copies, of any length from a run of five words, are clustered as all pairs would be."""
    lines = []
    for k in range(40):
        own = prose(8 + k, 3000 + k).split()
        lines += [own, [*own, "zz"], own[1:], [*own[: len(own) // 2], "qq", *own[len(own) // 2 :]]]
    rows = [(i, " ".join(x), "", "") for i, x in enumerate(lines)]
    every = shared.stored(substring._units(docs(spark, rows)), "units")
    got = Counter(r["keeper"] for r in every.where("bands is not null").join(substring._clusters(docs(spark, rows), every), "sig").collect())
    sets = [shingles(t) for _, t, _, _ in rows]
    pairs = sum(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    groups = near_groups([(i, t) for i, t, _, _ in rows])
    linked = len(rows) - sum(1 for i, _ in groups if not any(len(sets[i] & s) >= 0.8 * len(sets[i] | s) for j, s in enumerate(sets) if j != i))
    assert pairs > 100 and sum(got.values()) >= 0.98 * linked and set(got) <= {i for i, _ in groups}


def test_links_found_against_brute_force(spark):
    r = np.random.default_rng(9)
    centers = r.normal(size=(40, 24))
    x = (centers[r.integers(0, 40, 2000)] + 0.28 * r.normal(size=(2000, 24))).astype(np.float32)
    table = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got, there = multiindex.measured_recall(table, multiindex.near_copies(table))
    assert there > 100 and 0.9 * there <= got <= there


def test_codebooks_grow_with_the_table():
    assert [multiindex.codes_for(n, 64) for n in (0, 10_000, 2_000_000, 10**8)] == [8, 16, 128, 1024]
    assert multiindex.sample_for(1024, 64) == 20_000 and multiindex.sample_for(4096, 64) == 65_536 and multiindex.codes_for(10**15, 64) * 16 <= multiindex.SAMPLE_BYTES // (8 * 64)


# -- whole texts and other columns -------------------------------------------------------------


def test_texts_longer_than_a_group_go_through_every_operator(spark, monkeypatch):
    monkeypatch.setattr(textvec, "GROUP", 2000)
    monkeypatch.setattr(shared, "SLICE_BYTES", 3000)
    long = prose(4000, 11)
    item = prose(30, 12)
    rows = [(1, long, "aa", "s"), (2, long + " z", "aa", "t"), (3, long[: len(long) // 2] + " " + item + long[len(long) // 2 :], "bb", "t"), (4, prose(50, 13), "bb", "s")]
    d = docs(spark, rows)
    assert {r["doc_id"]: r["n_links"] for r in chosenpath.join(d).collect()} == {1: 2, 2: 2, 3: 2, 4: 0}
    assert [r["doc_id"] for r in decontam.leaks(d, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()] == [3]
    assert {r["class_id"] for r in substring.spans(d).collect()} == {1}
    assert len(langid.identify(d).collect()) == 4 and mixing.mix(d).count() == 4


@pytest.mark.parametrize("name", ["h", "size", "hash", "sig", "seg", "n", "x", "place", "key", "bucket", "score"])
def test_extra_columns_may_have_any_name(spark, name):
    d = docs(spark, [(i, prose(30, i % 3), "ab"[i % 2] * 2, "s") for i in range(6)]).withColumn(name, F.lit("other"))
    assert mixing.mix(d).count() == 6 and mixing.apply_mix(d).columns == d.columns
    assert {r["n_links"] for r in chosenpath.join(d).collect()} == {1} and chosenpath.drop_near_copies(d).count() == 3
    assert langid.identify(d).count() == 6 and substring.spans(d).count() == 6
    if os.path.exists("/opt/tokenizers"):
        public = pytest.importorskip("public_tokenizers")
        assert tokens.round_trip(d, public.path("word_bpe_49k.json")).count() == 6
