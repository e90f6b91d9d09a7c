"""The ten operators on small fixtures: against brute force, exact round trips, held-out accuracy, and odd input."""

import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from citeloom.llm import chosenpath, components, decontam, langid, mixing, multiindex, substring, textvec, tokencoder, tokens, toxicity, urlfilter, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(3)
VOCABULARY = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(600)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows], DOC)


ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, "word", "en", "a"),
    (4, prose(4000, 1), "de", "a"),
    (5, "the same text in two rows of the table", "en", "b"),
    (6, "the same text in two rows of the table", "en", "b"),
    (6, "the same text in two rows of the table", "en", "b"),
    (None, "a text without an id that has some words", "fr", None),
    (7, "\x00\x1c odd \u2028 İstanbul ß Σίσυφος \U0001f600 \n\n", "fr", "c"),
]


# -- kernels -----------------------------------------------------------------------------------


def test_words_are_those_of_the_regex_whatever_the_grouping(monkeypatch):
    texts = [t for _, t, _, _ in ODD] + [prose(300, 5), "a_b c-d É", "x" * 50]
    whole, at = textvec.words(texts)
    assert [b - a for a, b in zip(at[:-1], at[1:], strict=True)] == [len(re.findall(r"\w+", (t or "").lower())) for t in texts]
    monkeypatch.setattr(textvec, "GROUP", 64)
    again, at2 = textvec.words(texts)
    assert (whole == again).all() and (at == at2).all()


def test_equal_words_have_equal_hashes():
    w, at = textvec.words(["Foo bar", "bar, FOO!", "baz"])
    assert w[0] == w[3] and w[1] == w[2] and len(set(w.tolist())) == 3


@pytest.mark.parametrize("n", [0, 1, 2, 4095, 4096, 4097, 30_000])
def test_segments_decode_to_what_was_encoded(n):
    r = np.random.default_rng(n)
    ids = r.zipf(1.3, n).clip(0, 49_000).astype(np.uint32)
    sizes = np.array([n // 3, 0, n - n // 3])
    data = tokencoder.encode_segment(ids, sizes)
    back, got = tokencoder.decode_segment(data)
    assert (back == ids).all() and got.tolist() == sizes.tolist()


def test_damage_is_found_in_every_part():
    ids = np.random.default_rng(0).integers(0, 300, 9000).astype(np.uint32)
    data = tokencoder.encode_segment(ids, np.array([9000]))
    for at in (2, 20, len(data) // 3, len(data) // 2, len(data) - 200):
        broken = bytearray(data)
        broken[at] ^= 4
        with pytest.raises((tokencoder.Corrupt, zlib.error)):
            tokencoder.decode_segment(bytes(broken))
    with pytest.raises(tokencoder.Corrupt):
        tokencoder.decode_segment(data[:-10])


def test_repeated_contexts_cost_less_than_order_zero():
    once = np.random.default_rng(1).integers(0, 1000, 500).astype(np.uint32)
    again = np.tile(once, 8)
    other = np.random.default_rng(2).permutation(again)
    assert len(tokencoder.encode_segment(again, np.array([4000]))) < 0.8 * len(tokencoder.encode_segment(other, np.array([4000])))


# -- op1 ---------------------------------------------------------------------------------------


def brute_targets(sizes):
    """Share again and again, until nobody is above the limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 3 * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / w for s in free}
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mix_meets_its_targets(spark):
    rows = [(i, prose(random.Random(i).randint(0, 60), i), "en", "hot" if i % 3 else f"s{i % 7}" if i % 11 else None) for i in range(900)] + ODD
    d = docs(spark, rows)
    got = mixing.mix(d).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, largest, taken = Counter(), Counter(), Counter()
    for _, t, _, s in rows:
        sizes[s] += size(t)
        largest[s] = max(largest[s], size(t))
    want = brute_targets(sizes)
    by_size = defaultdict(set)
    for s in sizes:
        by_size[sizes[s]].add(s)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        assert any(abs(r["target"] - want[s]) < 1e-6 * max(1, want[s]) for s in by_size[r["source_size"]])
        taken[r["source_size"]] += r["taken"]
    for n, names in by_size.items():
        assert abs(taken[n] - sum(want[s] for s in names)) <= sum(largest[s] for s in names)
    assert sorted(map(str, mixing.mix(d).collect())) == sorted(map(str, got))
    copies = mixing.apply_mix(d)
    assert copies.columns == d.columns and copies.count() == sum(r["copies"] for r in got)


def test_mix_of_nothing_and_of_empty_texts(spark):
    assert mixing.mix(docs(spark, []).limit(0)).collect() == []
    assert [r["taken"] for r in mixing.mix(docs(spark, [(1, "", "x", "s"), (2, None, "x", None)])).collect()] == [0, 0]


# -- op2, op4 ----------------------------------------------------------------------------------


def test_toxicity_finds_unseen_misspellings(spark):
    bad = ["grumblefoot", "snotwhistle", "dunderclod"]
    rows, labels = [], []
    for i in range(400):
        words = prose(60, i).split()
        if i % 4 == 0:
            words[i % 50] = bad[i % 3] if i < 300 else bad[i % 3].replace("m", "n").replace("w", "vv") + "z"
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(i % 4 == 0)))
    d = docs(spark, rows + [(None, None, None, None), (1000, "", None, None)]).selectExpr("*", "1 as score")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(d, lab).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(400))
    held = [i for i in range(400) if got[i]["held_out"]]
    right = np.mean([got[i]["predicted"] == (i % 4 == 0) for i in held])
    assert right > 0.95 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert got[1000]["predicted"] == 0 and got[None]["predicted"] == 0 and got[None]["held_out"] is False
    kept = toxicity.drop_toxic(d, lab)
    assert kept.columns == d.columns and kept.count() == sum(r["predicted"] == 0 for r in got.values())


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)], [(1, 1, 0), (2, 1, 0)]])
def test_toxicity_without_one_of_the_labels(spark, labels):
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scores = {r["score"] for r in toxicity.classify(docs(spark, ODD), lab).collect()}
    assert scores == {1.0 if labels and labels[0][2] else 0.0}
    assert toxicity.classify(docs(spark, []), lab).collect() == []


def test_languages_are_told_apart_when_held_out(spark):
    stock = {g: ["".join(random.Random(f"{g}{k}{j}").choice(s) for j in range(3)) for k in range(40)] for g, s in {"xx": ["ba", "be", "ti"], "yy": ["öl", "ür", "sch"], "zz": ["que", "ña", "os"]}.items()}
    rows = [(i, " ".join(random.Random(i).choice(stock[g]) for _ in range(25)), g, "s") for i in range(300) for g in [sorted(stock)[i % 3]]]
    rows += [(1000, None, "xx", "s"), (1001, "12 34 !", "yy", "s"), (1002, "", "zz", "s"), (None, "bababa", None, None)]
    got = {r["doc_id"]: r for r in langid.identify(docs(spark, rows)).collect()}
    held = [i for i in range(300) if got[i]["held_out"]]
    assert np.mean([got[i]["lang_pred"] == sorted(stock)[i % 3] for i in held]) > 0.97
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in {*stock, "und"} for r in got.values())


def test_language_with_no_or_one_label(spark):
    assert {r["lang_pred"] for r in langid.identify(docs(spark, [(1, "abc", None, "s")])).collect()} == {"und"}
    assert [(r["lang_pred"], r["score"]) for r in langid.identify(docs(spark, [(i, "abc", "qq", "s") for i in range(8)])).collect()] == [("qq", 1.0)] * 8
    assert langid.identify(docs(spark, [])).collect() == []


@pytest.mark.parametrize("n", [2, 4, 6, 7, 30])
def test_codewords_differ(n):
    c = langid.codewords(n)
    assert len({tuple(r) for r in c}) == n and (abs(c.sum(axis=0)) < n).all()


# -- op3, op5 ----------------------------------------------------------------------------------


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def edited(text, n, seed):
    w, r = text.split(), random.Random(seed)
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(1000)}"
    return " ".join(w)


def near_copies():
    rows = [(1000 + i, prose(120, i), "en", "s") for i in range(60)]
    rows += [(100 + i, edited(prose(120, i % 5), i % 4, i), "en", "s") for i in range(60)]
    rows += [(300 + i, edited(prose(200, 777), 1, 900 + i), "en", "s") for i in range(150)]  # one group larger than a small bucket
    return rows + [(500 + i, prose(120, 3).upper() + "!", "en", "s") for i in range(5)] + ODD


def brute_links(rows):
    sets = [(i, shingles(t)) for i, t, _, _ in rows]
    n, parent = Counter(), {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is not None and j is not None and x and y and len(x & y) / len(x | y) >= 0.8:
                n[a] += 1
                n[b] += 1
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return sorted((str(i), n[a], str(root(i))) for a, (i, _) in enumerate(sets))


def test_jaccard_join_equals_brute_force(spark):
    rows = near_copies()
    d = docs(spark, rows).selectExpr("*", "1 as sig", "2 as bucket")
    got = chosenpath.join(d).collect()
    assert sorted((str(r["doc_id"]), r["n_links"], str(r["class_id"])) for r in got) == brute_links(rows)
    kept = chosenpath.drop_near_copies(d)
    assert kept.columns == d.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = {r["class_id"] for r in got if r["class_id"] is not None}
    assert Counter(i for i in ids if i is not None) == Counter(want) and ids.count(None) == 1


def test_jaccard_join_splits_and_blocks(spark, monkeypatch):
    rows = near_copies()[60:270]
    monkeypatch.setattr(chosenpath, "SMALL", 4)
    monkeypatch.setattr(chosenpath, "BLOCK", 16)
    got = chosenpath.join(docs(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_links"], str(r["class_id"])) for r in got) == brute_links(rows)


def test_jaccard_join_of_nothing(spark):
    assert chosenpath.join(docs(spark, [])).collect() == []
    assert [r["n_links"] for r in chosenpath.join(docs(spark, [(1, None, "", ""), (2, "", "", "")])).collect()] == [0, 0]


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}


def test_repeated_passages_are_found_wherever_they_stand(spark):
    passage = prose(55, 4242)
    rows = [(i, prose(80, i) + " " + (passage + " " if i % 5 == 0 else "") + prose(80, 1000 + i), "en", "s") for i in range(40)]
    line = prose(60, 99)
    rows += [(100 + i, prose(40, 2000 + i) + "\n" + edited(line, i % 2, i) + "\n" + prose(40, 3000 + i), "en", "s") for i in range(6)]
    rows += [(200 + i, prose(40, 4000 + i) + "\nAll rights reserved by the one company.\n", "en", "s") for i in range(20)]
    rows += [(300, prose(70, 5000) + " " + prose(70, 5000), "en", "s"), (None, passage, "en", "s"), (301, None, None, None), (302, "", None, None)]
    got = defaultdict(list)
    for r in substring.spans(docs(spark, rows)).collect():
        got[r["doc_id"]].append(r)
    assert set(got) == {i for i in range(0, 40, 5)} | {100 + i for i in range(6)}
    for i in range(0, 40, 5):
        (r,) = got[i]
        assert r["class_id"] == 0 and r["removed"] == (i != 0) and 80 <= r["start"] and r["start"] + r["n_words"] <= 136 and r["n_words"] >= 18
    assert substring.spans(docs(spark, [])).collect() == []


def left_over(spark, rows):
    """The words of each document that are not in removed spans, and the spans."""
    found = substring.spans(docs(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    kept = {}
    for i, t in rows:
        gone = {k for r in found if r["doc_id"] == i and r["removed"] for k in range(r["start"], r["start"] + r["n_words"])}
        kept[i] = " ".join(w for k, w in enumerate(t.split()) if k not in gone)
    return kept, found


def test_a_passage_beside_an_older_one_is_kept_somewhere(spark):
    one, two = prose(45, 71), prose(45, 72)
    for glue in (" ", "\n"):
        kept, found = left_over(spark, [(3, prose(30, 73) + glue + one), (5, one + glue + two), (7, two + glue + prose(30, 74))])
        assert one[9:-9] in kept[3] and two[60:-60] in kept[5] and two[60:-60] not in kept[7]
        assert one[60:-60] not in kept[5]
        assert all(r["removed"] == (r["class_id"] != r["doc_id"]) for r in found)
    # the second copy of a piece stands in a near copy of an older paragraph and goes with it: the third stays
    near = prose(60, 75).split()
    changed = near[:50] + ["otherwise"] + near[51:]
    kept, _ = left_over(spark, [(1, " ".join(near)), (2, " ".join(changed)), (4, prose(60, 76) + " " + " ".join(changed[30:]))])
    assert kept[2] == "" and "otherwise" in kept[4]


def set_in(text, width, first):
    """The text in lines of ``width`` words, the first line of ``first``."""
    w = text.split()
    cuts = [0, *range(first, len(w), width), len(w)]
    return "\n".join(" ".join(w[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))


def test_passages_over_lines_are_found_to_their_ends(spark):
    # passages of 51 words that begin and end within lines, by lines of 1 to 200 words; each in two documents, set differently
    widths = [1, 2, 7, 15, 25, 200]
    rows, where = [], {}
    for i in range(60):
        passage = prose(51, 9000 + i)
        for j in (2 * i, 2 * i + 1):
            n = 70 + j % 13
            rows.append((j, set_in(f"{prose(n, 10_000 + j)} before{j} {passage} after{j} {prose(70, 20_000 + j)}", widths[(i + j % 2) % 6], 1 + j % widths[(i + j % 2) % 6])))
            where[j] = (n + 1, 51)
    found = substring.spans(docs(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    assert {r["doc_id"]: (r["start"], r["n_words"]) for r in found} == where and len(found) == len(where)
    assert all(r["class_id"] == r["doc_id"] // 2 * 2 and r["removed"] == (r["doc_id"] % 2 == 1) for r in found)


@pytest.mark.parametrize("n", [0, 5, 39, 40, 41, 400])
def test_every_passage_has_an_anchor(n):
    texts = [prose(n, 31), "", prose(57, 32), prose(n, 33)]
    w, at = textvec.words(texts)
    found, sig = substring.anchors(w, at[1:])
    for a, b in zip(at[:-1], at[1:], strict=True):
        inside = found[(found >= a) & (found < b)]
        assert all(((inside >= k) & (inside + substring.ANCHOR <= k + substring.LONG_SPAN)).any() for k in range(a, b - substring.LONG_SPAN + 1))
    alone, own = substring.anchors(*(lambda w, at: (w, at[1:]))(*textvec.words(texts[2:3])))
    assert set(own) <= set(sig)


# -- op6 ---------------------------------------------------------------------------------------


def test_embedding_links_equal_brute_force(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(300, 32))
    near = base[:60] + 0.1 * r.normal(size=(60, 32))
    group = base[0] + 0.12 * r.normal(size=(80, 32))
    x = np.concatenate([base, near, group, base[:10], 7 * base[10:15]]).astype(np.float32)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    odd = [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 32, 0), (1003, [float("nan")] * 32, 0), (1004, [None] + [1.0] * 31, 0), (None, [1.0] * 32, 0), (1005, [1.0, 2.0], 0), (1006, [2.0, 4.0], 0)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as sig", "1 as row")
    got = {v["vec_id"]: v for v in multiindex.near_copies(table).collect()}
    assert len(got) == len(rows) + len(odd)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    found = np.array([got[i]["n_links"] for i in range(len(u))])
    assert (found <= link.sum(axis=1)).all() and found.sum() >= 0.98 * link.sum()
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in range(len(u)))
    assert got[1005]["n_links"] == got[1006]["n_links"] == 1 and got[1006]["component_id"] == 1005
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (1000, 1001, 1002, 1003, 1004))


def test_embedding_of_nothing(spark):
    assert multiindex.near_copies(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


# -- op7, op8 ----------------------------------------------------------------------------------


def test_token_ids_survive_the_round_trip(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    rows = ODD + [(20 + i, prose(i, i) + " don't <|endoftext|> \x01 x\u00a0y", "en", "s") for i in range(30)]
    got = tokens.round_trip(docs(spark, rows), path).collect()
    tokenizer = Tokenizer.from_file(path)
    want = Counter()
    for i, t, _, _ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0, *(r["n_tokens"] for r in ordered)])[:-1].tolist()
    known = [r["doc_id"] for r in ordered if r["doc_id"] is not None]
    assert ordered[0]["doc_id"] is None and known == sorted(known)
    assert tokens.round_trip(docs(spark, []), path).collect() == []


PAGE = "page_id long, url string, html string"


def test_warc_archives_are_read_back(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 256)
    long, same = "<p>" + prose(400, 8) + "é</p>", "x" * 120
    rows = [(5, "http://a/b c", same), (3, None, same), (3, "http://z/", same), (9, "http://q/", same), (4, "u", "short"), (8, "u", "short"), (1, "u", None), (2, "u", ""), (7, "u", long), (6, "u", long + "!"), (None, "u", same), (None, "u", long + "?")]
    table = spark.createDataFrame(rows, PAGE).selectExpr("*", "'x' as digest")
    got = Counter(tuple(r) for r in warc.round_trip(table).collect())
    import hashlib

    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        first = min((j for j, _, k in rows if k == h and j is not None), default=None) if len(b) >= 100 else i
        want[i, len(b), hashlib.sha256(b).hexdigest(), "response" if first in (None, i) else "revisit", None if first in (None, i) else first] += 1
    assert got == want
    assert warc.round_trip(table.limit(0)).collect() == []


def test_warc_records_of_repeated_and_null_ids_stay_apart(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(warc, "CHUNK", 256)
    one, two = prose(400, 81), prose(300, 82)
    rows = [(5, "u", one), (5, "v", one), (5, "u", one), (5, "u", two), (8, "u", one), (9, "u", two), (6, "u", "short"), (6, "u", "short")]
    rows += [(None, "u", prose(350, 83))] * 8
    table = spark.createDataFrame(rows, PAGE).repartition(4)
    records = [r for r in warc.archive(table).collect() if r["chunk_no"] == 0]
    assert len({r["record_id"] for r in records}) == len(records) == len(rows)
    heads = [(r["record_id"], warc._fields(bytes(r["data"]))[0]) for r in records]
    responses = {name: (int(f["x-page-id"]), f["warc-payload-digest"]) for name, f in heads if f["warc-type"] == "response" and "x-page-id" in f}
    told = [(f["warc-refers-to"].strip("<>"), f) for _, f in heads if f["warc-type"] == "revisit"]
    assert len(told) == 2 and all(responses[name] == (int(f["x-refers-to-page"]), f["warc-payload-digest"]) for name, f in told)
    want = Counter((i, len(h), hashlib.sha256(h.encode()).hexdigest(), *(("revisit", 5) if i in (8, 9) else ("response", None))) for i, _, h in rows)
    assert Counter(tuple(r) for r in warc.round_trip(table).collect()) == want


def test_warc_files_are_parsed_in_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 100)
    rows = sorted(((r["record_id"], r["chunk_no"], r["last"], bytes(r["data"]), r["digest"]) for r in warc.archive(spark.createDataFrame([(i, "u", prose(5 * i * i, i)) for i in range(8)], PAGE)).collect()), key=lambda r: r[:2])
    plain, packed = io.BytesIO(), io.BytesIO()
    warc.export(iter(rows), plain, compress=False)
    warc.export(iter(rows), packed)
    for f in (plain, packed):
        f.seek(0)
        back = list(warc.parse(f))
        assert max(len(r[3]) for r in back) < 1000
        assert sorted(map(str, warc._checked(iter(back)))) == sorted(map(str, warc._checked(iter(rows))))
    cut = io.BytesIO(plain.getvalue()[:-500])
    with pytest.raises(warc.Damaged):
        list(warc.parse(cut))
    broken = [(n, k, x, d.replace(b"</html>", b"") if k else d[:-6] + b"zz" + d[-4:], s) for n, k, x, d, s in rows]
    with pytest.raises(warc.Damaged):
        list(warc._checked(iter(broken)))


# -- op9, op10 ---------------------------------------------------------------------------------

URLS = ["https://Sub.Example.ORG/es/x?q", "http://example.org/en/12", "http://example.org/en/2", "http://badexample.org/es/", "https://a.com/fr/", "https://com/de/x", "http://a.com/de", "ftp://spam.net/x", "http://nospam.net/x", "no scheme", "", None, "http://b.net/a/login.html", "x://y?z://com/fr/", "http://org", "http://org/", "http://a.org#/es/"]


def brute_verdict(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = [(len(r.text), r.text, r.verdict) for r in urlfilter.RULES if r.listed for h, s, p in [r.text.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith(s + p)]
    best = max(fits, default=None)
    other = any(re.search(r.regex, host + path) for r in urlfilter.RULES if not r.listed)
    return host, path, best and best[1], best[2] if best else "block" if other else "allow"


@pytest.mark.parametrize("inline", [256, 0])
def test_url_rules_equal_brute_force(spark, monkeypatch, inline):
    monkeypatch.setattr(urlfilter, "INLINE_RULES", inline)
    table = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS * 2)], PAGE).selectExpr("*", "'x' as host", "1 as place", "2 as rule")
    got = {r["page_id"]: r for r in urlfilter.judge(table).collect()}
    assert len(got) == 2 * len(URLS)
    for i, u in enumerate(URLS * 2):
        assert tuple(got[i][c] for c in ("host", "path", "rule", "verdict")) == brute_verdict(u), u
    assert urlfilter.judge(table.limit(0)).collect() == []


def test_url_rule_without_tokens_is_always_tried(spark):
    rules = [urlfilter.pattern("block", "digits", r"^\d+\.\d+")]
    table = spark.createDataFrame([(1, "http://1.2/", ""), (2, "http://a/", "")], PAGE)
    assert [r["verdict"] for r in urlfilter.judge(table, rules).orderBy("page_id").collect()] == ["block", "allow"]


def test_leaks_are_found_also_when_reordered(spark):
    items = [(i, prose(40, 9000 + i)) for i in range(12)] + [(50, "three words only"), (51, ""), (52, None), (53, "a a a a a a a a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    half = lambda t: " ".join(t.split()[20:] + ["and", "then"] + t.split()[:20])
    rows = [(i, prose(200, i) + " " + dict(items)[i % 12].upper().replace(" ", ", ") + " " + prose(50, i), "en", "s") for i in range(0, 30, 3)]
    rows += [(100, prose(50, 1) + half(items[2][1]), "", ""), (101, prose(20, 3) + " " + " ".join(items[4][1].split()[:12]), "", ""), (102, "these are three words only here", "", ""), (103, prose(500, 4), "", ""), (104, "a " * 300, "", ""), *ODD]
    d = docs(spark, rows).selectExpr("*", "1 as item_id")
    got = defaultdict(set)
    for r in decontam.leaks(d, bench).collect():
        got[r["doc_id"]].add(r["item_id"])
        assert r["coverage"] >= 0.5 and r["n_covered"] <= r["n_words"]
    want = {i: {i % 12} for i in range(0, 30, 3)} | {100: {2}, 102: {50}, 104: {53}}
    assert dict(got) == want
    kept = decontam.drop_leaks(d, bench)
    assert kept.columns == d.columns and kept.count() == len(rows) - len(want)
    assert decontam.leaks(d, bench.limit(0)).collect() == [] and decontam.leaks(d.limit(0), bench).collect() == []


def test_many_blocks_give_the_same_leaks(spark, monkeypatch):
    items = [(i, prose(30, 9000 + i)) for i in range(12)]
    bench, d = spark.createDataFrame(items, "item_id long, text string"), docs(spark, [(i, prose(30, 9000 + i) + " x", "", "") for i in range(12)])
    one = sorted(map(str, decontam.leaks(d, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 400)
    assert sorted(map(str, decontam.leaks(d, bench).collect())) == one and len(one) == 12


def greedy_tiling(a, b, least):
    """The longest match of unmarked words, the first of equals, again and again."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for x in range(len(a)):
            for y in range(len(b)):
                k = 0
                while x + k < len(a) and y + k < len(b) and a[x + k] == b[y + k] and free_a[x + k] and free_b[y + k]:
                    k += 1
                if k > best[0]:
                    best = (k, x, y)
        if best[0] < least:
            return out
        k, x, y = best
        free_a[x : x + k], free_b[y : y + k] = [False] * k, [False] * k
        out.append(best)


def test_tiles_are_those_of_the_greedy_tiling():
    r = np.random.default_rng(2)
    for letters in (2, 4, 12):
        for _ in range(25):
            a, b = r.integers(0, letters, r.integers(3, 40)).astype(np.uint64), r.integers(0, letters, r.integers(3, 60)).astype(np.uint64)
            got, want = decontam.tiles(a, b, 3), greedy_tiling(a.tolist(), b.tolist(), 3)
            assert sorted(got) == sorted(want)
    long = np.arange(100, dtype=np.uint64)
    assert decontam.tiles(long, np.concatenate([long[50:], long[:50]]), 5) == [(50, 0, 50), (50, 50, 0)]
    assert decontam.tiles(long[:2], long, 2) == [(2, 0, 0)] and decontam.tiles(long[:5], long[50:], 5) == []


def test_leaks_equal_tiling_all_pairs(spark):
    items = {i: prose(12 + i, 700 + i) for i in range(8)}
    cut = lambda t, a, b: " ".join(t.split()[a:b])
    texts = {10 * i + k: prose(15, i) + " " + x + " " + prose(9, i + 50) for i, t in items.items() for k, x in enumerate([t, cut(t, 0, 5), cut(t, 4, 30), cut(t, 6, 30) + " zz " + cut(t, 0, 6), ""])}
    found = {(r["doc_id"], r["item_id"]): (r["n_covered"], r["n_tiles"]) for r in decontam.leaks(docs(spark, [(i, t, "", "") for i, t in texts.items()]), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    want = {}
    for d, text in texts.items():
        for i, item in items.items():
            tiled = greedy_tiling(item.split(), text.split(), 5)
            covered = sum(k for k, _, _ in tiled)
            if covered >= 0.5 * len(item.split()):
                want[d, i] = (covered, len(tiled))
    assert found == want and len(want) >= 20
