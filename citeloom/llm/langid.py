"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1. For every bit a linear classifier over hashed character n-grams learns
to tell the languages with +1 from the others, all bits being fitted together. A text is given the language whose
codeword has the least total logistic loss against the outputs; the losses also give a probability, and a text
whose two nearest codewords lie close is flagged as ambiguous.

Up to ``EXHAUSTIVE`` languages use all distinct two-way splits, more use random codewords chosen for their distance.
The classifiers are fitted to a bounded sample (``MAX_ROWS`` texts a language in the order of a hash of the id, with
at most ``MAX_CHARS`` in total, long ones by a stretch out of their middle), cut into pieces of several lengths so that short texts are known too; every text is
predicted whole.

Defined results: ``und`` with score 0 for a null text or one without a letter, and for all texts if there is no
labelled row; with one language learned, that one with score 1. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec
from .shared import by_bytes
from .toxicity import held_out

SIZES, BUCKETS = (2, 3), 1 << 13
EXHAUSTIVE, MAX_ROWS, MAX_CHARS = 6, 500, 6_000_000
PIECES = (30, 120, 600)
EPOCHS, BATCH, RATE, DECAY, SEED = 25, 64, 0.5, 1e-5, 11
AMBIGUOUS = 0.2


def codewords(n: int) -> np.ndarray:
    """One row of +1 and -1 for each of ``n`` languages."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE:
        return np.array([[1.0, *bits] for bits in itertools.product((1.0, -1.0), repeat=n - 1)][1:]).T
    rng = np.random.default_rng(SEED)
    width = 10 * int(np.ceil(np.log2(n)))
    tries = (np.where(rng.random((n, width)) < 0.5, -1.0, 1.0) for _ in range(100))

    def spread(c: np.ndarray) -> tuple[int, int]:
        apart = (width - c @ c.T) / 2
        np.fill_diagonal(apart, width)
        return int(apart.min()), int((np.abs(c.sum(axis=0)) < n).sum())

    return max(tries, key=spread)


def features(texts: list[str | None]) -> np.ndarray:
    """Square roots of the n-gram counts, each row of length 1."""
    x = np.zeros((len(texts), BUCKETS), np.float32)
    for index, pieces in textvec.groups(texts):
        ids, word, n_words, _ = textvec.ngrams(pieces, SIZES, BUCKETS)
        place = np.repeat(np.arange(len(pieces)), n_words)[word]
        for a in range(0, len(pieces), 256):
            some = slice(None) if len(pieces) <= 256 else (place >= a) & (place < a + 256)
            n = min(256, len(pieces) - a)
            x[index[a : a + n]] += np.bincount((place[some] - a) * BUCKETS + ids[some], minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
    np.sqrt(x, out=x)
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, probabilities, and which texts are ambiguous."""
        lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], dtype=bool)
        lang, score, unsure = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        rows = np.flatnonzero(lettered)
        for a in range(0, len(rows), 512):
            part = rows[a : a + 512] if self.langs else rows[:0]
            if not len(part):
                break
            f = features([texts[i] for i in part]).astype(np.float64) @ self.weights + self.bias
            loss = np.logaddexp(0, -f[:, None, :] * self.codes[None]).sum(axis=2)
            p = np.exp(loss.min(axis=1, keepdims=True) - loss)
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            score[part] = p.max(axis=1)
            if len(self.langs) > 1:
                two = np.sort(p, axis=1)[:, -2:]
                unsure[part] = two[:, 1] - two[:, 0] < AMBIGUOUS
            for i, k in zip(part.tolist(), best.tolist(), strict=True):
                lang[i] = self.langs[k]
        return lang, score, unsure


def _cut(text: str) -> list[str]:
    """The text, and pieces of it of each of the lengths."""
    return [text, *(text[a : a + n] for n in PIECES for a in range(0, min(len(text), 4 * n), 2 * n) if len(text) > n)]


def fit(texts: list[str], langs: list[str]) -> Model:
    names = tuple(sorted(set(langs)))
    codes = codewords(len(names))
    if len(names) < 2:
        return Model(names, codes, np.zeros((BUCKETS, 1)), np.ones(1))
    number = {n: i for i, n in enumerate(names)}
    pairs = [(p, number[g]) for t, g in zip(texts, langs, strict=True) for p in _cut(t)]
    y = np.array([g for _, g in pairs])
    weigh = len(y) / (len(names) * np.bincount(y, minlength=len(names)))
    rng = np.random.default_rng(SEED)
    k = codes.shape[1]
    w, b = np.zeros((BUCKETS, k), np.float32), np.zeros(k, np.float32)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for a in range(0, len(pairs), 256):
        x = features([p for p, _ in pairs[a : a + 256]])
        for row in x:
            at = np.flatnonzero(row)
            kept.append((at.astype(np.int32), row[at]))
    w_sq, b_sq = np.full((BUCKETS, k), 1e-4, np.float32), np.full(k, 1e-2, np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(kept))
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            n = [len(kept[i][0]) for i in part]
            cols, vals = np.concatenate([kept[i][0] for i in part]), np.concatenate([kept[i][1] for i in part])
            x = np.zeros((len(part), BUCKETS), np.float32)
            x[np.repeat(np.arange(len(part)), n), cols] = vals
            c = codes[y[part]]
            g = (-c / (1 + np.exp(c * (x @ w + b))) * (weigh[y[part]] / len(part))[:, None]).astype(np.float32)
            used = np.unique(cols)
            g_w, g_b = x[:, used].T @ g + DECAY * w[used], g.sum(axis=0)
            w_sq[used] += g_w**2
            w[used] -= RATE * g_w / np.sqrt(w_sq[used])
            b_sq += g_b**2
            b -= RATE * g_b / np.sqrt(b_sq)
    return Model(names, codes, w.astype(np.float64), b.astype(np.float64))


def training_rows(docs: DataFrame) -> tuple[list[str], list[str]]:
    """The bounded sample of labelled texts, as many of each language at most, read in one scan.

    ``MAX_ROWS`` texts a language come first in the order of a hash; while they are found, each task keeps no more than that of
    each. All of them together have ``MAX_CHARS`` characters at most, of which every language has an equal share, so that a language of nothing
    but long texts is learned too. A text gives no more than four even parts of that share, out of its middle if it is longer; texts are
    taken in the order of the hash until the share is used up, so where most are long the last ones of a language aren't read."""
    open_rows = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    keyed = open_rows.select("lang", F.struct(F.xxhash64("doc_id", "text", F.lit(SEED)).alias("key"), F.xxhash64("text").alias("h")).alias("x")).distinct()
    per_lang = keyed.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("x"))).where(F.col("place") <= MAX_ROWS).select("lang", "x.*")
    picked = [tuple(r) for r in per_lang.collect()]
    langs = {lang for lang, _, _ in picked}
    if not langs:
        return [], []
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("key", T.LongType()), T.StructField("h", T.LongType())])
    table = F.broadcast(docs.sparkSession.createDataFrame(picked, schema))
    piece = max(1, MAX_CHARS // len(langs) // MAX_ROWS)
    n = F.length("text")
    middle = F.when(n <= 4 * piece, F.col("text")).otherwise(F.substring(F.col("text"), (F.floor(n / 2) - 2 * piece).cast("int"), F.lit(4 * piece)))
    same = F.xxhash64("doc_id", "text", F.lit(SEED)).alias("key")
    found = open_rows.select("lang", same, F.xxhash64("text").alias("h"), middle.alias("text")).join(table, ["lang", "key", "h"]).dropDuplicates(["lang", "key", "h"])
    left = dict.fromkeys(langs, MAX_CHARS // len(langs))
    texts, names = [], []
    for _, lang, text in sorted((r["key"], r["lang"], r["text"]) for r in found.collect()):
        some = text[: left[lang]]
        if some:
            left[lang] -= len(some)
            texts.append(some)
            names.append(lang)
    return texts, names


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of each document."""
    held = docs.sparkSession.sparkContext.broadcast(fit(*training_rows(docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in by_bytes(batches, 1):
            lang, score, unsure = m.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema).withColumn("held_out", held_out(F.col("doc_id")))
