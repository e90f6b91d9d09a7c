"""Toxicity: subword-bag embeddings, averaged, into a linear softmax; both trained jointly in numpy.

A text is read in windows of a few words. A window's vector is the mean of the embeddings of its words' character
n-grams, so a misspelt word shares most of its vectors with the word it stands for. The softmax gives each window a
score and a text gets its highest, which keeps a few words from drowning in a long text. Labels are of texts, so in
training a text labelled 1 answers with its highest window only, one labelled 0 with its highest and some others.

Only a bounded sample of labelled rows is fitted (``MAX_TRAIN_ROWS`` of each label in the order of a hash of the id,
``MAX_TRAIN_CHARS`` in total); every text is scored whole. For scoring, embeddings and softmax fold into one number
per n-gram bucket.

Defined results: null and wordless texts get the score that the label's base rate gives, at most; if the sample
lacks one of the labels, all texts score its share (0 or 1, 0 if there are none). Rows of ``labels`` with a null id
or label are ignored; repeated rows count as often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec
from .shared import by_bytes

SIZES, BUCKETS, DIM, WINDOW = (3, 4, 5), 1 << 18, 8, 8
MAX_TRAIN_ROWS, MAX_TRAIN_CHARS = 1_500, 8_000_000
EPOCHS, LEAST_STEPS, NOISY, BATCH, RATE, SEED = 30, 1_200, 0.2, 128, 0.15, 7
#: How much heavier clean rows weigh than toxic ones in the calibration, as they are far more frequent.
THRESHOLD, CLEAN = 0.3, 5.0


def held_out(doc_id: Column) -> Column:
    """Whether labels of this row are kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass(frozen=True)
class Model:
    """What an n-gram of each bucket adds; a window's score is the mean of that plus ``bias``."""

    weights: np.ndarray
    bias: float
    scale: float
    shift: float
    none: float

    def window_scores(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The scores of all windows, and how many each piece has."""
        ids, word, n_words, per_word = textvec.ngrams(pieces, SIZES, BUCKETS)
        win_of_word, n_win = _windows(n_words)
        m = int(n_win.sum())
        if not m:
            return np.empty(0), n_win
        total = np.bincount(win_of_word[word], weights=self.weights[ids], minlength=m)
        n = np.bincount(win_of_word, weights=per_word, minlength=m)
        return total / np.maximum(n, 1) + self.bias, n_win

    def scores(self, texts: list[str | None]) -> np.ndarray:
        best = np.full(len(texts), -np.inf)
        for index, pieces in textvec.groups(texts):
            s, n_win = self.window_scores(pieces)
            some = np.flatnonzero(n_win)
            if len(some):
                starts = (np.cumsum(n_win) - n_win)[some]
                np.maximum.at(best, index[some], np.maximum.reduceat(s, starts))
        out = np.full(len(texts), self.none)
        have = np.isfinite(best)
        if self.scale:
            out[have] = 1 / (1 + np.exp(-np.clip(self.scale * best[have] + self.shift, -60, 60)))
        return out


def _windows(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n_win = -(-n_words // WINDOW)
    first_word = np.cumsum(n_words) - n_words
    local = np.arange(int(n_words.sum())) - np.repeat(first_word, n_words)
    return np.repeat(np.cumsum(n_win) - n_win, n_words) + local // WINDOW, n_win


def _constant(p: float) -> Model:
    return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, 0.0, p)


def fit(texts: list[str | None], label: list[int]) -> Model:
    y = np.array(label, np.int64)
    if len(y) == 0 or y.min() == y.max():
        return _constant(float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(SEED)
    bag, offsets, owner = [], [], []
    for d, t in enumerate(texts):
        for _, pieces in textvec.groups([t]):
            ids, word, n_words, _ = textvec.ngrams(pieces, SIZES, BUCKETS)
            win_of_word, n_win = _windows(n_words)
            if len(ids):
                win = win_of_word[word]
                bag.append(ids[np.argsort(win, kind="stable")].astype(np.int32))
                counts = np.bincount(win, minlength=int(n_win.sum()))
                offsets.append(counts[counts > 0])
                owner.append(np.full(int((counts > 0).sum()), d))
    if not bag:
        return _constant(float(y.mean()))
    ids, count, doc = np.concatenate(bag), np.concatenate(offsets), np.concatenate(owner)
    start = np.cumsum(count) - count
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    docs = doc[first]
    n_win = np.diff(np.append(first, len(doc)))
    tuning = rng.random(len(docs)) < 0.2
    if len(set(y[docs[~tuning]])) < 2 or len(set(y[docs[tuning]])) < 2:
        tuning[:] = False
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    emb_sq, out_sq, bias_sq = np.full(BUCKETS, 1e-6, np.float32), np.full((DIM, 2), 1e-3, np.float32), np.full(2, 1e-3, np.float32)
    use = np.flatnonzero(~tuning)
    share = y[docs[use]].mean()
    weigh = np.array([0.5 / (1 - share), 0.5 / share], np.float32)

    def scored() -> np.ndarray:
        table = emb @ (out[:, 1] - out[:, 0])
        return np.add.reduceat(table[ids], start) / count + (bias[1] - bias[0])

    def highest(s: np.ndarray) -> np.ndarray:
        """For each text, its highest window."""
        order = np.lexsort((s, doc))
        return order[np.append(first[1:], len(doc)) - 1]

    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // (3 * len(use))))  # a small sample is gone through more often
    for epoch in range(epochs):
        top = highest(scored())[use]
        random = [first[use] + (rng.random(len(use)) * n_win[use]).astype(np.int64) for _ in range(2)]
        one = y[docs[use]] == 1
        chosen = [top[~one], *(r[~one] for r in random), *([r[one] for r in random] if epoch < NOISY * epochs else [top[one]])]
        picks = rng.permutation(np.concatenate(chosen))
        for i in range(0, len(picks), BATCH):
            w = picks[i : i + BATCH]
            n = count[w]
            ends = np.cumsum(n)
            at = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(start[w], n)
            own = ids[at]
            h = np.add.reduceat(emb[own], ends - n) / n[:, None]
            z = h @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            t = y[doc[w]]
            p[np.arange(len(w)), t] -= 1
            g = (p * weigh[t][:, None] / len(w)).astype(np.float32)
            g_h = g @ out.T
            g_out, g_bias = h.T @ g, g.sum(axis=0)
            order = np.argsort(own, kind="stable")
            sorted_own = own[order]
            new = np.flatnonzero(np.diff(sorted_own, prepend=-1))
            rows = sorted_own[new]
            g_emb = np.add.reduceat(np.repeat(g_h * (len(w) / n)[:, None], n, axis=0)[order], new)
            emb_sq[rows] += (g_emb**2).mean(axis=1)
            emb[rows] -= RATE * g_emb / np.sqrt(emb_sq[rows])[:, None]
            out_sq += g_out**2
            out -= RATE * g_out / np.sqrt(out_sq)
            bias_sq += g_bias**2
            bias -= RATE * g_bias / np.sqrt(bias_sq)
    s = scored()
    peak = s[highest(s)]
    fit_on = tuning if tuning.any() else ~tuning
    scale, shift = _calibrated(peak[fit_on], y[docs[fit_on]])
    table = (emb @ (out[:, 1] - out[:, 0])).astype(np.float32)
    base = float(1 / (1 + np.exp(-np.clip(scale * (bias[1] - bias[0]) + shift, -60, 60))))
    return Model(table, float(bias[1] - bias[0]), scale, shift, min(base, float(y.mean()), THRESHOLD / 2))


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """A logistic curve over peak scores; label 0 weighs ``CLEAN`` times label 1, slightly smoothed labels keep it finite."""
    mean, sd = x.mean(), x.std() + 1e-9
    u = (x - mean) / sd
    t = np.where(y == 1, 0.99, 0.005)
    w = np.where(y == 1, 1 / max(y.mean(), 1e-9), CLEAN / max(1 - y.mean(), 1e-9))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -60, 60)))
        g = np.array([(w * (p - t) * u).sum() + 1e-3 * a, (w * (p - t)).sum()])
        q = w * np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(q * u * u).sum() + 1e-3, (q * u).sum()], [(q * u).sum(), q.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
    return float(a / sd), float(b - a * mean / sd)


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[str | None], list[int]]:
    """The bounded sample: texts and labels, in the order of a hash of the id and the text.

    At most ``MAX_TRAIN_ROWS`` rows a label come to the driver, each with at most its label's share of ``MAX_TRAIN_CHARS``, whatever
    ids repeat; of these the first are fitted that have ``MAX_TRAIN_CHARS`` together."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    open_rows = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text")
    rows = open_rows.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce(F.length("text"), F.lit(0)).alias("n")).join(known, "doc_id").where(F.col("n") <= MAX_TRAIN_CHARS)
    order = F.struct(F.xxhash64("doc_id", "h", F.lit(SEED)).alias("key"), "doc_id", "h", "n")
    least = rows.groupBy("toxic", order.alias("x")).agg(F.count("*").alias("times"))
    picked: list[tuple] = []
    for label in (0, 1):
        some = least.where(F.col("toxic") == label).orderBy("x").limit(MAX_TRAIN_ROWS).collect()
        picked += [(*r["x"], label) for r in some]
    left, chosen = MAX_TRAIN_CHARS, []
    for key, i, h, n, label in sorted(picked):
        if n <= left:
            left -= n
            chosen.append((i, h, key, label))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("h", T.LongType()), T.StructField("key", T.LongType()), T.StructField("toxic", T.IntegerType())])
    table = F.broadcast(docs.sparkSession.createDataFrame(chosen, schema))
    found = open_rows.withColumn("h", F.xxhash64("text")).join(table, ["doc_id", "h"]).dropDuplicates(["doc_id", "h", "toxic"])
    got = sorted(((r["key"], r["doc_id"], r["toxic"], r["text"]) for r in found.collect()), key=lambda r: (r[0], r[1], r[2], r[3] or ""))
    return [r[3] for r in got], [r[2] for r in got]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(*training_rows(docs, labels))


def with_scores(docs: DataFrame, model: Model, keep_below: float | None = None) -> DataFrame:
    """``docs`` with a column ``score`` (one of that name is replaced); with ``keep_below``: only rows that score less, without it."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.drop("score") if keep_below is None else docs
    at = base.columns.index("text")
    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType())]) if keep_below is None else base.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in by_bytes(batches, at):
            s = m.scores(b.column(at).to_pylist())
            if keep_below is None:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=[*b.schema.names, "score"])
            else:
                yield b.filter(pa.array(s < keep_below))

    return base.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    scored = with_scores(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    return with_scores(docs, train(docs, labels), keep_below=THRESHOLD)
