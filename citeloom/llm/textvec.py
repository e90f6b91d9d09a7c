"""Whole texts as arrays: word hashes, shingles and character n-grams for many texts at once.

A word is a maximal run of letters, digits and underscores (``str.isalnum`` or ``_``) of the lower-cased text.
All of it is numpy over code points; the loops in Python are over texts, never over words or characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np

#: Code points that are worked on at a time; a longer text is cut between words.
GROUP = 500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_BASE_INV = pow(_BASE, -1, 1 << 64)
_NOT_WORD = re.compile(r"\W")


@cache
def word_table() -> np.ndarray:
    """For every code point, whether it belongs to a word."""
    return np.fromiter((chr(c).isalnum() or c == 95 for c in range(0x110000)), dtype=bool, count=0x110000)


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    kept = GROUP + 65536
    if n > kept:
        return _power_table(n)
    if not _powers:
        _powers[:] = _power_table(kept)
    return _powers[0][:n], _powers[1][:n]


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    tables = []
    for b in (_BASE, _BASE_INV):
        x = np.full(n, b, dtype=np.uint64)
        x[0] = 1
        tables.append(np.multiply.accumulate(x))
    return tables[0], tables[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of about GROUP characters, cut between words."""
    at = 0
    while len(text) - at > GROUP:
        found = _NOT_WORD.search(text, at + GROUP)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def groups(texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Lower-cased texts, some together up to GROUP characters: the indices of the texts and their pieces.

    A text longer than GROUP comes in several pieces, each in a group of its own."""
    held: list[str] = []
    index: list[int] = []
    n = 0
    for i, t in enumerate(texts):
        t = (t or "").lower()
        if len(t) > GROUP:
            if held:
                yield np.array(index), held
                held, index, n = [], [], 0
            for p in _pieces(t):
                yield np.array([i]), [p]
            continue
        if n + len(t) > GROUP:
            yield np.array(index), held
            held, index, n = [], [], 0
        held.append(t)
        index.append(i)
        n += len(t) + 1
    if held:
        yield np.array(index), held


def _word_hashes(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the pieces, and how many words each piece has."""
    cp = code_points(" ".join(pieces))
    if not len(cp):
        return np.empty(0, np.uint64), np.zeros(len(pieces), np.int64)
    inside = word_table()[cp]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = powers(len(cp) + 1)
    total = np.empty(len(cp) + 1, np.uint64)
    total[0] = 0
    np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * power[: len(cp)], out=total[1:])
    h = mix((total[end] - total[start]) * inverse[start] * _ODD)
    stops = np.cumsum([len(p) + 1 for p in pieces])
    return h, np.diff(np.searchsorted(start, stops), prepend=0)


def words(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the words of all texts, one after another, and where each text's begin (and the last's end)."""
    found: list[np.ndarray] = []
    count = np.zeros(len(texts), np.int64)
    for index, pieces in groups(texts):
        h, n = _word_hashes(pieces)
        found.append(h)
        np.add.at(count, index, n)
    return (np.concatenate(found) if found else np.empty(0, np.uint64)), np.concatenate([[0], np.cumsum(count)])


_STEP = [np.uint64(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64)) for k in range(64)]


def shingle_hashes(w: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words; the words must be of one text, or runs over a border be ignored later."""
    n = len(w) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h += w[k : k + n] * _STEP[k]
    return mix(h)


def shingle_sets(w: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``size`` words.

    A text of fewer words, but at least one, has its whole word sequence as its only member."""
    every = shingle_hashes(w, size)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            sets.append(np.unique(every[a : b - size + 1]))
        elif b > a:
            short = w[a:b] * np.array(_STEP[: b - a], np.uint64)
            sets.append(mix(np.array([short.sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def ngrams(pieces: list[str], sizes: Sequence[int], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed character n-grams of all words of the pieces, with a mark at either end of a word.

    Returns, for each n-gram (by size, then by place): its bucket, its word (counted over all pieces);
    then the number of words of each piece, and for each word its number of n-grams."""
    cp = code_points(" " + " ".join(pieces) + " ")
    inside = word_table()[cp]
    start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    n_words = np.diff(np.searchsorted(start, 1 + np.cumsum([len(p) + 1 for p in pieces])), prepend=0)
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.int64), n_words, np.empty(0, np.int64)
    power, inverse = powers(len(cp) + 1)
    total = np.empty(len(cp) + 1, np.uint64)
    total[0] = 0
    np.cumsum((np.where(inside, cp, 32).astype(np.uint64) + np.uint64(1)) * power[: len(cp)], out=total[1:])
    outside = np.concatenate([[0], np.cumsum(~inside, dtype=np.int32)])
    word_at = np.zeros(len(cp), np.int32)  # of a mark: the word that begins after it
    word_at[start] = 1
    word_at = np.cumsum(word_at, dtype=np.int32) - 1
    word_at[:-1] += (~inside[:-1]) & inside[1:]
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    ids, places = [], []
    for n in sizes:
        m = len(cp) - n + 1
        if m <= 0:
            continue
        whole = outside[n - 1 : n - 1 + m] == outside[1 : 1 + m]  # nothing but letters between the first and the last
        whole &= inside[:m] | inside[1 : 1 + m]
        i = np.flatnonzero(whole & (inside[:m] | inside[n - 1 : n - 1 + m]))
        h = (total[i + n] - total[i]) * inverse[i] * _ODD
        h ^= h >> np.uint64(29)
        ids.append(((h * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)) >> shift).astype(np.int64))
        places.append(i)
    word = word_at[np.concatenate(places)].astype(np.int64)
    return np.concatenate(ids), word, n_words, np.bincount(word, minlength=len(start))
