"""Token ids in compressed blocks: an adaptive context-mixing range coder.

Ids are cut into blocks of at most ``BLOCK`` ids. A block starts from reset models, holds all that its decoding needs and
carries a checksum. Within a block three adaptive models predict the next id: order 0, a distribution over the
block's alphabet that follows the ids coded so far, and orders 1 and 2, each of which names the id that its context
was last followed by, with a confidence that rises with hits and falls with misses. Their probabilities are mixed: an id gets the
weighted sum of what the three give it. For each joint state of the confidences the weights follow the share that
each order had in the ids that came (one step of expectation maximization an id), so that on independent ids nearly all weight
goes to order 0.

A block is coded in lanes, contiguous stretches of it that step forward together as one numpy row and share the
models; a step's ids are learned after all its lanes are coded. That makes the loop in Python as long as a lane, and not as long as the
data. Up to ``TOGETHER`` blocks step forward in one row, each with its own models, side by side in the same arrays; a block's bytes are those
that it has alone. All of it is integer arithmetic, so that any machine decodes what another wrote.

Each lane is a carry-less range coder with 64-bit state and 16-bit output words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK, LANES, LEAST_LANE = 1 << 20, 2048, 64
#: Blocks that are coded or decoded in one loop; what they are does not depend on it.
TOGETHER = 4
MAGIC = b"CTLK\x04"
_U = np.uint64
_TOP, _BOT, _LOW = _U(1 << 48), _U(1 << 32), _U((1 << 32) - 1)
_16, _32, _48 = _U(16), _U(32), _U(48)
#: An order-0 distribution sums to 2**20 and the three weights to 2**12, so that a mixed one sums to 2**32.
_ORDER0_BITS, _WEIGHT_BITS, _CONTEXT2_BITS = 20, 12, 18
_MOST_LETTERS = 1 << 18
_GAIN, _LEAST_WEIGHT, _FORGET = 32, 16, 1 << 27
#: Weights learn from each of the first steps and then from every so manieth.
_EACH = 8
_STATES = 128


class Corrupt(ValueError):
    """A segment or a block that does not hold what its checksum says."""


class _Models:
    """The three models of some blocks, of ``letters`` different ids each, and their weights.

    A slot of a context holds the id last seen there and its confidence (1 to 4, 0 for an empty slot) in one integer. A state
    is both confidences and whether orders 1 and 2 name one id; if so, order 1 has the weight of both. Ids, contexts and states of
    a block are moved by what the blocks before it have, so that one array holds those of all; ``block`` is that of each lane."""

    def __init__(self, letters: list[int], block: np.ndarray) -> None:
        self.letters = letters
        self.base = np.cumsum([0, *(n + 2 for n in letters)])  # two more: the id of empty slots, and the end of the last one's place
        empty = self.base[:-1] + letters
        blocks = len(letters)
        self.slot1 = np.repeat(empty << 3, np.diff(self.base))
        self.slot2 = np.repeat(empty << 3, 1 << _CONTEXT2_BITS)
        self.prev, self.prev2 = self.base[block], self.base[block]
        self.hashed = self.prev * (2654435761 + 2246822519)
        self.context2, self.first_state, self.above = block << _CONTEXT2_BITS, block * _STATES, block << (_ORDER0_BITS + 1)
        self.share = np.full((3, blocks * _STATES), 1 << 13, np.int64)
        state = np.arange(blocks * _STATES) % _STATES
        self.share[0, (state >> 4 == 0) | (state & 1 == 1)] = 0
        self.share[1, (state >> 1) & 7 == 0] = 0
        self.count = np.ones(self.base[-1], np.int64)
        self.cum, self.ladder = np.zeros(self.base[-1], np.int64), np.zeros(self.base[-1], np.int64)
        self.waiting: list[np.ndarray] = []
        self.block, self.step = block, 0
        self.seen, self.due = np.zeros(blocks, np.int64), np.zeros(blocks, np.int64)
        self.active, self.of = 0, np.zeros(blocks, np.int64)
        for b in range(blocks):
            self._distribute(b)
        self._weigh()

    def _distribute(self, b: int) -> None:
        whole, a, n = 1 << _ORDER0_BITS, self.base[b], self.letters[b]
        count = self.count[a : a + n]
        freq = 1 + count * (whole - n) // int(count.sum())
        freq[int(count.argmax())] += whole - int(freq.sum())
        np.cumsum(freq, out=self.cum[a + 1 : a + n + 1])
        self.cum[a + n + 1] = whole  # for the id of empty slots
        self.ladder[a : a + n + 2] = self.cum[a : a + n + 2] + (b << (_ORDER0_BITS + 1))

    def _weigh(self) -> None:
        whole = 1 << _WEIGHT_BITS
        a = np.minimum((self.share[:2] * whole) // self.share.sum(axis=0), (whole - _LEAST_WEIGHT) // 2)
        self.weight0 = whole - a[0] - a[1]
        self.point2, self.point1 = a << _ORDER0_BITS

    def _credit(self) -> None:
        """Each order gets of an id that came what it gave to its probability."""
        some = np.flatnonzero(self.hit1 | self.hit2)
        state, width = self.state[some], self.width[some]
        total = np.bincount(self.state, minlength=self.share.shape[1]) << 10
        for k, (hit, m) in enumerate(((self.hit2, self.m2), (self.hit1, self.m1))):
            got = np.bincount(state, weights=((hit[some] * m[some]) << 10) // width, minlength=self.share.shape[1]).astype(np.int64)
            self.share[k] += got
            total -= got
        self.share[2] += total
        old = self.share.sum(axis=0) > _FORGET
        if old.any():
            self.share[:, old] >>= 1
        self._weigh()

    def predict(self, n: int) -> None:
        """For the first ``n`` lanes: the ids of orders 2 and 1 with their shares of 2**32, and order 0's weight."""
        self.i1 = self.prev[:n]
        self.i2 = (((self.i1 * 2654435761 + self.prev2[:n] * 2246822519 - self.hashed[:n]) >> 7) & ((1 << _CONTEXT2_BITS) - 1)) + self.context2[:n]
        self.v1, self.v2 = self.slot1.take(self.i1), self.slot2.take(self.i2)
        self.p1, self.p2 = self.v1 >> 3, self.v2 >> 3
        self.sure1, self.sure2 = self.v1 & 7, self.v2 & 7
        self.state = (self.sure2 << 4) + (self.sure1 << 1) + (self.p1 == self.p2) + self.first_state[:n]
        self.a0, self.m1, self.m2 = self.weight0.take(self.state), self.point1.take(self.state), self.point2.take(self.state)

    def place(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids ``s`` begin in the mixed distribution, and how wide they are."""
        at = self.cum.take(s)
        self.hit1, self.hit2 = self.p1 == s, self.p2 == s
        start = self.a0 * at + self.m2 * (self.p2 < s) + self.m1 * (self.p1 < s)
        self.width = self.a0 * (self.cum.take(s + 1) - at) + self.m2 * self.hit2 + self.m1 * self.hit1
        return start, self.width

    def find(self, v: np.ndarray) -> np.ndarray:
        """The ids whose places in the mixed distribution hold ``v``. Of a named id's place the part that its order gives comes
        first; without such parts what is left is the place in order 0."""
        r1 = v - self.a0 * self.cum.take(self.p1) - self.m2 * (self.p2 < self.p1)
        r2 = v - self.a0 * self.cum.take(self.p2) - self.m1 * (self.p1 < self.p2)
        past1, past2 = r1 >= 0, r2 >= 0
        in1, in2 = past1 & (r1 < self.m1), past2 & (r2 < self.m2)
        s = np.where(in1, self.p1, self.p2)
        rest = np.flatnonzero(~(in1 | in2))
        u = (v - self.m1 * past1 - self.m2 * past2)[rest]
        s[rest] = self.ladder.searchsorted(u // self.a0[rest] + self.above[rest], "right") - 1
        return s

    def learn(self, n: int, s: np.ndarray) -> None:
        fresh = (s << 3) + 1
        for slot, i, v, sure, hit in ((self.slot1, self.i1, self.v1, self.sure1, self.hit1), (self.slot2, self.i2, self.v2, self.sure2, self.hit2)):
            now = np.where(sure < 2, fresh, v - 1)
            np.copyto(now, v + (sure < 4), where=hit)
            slot[i] = now
        if self.step < _EACH or self.step % _EACH == 0:
            self._credit()
        self.step += 1
        self.prev2[:n] = self.prev[:n]
        self.prev[:n] = s
        self.prev[:n] += 1
        self.waiting.append(s)
        if n != self.active:
            self.active, self.of = n, np.bincount(self.block[:n], minlength=len(self.letters))
        self.seen += self.of
        now = self.seen >= self.due
        if now.any():
            self.count += _GAIN * np.bincount(np.concatenate(self.waiting), minlength=len(self.count))
            self.waiting = []
            for b in np.flatnonzero(now).tolist():
                self._distribute(b)
            self.due[now] = self.seen[now] + (self.seen[now] >> 3)


def _unsettled(low: np.ndarray, rng: np.ndarray) -> np.ndarray:
    """The lanes whose top word is settled or whose range has become too small; the latter's ranges are cut to fit."""
    need = (low ^ (low + rng)) < _TOP
    tight = rng < _BOT
    if tight.any():
        cut = np.flatnonzero(tight & ~need)
        rng[cut] = (~low[cut] + _U(1)) & _LOW
        need |= tight
    return np.flatnonzero(need)


def _shape(n: int) -> tuple[int, int, int]:
    """(lanes, steps, ids of the last lane) for a block of ``n`` ids."""
    steps = -(-n // max(1, min(LANES, n // LEAST_LANE)))
    lanes = -(-n // steps)
    return lanes, steps, n - steps * (lanes - 1)


def _side_by_side(counts: list[int]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """The lanes of blocks of ``counts`` ids in one row, the longer ones first, so that those that go on are always the first ones: each
    lane's ids and block, and each block's (lanes, steps, place of its lanes in the row)."""
    shapes = [_shape(n) for n in counts]
    length = np.concatenate([np.append(np.full(lanes - 1, steps), last) for lanes, steps, last in shapes])
    block = np.repeat(np.arange(len(counts)), [x[0] for x in shapes])
    order = np.argsort(-length, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    first = np.cumsum([0, *(x[0] for x in shapes)])
    return length[order], block[order], [(x[0], x[1], place[a : a + x[0]]) for x, a in zip(shapes, first.tolist(), strict=False)]


def _going(length: np.ndarray) -> list[int]:
    """How many lanes go on at each step."""
    return (len(length) - np.searchsorted(length[::-1], np.arange(int(length[0])), "right")).tolist()


def _encode_lanes(dense: list[np.ndarray], letters: list[int]) -> list[list[bytes]]:
    length, block, places = _side_by_side([len(x) for x in dense])
    models = _Models(letters, block)
    sym = np.zeros((int(length[0]), len(length)), np.int64)
    for b, (lanes, steps, place) in enumerate(places):
        own = np.zeros(lanes * steps, np.int64)
        own[: len(dense[b])] = dense[b] + models.base[b]
        sym[:steps, place] = own.reshape(lanes, steps).T
    low, rng = np.zeros(len(length), np.uint64), np.full(len(length), 2**64 - 1, np.uint64)
    width = 3 * len(sym) + 8
    out, at = np.zeros(len(length) * width, np.uint16), np.arange(len(length), dtype=np.int64) * width
    for t, n in enumerate(_going(length)):
        s = sym[t, :n]
        models.predict(n)
        start, size = models.place(s)
        lo, r = low[:n], rng[:n]
        r >>= _32
        lo += r * start.astype(np.uint64)
        r *= size.astype(np.uint64)
        some = _unsettled(lo, r)
        while len(some):
            l2, r2 = lo[some], r[some]
            place = at[some]
            out[place] = (l2 >> _48).astype(np.uint16)
            at[some] = place + 1
            l2 <<= _16
            r2 <<= _16
            more = _unsettled(l2, r2)
            lo[some], r[some] = l2, r2
            some = some[more]
        models.learn(n, s)
    # The end: the least number of the range whose lower half is zero, so that two words do.
    low += _LOW
    for k in range(2):
        out[at + k] = (low >> _48).astype(np.uint16)
        low <<= _16
    return [[out[i * width : end + 2].astype("<u2").tobytes() for i, end in zip(place.tolist(), at[place].tolist(), strict=True)] for _, _, place in places]


def _decode_lanes(words: list[np.ndarray], sizes: list[np.ndarray], counts: list[int], letters: list[int]) -> list[np.ndarray]:
    length, block, places = _side_by_side(counts)
    at, end = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    before = 0
    for w, size, (_, _, place) in zip(words, sizes, places, strict=True):
        ends = before + np.cumsum(size.astype(np.int64))
        at[place], end[place] = ends - size, ends
        before += len(w)
    data = np.concatenate([*words, np.zeros(1, np.uint16)])
    zero = before
    models = _Models(letters, block)
    low, rng, code = np.zeros(len(length), np.uint64), np.full(len(length), 2**64 - 1, np.uint64), np.zeros(len(length), np.uint64)
    for _ in range(4):
        code = (code << _16) | data[np.where(at < end, at, zero)]
        at += 1
    out = np.zeros((int(length[0]), len(length)), np.uint32)
    for t, n in enumerate(_going(length)):
        models.predict(n)
        lo, r, co = low[:n], rng[:n], code[:n]
        r >>= _32
        v = np.minimum((co - lo) // np.maximum(r, _U(1)), _LOW).astype(np.int64)
        s = models.find(v)
        start, width = models.place(s)
        lo += r * start.astype(np.uint64)
        r *= width.astype(np.uint64)
        some = _unsettled(lo, r)
        while len(some):
            l2, r2 = lo[some], r[some]
            place = at[some]
            co[some] = (co[some] << _16) | data[np.where(place < end[some], place, zero)]
            at[some] = place + 1
            l2 <<= _16
            r2 <<= _16
            more = _unsettled(l2, r2)
            lo[some], r[some] = l2, r2
            some = some[more]
        out[t, :n] = s
        models.learn(n, s)
    return [out[:steps, place].T.reshape(-1)[:n].astype(np.int64) - models.base[b] for b, ((_, steps, place), n) in enumerate(zip(places, counts, strict=True))]


def _dense(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids in ascending order, and each id's place among them."""
    if int(ids.max()) >= 1 << 22:
        return np.unique(ids, return_inverse=True)
    there = np.zeros(int(ids.max()) + 1, bool)  # counting is faster than sorting
    there[ids] = True
    return np.flatnonzero(there).astype(np.uint32), (np.cumsum(there) - 1)[ids]


def _pieces(ids: np.ndarray) -> list[np.ndarray]:
    """The stretches of ``ids`` that become blocks; one with more different ids than a model takes is halved."""
    if not len(ids):
        return []
    if len(ids) > BLOCK:
        return [x for a in range(0, len(ids), BLOCK) for x in _pieces(ids[a : a + BLOCK])]
    if len(_dense(ids)[0]) > _MOST_LETTERS:
        return [*_pieces(ids[: len(ids) // 2]), *_pieces(ids[len(ids) // 2 :])]
    return [ids]


def _encode(pieces: list[np.ndarray]) -> list[bytes]:
    out = []
    for a in range(0, len(pieces), TOGETHER):
        some = pieces[a : a + TOGETHER]
        alphabets, dense = zip(*map(_dense, some), strict=True)
        for ids, alphabet, lanes in zip(some, alphabets, _encode_lanes(dense, [len(x) for x in alphabets]), strict=True):
            gaps = np.diff(alphabet, prepend=np.uint32(0)).astype("<u4").tobytes()
            tables = zlib.compress(gaps + np.array([len(x) // 2 for x in lanes], "<u4").tobytes(), 6)
            out.append(struct.pack("<IIII", len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(alphabet), len(tables)) + tables + b"".join(lanes))
    return out


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """``ids`` as blocks."""
    return _encode(_pieces(ids))


def decode_blocks(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; raises ``Corrupt`` if those of one fail its checksum."""
    return [ids for a in range(0, len(blocks), TOGETHER) for ids in _decode(blocks[a : a + TOGETHER])]


def _decode(blocks: list[bytes]) -> list[np.ndarray]:
    try:
        counts, crcs, letters, alphabets, words, sizes = [], [], [], [], [], []
        for data in blocks:
            n, crc, k, packed = struct.unpack_from("<IIII", data)
            table = np.frombuffer(zlib.decompress(data[16 : 16 + packed]), "<u4")
            alphabet = np.cumsum(table[:k], dtype=np.uint32)
            w = np.frombuffer(data, "<u2", offset=16 + packed)
            size = table[k:]
            if int(size.sum()) != len(w) or len(alphabet) != k or len(size) != _shape(n)[0]:
                raise Corrupt("a block is cut short")
            for x, y in ((counts, n), (crcs, crc), (letters, k), (alphabets, alphabet), (words, w), (sizes, size)):
                x.append(y)
        places = _decode_lanes(words, sizes, counts, letters)
        out = [alphabet[np.clip(x, 0, k - 1)] for alphabet, x, k in zip(alphabets, places, letters, strict=True)]
    except (struct.error, zlib.error, ValueError, IndexError, ZeroDivisionError) as e:
        raise Corrupt(f"a block can't be read: {e}") from e
    for ids, crc in zip(out, crcs, strict=True):
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise Corrupt("a block's checksum is wrong")
    return out


def decode_block(data: bytes) -> np.ndarray:
    """The ids of a block; raises ``Corrupt`` if they fail its checksum."""
    return decode_blocks([data])[0]


def encode_segments(segments: list[tuple[np.ndarray, np.ndarray]]) -> list[bytes]:
    """The bytes of each segment, given the ids of its documents one after another and how many each document has."""
    pieces = [_pieces(np.ascontiguousarray(ids, np.uint32)) for ids, _ in segments]
    coded = iter(_encode([x for p in pieces for x in p]))
    out = []
    for (ids, doc_sizes), own in zip(segments, pieces, strict=True):
        blocks = [next(coded) for _ in own]
        tables = zlib.compress(np.asarray(doc_sizes).astype("<u4").tobytes() + np.array([len(b) for b in blocks], "<u4").tobytes(), 6)
        head = struct.pack("<QIII", len(ids), len(doc_sizes), len(blocks), len(tables)) + tables
        out.append(MAGIC + struct.pack("<I", zlib.crc32(head)) + head + b"".join(blocks))
    return out


def encode_segment(ids: np.ndarray, doc_sizes: np.ndarray) -> bytes:
    return encode_segments([(ids, doc_sizes)])[0]


def _parts(data: bytes) -> tuple[int, np.ndarray, list[bytes]]:
    """(ids, document sizes, blocks) of a segment; raises ``Corrupt`` if the head fails its checksum."""
    if data[:5] != MAGIC or len(data) < 29:
        raise Corrupt("not a segment")
    (crc,) = struct.unpack_from("<I", data, 5)
    n, docs, blocks, packed = struct.unpack_from("<QIII", data, 9)
    end = 29 + packed
    if zlib.crc32(data[9:end]) != crc:
        raise Corrupt("the head's checksum is wrong")
    table = np.frombuffer(zlib.decompress(data[29:end]), "<u4")
    edges = end + np.cumsum(table[docs:], dtype=np.int64)
    if len(table) != docs + blocks or len(data) != (int(edges[-1]) if blocks else end):
        raise Corrupt("the segment is cut short")
    return n, table[:docs], [data[b - int(k) : b] for b, k in zip(edges.tolist(), table[docs:], strict=True)]


def decode_segments(segments: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The ids and document sizes of each segment; raises ``Corrupt`` if a head or a block fails its checksum."""
    parts = [_parts(data) for data in segments]
    decoded = iter(decode_blocks([b for _, _, blocks in parts for b in blocks]))
    out = []
    for n, sizes, blocks in parts:
        found = [next(decoded) for _ in blocks]
        ids = np.concatenate(found) if found else np.empty(0, np.uint32)
        if len(ids) != n:
            raise Corrupt("the blocks hold another number of ids")
        out.append((ids, sizes))
    return out


def decode_segment(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return decode_segments([data])[0]
