"""An adaptive range coder for token ids: predictions of orders 0 to 2 are mixed and drive arithmetic coding, in blocks that start afresh.

A block of ids has a dictionary of its distinct ids; ids are coded by their place in it. Order 2 and order 1 each remember, for the last two ids and for the last
one, the id that followed last and how often it did so in a row; order 0 counts the block's ids. A coding step has three outcomes: the id that order 2 expects, the one that
order 1 expects if it is another, or neither. The three orders' shares of these outcomes are mixed with weights that follow Bayes' rule
after every id (each keeps a small share), and the mixture is the interval that is coded. An id that was expected by neither is then coded by
the counts of order 0.

Blocks share nothing, so many are coded in step: each numpy operation serves one position of all blocks ("lanes"). Only +, -, *, / and comparisons
of doubles and integers are used, which give the same bits on every machine. Memory is bounded by lanes x block, whatever the number of ids.

Block format, little endian: ids u32, distinct ids u32, 16-bit words u32, CRC-32 of the ids as u32 u32, the dictionary as LEB128 varints of differences, the words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids of a block, blocks coded in step.
BLOCK, LANES = 4096, 2048
HEAD = struct.Struct("<IIII")
#: Shares of the range are in 1/2**16; a range stays in [2**32, 2**48] and loses a word of 16 bits at a time.
_BITS, _LEAST, _TOP = 16, 1 << 32, 1 << 48
_SHARE = 65000.0
#: Confidences 0 (nothing seen) to 7, how fast their hit rates move, and the share of weight that an order always keeps.
_SURE, _RATE, _KEPT = 8, 1 / 24, 0.01
_REFRESH = 256


class Mixer:
    """The models of n lanes at one position; `sizes`: entries of the lanes' dictionaries."""

    def __init__(self, sizes: np.ndarray, block: int) -> None:
        n, self.width, self.slots = len(sizes), int(sizes.max()), 2 << max(block - 1, 1).bit_length()
        self.sizes = sizes
        lane = np.arange(n, dtype=np.int64)
        self.at0, self.at1, self.at2, self.atq = lane * (self.width + 1), lane * self.width, lane * self.slots, lane * _SURE
        # An entry is 8 times the id expected plus the confidence.
        self.next1, self.next2 = np.zeros(n * self.width, np.int32), np.zeros(n * self.slots, np.int32)
        rates = (np.arange(_SURE) + 0.25) / (_SURE + 1)
        self.rate1, self.rate2 = np.tile(rates, n), np.tile(rates, n)
        self.w0, self.w1, self.w2 = np.full(n, 0.2), np.full(n, 0.4), np.full(n, 0.4)
        self.last, self.before = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.seen = np.zeros((n, self.width), np.int32)
        self.flat_seen = self.seen.ravel()
        self.cum, self.p0 = np.zeros((n, self.width + 1), np.int32), np.zeros((n, self.width))
        self.keys = np.zeros(0, np.int64)
        self.t = 0

    def _refresh(self) -> None:
        """Order 0 takes the counts so far: every id of the dictionary has a share of at least one, and all together at most 2**16."""
        for lo in range(0, len(self.sizes), 256):
            rows = slice(lo, lo + 256)
            inside = np.arange(self.width) < self.sizes[rows, None]
            room = ((1 << _BITS) - self.sizes[rows, None]) // max(self.t, 1)  # a share of each id seen
            shares = np.where(inside, 1 + self.seen[rows] * room, 0)
            np.cumsum(shares, axis=1, out=self.cum[rows, 1:])
            self.p0[rows] = shares / self.cum[rows, -1:]
        self.flat_cum, self.flat_p0, self.total = self.cum.ravel(), self.p0.ravel(), self.cum[:, -1].astype(np.int64)
        self.keys = (self.cum.astype(np.int64) + (np.arange(len(self.sizes)) << (_BITS + 1))[:, None]).ravel()

    def predict(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The shares of the first n lanes' first two outcomes, in 1/2**16."""
        if self.t % _REFRESH == 0 or (self.t >= 16 and self.t & (self.t - 1) == 0):
            self._refresh()
        last, before = self.last[:n], self.before[:n]
        self.i1 = self.at1[:n] + last
        self.i2 = self.at2[:n] + ((before * 40503 + last * 30011 + (before >> 3)) & (self.slots - 1))
        self.e1, self.e2 = self.next1[self.i1], self.next2[self.i2]
        self.c1, self.c2, self.s1, self.s2 = self.e1 >> 3, self.e2 >> 3, self.e1 & 7, self.e2 & 7
        self.j1, self.j2 = self.atq[:n] + self.s1, self.atq[:n] + self.s2
        self.q1, self.q2 = self.rate1[self.j1], self.rate2[self.j2]
        self.other = self.c1 != self.c2
        self.b1 = self.q1 * self.other
        self.a1 = self.q1 - self.b1
        self.a0 = self.flat_p0[self.at1[:n] + self.c2]
        self.b0 = self.flat_p0[self.at1[:n] + self.c1] * self.other
        first = self.w2[:n] * self.q2 + self.w1[:n] * self.a1 + self.w0[:n] * self.a0
        second = self.w1[:n] * self.b1 + self.w0[:n] * self.b0
        return (first * _SHARE).astype(np.int64) + 32, (second * _SHARE).astype(np.int64) + self.other * 32

    def update(self, n: int, x: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        """The ids that came, and whether they were the first or the second outcome."""
        hit1 = second | (first & ~self.other)
        neither = ~(first | second)
        v0 = self.w0[:n] * (first * self.a0 + second * self.b0 + neither * (1.0 - self.a0 - self.b0) + _KEPT)
        v1 = self.w1[:n] * (first * self.a1 + second * self.b1 + neither * (1.0 - self.q1) + _KEPT)
        v2 = self.w2[:n] * (first * self.q2 + neither * (1.0 - self.q2) + _KEPT)
        scale = (1 - 3 * _KEPT) / (v0 + v1 + v2)
        self.w0[:n], self.w1[:n], self.w2[:n] = v0 * scale + _KEPT, v1 * scale + _KEPT, v2 * scale + _KEPT
        self.rate1[self.j1] = self.q1 + (hit1 - self.q1) * _RATE
        self.rate2[self.j2] = self.q2 + (first - self.q2) * _RATE
        new = x * 8 + 1
        self.next1[self.i1] = np.where(hit1, self.e1 + (self.s1 < 7), np.where(self.s1 < 2, new, self.e1 - ((self.s1 + 1) >> 1)))
        self.next2[self.i2] = np.where(first, self.e2 + (self.s2 < 7), np.where(self.s2 < 2, new, self.e2 - ((self.s2 + 1) >> 1)))
        self.flat_seen[self.at1[:n] + x] += 1
        self.before[:n] = self.last[:n]
        self.last[:n] = x
        self.t += 1


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LEB128 bytes of all values, and the number of bytes of each."""
    parts = values[:, None] >> (7 * np.arange(5, dtype=np.uint64))
    count = np.maximum((parts > 0).sum(1), 1)
    more = np.arange(5) < (count - 1)[:, None]
    data = (parts & np.uint64(127)).astype(np.uint8) | (more.astype(np.uint8) << 7)
    return data[np.arange(5) < count[:, None]], count


def _unvarints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of LEB128 bytes, and the index after each."""
    ends = np.flatnonzero(data < 128) + 1
    if not len(ends):
        return np.zeros(0, np.int64), ends
    starts = np.concatenate([[0], ends[:-1]])
    shift = (np.arange(ends[-1]) - np.repeat(starts, ends - starts)) * 7
    return np.add.reduceat((data[: ends[-1]] & 127).astype(np.int64) << shift, starts), ends


def _coded(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct ids of a block, and each id's place among them."""
    top = int(ids.max()) + 1
    if top > 1 << 18:
        return np.unique(ids, return_inverse=True)
    there = np.zeros(top, bool)
    there[ids] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[ids]


def encode(ids: np.ndarray, block: int = BLOCK, lanes: int = LANES) -> list[bytes]:
    """ids (u32) as blocks of `block` ids; the last may be shorter. No ids: no blocks."""
    if not 0 < block <= 1 << _BITS:
        raise ValueError("a block has 1 to 65536 ids")
    out = []
    for lo in range(0, len(ids), block * lanes):
        out += _encode_lanes(np.ascontiguousarray(ids[lo : lo + block * lanes], "<u4"), block)
    return out


def _encode_lanes(ids: np.ndarray, block: int) -> list[bytes]:
    parts = [ids[i : i + block] for i in range(0, len(ids), block)]
    n_all, full = len(parts), len(parts[0])
    sizes, codes = np.zeros(n_all, np.int64), np.zeros((full, n_all), np.int64)
    books = []
    for k, part in enumerate(parts):
        book, code = _coded(part)
        codes[: len(part), k], sizes[k] = code, len(book)
        books.append(np.diff(book, prepend=0).astype(np.uint64))
    mixer = Mixer(sizes, block)
    low, width = np.zeros(n_all, np.int64), np.full(n_all, _TOP, np.int64)
    words, at = np.zeros((n_all, 2 * full + 4), np.uint16), np.zeros(n_all, np.int64)

    def carry(lane: np.ndarray) -> None:
        """Adds one to the words that precede; seldom, and seldom more than one word back."""
        low[lane] -= _TOP
        back = at[lane] - 1
        while len(lane):
            words[lane, back] += np.uint16(1)
            on = words[lane, back] == 0
            lane, back = lane[on], back[on] - 1

    def shrink(lane: np.ndarray) -> None:
        own = low[lane]
        words[lane, at[lane]] = own >> 32
        low[lane], width[lane] = (own & (_LEAST - 1)) << 16, width[lane] << 16
        at[lane] += 1

    every = np.arange(n_all)
    short = len(parts[-1])
    for t in range(full):
        n = n_all if t < short else n_all - 1
        x = codes[t, :n]
        share1, share2 = mixer.predict(n)
        first = x == mixer.c2
        second = (x == mixer.c1) & ~first
        unit = width[:n] >> _BITS
        begin = np.where(first, 0, np.where(second, share1, share1 + share2))
        low[:n] += begin * unit
        width[:n] = np.where(first, share1, np.where(second, share2, (1 << _BITS) - share1 - share2)) * unit
        over = np.flatnonzero(low[:n] >= _TOP)
        if len(over):
            carry(over)
        shrink(np.flatnonzero(width[:n] < _LEAST))
        lane = np.flatnonzero(~(first | second))
        if len(lane):
            own = mixer.at0[lane] + x[lane]
            begin, end, total = mixer.flat_cum[own].astype(np.int64), mixer.flat_cum[own + 1].astype(np.int64), mixer.total[lane]
            unit = width[lane] // total
            moved, left = low[lane] + begin * unit, (end - begin) * unit
            low[lane], width[lane] = moved, left
            over = lane[moved >= _TOP]
            if len(over):
                carry(over)
            shrink(lane[left < _LEAST])
        mixer.update(n, x, first, second)
    for k in (32, 16, 0):
        words[every, at] = (low >> k) & 0xFFFF
        at += 1
    data, count = _varints(np.concatenate(books))
    ends = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(sizes)])]
    return [
        HEAD.pack(len(part), int(sizes[k]), int(at[k]), zlib.crc32(part)) + data[ends[k] : ends[k + 1]].tobytes() + words[k, : at[k]].astype("<u2").tobytes()
        for k, part in enumerate(parts)
    ]


def decode(blocks: list[bytes], block: int = BLOCK, lanes: int = LANES) -> np.ndarray:
    """The ids (u32) of blocks end to end; ValueError if a block is damaged. Any selection of blocks can be decoded."""
    parts = []
    for lo in range(0, len(blocks), lanes):
        parts += _decode_lanes(blocks[lo : lo + lanes], block)
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")


def _decode_lanes(blocks: list[bytes], block: int) -> list[np.ndarray]:
    heads, books, bodies = [], [], []
    for raw in blocks:
        if len(raw) < HEAD.size:
            raise ValueError("a block is cut short")
        n, distinct, count, _ = head = HEAD.unpack_from(raw)
        body = len(raw) - 2 * count
        values, _ = _unvarints(np.frombuffer(raw, np.uint8)[HEAD.size : max(body, HEAD.size)])
        if not 0 < n <= block or body < HEAD.size or not 0 < distinct == len(values) or count < 3:
            raise ValueError("a block's header is damaged")
        heads.append(head)
        books.append(np.cumsum(values))
        bodies.append(np.frombuffer(raw, "<u2", count, body))
    order = np.argsort([-h[0] for h in heads], kind="stable")  # lanes that end sooner come last
    length = np.array([heads[k][0] for k in order])
    sizes = np.array([len(books[k]) for k in order], np.int64)
    n_all, full = len(order), int(length[0])
    mixer = Mixer(sizes, block)
    starts = np.cumsum([0, *[len(bodies[k]) + 2 for k in order]])[:-1].astype(np.int64)
    words = np.zeros(int(starts[-1]) + len(bodies[order[-1]]) + 2, np.int64)
    for s, k in zip(starts, order, strict=True):
        words[s : s + len(bodies[k])] = bodies[k]
    ends, at = starts + np.array([len(bodies[k]) for k in order]) + 1, starts + 3
    ahead = words[starts] << 32 | words[starts + 1] << 16 | words[starts + 2]  # how far the code lies above the range's start
    width = np.full(n_all, _TOP, np.int64)
    codes = np.zeros((full, n_all), np.int64)

    def grow(lane: np.ndarray) -> None:
        ahead[lane] = ahead[lane] << 16 | words[at[lane]]
        width[lane] <<= 16
        at[lane] = np.minimum(at[lane] + 1, ends[lane])  # a damaged block runs out of words

    for t in range(full):
        n = int(np.searchsorted(-length, -t, "left"))
        share1, share2 = mixer.predict(n)
        unit = width[:n] >> _BITS
        own = ahead[:n]
        edge1, edge2 = share1 * unit, (share1 + share2) * unit
        first = own < edge1
        second = (own < edge2) & ~first
        x = np.where(first, mixer.c2, mixer.c1).astype(np.int64)
        ahead[:n] = own - np.where(first, 0, np.where(second, edge1, edge2))
        width[:n] = np.where(first, edge1, np.where(second, edge2 - edge1, ((1 << _BITS) * unit) - edge2))
        grow(np.flatnonzero(width[:n] < _LEAST))
        lane = np.flatnonzero(~(first | second))
        if len(lane):
            total, own, base = mixer.total[lane], ahead[lane], mixer.at0[lane]
            unit = np.maximum(width[lane] // total, 1)
            place = np.minimum(own // unit, total - 1)
            found = np.searchsorted(mixer.keys, (lane << (_BITS + 1)) + place, "right") - 1
            code = np.minimum(found - base, sizes[lane] - 1)
            begin = mixer.flat_cum[found].astype(np.int64)
            left = (mixer.flat_cum[found + 1] - begin) * unit
            ahead[lane], width[lane], x[lane] = np.minimum(own - begin * unit, _TOP), left, code
            grow(lane[left < _LEAST])
        codes[t, :n] = x
        mixer.update(n, x, first, second)
    out: list[np.ndarray] = [np.zeros(0, "<u4")] * n_all
    for lane, k in enumerate(order):
        ids = books[k][np.minimum(codes[: length[lane], lane], len(books[k]) - 1)].astype("<u4")
        if zlib.crc32(ids) != heads[k][3]:
            raise ValueError("a block's checksum differs")
        out[k] = ids
    return out
