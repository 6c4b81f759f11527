"""Vectorised hashing of words in Arrow batches of UTF-8 text, with no loop over words.

A word's hash is the sum of table[byte] * P**i modulo 2**64, mixed; it comes from differences of one running sum
over the whole buffer, so the cost is a few numpy passes over the bytes. P is odd and so has an inverse.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at a time; bounds the temporary arrays to about 40 times as much.
PIECE = 1 << 21
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.default_rng(20240601).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 12, 1 << int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        p, q = np.full(size, _P), np.full(size, _P_INV)
        p[0] = q[0] = 1
        _powers[size] = np.cumprod(p), np.cumprod(q)
    return _powers[size]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = pa.concat_arrays([column.fill_null(b"")])
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(column):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; words end at the end of their text."""
    inside = ~_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    starts[edges] = inside[edges]
    ends = np.zeros(len(data) + 1, dtype=bool)
    ends[1:] = inside
    ends[1:-1] &= ~inside[1:]
    ends[edges] = inside[edges - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends)


def _hash_piece(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = _LOWER[data]
    start, end = word_spans(data, offsets)
    p, q = _power_tables(len(data))
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * p[: len(data)], out=run[1:])
    return mix((run[end] - run[start]) * q[start]), start


def slices(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, stop, offsets within) of parts of about PIECE bytes, cut at white space or at the end of a text."""
    at = 0
    while at < len(data):
        stop = min(len(data), at + PIECE)
        while stop < len(data):
            gap = np.flatnonzero(_SPACE[data[stop : stop + PIECE]])
            edge = offsets[np.searchsorted(offsets, stop)]
            stop = min(int(edge), stop + int(gap[0])) if len(gap) else min(int(edge), stop + PIECE)
            if len(gap) or stop == edge:
                break
        yield at, stop, offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop, "right")] - at
        at = stop


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the A-Z-lower-cased words of all texts, and the index at which each text's words start."""
    hashes, starts = [], []
    for at, stop, own in slices(data, offsets):
        h, s = _hash_piece(data[at:stop], own)
        hashes.append(h)
        starts.append(s + at)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return h, np.searchsorted(s, offsets)


def texts(batches: Iterator[pa.RecordBatch], limit: int = 4 * PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose first binary column holds about `limit` bytes, one row at least."""
    for batch in batches:
        column = next(c for c in batch.columns if pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type))
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
        total, lo = np.cumsum(sizes), 0
        while lo < len(sizes):
            base = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, base + limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
    trim()


def trim() -> None:
    """Give what this Python worker no longer uses back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def shingle_sets(words: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's word shingles, end to end, and where each text's begin.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    counts = np.diff(starts)
    salt = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), n)
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(first[-1]) - first[text] + starts[text]
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    length = np.minimum(counts, width)[text]
    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        h += np.where(k < length, padded[at + k] * salt[k], np.uint64(0))
    h = mix(h + length.astype(np.uint64))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(counts) + 1))
