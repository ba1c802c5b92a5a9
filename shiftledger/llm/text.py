"""Words and hashes of whole batches of texts, on the UTF-8 bytes that Arrow holds, without a loop over words.

A batch is cut into segments of a bounded number of bytes, so memory follows the longest single text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Arrays of 64-bit hashes and powers for each byte of a segment stay in every worker, so it is small.
SEGMENT_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SEEDS = (0x5DEECE66D, 0x2545F491)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, seed: int):
        self.base = int(mix(np.array([seed], np.uint64))[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (self._run(b, size) for b in (self.base, self.inverse))
        return self.up, self.down

    @staticmethod
    def _run(base: int, size: int) -> np.ndarray:
        out, step = np.ones(1, np.uint64), base
        while len(out) < size:
            out = np.concatenate([out, out * np.uint64(step)])
            step = step * step & _MASK
        return out


_POWERS = [_Powers(s) for s in _SEEDS]
_BYTES = [mix(np.arange(256, dtype=np.uint64) + np.uint64(s)) for s in _SEEDS]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span, by differences of one running polynomial."""
    up, down = _POWERS[which].upto(len(values) + 1)
    run = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _BASE)


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return span_hashes(_BYTES[which][data], starts, ends, which)


def distinct(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct pair (h, g), and for each place the number of its pair."""
    order = np.argsort(h)
    v, w = h[order], g[order]
    same = (v[1:] == v[:-1])
    if (same & (w[1:] != w[:-1])).any():  # two features share one hash
        order = np.lexsort((g, h))
        v, w = h[order], g[order]
        same = (v[1:] == v[:-1]) & (w[1:] == w[:-1])
    new = np.append(True, ~same)[:len(order)]
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the places where its texts start, with the end; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, places, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    places = np.frombuffer(places, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[places[0]:places[-1]], places - places[0]


def segments(column: pa.Array, limit: int = SEGMENT_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, starts of texts) for runs of rows of at most `limit` bytes, or one row."""
    data, at = utf8(column)
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, last, data[at[first]:at[last]], at[first:last + 1] - at[first]
        first = last


def word_spans(data: np.ndarray, at: np.ndarray, between: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes, and for each text the number of words before it, with the total.

    `between` marks the bytes that are in no word.
    """
    inside = ~between[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def windows(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows of `size` words that stay in one text, and for each text the windows before it."""
    each = np.maximum(np.diff(counts) - size + 1, 0)
    before = np.concatenate([[0], np.cumsum(each)])
    return np.arange(before[-1]) + np.repeat(counts[:-1] - before[:-1], each), before
