"""Vectorised word and n-gram hashing over Arrow string columns.

A batch of texts is read as one UTF-8 byte buffer with row offsets, so that
tokenising and hashing are numpy passes over bytes instead of Python loops over
words.  All hashes are 64-bit and depend on nothing but the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPAN = 1 << 17  #: bytes hashed in one numpy pass
SLICE_BYTES = 2 << 20  #: bytes of text handled together by the operators
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def separators(pattern: str) -> np.ndarray:
    """Byte table, true where a byte ends a word. ``space``: x20, x09-x0D; ``alnum``: ASCII that is neither letter nor digit."""
    table = np.zeros(256, dtype=bool)
    if pattern == "space":
        table[[0x20, *range(0x09, 0x0E)]] = True
    elif pattern == "alnum":
        table[:0x80] = True
        table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = False
    else:
        raise ValueError(pattern)
    return table


SPACE, ALNUM = separators("space"), separators("alnum")


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
_BYTE_LOWER = _BYTE[_LOWER]


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)
        self.grow(SPAN)

    def grow(self, n: int) -> None:
        if len(self.up) >= n:
            return
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            x = np.full(n, base & _MASK, dtype=np.uint64)
            x[0] = 1
            setattr(self, name, np.cumprod(x, dtype=np.uint64))


_POWERS = _Powers()


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32, count=len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy row ranges of about ``limit`` bytes of text; a longer text stands alone."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def as_column(data: np.ndarray) -> pa.Array:
    """One text as a column, without a copy."""
    return pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(data)], dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def sentence_pieces(data: np.ndarray, limit: int, sep: np.ndarray, marks: bytes) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of at least ``limit`` bytes that end behind a mark right after a word (what is left ends the last)."""
    mark = np.zeros(256, dtype=bool)
    mark[list(marks)] = True
    start, at = 0, limit
    while at < len(data):
        stop = min(len(data), at + limit)
        found = np.flatnonzero(mark[data[at:stop]] & ~sep[data[at - 1 : stop - 1]])
        if len(found):
            end = at + int(found[0]) + 1
            yield start, end
            start, at = end, end + limit
        else:
            at = stop
    if start < len(data) or not len(data):
        yield start, len(data)


def word_bounds(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word, in order. Words never cross rows."""
    if not len(data):
        return (np.zeros(0, dtype=np.int64),) * 3
    inside = ~sep[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = edges[edges > 0] - 1
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word's bytes, ASCII lower-cased first."""
    out = np.empty(len(starts), dtype=np.uint64)
    table = _BYTE_LOWER if lower else _BYTE
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + SPAN, side="right")))
        size = int(ends[j - 1] - base)
        _POWERS.grow(size + 1)
        sums = np.empty(size + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(table[data[base : base + size]] * _POWERS.up[:size], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * _POWERS.down[s] + (e - s).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        i = j
    return out


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, without regard to rows: len(words) - n + 1 values."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    count = len(words) - n + 1
    out = np.zeros(count, dtype=np.uint64)
    for j in range(n):
        out *= np.uint64(_BASE)
        out += words[j : j + count]
    return mix(out + np.uint64(n))


def row_ranges(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Word offsets of each row: n_rows + 1 values."""
    return np.searchsorted(rows, np.arange(n_rows + 1))


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
