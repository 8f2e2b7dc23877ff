"""Vectorised text primitives on Arrow string buffers.

Every text operator of this subpackage works on the UTF-8 bytes of an Arrow
batch: word boundaries, word hashes and per-document counts come from a few
numpy passes over the buffer, never from a loop over words.  ASCII separators
cannot occur inside a multi-byte character, so byte classes are exact.

Batches are cut into slices of about ``SLICE_BYTES`` of text, which bounds the
memory of a task by the slice (or by its one longest document).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 3 << 20

#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Separators of ``[^\x20\x09-\x0D]+`` words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Word bytes of ``[^\x20\x09-\x0D]+``.
SPACED = ~SPACE
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE[LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Odd multipliers that tell the places of a window apart.
PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.cumprod(np.full(1 << 12, _BASE, np.uint64), dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """At least ``n`` successive powers of the hash base, modulo 2^64."""
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.full(1 << int(n - 1).bit_length(), _BASE, np.uint64),
                             dtype=np.uint64)
    return _POWERS


def power(n: int) -> np.uint64:
    """The hash base to the ``n``, modulo 2^64."""
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def byte_values(data: np.ndarray) -> np.ndarray:
    """The random 64-bit value of each byte."""
    return _BYTE[data]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Texts:
    """The texts of one Arrow string array: bytes, document offsets.

    A null text counts as an empty one.
    """

    def __init__(self, column: pa.Array):
        if column.null_count:
            column = column.fill_null("")
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)
        offsets = offsets[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data = raw[offsets[0]:offsets[-1]]
        self.off = offsets - offsets[0]
        self.n = len(column)
        self._points = None

    def bytes(self, i: int) -> bytes:
        return self.data[self.off[i]:self.off[i + 1]].tobytes()

    @property
    def points(self) -> np.ndarray:
        """``points[b]``: code points before byte ``b`` (of the whole buffer)."""
        if self._points is None:
            self._points = np.concatenate(([0], np.cumsum((self.data & 0xC0) != 0x80)))
        return self._points

    def count(self, table: np.ndarray) -> np.ndarray:
        """Per document, how many bytes ``table`` marks."""
        return per_doc(table[self.data], self.off)


def per_doc(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the ranges that ``off`` delimits."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[off[1:]] - total[off[:-1]]


class Words:
    """Words of a batch: byte ranges, 64-bit hashes, word offsets per document."""

    def __init__(self, texts: Texts, table: np.ndarray, lower: bool = True):
        data, off = texts.data, texts.off
        inside = table[data]
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        if len(inside):
            before[0] = False
            before[1:] = inside[:-1]
            after[-1] = False
            after[:-1] = inside[1:]
            cuts = off[(off > 0) & (off < len(data))]
            before[cuts] = False
            after[cuts - 1] = False
        self.texts = texts
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.off = np.searchsorted(self.start, off)
        self.n = np.diff(self.off)
        self.hash = range_hashes(data, self.start, self.end, lower, inside)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts.n), self.n)

    def bytes(self, i: int) -> bytes:
        return self.texts.data[self.start[i]:self.end[i]].tobytes()

    def window_hashes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``k`` consecutive words that lie in one
        document, and the index of each window's first word."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h += self.hash[j:j + n] * PLACE[j]
        room = np.repeat(self.off[1:], self.n)[:n]
        first = np.flatnonzero(np.arange(n) + k <= room)
        return mix(h[first]), first


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool,
                 inside: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the non-empty, ascending, disjoint byte ranges.

    ``inside`` marks exactly the bytes in the ranges, if at hand."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.concatenate(([0], np.cumsum(size)))
    if inside is None:
        edge = np.zeros(len(data) + 1, np.int8)
        edge[start] += 1
        edge[end] -= 1
        inside = np.cumsum(edge[:-1]).astype(bool)
    place = np.arange(first[-1]) - np.repeat(first[:-1], size)
    value = (_BYTE_LOWER if lower else _BYTE)[data[inside]] * powers(int(size.max()))[place]
    return mix(np.add.reduceat(value, first[:-1]) + size.astype(np.uint64))


def first_of_equal(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether an equal one stands before it, and how many are equal."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, np.int64)
    _, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return first[inverse] < np.arange(len(keys)), counts[inverse]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``max_bytes`` of ``column`` at
    most; a longer single text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        size = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
        ends = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to
