"""Word kernels: Arrow text batches to flat numpy arrays of words and hashes.

A word is a run of bytes other than 0x20 and 0x09-0x0D. All kernels work on
the UTF-8 buffer of a slice of rows, so no Python object is made per word.
Slices are cut by bytes, never inside a text: memory is bounded by
``SLICE_BYTES`` or by the longest single text, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; the kernels need about 60 times that.
SLICE_BYTES = 1 << 18

_MASK = (1 << 64) - 1
_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on the input."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_PRIME))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POWER = {b: _powers(1 << 12, b) for b in (_PRIME, _INVERSE)}


def powers(n: int, base: int) -> np.ndarray:
    if len(_POWER[base]) < n:
        _POWER[base] = _powers(max(n, 2 * len(_POWER[base])), base)
    return _POWER[base][:n]


@dataclass
class Words:
    """Words of a slice of rows, in order."""

    data: np.ndarray  # bytes of all texts
    text_start: np.ndarray  # row -> first byte
    start: np.ndarray  # word -> first byte
    end: np.ndarray  # word -> byte after the last
    first: np.ndarray  # row -> its first word; one more entry than rows
    row: np.ndarray  # word -> row

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, equal for equal words anywhere."""
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[self.data] * powers(n, _PRIME), out=total[1:])
        raw = (total[self.end] - total[self.start]) * powers(n, _INVERSE)[self.start]
        return mix(raw ^ (self.end - self.start).astype(np.uint64) * np.uint64(_PRIME))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (one more than rows) of a string array; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array, lower: bool = False) -> Words:
    """Splits the texts into words; ``lower`` maps A-Z to a-z first."""
    data, offsets = buffers(texts)
    if lower:
        data = _LOWER[data]
    solid = ~_SPACE[data]
    n = len(data)
    begins = solid.copy()
    ends = np.zeros(n + 1, bool)
    if n:
        begins[1:] &= ~solid[:-1]
        inner = offsets[1:-1]
        inner = inner[inner < n]
        begins[inner] = solid[inner]
        ends[1:n] = solid[:-1] & ~solid[1:]
        ends[n] = solid[-1]
        inner = inner[inner > 0]
        ends[inner] = solid[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    first = np.searchsorted(start, offsets)
    return Words(data, offsets[:-1], start, end, first, np.repeat(np.arange(len(texts)), np.diff(first)))


def grams(hashes: np.ndarray, w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows that lie in one row, and their first words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(w.row[: len(hashes) - n + 1] == w.row[n - 1 :])
    out = hashes[at]
    for i in range(1, n):
        out = out * np.uint64(_PRIME) + hashes[at + i]
        out ^= out >> np.uint64(29)
    return mix(out), at


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of at most ``size`` bytes, or of one row."""
    if not batch.num_rows:
        return
    _, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes anywhere."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * powers(n, _PRIME), out=total[1:])
    at = np.minimum(start, max(n - 1, 0))
    raw = (total[end] - total[start]) * powers(max(n, 1), _INVERSE)[at]
    return mix(raw ^ (end - start).astype(np.uint64) * np.uint64(_PRIME))


def by_row(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``mask`` between consecutive bounds."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[bounds])


def lines(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last and row of each non-empty \\n-split line."""
    n = len(w.data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    begin = np.unique(np.concatenate([w.text_start, np.flatnonzero(w.data == 10) + 1]))
    begin = begin[begin < n]
    end = np.append(begin[1:], n)
    end = end - (w.data[end - 1] == 10)
    row = np.searchsorted(w.text_start, begin, "right") - 1
    solid = end > begin
    return begin[solid], end[solid], row[solid]
