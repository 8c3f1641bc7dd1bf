"""Words and word windows of whole Arrow string columns as flat numpy arrays.

Helpers that run inside Spark tasks.  A word is a maximal run of bytes other than
0x20 and 0x09-0x0D, as in the regular expression ``[^\\x20\\x09-\\x0D]+``; on UTF-8 the
bytes and the code points give the same words.  Batches are cut into slices of about a
megabyte of text, so memory is bounded by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from xxhash import xxh3_128_digest

SLICE_BYTES = 1 << 20
#: The prime of the window hashes, their two bases, and the seed of the digests of long words: drawn once.
PRIME = (1 << 61) - 1
BASES = 0x0B4F1E36A9D27C55, 0x153C8D70E2BF6493
_SEED = 0x6A5D39EAE12657A9

_IS_WORD_BYTE = np.ones(256, bool)
_IS_WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False
#: Masks of the first bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def times(values: np.ndarray, factor: int) -> np.ndarray:
    """values * factor modulo PRIME, folded, for folded values and a factor below PRIME."""
    f1, f0 = np.uint64(factor >> 31), np.uint64(factor & ((1 << 31) - 1))
    v1, v0 = values >> np.uint64(31), values & np.uint64((1 << 31) - 1)
    middle = v1 * f0 + v0 * f1
    return folded(v1 * (f1 + f1) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << np.uint64(31)) + v0 * f0)


def folded(values: np.ndarray) -> np.ndarray:
    """Any unsigned numbers modulo PRIME, as numbers at most 7 above it."""
    return (values & np.uint64(PRIME)) + (values >> np.uint64(61))


def reduced(values: np.ndarray) -> np.ndarray:
    """Any unsigned numbers modulo PRIME."""
    values = folded(values)
    return values - np.uint64(PRIME) * (values >= np.uint64(PRIME))


def window_hashes(values: np.ndarray, size: int, base: int) -> np.ndarray:
    """For each window of ``size`` values, the polynomial in ``base`` that they are the coefficients of, modulo PRIME.

    Windows are put together from windows of half their length.
    """
    return reduced(_windows(values, size, base))


def _windows(values: np.ndarray, size: int, base: int) -> np.ndarray:
    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if size == 1:
        return values
    half = size // 2
    shorter = _windows(values, half, base)
    found = shorter[: len(shorter) - half] + times(shorter[half:], pow(base, half, PRIME))
    if size % 2:
        found = found[:n] + times(values[size - 1 :], pow(base, size - 1, PRIME))
    return folded(found)


def hashes_at(values: np.ndarray, at: np.ndarray, size: int, base: int) -> np.ndarray:
    """The hashes of the windows of ``size`` values that start at these places."""
    if len(at) * size > 6 * len(values):
        return window_hashes(values, size, base)[at]
    found = values[at]
    for k in range(1, size):
        found = folded(found + times(values[at + k], pow(base, k, PRIME)))
    return reduced(found)


def joint(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for each pair (left, right): equal pairs alone share one."""
    if not len(left):
        return np.empty(0, np.int64)
    return np.unique(left.astype(np.int64) * (int(right.max()) + 1) + right, return_inverse=True)[1]


def equal_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each range of bytes, ranges in rising order, and the distinct ones: equal bytes alone share a number."""
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=at[1:])
    bytes_ = data[np.repeat(start - at[:-1], end - start) + np.arange(at[-1])]
    return numbered(bytes_, at)


def numbered(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The same for ranges that touch: range i is data[at[i]:at[i + 1]]."""
    ranges = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = ranges.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


@dataclass
class Words:
    """Words of several texts. Word w is data[start[w]:end[w]]; text i has words first[i]:first[i + 1] and bytes text_at[i]:text_at[i + 1]."""

    data: np.ndarray
    text_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def texts(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def interned(self, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
        """The number of each word among the distinct ones, and these; with A-Z in lower case if asked for."""
        data = self.data
        inside = _IS_WORD_BYTE[data]
        if lower:
            data = _LOWER[data]
        at = np.zeros(len(self.start) + 1, np.int64)
        np.cumsum(self.end - self.start, out=at[1:])
        return numbered(data[inside], at)  # every byte that is none of the separators belongs to a word

    def keys(self, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit numbers for each word, with A-Z in lower case if asked for.

        A word of up to 15 bytes is spelled out in them, with its length in the last byte; a
        longer one has 120 bits of its XXH3 digest.
        """
        data = np.r_[_LOWER[self.data] if lower else self.data, np.zeros(16, np.uint8)]
        eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from each place on
        length = self.end - self.start
        a = eight[self.start] & _FIRST[np.minimum(length, 8)]
        b = eight[self.start + 8] & _FIRST[np.clip(length - 8, 0, 8)] | length.astype(np.uint64) << np.uint64(56)
        long_ = np.flatnonzero(length > 15)
        if len(long_):
            which, distinct = equal_ranges(data, self.start[long_], self.end[long_])
            digests = np.frombuffer(b"".join([xxh3_128_digest(w, _SEED) for w in distinct.to_pylist()]), np.uint64).reshape(-1, 2)[which]
            a[long_], b[long_] = digests[:, 0], digests[:, 1] | np.uint64(0xFF << 56)
        return a, b

    def values(self) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers below PRIME for each word, mixed from its keys."""
        a, b = self.keys()
        return reduced(mix(a + mix(b + np.uint64(BASES[0])))), reduced(mix(b - mix(a ^ np.uint64(BASES[1]))))

    def window_starts(self, size: int) -> np.ndarray:
        """Words at which a window of so many words of one text starts."""
        ends = np.repeat(self.first[1:], self.counts)
        return np.flatnonzero(np.arange(len(self.start)) + size <= ends)


def find_words(data: np.ndarray, text_at: np.ndarray) -> Words:
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _IS_WORD_BYTE[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # A word may not run over the border of two texts that touch.
    borders = text_at[1:-1]
    if len(borders):
        borders = np.unique(borders)
        borders = borders[(borders > 0) & (borders < len(data))]
        cut = borders[(inside[borders] == 1) & (inside[borders + 1] == 1)]
        if len(cut):
            start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return Words(data, text_at, start, end, np.searchsorted(start, text_at))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, null as empty, and where each text starts in them."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that a slice has at most so many bytes of text, or one row."""
    at = text_bytes(batch.column(column))[1]
    row, rows = 0, batch.num_rows
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield batch.slice(row, stop - row)
        row = stop


def batch_words(batch: pa.RecordBatch, column: str = "text") -> Words:
    return find_words(*text_bytes(batch.column(column)))


def sliding_minimum_at(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of width values, the index of its smallest value, the first on ties."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, at, span = values.copy(), np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        m = len(best) - step
        right = best[step:] < best[:m]
        best = np.where(right, best[step:], best[:m])
        at = np.where(right, at[step:], at[:m])
        span += step
    return at[:n]


def lists(first: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), values)
