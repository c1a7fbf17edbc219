"""Texts as one byte buffer, and vectorised work on their words.

A batch of texts is held as ``data`` (uint8) and ``starts`` (one more than there are
texts). Words, hashes and sets are computed by NumPy over the whole buffer, in slices of
a fixed size that are cut between words, so memory follows the slice and not the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that one vectorised step handles; a single longer word is handled whole.
SLICE = 2 << 20

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_STEP = np.uint64(0x9E3779B97F4A7C15)  # constants of the public SplitMix64 generator
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 of each value: a permutation of the 64-bit numbers."""
    x = x + _STEP
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mix(np.arange(256, dtype=np.uint64))
LOWER_VALUES = BYTE_VALUES[LOWER]
_places = mix(np.arange(1 << 10, 1 << 11, dtype=np.uint64)) | np.uint64(1)


def place_factors(n: int) -> np.ndarray:
    """Odd multipliers of the positions in a word."""
    global _places
    if n > len(_places):
        _places = mix(np.arange(1 << 10, (1 << 10) + 2 * n, dtype=np.uint64)) | np.uint64(1)
    return _places


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the starts of a string column; a null text is empty."""
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    starts = np.frombuffer(buffers[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    starts = starts.astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def groups_of(starts: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``limit`` bytes together, or of one text."""
    i, n = 0, len(starts) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + limit, "right")) - 1)
        yield i, j
        i = j


def _slices(data: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Slices cut after a blank."""
    i, n = 0, len(data)
    while n - i > limit:
        j = i + limit
        cut = np.flatnonzero(BLANK[data[i:j]])
        while not len(cut) and j < n:
            j = min(n, j + limit)
            cut = np.flatnonzero(BLANK[data[i:j]])
        j = i + int(cut[-1]) + 1 if len(cut) else n
        yield i, j
        i = j
    if i < n:
        yield i, n


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every word; texts are parted like words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~BLANK[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = starts[(starts > 0) & (starts < n)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; spans are in order and don't overlap."""
    if not len(begins):
        return np.zeros(0, np.uint64)
    sizes = ends - begins
    at = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(at, sizes)
    terms = values[data[place + np.repeat(begins, sizes)]] * place_factors(int(sizes.max()))[place]
    return mix(np.add.reduceat(terms, at) + sizes.astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of words of every text."""
    hashes, begins = [], []
    values = LOWER_VALUES if lower else BYTE_VALUES
    for i, j in _slices(data, SLICE):
        inner = starts[np.searchsorted(starts, i) : np.searchsorted(starts, j, "right")] - i
        b, e = word_spans(data[i:j], inner)
        hashes.append(span_hashes(data[i:j], b, e, values))
        begins.append(b + i)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(starts) - 1, np.int64)
    cuts = np.searchsorted(np.concatenate(begins), starts)
    return np.concatenate(hashes), np.diff(cuts)


def owners(counts: np.ndarray) -> np.ndarray:
    """Index of the text that each item belongs to."""
    return np.repeat(np.arange(len(counts)), counts)


def to_planes(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of each value, byte by byte, which compresses better."""
    table = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    return np.ascontiguousarray(table[:, :width].T).tobytes()


def from_planes(blob: bytes, width: int, dtype=np.uint64) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(width, -1)
    table = np.zeros((planes.shape[1], np.dtype(dtype).itemsize), np.uint8)
    table[:, :width] = planes.T
    return table.reshape(-1).view(dtype)


def distinct_per_text(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of each text in ascending order, and their number."""
    if not len(keys):
        return keys, counts
    own = owners(counts).astype(np.uint16 if len(counts) < 1 << 16 else np.int64)
    by_key = np.argsort(keys)
    order = by_key[np.argsort(own[by_key], kind="stable")]
    keys, own = keys[order], own[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])
    return keys[new], np.bincount(own[new], minlength=len(counts))


_SHINGLE = mix(np.arange(1, 65, dtype=np.uint64) << np.uint64(20)) | np.uint64(1)


def shingles(data: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ``size`` consecutive lower-cased words, and their number, by text.

    A text with fewer words has its whole word sequence as its only one; a text without
    words has none.
    """
    words, counts = word_hashes(data, starts)
    if not len(words):
        return words, counts
    n = len(words)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)  # words to the end of the text
    total = np.repeat(counts, counts)
    value = np.zeros(n, np.uint64)
    for k in range(size):
        shifted = np.zeros(n, np.uint64)
        shifted[: n - k] = words[k:] * _SHINGLE[k]
        value += np.where(left > k, shifted, np.uint64(0))
    first = left == total
    real = (left >= size) | (first & (total < size))
    value = mix(value + np.minimum(total, size).astype(np.uint64))
    return distinct_per_text(value[real], np.bincount(owners(counts)[real], minlength=len(counts)))
