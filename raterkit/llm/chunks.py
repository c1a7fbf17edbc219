"""Encode texts by their distinct chunks.

Text is cut where a tokenizer can never join what stands on both sides, so encoding the
chunks one after the other gives exactly the ids of the whole text. A batch repeats its
chunks many times; each distinct one goes to the tokenizer once, and a worker remembers
those of earlier batches. Ids are then laid out by NumPy.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from raterkit.llm.textarrays import BYTE_VALUES, span_hashes

#: Chunks a worker remembers; beyond them it starts anew. Only speed depends on it.
REMEMBERED = 1_500_000


def joined_ranges(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of every range, one after the other."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(begins - before, counts)


class ChunkEncoder:
    """``encode(list of bytes) -> list of id lists``, applied to distinct chunks."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], dtype):
        self.encode_distinct = encode
        self.dtype = dtype
        self.remembered = REMEMBERED
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begins = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.dtype)

    def _learn(self, keys: np.ndarray, lists: list[list[int]]) -> None:
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter((i for one in lists for i in one), self.dtype, int(counts.sum()))
        begins = len(self.ids) + np.cumsum(counts) - counts
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.begins = np.insert(self.begins, at, begins)
        self.counts = np.insert(self.counts, at, counts)
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of every chunk."""
        if not len(begins):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        keys, first, at = np.unique(span_hashes(data, begins, ends, BYTE_VALUES), return_index=True, return_inverse=True)
        if len(self.keys) > self.remembered:
            self._forget()
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[np.minimum(place, len(self.keys) - 1)] == keys
        if not known.all():
            new = np.flatnonzero(~known)
            raw = data.tobytes()
            texts = [raw[b:e] for b, e in zip(begins[first[new]].tolist(), ends[first[new]].tolist())]
            self._learn(keys[new], self.encode_distinct(texts))
            place = np.searchsorted(self.keys, keys)
        chosen = place[at]
        counts = self.counts[chosen]
        return self.ids[joined_ranges(self.begins[chosen], counts)], counts


def spans_from_cuts(cut: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of the chunks, and their number by text. ``cut``: a chunk may begin here."""
    n = len(cut)
    cut[starts[starts < n]] = True
    begins = np.flatnonzero(cut)
    ends = np.append(begins[1:], n) if len(begins) else begins
    per_text = np.diff(np.searchsorted(begins, starts))
    return begins, ends, per_text
