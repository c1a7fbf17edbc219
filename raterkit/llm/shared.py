"""Which keys of a text (shingles, anchors) also occur in another text.

Keys are never shuffled one by one. A task sorts some million keys, combines equal ones,
and sends each part of the key space a block of 32-bit fingerprints with their ordinals.
A key that a task has met twice is marked there at once and only announced, so a key
that a third of all texts have costs one entry per block. Parts answer with ordinals, and
a block's answers are merged with its list of texts. A fingerprint shared by chance
marks a key too many, never one too few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from raterkit.llm.common import on_groups
from raterkit.llm.textarrays import buffer_of, from_planes, groups_of, to_planes
from raterkit.session import shuffle_slots

#: Keys of a text buffer, and how many belong to each text.
KeysOf = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]

BLOCK_KEYS = 2_000_000
_FINGERPRINT = 4
_ORDINAL = 4
_KNOWN = np.uint32(0xFFFFFFFF)
_SENT = pa.schema(
    [("dest", pa.int32()), ("block", pa.int64()), ("prints", pa.binary()), ("at", pa.binary()), ("texts", pa.binary()), ("counts", pa.binary()), ("marks", pa.binary())]
)
_SENT_DDL = "dest int, block long, prints binary, at binary, texts binary, counts binary, marks binary"


def _send(keys_of: KeysOf, parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 24
    keys, texts, counts = [], [], []
    for batch in batches:
        ids = batch.column(0).to_numpy()
        data, starts = buffer_of(batch.column(1))
        for i, j in groups_of(starts):
            k, c = keys_of(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
            keys.append(k)
            counts.append(c)
            texts.append(ids[i:j])
            if sum(map(len, keys)) >= BLOCK_KEYS:
                yield from _block(number, parts, keys, texts, counts)
                number += 1
                keys, texts, counts = [], [], []
    if keys:
        yield from _block(number, parts, keys, texts, counts)


def _block(number: int, parts: int, keys: list, texts: list, counts: list) -> Iterator[pa.RecordBatch]:
    values, owned, ids = np.concatenate(keys), np.concatenate(counts), np.concatenate(texts)
    order = np.argsort(values)
    ranked = values[order]
    same = np.zeros(len(ranked) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    twice = same[:-1] | same[1:]
    marks = np.zeros(len(values), bool)
    marks[order[twice]] = True
    head = ~same[:-1]
    prints, at = ranked[head], np.where(twice[head], _KNOWN, order[head].astype(np.uint32))
    part = ((prints >> np.uint64(8 * _FINGERPRINT)) % np.uint64(parts)).astype(np.int32)
    # within a part the fingerprints are ascending, which compresses
    by_part = np.lexsort((prints & np.uint64((1 << 8 * _FINGERPRINT) - 1), part))
    prints, at, part = prints[by_part], at[by_part], part[by_part]
    cuts = np.flatnonzero(np.diff(part)) + 1
    for p, f, a in zip(np.split(part, cuts), np.split(prints, cuts), np.split(at, cuts)):
        if len(p):
            yield _row(dest=int(p[0]), block=number, prints=to_planes(f, _FINGERPRINT), at=to_planes(a, _ORDINAL))
    yield _row(
        dest=number % parts,
        block=number,
        texts=ids.astype(np.int64).tobytes(),
        counts=owned.astype(np.int64).tobytes(),
        marks=np.packbits(marks).tobytes(),
    )


def _row(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([values], _SENT)


def _answer(rows: pa.Table) -> pa.Table:
    """Of one part: the ordinals whose fingerprint occurs in another block, by block."""
    rows = rows.to_pylist()
    sent = [r for r in rows if r["prints"] is not None]
    out = [r for r in rows if r["prints"] is None]
    if sent:
        prints = np.concatenate([from_planes(r["prints"], _FINGERPRINT) for r in sent])
        at = np.concatenate([from_planes(r["at"], _ORDINAL, np.uint32) for r in sent])
        row = np.repeat(np.arange(len(sent)), [len(r["prints"]) // _FINGERPRINT for r in sent])
        order = np.argsort(prints)
        same = np.zeros(len(prints) + 1, bool)
        same[1:-1] = prints[order][1:] == prints[order][:-1]
        hit = order[(same[:-1] | same[1:])]
        hit = np.sort(hit[at[hit] != _KNOWN])
        cuts = np.searchsorted(row[hit], np.arange(len(sent) + 1))
        for i, r in enumerate(sent):
            chosen = at[hit[cuts[i] : cuts[i + 1]]]
            if len(chosen):
                out.append({"block": r["block"], "at": to_planes(chosen, _ORDINAL)})
    return pa.Table.from_pylist([{**dict.fromkeys(_SENT.names), **r, "dest": 0, "prints": None} for r in out], _SENT)


def _merge(least: float, with_marks: bool, rows: pa.Table) -> pa.Table:
    rows = rows.to_pylist()
    own = next(r for r in rows if r["texts"] is not None)
    texts = np.frombuffer(own["texts"], np.int64)
    ends = np.cumsum(np.frombuffer(own["counts"], np.int64))
    total = int(ends[-1]) if len(ends) else 0
    marks = np.unpackbits(np.frombuffer(own["marks"], np.uint8), count=total).astype(bool)
    for r in rows:
        if r["at"] is not None:
            marks[from_planes(r["at"], _ORDINAL, np.uint32)] = True
    before = np.concatenate([[0], np.cumsum(marks)])
    starts = ends - np.frombuffer(own["counts"], np.int64)
    shared = before[ends] - before[starts]
    chosen = np.flatnonzero((shared > 0) & (shared >= np.ceil(least * (ends - starts) - 1e-9)))
    values = [np.packbits(marks[starts[i] : ends[i]]).tobytes() if with_marks else b"" for i in chosen]
    return pa.table({"key": pa.array(texts[chosen]), "value": pa.array(values, pa.binary())})


def shared_keys(texts: DataFrame, keys_of: KeysOf, least: float = 0.0, with_marks: bool = True) -> DataFrame:
    """(key, value) of the texts of (key long, text) that share a key with another text.

    ``value`` has one bit per key of the text, in the order of ``keys_of``, set where the
    key occurs in another text, or twice in this one. Texts are left out if less than the
    share ``least`` of their keys is marked. Rows with an equal key appear several times.
    """
    parts = shuffle_slots(texts.sparkSession)
    sent = texts.mapInArrow(partial(_send, keys_of, parts), _SENT_DDL)
    answered = sent.groupBy("dest").applyInArrow(on_groups(_answer), _SENT_DDL)
    return answered.groupBy("block").applyInArrow(on_groups(_merge, least, with_marks), "key long, value binary")
