"""Remove long passages that an earlier document has, by sorting suffixes.

1. Every window of 50 bytes picks an anchor: of the 24-byte strings inside it the one
   with the smallest hash. Equal windows pick equal anchors, so only windows whose anchor
   string occurs again (``shared.shared_keys``) can be repeated.
2. Consecutive windows with one anchor form a segment. Segments go to the part of their
   anchor, each distinct one once per block of text, with its smallest doc_id.
3. A part sorts the suffixes that begin at its windows, up to 50 bytes, deep and shallow:
   a multikey sort to 16 bytes, then blind tries for the groups that still agree. Equal
   windows become neighbours and share the smallest doc_id among them.
4. Windows whose smallest doc_id is below their own document's are removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from raterkit.llm.chunks import joined_ranges
from raterkit.llm.common import on_groups
from raterkit.llm.shared import shared_keys
from raterkit.llm.store import Store, build
from raterkit.llm.textarrays import BYTE_VALUES, SLICE, buffer_of, from_planes, groups_of, mix, span_hashes, to_planes
from raterkit.session import ship_package, shuffle_slots

WINDOW = 50
ANCHOR = 24
_CHOICES = WINDOW - ANCHOR + 1
SHALLOW = 16
#: Text with marked anchors that one block combines.
BLOCK_BYTES = 12 << 20
#: Parts of the anchor space for each reduce task: a part sorts its windows in memory.
PARTS_PER_SLOT = 4
#: Windows that one step of the merge expands.
_STEP = 2_000_000
_FACTORS = mix(np.arange(7, 11, dtype=np.uint64)) | np.uint64(1)
#: A null doc_id counts as this one, which is smaller than any other.
NULL_ID = -(1 << 63)


def _loads(data: np.ndarray, dtype: str) -> np.ndarray:
    """The eight bytes from each position on as one number."""
    return np.ndarray(max(0, len(data) - 7), dtype, np.ascontiguousarray(data), strides=(1,))


# ---- anchors -------------------------------------------------------------------------


def _string_hashes(data: np.ndarray) -> np.ndarray:
    """Hash, never 0, of the ``ANCHOR`` bytes from each position on."""
    loads, n = _loads(data, "<u8"), len(data) - ANCHOR + 1
    value = loads[:n] * _FACTORS[0]
    value += loads[8 : n + 8] * _FACTORS[1]
    value += loads[16 : n + 16] * _FACTORS[2]
    value ^= value >> np.uint64(32)
    value *= _FACTORS[3]
    value ^= value >> np.uint64(29)
    value |= np.uint64(1)
    return value


def _sliding(choose, values: np.ndarray) -> np.ndarray:
    """``choose`` over every run of ``_CHOICES`` values, by doubling."""
    width = 1
    while 2 * width <= _CHOICES:
        values = choose(values[:-width], values[width:])
        width *= 2
    return choose(values[: len(values) - (_CHOICES - width)], values[_CHOICES - width :])


def _inside(starts: np.ndarray, low: int, n: int) -> np.ndarray:
    """Whether the window from each of the positions low .. low + n lies in one text."""
    change = np.zeros(n + 1, np.int32)
    edges = starts[np.searchsorted(starts, low + 1) : np.searchsorted(starts, low + n + WINDOW)] - low
    begin, end = np.clip(edges - WINDOW + 1, 0, n), np.clip(edges, 0, n)
    np.add.at(change, begin, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) == 0


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of all windows, ascending, and their hashes.

    They depend on their text alone. A long text is worked through in slices.
    """
    positions, hashes, n = [], [], len(data)
    for a in range(0, n - ANCHOR + 1, SLICE):
        low, high = max(0, a - _CHOICES + 1), min(n, a + SLICE + WINDOW)
        if high - low < WINDOW:
            break
        value = _string_hashes(data[low:high])
        least = _sliding(np.minimum, value)
        least[~_inside(starts, low, len(least))] = 0
        edge = np.zeros(_CHOICES - 1, np.uint64)
        chosen = _sliding(np.maximum, np.concatenate([edge, least, edge])) == value
        at = np.flatnonzero(chosen) + low
        at = at[(at >= a) & (at < a + SLICE)]
        positions.append(at)
        hashes.append(value[at - low])
    if not positions:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(positions), np.concatenate(hashes)


def anchor_keys(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor hashes, spread evenly, and their number by text."""
    at, value = anchors(data, starts)
    return mix(value), np.diff(np.searchsorted(at, starts))


def marked_segments(
    data: np.ndarray, starts: np.ndarray, at: np.ndarray, value: np.ndarray, marked: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor of each segment with a marked anchor."""
    firsts, chosen = [], []
    n = len(data)
    for a in range(0, n - WINDOW + 1, SLICE):
        b = min(n - WINDOW + 1, a + SLICE)
        least = _sliding(np.minimum, _string_hashes(data[a : b + WINDOW - 1]))
        window = np.flatnonzero(_inside(starts, a, len(least)))
        least = least[window]
        window += a
        anchor = np.searchsorted(at, window)
        open_ = np.flatnonzero(value[anchor] != least)
        while len(open_):
            anchor[open_] += 1
            open_ = open_[value[anchor[open_]] != least[open_]]
        keep = marked[anchor]
        firsts.append(window[keep])
        chosen.append(anchor[keep])
    if not firsts:
        return (np.zeros(0, np.int64),) * 3
    window, anchor = np.concatenate(firsts), np.concatenate(chosen)
    if not len(window):
        return window, window, window
    head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)]))
    return window[head], np.diff(np.append(head, len(window))), anchor[head]


# ---- deep-shallow sorting ------------------------------------------------------------


def _split(order: np.ndarray, group: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (group, code) where groups are ascending, and the new groups."""
    by = np.lexsort((code, group))
    order, group, code = order[by], group[by], code[by]
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (code[1:] != code[:-1])])
    return order, np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))


def sort_windows(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``begins`` by their first ``WINDOW`` bytes, and, along it,
    the place of the first suffix that is equal.

    Shallow: a multikey sort whose characters are eight bytes, which splits all groups of
    a depth at once; a group of one is done. Deep: in every group left, a blind trie is
    grown from a leader: each member is compared with the leader once, and only the depth
    and byte at which it leaves the leader's path are used. Members that never leave it
    are equal; those that leave at one branch form the next group, whose comparison
    begins at that depth.
    """
    n = len(begins)
    loads = _loads(np.concatenate([data, np.zeros(8, np.uint8)]), ">u8")
    order, group = np.arange(n), np.zeros(n, np.int64)
    place = np.arange(n)  # where the entries still being sorted lie
    final, equal = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for depth in range(0, SHALLOW, 8):
        order, group = _split(order, group, loads[begins[order] + depth].astype(np.uint64))
        group = place[group]
        alone = np.bincount(group, minlength=n)[group] == 1
        final[place[alone]], equal[place[alone]] = order[alone], place[alone]
        order, group, place = order[~alone], group[~alone], place[~alone]
    known = np.full(len(order), SHALLOW)  # bytes in which a group agrees
    while len(order):
        head = np.searchsorted(group, group)
        leader = order[head]
        depth, byte, side = _leaves(loads, begins[order], begins[leader], known)
        # smaller suffixes: the earlier they leave, the smaller; larger ones: the reverse
        code = np.where(side < 0, depth * 256 + byte, np.where(side > 0, 20_001 + (WINDOW - depth) * 256 + byte, 20_000))
        known = np.where(side == 0, WINDOW, depth + 1)
        by = np.lexsort((code, group))
        order, group, code, known = order[by], group[by], code[by], known[by]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (code[1:] != code[:-1])])
        group = place[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        done = (code == 20_000) | (np.bincount(group, minlength=n)[group] == 1)
        final[place[done]], equal[place[done]] = order[done], group[done]
        order, group, place, known = order[~done], group[~done], place[~done], known[~done]
    return final, equal


def _leaves(loads: np.ndarray, own: np.ndarray, leader: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Depth at which each suffix leaves its leader, its byte there, and whether it is
    smaller (-1), larger (1) or equal up to the window's end (0)."""
    n = len(own)
    depth, byte, side = np.full(n, WINDOW), np.zeros(n, np.int64), np.zeros(n, np.int64)
    open_ = np.arange(n)
    at = known.copy()
    while len(open_):
        mine, other = loads[own[open_] + at[open_]].astype(np.uint64), loads[leader[open_] + at[open_]].astype(np.uint64)
        differ = mine ^ other
        hit = differ != 0
        skip = sum((differ[hit] < np.uint64(1 << (56 - 8 * k))).astype(np.int64) for k in range(7))
        found = at[open_[hit]] + skip
        real = found < WINDOW
        i = open_[hit][real]
        depth[i] = found[real]
        shift = (np.uint64(56) - np.uint64(8) * skip[real].astype(np.uint64))
        a, b = (mine[hit][real] >> shift) & np.uint64(255), (other[hit][real] >> shift) & np.uint64(255)
        byte[i] = a.astype(np.int64)
        side[i] = np.where(a < b, -1, 1)
        open_ = open_[~hit]
        at[open_] += 8
        open_ = open_[at[open_] < WINDOW]
    return depth, byte, side


# ---- exchange ------------------------------------------------------------------------

_SENT = pa.schema(
    [("dest", pa.int32()), ("block", pa.int64()), ("ordinals", pa.binary()), ("counts", pa.binary()), ("bytes", pa.binary()), ("ids", pa.binary()), ("texts", pa.binary()), ("places", pa.binary())]
)
_SENT_DDL = "dest int, block long, ordinals binary, counts binary, bytes binary, ids binary, texts binary, places binary"


def _row(**values) -> dict:
    return {**dict.fromkeys(_SENT.names), **values}


def _send(store: Store, parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of the documents with marked anchors: (key, doc_id, text) rows."""
    number = TaskContext.get().partitionId() << 24
    block = _Block()
    for batch in batches:
        keys, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        found = store.get(keys)
        some = np.flatnonzero([f is not None for f in found])
        if not len(some):
            continue
        data, starts = buffer_of(batch.column(2).take(pa.array(some)))
        for i, j in groups_of(starts):
            block.add(keys[some[i:j]], ids[some[i:j]], data[starts[i] : starts[j]], starts[i : j + 1] - starts[i], [found[k] for k in some[i:j]])
            if block.size >= BLOCK_BYTES:
                yield from block.rows(number, parts)
                number, block = number + 1, _Block()
    if block.size:
        yield from block.rows(number, parts)


class _Block:
    """Segments of some megabytes of text, each distinct one held once."""

    def __init__(self):
        self.size = 0
        self.keys, self.ids, self.prints, self.anchors = [], [], [], []
        self.bytes, self.counts, self.owner, self.places = [], [], [], []
        self.texts = 0

    def add(self, keys, ids, data, starts, bits) -> None:
        at, value = anchors(data, starts)
        number = np.diff(np.searchsorted(at, starts))
        marked = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=c) for b, c in zip(bits, number)]).astype(bool)
        first, count, anchor = marked_segments(data, starts, at, value, marked)
        owner = np.searchsorted(starts, first, "right") - 1
        sizes = count + WINDOW - 1
        content = data[joined_ranges(first, sizes)]
        ends = np.cumsum(sizes)
        prints = span_hashes(content, ends - sizes, ends, BYTE_VALUES)
        _, head, back = np.unique(prints, return_index=True, return_inverse=True)
        self.prints.append((prints[head], back))
        self.anchors.append(mix(value[anchor[head]]) if len(head) else np.zeros(0, np.uint64))
        self.bytes.append((content[joined_ranges((ends - sizes)[head], sizes[head])], sizes[head]))
        self.counts.append(count)
        self.owner.append(owner + self.texts)
        self.places.append(first - starts[owner])
        self.keys.append(keys)
        self.ids.append(ids)
        self.texts += len(keys)
        self.size += len(data)

    def rows(self, number: int, parts: int) -> Iterator[pa.RecordBatch]:
        keys, ids, owner = np.concatenate(self.keys), np.concatenate(self.ids), np.concatenate(self.owner)
        prints = np.concatenate([p for p, _ in self.prints])
        before = np.cumsum([0] + [len(p) for p, _ in self.prints])
        back = np.concatenate([b + s for (_, b), s in zip(self.prints, before)]).astype(np.int64)
        if len(prints):
            _, head, merged = np.unique(prints, return_index=True, return_inverse=True)
            segment = merged[back]
            least = np.full(len(head), np.iinfo(np.int64).max)
            np.minimum.at(least, segment, ids[owner])
            sizes = np.concatenate([s for _, s in self.bytes])
            content = np.concatenate([c for c, _ in self.bytes])
            begins = (np.cumsum(sizes) - sizes)[head]
            sizes = sizes[head]
            part = (np.concatenate(self.anchors)[head] % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            for chosen in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                yield pa.RecordBatch.from_pylist(
                    [
                        _row(
                            dest=int(part[chosen[0]]),
                            block=number,
                            ordinals=to_planes(chosen.astype(np.uint32), 4),
                            counts=(sizes[chosen] - (WINDOW - 1)).astype(np.uint8).tobytes(),
                            bytes=content[joined_ranges(begins[chosen], sizes[chosen])].tobytes(),
                            ids=to_planes(least[chosen], 8),
                        )
                    ],
                    _SENT,
                )
            places = np.concatenate(self.places)
            table = np.stack([segment, owner, places, np.concatenate(self.counts)], 1).astype(np.int64)
        else:
            table = np.zeros((0, 4), np.int64)
        own = _row(dest=number % parts, block=number, texts=np.stack([keys, ids]).tobytes(), places=to_planes(table.reshape(-1), 5))
        yield pa.RecordBatch.from_pylist([own], _SENT)


def _sort_part(rows: pa.Table) -> pa.Table:
    """Smallest doc_id of every window of the part, sent back by block."""
    rows = rows.to_pylist()
    sent = [r for r in rows if r["bytes"] is not None]
    out = [r for r in rows if r["bytes"] is None]
    if sent:
        counts = [np.frombuffer(r["counts"], np.uint8).astype(np.int64) for r in sent]
        number = np.concatenate(counts)
        sizes = number + WINDOW - 1
        data = np.frombuffer(b"".join(r["bytes"] for r in sent), np.uint8)
        ids = np.repeat(np.concatenate([from_planes(r["ids"], 8, np.int64) for r in sent]), number)
        order, equal = sort_windows(data, joined_ranges(np.cumsum(sizes) - sizes, number))
        head = np.flatnonzero(np.concatenate([[True], equal[1:] != equal[:-1]]))
        least = np.empty(len(order), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(ids[order], head), np.diff(np.append(head, len(order))))
        end = 0
        for r, c in zip(sent, counts):
            begin, end = end, end + int(c.sum())
            out.append(_row(dest=0, block=r["block"], ordinals=r["ordinals"], counts=r["counts"], ids=to_planes(least[begin:end], 8)))
    return pa.Table.from_pylist(out, _SENT)


def _merge(rows: pa.Table) -> pa.Table:
    """(key, value) of a block's texts that lose bytes; value: begin and end of each run."""
    rows = rows.to_pylist()
    own = next(r for r in rows if r["texts"] is not None)
    keys, ids = np.frombuffer(own["texts"], np.int64).reshape(2, -1)
    table = from_planes(own["places"], 5, np.int64).reshape(-1, 4)
    answers = [r for r in rows if r["texts"] is None]
    texts, begins = [], []
    if answers:
        ordinals = np.concatenate([from_planes(r["ordinals"], 4, np.uint32) for r in answers]).astype(np.int64)
        counts = np.concatenate([np.frombuffer(r["counts"], np.uint8) for r in answers]).astype(np.int64)
        least = np.concatenate([from_planes(r["ids"], 8, np.int64) for r in answers])
        at = np.zeros(len(ordinals), np.int64)
        at[ordinals] = np.cumsum(counts) - counts
        step = max(1, _STEP // (_CHOICES + 1))
        for i in range(0, len(table), step):
            segment, owner, place, number = table[i : i + step].T
            text = np.repeat(owner, number)
            gone = least[joined_ranges(at[segment], number)] < ids[text]
            texts.append(text[gone])
            begins.append(joined_ranges(place, number)[gone])
    text = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    if not len(text):
        return pa.table({"key": pa.array([], pa.int64()), "value": pa.array([], pa.binary())})
    begin = np.concatenate(begins)
    order = np.lexsort((begin, text))
    text, begin = text[order], begin[order]
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (begin[1:] > begin[:-1] + WINDOW)])
    head = np.flatnonzero(new)
    spans = np.stack([begin[head], begin[np.append(head[1:], len(begin)) - 1] + WINDOW], 1)
    text = text[head]
    cuts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    values = [s.tobytes() for s in np.split(spans, cuts[1:])]
    return pa.table({"key": pa.array(keys[text[cuts]]), "value": pa.array(values, pa.binary())})


def _cut(store: Store, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, starts = buffer_of(batch.column(2))
        found = store.get(batch.column(0).to_numpy())
        for a, b in groups_of(starts):
            kept, removed, runs = [], [], []
            for i in range(a, b):
                text = data[starts[i] : starts[i + 1]]
                spans = np.frombuffer(found[i] or b"", np.int64).reshape(-1, 2)
                edges = np.concatenate([[0], spans.reshape(-1), [len(text)]]).reshape(-1, 2)
                kept.append(b"".join(text[x:y].tobytes() for x, y in edges.tolist()))
                removed.append(len(text) - len(kept[-1]))
                runs.append(spans.reshape(-1).tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1)[a:b],
                    pa.array(np.diff(starts[a : b + 1])),
                    pa.array(removed, pa.int64()),
                    pa.array([len(r) // 2 for r in runs], pa.int64()),
                    pa.array(kept, pa.binary()),
                    pa.array(runs, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "edges"],
            )


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), edges: one row per input row.

    A byte goes if a 50-byte string that covers it also begins in a document with a
    smaller id; strings are those of the input and never cross documents. ``edges`` holds
    begin and end of the maximal removed runs, ``kept`` the other bytes. A null text is
    empty; a null id counts as smaller than all others. Rows with the same id never
    remove from each other. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(
        F.xxhash64(F.col(key), F.col(text)).alias("key"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")
    )
    marks = build(shared_keys(texts.select("key", "text"), anchor_keys).dropDuplicates(["key"]), "anchor-marks")
    rows = texts.withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)))
    sent = rows.mapInArrow(partial(_send, marks, PARTS_PER_SLOT * shuffle_slots(spark)), _SENT_DDL)
    sorted_ = sent.groupBy("dest").applyInArrow(on_groups(_sort_part), _SENT_DDL)
    spans = sorted_.groupBy("block").applyInArrow(on_groups(_merge), "key long, value binary")
    store = build(spans.dropDuplicates(["key"]), "removed-spans")
    return texts.mapInArrow(
        partial(_cut, store), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, edges array<long>"
    )
