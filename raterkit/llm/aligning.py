"""Alignment of two tokenizers' tokens over the same bytes.

Every text is tokenised whole by both. Where a token of either side ends at one byte and the
next tokens of both begin with a space, the ends are an anchor; anchors cut the tokens into
windows of a few ids. Equal windows align alike, so a window is aligned once for each tuple
of ids and remembered by the worker: its links (pairs of tokens whose bytes overlap), its
groups (tokens between shared ends), and the groups as text.

Counts of id pairs over the corpus need every document, so there are two passes. The first
writes, for blocks of texts, the documents as places in the block's list of windows, that
list as places in its list of id pairs, and that one with the number of documents of each
pair. Pairs are summed, ranked and joined by Spark; the second pass cogroups a block with
its answered pairs. Texts are tokenised once and never shuffled, and an id pair costs one
row per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from raterkit.llm.chunks import joined_ranges
from raterkit.llm.sentencepieces import codec
from raterkit.llm.textarrays import buffer_of, from_planes, groups_of, mix, owners, place_factors, to_planes
from raterkit.llm.tokenids import byte_encoder, byte_level_bytes, encode_texts
from raterkit.session import materialize, ship_package

#: Bytes of text in a block, or one text if that is longer.
BLOCK_BYTES = 2 << 20
#: Windows a worker remembers, ids in them, and chunks of either tokenizer; beyond any it
#: starts anew. Only speed depends on it.
REMEMBERED, REMEMBERED_IDS, REMEMBERED_CHUNKS = 300_000, 3_000_000, 400_000
_SPACE = 0x20
_COMMA, _BAR, _SEMICOLON, _ZERO = b",|;0"
#: Bytes of a place in a block's lists, and of a number of links.
_PLACE, _SIZE = 3, 4
#: Cells of the grid of documents and pairs that is looked at together.
_GRID = 32 << 20

_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_ROWS = f"block long, is_doc boolean, {_DOC}, windows binary, sizes binary, links binary, a array<int>, b array<int>, n_docs array<int>"
_COUNTS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
_TYPES = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
_SCHEMA = pa.schema([(name, _TYPES[kind]) for name, kind in (part.split() for part in _ROWS.split(", "))])
_RESULT = f"{_DOC}, n_best long, count_sum long"


class Side:
    """One tokenizer's vocabulary as bytes."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.at = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.spaced = np.fromiter((t[:1] == b" " for t in tokens), bool, len(tokens))

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[joined_ranges(self.at[ids], self.sizes[ids])]


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the values of each run."""
    before = np.concatenate([[0], np.cumsum(values)])
    last = np.cumsum(counts)
    return before[last] - before[last - counts]


def _chosen(values: np.ndarray, counts: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """The values of the runs that are kept."""
    return values if keep.all() else values[np.repeat(keep, counts)]


def _shared(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the ascending ends that both sides have."""
    marks = np.zeros(int(ends_a[-1]) + 1, np.int8)
    marks[ends_a] = 1
    marks[ends_b] += 1
    return np.flatnonzero(marks[ends_a] == 2), np.flatnonzero(marks[ends_b] == 2)


class Tokens:
    """Ids of both sides for some texts whose tokens spell exactly their bytes."""

    def __init__(self, sides: tuple[Side, Side], ids: tuple[np.ndarray, np.ndarray], counts: tuple[np.ndarray, np.ndarray]):
        self.ids, self.counts = ids, counts
        self.ends = tuple(np.cumsum(side.sizes[i]) for side, i in zip(sides, ids))

    def cuts(self, sides: tuple[Side, Side]) -> tuple[np.ndarray, np.ndarray]:
        """First token of every window, on either side."""
        (ids_a, ids_b), (ends_a, ends_b) = self.ids, self.ends
        if not len(ids_a):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at_a, at_b = _shared(ends_a, ends_b)
        at_a, at_b = at_a[:-1] + 1, at_b[:-1] + 1  # the tokens behind the shared ends but the last
        anchor = sides[0].spaced[ids_a[at_a]] & sides[1].spaced[ids_b[at_b]]
        # a text begins with a space of its own, so texts are parted at anchors too
        return np.concatenate([[0], at_a[anchor]]), np.concatenate([[0], at_b[anchor]])


class Windows:
    """Aligned windows, found again by their tuples of ids.

    A 64-bit hash finds the window; its ids are then compared, so equal hashes of different
    tuples are noticed, and the memory starts anew under another seed.
    """

    def __init__(self, sides: tuple[Side, Side]):
        self.sides = sides
        self.seed = 0
        self._forget()

    def _forget(self) -> None:
        none = np.zeros(0, np.int64)
        self.keys = np.zeros(0, np.uint64)
        self.place = none
        self.begins, self.sizes, self.ids = [none, none], [none, none], [none, none]
        self.link_begins, self.link_sizes, self.links, self.n_groups = none, none, none, none
        self.text_begins, self.text_sizes, self.text = none, none, np.zeros(0, np.uint8)

    def _hashes(self, ids: list[np.ndarray], begins: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        total = np.zeros(len(begins[0]), np.uint64)
        for side in (0, 1):
            place = np.arange(len(ids[side])) - np.repeat(begins[side], sizes[side])
            factors = place_factors(int(sizes[side].max()))[place]
            terms = mix(ids[side].astype(np.uint64) + np.uint64((2 * self.seed + side + 1) << 40)) * factors
            total = mix(total ^ np.add.reduceat(terms, begins[side])) + sizes[side].astype(np.uint64)
        return total

    def find(self, ids: list[np.ndarray], begins: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        """Place in the memory of each window; windows lie one after the other."""
        if len(self.keys) > REMEMBERED or len(self.ids[0]) > REMEMBERED_IDS:
            self._forget()
        while True:
            keys, first, at = np.unique(self._hashes(ids, begins, sizes), return_index=True, return_inverse=True)
            known = np.isin(keys, self.keys)
            if not known.all():
                self._learn(keys[~known], [self._taken(ids, begins, sizes, first[~known], side) for side in (0, 1)])
            found = self.place[np.searchsorted(self.keys, keys)][at]
            if all(self._same(found, ids[side], sizes[side], side) for side in (0, 1)):
                return found
            self.seed += 1
            self._forget()

    @staticmethod
    def _taken(ids, begins, sizes, chosen, side):
        counts = sizes[side][chosen]
        return ids[side][joined_ranges(begins[side][chosen], counts)].astype(np.int64), counts

    def _same(self, found: np.ndarray, ids: np.ndarray, sizes: np.ndarray, side: int) -> bool:
        if not np.array_equal(self.sizes[side][found], sizes):
            return False
        return np.array_equal(self.ids[side][joined_ranges(self.begins[side][found], sizes)], ids)

    def _learn(self, keys: np.ndarray, taken: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Align new windows, all in one pass over their tokens."""
        (ids_a, counts_a), (ids_b, counts_b) = taken
        ends_a, ends_b = (np.cumsum(side.sizes[ids]) for side, (ids, _) in zip(self.sides, taken))
        last = ends_a[np.cumsum(counts_a) - 1]  # where each window ends, on both sides
        # between neighbouring ends of either side lies one overlap of one token of each
        cuts = np.union1d(ends_a, ends_b)
        link_a, link_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        links = ids_a[link_a] << 32 | ids_b[link_b]
        link_sizes = np.diff(np.searchsorted(cuts, last, "right"), prepend=0)
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        n_groups = np.diff(np.searchsorted(shared, last, "right"), prepend=0)
        text, text_sizes = self._texts((ids_a, ids_b), (ends_a, ends_b), shared, n_groups)
        base = len(self.place)
        for side, (ids, counts) in enumerate(taken):
            self.begins[side] = np.concatenate([self.begins[side], len(self.ids[side]) + np.cumsum(counts) - counts])
            self.sizes[side] = np.concatenate([self.sizes[side], counts])
            self.ids[side] = np.concatenate([self.ids[side], ids])
        self.link_begins = np.concatenate([self.link_begins, len(self.links) + np.cumsum(link_sizes) - link_sizes])
        self.link_sizes = np.concatenate([self.link_sizes, link_sizes])
        self.links = np.concatenate([self.links, links])
        self.n_groups = np.concatenate([self.n_groups, n_groups])
        self.text_begins = np.concatenate([self.text_begins, len(self.text) + np.cumsum(text_sizes) - text_sizes])
        self.text_sizes = np.concatenate([self.text_sizes, text_sizes])
        self.text = np.concatenate([self.text, text])
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.place = np.insert(self.place, at, base + np.arange(len(keys)))

    @staticmethod
    def _texts(ids, ends, shared: np.ndarray, n_groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The groups of all windows as text, each closed by ';', and each window's share of it."""
        upto = [np.searchsorted(e, shared) + 1 for e in ends]  # tokens to the end of each group
        total = len(ids[0]) + len(ids[1])
        numbers, marks, group = np.zeros(total, np.int64), np.full(total, _COMMA, np.uint8), np.zeros(total, np.int64)
        for side, last in ((0, _BAR), (1, _SEMICOLON)):
            sizes = np.diff(upto[side], prepend=0)
            others = upto[1 - side] if side else np.concatenate([[0], upto[1][:-1]])  # of the other side before them
            at = np.arange(len(ids[side])) + np.repeat(others, sizes)
            numbers[at], group[at] = ids[side], np.repeat(np.arange(len(sizes)), sizes)
            marks[at[upto[side] - 1]] = last
        digits = np.ones(total, np.int64)
        for k in range(1, len(str(int(numbers.max(initial=0))))):
            digits += numbers >= 10**k
        behind = np.cumsum(digits + 1)
        text = np.empty(int(behind[-1]) if total else 0, np.uint8)
        text[behind - 1] = marks
        for k in range(int(digits.max(initial=0))):
            has = digits > k
            text[behind[has] - 2 - k] = _ZERO + numbers[has] // 10**k % 10
        of_group = np.bincount(group, digits + 1, len(shared)).astype(np.int64)
        return text, _sums(of_group, n_groups)


class Aligner:
    """Both tokenizers and the windows a worker has aligned."""

    def __init__(self, byte_model: str, piece_model: str):
        self.byte_encoder, self.pieces = byte_encoder(byte_model), codec(piece_model)
        self.sides = Side(byte_level_bytes(byte_model)), Side(self.pieces.model.piece_bytes())
        self.windows = Windows(self.sides)
        self.byte_encoder.remembered = self.pieces.chunks.remembered = REMEMBERED_CHUNKS

    def tokens(self, data: np.ndarray, starts: np.ndarray) -> Tokens:
        """Both sides' ids; none for a text that is empty or that either side spells otherwise."""
        filled = np.diff(starts) > 0
        spaced = np.insert(data, starts[:-1][filled], _SPACE)
        bounds = starts + np.concatenate([[0], np.cumsum(filled)])
        ids_a, counts_a = encode_texts(self.byte_encoder, spaced, bounds)
        ids_b, counts_b = self.pieces.encode(*self.pieces.normalised(data, starts))
        keep, wanted = filled, np.diff(bounds)
        spelled = []
        for side, ids, counts in zip(self.sides, (ids_a, ids_b), (counts_a, counts_b)):
            sizes = _sums(side.sizes[ids], counts)
            keep = keep & (sizes == wanted)
            spelled.append((side.bytes_of(ids), sizes))
        for text, sizes in spelled:
            if len(text) == len(spaced) and np.array_equal(sizes, wanted):
                differ = np.flatnonzero(text != spaced)
                keep[np.searchsorted(bounds, differ, "right") - 1] = False
            else:
                at = np.cumsum(sizes) - sizes
                for i in np.flatnonzero(keep):
                    keep[i] = np.array_equal(text[at[i] : at[i] + sizes[i]], spaced[bounds[i] : bounds[i + 1]])
        ids = tuple(_chosen(i, c, keep) for i, c in ((ids_a, counts_a), (ids_b, counts_b)))
        return Tokens(self.sides, ids, (np.where(keep, counts_a, 0), np.where(keep, counts_b, 0)))

    def align(self, data: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """By text: n_a, n_b, n_groups, n_links, groups_sha256, n_windows; ``windows``, the
        windows of all texts as places in the memory."""
        tokens = self.tokens(data, starts)
        n = len(starts) - 1
        begins = tokens.cuts(self.sides)
        if not len(begins[0]):
            zero = np.zeros(n, np.int64)
            return dict(n_a=zero, n_b=zero, n_groups=zero, n_links=zero, groups_sha256=[""] * n, n_windows=zero, windows=zero[:0])
        sizes = [np.diff(b, append=len(i)) for b, i in zip(begins, tokens.ids)]
        found = self.windows.find(list(tokens.ids), list(begins), sizes)
        first = np.cumsum(tokens.counts[0]) - tokens.counts[0]
        of_text = np.diff(np.searchsorted(begins[0], np.append(first, len(tokens.ids[0]))))
        memory = self.windows
        text = memory.text[joined_ranges(memory.text_begins[found], memory.text_sizes[found])].tobytes()
        ends = np.cumsum(_sums(memory.text_sizes[found], of_text)).tolist()
        digests = [hashlib.sha256(text[b : e - 1]).hexdigest() if e > b else "" for b, e in zip([0, *ends], ends)]
        return dict(
            n_a=tokens.counts[0],
            n_b=tokens.counts[1],
            n_groups=_sums(memory.n_groups[found], of_text),
            n_links=_sums(memory.link_sizes[found], of_text),
            groups_sha256=digests,
            n_windows=of_text,
            windows=found,
        )

    def links(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links (a << 32 | b) of windows in the memory, and their number by window."""
        sizes = self.windows.link_sizes[windows]
        return self.windows.links[joined_ranges(self.windows.link_begins[windows], sizes)], sizes


@lru_cache(maxsize=1)
def aligner(byte_model: str, piece_model: str) -> Aligner:
    """The worker's aligner of two model files."""
    return Aligner(byte_model, piece_model)


def _documents_of(pairs: int, own: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Number of documents that hold each pair; document ``own`` holds pair ``at``, in order."""
    held, step = np.zeros(pairs, np.int64), max(1, _GRID // max(pairs, 1))
    for begin in range(0, n, step):
        i, j = np.searchsorted(own, [begin, begin + step])
        grid = np.zeros((min(step, n - begin), pairs), bool)
        grid[own[i:j] - begin, at[i:j]] = True
        held += grid.sum(axis=0)
    return held


def _align_blocks(byte_model: str, piece_model: str, block_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block, a row for each document and one with the block's windows and id pairs."""
    worker = aligner(byte_model, piece_model)
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        data, starts = buffer_of(batch.column(1))
        for i, j in groups_of(starts, block_bytes):
            found = worker.align(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
            windows, at, times = np.unique(found["windows"], return_inverse=True, return_counts=True)
            often = np.argsort(-times, kind="stable")  # small places for frequent windows
            rank = np.empty(len(often), np.int64)
            rank[often] = np.arange(len(often))
            places, (links, sizes) = rank[at], worker.links(windows[often])
            pairs, pair = np.unique(links, return_inverse=True)
            of_text = found["n_windows"]
            whole = np.cumsum(sizes) - sizes
            own = np.repeat(owners(of_text), sizes[places])
            n_docs = _documents_of(len(pairs), own, pair[joined_ranges(whole[places], sizes[places])], j - i)
            parts = np.split(places, np.cumsum(of_text)[:-1])
            yield _rows(j - i, block=[block] * (j - i), is_doc=[True] * (j - i), doc_id=batch.column(0)[i:j], windows=[to_planes(p, _PLACE) for p in parts], **{c: found[c] for c in _COUNTS})
            ints = lambda values: [values.astype(np.int32)]
            yield _rows(
                1, block=[block], is_doc=[False], sizes=[to_planes(sizes, _SIZE)], links=[to_planes(pair, _PLACE)],
                a=ints(pairs >> 32), b=ints(pairs & 0xFFFFFFFF), n_docs=ints(n_docs),
            )
            block += 1


def _rows(n: int, **columns) -> pa.RecordBatch:
    """Rows of the first pass; columns that are not given are null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)


def _score(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
    """Sums over a block's documents of what its id pairs were answered."""
    order = np.argsort(answers["pair"].to_numpy())
    counts = answers["count"].to_numpy()[order]
    best = answers["best"].to_numpy()[order].astype(np.int64)
    is_doc = rows["is_doc"].to_numpy()
    (lists,) = rows.filter(pa.array(~is_doc)).select(["sizes", "links"]).to_pylist()
    docs = rows.filter(pa.array(is_doc))
    sizes, pair = from_planes(lists["sizes"], _SIZE, np.int64), from_planes(lists["links"], _PLACE, np.int64)
    parts = [from_planes(p, _PLACE, np.int64) for p in docs["windows"].to_pylist()]
    places = np.concatenate([*parts, np.zeros(0, np.int64)])
    of_text = np.fromiter(map(len, parts), np.int64, len(parts))
    found = docs.select([name.split()[0] for name in _DOC.split(", ")])
    for name, values in (("n_best", best), ("count_sum", counts)):
        by_window = _sums(values[pair], sizes)
        found = found.append_column(name, pa.array(_sums(by_window[places], of_text)))
    return found


class Alignment:
    """Aligned documents of a corpus, and how many documents hold each id pair."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        lists = rows.filter("NOT is_doc").select("block", F.posexplode(F.arrays_zip("a", "b", "n_docs")).alias("pair", "x"))
        self.listed = lists.select("block", "pair", "x.a", "x.b", "x.n_docs")

    def pairs(self) -> DataFrame:
        """a, b, count, best: documents that hold the link, and whether no other b of a has more."""
        counts = materialize(self.listed.groupBy("a", "b").agg(F.sum("n_docs").alias("count")), "pair-counts")
        top = counts.groupBy("a").agg(F.max("count").alias("top"))
        return counts.join(top, "a").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))

    def scored(self) -> DataFrame:
        """Documents with ``n_best`` (links whose count no other b of their a exceeds) and
        ``count_sum`` (over their links)."""
        answers = self.listed.join(self.pairs(), ["a", "b"]).select(F.col("block").alias("of_block"), "pair", "count", "best")
        return self.rows.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(_score, _RESULT)


def align(
    docs: DataFrame, byte_model: str, piece_model: str, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES
) -> Alignment:
    """Align a byte-level ``tokenizers`` file (A) with a SentencePiece model (B) on whole texts.

    A reads space + text, B adds its space itself; names of special tokens in a text are
    plain text. A null or empty text, or one that either side spells otherwise, has no
    tokens, groups or links, and an empty digest. Long texts are blocks of their own. Null,
    repeated keys and equal rows are rows like others; other columns are not read. An empty
    table gives an empty one. Both paths are files that all workers have.
    """
    ship_package(docs.sparkSession)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return Alignment(materialize(texts.mapInArrow(partial(_align_blocks, byte_model, piece_model, block_bytes), _ROWS), "aligned"))
