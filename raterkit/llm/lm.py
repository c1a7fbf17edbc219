"""Interpolated modified Kneser-Ney bigram model, counted in Spark.

Words are 56-bit hashes of their lower-cased bytes. Tasks combine the words and word
pairs of some million tokens by sorting and send each part of the hash space one packed
block; parts merge the blocks and write sorted arrays to the shared folder:

    words/<part>.keys .counts                        by word
    follow/<part>.keys .counts                       words that precede, by word
    pairs/<part>.keys .counts                        by pair hash
    contexts/<part>.keys .total .one .two .more      by first word
    hot.table                                        contexts that are spread over parts

Scoring maps the arrays and looks up the distinct words and pairs of a buffer at a time.
Pairs lie in the part of their first word, except those of words so frequent that they
would make a part large (fewer than four per part can be): these lie by their own hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from raterkit.llm.common import on_groups
from raterkit.llm.files import map_array, write_array
from raterkit.llm.textarrays import buffer_of, from_planes, groups_of, mix, to_planes, word_hashes
from raterkit.session import materialize, scratch_path, ship_package, shuffle_slots

_BITS = 56
_WIDTH = _BITS // 8
#: Hashes of the two marks; no word is taken for them, as words are hashed by their bytes.
BEGIN, END = (int(x) >> 8 for x in mix(np.array([101, 202], np.uint64)))
BLOCK_TOKENS = 4_000_000
_SENT = "part int, keys binary, seconds binary, sizes binary, counts binary"
_SCHEMA = pa.schema([("part", pa.int32()), *((n, pa.binary()) for n in ("keys", "seconds", "sizes", "counts"))])


def held_out(key: Column) -> Column:
    """Whether the CRC-32 of the id's text is a multiple of 10; a null id counts as ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def token_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and its end mark, and their number."""
    words, counts = word_hashes(data, starts)
    return np.insert(words >> np.uint64(8), np.cumsum(counts), np.uint64(END)), counts + 1


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of the hash, so a sorted array is cut by a search."""
    return ((keys >> np.uint64(_BITS - 24)) * np.uint64(parts) >> np.uint64(24)).astype(np.int32)


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0x9E3779B97F4A7C15) ^ second)


def _counted(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        values = np.sort(values)
    else:
        order = np.argsort(values, kind="stable")
        values, weights = values[order], weights[order]
    head = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    if weights is None:
        counts = np.diff(np.append(head, len(values)))
    else:
        counts = np.add.reduceat(weights, head) if len(head) else weights
    return values[head], counts.astype(np.int64)


def _row(part: int, **values) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"part": part, **values}], _SCHEMA)


def _by_part(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b > a:
            yield int(part[a]), slice(a, b)


def _token_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and text sizes of some million tokens at a time."""
    hashes, sizes, total = [], [], 0
    for batch in batches:
        data, starts = buffer_of(batch.column(0))
        for i, j in groups_of(starts):
            h, c = token_hashes(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
            hashes.append(h)
            sizes.append(c)
            total += len(h)
            if total >= BLOCK_TOKENS:
                yield np.concatenate(hashes), np.concatenate(sizes)
                hashes, sizes, total = [], [], 0
    if total:
        yield np.concatenate(hashes), np.concatenate(sizes)


# ---- words ---------------------------------------------------------------------------


def _send_words(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for hashes, _ in _token_blocks(batches):
        keys, counts = _counted(hashes)
        for part, s in _by_part(part_of(keys, parts)):
            yield _row(part, keys=to_planes(keys[s], _WIDTH), counts=counts[s].astype("<u4").tobytes())


def _merge_counts(folder: str, name: str, top: int, rows: pa.Table) -> pa.Table:
    """Write the part's words and counts; return its totals and its ``top`` most frequent."""
    part = rows["part"][0].as_py()
    rows = rows.to_pylist()
    keys = np.concatenate([from_planes(r["keys"], _WIDTH) for r in rows])
    keys, counts = _counted(keys, np.concatenate([np.frombuffer(r["counts"], "<u4") for r in rows]).astype(np.int64))
    write_array(f"{folder}/{name}/{part}.keys", keys)
    write_array(f"{folder}/{name}/{part}.counts", counts)
    best = np.argsort(-counts, kind="stable")[:top]
    number = [int((counts == k).sum()) for k in range(1, 5)]
    return pa.table(
        {
            "part": pa.array([part], pa.int32()),
            "tokens": [int(counts.sum())],
            "types": [len(counts)],
            **{f"n{k + 1}": [number[k]] for k in range(4)},
            "hot": pa.array([keys[best].astype(np.int64).tolist()], pa.list_(pa.int64())),
            "hot_counts": pa.array([counts[best].tolist()], pa.list_(pa.int64())),
        }
    )


_TOTALS = "part int, tokens long, types long, n1 long, n2 long, n3 long, n4 long, hot array<long>, hot_counts array<long>"


# ---- pairs ---------------------------------------------------------------------------


def _send_pairs(parts: int, hot: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for hashes, sizes in _token_blocks(batches):
        words, ranks = np.unique(np.append(hashes, np.uint64(BEGIN)), return_inverse=True)
        second = ranks[:-1]
        first = np.concatenate([ranks[-1:], second[:-1]])
        first[np.cumsum(sizes)[:-1]] = ranks[-1]
        pairs, counts = _counted(first.astype(np.int64) * len(words) + second)
        first, second = words[pairs // len(words)], words[pairs % len(words)]
        spread = np.isin(first, hot)
        part = np.where(spread, part_of(pair_key(first, second) >> np.uint64(8), parts), part_of(first, parts))
        order = np.argsort(part, kind="stable")
        first, second, counts, part = first[order], second[order], counts[order], part[order]
        for p, s in _by_part(part):
            f = first[s]
            head = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
            yield _row(
                p,
                keys=to_planes(f[head], _WIDTH),
                sizes=np.diff(np.append(head, len(f))).astype("<u4").tobytes(),
                seconds=to_planes(second[s], _WIDTH),
                counts=to_planes(counts[s].astype("<u4"), 4),
            )


def _small(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.min_scalar_type(int(counts.max())) if len(counts) else np.uint8)


def _merge_pairs(folder: str, parts: int, hot: np.ndarray, rows: pa.Table) -> pa.Table:
    """Write the part's pairs and contexts; return numbers, spread contexts and the
    partial numbers of distinct predecessors, packed for the part of the second word."""
    part = rows["part"][0].as_py()
    rows = rows.to_pylist()
    first = np.concatenate([np.repeat(from_planes(r["keys"], _WIDTH), np.frombuffer(r["sizes"], "<u4")) for r in rows])
    second = np.concatenate([from_planes(r["seconds"], _WIDTH) for r in rows])
    counts = np.concatenate([from_planes(r["counts"], 4, "<u4") for r in rows]).astype(np.int64)
    keys = pair_key(first, second)
    order = np.argsort(keys)
    keys = keys[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.add.reduceat(counts[order], head)
    first, second = first[order[head]], second[order[head]]
    small = _small(counts)
    write_array(f"{folder}/pairs/{part}.keys", keys[head])
    write_array(f"{folder}/pairs/{part}.counts", small)

    order = np.argsort(first, kind="stable")
    by = first[order]
    head = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
    sums = {"total": np.add.reduceat(counts[order], head)}
    for name, is_it in (("one", counts == 1), ("two", counts == 2), ("more", counts > 2)):
        sums[name] = np.add.reduceat(is_it[order].astype(np.int64), head)
    words = by[head]
    spread = np.isin(words, hot)
    write_array(f"{folder}/contexts/{part}.keys", words[~spread])
    for name, values in sums.items():
        write_array(f"{folder}/contexts/{part}.{name}", values[~spread])
    partial_contexts = np.stack([words[spread].astype(np.int64), *(v[spread] for v in sums.values())], 1)

    follows, number = _counted(second)
    out = []
    for p, s in _by_part(part_of(follows, parts)):
        out.append({"part": p, "keys": to_planes(follows[s], _WIDTH), "counts": number[s].astype("<u4").tobytes()})
    facts = {
        "numbers": np.array([len(counts), *((counts == k).sum() for k in range(1, 5))], np.int64).tobytes(),
        "contexts": partial_contexts.tobytes(),
        "width": small.dtype.str,
        "pairs_part": part,
    }
    return pa.Table.from_pylist([*out, facts], _MERGED)


_MERGED = pa.schema(
    [("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("numbers", pa.binary()), ("contexts", pa.binary()), ("width", pa.string()), ("pairs_part", pa.int32())]
)
_MERGED_DDL = "part int, keys binary, counts binary, numbers binary, contexts binary, width string, pairs_part int"


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of items seen 1, 2, 3 and 4 times.

    Where a number is missing, as in tiny corpora, the plain discount or one half serves.
    """
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    raw = (1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else y, 3 - 4 * y * n4 / n3 if n3 else y)
    return tuple(min(max(d, 0.0), k) for k, d in enumerate(raw, 1))


class Model:
    """Where the arrays are, and the numbers every worker needs."""

    def __init__(self, folder, parts, tokens, types, hot, pair_discounts, follow_discounts, follows, widths, word_parts, follow_parts, free):
        self.folder, self.parts, self.tokens, self.types = folder, parts, tokens, types
        self.hot, self.pair_discounts, self.follow_discounts = hot, pair_discounts, follow_discounts
        #: distinct pairs; share of the lowest order that goes to the uniform distribution
        self.follows, self.free = follows, free
        self.widths, self.word_parts, self.follow_parts = widths, word_parts, follow_parts

    def _look_up(self, name: str, keys: np.ndarray, part: np.ndarray, fields: dict[str, str], present) -> list[np.ndarray]:
        """Values of the keys in the sorted arrays, 0 where there are none."""
        out = [np.zeros(len(keys), np.int64) for _ in fields]
        order = np.lexsort((keys, part))
        for p, s in _by_part(part[order]):
            if p not in present:
                continue
            known = map_array(f"{self.folder}/{name}/{p}.keys", "<u8")
            if not len(known):
                continue
            wanted = keys[order[s]]
            at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            hit = np.flatnonzero(known[at] == wanted)
            for values, (field, dtype) in zip(out, fields.items()):
                values[order[s][hit]] = map_array(f"{self.folder}/{name}/{p}.{field}", dtype or self.widths[p])[at[hit]]
        return out

    def words(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each word occurs, and after how many different words."""
        part = part_of(keys, self.parts)
        (counts,) = self._look_up("words", keys, part, {"counts": "<i8"}, self.word_parts)
        (follow,) = self._look_up("follow", keys, part, {"counts": "<i8"}, self.follow_parts)
        return counts, follow

    def contexts(self, keys: np.ndarray) -> list[np.ndarray]:
        """Total, and number of different words seen once, twice and more often after each word."""
        found = self._look_up(
            "contexts", keys, part_of(keys, self.parts), dict.fromkeys(("total", "one", "two", "more"), "<i8"), self.widths
        )
        spread = _hot_contexts(self.folder)
        if len(spread):
            at = np.minimum(np.searchsorted(spread[:, 0].view(np.uint64), keys), len(spread) - 1)
            hit = spread[at, 0].view(np.uint64) == keys
            for k in range(4):
                found[k][hit] = spread[at[hit], k + 1]
        return found

    def pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        keys = pair_key(first, second)
        part = np.where(np.isin(first, self.hot), part_of(keys >> np.uint64(8), self.parts), part_of(first, self.parts))
        return self._look_up("pairs", keys, part, {"counts": ""}, self.widths)[0]

    def lowest(self, follow: np.ndarray) -> np.ndarray:
        """Probability of words by the number of different words before them; of an unknown
        word at 0. All known words and one unknown sum to 1."""
        uniform = self.free / (self.types + 1)
        return _cut(follow, self.follow_discounts) / max(self.follows, 1) + uniform

    def log10(self, ranks_first: np.ndarray, ranks_second: np.ndarray, words: np.ndarray, low: np.ndarray) -> np.ndarray:
        """log10 probabilities of pairs, given as ranks in ``words``."""
        total, one, two, more = self.contexts(words)
        d1, d2, d3 = self.pair_discounts
        seen = np.maximum(total, 1)
        back = np.where(total > 0, (d1 * one + d2 * two + d3 * more) / seen, 1.0)
        count = self.pairs(words[ranks_first], words[ranks_second])
        p = _cut(count, self.pair_discounts) / seen[ranks_first] + back[ranks_first] * low[ranks_second]
        return np.log10(p)


@lru_cache(maxsize=4)
def _hot_contexts(folder: str) -> np.ndarray:
    raw = map_array(f"{folder}/hot.table", "<i8")
    return np.array(raw).reshape(-1, 5)


def _cut(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """Counts less their discount."""
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3)], 0.0)


def train(texts: DataFrame) -> Model:
    """Count the (text string) rows and write the model; each row is one sequence.

    Null texts are empty and count their end mark. The driver holds one row of numbers per
    part and the counts of the words that are spread.
    """
    spark = texts.sparkSession
    ship_package(spark)
    folder, parts = scratch_path(spark, "kneser-ney"), shuffle_slots(spark)
    texts = texts.select("text")
    sent = texts.mapInArrow(partial(_send_words, parts), _SENT)
    totals = sent.groupBy("part").applyInArrow(on_groups(_merge_counts, folder, "words", 4), _TOTALS).collect()
    tokens, types = sum(r["tokens"] for r in totals), sum(r["types"] for r in totals)
    frequent = [k for r in totals for k, n in zip(r["hot"], r["hot_counts"]) if n * 4 * parts > tokens]
    hot = np.sort(np.array([*frequent, BEGIN], np.uint64))

    sent = texts.mapInArrow(partial(_send_pairs, parts, hot), _SENT)
    merged = materialize(sent.groupBy("part").applyInArrow(on_groups(_merge_pairs, folder, parts, hot), _MERGED_DDL), "pair-facts")
    facts = merged.filter("numbers IS NOT NULL").select("numbers", "contexts", "width", "pairs_part").collect()
    numbers = np.sum([np.frombuffer(r["numbers"], np.int64) for r in facts], 0) if facts else np.zeros(5, np.int64)
    spread = np.concatenate([np.frombuffer(r["contexts"], np.int64).reshape(-1, 5) for r in facts] or [np.zeros((0, 5), np.int64)])
    words, at = np.unique(spread[:, 0], return_inverse=True)
    sums = np.zeros((len(words), 4), np.int64)
    np.add.at(sums, at, spread[:, 1:])
    write_array(f"{folder}/hot.table", np.column_stack([words, sums]).reshape(-1))
    partial_follows = merged.filter("keys IS NOT NULL").select("part", "keys", "counts")
    follow = partial_follows.groupBy("part").applyInArrow(on_groups(_merge_counts, folder, "follow", 0), _TOTALS).collect()
    seen = [sum(r[f"n{k}"] for r in follow) for k in range(1, 5)]
    kinds = sum(r["types"] for r in follow)
    d = discounts(seen)
    follows = int(numbers[0])
    free = (d[0] * seen[0] + d[1] * seen[1] + d[2] * (kinds - seen[0] - seen[1])) / follows if follows else 1.0
    return Model(
        folder, parts, tokens, types, hot, discounts(numbers[1:].tolist()), d, follows,
        {r["pairs_part"]: r["width"] for r in facts}, frozenset(r["part"] for r in totals), frozenset(r["part"] for r in follow), free,
    )


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    log_all = np.log10(model.tokens + 0.1 * (model.types + 1))
    for batch in batches:
        data, starts = buffer_of(batch.column(2))
        for i, j in groups_of(starts):
            hashes, sizes = token_hashes(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
            words, ranks = np.unique(np.append(hashes, np.uint64(BEGIN)), return_inverse=True)
            counts, follow = model.words(words)
            second, heads = ranks[:-1], np.cumsum(sizes) - sizes
            first = np.concatenate([ranks[-1:], second[:-1]])
            first[heads] = ranks[-1]
            codes, at = np.unique(first * len(words) + second, return_inverse=True)
            logs = model.log10(codes // len(words), codes % len(words), words, model.lowest(follow))
            base = np.log10(counts + 0.1) - log_all
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[i:j],
                    batch.column(1)[i:j],
                    pa.array(sizes),
                    pa.array(np.add.reduceat((counts > 0)[second].astype(np.int64), heads)),
                    pa.array(np.full(j - i, model.tokens)),
                    pa.array(np.add.reduceat(base[second], heads)),
                    pa.array(np.add.reduceat(logs[at], heads)),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    ``score`` is the log10 probability of the whole text and its end; ``base_score`` that
    of single words with 0.1 added to each count. Null and empty texts are one end mark.
    Repeated rows and null ids are kept, other columns not read. Perplexity is
    10 ** (-score / n_tokens).
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(partial(_score, model), _SCORES)


def train_and_score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Learn from the documents that are not held out, and score all."""
    return score(docs, train(docs.filter(~held_out(F.col(key))).select(F.col(text).alias("text"))), key, text)
