"""Token ids in binary shards with a minimal perfect hash index.

Shards hold the raw ids of consecutive documents in ascending order of doc_id, in the
smallest unsigned type that fits the vocabulary, and next to them where each document
begins. The index maps a doc_id to its runs, each a shard, an ordinal and a number of
documents: a hash names the index part, the part's levels of bits name the slot, and the
slot's fingerprint tells foreign keys apart. A keyed access so reads a constant number of
places and one for each run, whatever the corpus.

    tokens/<shard>.ids      ids of the shard's documents, each with the end id
    tokens/<shard>.starts   int64, first id of each document, and the total
    index/<part>.bits, .ranks, .levels, .slots, .runs
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from raterkit.llm.common import on_groups
from raterkit.llm.chunks import ChunkEncoder, joined_ranges, spans_from_cuts
from raterkit.llm.files import map_array, write_array
from raterkit.llm.textarrays import buffer_of, groups_of, mix
from raterkit.session import materialize, scratch_path, ship_package, shuffle_slots

END_ID = 0
#: A null doc_id is filed as this key, which sorts first.
NULL_KEY = -(1 << 63)
_DIRECTORY = "doc_id long, shard int, ordinal long, n_ids long"
_ENCODE_BYTES = 4 << 20

# ---- byte-level BPE ------------------------------------------------------------------

_OTHER, _LETTER, _DIGIT, _MARK, _QUOTE, _BLANK = range(6)


def _classes() -> np.ndarray:
    kind = np.full(256, _OTHER, np.uint8)
    for b in range(0x21, 0x7F):
        kind[b] = _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _MARK
    kind[ord("'")] = _QUOTE
    kind[[0x20, *range(0x09, 0x0E)]] = _BLANK
    return kind


_CLASS = _classes()
_CUT = np.zeros((6, 6), bool)
_CUT[_LETTER, [_DIGIT, _MARK, _QUOTE, _BLANK]] = True
_CUT[_DIGIT, [_LETTER, _MARK, _QUOTE, _BLANK]] = True
_CUT[_MARK, [_LETTER, _DIGIT, _BLANK]] = True
_CUT[_QUOTE, _BLANK] = True


def word_cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where a pre-token of the byte-level pattern is sure to begin. No pre-token reaches
    over ``bounds``.

    The pattern's tokens are runs of letters, digits or marks with at most one space
    before them, contractions after a quote, and runs of blanks. A space before a
    visible ASCII character, or one whose first byte no blank has, begins a token.
    """
    n = len(data)
    kind = _CLASS[data]
    cut = np.zeros(n, bool)
    if n > 1:
        cut[1:] = _CUT[kind[:-1], kind[1:]]
        visible = ((data[1:] > 0x20) & (data[1:] < 0x7F)) | ((data[1:] >= 0xC3) & (data[1:] < 0xE1))
        space = (data[:-1] == 0x20) & visible
        space[bounds[(bounds > 0) & (bounds < n)] - 1] = False
        cut[:-1] |= space
        cut[1:] &= data[:-1] != 0x20
        # one line break or tab between visible characters stands alone
        if n > 2:
            left, mid, right = kind[:-2], kind[1:-1], kind[2:]
            seen = (left > _OTHER) & (left < _BLANK) & (right > _OTHER) & (right < _BLANK)
            cut[2:] |= seen & (mid == _BLANK) & (data[1:-1] != 0x20)
    return cut


def _byte_names() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: other bytes follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def byte_level_bytes(model: str) -> list[bytes]:
    """The bytes that each id of a byte-level ``tokenizers`` file stands for."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(model)
    byte_of = {name: b for b, name in _byte_names().items()}
    found = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        found[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return found


class ByteEncoder(ChunkEncoder):
    """``added`` finds the file's added tokens. Where they are ``plain``, each occurrence is a
    chunk of its own, as the tokenizer takes them out before anything else; otherwise (blanks
    stripped beside them, whole words, normalised) a text with one is a single chunk."""

    added: re.Pattern | None = None
    plain = True


@lru_cache(maxsize=2)
def byte_encoder(model: str, literal: bool = True) -> ByteEncoder:
    """The worker's encoder of a byte-level ``tokenizers`` file.

    ``literal`` reads the names of special tokens in a text as plain text; without it the
    file works as loaded, and they get the special tokens' ids. Shards are written without it.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(model)
    tokenizer.encode_special_tokens = literal
    tokens = [t for t in tokenizer.get_added_tokens_decoder().values() if t.content and not (literal and t.special)]
    contents = sorted((t.content.encode() for t in tokens), key=len, reverse=True)
    added = re.compile(b"|".join(map(re.escape, contents))) if contents else None
    bpe, names = tokenizer.model, _byte_names()

    def encode(chunks: list[bytes]) -> list[list[int]]:
        found: list[list[int] | None] = [None] * len(chunks)
        whole: list[int] = []
        for i, chunk in enumerate(chunks):
            text = chunk.decode()
            word = text[1:] if text[0] == " " else text
            if word.isalpha() and max(word) < "\u0250" and not (added and added.search(chunk)):  # Latin letters: surely one pre-token
                found[i] = [t.id for t in bpe.tokenize(chunk.decode("latin-1").translate(names))]
            else:
                whole.append(i)
        encoded = tokenizer.encode_batch([chunks[i].decode() for i in whole], add_special_tokens=False)
        for i, one in zip(whole, encoded):
            found[i] = one.ids
        return found

    size = tokenizer.get_vocab_size()
    encoder = ByteEncoder(encode, np.uint16 if size <= 1 << 16 else np.uint32)
    encoder.added = added
    encoder.plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in tokens)
    return encoder


def _added_spans(encoder: ByteEncoder, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Begins and ends of the added tokens in the texts, or of the texts that hold one."""
    raw = data.tobytes()
    if encoder.added is None or not encoder.added.search(raw):
        return np.zeros((0, 2), np.int64)
    places = zip(starts[:-1].tolist(), starts[1:].tolist())
    if encoder.plain:
        spans = [hit.span() for begin, end in places for hit in encoder.added.finditer(raw, begin, end)]
    else:
        spans = [(begin, end) for begin, end in places if encoder.added.search(raw, begin, end)]
    return np.array(spans, np.int64).reshape(-1, 2)


def encode_texts(encoder: ByteEncoder, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, and their number by text, without end ids."""
    added = _added_spans(encoder, data, starts)
    bounds = np.concatenate([starts, added.ravel()])
    cut = word_cuts(data, bounds)
    cut[joined_ranges(added[:, 0], added[:, 1] - added[:, 0])] = False
    cut[bounds[bounds < len(cut)]] = True
    begins, ends, per_text = spans_from_cuts(cut, starts)
    ids, counts = encoder.encode(data, begins, ends)
    before = np.concatenate([[0], np.cumsum(counts)])
    last = np.cumsum(per_text)
    return ids, before[last] - before[last - per_text]


# ---- shards --------------------------------------------------------------------------


def _write_shard(folder: str, model: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard = TaskContext.get().partitionId()
    encoder = byte_encoder(model, literal=False)
    payload, sizes, keys = [], [], []
    for batch in batches:
        data, starts = buffer_of(batch.column(1))
        keys.append(batch.column(0).to_numpy())
        for i, j in groups_of(starts, _ENCODE_BYTES):
            ids, counts = encode_texts(encoder, data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
            payload.append(np.insert(ids, np.cumsum(counts), END_ID).astype(encoder.dtype))
            sizes.append(counts + 1)
    if not keys:
        return
    sizes, keys = np.concatenate(sizes), np.concatenate(keys)
    write_array(f"{folder}/tokens/{shard}.ids", np.concatenate(payload))
    write_array(f"{folder}/tokens/{shard}.starts", np.concatenate([[0], np.cumsum(sizes)]))
    yield pa.RecordBatch.from_arrays(
        [pa.array(keys), pa.array(np.full(len(keys), shard, np.int32)), pa.array(np.arange(len(keys))), pa.array(sizes)],
        names=["doc_id", "shard", "ordinal", "n_ids"],
    )


def _key(column) -> F.Column:
    return F.coalesce(column, F.lit(NULL_KEY))


# ---- minimal perfect hash ------------------------------------------------------------

_SEEDS = mix(np.arange(64, dtype=np.uint64) + np.uint64(1 << 32))
_SLOT = np.dtype([("print", "<u4"), ("runs", "<u4"), ("first", "<i8")])
_RUN = np.dtype([("shard", "<i4"), ("ordinal", "<i8"), ("rows", "<i8")])


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys.view(np.uint64) ^ _SEEDS[level]) % np.uint64(size)).astype(np.int64)


def _prints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64) ^ _SEEDS[-1]) >> np.uint64(32)).astype(np.uint32)


def hash_levels(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of all levels and the size of each: a key owns the bit of the first level where
    no other remaining key falls on its place. Two bits a key and level; ends when all own one."""
    bits, sizes, rest = [], [], keys
    while len(rest):
        if len(sizes) == len(_SEEDS) - 1:
            raise ValueError("repeated keys")
        size = 2 * len(rest) + 63 & ~63
        place = _places(rest, len(sizes), size)
        own = np.bincount(place, minlength=size) == 1
        bits.append(own)
        sizes.append(size)
        rest = rest[~own[place]]
    return (np.concatenate(bits) if bits else np.zeros(0, bool)), np.array(sizes, np.int64)


def slots_of(keys: np.ndarray, bits: np.ndarray, ranks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 where no level owns its place. ``bits`` are packed bytes,
    ``ranks`` the owned bits before each 64."""
    found = np.full(len(keys), -1, np.int64)
    rest, offset = np.arange(len(keys)), 0
    for level, size in enumerate(sizes.tolist()):
        place = _places(keys[rest], level, size) + offset
        own = (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
        at = place[own]
        word = bits[(at >> 6 << 3)[:, None] + np.arange(8)]
        spread = np.unpackbits(np.ascontiguousarray(word), axis=1)
        inside = np.where(np.arange(64) < (at & 63)[:, None], spread, 0).sum(1)
        found[rest[own]] = ranks[at >> 6] + inside
        rest, offset = rest[~own], offset + size
    return found


def _write_index(folder: str, rows: pa.Table) -> pa.Table:
    part = rows["part"][0].as_py()
    rows = rows.sort_by([("doc_id", "ascending"), ("shard", "ascending")])
    keys, first, counts = np.unique(rows["doc_id"].to_numpy(), return_index=True, return_counts=True)
    bits, sizes = hash_levels(keys)
    packed = np.packbits(bits)
    ranks = np.concatenate([[0], np.cumsum(bits.reshape(-1, 64).sum(1))])[:-1]
    slots = np.zeros(len(keys), _SLOT)
    at = slots_of(keys, packed, ranks, sizes)
    slots["print"][at] = _prints(keys)
    slots["first"][at], slots["runs"][at] = first, counts
    runs = np.zeros(rows.num_rows, _RUN)
    for name in _RUN.names:
        runs[name] = rows[name].to_numpy()
    for name, values in (("bits", packed), ("ranks", ranks.astype(np.int64)), ("levels", sizes), ("slots", slots), ("runs", runs)):
        write_array(f"{folder}/index/{part}.{name}", values)
    return pa.table({"part": pa.array([part], pa.int32())})


def _find(folder: str, rows: pa.Table) -> pa.Table:
    """The runs of the keys of one index part."""
    part = rows["part"][0].as_py()
    keys = rows["doc_id"].to_numpy()
    bits, ranks, sizes = (map_array(f"{folder}/index/{part}.{n}", t) for n, t in (("bits", "u1"), ("ranks", "<i8"), ("levels", "<i8")))
    slots, runs = (map_array(f"{folder}/index/{part}.{n}", "u1").view(t) for n, t in (("slots", _SLOT), ("runs", _RUN)))
    at = slots_of(keys, bits, ranks, sizes)
    hit = (at >= 0) & (slots["print"][np.maximum(at, 0)] == _prints(keys))
    slot = slots[at[hit]]
    counts = slot["runs"].astype(np.int64)
    chosen = runs[joined_ranges(slot["first"], counts)]
    return pa.table({"doc_id": np.repeat(keys[hit], counts)} | {name: chosen[name].copy() for name in _RUN.names})


class TokenFiles:
    """A written corpus: its folder, the first global position of each shard, index parts."""

    def __init__(self, folder: str, bases: dict[int, int], parts: int, present: frozenset[int], dtype: str):
        self.folder, self.bases, self.parts, self.present, self.dtype = folder, bases, parts, present, dtype

    def locate(self, keys: DataFrame) -> DataFrame:
        """doc_id, shard, ordinal, rows of every run of the distinct keys (doc_id long) that are indexed."""
        part = F.pmod(F.xxhash64("doc_id"), F.lit(self.parts)).cast("int")
        known = keys.select("doc_id", part.alias("part")).filter(F.col("part").isin(sorted(self.present)))
        return known.groupBy("part").applyInArrow(on_groups(_find, self.folder), "doc_id long, shard int, ordinal long, rows long")

    def read(self, keys: DataFrame) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 of every document filed under the keys."""
        placed = self.locate(keys).repartition("shard").sortWithinPartitions("shard", "ordinal")
        return placed.mapInArrow(
            partial(_read, self.folder, self.bases, self.dtype), "doc_id long, start long, n_tokens long, ids_crc32 long"
        ).withColumn("doc_id", F.when(F.col("doc_id") != NULL_KEY, F.col("doc_id")))


def ids_at(folder: str, dtype: str, shard: int, ordinal: int) -> np.ndarray:
    """The ids of one document."""
    starts = map_array(f"{folder}/tokens/{shard}.starts", "<i8")
    return map_array(f"{folder}/tokens/{shard}.ids", dtype)[starts[ordinal] : starts[ordinal + 1]]


def _read(folder: str, bases: dict[int, int], dtype: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, shard, ordinal, rows in zip(*(c.to_pylist() for c in batch.columns)):
            starts = map_array(f"{folder}/tokens/{shard}.starts", "<i8")
            for k in range(ordinal, ordinal + rows):
                ids = ids_at(folder, dtype, shard, k)
                out.append((key, bases[shard] + int(starts[k]), len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        columns = list(zip(*out)) if out else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> TokenFiles:
    """Encode every whole text with the tokenizer file ``model`` and write shards and index.

    The file works as loaded: an added token's name in a text gets that token's id.
    ``model`` is a path that all workers have. Every document gets the end id 0; a null
    text is empty. A null doc_id is filed as the smallest key. Rows with one doc_id are in
    consecutive places, ordered by a hash of their text; where they reach over several
    shards the index holds one run for each. Other columns are not read. Texts are shuffled
    once, to put them in order.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    ship_package(spark)
    folder, parts = scratch_path(spark, "token-ids"), shuffle_slots(spark)
    rows = docs.select(_key(F.col(key)).alias("doc_id"), F.col(text).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    directory = materialize(ordered.mapInArrow(partial(_write_shard, folder, model), _DIRECTORY), "token-directory")
    totals = {r["shard"]: r["n"] for r in directory.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    bases, total = {}, 0
    for shard in sorted(totals):
        bases[shard], total = total, total + totals[shard]
    runs = directory.groupBy("doc_id", "shard").agg(F.min("ordinal").alias("ordinal"), F.count(F.lit(1)).alias("rows"))
    entries = runs.select(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part"), "doc_id", "shard", "ordinal", "rows")
    written = entries.groupBy("part").applyInArrow(on_groups(_write_index, folder), "part int").collect()
    dtype = "<u2" if Tokenizer.from_file(model).get_vocab_size() <= 1 << 16 else "<u4"
    return TokenFiles(folder, bases, parts, frozenset(r["part"] for r in written), dtype)


def keys_of(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The distinct keys under which ``docs`` are filed."""
    return docs.select(_key(F.col(key)).alias("doc_id")).distinct()
