"""SentencePiece encoding and decoding on the ``tokenizers`` library.

The model's protobuf is read here: pieces with scores and kinds, normaliser and trainer
settings. From them a ``tokenizers`` model is built (unigram scores, or merges ordered by
score for BPE) with byte fallback and the metaspace marker. Texts are cut where no piece
spans the cut; every distinct chunk is encoded in multithreaded batches and compared with
the original library. A difference is an error, never another result; so is a text that
the rebuilt normaliser writes otherwise. Decoding is by the pieces' bytes, and every text is
decoded again and compared.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from raterkit.llm.chunks import ChunkEncoder, joined_ranges, spans_from_cuts
from raterkit.llm.textarrays import buffer_of, groups_of
from raterkit.session import ship_package

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # kinds of the public format
_UNIGRAM, _BPE = 1, 2
_ENCODE_BYTES = 4 << 20
#: Threads of one encoding batch, in either library.
THREADS = 2


def _varint(raw: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[i]
        value |= (byte & 127) << shift
        i, shift = i + 1, shift + 7
        if byte < 128:
            return value, i


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message."""
    i = 0
    while i < len(raw):
        tag, i = _varint(raw, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(raw, i)
        else:
            if kind == 2:
                size, i = _varint(raw, i)
            else:
                size = 4 if kind == 5 else 8
            value, i = raw[i : i + size], i + size
        yield tag >> 3, value


class PieceModel:
    """What a model file says."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.raw = file.read()
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, int | bytes] = {}
        rules: dict[int, int | bytes] = {}
        for number, value in _fields(self.raw):
            if number == 1:
                one = dict(_fields(value))
                score = struct.unpack("<f", one[2])[0] if 2 in one else 0.0
                self.pieces.append((one.get(1, b"").decode(), score, one.get(3, NORMAL)))
            elif number == 2:
                trainer |= dict(_fields(value))
            elif number == 3:
                rules |= dict(_fields(value))
        self.kind = trainer.get(3, _UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.suffix_space = bool(trainer.get(24, 0))
        self.charsmap = rules.get(2, b"")
        self.dummy_prefix = bool(rules.get(3, 1))
        self.squeeze = bool(rules.get(4, 1))
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def merges(self) -> list[tuple[str, str]]:
        """Pairs that make a piece, best piece first."""
        vocab = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED)}
        found = []
        for piece, score, kind in self.pieces:
            if kind not in (NORMAL, USER_DEFINED):
                continue
            for k in range(1, len(piece)):
                left, right = piece[:k], piece[k:]
                if left in vocab and right in vocab:
                    found.append((-score, vocab[piece], vocab[left], vocab[right], left, right))
        return [(left, right) for *_, left, right in sorted(found)]

    def tokenizer(self):
        """The ``tokenizers`` model of one chunk, in which spaces are already marked."""
        from tokenizers import AddedToken, Tokenizer, models

        if self.kind == _BPE:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            model = models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        tokenizer = Tokenizer(model)
        users = [AddedToken(p, normalized=False) for p, _, kind in self.pieces if kind == USER_DEFINED]
        if users:
            tokenizer.add_tokens(users)
        return tokenizer

    def joins(self) -> np.ndarray:
        """Whether two neighbouring bytes, at a character's start, stand so inside a piece."""
        inside = np.zeros((256, 256), bool)
        inside[:, 0x80:0xC0] = True
        for piece, _, kind in self.pieces:
            if kind in (NORMAL, USER_DEFINED):
                raw = piece.replace(SPACE, " ").encode()
                inside[list(raw[:-1]), list(raw[1:])] = True
        return inside

    def piece_bytes(self) -> list[bytes]:
        out = []
        for piece, _, kind in self.pieces:
            if kind == BYTE:
                out.append(bytes([int(piece[1:-1], 16)]))
            else:
                out.append(b"" if kind == CONTROL else piece.replace(SPACE, " ").encode())
        return out


class PieceCodec:
    """Encodes and decodes batches of texts in a worker."""

    def __init__(self, path: str, threads: int = THREADS):
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        import sentencepiece

        self.model = PieceModel(path)
        if self.model.suffix_space:
            raise ValueError("models that mark spaces behind words are not supported")
        self.tokenizer = self.model.tokenizer()
        # the same model without the dummy prefix: a repeated field of a message is merged into it
        plain = self.model.raw + b"\x1a\x02\x18\x00"
        self.original = sentencepiece.SentencePieceProcessor(model_proto=plain)
        self.threads = threads
        self.library = sentencepiece.SentencePieceProcessor(model_proto=self.model.raw)
        self.inside = self.model.joins()
        self.whole = self.model.kind != _BPE
        self.chunks = ChunkEncoder(self._encode, np.uint16 if len(self.model.pieces) <= 1 << 16 else np.int32)
        pieces = self.model.piece_bytes()
        self.sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.at = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)

    def _encode(self, chunks: list[bytes]) -> list[list[int]]:
        texts = [c.decode() for c in chunks]
        rebuilt = self.tokenizer.encode_batch_fast([t.replace(" ", SPACE) for t in texts], add_special_tokens=False)
        wanted = self.original.encode(texts, num_threads=self.threads)
        found = [one.ids for one in rebuilt]
        for text, ids, other in zip(texts, found, wanted):
            if ids != other:
                raise ValueError(f"the rebuilt model encodes {text[:80]!r} as {ids[:20]}, the library as {other[:20]}")
        return found

    def normalised(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts as the model sees them, with spaces for markers."""
        raw = data.tobytes()
        marker = SPACE.encode()
        if self.model.charsmap or self.model.squeeze or marker in raw:
            from tokenizers import normalizers

            steps = [normalizers.Precompiled(self.model.charsmap)] if self.model.charsmap else []
            rule = normalizers.Sequence(steps)
            texts, prefix = [], " " if self.model.dummy_prefix else ""
            for b, e in zip(starts[:-1], starts[1:]):
                whole = raw[b:e].decode()
                text = rule.normalize_str(whole).replace(SPACE, " ")
                text = " ".join(t for t in text.split(" ") if t) if self.model.squeeze else text
                if self.library.normalize(whole).replace(SPACE, " ") != (prefix + text if text else ""):
                    raise ValueError(f"the rebuilt normaliser differs from the library on {whole[:80]!r}")
                texts.append(text.encode())
            data = np.frombuffer(b"".join(texts), np.uint8)
            starts = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        if self.model.dummy_prefix:
            filled = np.diff(starts) > 0
            data = np.insert(data, starts[:-1][filled], 0x20)
            starts = starts + np.concatenate([[0], np.cumsum(filled)])
        return data, starts

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised texts, and their number by text."""
        cut = np.zeros(len(data), bool)
        if len(data) and not self.whole:
            cut[1:] = ~self.inside[data[:-1], data[1:]]
        begins, ends, per_text = spans_from_cuts(cut, starts)
        ids, counts = self.chunks.encode(data, begins, ends)
        before = np.concatenate([[0], np.cumsum(counts)])
        last = np.cumsum(per_text)
        return ids, before[last] - before[last - per_text]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The normalised texts of ids: bytes, and starts."""
        sizes = self.sizes[ids]
        data = self.flat[joined_ranges(self.at[ids], sizes)]
        before = np.concatenate([[0], np.cumsum(sizes)])
        return data, before[np.concatenate([[0], np.cumsum(counts)])]


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """The worker's codec of a model file."""
    return PieceCodec(path)


def _equal_texts(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray) -> np.ndarray:
    same = np.diff(a_starts) == np.diff(b_starts)
    if same.all():
        differ = np.flatnonzero(a != b)
        same[np.searchsorted(a_starts, differ, "right") - 1] = False
        return same
    for i in np.flatnonzero(same):
        same[i] = np.array_equal(a[a_starts[i] : a_starts[i + 1]], b[b_starts[i] : b_starts[i + 1]])
    return same


def _encode_rows(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pieces = codec(path)
    for batch in batches:
        data, starts = buffer_of(batch.column(1))
        for i, j in groups_of(starts, _ENCODE_BYTES):
            text, ends = pieces.normalised(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
            ids, counts = pieces.encode(text, ends)
            back = _equal_texts(text, ends, *pieces.decode(ids, counts))
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i:j], pa.array(counts, pa.int64()), pa.array(back), lists],
                names=["doc_id", "n_pieces", "round_trip", "ids"],
            )


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_pieces, round_trip, ids: one row per input row, in its place.

    Ids are those of the rebuilt model, which equal the original library's for the whole text;
    ``round_trip`` tells whether they decode to the normalised text. Null and empty texts have no pieces and round trip.
    A null key and repeated rows are kept; other columns are not read. Nothing is shuffled;
    a worker holds a few megabytes of text, or one text if that is longer.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(partial(_encode_rows, model), "doc_id long, n_pieces long, round_trip boolean, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of (doc_id, ids): the normalised texts, without the dummy prefix."""
    ship_package(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode_rows, model), "doc_id long, text string")


def _decode_rows(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pieces = codec(path)
    skip = int(pieces.model.dummy_prefix)
    for batch in batches:
        lists = batch.column(1).to_pylist()
        ids = np.array([i for one in lists for i in one or []], np.int64)
        data, starts = pieces.decode(ids, np.array([len(one or []) for one in lists], np.int64))
        raw = data.tobytes()
        texts = [raw[b:e].decode(errors="replace")[skip:] for b, e in zip(starts[:-1], starts[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])
