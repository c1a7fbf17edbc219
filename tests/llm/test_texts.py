"""Operators that work on whole texts in NumPy inside tasks."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from raterkit.llm import jaccard, lm, queries, sentencepieces, shared, suffix, textarrays, tokenids
from raterkit.llm.components import components
from raterkit.llm.store import build
from tests.llm import brute, odd


def shorter():
    """The odd texts; brute force on the very long ones takes long, so there is one."""
    return odd.texts()


def test_words_as_python_sees_them():
    texts = [t for _, t in odd.texts()] + ["A b\x0bC\x1cd\x85e", "\x00 \x7f"]
    data, starts = textarrays.buffer_of(pa.array(texts))
    hashes, counts = textarrays.word_hashes(data, starts)
    want = [w for t in texts for w in brute.words(t)]
    assert counts.tolist() == [len(brute.words(t)) for t in texts]
    seen = {}
    assert all(seen.setdefault(h, w) == w for h, w in zip(hashes.tolist(), want))
    assert len(set(hashes.tolist())) == len(set(want))


def test_slices_do_not_matter(monkeypatch):
    data, starts = textarrays.buffer_of(pa.array([t for _, t in odd.texts()]))
    want = textarrays.word_hashes(data, starts)
    at = suffix.anchors(data, starts)
    for size in (97, 1000):
        monkeypatch.setattr(textarrays, "SLICE", size)
        monkeypatch.setattr(suffix, "SLICE", size)
        assert all(np.array_equal(a, b) for a, b in zip(textarrays.word_hashes(data, starts), want))
        assert all(np.array_equal(a, b) for a, b in zip(suffix.anchors(data, starts), at))


def test_planes():
    values = np.array([0, 1, 255, 256, (1 << 40) - 1], np.uint64)
    assert textarrays.from_planes(textarrays.to_planes(values, 5), 5).tolist() == values.tolist()


@pytest.mark.parametrize("block", [200, 2_000_000])
def test_shared_keys(spark, monkeypatch, block):
    rows = [(d, t) for d, t in odd.texts() if d is not None and d != 5]
    monkeypatch.setattr(shared, "BLOCK_KEYS", block)
    table = spark.createDataFrame(rows, "key long, text string").repartition(3)

    def keys_of(data, starts):
        return textarrays.shingles(data, starts, 3)

    got = {r["key"]: r["value"] for r in shared.shared_keys(table, keys_of).collect()}
    sets = {d: brute.shingle_set(t, 3) for d, t in rows}
    for d, own in sets.items():
        n = sum(any(g in s for e, s in sets.items() if e != d) for g in own)
        assert (d in got) == (n > 0)
        if n:
            assert sum(bin(b).count("1") for b in got[d]) == n


def test_store(spark):
    rows = [(k * 7919 - 50_000, bytes([k % 256]) * (k % 5)) for k in range(100)]
    store = build(spark.createDataFrame(rows, "key long, value binary"), "store")
    assert store.get(np.array([k for k, _ in rows] + [1])) == [v for _, v in rows] + [None]
    assert build(spark.createDataFrame([], "key long, value binary"), "store").get(np.array([1])) == [None]


def test_components(spark):
    rnd = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(100 + rnd.randint(0, 50), 100 + rnd.randint(0, 50)) for _ in range(40)] + [(500, k) for k in range(501, 560)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {n: n for e in links for n in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert got == root


@pytest.mark.parametrize("words, percent", [(4, 85), (5, 80), (1, 30)])
def test_near_copies(spark, words, percent):
    got = jaccard.near_copies(odd.table(spark), words, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted([tuple(r) for r in got], key=repr) == sorted(brute.near_components(shorter(), words, percent), key=repr)


def many_near():
    """Groups in which not all members are linked, chains, and short texts."""
    rnd = random.Random(8)
    rows, n = [], 0
    for g in range(6):
        base = [f"w{g}x{i}" for i in range(60)]
        for _ in range(25):
            w = list(base)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(60)] = f"v{rnd.randint(0, 3)}"
            rows.append((n := n + 1, " ".join(w)))
    for g in range(40):
        rows.append((n := n + 1, " ".join(f"c{i}" for i in range(2 * g, 2 * g + 40))))
    return rows + [(n + 1 + k, " ".join(["a"] * (k % 5))) for k in range(10)]


@pytest.mark.parametrize("rounds", [0, 2])
def test_near_copies_in_chains_and_groups(spark, monkeypatch, rounds):
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", rounds)
    rows = many_near()
    got = jaccard.near_copies(odd.table(spark, rows), 4, 85).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(tuple(r) for r in got) == sorted(brute.near_components(rows, 4, 85))


def test_near_copy_stage(spark):
    docs = odd.table(spark)
    kept = jaccard.keep_one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    found = brute.near_components(odd.texts(), 5, 80)
    sizes = [sum(c == x[2] for x in found if x[1]) for *_, c in found]
    want = {(d, c) for d, _, c in found if d == c}
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(set(got), key=repr) == sorted({d for d, _ in want}, key=repr)
    assert len(sizes) and all(got.count(d) == 1 for d in got if d is not None)
    assert jaccard.near_copies(odd.empty(spark), 5, 80).count() == 0
    assert jaccard.keep_one_of_each(odd.empty(spark), 5, 80).count() == 0


def as_repeats(rows):
    return [((-(1 << 63) if d is None else d), t) for d, t in rows]


@pytest.mark.parametrize("block", [1000, 12 << 20])
def test_suffix_dedup(spark, monkeypatch, block):
    monkeypatch.setattr(suffix, "BLOCK_BYTES", block)
    got = suffix.remove_repeats(odd.table(spark)).collect()
    want = [(None if d == -(1 << 63) else d, *rest) for d, *rest in brute.removed_spans(as_repeats(odd.texts()))]
    found = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert all(len(r["edges"]) == 2 * r["n_spans"] for r in got)
    assert suffix.remove_repeats(odd.empty(spark)).count() == 0


def test_window_order():
    rnd = random.Random(1)
    base = [bytes(rnd.choice(b"ab c") for _ in range(300)) for _ in range(3)]
    text = b"".join(rnd.choice(base)[rnd.randint(0, 200) :][: rnd.randint(1, 160)] for _ in range(100)) + b"a" * 300
    data = np.frombuffer(text, np.uint8)
    begins = np.arange(len(data) - suffix.WINDOW + 1)
    order, equal = suffix.sort_windows(data, begins)
    windows = [text[i : i + suffix.WINDOW] for i in order]
    assert windows == sorted(windows)
    assert all((equal[i] == equal[i - 1]) == (windows[i] == windows[i - 1]) for i in range(1, len(windows)))


@pytest.mark.parametrize("block", [50, 4_000_000])
def test_kneser_ney(spark, monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", block)
    got = lm.train_and_score(odd.table(spark)).collect()
    want = brute.kneser_ney(odd.texts())
    for a, b in zip(sorted((tuple(r) for r in got), key=lambda r: repr(r[:4])), sorted(want, key=lambda r: repr(r[:4]))):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_kneser_ney_sums_to_one(spark):
    model = lm.train(odd.table(spark, [(i, "a b a c a b d" if i % 2 else "b c e") for i in range(9)]).select("text"))
    texts = ["a", "b", "c", "d", "e"]
    data, starts = textarrays.buffer_of(pa.array(texts))
    words = np.append(textarrays.word_hashes(data, starts)[0] >> np.uint64(8), [np.uint64(lm.END), np.uint64(12345)])
    _, follow = model.words(words)
    low = model.lowest(follow)
    assert low.sum() == pytest.approx(1)
    for first in range(len(words)):
        logs = model.log10(np.full(len(words), first), np.arange(len(words)), words, low)
        assert (10**logs).sum() == pytest.approx(1)


def test_kneser_ney_without_training_rows(spark):
    assert lm.train_and_score(odd.empty(spark)).count() == 0
    held = next(i for i in range(100) if brute.held_out(i))
    (row,) = lm.train_and_score(odd.table(spark, [(held, "a b")])).collect()
    assert row["train_tokens"] == row["n_known"] == 0 and row["score"] == 0


def test_held_out_text_is_predicted_better_than_by_single_words(spark, sf_dir):
    rows = lm.train_and_score(spark.read.parquet(f"{sf_dir}/documents.parquet")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_token_files(spark):
    model = queries.tokenizer_file(queries.BYTE_BPE)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(model)
    tokenizer.encode_special_tokens = True
    docs = odd.table(spark)
    files = tokenids.write_tokens(docs, model)
    got = files.read(tokenids.keys_of(docs)).orderBy("start").collect()
    start, by_start = 0, {}
    for r in got:
        by_start.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
        assert r["start"] == start
        start += r["n_tokens"]
    assert [r["doc_id"] for r in got] == sorted([d for d, _ in odd.texts()], key=lambda d: (d is not None, d or 0))
    want = {}
    for d, t in odd.texts():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.setdefault(d, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert {d: sorted(v) for d, v in by_start.items()} == {d: sorted(v) for d, v in want.items()}
    foreign = spark.range(10_000, 30_000).withColumnRenamed("id", "doc_id")
    assert files.locate(foreign).count() <= 2  # a 32-bit fingerprint
    none = odd.empty(spark)
    assert tokenids.write_tokens(none, model).read(tokenids.keys_of(none)).count() == 0


def test_token_files_of_an_id_in_many_shards(spark):
    model = queries.tokenizer_file(queries.BYTE_BPE)
    docs = odd.table(spark, [(None if i % 3 == 0 else i, f"text {i}") for i in range(900)])
    files = tokenids.write_tokens(docs, model)
    assert files.locate(tokenids.keys_of(docs)).filter(F.col("doc_id") == tokenids.NULL_KEY).count() > 1
    got = files.read(tokenids.keys_of(docs)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 300 + [i for i in range(900) if i % 3]
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(model)
    crcs = [zlib.crc32(np.array([*tokenizer.encode(f"text {i}", add_special_tokens=False).ids, 0], "<u4").tobytes()) for i in range(900)]
    assert sorted(r["ids_crc32"] for r in got) == sorted(crcs)


def test_minimal_perfect_hash():
    keys = np.random.default_rng(3).choice(1 << 40, 20_000, replace=False).astype(np.int64)
    bits, sizes = tokenids.hash_levels(keys)
    ranks = np.concatenate([[0], np.cumsum(bits.reshape(-1, 64).sum(1))])[:-1]
    assert sorted(tokenids.slots_of(keys, np.packbits(bits), ranks, sizes).tolist()) == list(range(len(keys)))


def tricky(n=1500):
    rnd = random.Random(3)
    parts = ["a", "B", " ", "  ", "\n", "\t", " \n", "'s", "'", "'ll", "é", "É", "1", "23", ",", ".", "!?", "-", "日本", "▁", "<s>", "<|endoftext|>", "👍", " the", "don't", "́", "_", "$", "\x1c", "\x00", "\r\n", "    "]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(n)] + [t or "" for _, t in odd.texts()]


def test_chunked_byte_bpe_is_exact():
    from tokenizers import Tokenizer

    path = queries.tokenizer_file(queries.BYTE_BPE)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    texts = tricky()
    ids, counts = tokenids.encode_texts(tokenids.byte_encoder(path), *textarrays.buffer_of(pa.array(texts)))
    ends = np.cumsum(counts)
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids[e - c : e].tolist() for e, c in zip(ends, counts)] == want


def added_texts():
    return [*tricky(), "a b<|endoftext|>c", "a  ", "b", "x  <|endoftext|>  y<|endoftext|><|endoftext|>", "<|endoftext|", ">", "<|endof<|endoftext|>text|>", "<|endoftext|>"]


def test_chunked_byte_bpe_is_that_of_the_file_as_loaded():
    from tokenizers import Tokenizer

    path = queries.tokenizer_file(queries.BYTE_BPE)
    texts = added_texts()
    ids, counts = tokenids.encode_texts(tokenids.byte_encoder(path, literal=False), *textarrays.buffer_of(pa.array(texts)))
    ends = np.cumsum(counts)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [ids[e - c : e].tolist() for e, c in zip(ends, counts)] == want
    assert [64, 275, 50256, 66] in want


@pytest.mark.parametrize("flags", [{}, {"lstrip": True}, {"rstrip": True}, {"single_word": True}, {"normalized": True}])
def test_other_added_tokens(tmp_path, flags):
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_file(queries.BYTE_BPE))
    tokenizer.add_tokens([AddedToken("the", **({"normalized": False} | flags)), AddedToken("the do", normalized=False)])
    path = str(tmp_path / "added.json")
    tokenizer.save(path)
    texts = [*added_texts(), "the", "them the", " the dot", "a  the  b"]
    ids, counts = tokenids.encode_texts(tokenids.byte_encoder(path, literal=False), *textarrays.buffer_of(pa.array(texts)))
    ends = np.cumsum(counts)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [ids[e - c : e].tolist() for e, c in zip(ends, counts)] == want


def test_token_files_hold_the_ids_of_the_file_as_loaded(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file(queries.BYTE_BPE)
    docs = odd.table(spark, list(enumerate(["a b<|endoftext|>c", "d  <|endoftext|>", None])))
    got = tokenids.write_tokens(docs, path).read(tokenids.keys_of(docs)).orderBy("doc_id").collect()
    tokenizer = Tokenizer.from_file(path)
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in ("a b<|endoftext|>c", "d  <|endoftext|>", "")]
    assert [(r["n_tokens"], r["ids_crc32"]) for r in got] == [(len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for w in want]


def test_sentencepiece_codec_is_exact():
    import sentencepiece

    path = queries.tokenizer_file(queries.PIECES)
    texts = tricky()
    codec = sentencepieces.PieceCodec(path)
    data, starts = codec.normalised(*textarrays.buffer_of(pa.array(texts)))
    ids, counts = codec.encode(data, starts)
    ends = np.cumsum(counts)
    want = sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)
    assert [ids[e - c : e].tolist() for e, c in zip(ends, counts)] == want
    back, at = codec.decode(ids, counts)
    assert back.tobytes() == data.tobytes() and at.tolist() == starts.tolist()


def test_sentencepiece_encode_and_decode(spark):
    import sentencepiece

    path = queries.tokenizer_file(queries.PIECES)
    original = sentencepiece.SentencePieceProcessor(model_file=path)
    encoded = sentencepieces.encode(odd.table(spark), path)
    got = [(r["doc_id"], r["n_pieces"], r["round_trip"], r["ids"]) for r in encoded.collect()]
    want = [(d, len(i := original.encode(t or "")), True, i) for d, t in odd.texts()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    texts = [tuple(r) for r in sentencepieces.decode(encoded, path).collect()]
    assert sorted(texts, key=repr) == sorted(((d, t or "") for d, t in odd.texts()), key=repr)
    assert sentencepieces.encode(odd.empty(spark), path).count() == 0


def test_kept_hash_of_the_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 60").collect()]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.sha2("kept", 256)).collect()
    assert sorted(tuple(r) for r in got) == sorted((d, hashlib.sha256(k).hexdigest()) for d, *_, k in brute.removed_spans(rows))


def test_a_difference_to_the_library_is_an_error(monkeypatch):
    path = queries.tokenizer_file(queries.PIECES)
    codec = sentencepieces.PieceCodec(path)
    texts = textarrays.buffer_of(pa.array(["some text ▁ marked"]))
    codec.encode(*codec.normalised(*texts))
    rebuilt = sentencepieces.PieceModel(path)
    pieces = [p if p[0] != "▁some" else ("▁somx", *p[1:]) for p in rebuilt.pieces]
    monkeypatch.setattr(rebuilt, "pieces", pieces)
    codec.tokenizer = rebuilt.tokenizer()
    codec.chunks._forget()
    with pytest.raises(ValueError, match="rebuilt model"):
        codec.encode(*codec.normalised(*texts))
    codec.model.dummy_prefix = False
    with pytest.raises(ValueError, match="rebuilt normaliser"):
        codec.normalised(*texts)
