"""Alignment of tokenizers, the Merkle manifest, and the MinHash forest."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from raterkit.llm import aligning, forest, merkle, queries
from raterkit.llm.links import Links
from raterkit.llm.textarrays import buffer_of
from tests.llm import brute, odd
from tests.llm.test_texts import many_near, tricky

MODELS = queries.tokenizer_file(queries.BYTE_BPE), queries.tokenizer_file(queries.PIECES)


# ---- alignment -----------------------------------------------------------------------


def aligned_texts():
    rows = [(d, t if t is None or len(t) < 3000 else t[:3000]) for d, t in odd.texts()]
    return rows + [(100 + i, t) for i, t in enumerate(tricky(150)) if len(t) < 3000]


@pytest.mark.parametrize("block", [200, 4 << 20])
def test_alignment(spark, block):
    rows = aligned_texts()
    got = aligning.align(odd.table(spark, rows), *MODELS, block_bytes=block).scored().collect()
    want = brute.alignment(rows, *MODELS)
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(r["n_links"] == 0 for r in got) > 3  # nulls, empty texts and a text with the marker
    assert any(r["n_links"] > r["n_best"] > 0 for r in got)


def test_alignment_of_nothing(spark):
    assert aligning.align(odd.empty(spark), *MODELS).scored().count() == 0
    (row,) = aligning.align(odd.table(spark, [(1, None)]), *MODELS).scored().collect()
    assert tuple(row) == (1, 0, 0, 0, 0, "", 0, 0)


def test_alignment_counts_documents_not_occurrences(spark):
    found = aligning.align(odd.table(spark, [(1, "the the the"), (2, "the"), (None, "the end")]), *MODELS)
    counts = found.pairs().collect()
    assert max(r["count"] for r in counts) == 3 and all(r["best"] for r in counts if r["count"] == 3)


def test_windows_survive_equal_hashes(monkeypatch):
    """Different windows under one hash are noticed, and found under another seed."""
    texts = [t for _, t in aligned_texts()]
    plain = aligning.Aligner(*MODELS).align(*buffer_of(pa.array(texts)))
    worker, real = aligning.Aligner(*MODELS), aligning.Windows._hashes
    seeds = []

    def poor(self, *args):
        seeds.append(self.seed)
        return real(self, *args) if self.seed else np.zeros(len(args[1][0]), np.uint64)

    monkeypatch.setattr(aligning.Windows, "_hashes", poor)
    again = worker.align(*buffer_of(pa.array(texts)))
    assert set(seeds) == {0, 1}
    assert all(np.array_equal(plain[k], again[k]) for k in plain if k != "windows")


def test_windows_are_remembered(monkeypatch):
    monkeypatch.setattr(aligning, "REMEMBERED", 5)
    texts = buffer_of(pa.array([t for _, t in aligned_texts()]))
    worker = aligning.Aligner(*MODELS)
    first = worker.align(*texts)
    learned = []
    monkeypatch.setattr(aligning.Windows, "_learn", lambda self, keys, taken, real=aligning.Windows._learn: (learned.append(len(keys)), real(self, keys, taken)))
    forgotten = worker.align(*texts)
    monkeypatch.setattr(aligning, "REMEMBERED", 10**6)
    learned.clear()
    again = worker.align(*texts)
    assert all(np.array_equal(first[k], forgotten[k]) and np.array_equal(first[k], again[k]) for k in first if k != "windows")
    assert not learned


# ---- manifest ------------------------------------------------------------------------


def manifest_of(spark, rows, height=merkle.BLOCK_LEVELS):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, pos long, tree long, name string, digest string")
    seven = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = merkle.audit(docs.repartition(3), "doc_id", "lang", queries.MANIFEST_FIELDS, {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}, seven, height)
    return found.withColumn("proof", merkle.proof_digest(F.col("path")))


def presented(row):
    doc_id, source, lang, n_chars, text = row
    if doc_id is None or n_chars is None or zlib.crc32(str(doc_id).encode()) % 7:
        return row
    return doc_id, source, lang, n_chars + 1, text


def manifest_rows(sizes):
    rnd, rows = random.Random(5), []
    for lang, size in sizes.items():
        for i in range(size):
            rows.append((rnd.choice([len(rows), len(rows), None, 7]), rnd.choice(["a", None]), lang, rnd.choice([None, 5, (1 << 63) - 1]), rnd.choice([None, "", "é:x", "z" * 5000])))
    return rows + rows[:3]


@pytest.mark.parametrize("levels", [1, 2, 8])
@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 2, None: 1}, {None: 5, "": 3, "é": 1, "zh": 40, "de": 33, "=": 17}, {f"l{i}": 1 + i % 3 for i in range(11)}])
def test_manifest(spark, levels, sizes):
    rows = manifest_rows(sizes)
    got = manifest_of(spark, [(*r, 1, 2, "n", "d") for r in rows], levels).select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified").collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(brute.manifest(rows, presented), key=repr)


def test_manifest_of_nothing(spark):
    assert manifest_of(spark, []).count() == 0


def test_paths_prove_leaves(spark):
    rows = manifest_rows({"en": 300, "de": 9})
    for r in manifest_of(spark, [(*r, 1, 2, "n", "d") for r in rows]).collect():
        assert merkle.fold(r["leaf"], merkle._split(r["path"])) == r["root"]
        assert r["verified"] == (r["folded_root"] == r["root"])


# ---- forest --------------------------------------------------------------------------


def components_of(found):
    return sorted((tuple(r) for r in found.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_forest(spark, words, percent):
    found = forest.near_copies(odd.table(spark), words, percent)
    assert components_of(found) == sorted(brute.near_components(odd.texts(), words, percent), key=repr)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found.collect())
    assert forest.near_copies(odd.empty(spark), words, percent).count() == 0


@pytest.mark.parametrize("crowded, firsts", [(256, 2), (3, 0)])
def test_forest_in_chains_and_groups(spark, monkeypatch, crowded, firsts):
    """With small tiles and no first orders, regions are parted and their tiles compared."""
    monkeypatch.setattr(forest, "CROWDED", crowded)
    monkeypatch.setattr(forest, "FIRST_ORDERS", firsts)
    rows = many_near()
    assert components_of(forest.near_copies(odd.table(spark, rows), 3, 85)) == sorted(brute.near_components(rows, 3, 85), key=repr)


def test_regions_alone_find_all_links(spark, monkeypatch):
    """Without neighbours the comparison by region must find every link."""
    monkeypatch.setattr(forest, "CROWDED", 4)
    monkeypatch.setattr(forest, "_agreeing", lambda pairs, *_: pairs.limit(0).withColumn("agree", F.lit(0).cast("long")))
    rows = many_near()
    assert components_of(forest.near_copies(odd.table(spark, rows), 3, 85)) == sorted(brute.near_components(rows, 3, 85), key=repr)


def test_neighbours_across_batches():
    rnd = random.Random(2)
    step = 1 << forest.KEY_BITS * (forest.DEEPEST - forest.LEAST)
    rows = sorted((rnd.randint(0, 2), rnd.randint(0, 12) * step + rnd.randint(0, 9), i) for i in range(60))
    want = []
    for i, (tree, path, cid) in enumerate(rows):
        near = i > 0 and rows[i - 1][0] == tree and rows[i - 1][1] // step == path // step
        follows = i + 1 < len(rows) and rows[i + 1][0] == tree and rows[i + 1][1] // step == path // step
        if near or follows or i in (0, len(rows) - 1):
            want.append((tree, path, cid, rows[i - 1][2] if near else None))
    for size in (1, 2, 7, 100):
        batches = [
            pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part]), pa.array([r[2] for r in part])], names=["tree", "path", "cid"])
            for part in (rows[i : i + size] for i in range(0, len(rows), size))
        ]
        got = [tuple(r.values()) for b in forest._neighbours(iter(batches)) for r in b.to_pylist()]
        assert got == want


def test_agreement_rules_out_little():
    rng = np.random.default_rng(1)
    least = forest.agreement(85)
    assert least < 0.85 * forest.HASHES
    agree = rng.binomial(forest.HASHES, 0.85, 200_000)
    assert agree.min() >= least


def test_parities_rule_out_no_link():
    rng = np.random.default_rng(2)
    for percent in (80, 85, 100):
        for _ in range(300):
            common, left, right = rng.integers(1, 3000), rng.integers(0, 200), rng.integers(0, 200)
            values = rng.integers(0, 1 << 63, common + left + right).astype(np.uint64)
            a, b = values[: common + left], np.concatenate([values[:common], values[common + left :]])
            differ = int(np.unpackbits(forest.parity_map(a) ^ forest.parity_map(b)).sum())
            linked = 100 * common >= percent * (common + left + right)
            assert linked == (common >= forest.least_overlap(len(a) + len(b), percent))
            assert not linked or differ <= len(a) + len(b) - 2 * forest.least_overlap(len(a) + len(b), percent)


def test_links_keep_earlier_ones(spark):
    links = Links()
    pairs = lambda *p: spark.createDataFrame(list(p), "a long, b long")
    links.add(pairs((1, 2), (5, 6)))
    assert links.apart(pairs((1, 2), (2, 6), (9, 8))).count() == 2
    links.add(pairs((2, 6)))
    assert links.apart(pairs((1, 5), (9, 8))).count() == 1
    links.add(spark.createDataFrame([], "a long, b long"))
    assert {r["node"]: r["root"] for r in links.roots.collect()} == {1: 1, 2: 1, 5: 1, 6: 1}
