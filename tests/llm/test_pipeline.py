"""The pipeline against the plain versions of its stages."""

from __future__ import annotations

import hashlib
import os
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from raterkit.llm import mixing  # noqa: E402
from raterkit.llm.queries import PIECES, tokenizer_file  # noqa: E402
from tests.llm import brute, odd  # noqa: E402
from tests.llm.test_native import exact_brute, failed, measured, poisson, share  # noqa: E402


def plain(rows):
    """{(doc_id, ids): copies} of rows (doc_id, text, source) with distinct ids."""
    import sentencepiece

    rows = [r for r in rows if failed(*measured(r[1])) == 0]
    stay = {r[0] for r in exact_brute([r[:2] for r in rows]) if r[3]}
    rows = [r for r in rows if r[0] in stay]
    least = {d: c for d, _, c in brute.near_components([r[:2] for r in rows], 5, 80)}
    rows = [r for r in rows if least[r[0]] == r[0]]
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t)
    shares = {s: n**mixing.ALPHA for s, n in size.items()}
    rate = {s: shares[s] / sum(shares.values()) * sum(size.values()) / size[s] for s in size}
    pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(PIECES))
    out = Counter({(d, tuple(pieces.encode(t))): poisson(rate[s], share(mixing.SEED, d, hashlib.md5(t.encode()).hexdigest(), 1)) for d, t, s in rows})
    return +out


def test_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    assert all(r["round_trip"] for r in got)


def test_stages_take_odd_and_empty_tables(spark, sf_dir):
    for docs in (odd.table(spark), odd.empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            result = stage(spark, docs, sf_dir)
            assert result.schema == docs.schema
            assert (result.count() > 0) == (docs.count() > 0)
            others = [c for c in docs.columns if c not in ("doc_id", "text")]
            assert result.select(*others).distinct().join(docs.select(*others), others, "left_anti").dropna().count() == 0
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
