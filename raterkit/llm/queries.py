"""One query per corpus operator, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from raterkit.llm import aligning, exact, forest, jaccard, lm, merkle, mixing, pii, quality, sentencepieces, suffix, tokenids, urls
from raterkit.llm.common import table
from raterkit.session import materialize

Query = Callable[[SparkSession, str], DataFrame]

#: The joins' production rules, what a leaf of the manifest holds, and the files of the public tokenizers.
SHINGLE_WORDS, SHINGLE_PERCENT = 4, 85
FOREST_WORDS, FOREST_PERCENT = 3, 85
MANIFEST_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; all workers have it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = materialize(quality.ledger(table(spark, sf_dir, "documents")), "quality-ledger")
    return quality.apply_policy(entries)


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.train_and_score(table(spark, sf_dir, "documents"))


def op4_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    proposals = materialize(pii.proposals_of(table(spark, sf_dir, "documents")), "pii-proposals")
    return pii.describe(proposals, pii.fit(proposals))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.match(table(spark, sf_dir, "pages"), urls.rule_table(spark))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.near_copies(table(spark, sf_dir, "documents"), SHINGLE_WORDS, SHINGLE_PERCENT)
    return found.select("doc_id", "n_shingles", "component_id")


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    files = tokenids.write_tokens(documents, tokenizer_file(BYTE_BPE))
    return files.read(tokenids.keys_of(documents))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(table(spark, sf_dir, "documents"), tokenizer_file(PIECES))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.decide(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligning.align(table(spark, sf_dir, "documents"), tokenizer_file(BYTE_BPE), tokenizer_file(PIECES)).scored()


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    longer = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    found = merkle.audit(table(spark, sf_dir, "documents"), "doc_id", "lang", MANIFEST_FIELDS, longer, tampered)
    proof = merkle.proof_digest(F.col("path")).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


def op13_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = forest.near_copies(table(spark, sf_dir, "documents"), FOREST_WORDS, FOREST_PERCENT)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        op1_suffix_dedup,
        op2_quality_rules,
        op3_kneser_ney,
        op4_poisson_mix,
        op5_pii_spans,
        op6_url_rules,
        op7_jaccard_join,
        op8_token_ids,
        op9_sentencepiece,
        op10_exact_dedup,
        op11_token_alignment,
        op12_merkle_manifest,
        op13_minhash_forest,
    )
}
