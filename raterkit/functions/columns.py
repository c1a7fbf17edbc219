"""Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_BITS = 60


def md5_hash(text: Column) -> Column:
    """The first 60 bits of MD5 as a number; the same in every SQL engine."""
    return F.conv(F.substring(F.md5(text.cast("string")), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def seeded_hash(key: Column, seed: int) -> Column:
    return md5_hash(F.concat(key.cast("string"), F.lit(f":{seed}")))


def pair_hash(first: Column, second: Column) -> Column:
    return md5_hash(F.concat(first.cast("string"), F.lit("/"), second.cast("string")))


def hash_below(hashed: Column, share: float) -> Column:
    """Whether a hash lies in the lowest ``share`` of all."""
    return hashed < F.lit(int(share * (1 << HASH_BITS)))


def text_digest(text: Column) -> Column:
    """SHA-256 of the whole text as 32 bytes; empty for null. Stands in for long texts as a key."""
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b""))


def replace_two(value: Column) -> Column:
    """Ordinal 0/1/2 to a binary label; null stays null."""
    return F.when(value == 2, F.lit(1)).otherwise(value)


def nonzero_flag(value: Column) -> Column:
    """1 for everything but zero; a missing score counts as 1."""
    return (~value.eqNullSafe(F.lit(0))).cast("int")


def mean_above(value: Column, cut: float) -> Column:
    """Aggregate: 1 if the mean of the non-null values is strictly above ``cut``."""
    return F.coalesce(F.avg(value.cast("double")) > F.lit(float(cut)), F.lit(False)).cast("int")


def sigmoid(logit: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-logit))


def above(probability: Column, threshold: float = 0.5) -> Column:
    """Hard label by a strict threshold."""
    return (probability > F.lit(float(threshold))).cast("int")


def bce_with_logits(logit: Column, target: Column) -> Column:
    """Cross-entropy of one prediction, stable for large logits."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def safe_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, and 0 where the denominator is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(
        top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))
    )
