"""Train/test split by comment: a comment is wholly on one side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from raterkit.functions.columns import hash_below, seeded_hash
from raterkit.operators.ordering import with_index

SPLIT_SEED = 36  # fixed value


def split_by_hash(df: DataFrame, test_share: float, key: str = "comment_id", seed: int = SPLIT_SEED) -> DataFrame:
    """Add ``part`` from a seeded hash of the key: no shuffle, stable under new data.

    The test share holds on average; use ``split_exact`` for an exact size.
    """
    return df.withColumn("part", F.when(hash_below(seeded_hash(F.col(key), seed), test_share), "test").otherwise("train"))


def split_exact(comments: DataFrame, test_share: float, key: str = "comment_id", seed: int = SPLIT_SEED) -> DataFrame:
    """(key, part) for distinct comments: the first ceil(share * n) in hash order are test."""
    distinct = comments.select(key).dropna().distinct().withColumn("_hash", seeded_hash(F.col(key), seed))
    ranked = with_index(distinct, ["_hash", key], "_rank")
    size = F.ceil(ranked.agg(F.count(F.lit(1)).cast("double")).scalar() * F.lit(float(test_share)))
    return ranked.select(key, F.when(F.col("_rank") < size, "test").otherwise("train").alias("part"))


def split_summary(df: DataFrame, key: str = "comment_id", part: str = "part") -> DataFrame:
    """Comments and rows per part."""
    per_comment = df.groupBy(part, key).agg(F.count(F.lit(1)).alias("_n"))
    return per_comment.groupBy(part).agg(
        F.count(key).alias("n_comments"), F.sum("_n").alias("n_rows")
    )


def drop_last_single(df: DataFrame, order: Sequence[str], batch_size: int = 32) -> DataFrame:
    """Drop the last row in ``order`` if it would be alone in its batch.

    One pass finds the row count and the last row; no sort.
    """
    last = df.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct(*order)).alias("last")
    ).select(F.when(F.col("n") % batch_size == 1, F.col("last")).alias("lone"))
    return df.filter(~F.struct(*order).eqNullSafe(last.scalar()))
