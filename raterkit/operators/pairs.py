"""Annotators of one comment compared with each other.

Pairs are counted, never emitted: a comment with n ratings has n * (n - 1) / 2 of them,
and the label counts of the comment say how many agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from raterkit.operators.skew import salted_join


def label_counts(df: DataFrame, label: str = "label", comment: str = "comment_id") -> DataFrame:
    return df.groupBy(comment, label).agg(F.count(F.lit(1)).alias("n"))


def annotator_pairs(df: DataFrame, label: str = "label", comment: str = "comment_id") -> DataFrame:
    """Per comment: unordered pairs of ratings, and how many agree and disagree."""
    counts = label_counts(df, label, comment)
    per_comment = counts.groupBy(comment).agg(
        F.sum("n").alias("n_ratings"), F.sum(_pairs(F.col("n"))).alias("n_agree")
    )
    return per_comment.withColumn("n_pairs", _pairs(F.col("n_ratings"))).withColumn(
        "n_disagree", F.col("n_pairs") - F.col("n_agree")
    )


def _pairs(n):
    return F.floor(n * (n - 1) / 2).cast("bigint")


def pair_masks(df: DataFrame, label: str = "label", comment: str = "comment_id") -> DataFrame:
    """Per rating: partners on the same comment with the same and with another label.

    These are the row sums of the positive mask (diagonal removed) and the negative mask.
    """
    counts = label_counts(df, label, comment)
    per_comment = counts.groupBy(comment).agg(
        F.sum("n").alias("_all"), F.map_from_entries(F.collect_list(F.struct(label, "n"))).alias("_by_label")
    )
    rows = salted_join(df, per_comment, [comment], counts=per_comment.select(comment, F.col("_all").alias("n")))
    same = F.element_at("_by_label", F.col(label))
    return rows.select(*df.columns, (same - 1).alias("n_positive"), (F.col("_all") - same).alias("n_negative"))
