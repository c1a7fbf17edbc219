"""Scores of predictions: precision, recall, F1, area under the ROC curve."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from raterkit.functions.columns import above, safe_ratio, sigmoid
from raterkit.functions.vectors import at, dot
from raterkit.operators.ordering import total_before
from raterkit.operators.features import join_required
from raterkit.operators.skew import key_counts


def threshold_scores(df: DataFrame, logit: str = "logit", threshold: float = 0.5) -> DataFrame:
    """Add ``prob`` and the hard label ``pred``."""
    return df.withColumn("prob", sigmoid(F.col(logit))).withColumn("pred", above(F.col("prob"), threshold))


def precision_recall_f1(df: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "pred") -> DataFrame:
    """For class 1; a zero denominator gives 0."""
    hit, said, true = F.col("_tp"), F.col("_said"), F.col("_true")
    counts = df.groupBy(*by).agg(
        F.count_if((F.col(label) == 1) & (F.col(pred) == 1)).alias("_tp"),
        F.count_if(F.col(pred) == 1).alias("_said"),
        F.count_if(F.col(label) == 1).alias("_true"),
    )
    return counts.select(
        *by,
        safe_ratio(hit, said).alias("precision"),
        safe_ratio(hit, true).alias("recall"),
        safe_ratio(2 * hit, said + true).alias("f1"),
    )


def roc_auc(df: DataFrame, by: Sequence[str] = (), label: str = "label", prob: str = "prob") -> DataFrame:
    """Exact area under the ROC curve, ties counted half; null if there is one class.

    Rows are reduced to counts per distinct score first; the negatives below a score are
    a running total over range partitions.
    """
    by = list(by)
    keyed = df if by else df.withColumn("_all", F.lit(1))
    group = by or ["_all"]
    counts = keyed.groupBy(*group, prob).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
    )
    ranked = total_before(counts, [prob], "_neg", group, "_below")
    wins = F.col("_pos") * (F.col("_below") + F.col("_neg") / F.lit(2.0))
    sums = ranked.groupBy(*group).agg(
        F.sum(wins).alias("_wins"), F.sum("_pos").cast("double").alias("_p"), F.sum("_neg").cast("double").alias("_n")
    )
    pairs = F.nullif(F.col("_p") * F.col("_n"), F.lit(0.0))
    return sums.select(*by, (F.col("_wins") / pairs).alias("auc"))


def evaluate(
    df: DataFrame, by: Sequence[str] = ("model",), label: str = "label", prob: str = "prob", threshold: float = 0.5
) -> DataFrame:
    """precision, recall, f1 and auc per group."""
    hard = df.withColumn("pred", above(F.col(prob), threshold))
    return precision_recall_f1(hard, by, label).join(roc_auc(df, by, label, prob), list(by))


def combine_metrics(tables: Sequence[DataFrame]) -> DataFrame:
    """Metric rows of several models in one table; f1_score and f1 become one column."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    names = [F.col(c) for c in ("f1", "f1_score") if c in merged.columns]
    return merged.withColumn("f1", F.coalesce(*names)).drop("f1_score")


# ---- predictions ---------------------------------------------------------------------

def predictions_wide(
    df: DataFrame, models: Sequence[str], keys: Sequence[str] = ("comment_id", "annotator_id"), prob: str = "prob"
) -> DataFrame:
    """One column per model, one row per rating, matched by key; two scores for a rating and
    model are an error."""
    cells = df.groupBy(*keys, "model").agg(F.count(F.lit(1)).alias("_n"), F.first(prob).alias(prob))
    twice = F.concat(F.lit("two scores by model "), F.col("model"))
    once = F.when(F.col("_n") == 1, F.col(prob)).otherwise(F.raise_error(twice).cast(df.schema[prob].dataType))
    return cells.withColumn(prob, once).groupBy(*keys).pivot("model", list(models)).agg(F.first(prob))


def own_head_scores(ratings: DataFrame, texts: DataFrame, heads: DataFrame) -> DataFrame:
    """Add the logit of the rating's own annotator head: only that head is computed.

    ``texts`` is (comment_id, text), ``heads`` is (annotator_id, weights).
    """
    per_annotator = key_counts(ratings, ["annotator_id"])
    with_text = join_required(ratings, texts, "comment_id", "text")
    rows = join_required(with_text, heads, "annotator_id", "weights", per_annotator)
    return rows.withColumn("logit", dot(F.col("text"), F.col("weights"))).drop("text", "weights")


def gather_head(df: DataFrame, probs: str = "probs", head: str = "head", name: str = "prob") -> DataFrame:
    """Pick one element of an array of all heads' scores by 0-based head index."""
    return df.withColumn(name, at(F.col(probs), F.col(head)))
