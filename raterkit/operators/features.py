"""Demographic features: flags, one-hot blocks, multi-hot lists, standardised vectors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from raterkit.operators.ordering import with_index
from raterkit.operators.skew import key_counts, salted_join
from raterkit.session import materialize

SINGLE_VALUED = [  # fixed values: order of the one-hot blocks
    "gender",
    "identify_as_transgender",
    "education",
    "age_range",
    "lgbtq_status",
    "political_affilation",
    "is_parent",
    "religion_important",
]
FLAG_RANGE = ("annotator_gender_men", "annotator_sexuality_other")  # fixed values: first and last flag column


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last``, both included, in schema order."""
    names = df.columns
    return names[names.index(first) : names.index(last) + 1]


def multi_hot_range(
    df: DataFrame, first: str = FLAG_RANGE[0], last: str = FLAG_RANGE[1], name: str = "socio"
) -> DataFrame:
    """The contiguous flag columns as one float array."""
    flags = [F.col(f"`{c}`").cast("float") for c in column_range(df, first, last)]
    return df.withColumn(name, F.array(*flags))


# ---- vocabularies --------------------------------------------------------------------

def single_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (column, value): distinct non-null values of each column, in one pass."""
    stacked = F.explode(
        F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    )
    return df.select(stacked.alias("v")).select("v.*").filter(F.col("value").isNotNull()).distinct()


def delimited_values(df: DataFrame, column: str, sep: str = ",") -> DataFrame:
    """Rows (column, value): distinct items of a delimited string; items are not trimmed."""
    items = F.explode(split_exactly(F.col(column), sep))
    return (
        df.select(F.lit(column).alias("column"), items.alias("value")).filter(F.col("value") != "").distinct()
    )


def split_exactly(text: Column, sep: str = ",") -> Column:
    return F.split(text, f"\\Q{sep}\\E")


def vocabulary(df: DataFrame, columns: Sequence[str], delimited: str | None = None) -> DataFrame:
    """(block, value, position): every feature value with its place in the vector.

    Blocks in list order, the delimited column last; values sorted inside a block. It is
    a table, so there may be any number of values.
    """
    order = [*columns, delimited] if delimited else list(columns)
    found = [single_values(df, columns)] if columns else []
    found += [delimited_values(df, delimited)] if delimited else []
    values = reduce(DataFrame.union, found)
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("column")).cast("int")
    return with_index(values.select(rank.alias("_rank"), F.col("column").alias("block"), "value"), ["_rank", "value"], "position").drop("_rank")


# ---- encodings -----------------------------------------------------------------------

def one_hot(column: str, values: Sequence[str]) -> Column:
    """Float array with a 1 at the row's value; null is all zeros."""
    hit = F.col(column).cast("string")
    return F.transform(F.array(*map(F.lit, values)), lambda v: F.coalesce(v == hit, F.lit(False)).cast("float"))


def multi_hot(column: str, values: Sequence[str], sep: str = ",") -> Column:
    """Float array with a 1 for each listed value; null or empty is all zeros."""
    items = F.coalesce(split_exactly(F.col(column), sep), F.array().cast("array<string>"))
    return F.transform(F.array(*map(F.lit, values)), lambda v: F.array_contains(items, v).cast("float"))


def one_hot_long(
    df: DataFrame, key: str, columns: Sequence[str], delimited: Sequence[str] = (), sep: str = ","
) -> DataFrame:
    """Rows (key, feature) of the set features, named column_value. No vocabulary needed."""
    single = [
        F.array(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}_"), F.col(c).cast("string")))) for c in columns
    ]

    def listed(column: str) -> Column:
        items = F.coalesce(split_exactly(F.col(column), sep), F.array().cast("array<string>"))
        return F.transform(F.array_distinct(items), lambda v: F.when(v != "", F.concat(F.lit(f"{column}_"), v)))

    features = F.explode(F.concat(*single, *map(listed, delimited)))
    return df.select(key, features.alias("feature")).filter(F.col("feature").isNotNull())


def socio_features(
    df: DataFrame,
    columns: Sequence[str] = tuple(SINGLE_VALUED),
    delimited: str = "race",
    name: str = "socio",
    key: str = "annotator_id",
    vocabulary_from: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Add the concatenated blocks as one float array per ``key``, and return the vocabulary.

    The vocabulary comes from all rows of ``vocabulary_from``, or of ``df``: give the rows
    before the train/test filter. Set positions are looked up by a join and gathered per
    key; only the number of values comes to the driver.
    """
    words = materialize(vocabulary(df if vocabulary_from is None else vocabulary_from, columns, delimited), "vocabulary")
    width = words.count()
    single = F.array(*(F.struct(F.lit(c).alias("block"), F.col(c).cast("string").alias("value")) for c in columns))
    items = F.coalesce(split_exactly(F.col(delimited)), F.array().cast("array<string>"))
    listed = F.transform(F.array_distinct(items), lambda v: F.struct(F.lit(delimited).alias("block"), v.alias("value")))
    long = df.select(key, F.explode(F.concat(single, listed)).alias("f")).select(key, "f.block", "f.value")
    found = salted_join(long.dropna(subset=["value"]), words, ["block", "value"])
    sets = found.groupBy(key).agg(F.collect_set("position").alias("_set"))
    positions = F.sequence(F.lit(0), F.lit(width - 1)) if width else F.array().cast("array<int>")
    dense = F.transform(positions, lambda i: F.coalesce(F.array_contains("_set", i.cast("bigint")), F.lit(False)).cast("float"))
    return df.join(sets, key, "left").withColumn(name, dense).drop("_set"), words


def standardize(df: DataFrame, vector: str, name: str | None = None, eps: float = 1e-5) -> DataFrame:
    """Each position minus its mean over its population deviation.

    Means and variances are two arrays as long as the vector, from one aggregate that does
    not explode the vectors; it is read back as a scalar subquery.
    """
    values = array_to_vector(F.col(vector).cast("array<double>"))
    summary = Summarizer.metrics("mean", "variance", "count").summary(values)
    whole = df.select(summary.alias("s")).select(
        vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("var"), F.col("s.count").alias("n")
    )
    population = F.array_repeat((F.col("n") - 1) / F.col("n"), F.size("var"))
    deviation = F.zip_with("var", population, lambda var, p: F.sqrt(var * p + F.lit(eps)))
    stats = whole.select(F.arrays_zip("mean", deviation.alias("dev"))).scalar()
    scaled = F.zip_with(F.col(vector), F.col("_stats"), lambda x, s: (x.cast("double") - s["mean"]) / s["dev"])
    return df.withColumn("_stats", stats).withColumn(name or vector, scaled).drop("_stats")


# ---- vectors joined to ratings -------------------------------------------------------

def join_text_vectors(
    ratings: DataFrame,
    vectors: DataFrame,
    vector: str = "embedding",
    key: str = "comment_id",
    counts: DataFrame | None = None,
) -> DataFrame:
    """Each rating with its comment's vector; a comment without one is an error."""
    return join_required(ratings, vectors, key, vector, counts)


def join_annotator_vectors(
    ratings: DataFrame,
    vectors: DataFrame,
    vector: str = "embedding",
    key: str = "annotator_id",
    counts: DataFrame | None = None,
) -> DataFrame:
    """Each rating with its annotator's vector; an annotator without one is an error."""
    return join_required(ratings, vectors, key, vector, counts)


def join_required(
    ratings: DataFrame, values: DataFrame, key: str, vector: str, counts: DataFrame | None = None
) -> DataFrame:
    """Each rating with the one value of its key; a key without a value is an error."""
    joined = salted_join(ratings, values.select(key, vector), [key], "left", counts)
    missing = F.concat(F.lit(f"no vector for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    kind = joined.schema[vector].dataType
    return joined.withColumn(
        vector, F.when(F.col(vector).isNotNull(), F.col(vector)).otherwise(F.raise_error(missing).cast(kind))
    )


def training_rows(ratings: DataFrame, texts: DataFrame, annotators: DataFrame, label: str = "label") -> DataFrame:
    """(comment_id, annotator_id, label, socio, text): one keyed table for all models.

    Hot annotators are counted on the ratings, not on the rows already joined.
    """
    rows = ratings.select("comment_id", "annotator_id", label)
    per_annotator = key_counts(rows, ["annotator_id"])
    with_text = join_text_vectors(rows, texts.withColumnRenamed("embedding", "text"), "text")
    return join_annotator_vectors(
        with_text, annotators.withColumnRenamed("embedding", "socio"), "socio", counts=per_annotator
    )
