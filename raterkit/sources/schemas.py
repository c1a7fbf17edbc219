"""Schemas of the two kinds of input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

# Column names of the inputs.
RATER_FIELDS = [
    "gender",
    "identify_as_transgender",
    "education",
    "age_range",
    "lgbtq_status",
    "political_affilation",
    "religion_important",
    "is_parent",
    "race",
]

RATING = T.StructType(
    [T.StructField("worker_id", T.StringType()), T.StructField("toxic_score", T.IntegerType())]
    + [T.StructField(name, T.StringType()) for name in RATER_FIELDS]
)

NESTED_RATINGS = T.StructType(
    [
        T.StructField("comment", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("ratings", T.ArrayType(RATING)),
    ]
)


def flat_ratings(flags: Sequence[str]) -> T.StructType:
    """One row per comment and annotator; ``flags`` are the boolean attribute columns in order."""
    text = [T.StructField(n, T.StringType()) for n in ("annotator_educ", "annotator_income", "annotator_ideology")]
    return T.StructType(
        [
            T.StructField("comment_id", T.LongType()),
            T.StructField("annotator_id", T.LongType()),
            T.StructField("hatespeech", T.DoubleType()),
            T.StructField("text", T.StringType()),
            T.StructField("annotator_gender", T.StringType()),
            T.StructField("annotator_transgender", T.BooleanType()),
            T.StructField("annotator_age", T.DoubleType()),
            *text,
            *(T.StructField(name, T.BooleanType()) for name in flags),
        ]
    )
