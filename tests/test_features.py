"""Features, profiles, labels and the pivot."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from raterkit.operators import features, labels, profiles
from raterkit.plans.views import FLAGS


def test_items_are_not_trimmed_and_repeats_count_once(spark):
    df = spark.createDataFrame([(1, "Black, Black,Black"), (2, None), (3, "")], "annotator_id int, race string")
    words = features.vocabulary(df, [], "race").orderBy("position").collect()
    assert [r["value"] for r in words] == [" Black", "Black"]
    out = df.select("annotator_id", features.multi_hot("race", [r["value"] for r in words]).alias("v"))
    assert rows(out) == [(1, [1.0, 1.0]), (2, [0.0, 0.0]), (3, [0.0, 0.0])]


def test_separator_is_not_a_pattern(spark):
    df = spark.createDataFrame([("a|b.c",)], "t string")
    assert df.select(features.split_exactly(F.col("t"), "|")).first()[0] == ["a", "b.c"]


def test_blocks_in_list_order_null_is_all_zeros(spark):
    df = spark.createDataFrame(
        [(1, "Male", "No", "White"), (2, "Female", None, None), (3, "Agender", "Yes", "Asian,White")],
        "annotator_id int, gender string, is_parent string, race string",
    )
    out, names = features.socio_features(df, ["gender", "is_parent"])
    assert [f"{r['block']}_{r['value']}" for r in names.orderBy("position").collect()] == [
        "gender_Agender", "gender_Female", "gender_Male", "is_parent_No", "is_parent_Yes", "race_Asian", "race_White",
    ]
    assert rows(out, "annotator_id", "socio")[1] == (2, [0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0])


def test_more_than_ten_thousand_values(spark):
    ids = spark.range(10_050).select(F.col("id").alias("annotator_id"), F.lpad(F.col("id").cast("string"), 5, "0").alias("gender"))
    df = ids.withColumn("race", F.lit(None).cast("string"))
    out, words = features.socio_features(df, ["gender"])
    assert words.count() == 10_050
    some = out.filter("annotator_id in (0, 7, 10049)").select("annotator_id", F.array_position("socio", 1.0).alias("at"), F.size("socio").alias("n"))
    assert set(rows(some)) == {(0, 1, 10_050), (7, 8, 10_050), (10_049, 10_050, 10_050)}


def test_column_range_includes_both_ends(spark):
    df = spark.createDataFrame([(9, True, False, True, 9)], "a int, b boolean, c boolean, d boolean, e int")
    assert features.column_range(df, "b", "d") == ["b", "c", "d"]
    assert features.multi_hot_range(df, "b", "d").first()["socio"] == [1.0, 0.0, 1.0]


def test_standardize_matches_numpy(spark):
    values = np.random.default_rng(1).normal(3, 2, (40, 3))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(values)], "id int, v array<double>")
    got = np.array([r["v"] for r in features.standardize(df, "v").orderBy("id").collect()])
    want = (values - values.mean(0)) / np.sqrt(values.var(0) + 1e-5)
    assert np.allclose(got, want)


def person(spark, **changes):
    base = {
        "annotator_id": 1, "annotator_gender": "female", "annotator_transgender": False, "annotator_age": 33.0,
        "annotator_educ": "some_college", "annotator_income": "<10k", "annotator_ideology": "very_liberal",
        **{c: False for c in FLAGS},
    }
    base.update(changes)
    kinds = {int: "int", str: "string", bool: "boolean", float: "double"}
    fixed = {"annotator_transgender": "boolean", "annotator_age": "double"}
    schema = ", ".join(f"{k} {fixed.get(k) or kinds.get(type(v), 'string')}" for k, v in base.items())
    return spark.createDataFrame([tuple(base.values())], schema)


def test_profile_text(spark):
    df = person(spark, annotator_transgender=True, annotator_race_asian=True, annotator_race_native_american=True)
    assert profiles.profile_text(df).first()["profile"] == (
        "gender: female, transgender, 33 years old, education: some college, income: <10k, "
        "ideology: very liberal, religion, race: asian, native_american, sexuality"
    )


def test_profile_unknowns(spark):
    df = person(spark, annotator_age=None, annotator_income=None, annotator_transgender=None)
    text = profiles.profile_text(df).first()["profile"]
    assert text.startswith("gender: female, age: unknown,") and "income: unknown" in text


def test_plain_profile_prints_none(spark):
    names = ["gender", "identify_as_transgender", "education", "age_range", "lgbtq_status",
             "political_affilation", "is_parent", "religion_important", "race"]
    schema = ", ".join(f"{n} string" for n in names)
    df = spark.createDataFrame([("Male", "Yes", None, "18 - 24", "x", "y", "No", "z", "White")], schema)
    assert profiles.profile_text_plain(df).first()["profile"] == (
        "race: White, gender: Male, transgender, education: None, age: 18 - 24 years old, lgbtq: x, "
        "political affiliation: y, parent: No, religion: z"
    )


def test_votes_use_the_raw_score(spark):
    df = spark.createDataFrame(
        [(1, 2), (1, 0), (1, 0), (2, 1), (2, 0), (3, None), (4, None), (4, 1)], "comment_id int, rating int"
    )
    assert rows(labels.vote_labels(df, cut=0.5)) == [(1, 1), (2, 0), (3, 0), (4, 1)]
    assert rows(labels.vote_labels(df, cut=0.75)) == [(1, 0), (2, 0), (3, 0), (4, 1)]


CELLS = "comment_id int, annotator_id int, label int"


def test_pivot_refuses_duplicates(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 1, 1)], CELLS)
    with pytest.raises(Exception, match="duplicate rating of comment 1"):
        labels.pivot_long(df).collect()


def test_dense_targets_and_masks(spark):
    df = spark.createDataFrame([(1, 10, 1), (1, 20, 0), (2, 20, 1)], CELLS)
    assert rows(labels.dense_targets(df, [10, 20])) == [(1, [1.0, 0.0], [1.0, 1.0]), (2, [0.0, 1.0], [0.0, 1.0])]


def test_head_index_is_sorted(spark):
    df = spark.createDataFrame([(1, 30, 0), (1, 10, 0), (2, 30, 0)], CELLS)
    assert rows(labels.head_index(df)) == [(10, 0), (30, 1)]
