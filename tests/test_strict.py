"""Bad input is refused, hot keys are spread, runs differ by their options."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from raterkit.models import classifiers, common, contrastive, heads, runs
from raterkit.operators import cleaning, labels, metrics, skew
from raterkit.session import materialize, scratch_dir, scratch_scope
from raterkit.sources.readers import parse_json, read_nested


@pytest.mark.parametrize("line", ['{"comment": "a", "ratings": [{"worker_id"', '{"comment": "a", "ratings": [{"worker_id": "w", "toxic_score": "high"}]}'])
def test_bad_lines_are_errors(spark, tmp_path, line):
    (tmp_path / "lines.json").write_text('{"comment": "b", "ratings": []}\n' + line + "\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|parse"):
        read_nested(spark, str(tmp_path)).collect()


def test_bad_json_strings_are_errors(spark):
    df = spark.createDataFrame([("{}",), (None,), ("{",)], "s string")
    schema = spark.createDataFrame([], "k long").schema
    assert parse_json(df.limit(2), "s", schema, "p").count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        parse_json(df, "s", schema, "p").collect()


def test_duplicate_ratings_are_refused(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (1, 1, 1)], "comment_id int, annotator_id int, hatespeech int")
    with pytest.raises(ValueError, match="more than one row"):
        cleaning.refuse_duplicates(df, runs.KEYS)
    assert cleaning.refuse_duplicates(df.limit(2), runs.KEYS).count() == 2


def test_two_scores_for_one_rating_are_an_error(spark):
    df = spark.createDataFrame([(1, 1, "a", 0.1), (1, 1, "a", 0.2)], "comment_id int, annotator_id int, model string, prob double")
    with pytest.raises(Exception, match="two scores by model a"):
        metrics.predictions_wide(df, ["a"]).collect()


def small_data(spark, people=2):
    ratings = spark.createDataFrame(
        [(c, a, float(c % 2), c % 2, "train" if c < 40 else "test") for c in range(60) for a in (1, 2 + c % 5)],
        "comment_id long, annotator_id long, score double, label int, part string",
    )
    texts = spark.createDataFrame(
        [(c, [float((c * k) % 7) for k in range(1, 13)], "train" if c < 40 else "test") for c in range(60)],
        "comment_id long, embedding array<float>, part string",
    )
    socio = spark.createDataFrame([(a, [float(a), 1.0]) for a in range(1, people)], "annotator_id long, socio array<float>")
    return common.TrainingData(ratings, texts, socio)


def test_missing_annotator_vector_is_an_error(spark):
    with pytest.raises(Exception, match="no vector for annotator_id"):
        classifiers.annotator_rows(small_data(spark, 3), "train", small_data(spark, 3).socio, "socio").collect()
    assert classifiers.annotator_rows(small_data(spark, 9), "train", small_data(spark, 9).socio, "socio").filter("NOT is_text").count() == 80


def test_rows_of_a_hot_annotator_are_told_apart_by_their_vectors(spark):
    df = spark.range(3000).select(F.lit(7).alias("annotator_id"), F.array(F.col("id") * 0.5).alias("x"), (F.col("id") % 2).alias("label"))
    pieces = df.select(F.pmod(skew._row_hash(df), F.lit(8)).alias("p")).groupBy("p").count().collect()
    assert len(pieces) == 8 and min(r["count"] for r in pieces) > 200


def test_heads_follow_epochs_and_seed(spark):
    data = small_data(spark, 9)
    short = runs.train_model("multi_task_model", data, runs.Options(epochs=1, seed=0))
    other = runs.train_model("multi_task_model", data, runs.Options(epochs=1, seed=1))
    long = runs.train_model("multi_task_model", data, runs.Options(epochs=4, seed=0))
    assert [len(r.history) for r in (short, other, long)] == [1, 1, 4]
    assert short.history != other.history
    assert long.history[-1] <= long.history[0]


def test_scope_removes_what_was_written(spark):
    def tables():
        folder = f"{scratch_dir(spark)}/raterkit".removeprefix("file:")
        return set(os.listdir(folder)) if os.path.isdir(folder) else set()

    before = tables()
    with pytest.raises(RuntimeError), scratch_scope():
        materialize(spark.range(3).toDF("a"), "kept-no-longer")
        with scratch_scope():
            materialize(spark.range(3).toDF("a"), "inner")
        assert len(tables() - before) == 1
        raise RuntimeError
    assert tables() == before


def test_training_leaves_no_tables_behind(spark):
    data = small_data(spark, 9)
    folder = f"{scratch_dir(spark)}/raterkit".removeprefix("file:")
    with scratch_scope():
        batches = classifiers.annotator_rows(data, "train", data.socio, "socio")
        before = set(os.listdir(folder))
        _, state, history = contrastive.fit_joint(batches, epochs=3, hidden=(4,))
        assert set(os.listdir(folder)) == before
    assert len(history) == 3 and all(np.isfinite(history))


def test_wide_pivot_takes_any_number_of_values(spark):
    df = spark.createDataFrame([(1, 5, 0.5), (2, 11_000, 0.25)], "comment_id int, annotator_id int, v double")
    wide = labels.pivot_wide(df, "annotator_id", [5, 11_000, 7], "v")
    assert rows(wide) == [(1, 0.5, None, None), (2, None, 0.25, None)]
