"""Null rules, orders and filters of the preparation."""

from conftest import rows
from pyspark.sql import functions as F, types as T

from raterkit.functions.columns import nonzero_flag, replace_two
from raterkit.operators import cleaning
from raterkit.plans import views
from raterkit.sources.schemas import NESTED_RATINGS

RATINGS = "annotator_id int, comment_id int, rating int"


def test_filters_run_once_and_in_order(spark):
    # Annotator 2 has too few ratings; without them comment 9 has too few; annotator 1
    # then falls below the floor but stays.
    df = spark.createDataFrame([(1, 8, 0), (1, 9, 0), (3, 8, 0), (3, 7, 0), (2, 9, 0)], RATINGS)
    assert rows(cleaning.keep_active(df, 2, 2), "annotator_id", "comment_id") == [(1, 8), (3, 8)]


def test_null_keys_are_dropped_by_filters(spark):
    df = spark.createDataFrame([(None, 1, 0), (None, 1, 0), (1, 1, 0), (1, 1, 1)], RATINGS)
    assert rows(cleaning.keep_frequent(df, "annotator_id", 2), "annotator_id") == [(1,), (1,)]


def test_fill_covers_text_and_flags(spark):
    df = spark.createDataFrame([(None, None, None, None)], "n int, x double, t string, b boolean")
    assert rows(cleaning.fill_zero(df)) == [(0, 0.0, "0", False)]


def test_missing_score_counts_as_positive(spark):
    df = spark.createDataFrame([(0,), (2,), (None,)], "s int")
    assert [r[0] for r in df.select(nonzero_flag(F.col("s"))).collect()] == [0, 1, 1]


def test_two_becomes_one(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (None,)], "s double")
    assert [r[0] for r in df.select(replace_two(F.col("s"))).collect()] == [0.0, 1.0, 1.0, None]


def test_booleans_to_int_keeps_null(spark):
    df = spark.createDataFrame([(True, "x"), (None, "y")], "b boolean, t string")
    assert rows(cleaning.booleans_to_int(df)) == [(1, "x"), (None, "y")]


def test_dense_ids_follow_first_appearance_and_number_null(spark):
    df = spark.createDataFrame([(3, "b"), (1, "a"), (2, None), (4, "a"), (5, None)], "at int, t string")
    assert rows(cleaning.dense_ids(df, "t", ["at"], "id"), "at", "id") == [(1, 0), (2, 1), (3, 2), (4, 0), (5, 1)]


def test_empty_text_and_null_are_two_values(spark):
    df = spark.createDataFrame([(1, ""), (2, None)], "at int, t string")
    assert rows(cleaning.dense_ids(df, "t", ["at"], "id"), "id") == [(0,), (1,)]


def test_first_row_by_order_with_null_keys(spark):
    df = spark.createDataFrame([(None, 2, 5), (None, 1, 6), (1, 3, 7)], "k int, at int, v int")
    assert rows(cleaning.first_rows(df, ["k"], ["at"])) == [(1, 3, 7), (None, 1, 6)]


def test_first_row_is_one_row_not_column_minima(spark):
    df = spark.createDataFrame([(1, 1, None, 9), (1, 2, 3, 4)], "k int, at int, a int, b int")
    assert rows(cleaning.first_rows(df, ["k"], ["at"])) == [(1, 1, None, 9)]


def test_first_rows_of_keys_and_order_alone_fetch_nothing(spark):
    data = [(None, 3, "b"), (None, 3, "a"), (1, 5, "x"), (1, 4, "y"), (1, 4, "y"), (2, None, "z"), (2, 0, "z")]
    df = spark.createDataFrame(data, "k int, at int, name string")
    first = cleaning.first_rows(df, ["k"], ["at", "name"])
    assert first.columns == df.columns and rows(first) == [(1, 4, "y"), (2, None, "z"), (None, 3, "a")]
    assert "Join" not in first._jdf.queryExecution().optimizedPlan().toString()


def test_first_rows_keep_negative_zero_keys(spark):
    first = cleaning.first_rows(spark.createDataFrame([(-0.0, 1)], "k double, at int"), ["k"], ["at"])
    assert [str(r["k"]) for r in first.collect()] == ["-0.0"]


def test_empty_list_keeps_a_row_of_nulls(spark):
    schema = "comment string, source string, ratings array<struct<worker_id:string,toxic_score:int>>"
    df = spark.createDataFrame([("a", "s", []), ("b", "s", None), ("c", "s", [("w", 1)])], schema)
    out = cleaning.unpack(cleaning.explode_ratings(df))
    assert out.columns == ["comment", "worker_id", "toxic_score"]
    assert rows(out) == [("a", None, None), ("b", None, None), ("c", "w", 1)]


def test_flatten_names_nested_fields(spark):
    df = spark.createDataFrame([(1, (2, (3,)))], "id int, s struct<a:int,b:struct<c:int>>")
    assert cleaning.flatten(df).columns == ["id", "s.a", "s.b.c"]
    assert cleaning.unpack(df, "s").columns == ["id", "a", "b.c"]


def test_repeated_text_merges_and_second_rating_is_dropped(spark):
    def rating(worker, score):
        return {"worker_id": worker, "toxic_score": score}

    nested = [
        {"comment": "x", "source": "s", "ratings": [rating("w1", 0), rating("w2", None)]},
        {"comment": "y", "source": "s", "ratings": [rating("w2", 2)]},
        {"comment": "x", "source": "s", "ratings": [rating("w1", 4), rating("w3", 1)]},
    ]
    full = [
        (i, r["comment"], r["source"], [{**dict.fromkeys(_rating_fields()), **x} for x in r["ratings"]])
        for i, r in enumerate(nested)
    ]
    df = spark.createDataFrame(full, T.StructType([T.StructField("line", T.IntegerType()), *NESTED_RATINGS.fields]))
    out = cleaning.prepare_nested(df, ["line"], (1, 1))
    assert rows(out, "comment_id", "annotator_id", "toxic_score", "binary_toxic_score") == [
        (0, 0, 0, 0),
        (0, 1, None, 1),
        (0, 2, 1, 1),
        (1, 1, 2, 1),
    ]


def _rating_fields():
    return [f.name for f in NESTED_RATINGS["ratings"].dataType.elementType.fields]


def test_flat_fill_happens_after_filters_and_before_label(spark):
    schema = "comment_id bigint, annotator_id bigint, hatespeech double, annotator_educ string, flag boolean"
    df = spark.createDataFrame([(1, 1, None, None, True), (1, 1, 2.0, "some_college", None)], schema)
    out = cleaning.prepare_flat(df, (2, 2))
    assert rows(out, "hatespeech", "binary_hatespeech", "annotator_educ", "flag") == [
        (0.0, 0, "0", 1),
        (2.0, 1, "some_college", 0),
    ]


def test_ratings_are_joined_by_more_tasks_on_more_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(views, "ROWS_PER_TASK", 10, raising=False)
    lines = [(i // 3, i % 7, 1, i % 3, "NAR"[i % 3]) for i in range(300)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, i % 5) for i in range(100)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    rated = views.ratings(spark, str(tmp_path))
    assert rated.rdd.getNumPartitions() == 30
    assert rows(rated) == sorted(((p, o % 5, "NAR".index(f), o, n, s) for o, p, s, n, f in lines), key=repr)
