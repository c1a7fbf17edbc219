"""Joins and filters with one key holding a third of all rows."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from raterkit.operators.cleaning import dense_ids, keep_frequent
from raterkit.operators.features import join_text_vectors
from raterkit.operators.pairs import annotator_pairs, pair_masks
from raterkit.operators.skew import heavy_keys, key_counts, salted_join


@pytest.fixture(scope="module")
def many(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 500)
    return spark.range(3000).select(key.alias("k"), "id")


def test_few_heavy_keys(spark, many):
    heavy = heavy_keys(key_counts(many, ["k"]), ["k"])
    assert heavy == [(7, 3)]


def test_no_heavy_key(spark):
    assert heavy_keys(key_counts(spark.range(100), ["id"]), ["id"]) == []
    assert heavy_keys(key_counts(spark.range(0), ["id"]), ["id"]) == []


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_same_as_plain_join(spark, many, how):
    one = spark.range(0, 400, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    one = one.union(spark.createDataFrame([(7, -1)], "k bigint, v bigint"))
    with_null = many.union(spark.createDataFrame([(None, 1), (None, 2)], "k bigint, id bigint"))
    assert rows(salted_join(with_null, one, ["k"], how)) == rows(with_null.join(one, "k", how))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_many_rows_without_a_key(spark, many, how):
    one = spark.range(0, 400, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    holes = many.withColumn("k", F.when(F.col("k") != 7, F.col("k")))
    assert rows(salted_join(holes, one, ["k"], how)) == rows(holes.join(one, "k", how))


def test_hot_key_is_dealt_over_tasks(spark, many):
    one = spark.createDataFrame([(7, "x")], "k bigint, v string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = salted_join(many.repartition(4), one, ["k"])
        tasks = joined.groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert joined.count() == many.filter("k = 7").count() and tasks > 1


def test_hot_text_gets_one_id(spark):
    text = F.when(F.col("id") % 3 == 0, F.lit("copy")).otherwise(F.col("id").cast("string"))
    df = spark.range(900).select("id", text.alias("t"))
    out = dense_ids(df, "t", ["id"], "n")
    assert out.count() == 900 and out.select("n").distinct().count() == 601
    assert out.filter("t = 'copy'").select("n").distinct().collect() == [(0,)]


def test_hot_annotator_is_filtered_exactly(spark, many):
    kept = keep_frequent(many, "k", 6)
    assert kept.count() == many.join(many.groupBy("k").count().filter("count >= 6"), "k").count()


def test_hot_comment_pairs_are_counted_not_emitted(spark):
    df = spark.range(100_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("comment_id"),
        F.col("id").alias("annotator_id"),
        (F.col("id") % 2).cast("int").alias("label"),
    )
    hot = annotator_pairs(df).filter("comment_id = 1").first()
    n = hot["n_ratings"]
    assert hot["n_pairs"] == n * (n - 1) // 2 and hot["n_agree"] + hot["n_disagree"] == hot["n_pairs"]
    masks = pair_masks(df)
    assert masks.filter("comment_id = 1").agg(F.sum("n_positive")).first()[0] == 2 * hot["n_agree"]
    assert masks.count() == 100_000


def test_missing_vector_is_an_error(spark):
    ratings = spark.createDataFrame([(1, 1), (2, 1)], "comment_id int, annotator_id int")
    vectors = spark.createDataFrame([(1, [1.0])], "comment_id int, embedding array<float>")
    with pytest.raises(Exception, match="no vector for comment_id 2"):
        join_text_vectors(ratings, vectors).collect()
