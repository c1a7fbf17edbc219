"""Queries on tables where one comment, one annotator and one text hold a third of the rows."""

import os
import shutil
import sys

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry

sys.path.insert(0, os.path.join(os.path.dirname(spark_entry.__file__), "tools"))
from check import compare, tables  # noqa: E402

NAMES = [
    "dense_id_text",
    "dense_id_worker",
    "dedupe_first",
    "filter_chain",
    "filter_chain_nulls",
    "semi_join_comments",
    "join_text_vectors",
    "pair_masks",
    "annotator_pairs",
    "comment_batches",
    "loss_contrastive",
    "gather_head",
    "multi_task_rows",
    "evaluate_models",
    "prepare_flat",
    "prepare_nested",
    "head_sums",
    "pivot_segments",
    "one_hot_concat",
]


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """Copies of the tables with hot keys; many shuffle slots make them count as heavy."""
    sf_dir = "/root/testdata/sf0.01"
    folder = str(tmp_path_factory.mktemp("skewed"))
    for file in os.listdir(sf_dir):
        shutil.copy(f"{sf_dir}/{file}", f"{folder}/{file}")
    changes = {
        "lineitem": ("l_partkey", F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 3 == 0, 7)),
        "orders": ("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, 5)),
        "documents": ("text", F.when(F.col("doc_id") % 3 == 0, "the very same copy")),
    }
    for name, (column, hot) in changes.items():
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        changed = df.withColumn(column, F.coalesce(hot.cast(df.schema[column].dataType), F.col(column)))
        os.remove(f"{folder}/{name}.parquet")
        pq.write_table(changed.toArrow(), f"{folder}/{name}.parquet", coerce_timestamps="us")
    slots = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    yield folder
    spark.conf.set("spark.sql.shuffle.partitions", slots)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, skewed, name):
    verdict, _, _, n = compare(spark, tables(skewed), skewed, name, spark_entry.oracle_sql()[name])
    assert verdict == "ok" and n > 0


@pytest.mark.parametrize("name", ["train_heads", "train_voted"])
def test_training_scores_every_test_rating_once(spark, skewed, name):
    scores = spark_entry.queries()[name](spark, skewed)
    assert scores.count() == scores.select("comment_id", "annotator_id").distinct().count() > 0
    assert scores.filter("prob IS NULL OR prob < 0 OR prob > 1").isEmpty()
