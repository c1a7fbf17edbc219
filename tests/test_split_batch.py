"""Splits, batches and global positions."""

from conftest import rows
from pyspark.sql import functions as F

from raterkit.operators import ordering
from raterkit.operators.batching import batch_sizes, comment_batches
from raterkit.operators.ordering import total_before, with_index
from raterkit.operators.splitting import drop_last_single, split_by_hash, split_exact, split_summary


def grid(spark, comments=50, annotators=40):
    return spark.range(comments * annotators).select(
        F.floor(F.col("id") / annotators).alias("comment_id"), (F.col("id") % annotators).alias("annotator_id")
    )


def test_index_is_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    out = with_index(df, ["k"])
    assert out.filter("k <> idx").count() == 0 and out.count() == 1000


def test_computed_order_is_not_shuffled(spark, monkeypatch):
    """Hashes that order the rows are computed again behind the shuffle, not carried through it."""
    plans, write = [], ordering.materialize
    monkeypatch.setattr(ordering, "materialize", lambda df, *a, **k: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, *a, **k))
    df = spark.range(500).select((F.col("id") % 50).alias("k"), "id")
    out = with_index(df, ["_h", "id"], computed={"_h": F.xxhash64("k")})
    assert out.columns == ["k", "id", "idx"]
    found = [(r["h"], r["id"]) for r in out.withColumn("h", F.xxhash64("k")).orderBy("idx").collect()]
    assert found == sorted(found) and len(found) == 500
    comment_batches(grid(spark), 100)
    assert all("AS _" not in plan[plan.index("RepartitionByExpression") :] for plan in plans) and len(plans) == 2


def test_index_of_nothing(spark):
    assert with_index(spark.range(0), ["id"]).collect() == []


def test_total_before_counts_earlier_rows_of_the_group(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"), F.lit(1).alias("one"))
    out = total_before(df, ["k"], "one", ["g"], "before")
    assert out.filter("before <> floor(k / 3)").count() == 0 and out.count() == 300


def test_split_is_by_comment_and_covers(spark):
    parts = split_by_hash(grid(spark), 0.3)
    assert parts.count() == 2000
    assert parts.groupBy("comment_id").agg(F.count_distinct("part").alias("n")).filter("n <> 1").count() == 0


def test_exact_split_has_the_exact_size_and_depends_on_the_seed(spark):
    one = split_exact(grid(spark), 0.33)
    assert one.count() == 50 and one.filter("part = 'test'").count() == 17  # ceil(16.5)
    other = split_exact(grid(spark), 0.33, seed=1)
    assert rows(one) == rows(split_exact(grid(spark), 0.33)) and rows(one) != rows(other)


def test_summary(spark):
    df = grid(spark, 3, 2).withColumn("part", F.when(F.col("comment_id") == 0, "test").otherwise("train"))
    assert rows(split_summary(df)) == [("test", 1, 2), ("train", 2, 4)]


def test_lone_last_row_is_dropped(spark):
    assert drop_last_single(spark.range(33), ["id"]).agg(F.max("id"), F.count("id")).first()[:] == (31, 32)
    assert drop_last_single(spark.range(34), ["id"]).count() == 34
    assert drop_last_single(spark.range(32), ["id"]).count() == 32
    assert drop_last_single(spark.range(1), ["id"]).count() == 0


def test_batches_are_full_whatever_the_comment_sizes(spark):
    hot = spark.range(700).select(F.lit(999).cast("bigint").alias("comment_id"), F.col("id").alias("annotator_id"))
    df = grid(spark, 30, 20).union(hot)
    sizes = rows(batch_sizes(comment_batches(df, 512)))
    assert sizes == [(0, 512), (1, 512), (2, 276)]


def test_comments_stay_together_in_batches(spark):
    out = comment_batches(grid(spark), 100, seed=3)
    spans = out.groupBy("comment_id").agg((F.max("batch_id") - F.min("batch_id")).alias("span"))
    assert spans.filter("span > 1").count() == 0
    assert rows(out) != rows(comment_batches(grid(spark), 100, seed=4))
