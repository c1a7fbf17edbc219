"""Ratings, annotators and vectors derived from the star-schema test tables.

A part is a comment, a customer an annotator, a line item a rating. ``oracles.VIEWS``
holds the same definitions in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from raterkit.functions.columns import md5_hash, nonzero_flag, pair_hash
from raterkit.models.runs import MODELS
from raterkit.operators.cleaning import first_rows
from raterkit.operators.splitting import split_by_hash
from raterkit.session import materialize, shuffle_slots

ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "rating"]
#: Line items that one task joins with their orders and sorts.
ROWS_PER_TASK = 500_000
FLAGS = {  # flag column: order priority or status whose share decides it
    "annotator_gender_men": "1-URGENT",
    "annotator_gender_women": "2-HIGH",
    "annotator_religion_buddhist": "3-MEDIUM",
    "annotator_religion_atheist": "4-NOT SPECIFIED",
    "annotator_race_asian": "5-LOW",
    "annotator_race_native_american": "F",
    "annotator_sexuality_gay": "O",
    "annotator_sexuality_other": "P",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    flag = F.col("l_returnflag")
    score = F.when(flag == "N", 0).when(flag == "A", 1).when(flag == "R", 2)
    # all reduce tasks, and more on more rows: a task's sorts stay small on a table of any size
    tasks = max(shuffle_slots(spark), -(-lines.count() // ROWS_PER_TASK))
    lines, orders = lines.repartition(tasks, "l_orderkey"), orders.repartition(tasks, "o_orderkey")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("l_partkey").alias("comment_id"),
        F.col("o_custkey").alias("annotator_id"),
        score.alias("rating"),
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
    )


def ratings_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = ratings(spark, sf_dir)
    no_rater = F.col("annotator_id") % 97 == 0
    no_score = (F.col("l_orderkey") + F.col("l_suppkey")) % 13 == 0
    return rated.withColumns(
        {
            "annotator_id": F.when(~no_rater, F.col("annotator_id")),
            "rating": F.when(~no_score, F.col("rating")),
        }
    )


def unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = first_rows(ratings(spark, sf_dir), ["annotator_id", "comment_id"], ORDER)
    return first.select("comment_id", "annotator_id", "rating", nonzero_flag(F.col("rating")).alias("label"))


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    comments = ratings(spark, sf_dir).select("comment_id").distinct()
    return split_by_hash(comments, 0.3)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test ratings with a score that follows the label, with many ties."""
    test = split_by_hash(unique(spark, sf_dir), 0.3).filter(F.col("part") == "test")
    noise = pair_hash(F.col("comment_id"), F.col("annotator_id")) % 100
    return test.select(
        "comment_id", "annotator_id", "label", F.round((noise + 20 * F.col("label")) / 120.0, 6).alias("prob")
    )


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test ratings scored by five made-up models, one row per model and rating."""
    test = scores(spark, sf_dir)
    model = F.explode(F.array(*map(F.lit, MODELS))).alias("model")
    rows = test.select("comment_id", "annotator_id", "label", model)
    text = F.concat_ws("/", F.col("model"), F.col("comment_id").cast("string"), F.col("annotator_id").cast("string"))
    lift = F.length("model") * F.col("label")
    return rows.withColumn("prob", F.round((md5_hash(text) % 100 + lift) / 125.0, 6))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotators with the attribute columns of the flat schema."""
    orders = table(spark, sf_dir, "orders")
    shares = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        *(
            (F.avg(((F.col("o_orderpriority") == v) | (F.col("o_orderstatus") == v)).cast("double")) > 0.3).alias(c)
            for c, v in FLAGS.items()
        )
    )
    places = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    customers = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    return customers.join(shares, "c_custkey", "left").select(
        key.alias("annotator_id"),
        F.col("c_mktsegment").alias("annotator_gender"),
        F.when(key % 20 == 0, True).when(key % 7 != 0, False).alias("annotator_transgender"),
        F.when(key % 11 != 0, (18 + key % 60).cast("double") + 0.5).alias("annotator_age"),
        F.col("n_name").alias("annotator_educ"),
        income_band(F.col("c_acctbal")).alias("annotator_income"),
        F.col("r_name").alias("annotator_ideology"),
        *FLAGS,
    )


def income_band(balance):
    return (
        F.when(balance < 0, F.lit(None))
        .when(balance < 3000, "up_to_3000")
        .when(balance < 6000, "up_to_6000")
        .otherwise("over_6000")
    )


def raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotators with the attribute columns of the nested schema."""
    flat = people(spark, sf_dir)
    groups = {
        "annotator_race_asian": "Asian",
        "annotator_race_native_american": " Native",
        "annotator_gender_men": "White",
    }
    race = F.concat_ws(",", *(F.when(F.col(c), F.lit(v)) for c, v in groups.items()))

    def yes_no(column: str):
        return F.when(F.col(column), "Yes").when(~F.col(column), "No")

    return flat.select(
        "annotator_id",
        F.col("annotator_gender").alias("gender"),
        yes_no("annotator_transgender").alias("identify_as_transgender"),
        F.col("annotator_educ").alias("education"),
        F.col("annotator_income").alias("age_range"),
        yes_no("annotator_sexuality_gay").alias("lgbtq_status"),
        F.col("annotator_ideology").alias("political_affilation"),
        yes_no("annotator_gender_women").alias("is_parent"),
        yes_no("annotator_religion_buddhist").alias("religion_important"),
        F.nullif(race, F.lit("")).alias("race"),
    )


def vectors_for(spark: SparkSession, sf_dir: str, keys: DataFrame, key: str) -> DataFrame:
    """(key, embedding): each id takes the stored vector with number id modulo their count."""
    stored = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    size = stored.agg(F.count(F.lit(1))).scalar()
    numbered = keys.select(key).distinct().withColumn("vec_id", F.col(key) % size)
    return numbered.join(stored, "vec_id").select(key, "embedding")


def text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("comment_id"))
    return vectors_for(spark, sf_dir, parts, "comment_id")


def annotator_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("annotator_id"))
    return vectors_for(spark, sf_dir, customers, "annotator_id")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors as the tokens of ten texts; every third one is masked."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("bigint").alias("text_id"),
        F.col("vec_id").alias("pos"),
        F.col("embedding").alias("vec"),
        (F.col("vec_id") % 3 != 0).cast("int").alias("mask"),
    )


def saved(df: DataFrame) -> DataFrame:
    """A view used several times by one query, written out once."""
    return materialize(df, "view", compression="zstd")
