"""One query per operator over the test tables; each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from raterkit.functions.columns import above, bce_with_logits, nonzero_flag, replace_two, sigmoid
from raterkit.functions.criteria import Combined
from raterkit.functions.network import JointNetwork, place_of
from raterkit.functions.vectors import array_sum, l2_normalize as unit_length, weighted_sum
from raterkit.models import classifiers, common, contrastive, heads, trainer
from raterkit.models.common import TrainingData
from raterkit.models.runs import MODELS, Options, run_models
from raterkit.operators import batching, cleaning, embedding, features, labels, losses, metrics, pairs, profiles, running, splitting, text
from raterkit.operators.ordering import with_index
from raterkit.operators.skew import salted_join
from raterkit.plans import views as v
from raterkit.session import materialize, scratch_path
from raterkit.sources.arrow_files import read_arrow, write_arrow
from raterkit.sources.discovery import read_discovered
from raterkit.sources.readers import parse_json, read_flat, read_nested
from raterkit.sources.schemas import RATER_FIELDS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ANNOTATOR_FLOOR, COMMENT_FLOOR = 35, 25  # floors that bite on the test tables
KEYS = ["comment_id", "annotator_id"]
LINE_KEYS = ["comment_id", "l_orderkey", "l_linenumber", "l_suppkey"]


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), places) for n, t in df.dtypes if t in ("double", "float")})


def vector_checks(df: DataFrame, vector: str) -> DataFrame:
    """A vector column as three numbers that cover every element and its position."""
    whole = F.col(vector)
    return rounded(
        df.withColumns(
            {
                "width": F.size(whole).cast("bigint"),
                "total": array_sum(whole),
                "by_position": weighted_sum(whole),
            }
        ).drop(vector)
    )


# ---- sources -------------------------------------------------------------------------

@query
def scan_ratings(spark, sf_dir):
    schema = T.StructType(
        [
            T.StructField("l_orderkey", T.LongType()),
            T.StructField("l_partkey", T.LongType()),
            T.StructField("l_suppkey", T.LongType()),
            T.StructField("l_linenumber", T.IntegerType()),
            T.StructField("l_returnflag", T.StringType()),
        ]
    )
    return read_flat(spark, f"{sf_dir}/lineitem.parquet", schema)


def nested_lines(spark, sf_dir, per_line: int = 256) -> DataFrame:
    """Ratings as (comment, source, line, ratings[]): a comment's ratings over as many
    lines of at most ``per_line`` as it needs."""
    rated = v.ratings(spark, sf_dir)
    raters = v.raters(spark, sf_dir)
    rows = with_index(rated, ["comment_id", *v.ORDER], "at")
    rows = salted_join(rows, raters, ["annotator_id"]).withColumn("line", F.floor(F.col("at") / per_line))
    rating = F.struct(
        "at",
        F.col("annotator_id").cast("string").alias("worker_id"),
        F.col("rating").alias("toxic_score"),
        *RATER_FIELDS,
    )
    return rows.groupBy("comment_id", "line").agg(F.sort_array(F.collect_list(rating)).alias("ratings")).select(
        F.concat(F.lit("comment "), F.col("comment_id").cast("string")).alias("comment"),
        F.lit("stand-in").alias("source"),
        "line",
        F.transform("ratings", lambda r: r.dropFields("at")).alias("ratings"),
    )


def nested_input(spark, sf_dir) -> DataFrame:
    """The nested ratings as JSON lines, written and read back."""
    path = scratch_path(spark, "json-lines")
    lines = nested_lines(spark, sf_dir)
    lines.write.json(path, compression="gzip")  # a file for each task, so nothing needs to be split
    return read_nested(spark, path, lines.schema)


@query
def scan_nested_ratings(spark, sf_dir):
    rows = cleaning.unpack(cleaning.explode_ratings(nested_input(spark, sf_dir)).drop("line"))
    return rows.select("comment", "worker_id", F.col("toxic_score"), "gender", "age_range", "race")


@query
def scan_json_strings(spark, sf_dir):
    schema = T.StructType([T.StructField("k", T.LongType())])
    events = v.table(spark, sf_dir, "events").select("event_id", "props")
    return parse_json(events, "props", schema, "parsed").select("event_id", F.col("parsed.k").alias("k"))


@query
def scan_arrow(spark, sf_dir):
    """Ratings written as Arrow files, and some of their columns and rows read back."""
    path = scratch_path(spark, "arrow")
    write_arrow(v.ratings(spark, sf_dir), path)
    some = T.StructType([T.StructField(n, T.LongType()) for n in KEYS] + [T.StructField("rating", T.IntegerType())])
    return read_arrow(spark, path, some).filter("rating >= 1")


@query
def scan_discovered(spark, sf_dir):
    """JSON lines of mixed types, read under the schema found in them and flattened."""
    text = lambda name: F.col(name).cast("string")
    kind = F.col("annotator_id") % 4
    score = F.when(kind == 0, text("rating")).when(kind == 1, F.concat(text("rating"), F.lit(".5"))).when(kind == 2, F.lit("null"))
    mixed = F.when(F.col("comment_id") % 2 == 0, text("rating")).otherwise(F.concat(F.lit('"r'), text("rating"), F.lit('"')))
    line = F.concat(
        F.lit('{"comment_id":'), text("comment_id"), F.coalesce(F.concat(F.lit(',"score":'), score), F.lit("")), F.lit(',"mixed":'), mixed,
        F.lit(',"rater":{"id":'), text("annotator_id"), F.lit(',"flags":{"odd":'), (F.col("annotator_id") % 2 == 1).cast("string"), F.lit("}}}"),
    )
    path = scratch_path(spark, "lines")
    v.unique(spark, sf_dir).select(line.alias("value")).write.text(path)
    return cleaning.flatten(read_discovered(spark, path), "_")


# ---- restructuring and values --------------------------------------------------------

def labelled_documents(spark, sf_dir) -> DataFrame:
    """Documents with the list of their labels, empty for most."""
    docs = v.table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    marks = v.table(spark, sf_dir, "labels")
    rating = F.array(
        F.struct(F.lit("quality").alias("worker_id"), F.col("quality").alias("score")),
        F.struct(F.lit("toxic").alias("worker_id"), F.col("toxic").alias("score")),
    )
    empty = F.array().cast("array<struct<worker_id:string,score:int>>")
    return docs.join(marks, "doc_id", "left").select(
        "doc_id", "source", "digest", F.when(F.col("quality").isNull(), empty).otherwise(rating).alias("ratings")
    )


@query
def explode_ratings(spark, sf_dir):
    return cleaning.unpack(cleaning.explode_ratings(labelled_documents(spark, sf_dir)))


@query
def flatten_struct(spark, sf_dir):
    place = F.struct(F.col("n_name").alias("nation"), F.struct(F.col("r_name").alias("name")).alias("region"))
    nested = (
        v.table(spark, sf_dir, "customer")
        .join(v.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(v.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", F.struct(F.col("c_mktsegment").alias("segment"), place.alias("place")).alias("rater"))
    )
    return cleaning.flatten(nested, sep="_")


@query
def dense_id_text(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents").select("doc_id", "text")
    return cleaning.dense_ids(docs, "text", ["doc_id"], "text_id", long_text=True).select("doc_id", "text_id")


@query
def dense_id_worker(spark, sf_dir):
    rated = v.saved(v.ratings_nulls(spark, sf_dir))
    numbered = cleaning.dense_ids(rated, "annotator_id", v.ORDER[:3], "worker_no")
    return numbered.select("l_orderkey", "l_linenumber", "l_suppkey", "annotator_id", "worker_no")


@query
def fill_null_zero(spark, sf_dir):
    filled = cleaning.fill_zero(v.people(spark, sf_dir))
    return filled.select(
        "annotator_id", "annotator_transgender", "annotator_age", "annotator_income", "annotator_gender_men"
    )


@query
def bool_to_int(spark, sf_dir):
    return cleaning.booleans_to_int(v.people(spark, sf_dir)).select("annotator_id", "annotator_transgender", *v.FLAGS)


@query
def binarize_replace(spark, sf_dir):
    rated = v.ratings_nulls(spark, sf_dir)
    return rated.select(*LINE_KEYS, replace_two(F.col("rating")).alias("label"))


@query
def binarize_nonzero(spark, sf_dir):
    rated = v.ratings_nulls(spark, sf_dir)
    return rated.select(*LINE_KEYS, nonzero_flag(F.col("rating")).alias("label"))


# ---- features ------------------------------------------------------------------------

@query
def multi_hot_range(spark, sf_dir):
    flags = features.multi_hot_range(cleaning.fill_zero(v.people(spark, sf_dir)))
    return vector_checks(flags.select("annotator_id", "socio"), "socio")


@query
def one_hot_categorical(spark, sf_dir):
    return features.one_hot_long(v.raters(spark, sf_dir), "annotator_id", features.SINGLE_VALUED)


@query
def multi_hot_delimited(spark, sf_dir):
    return features.one_hot_long(v.raters(spark, sf_dir), "annotator_id", [], ["race"])


@query
def one_hot_concat(spark, sf_dir):
    encoded, _ = features.socio_features(v.raters(spark, sf_dir))
    return vector_checks(encoded.select("annotator_id", "socio"), "socio")


@query
def profile_flags(spark, sf_dir):
    filled = cleaning.fill_zero(v.people(spark, sf_dir))
    groups = [profiles.set_flags(filled, p, n).alias(n) for p, n in profiles.FLAG_GROUPS.items()]
    return filled.select("annotator_id", *groups)


@query
def profile_text(spark, sf_dir):
    return profiles.profile_text(v.people(spark, sf_dir)).select("annotator_id", "profile")


@query
def profile_text_plain(spark, sf_dir):
    return profiles.profile_text_plain(v.raters(spark, sf_dir)).select("annotator_id", "profile")


@query
def sigmoid_threshold(spark, sf_dir):
    scored = v.scores(spark, sf_dir).withColumn("logit", 4 * F.col("prob") - 2)
    p = sigmoid(F.col("logit"))
    return rounded(scored.select(*KEYS, p.alias("p"), above(p).alias("pred")))


@query
def l2_normalize(spark, sf_dir):
    stored = v.table(spark, sf_dir, "embeddings").select("vec_id", unit_length(F.col("embedding")).alias("unit"))
    return rounded(stored.select("vec_id", F.posexplode("unit").alias("pos", "value")))


@query
def standardize_features(spark, sf_dir):
    stored = v.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    scaled = features.standardize(stored, "embedding")
    return rounded(scaled.select("vec_id", F.posexplode("embedding").alias("pos", "value")))


# ---- filters, distinct, split --------------------------------------------------------

@query
def filter_annotators(spark, sf_dir):
    return cleaning.keep_frequent(v.unique(spark, sf_dir), "annotator_id", ANNOTATOR_FLOOR)


@query
def filter_chain(spark, sf_dir):
    return cleaning.keep_active(v.saved(v.unique(spark, sf_dir)), ANNOTATOR_FLOOR, COMMENT_FLOOR)


@query
def filter_chain_nulls(spark, sf_dir):
    return cleaning.keep_active(v.saved(v.ratings_nulls(spark, sf_dir)), ANNOTATOR_FLOOR, COMMENT_FLOOR)


@query
def semi_join_comments(spark, sf_dir):
    test = v.split(spark, sf_dir).filter(F.col("part") == "test")
    return cleaning.keep_comments(v.unique(spark, sf_dir), test)


@query
def dedupe_first(spark, sf_dir):
    return cleaning.first_rows(v.ratings(spark, sf_dir), ["annotator_id", "comment_id"], v.ORDER)


@query
def first_per_comment(spark, sf_dir):
    return cleaning.first_rows(v.ratings_nulls(spark, sf_dir), ["comment_id"], v.ORDER[:3])


@query
def first_per_annotator(spark, sf_dir):
    order = ["l_orderkey", "l_linenumber", "comment_id", "l_suppkey"]
    return cleaning.first_rows(v.ratings_nulls(spark, sf_dir), ["annotator_id"], order)


@query
def split_hash(spark, sf_dir):
    return v.split(spark, sf_dir)


@query
def split_exact(spark, sf_dir):
    return splitting.split_exact(v.ratings(spark, sf_dir), 0.3)


@query
def split_summary(spark, sf_dir):
    return splitting.split_summary(splitting.split_by_hash(v.unique(spark, sf_dir), 0.3))


@query
def drop_last_single(spark, sf_dir):
    scored = v.saved(v.scores(spark, sf_dir))
    sizes = (2, 3, 32)
    kept = [splitting.drop_last_single(scored, KEYS, n).select(*KEYS, "label") for n in sizes]
    named = [df.withColumn("batch_size", F.lit(n).cast("bigint")) for n, df in zip(sizes, kept)]
    return named[0].union(named[1]).union(named[2])


# ---- joins, pairs --------------------------------------------------------------------

@query
def join_text_vectors(spark, sf_dir):
    rows = features.join_text_vectors(v.unique(spark, sf_dir), v.text_vectors(spark, sf_dir))
    return vector_checks(rows, "embedding")


@query
def join_annotator_vectors(spark, sf_dir):
    rows = features.join_annotator_vectors(v.unique(spark, sf_dir), v.annotator_vectors(spark, sf_dir))
    return vector_checks(rows, "embedding")


@query
def head_index(spark, sf_dir):
    return labels.head_index(v.ratings(spark, sf_dir))


@query
def annotator_pairs(spark, sf_dir):
    return pairs.annotator_pairs(v.unique(spark, sf_dir))


@query
def pair_masks(spark, sf_dir):
    return pairs.pair_masks(v.saved(v.unique(spark, sf_dir))).drop("rating")


def batched_vectors(spark, sf_dir) -> DataFrame:
    rows = v.unique(spark, sf_dir).select(*KEYS, "label")
    return with_vectors(spark, sf_dir, batching.comment_batches(rows))


def with_vectors(spark, sf_dir, batches: DataFrame) -> DataFrame:
    """Batches with the stored vectors of their annotators; the losses scale them."""
    vectors = v.annotator_vectors(spark, sf_dir).withColumnRenamed("embedding", "vec")
    return salted_join(batches, vectors, ["annotator_id"])


@query
def batch_similarity(spark, sf_dir):
    return rounded(losses.batch_similarity(batched_vectors(spark, sf_dir), KEYS, normalize=True))


@query
def predictions_wide(spark, sf_dir):
    return metrics.predictions_wide(v.model_scores(spark, sf_dir), MODELS)


def head_logits(spark, sf_dir) -> DataFrame:
    texts = v.text_vectors(spark, sf_dir).withColumnRenamed("embedding", "text")
    weights = v.annotator_vectors(spark, sf_dir).withColumnRenamed("embedding", "weights")
    return metrics.own_head_scores(v.saved(v.unique(spark, sf_dir)), texts, weights)


@query
def gather_head(spark, sf_dir):
    scored = metrics.threshold_scores(head_logits(spark, sf_dir))
    return rounded(scored.select(*KEYS, "prob"))


# ---- labels --------------------------------------------------------------------------

@query
def vote_labels(spark, sf_dir):
    return labels.vote_labels(v.ratings_nulls(spark, sf_dir), cut=labels.FLAT_CUT)


@query
def vote_labels_strict(spark, sf_dir):
    return labels.vote_labels(v.ratings_nulls(spark, sf_dir), cut=labels.NESTED_CUT)


@query
def pivot_labels(spark, sf_dir):
    return labels.pivot_long(v.unique(spark, sf_dir))


@query
def pivot_mask(spark, sf_dir):
    return labels.targets_and_mask(v.unique(spark, sf_dir))


# ---- losses --------------------------------------------------------------------------

def logits(spark, sf_dir) -> DataFrame:
    return v.scores(spark, sf_dir).withColumn("logit", 4 * F.col("prob") - 2)


@query
def loss_bce(spark, sf_dir):
    return rounded(losses.bce_loss(logits(spark, sf_dir)))


@query
def loss_masked_bce(spark, sf_dir):
    masked = logits(spark, sf_dir).withColumn("mask", (F.col("annotator_id") % 3 != 0).cast("int"))
    return rounded(losses.masked_bce_loss(masked))


@query
def loss_contrastive(spark, sf_dir):
    return rounded(losses.contrastive_loss(batched_vectors(spark, sf_dir), normalize=True))


def batched_logits(spark, sf_dir) -> DataFrame:
    return batching.comment_batches(logits(spark, sf_dir))


@query
def loss_combined(spark, sf_dir):
    rows = v.saved(batched_logits(spark, sf_dir))
    vectors = with_vectors(spark, sf_dir, rows)
    return rounded(losses.combined_loss(losses.bce_loss(rows, by=["batch_id"]), losses.contrastive_loss(vectors, normalize=True)))


@query
def joint_sums(spark, sf_dir):
    """Losses and some entries of the joint gradient per batch, at parameters set by a rule:
    the representation is the unit vector itself, the classifier one layer."""
    vectors = v.annotator_vectors(spark, sf_dir).withColumnRenamed("embedding", "vector")
    rows = trainer.batch_rows(v.unique(spark, sf_dir), v.text_vectors(spark, sf_dir), vectors)
    width = rows.select(F.size("vector")).first()[0]
    network = JointNetwork(width, width, hidden=(), widths=(width,))
    params = network.new(0)
    params["s0.w"], params["s0.b"] = np.eye(width), np.zeros(width)
    params["w0"], params["b0"] = ((np.arange(2 * width) % 7 - 3) / 20.0)[:, None], np.array([0.1])
    sums = trainer.batch_gradients(trainer.place(rows), network, Combined(), params).withColumn("bce", F.col("sums")[1])
    entries = {"by_constant": ("b0", 0), "by_first": ("w0", 0), "by_last": ("w0", 2 * width - 1)}
    at = {name: 3 + place_of(array, params) + i for name, (array, i) in entries.items()}
    return rounded(sums.select("batch_id", "bce", F.col("sums")[2].alias("contrastive"), *(F.col("sums")[i].alias(n) for n, i in at.items())))


@query
def batch_norm(spark, sf_dir):
    """Moments of the text vectors in each batch, and the running ones after it."""
    batches = v.saved(batching.comment_batches(v.unique(spark, sf_dir)))
    moments = running.batch_moments(batches, v.text_vectors(spark, sf_dir))
    return rounded(running.running_moments(v.saved(moments)).withColumn("pos", F.col("pos").cast("long")))


@query
def epoch_loss(spark, sf_dir):
    rows = batched_logits(spark, sf_dir)
    loss = bce_with_logits(F.col("logit"), F.col("label").cast("double"))
    return rounded(losses.epoch_loss(rows.withColumn("loss", loss), "loss"))


# ---- metrics -------------------------------------------------------------------------

@query
def metrics_prf(spark, sf_dir):
    scored = v.scores(spark, sf_dir).withColumn("pred", above(F.col("prob")))
    return rounded(metrics.precision_recall_f1(scored))


@query
def metric_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(v.scores(spark, sf_dir)))


@query
def metrics_union(spark, sf_dir):
    scored = v.scores(spark, sf_dir).withColumn("pred", above(F.col("prob")))
    plain = metrics.precision_recall_f1(scored).withColumnRenamed("f1", "f1_score")
    per_head = metrics.precision_recall_f1(scored.withColumn("pred", above(F.col("prob"), 0.4)))
    named = [plain.withColumn("model", F.lit("single_model")), per_head.withColumn("model", F.lit("multi_task_model"))]
    return rounded(metrics.combine_metrics(named))


@query
def evaluate_models(spark, sf_dir):
    return rounded(metrics.evaluate(v.saved(v.model_scores(spark, sf_dir))))


@query
def evaluate_heads(spark, sf_dir):
    scored = metrics.threshold_scores(head_logits(spark, sf_dir))
    named = scored.select("label", F.round("prob", 6).alias("prob"), F.lit("multi_task_model").alias("model"))  # no step below reads the ids
    return rounded(metrics.evaluate(v.saved(named)))


# ---- text ----------------------------------------------------------------------------

@query
def word_information(spark, sf_dir):
    """Positive mutual information of neighbouring words, and how often they are neighbours."""
    turns = v.table(spark, sf_dir, "conversations")
    words = v.saved(embedding.vocabulary(turns, words=embedding.plain_words))
    counts = v.saved(embedding.neighbour_counts(turns, words=embedding.plain_words))
    return rounded(embedding.mutual_information(counts, words).join(counts, ["a", "b"]))


@query
def encode_learned(spark, sf_dir):
    """Documents as vectors learned from the training part of them."""
    docs = splitting.split_by_hash(v.table(spark, sf_dir, "documents"), 0.3, "doc_id")
    encoder = text.learned_encoder("word_vectors", v.saved(docs.filter("part = 'train'").select("text")), "text")
    return vector_checks(text.encode_texts(docs, "doc_id", "text", ["doc_id"], encoder), "embedding")


@query
def encode_texts(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents").select("doc_id", "text")
    return vector_checks(text.encode_texts(docs, "doc_id", "text", ["doc_id"]), "embedding")


@query
def encode_profiles(spark, sf_dir):
    encoded = text.encode_profiles(v.saved(v.people(spark, sf_dir)), ["annotator_id"])
    return vector_checks(encoded, "embedding")


@query
def pool_first(spark, sf_dir):
    pooled = text.pool_first(v.tokens(spark, sf_dir), "text_id")
    wide = F.col("vec").cast("array<double>")
    return rounded(pooled.select("text_id", F.posexplode(wide).alias("pos", "value")))


@query
def pool_masked_mean(spark, sf_dir):
    pooled = text.pool_masked_mean(v.tokens(spark, sf_dir), "text_id")
    return rounded(pooled.select("text_id", F.posexplode("vec").alias("pos", "value")))


# ---- batches and training rows -------------------------------------------------------

@query
def comment_batches(spark, sf_dir):
    return batching.comment_batches(v.unique(spark, sf_dir).select(*KEYS))


@query
def batch_count(spark, sf_dir):
    return batching.batch_sizes(batching.comment_batches(v.unique(spark, sf_dir).select(*KEYS)))


@query
def training_rows(spark, sf_dir):
    rows = features.training_rows(
        v.saved(v.unique(spark, sf_dir)), v.text_vectors(spark, sf_dir), v.annotator_vectors(spark, sf_dir)
    )
    joined = rows.select(*KEYS, "label", F.concat("socio", "text").alias("features"))
    return vector_checks(joined, "features")


@query
def multi_task_rows(spark, sf_dir):
    train = v.split(spark, sf_dir).filter(F.col("part") == "train")
    return labels.multi_task_rows(v.saved(v.unique(spark, sf_dir)), train)


# ---- whole preparation ---------------------------------------------------------------

@query
def prepare_flat(spark, sf_dir):
    rated = v.ratings_nulls(spark, sf_dir).withColumnRenamed("rating", "hatespeech")
    raw = v.saved(salted_join(rated, v.people(spark, sf_dir), ["annotator_id"], "left"))
    clean = cleaning.prepare_flat(raw, (ANNOTATOR_FLOOR, COMMENT_FLOOR))
    return clean.select(
        *KEYS, "l_orderkey", "l_linenumber", "l_suppkey", "hatespeech", "binary_hatespeech",
        "annotator_income", "annotator_transgender", "annotator_gender_men",
    )


@query
def prepare_nested(spark, sf_dir):
    nested = nested_input(spark, sf_dir)
    clean = cleaning.prepare_nested(nested, ["line", "comment"], (ANNOTATOR_FLOOR, COMMENT_FLOOR))
    return clean.select("comment", "worker_id", *KEYS, "toxic_score", "binary_toxic_score", "race")


# ---- training ------------------------------------------------------------------------

HEAD_WEIGHTS = (0.3, -0.2, 0.1, 0.05)  # at which the query below takes the sums
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query
def head_sums(spark, sf_dir):
    """Loss, gradient and curvature of every annotator's head at given weights."""
    first = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    texts = v.text_vectors(spark, sf_dir).select("comment_id", F.concat(first, F.array(F.lit(1.0))).alias("x"))
    rows = features.join_text_vectors(v.saved(v.unique(spark, sf_dir).select(*KEYS, "label")), texts, "x")
    width = len(HEAD_WEIGHTS)
    sums = heads._sums(rows, F.array(*map(F.lit, HEAD_WEIGHTS)), ["annotator_id"], width)
    names = ["loss", "n", *(f"g{i}" for i in range(width)), *(f"h{i}{j}" for i in range(width) for j in range(width))]
    return rounded(sums.select("annotator_id", *(F.col("s")[k].alias(name) for k, name in enumerate(names))))


@query
def group_means(spark, sf_dir):
    means = contrastive.group_means(
        v.annotator_vectors(spark, sf_dir), v.raters(spark, sf_dir), ["gender", "education"], "embedding"
    )
    return vector_checks(means, "mean")


@query
def pivot_segments(spark, sf_dir):
    """Ratings of every comment by the rater's market segment, one column per segment."""
    people = v.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("annotator_id"), "c_mktsegment")
    rated = salted_join(v.saved(v.unique(spark, sf_dir).select(*KEYS)), people, ["annotator_id"])
    counted = rated.groupBy("comment_id", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return labels.pivot_wide(counted, "c_mktsegment", SEGMENTS, "n")


def training_data(spark, sf_dir, with_profiles: bool = False) -> TrainingData:
    rated = v.unique(spark, sf_dir).select(*KEYS, F.col("rating").alias("score"), "label")
    people = v.saved(cleaning.fill_zero(v.people(spark, sf_dir)))
    profile_vectors = None
    if with_profiles:
        encoded = text.encode_profiles(people, ["annotator_id"])
        profile_vectors = encoded.withColumnRenamed("embedding", "profile_vector")
    return common.training_data(
        ratings=v.saved(rated),
        parts=v.split(spark, sf_dir),
        texts=v.text_vectors(spark, sf_dir),
        socio=features.multi_hot_range(people).select("annotator_id", "socio"),
        profiles=profile_vectors,
        vote_cut=labels.FLAT_CUT,
    )


@query
def train_voted(spark, sf_dir):
    return rounded(classifiers.train_voted(training_data(spark, sf_dir)).predictions)


@query
def train_heads(spark, sf_dir):
    return rounded(heads.train_heads(training_data(spark, sf_dir)).predictions)


@query
def train_one_hot(spark, sf_dir):
    return rounded(classifiers.train_one_hot(training_data(spark, sf_dir)).predictions)


@query
def train_profile(spark, sf_dir):
    return rounded(classifiers.train_profile(training_data(spark, sf_dir, with_profiles=True)).predictions)


@query
def train_contrastive(spark, sf_dir):
    return rounded(contrastive.train_contrastive(training_data(spark, sf_dir)).predictions)


@query
def annotator_vectors(spark, sf_dir):
    people = v.saved(v.people(spark, sf_dir))
    socio = v.saved(features.multi_hot_range(cleaning.fill_zero(people)).select("annotator_id", "socio"))
    train = splitting.split_by_hash(v.unique(spark, sf_dir), 0.3).filter(F.col("part") == "train")
    flags = socio.select("annotator_id", F.col("socio").alias("vector"))
    texts = v.text_vectors(spark, sf_dir)
    network, state, _ = contrastive.fit_joint(trainer.batch_rows(v.saved(train), texts, flags))
    vectors = materialize(contrastive.annotator_vectors(socio, network.layers(state.params)), "representation")
    columns = ["annotator_gender", "annotator_income", "annotator_ideology"]
    means = contrastive.group_means(vectors, people, columns)
    return rounded(means.select("attribute", "value", F.posexplode("mean").alias("pos", "mean")))


@query
def run_all(spark, sf_dir):
    return rounded(run_models(training_data(spark, sf_dir, with_profiles=True), Options()).metrics)
