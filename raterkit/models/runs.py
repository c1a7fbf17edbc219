"""Whole experiments: prepare a data set, train the five models, write the results."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from raterkit.functions.criteria import CrossEntropy, Criterion, MaskedCrossEntropy
from raterkit.models.common import EPOCHS, HIDDEN, ModelRun, TrainingData, training_data
from raterkit.models.classifiers import train_one_hot, train_profile, train_voted
from raterkit.models.contrastive import train_contrastive
from raterkit.models.heads import train_heads
from raterkit.operators.cleaning import first_rows, keep_comments, prepare_flat, prepare_nested, refuse_duplicates
from raterkit.operators.features import multi_hot_range, socio_features
from raterkit.operators.labels import FLAT_CUT, NESTED_CUT
from raterkit.operators.metrics import evaluate, predictions_wide
from raterkit.operators.splitting import split_exact
from raterkit.operators.text import Encoder, encode_profiles, encode_texts, learned_encoder
from raterkit.session import materialize, scratch_scope
from raterkit.sources.checkpoints import FinishedModels, save_state
from raterkit.sources.sinks import (
    Run,
    history_table,
    save_heads,
    write_history,
    write_metrics,
    write_predictions,
)

KEYS = ["comment_id", "annotator_id"]
MODELS = [  # fixed values: names in the result tables
    "single_model",
    "multi_task_model",
    "one_hot_model",
    "social_embedding_model",
    "contrastive_model",
]
REPEATS = 6  # fixed values: experiments per data set, test shares
TEST_SHARE = {"hatespeech": 0.3, "toxic": 0.4}


@dataclass(frozen=True)
class Options:
    epochs: int = EPOCHS
    hidden: Sequence[int] = HIDDEN
    seed: int = 0
    evaluate: Callable[[DataFrame], DataFrame] = evaluate
    criterion: Criterion | None = None  # each model's own loss unless given
    models: Sequence[str] = field(default_factory=lambda: list(MODELS))


# ---- data sets by name ---------------------------------------------------------------

def flat_data(raw: DataFrame, test_share: float, encoder: str, order: Sequence[str]) -> TrainingData:
    """Training tables from flat ratings. The cleaned ratings are written out once."""
    clean = refuse_duplicates(materialize(prepare_flat(raw), "clean"), KEYS)
    annotators = first_rows(clean, ["annotator_id"], order)
    parts = materialize(split_exact(clean, test_share), "parts")
    return training_data(
        ratings=clean.select(*KEYS, F.col("hatespeech").alias("score"), F.col("binary_hatespeech").alias("label")),
        parts=parts,
        texts=encode_texts(clean, "comment_id", "text", order, _fitted(encoder, clean, parts, "text", order)),
        socio=multi_hot_range(annotators).select("annotator_id", "socio"),
        profiles=encode_profiles(clean, order, "flat", encoder).withColumnRenamed("embedding", "profile_vector"),
        vote_cut=FLAT_CUT,
    )


def _fitted(encoder: str, clean: DataFrame, parts: DataFrame, text: str, order: Sequence[str]) -> Encoder:
    """An encoder that has learned from the training comments only."""
    train = keep_comments(clean.select(*dict.fromkeys([*order, "comment_id", text])), parts.filter("part = 'train'"))
    return learned_encoder(encoder, materialize(first_rows(train, ["comment_id"], order).select(text), "training-texts"), text)


def nested_data(raw: DataFrame, test_share: float, encoder: str, order: Sequence[str]) -> TrainingData:
    """Training tables from nested ratings."""
    clean = materialize(prepare_nested(raw, order), "clean")
    rows = [*order, "annotator_id", "comment_id"]
    parts = materialize(split_exact(clean, test_share), "parts")
    socio, _ = socio_features(first_rows(clean, ["annotator_id"], [*order, "comment_id"]), vocabulary_from=clean)
    return training_data(
        ratings=clean.select(*KEYS, F.col("toxic_score").alias("score"), F.col("binary_toxic_score").alias("label")),
        parts=parts,
        texts=encode_texts(clean, "comment_id", "comment", rows, _fitted(encoder, clean, parts, "comment", rows)),
        socio=socio.select("annotator_id", "socio"),
        profiles=encode_profiles(clean, rows, "nested", encoder).withColumnRenamed("embedding", "profile_vector"),
        vote_cut=NESTED_CUT,
    )


DATASETS = {"hatespeech": flat_data, "toxic": nested_data}


def prepare(name: str, raw: DataFrame, test_share: float, encoder: str, order: Sequence[str]) -> TrainingData:
    if name not in DATASETS:
        raise ValueError(f"Unknown data set: {name}")
    return DATASETS[name](raw, test_share, encoder, order)


# ---- runs ----------------------------------------------------------------------------

def train_model(name: str, data: TrainingData, options: Options, resume: dict | None = None) -> ModelRun:
    """``resume`` has the trainer's ``resume`` and ``after_epoch``."""
    fit = {"epochs": options.epochs, "seed": options.seed, **(resume or {})}
    plain = {"hidden": options.hidden, "criterion": options.criterion or CrossEntropy()}
    if name == "single_model":
        return train_voted(data, **fit, **plain)
    if name == "multi_task_model":
        return train_heads(data, criterion=options.criterion or MaskedCrossEntropy(), **fit)
    if name == "one_hot_model":
        return train_one_hot(data, **fit, **plain)
    if name == "social_embedding_model":
        return train_profile(data, **fit, **plain)
    if name == "contrastive_model":
        return train_contrastive(data, **fit, **plain)
    raise ValueError(f"Unknown model: {name}")


@dataclass
class Results:
    metrics: DataFrame
    history: dict[str, list[float]]
    predictions: DataFrame
    runs: list[ModelRun]


def run_models(
    data: TrainingData, options: Options = Options(), finished: FinishedModels | None = None, folder: str | None = None
) -> Results:
    """All chosen models on one data set; predictions are written once and reused.

    With ``finished``, models of its manifest are read instead of trained, others go on from
    their last epoch, and each is saved below ``folder`` and entered when it is done.
    """
    runs = []
    for name in options.models:
        if finished and finished.has(name):
            runs.append(finished.load(name))
            continue
        resume = finished.epochs_of(name, options.epochs).options(name == "multi_task_model") if finished else None
        run = train_model(name, data, options, resume)
        run.predictions = materialize(run.predictions.withColumn("model", F.lit(run.name)), "predictions")
        if finished:
            save_model(finished.spark, run, f"{folder}/models/{finished.run.dataset}/{finished.run.run_id}/{run.name}")
            finished.commit(run)
        runs.append(run)
    scores = reduce(DataFrame.unionByName, (run.predictions for run in runs))
    return Results(options.evaluate(scores), {run.name: run.history for run in runs}, scores, runs)


def save_model(spark: SparkSession, done: ModelRun, where: str) -> None:
    """Layers and moments, and the heads of a model that has them."""
    save_state(spark, done.model[1], done.history, f"{where}/state")
    if "heads" in done.tables:
        save_heads(done.tables["heads"], done.model[2], f"{where}/heads")


def save_results(spark: SparkSession, results: Results, run: Run, folder: str) -> None:
    write_metrics(results.metrics, f"{folder}/metrics", run)
    write_history(history_table(spark, results.history), f"{folder}/history", run)
    names = [r.name for r in results.runs]
    write_predictions(predictions_wide(results.predictions, names), f"{folder}/predictions", run)


def run_experiments(
    spark: SparkSession,
    raw: dict[str, tuple[DataFrame, Sequence[str]]],
    folder: str,
    encoder: str = "hashing_tfidf",
    repeats: int = REPEATS,
    options: Options = Options(),
) -> None:
    """Each data set prepared once and trained ``repeats`` times with seeds 0, 1, 2, ...

    Run again after a failure, it trains only what the manifest in ``folder`` does not have,
    and a model that was being trained goes on from its last epoch. Intermediate tables of a
    data set and of a repeat are removed when it ends, also by an error.
    """
    for name, (ratings, order) in raw.items():
        with scratch_scope():
            data = prepare(name, ratings, TEST_SHARE[name], encoder, order)
            for seed in range(repeats):
                run = Run(f"{name}-{seed}", name, encoder)
                with scratch_scope():
                    finished = FinishedModels(spark, folder, run)
                    results = run_models(data, replace(options, seed=seed), finished, folder)
                    save_results(spark, results, run, folder)
