"""Training: gradients, falling loss, schemas, sinks."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from raterkit.functions import batch_math
from raterkit.functions.criteria import Combined, SmoothedCrossEntropy
from raterkit.models import contrastive, heads, runs, trainer
from raterkit.models.common import TrainingData
from raterkit.models.runs import MODELS, Options, prepare, run_experiments, run_models
from raterkit.plans import views
from raterkit.operators import cleaning
from raterkit.sources.readers import INPUT_ORDER, read_nested, read_nested_in_order
from raterkit.sources.schemas import flat_ratings
from raterkit.sources.checkpoints import load_state
from raterkit.sources.sinks import Run, load_heads, load_layers, save_layers


def test_contrastive_gradient_equals_finite_differences():
    random = np.random.default_rng(0)
    unit, comment, label = random.normal(size=(12, 3)), random.integers(0, 3, 12), random.integers(0, 2, 12)
    loss, gradient = batch_math.contrastive_gradient(unit, comment, label, 0.5)
    pull, push, _, _ = batch_math.batch_contrastive(unit, comment, label, 0.5)
    assert loss == pytest.approx(pull + push)
    for i, j in [(0, 0), (3, 2), (7, 1), (11, 2)]:
        moved = []
        for step in (1e-6, -1e-6):
            nudged = unit.copy()
            nudged[i, j] += step
            moved.append(batch_math.contrastive_gradient(nudged, comment, label, 0.5)[0])
        assert gradient[i, j] == pytest.approx((moved[0] - moved[1]) / 2e-6, abs=1e-5)


def test_representation_separates_what_agreement_separates(spark):
    random = np.random.default_rng(3)
    kinds = random.integers(0, 2, 150)
    rows_ = [(c, a, int(kinds[a])) for c in range(15) for a in range(10 * c, 10 * c + 10)]
    flags = [(a, [float(k == 1), float(k == 0), float(random.random())]) for a, k in enumerate(kinds)]
    batches = trainer.batch_rows(
        spark.createDataFrame(rows_, "comment_id long, annotator_id long, label int"),
        spark.createDataFrame([(c, [0.0]) for c in range(15)], "comment_id long, embedding array<float>"),
        spark.createDataFrame(flags, "annotator_id long, vector array<float>"),
        50,
    )
    network, state, history = contrastive.fit_joint(batches, 30, (4,), criterion=Combined(bce_weight=0.0), rate=0.01)
    assert history[-1] < history[0]
    same = batch_math.represent(network.layers(state.params), np.array([[1.0, 0, 0.2], [1.0, 0, 0.8], [0, 1.0, 0.2]]))
    assert same[0] @ same[1] > same[0] @ same[2]


def test_heads_differ_by_annotator_and_fall_back(spark):
    random = np.random.default_rng(4)
    data = []
    for i in range(600):
        x, annotator = float(random.normal()), i % 3
        data.append((annotator, [x, 1.0], int((x > 0) == (annotator != 2))))
    df = spark.createDataFrame(data, "annotator_id int, x array<double>, label int")
    fitted, common, history = heads.fit_heads(df, steps=3)
    weights = {r["annotator_id"]: r["weights"] for r in fitted.collect()}
    assert weights[0][0] > 1 and weights[2][0] < -1 and len(common) == 2
    assert history == sorted(history, reverse=True)


def test_newton_step_matches_one_by_one(spark):
    sums = np.random.default_rng(1).normal(size=(3, 2 + 2 + 4))
    sums[:, 4:] = [4.0, 1.0, 1.0, 3.0]
    weights, anchor = np.ones((3, 2)), np.zeros((1, 2))
    together = batch_math.newton_step(sums, weights, anchor, 0.5)
    alone = np.vstack([batch_math.newton_step(sums[i : i + 1], weights[i : i + 1], anchor, 0.5) for i in range(3)])
    assert np.allclose(together, alone)


@pytest.fixture(scope="module")
def raw_flat(spark, sf_dir):
    rated = views.ratings(spark, sf_dir).dropDuplicates(["comment_id", "annotator_id"])
    text = F.concat(F.lit("comment "), (F.col("comment_id") % 7).cast("string"))
    return (
        rated.join(views.people(spark, sf_dir), "annotator_id")
        .withColumn("hatespeech", F.col("rating").cast("double"))
        .withColumn("text", text)
        .drop("rating")
    )


ORDER = ["l_orderkey", "l_linenumber", "comment_id", "annotator_id"]


def test_unknown_data_set(raw_flat):
    with pytest.raises(ValueError, match="Unknown data set: other"):
        prepare("other", raw_flat, 0.3, "hashing_tfidf", ORDER)


def test_all_models_end_to_end(spark, raw_flat, tmp_path):
    options = Options(epochs=1, hidden=(8,))
    run_experiments(spark, {"hatespeech": (raw_flat, ORDER)}, str(tmp_path), repeats=2, options=options)
    metrics = spark.read.option("header", True).csv(f"{tmp_path}/metrics")
    assert rows(metrics, "model", "run_id") == sorted((m, f"hatespeech-{i}") for m in MODELS for i in (0, 1))
    assert {"precision", "recall", "f1", "auc", "dataset", "encoder"} <= set(metrics.columns)
    history = spark.read.parquet(f"{tmp_path}/history")
    assert history.filter("epoch = 1").count() == 10
    predictions = spark.read.parquet(f"{tmp_path}/predictions")
    assert set(MODELS) <= set(predictions.columns)
    one = predictions.filter("run_id = 'hatespeech-0'")
    assert one.count() == one.dropDuplicates(["comment_id", "annotator_id"]).count() > 0
    assert one.dropna(subset=MODELS).count() == one.count()
    saved = f"{tmp_path}/models/hatespeech/hatespeech-0"
    for model in MODELS:
        state, losses = load_state(spark, f"{saved}/{model}/state")
        assert len(losses) == 1 and state.steps > 0
    assert [state.params[f"s{i}.w"].shape[1] for i in range(3)] == [64, 128, 256]  # the contrastive model comes last
    heads_table, common = load_heads(spark, f"{saved}/multi_task_model/heads")
    assert heads_table.count() > 10 and len(common) == 11


def test_a_killed_experiment_repeats_nothing_that_is_done(spark, raw_flat, tmp_path, monkeypatch):
    names = ["single_model", "multi_task_model", "one_hot_model"]
    options = Options(epochs=2, hidden=(4,), models=names, criterion=SmoothedCrossEntropy(0.2))
    trained, real = [], runs.train_model

    def dying(name, data, options, resume=None):
        trained.append((name, len(resume["resume"][-1]) if resume["resume"] else 0))
        if len(trained) == 3:
            after = resume["after_epoch"]

            def die(*reached):
                after(*reached)
                raise KeyboardInterrupt

            resume = {**resume, "after_epoch": die}
        return real(name, data, options, resume)

    monkeypatch.setattr(runs, "train_model", dying)
    start = lambda: run_experiments(spark, {"hatespeech": (raw_flat, ORDER)}, str(tmp_path), repeats=1, options=options)
    with pytest.raises(KeyboardInterrupt):
        start()
    assert not (tmp_path / "metrics").exists()
    start()
    assert trained == [(n, 0) for n in names] + [("one_hot_model", 1)]
    assert rows(spark.read.option("header", True).csv(f"{tmp_path}/metrics"), "model") == sorted((n,) for n in names)
    assert spark.read.parquet(f"{tmp_path}/history").count() == 6
    assert spark.read.parquet(f"{tmp_path}/predictions").dropna(subset=names).count() > 0


def test_running_again_replaces_the_run(spark, tmp_path):
    from raterkit.sources.sinks import history_table, write_history

    for losses in ([3.0, 2.0], [1.0]):
        write_history(history_table(spark, {"m": losses}), str(tmp_path / "h"), Run("r1", "d", "e"))
    write_history(history_table(spark, {"m": [9.0]}), str(tmp_path / "h"), Run("r2", "d", "e"))
    assert rows(spark.read.parquet(str(tmp_path / "h")), "run_id", "epoch", "train_loss") == [("r1", 1, 1.0), ("r2", 1, 9.0)]


def test_layers_round_trip(spark, tmp_path):
    layers = batch_math.new_layers(3, (4, 2))
    save_layers(spark, layers, str(tmp_path / "layers"))
    for (w, b), (w2, b2) in zip(layers, load_layers(spark, str(tmp_path / "layers"))):
        assert np.array_equal(w, w2) and np.array_equal(b, b2)


def test_nested_data_set(spark, sf_dir):
    from raterkit.plans.queries import nested_input

    nested = nested_input(spark, sf_dir)
    data = prepare("toxic", nested, 0.4, "hashing_tfidf", ["line", "comment"])
    assert isinstance(data, TrainingData) and data.vote_cut == 0.75
    part = data.part("test").count() + data.part("train").count()
    assert part == data.ratings.count() > 0
    results = run_models(data, Options(epochs=1, hidden=(4,), models=["multi_task_model"]))
    assert results.metrics.count() == 1


def test_flat_schema():
    schema = flat_ratings(["annotator_gender_men", "annotator_sexuality_other"])
    assert schema.fieldNames()[-2:] == ["annotator_gender_men", "annotator_sexuality_other"]


def test_json_lines_reader(spark, tmp_path):
    (tmp_path / "x.json").write_text(
        '{"comment": "a", "source": "s", "ratings": [{"worker_id": "w", "toxic_score": 2, "race": "White"}]}\n'
    )
    row = read_nested(spark, str(tmp_path / "x.json")).first()
    assert row["ratings"][0]["worker_id"] == "w" and row["ratings"][0]["gender"] is None


def test_ids_follow_the_lines_of_a_split_file(spark, tmp_path):
    path = tmp_path / "x.json"
    texts = [f"text {(i * 37) % 400}" for i in range(1000)]
    line = '{"comment": "%s", "source": "s", "ratings": [{"worker_id": "w%d", "toxic_score": 1}]}\n'
    path.write_text("".join(line % (t, i) for i, t in enumerate(texts)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        nested = read_nested_in_order(spark, str(path))
        assert nested.rdd.getNumPartitions() > 4
        out = cleaning.prepare_nested(nested, INPUT_ORDER, (1, 1))
        found = {r["comment"]: r["comment_id"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {t: i for i, t in enumerate(dict.fromkeys(texts))}


def test_training_twice_gives_the_same_scores(spark, raw_flat):
    data = prepare("hatespeech", raw_flat, 0.3, "hashing_tfidf", ORDER)
    options = Options(epochs=1, hidden=(4,), seed=5, models=["single_model", "multi_task_model", "contrastive_model"])
    first, second = (
        rows(run_models(data, options).predictions.withColumn("prob", F.round("prob", 6))) for _ in range(2)
    )
    assert first == second
