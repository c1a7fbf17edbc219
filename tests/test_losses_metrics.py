"""Losses and metrics against brute force."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from raterkit.functions.columns import above
from raterkit.operators import losses, metrics
from raterkit.plans import queries


def unit_rows(n=60, width=5, seed=2):
    random = np.random.default_rng(seed)
    vectors = random.normal(size=(n, width))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors, random.integers(0, 8, n), random.integers(0, 2, n)


def brute_contrastive(e, comment, label, temperature):
    n, pull, push, p, m = len(e), 0.0, 0.0, 0, 0
    for i in range(n):
        scores = [float(e[i] @ e[j]) / temperature for j in range(n)]
        denominator = sum(np.exp(s) for s in scores)
        for j in range(n):
            q = np.exp(scores[j]) / denominator
            if comment[i] == comment[j] and i != j and label[i] == label[j]:
                pull, p = pull - np.log(q), p + 1
            elif comment[i] == comment[j] and label[i] != label[j]:
                push, m = push + q, m + 1
    return pull / max(p, 1), push / max(m, 1), p, m


def test_contrastive_loss_matches_brute_force(spark):
    e, comment, label = unit_rows()
    data = [(i // 30, int(c), int(y), [float(x) for x in v]) for i, (v, c, y) in enumerate(zip(e, comment, label))]
    df = spark.createDataFrame(data, "batch_id bigint, comment_id int, label int, vec array<double>")
    got = {r["batch_id"]: r for r in losses.contrastive_loss(df, temperature=0.5).collect()}
    for b in (0, 1):
        part = slice(30 * b, 30 * b + 30)
        pull, push, p, m = brute_contrastive(e[part], comment[part], label[part], 0.5)
        assert (got[b]["n_positive"], got[b]["n_negative"]) == (p, m)
        assert got[b]["pull"] == pytest.approx(pull) and got[b]["push"] == pytest.approx(push)
        assert got[b]["contrastive"] == pytest.approx(pull + push)


def test_float_vectors_are_scaled_in_the_batch(spark):
    e, _, _ = unit_rows()
    data = [(0, i % 7, i, i % 2, [float(x) for x in row]) for i, row in enumerate(e * np.arange(1, len(e) + 1)[:, None])]
    df = spark.createDataFrame(data, "batch_id long, comment_id long, annotator_id long, label int, vec array<float>")
    unit = df.withColumn("vec", F.array(*(F.col("vec")[k].cast("double") / (F.col("annotator_id") + 1) for k in range(e.shape[1]))))
    for loss in (losses.contrastive_loss, lambda d, **o: losses.batch_similarity(d, ["annotator_id"], **o)):
        a, b = (sorted(tuple(r) for r in d.collect()) for d in (loss(df, normalize=True), loss(unit)))
        assert np.allclose(a, b, atol=1e-5)


def test_batch_without_pairs_has_no_loss(spark):
    df = spark.createDataFrame([(0, 1, 1, [1.0, 0.0]), (0, 2, 1, [0.0, 1.0])],
                               "batch_id bigint, comment_id int, label int, vec array<double>")
    assert losses.contrastive_loss(df).first()["contrastive"] == 0.0


def test_bce_is_stable_for_large_logits(spark):
    df = spark.createDataFrame([(800.0, 0), (-800.0, 1), (0.0, 1)], "logit double, label int")
    assert losses.bce_loss(df).first()[0] == pytest.approx((1600 + np.log(2)) / 3)


def test_masked_bce_ignores_masked_cells(spark):
    df = spark.createDataFrame([(1.0, 1, 1), (5.0, None, 0), (2.0, 0, 1)], "logit double, label int, mask int")
    want = (np.log1p(np.exp(-1.0)) + 2 + np.log1p(np.exp(-2.0))) / 2
    assert losses.masked_bce_loss(df).first()[0] == pytest.approx(want)


def test_epoch_loss_weighs_batches_equally(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 8.0)], "batch_id int, loss double")
    assert losses.epoch_loss(df, "loss").first()[0] == 5.0


def test_combined_loss(spark):
    bce = spark.createDataFrame([(0, 1.0)], "batch_id int, bce double")
    con = spark.createDataFrame([(0, 2.0)], "batch_id int, contrastive double")
    assert rows(losses.combined_loss(bce, con, 1.0, 3.0)) == [(0, 1.0, 2.0, 7.0)]


def brute_auc(y, p):
    wins = [1.0 if a > b else 0.5 if a == b else 0.0 for a in p[y == 1] for b in p[y == 0]]
    return sum(wins) / len(wins)


def scored(spark, seed=5, n=400):
    random = np.random.default_rng(seed)
    y, p = random.integers(0, 2, n), random.integers(0, 40, n) / 40
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "label int, prob double")
    return y, p, df


def test_auc_with_ties(spark):
    y, p, df = scored(spark)
    assert metrics.roc_auc(df).first()["auc"] == pytest.approx(brute_auc(y, p))


def test_auc_of_reversed_scores(spark):
    y, p, df = scored(spark, 6)
    forward = metrics.roc_auc(df).first()["auc"]
    assert metrics.roc_auc(df.withColumn("prob", 1 - F.col("prob"))).first()["auc"] == pytest.approx(1 - forward)


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "label int, prob double")
    assert metrics.roc_auc(df).first()["auc"] is None


def test_auc_by_model_with_most_rows_in_one_group(spark):
    y, p, df = scored(spark, 7, 900)
    both = df.withColumn("model", F.lit("a")).union(df.limit(50).withColumn("model", F.lit("b")))
    got = {r["model"]: r["auc"] for r in metrics.roc_auc(both, ["model"]).collect()}
    assert got["a"] == pytest.approx(brute_auc(y, p)) and set(got) == {"a", "b"}


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(0.5,), (0.51,)], "p double")
    assert [r[0] for r in df.select(above(F.col("p"))).collect()] == [0, 1]


def test_precision_recall_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, pred int")
    assert rows(metrics.precision_recall_f1(df)) == [(0.0, 0.0, 0.0)]
    some = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (1, 1)], "label int, pred int")
    assert metrics.precision_recall_f1(some).first()[:] == pytest.approx((2 / 3, 2 / 3, 2 / 3))


def test_union_has_one_f1(spark):
    a = spark.createDataFrame([("a", 0.1)], "model string, f1_score double")
    b = spark.createDataFrame([("b", 0.2)], "model string, f1 double")
    assert rows(metrics.combine_metrics([a, b]), "model", "f1") == [("a", 0.1), ("b", 0.2)]


def test_gather_picks_the_head(spark):
    df = spark.createDataFrame([([0.1, 0.2, 0.3], 2), ([0.4, 0.5, 0.6], 0)], "probs array<double>, head bigint")
    assert rows(metrics.gather_head(df), "prob") == [(0.3,), (0.4,)]


def test_predictions_side_by_side(spark):
    df = spark.createDataFrame([(1, 1, "a", 0.1), (1, 1, "b", 0.2), (2, 1, "a", 0.3)],
                               "comment_id int, annotator_id int, model string, prob double")
    assert rows(metrics.predictions_wide(df, ["a", "b"])) == [(1, 1, 0.1, 0.2), (2, 1, 0.3, None)]


def test_heads_are_evaluated_on_narrow_rows(spark, monkeypatch):
    """What the query writes has no ids, which no metric reads."""
    data = [(i, i % 7, i % 2, float(i % 5 - 2)) for i in range(60)]
    monkeypatch.setattr(queries, "head_logits", lambda *_: spark.createDataFrame(data, "comment_id long, annotator_id long, label int, logit double"))
    kept, write = [], queries.v.saved
    monkeypatch.setattr(queries.v, "saved", lambda df: kept.append(df.columns) or write(df))
    (row,) = queries.evaluate_heads(spark, "").collect()
    assert kept == [["label", "prob", "model"]]
    pos, neg = ([z for _, _, label, z in data if label == kind] for kind in (1, 0))
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert row["model"] == "multi_task_model" and row["auc"] == pytest.approx(auc, abs=1e-6)
