"""Annotator representation learned from agreement on shared comments, with the classifier.

Dense layers map the demographic flags to unit vectors; beside the text they go into the
classifier. One loss, ``bce_weight`` times the classifier's and ``contrastive_weight`` times
the contrastive one, trains both, so the representation sees the classifier's errors.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from raterkit.functions.batch_math import TEMPERATURE, Layers, represent
from raterkit.functions.criteria import Combined, CrossEntropy, Criterion
from raterkit.functions.network import JointNetwork
from raterkit.models import trainer
from raterkit.models.classifiers import annotator_rows
from raterkit.models.common import EPOCHS, HIDDEN, ModelRun, TrainingData
from raterkit.session import materialize


def annotator_vectors(socio: DataFrame, layers: Layers) -> DataFrame:
    """(annotator_id, vector): the learned representation of each annotator."""

    @F.pandas_udf("array<float>")
    def apply(x: pd.Series) -> pd.Series:
        return pd.Series(list(represent(layers, np.stack(x.to_numpy()).astype("float64")).astype("float32")))

    return socio.select("annotator_id", apply("socio").alias("vector"))


def group_means(vectors: DataFrame, annotators: DataFrame, columns: Sequence[str], vector: str = "vector") -> DataFrame:
    """Mean representation per demographic value: rows (attribute, value, mean array)."""
    attributes = F.explode(
        F.array(*(F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in columns))
    )
    named = annotators.select("annotator_id", attributes.alias("a")).select("annotator_id", "a.*")
    rows = named.join(vectors, "annotator_id")
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return rows.groupBy("attribute", "value").agg(vector_to_array(mean).alias("mean"))


def fit_joint(
    rows: DataFrame,
    epochs: int = EPOCHS,
    hidden: Sequence[int] = HIDDEN,
    seed: int = 0,
    criterion: Criterion = Combined(),
    **options,
):
    """Network, state and loss of each epoch on ``trainer.batch_rows`` with flags."""
    return trainer.fit(rows, lambda socio, text: JointNetwork(socio, text, hidden), criterion, epochs, seed, **options)


def train_contrastive(
    data: TrainingData,
    epochs: int = EPOCHS,
    hidden: Sequence[int] = HIDDEN,
    seed: int = 0,
    criterion: Criterion = CrossEntropy(),
    bce_weight: float = 1.0,
    contrastive_weight: float = 1.0,
    temperature: float = TEMPERATURE,
    **options,
) -> ModelRun:
    """Representation and classifier together. A ``criterion`` for logits alone is combined
    with the contrastive loss."""
    both = criterion if isinstance(criterion, Combined) else Combined(criterion, bce_weight, contrastive_weight, temperature)
    train = annotator_rows(data, "train", data.socio, "socio", seed)
    network, state, history = fit_joint(train, epochs, hidden, seed, both, **options)
    vectors = materialize(annotator_vectors(data.socio, network.layers(state.params)), "representation")
    predictions = trainer.score(annotator_rows(data, "test", data.socio, "socio"), network, state)
    return ModelRun("contrastive_model", predictions, history, (network, state), {"annotator_vectors": vectors})
