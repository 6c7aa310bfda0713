"""Logistic model by full-batch gradient steps, and gradient-tracing values (Pruthi et al. 2020).

The gradient of one row's loss is (p - y) (x, 1). Sums of it over a table are one aggregate of
partial sums, one small array per task, so an epoch is one scan and the driver sees d + 1 numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowworth.functions.blocks import matrix, sigmoid, vector

Weights = np.ndarray  # d coefficients, then the intercept


def _gradient_sums(df: DataFrame, weights: Sequence[Weights], label: str, features: str) -> tuple[np.ndarray, int]:
    """Sum of gradients over the rows, one line per weight vector, and the row count."""
    stacked = np.asarray(weights)
    c, width = stacked.shape

    def run(batches):
        total, n = np.zeros((c, width)), 0
        for batch in batches:
            y, x = vector(batch.column(0)).astype(np.float64), matrix(batch.column(1))
            if not len(y):
                continue
            residual = sigmoid(x @ stacked[:, :-1].T + stacked[:, -1]) - y[:, None]
            total[:, :-1] += residual.T @ x
            total[:, -1] += residual.sum(axis=0)
            n += len(y)
        yield pa.record_batch(
            [pa.array([np.append(total.ravel(), n).tolist()], pa.list_(pa.float64()))], names=["parts"]
        )

    parts = df.select(F.col(label), F.col(features)).mapInArrow(run, "parts array<double>")
    summed = parts.select(F.posexplode("parts").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("x"))
    flat = np.zeros(c * width + 1)
    for row in summed.collect():
        flat[row["pos"]] = row["x"]
    return flat[:-1].reshape(c, width), int(round(flat[-1]))


def fit_checkpoints(
    train: DataFrame,
    label: str = "y",
    features: str = "features",
    epochs: int = 3,
    rate: float = 1.0,
    keep: Sequence[int] | None = None,
) -> list[Weights]:
    """Weights after the epochs in `keep` (default: all), starting from zero."""
    width = train.select(F.size(features)).first()[0] + 1
    weights = np.zeros(width)
    kept = []
    for epoch in range(1, epochs + 1):
        total, n = _gradient_sums(train, [weights], label, features)
        weights = weights - rate * total[0] / n
        if keep is None or epoch in keep:
            kept.append(weights)
    return kept


def predict_probability(weights: Weights, features: Column) -> Column:
    w = np.asarray(weights)

    @F.arrow_udf("double")
    def run(x: pa.Array) -> pa.Array:
        return pa.array(sigmoid(matrix(x) @ w[:-1] + w[-1]) if len(x) else [], pa.float64())

    return run(features)


def _scored(weights: Sequence[Weights], directions: np.ndarray | None, features: Column, label: Column) -> Column:
    """Sum over checkpoints of the row gradient's squared length, or of its product with a direction."""
    w = np.asarray(weights)

    @F.arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.float64())
        rows = matrix(x)
        residual = sigmoid(rows @ w[:, :-1].T + w[:, -1]) - vector(y).astype(np.float64)[:, None]
        if directions is None:
            score = (residual**2).sum(axis=1) * ((rows**2).sum(axis=1) + 1)
        else:
            score = (residual * (rows @ directions[:, :-1].T + directions[:, -1])).sum(axis=1)
        return pa.array(score, pa.float64())

    return run(features, label)


def value_tracin_self(
    rows: DataFrame, checkpoints: Sequence[Weights], label: str = "y", features: str = "features"
) -> DataFrame:
    """Minus the squared gradient length: rows the model keeps struggling with are worth little."""
    return rows.withColumn("value", -_scored(checkpoints, None, F.col(features), F.col(label)))


def value_tracin_test(
    rows: DataFrame, val: DataFrame, checkpoints: Sequence[Weights], label: str = "y", features: str = "features"
) -> DataFrame:
    """Minus the mean product of a row's gradient with the validation gradients.

    The mean over validation rows is taken first, one aggregate for all checkpoints, so no
    (training, validation) pair is ever formed. For the positives-only variant filter `val`.
    """
    total, n = _gradient_sums(val, checkpoints, label, features)
    return rows.withColumn("value", -_scored(checkpoints, total / n, F.col(features), F.col(label)))


def influence_output(
    valued: DataFrame, weights: Weights, label: str = "y", features: str = "features"
) -> DataFrame:
    """Beside each value the row's label, probability and predicted label."""
    p = predict_probability(weights, F.col(features))
    with_p = valued.withColumn("probability", p)
    return with_p.withColumn("predicted", (F.col("probability") >= 0.5).cast("int"))
