"""Logistic models that differ in their rows or row weights only, fitted together: one scan a step serves all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowworth.functions.blocks import matrix, sigmoid, vector
from rowworth.operators.sums import add_up
from rowworth.session import settle


def fit_many(
    df: DataFrame, weights: str, label: str = "y", features: str = "features", epochs: int = 3, rate: float = 1.0, penalty: float = 0.0
) -> list[np.ndarray]:
    """(models, features + 1) coefficients, the intercept last, after each epoch of full-batch gradient steps from zero.

    `weights` is an array with the row's weight in each model, 0 where it is left out. A step is the
    weighted mean gradient plus `penalty` times the coefficients. A model without rows stays at zero.
    """
    known = df.where(F.col(label).isNotNull())
    rows = settle(
        known.select(F.col(label).cast("double").alias("y"), F.col(features).alias("x"), F.col(weights).cast("array<double>").alias("weight"))
    )
    first = rows.select(F.size("x"), F.size("weight")).first()
    width, models = first[0] + 1, first[1]
    now, kept = np.zeros((models, width)), []
    for _ in range(epochs):
        sums = add_up(rows, _gradients(now)).get(0)
        total = sums.reshape(models, width + 1)
        size = total[:, -1:]
        step = np.divide(total[:, :-1], size, out=np.zeros_like(now), where=size > 0)
        step[:, :-1] += penalty * now[:, :-1]
        now = now - rate * step
        kept.append(now)
    return kept


def _gradients(now: np.ndarray):
    def partial(batches):
        total = np.zeros((len(now), now.shape[1] + 1))
        for batch in batches:
            y = vector(batch.column(0))
            if not len(y):
                continue
            x, weight = matrix(batch.column(1)), matrix(batch.column(2))
            pull = weight * (sigmoid(x @ now[:, :-1].T + now[:, -1]) - y[:, None])
            total[:, :-2] += pull.T @ x
            total[:, -2] += pull.sum(axis=0)
            total[:, -1] += weight.sum(axis=0)
        yield 0, total

    return partial


def probabilities(models: np.ndarray, features: Column) -> Column:
    """An array: the probability under each model."""

    @F.arrow_udf("array<double>")
    def run(x: pa.Array) -> pa.Array:
        found = sigmoid(matrix(x) @ models[:, :-1].T + models[:, -1]).tolist() if len(x) else []
        return pa.array(found, pa.list_(pa.float64()))

    return run(features)


def self_influence(checkpoints: list[np.ndarray], features: Column, label: Column) -> Column:
    """An array: minus the squared gradient length of the row, summed over the checkpoints, under each model."""

    @F.arrow_udf("array<double>")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        if not len(y):
            return pa.array([], pa.list_(pa.float64()))
        rows, truth = matrix(x), vector(y)[:, None]
        size = (rows**2).sum(axis=1)[:, None] + 1
        total = sum((sigmoid(rows @ w[:, :-1].T + w[:, -1]) - truth) ** 2 for w in checkpoints)
        return pa.array((-total * size).tolist(), pa.list_(pa.float64()))

    return run(features, label.cast("double"))
