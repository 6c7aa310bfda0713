"""Surrogate regressors: values known on the pool, mean and variance predicted for the rest."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowworth.functions.blocks import matrix, vector
from rowworth.functions.columns import seeded_key
from rowworth.operators.models import fit_all
from rowworth.operators.pairs import similarity
from rowworth.session import settle

_JITTER = 1e-6


def surrogate_gbt(
    pool: DataFrame,
    rest: DataFrame,
    value: str = "value",
    features: str = "features",
    n_models: int = 5,
    rounds: int = 20,
    seed: int = 0,
) -> DataFrame:
    """Add `mean` and population `variance` over boosted regressors that differ in seed and subsample."""
    rows = settle(pool.select(F.col(value).cast("double").alias("label"), _vector(features).alias("_x")))
    names = [f"_p{i}" for i in range(n_models)]

    def fit(i: int):
        learner = GBTRegressor(
            featuresCol="_x", labelCol="label", predictionCol=names[i], maxIter=rounds, subsamplingRate=0.8, seed=seed + i
        )
        return learner.fit(rows)

    out = rest.withColumn("_x", _vector(features))
    for model in fit_all(pool.sparkSession, [lambda i=i: fit(i) for i in range(n_models)]):
        out = model.transform(out)
    mean = sum((F.col(c) for c in names), F.lit(0.0)) / n_models
    spread = sum(((F.col(c) - F.col("mean")) ** 2 for c in names), F.lit(0.0)) / n_models
    return out.withColumn("mean", mean).withColumn("variance", spread).drop("_x", *names)


def _vector(features: str):
    return array_to_vector(F.col(features).cast("array<double>"))


def _landmarks(pool: DataFrame, features: str, id_col: str, count: int, seed: int) -> np.ndarray:
    """`count` seeded pool rows. They are model data: the driver holds them and a square matrix of them."""
    keyed = pool.select(id_col, features).withColumn("_draw", seeded_key(F.col(id_col), seed))
    return matrix(keyed.orderBy("_draw", id_col).limit(count).toArrow()[features])


def _fit_on_landmarks(
    pool: DataFrame, landmarks: np.ndarray, shift: float, value: str, features: str, solve: Callable
) -> tuple[np.ndarray, np.ndarray]:
    """Apply `solve(K K', K (y - shift))`, for K the landmark-by-row kernel of all pool rows.

    Each task sums its own rows, and the numbers of all tasks are added up place by place, with
    partial sums. The solve needs the sums together: as many rows as landmarks, so one small task
    does it.
    """
    m = len(landmarks)

    def partial(batches):
        gram, target = np.zeros((m, m)), np.zeros(m)
        for batch in batches:
            y, x = vector(batch.column(0)), matrix(batch.column(1))
            if len(y):
                k = similarity(x, landmarks, "tanimoto")
                gram += k.T @ k
                target += k.T @ (y - shift)
        lines = np.hstack([gram, target[:, None]])
        yield pa.record_batch(
            [pa.array(np.arange(m), pa.int64()), pa.array(lines.tolist(), pa.list_(pa.float64()))],
            names=["i", "line"],
        )

    def solved(part: pd.DataFrame) -> pd.DataFrame:
        full = np.stack(part.sort_values("i")["line"])
        alpha, inner = solve(full[:, :m], full[:, m])
        return pd.DataFrame({"i": np.arange(m), "alpha": alpha, "inner": list(inner)})

    lines = pool.select(F.col(value).cast("double"), features).mapInArrow(partial, "i bigint, line array<double>")
    places = lines.select("i", F.posexplode("line").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    # a line is as long as there are landmarks
    cells = F.array_sort(F.collect_list(F.struct("j", "x")))
    summed = places.groupBy("i").agg(F.transform(cells, lambda c: c["x"]).alias("line"))
    rows = summed.groupBy().applyInPandas(solved, "i bigint, alpha double, inner array<double>").toPandas()
    rows = rows.sort_values("i")
    return rows["alpha"].to_numpy(), np.stack(rows["inner"])


def _predicted(
    rest: DataFrame, landmarks: np.ndarray, alpha: np.ndarray, shift: float, inner: np.ndarray | None, features: str
) -> DataFrame:
    @F.arrow_udf("struct<mean: double, variance: double>")
    def run(x: pa.Array) -> pa.Array:
        k = similarity(matrix(x), landmarks, "tanimoto") if len(x) else np.zeros((0, len(alpha)))
        variance = np.zeros(len(k)) if inner is None else np.maximum(1.0 - ((k @ inner) * k).sum(axis=1), 0.0)
        return pa.StructArray.from_arrays(
            [pa.array(k @ alpha + shift, pa.float64()), pa.array(variance, pa.float64())], names=["mean", "variance"]
        )

    scored = rest.withColumn("_s", run(features))
    return scored.select(*rest.columns, F.col("_s.mean").alias("mean"), F.col("_s.variance").alias("variance"))


def surrogate_kernel_gp(
    pool: DataFrame,
    rest: DataFrame,
    value: str = "value",
    features: str = "features",
    landmarks: int = 200,
    noise: float = 1.0,
    seed: int = 0,
    id_col: str = "id",
) -> DataFrame:
    """Gaussian process with a Tanimoto kernel, on landmark rows (deterministic training conditional).

    All pool rows count; only the basis is limited. The prior mean is the pool's mean value.
    """
    z = _landmarks(pool, features, id_col, landmarks, seed)
    shift = float(pool.agg(F.avg(value)).first()[0])

    def solve(gram, target):
        k = similarity(z, z, "tanimoto") + _JITTER * np.eye(len(z))
        posterior = np.linalg.inv(noise * k + gram)
        return posterior @ target, np.linalg.inv(k) - noise * posterior

    alpha, inner = _fit_on_landmarks(pool, z, shift, value, features, solve)
    return _predicted(rest, z, alpha, shift, inner, features)


def surrogate_kernel_ridge(
    pool: DataFrame,
    rest: DataFrame,
    value: str = "value",
    features: str = "features",
    landmarks: int = 200,
    penalty: float = 1.0,
    seed: int = 0,
    id_col: str = "id",
) -> DataFrame:
    """Ridge regression on the same landmark kernel; it has no variance, so `variance` is 0."""
    z = _landmarks(pool, features, id_col, landmarks, seed)
    shift = float(pool.agg(F.avg(value)).first()[0])

    def solve(gram, target):
        k = similarity(z, z, "tanimoto") + _JITTER * np.eye(len(z))
        return np.linalg.solve(gram + penalty * k, target), np.zeros((len(z), 0))

    alpha, _ = _fit_on_landmarks(pool, z, shift, value, features, solve)
    return _predicted(rest, z, alpha, shift, None, features)


# names a caller can pick from, or extend with any `(pool, rest) -> rest + mean, variance`
SURROGATES = {"gbt": surrogate_gbt, "gp": surrogate_kernel_gp, "ridge": surrogate_kernel_ridge}
