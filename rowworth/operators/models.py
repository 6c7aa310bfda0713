"""Base learners: any `pyspark.ml` classifier, with optional row or class weights."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from rowworth.functions.columns import class_weight
from rowworth.operators.metrics import class_totals
from rowworth.operators.ordering import attach_totals

_VECTOR, _WEIGHT = "_vector", "_weight"


# fits submitted at a time; each is a Spark job of its own
PARALLEL_FITS = 4


def fit_all(spark, tasks: list[Callable]) -> list:
    """Run independent fits from a few driver threads, so that small jobs overlap."""
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        return list(pool.map(lambda task: inheritable_thread_target(spark)(task)(), tasks))


def default_classifier() -> Estimator:
    return LogisticRegression(maxIter=20, regParam=0.01)


def fit_classifier(
    df: DataFrame,
    estimator: Estimator | None = None,
    label: str = "y",
    features: str = "features",
    weight: str | None = None,
    balanced: bool = False,
) -> Model:
    """Fit on labels; `weight` names a row-weight column, `balanced` weighs classes by sqrt(n / n_class)."""
    estimator = (estimator or default_classifier()).copy()
    picked = F.lit(1.0)
    if balanced:
        df = attach_totals(df, class_totals(df, label))
        picked = class_weight(F.col(label), F.col("n_pos"), F.col("n_neg"))
    elif weight:
        picked = F.col(weight).cast("double")
    rows = df.select(
        F.col(label).cast("double").alias(label),
        array_to_vector(F.col(features).cast("array<double>")).alias(_VECTOR),
        picked.alias(_WEIGHT),
    )
    estimator.set(estimator.getParam("featuresCol"), _VECTOR)
    estimator.set(estimator.getParam("labelCol"), label)
    if estimator.hasParam("weightCol"):
        estimator.set(estimator.getParam("weightCol"), _WEIGHT)
    return estimator.fit(rows)


def predict(model: Model, df: DataFrame, features: str = "features") -> DataFrame:
    """Add `probability` of label 1 (null for a regressor) and `predicted`."""
    kept = [c for c in df.columns if c not in ("probability", "predicted")]
    scored = model.transform(
        df.select(*kept).withColumn(_VECTOR, array_to_vector(F.col(features).cast("array<double>")))
    )
    if "probability" in scored.columns:
        probability, predicted = vector_to_array("probability")[1], F.col("prediction").cast("int")
    else:
        probability, predicted = F.lit(None).cast("double"), F.col("prediction")
    return scored.select(*kept, probability.alias("probability"), predicted.alias("predicted"))


def margin_gap(train: DataFrame, val: DataFrame, label: str = "y", features: str = "features") -> DataFrame:
    """Add `gap` = |y - p(x)|, with p from a model that has only seen the validation rows."""
    model = fit_classifier(val, label=label, features=features)
    scored = predict(model, train, features)
    gap = F.abs(F.col(label) - F.col("probability"))
    return scored.withColumn("gap", gap).drop("probability", "predicted")
