"""Values by reinforced selection (Yoon et al. 2020) with a logistic value estimator.

The estimator sees (x, y, |y - p_val(x)|, 1) and gives each row a selection probability. Each step draws several
selections and fits a predictor on each, all in shared scans. The reward of a draw is its predictor's quality on the
validation rows; measured against the mean reward of the step's draws and in units of their spread, it moves the estimator
along the score function. Per step: one fit of all draws and two aggregates.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowworth.functions.blocks import matrix, sigmoid, vector
from rowworth.operators.many_logistic import fit_many, probabilities
from rowworth.operators.metrics import auroc, rmspe
from rowworth.operators.models import fit_all, fit_classifier, margin_gap, predict
from rowworth.operators.sums import add_up
from rowworth.session import settle

# The selection rate is held between these bounds by a penalty of this size.
RATE_BOUNDS = (0.1, 0.9)
PENALTY = 1e3
# gradient steps of a draw's predictor
_EPOCHS = 4


def _inputs(x: np.ndarray, y: np.ndarray, gap: np.ndarray) -> np.ndarray:
    return np.column_stack([x, y, gap, np.ones(len(y))])


def _selection(theta: np.ndarray, features: str, label: str) -> Column:
    @F.arrow_udf("double")
    def run(x: pa.Array, y: pa.Array, gap: pa.Array) -> pa.Array:
        if not len(y):
            return pa.array([], pa.float64())
        return pa.array(sigmoid(_inputs(matrix(x), vector(y), vector(gap)) @ theta))

    return run(features, label, "gap")


def _draws(ids: np.ndarray, seed: int, step: int, draws: int) -> np.ndarray:
    """(rows, draws) numbers in [0, 1) that depend on the row, seed, step and draw only, so a lost task redraws the same."""
    mixed = ids[:, None].astype(np.uint64) + np.uint64(seed) * np.uint64(0x632BE59BD9B4E019) + np.arange(step * draws, (step + 1) * draws, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for turn in (30, 27):
        mixed = (mixed ^ (mixed >> np.uint64(turn))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(12)) / float(1 << 52)


def _selected(theta: np.ndarray, ids: Column, features: str, label: str, seed: int, step: int, draws: int) -> Column:
    """An array: 1 for each draw that takes the row."""

    @F.arrow_udf("array<double>")
    def run(i: pa.Array, x: pa.Array, y: pa.Array, gap: pa.Array) -> pa.Array:
        if not len(y):
            return pa.array([], pa.list_(pa.float64()))
        e = sigmoid(_inputs(matrix(x), vector(y), vector(gap)) @ theta)
        return pa.array((_draws(vector(i), seed, step, draws) < e[:, None]).astype(np.float64).tolist(), pa.list_(pa.float64()))

    return run(ids, features, label, "gap")


def _score_sums(drawn: DataFrame, theta: np.ndarray, draws: int, features: str, label: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Means of (s - e) z for each draw, of e (1 - e) z, and of e."""
    width = len(theta)

    def partial(batches):
        total = np.zeros((draws + 1) * width + 2)
        for batch in batches:
            x, y, gap, s = (batch.column(i) for i in range(4))
            if not len(y):
                continue
            z = _inputs(matrix(x), vector(y), vector(gap))
            e = sigmoid(z @ theta)
            total[: draws * width] += ((matrix(s) - e[:, None]).T @ z).ravel()
            total[draws * width : -2] += (e * (1 - e)) @ z
            total[-2:] += e.sum(), len(e)
        yield 0, total

    flat = add_up(drawn.select(features, label, "gap", "s"), partial).get(0)
    means = flat[:-1] / max(flat[-1], 1)
    return means[: draws * width].reshape(draws, width), means[draws * width : -1], means[-1]


def value_reinforce(
    train: DataFrame,
    val: DataFrame,
    label: str = "y",
    features: str = "features",
    steps: int = 10,
    rate: float = 0.5,
    seed: int = 0,
    predictor: Estimator | None = None,
    id_col: str = "id",
    draws: int = 24,
    metric: str = "log_loss",
) -> DataFrame:
    """`value` is the selection probability after `steps` steps of `draws` selections each.

    The reward is the validation `metric`: `log_loss`, `rmspe` (both negated) or `auroc`, which wrong labels hardly move. Logistic
    predictors are fitted together; a `predictor` of `pyspark.ml` is fitted once a draw. `rmspe` is for numeric labels
    and takes a linear regression where no predictor is given. A draw whose reward is null counts as the step's worst.
    Ids are whole numbers.
    """
    if metric not in ("auroc", "log_loss", "rmspe"):
        raise ValueError(f"no reward is named {metric}")
    if metric == "rmspe":
        predictor = predictor or LinearRegression(regParam=0.01)
        model = fit_classifier(val, predictor, label, features)
        scored = predict(model, train, features)
        gap = F.abs(F.col(label) - F.col("predicted"))
        rows = scored.withColumn("gap", gap)
    else:
        rows = margin_gap(train, val, label, features)
    rows = settle(rows.select(id_col, F.col(label).cast("double").alias(label), features, "gap"))
    judged = settle(val.select(F.col(label).cast("double").alias(label), features))
    width = (rows.select(F.size(features)).first() or [0])[0] + 3
    theta = np.zeros(width)

    def scored_by_draw(drawn: DataFrame) -> DataFrame:
        if predictor is None:
            models = fit_many(drawn, "s", label, features, epochs=_EPOCHS, rate=2.0, penalty=0.01)[-1]
            found = probabilities(models, F.col(features))
            return judged.select(label, F.posexplode(found).alias("draw", "p"))

        def one(m: int):
            model = fit_classifier(drawn.where(F.col("s")[m] == 1), predictor, label, features)
            out = "predicted" if metric == "rmspe" else "probability"
            return predict(model, judged, features).select(label, F.lit(m).alias("draw"), F.col(out).alias("p"))

        return reduce(DataFrame.unionByName, fit_all(rows.sparkSession, [lambda m=m: one(m) for m in range(draws)]))

    def rewards(drawn: DataFrame) -> np.ndarray:
        scored = scored_by_draw(drawn)
        if metric == "auroc":
            per_draw = auroc(scored, label, "p", ["draw"], out="reward")
        elif metric == "rmspe":
            per_draw = rmspe(scored, label, "p", ["draw"]).select("draw", (-F.col("rmspe")).alias("reward"))
        else:
            p = F.least(F.greatest("p", F.lit(1e-9)), F.lit(1 - 1e-9))
            loss = F.avg(F.col(label) * F.log(p) + (1 - F.col(label)) * F.log(1 - p))
            per_draw = scored.groupBy("draw").agg(loss.alias("reward"))
        found = np.full(draws, np.nan)
        for row in per_draw.collect():
            found[row["draw"]] = np.nan if row["reward"] is None else row["reward"]
        return np.where(np.isnan(found), np.nanmin(found) if not np.isnan(found).all() else 0.0, found)

    for step in range(steps):
        taken = _selected(theta, F.col(id_col), features, label, seed, step, draws)
        drawn = settle(rows.withColumn("s", taken))
        gained = rewards(drawn)
        push, pull, mean = _score_sums(drawn, theta, draws, features, label)
        outside = float(mean > RATE_BOUNDS[1]) - float(mean < RATE_BOUNDS[0])
        spread = gained.std()
        # the mean over the step's draws takes away what they have in common
        move = (gained - gained.mean()) @ push / (max(spread, 1e-12) * draws) - PENALTY * outside * pull
        length = np.linalg.norm(move)
        theta = theta + rate * move / max(length, 1e-12)
    return train.join(rows.select(id_col, _selection(theta, features, label).alias("value")), id_col)
