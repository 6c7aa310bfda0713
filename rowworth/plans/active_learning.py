"""Which rows to measure next? Rounds of: value the pool, predict the rest, take the best batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowworth.functions.columns import acq_greedy, acq_ucb
from rowworth.operators.features import standardize_target
from rowworth.operators.models import fit_classifier, predict
from rowworth.operators.ordering import attach_totals
from rowworth.operators.removal import rank_batch
from rowworth.operators.split import random_order, random_split
from rowworth.operators.surrogate import SURROGATES
from rowworth.session import broadcast_if_small, settle

# pool rows -> pool rows with `value`
PoolValuer = Callable[[DataFrame], DataFrame]
# (pool, rest) -> rest rows with `acquisition`; the lowest are taken
Picker = Callable[[DataFrame, DataFrame], DataFrame]


def grow_pool(sampled: DataFrame, batch: DataFrame, round_no: int) -> DataFrame:
    """`(id, round)` with one more batch; written, so rounds do not pile up in the plan."""
    return settle(sampled.unionByName(batch.select("id", F.lit(round_no).alias("round"))))


def _rounds(train: DataFrame, picker: Picker, share: float, steps: int, seed: int) -> DataFrame:
    """Only the slim `(id, round)` table changes; pool and rest are joins against it."""
    total = train.count()
    first = random_split(train.select("id"), share, seed)
    sampled = settle(first.select("id", F.lit(0).alias("round")))
    for i in range(1, steps + 1):
        taken = broadcast_if_small(sampled.select("id"))
        pool = train.join(taken, "id", "left_semi")
        rest = train.join(taken, "id", "left_anti")
        batch = rank_batch(picker(pool, rest).select("id", "acquisition"), "acquisition", share, total)
        sampled = grow_pool(sampled, batch, i)
    return sampled


def actives_found(train: DataFrame, sampled: DataFrame, label: str = "y") -> DataFrame:
    """`(step, n_sampled, found, share)`: sizes and actives of the pool after each step; no actives at all: null share."""
    per_round = (
        train.select("id", label)
        .join(sampled, "id")
        .groupBy("round")
        .agg(F.count(F.lit(1)).alias("_c"), F.sum(label).alias("_a"))
    )
    earlier = per_round.select(F.col("round").alias("_r"), "_c", "_a")
    # as many rows as rounds
    summed = (
        per_round.select(F.col("round").alias("step"))
        .join(F.broadcast(earlier), F.col("_r") <= F.col("step"))
        .groupBy("step")
        .agg(F.sum("_c").alias("n_sampled"), F.sum("_a").alias("found"))
    )
    all_actives = train.agg(F.sum(label).alias("_all"))
    return attach_totals(summed, all_actives).select(
        "step", "n_sampled", "found", F.try_divide("found", "_all").alias("share")
    )


def active_learning(
    train: DataFrame,
    valuer: PoolValuer,
    surrogate: str | Callable = "gbt",
    acquisition: str = "greedy",
    step_share: float = 0.01,
    steps: int = 6,
    seed: int = 0,
    label: str = "y",
    explore: int = 1,
    **surrogate_options,
) -> DataFrame:
    """Actives found when each batch is picked by predicted value."""
    regress = SURROGATES[surrogate] if isinstance(surrogate, str) else surrogate

    def pick(pool: DataFrame, rest: DataFrame) -> DataFrame:
        valued = settle(valuer(pool).select("id", "features", "value"))
        predicted = regress(standardize_target(valued), rest, **surrogate_options)
        mean, variance = F.col("mean"), F.col("variance")
        score = acq_ucb(mean, variance, explore=explore) if acquisition == "ucb" else acq_greedy(mean)
        return predicted.withColumn("acquisition", score)

    return actives_found(train, _rounds(train, pick, step_share, steps, seed), label)


def active_learning_greedy(
    train: DataFrame,
    step_share: float = 0.01,
    steps: int = 6,
    seed: int = 0,
    label: str = "y",
    estimator: Estimator | None = None,
) -> DataFrame:
    """Baseline: a classifier on the pool, most probable actives first."""

    def pick(pool: DataFrame, rest: DataFrame) -> DataFrame:
        model = fit_classifier(pool, estimator, label)
        return predict(model, rest).withColumn("acquisition", 1 - F.col("probability"))

    return actives_found(train, _rounds(train, pick, step_share, steps, seed), label)


def active_learning_random(
    train: DataFrame, step_share: float = 0.01, steps: int = 6, seed: int = 0, label: str = "y"
) -> DataFrame:
    """Baseline: random batches. One shuffled order gives every round at once."""
    placed = random_order(train.select("id", label), seed)
    n = train.agg(F.count(F.lit(1)).alias("_n"))
    first = F.ceil(F.col("_n") * F.lit(step_share))
    # at least a row each round
    batch = F.greatest(F.floor(F.col("_n") * F.lit(step_share)), F.lit(1))
    beyond = F.ceil((F.col("position") - first) / batch)
    rounds = attach_totals(placed, n).select("id", F.greatest(beyond, F.lit(0)).cast("int").alias("round"))
    return actives_found(train, rounds.where(F.col("round") <= steps), label)
