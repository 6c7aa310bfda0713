"""Value methods by name, for screens, pools and sweeps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowworth.functions.columns import seeded_key
from rowworth.operators import boosting, logistic
from rowworth.operators.knn_shapley import value_knn_shapley
from rowworth.operators.labels import positives_only
from rowworth.operators.reinforce import value_reinforce

# (train, val, seed, options) to the rows of train with `value`
ValueMethod = Callable[..., DataFrame]


def _mvs(train, val, seed, **options):
    return boosting.value_mvs(train, boosting.fit_boosters(train, **options)[0])


def _leaf_test(train, val, seed, **options):
    return boosting.value_leaf_influence(train, boosting.fit_boosters(train, **options)[0], val)


def _leaf_self(train, val, seed, **options):
    return boosting.value_leaf_influence(train, boosting.fit_boosters(train, **options)[0], positives_only(train, "y"))


def _tracin_self(train, val, seed, **options):
    return logistic.value_tracin_self(train, logistic.fit_checkpoints(train, **options))


def _tracin_test(train, val, seed, **options):
    return logistic.value_tracin_test(train, val, logistic.fit_checkpoints(train, **options))


def _tracin_pos(train, val, seed, **options):
    return _tracin_test(train, positives_only(val, "y"), seed, **options)


def _shapley(train, val, seed, **options):
    return value_knn_shapley(train, val, **options)


def _reinforce(train, val, seed, **options):
    return value_reinforce(train, val, seed=seed, **options)


def _random(train, val, seed):
    return train.withColumn("value", F.conv(F.substring(seeded_key(F.col("id"), seed), 1, 12), 16, 10).cast("double"))


VALUE_METHODS: dict[str, ValueMethod] = {
    "mvs": _mvs,
    "leaf_self": _leaf_self,
    "leaf_test": _leaf_test,
    "tracin_self": _tracin_self,
    "tracin_test": _tracin_test,
    "tracin_pos": _tracin_pos,
    "shapley": _shapley,
    "reinforce": _reinforce,
    "random": _random,
}


def values_by_name(method: str, train: DataFrame, val: DataFrame, seed: int = 0, **options) -> DataFrame:
    """`(id, value)` of the rows of `train(id, y, features)` by the method of that name; `val` has the same columns.

    `options` go to what the method fits. Methods without a validation set or a draw leave `val` or `seed` alone.
    """
    if method not in VALUE_METHODS:
        raise ValueError(f"no value method is named {method}: {', '.join(VALUE_METHODS)}")
    return VALUE_METHODS[method](train, val, seed, **options).select("id", "value")


def pool_valuer(method: str, val: DataFrame, seed: int = 0, **options) -> Callable[[DataFrame], DataFrame]:
    """The method as what `active_learning` and `undersample_assays` take: a pool to its rows with `value`."""
    if method not in VALUE_METHODS:
        raise ValueError(f"no value method is named {method}: {', '.join(VALUE_METHODS)}")

    def value(pool: DataFrame) -> DataFrame:
        return pool.join(values_by_name(method, pool, val, seed, **options), "id")

    return value


def compare_values(
    train: DataFrame, val: DataFrame, methods: Sequence[str], seed: int = 0, options: dict[str, dict] | None = None
) -> DataFrame:
    """`(method, id, value)` of several methods; `options` are by name."""
    out = None
    for method in methods:
        found = values_by_name(method, train, val, seed, **(options or {}).get(method, {}))
        part = found.select(F.lit(method).alias("method"), "id", F.col("value").cast("double").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out
