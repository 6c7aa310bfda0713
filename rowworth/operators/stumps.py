"""Newton-boosted stumps on numeric columns, and the values read off them.

Every tree splits one feature at its mean, so a row enters only through its side pattern (one bit
per feature) and its label. One groupBy turns the table into counts per (pattern, label), and any
number of rounds then runs on those counts. Fixed splits also make the result reproducible.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowworth.functions.blocks import sigmoid

# up to here all 2^(d+1) cells are held on the driver and broadcast: at most 131072 rows
MAX_FEATURES = 16


@dataclass(frozen=True)
class StumpModel:
    features: tuple[str, ...]
    means: tuple[float, ...]
    base: float
    split_on: np.ndarray  # feature of each tree
    leaves: np.ndarray  # (trees, 2) leaf values, left then right
    hessians: np.ndarray  # (trees, 2) training hessian sums
    rate: float
    penalty: float

    @property
    def leaf_norms(self) -> np.ndarray:
        return np.abs(self.leaves).sum(axis=1)

    def sides(self, patterns: np.ndarray) -> np.ndarray:
        """(rows, trees) 0/1 leaf of each pattern in each tree."""
        return (patterns[:, None] >> self.split_on[None, :]) & 1

    def margins(self, patterns: np.ndarray) -> np.ndarray:
        """(rows, trees + 1) margin before each tree, and the final one."""
        steps = self.leaves[np.arange(len(self.split_on))[None, :], self.sides(patterns)]
        start = np.full((len(patterns), 1), self.base)
        return np.hstack([start, self.base + np.cumsum(steps, axis=1)])


def pattern_column(features: Sequence[str], means: Sequence[float]) -> Column:
    """Side pattern as an integer: bit j is set where feature j is above its mean."""
    pattern = F.lit(0)
    for j, (feature, mean) in enumerate(zip(features, means)):
        pattern = pattern + F.when(F.col(feature) > mean, 1 << j).otherwise(0)
    return pattern


def _cells(df: DataFrame, features: Sequence[str], means: Sequence[float], label: str) -> np.ndarray:
    """(pattern, label, count) of the rows; combined map-side to at most 2^(d+1) rows."""
    counted = df.where(F.col(label).isNotNull()).groupBy(pattern_column(features, means).alias("p"), F.col(label).cast("int").alias("y")).count()
    return np.array([tuple(r) for r in counted.collect()], dtype=np.int64).reshape(-1, 3)


def fit_stumps(
    df: DataFrame,
    features: Sequence[str],
    label: str = "y",
    rounds: int = 100,
    rate: float = 0.1,
    penalty: float = 1.0,
) -> StumpModel:
    """Two scans, whatever the number of rounds: feature means, then cell counts."""
    if len(features) > MAX_FEATURES:
        raise ValueError(f"at most {MAX_FEATURES} features; operators/boosting.py takes any number")
    means = tuple(df.agg(*[F.avg(c) for c in features]).first())
    cells = _cells(df, features, means, label)
    patterns, y, n = cells[:, 0], cells[:, 1].astype(float), cells[:, 2].astype(float)
    share = (y * n).sum() / n.sum()
    if not 0 < share < 1:
        raise ValueError("rows of both labels are needed")
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(n), base)
    split_on = np.arange(rounds) % len(features)
    leaves, hessians = np.zeros((rounds, 2)), np.zeros((rounds, 2))
    for t in range(rounds):
        p = sigmoid(margin)
        side = (patterns >> split_on[t]) & 1
        g = np.bincount(side, n * (p - y), 2)
        hessians[t] = np.bincount(side, n * p * (1 - p), 2)
        leaves[t] = -rate * g / (hessians[t] + penalty)
        margin = margin + leaves[t][side]
    return StumpModel(tuple(features), means, base, split_on, leaves, hessians, rate, penalty)


def _variance_terms(model: StumpModel, patterns: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(rows, trees) sampling weight min(1, sqrt(g^2 + l1 h^2)), taken before each tree."""
    p = sigmoid(model.margins(patterns)[:, :-1])
    g, h = p - y[:, None], p * (1 - p)
    return np.minimum(1.0, np.sqrt(g**2 + model.leaf_norms[None, :] * h**2))


def _all_cells(model: StumpModel) -> tuple[np.ndarray, np.ndarray]:
    patterns = np.tile(np.arange(1 << len(model.features), dtype=np.int64), 2)
    return patterns, np.repeat(np.array([0.0, 1.0]), len(patterns) // 2)


def _looked_up(rows: DataFrame, model: StumpModel, label: str, values: np.ndarray, kind: str) -> DataFrame:
    """Attach a value per (pattern, label) cell. The table covers unseen cells too, and its size
    depends on the number of features only."""
    patterns, y = _all_cells(model)
    cells = rows.sparkSession.createDataFrame(
        pa.table({"_p": patterns.astype(np.int32), "_y": y.astype(np.int32), "value": list(values)}),
        schema=f"_p int, _y int, value {kind}",
    )
    match = (pattern_column(model.features, model.means) == F.col("_p")) & (
        F.col(label).cast("int") == F.col("_y")
    )
    # a null label has no cell, hence a null value
    return rows.join(F.broadcast(cells), match, "left").drop("_p", "_y")


def value_mvs(rows: DataFrame, model: StumpModel, label: str = "y") -> DataFrame:
    """Minus the summed sampling weight: rows the booster needs most are suspect.

    Works for the training rows and, with known labels, for any other rows.
    """
    return _looked_up(rows, model, label, -_variance_terms(model, *_all_cells(model)).sum(axis=1), "double")


def mvs_trajectory(rows: DataFrame, model: StumpModel, label: str = "y") -> DataFrame:
    """One row per row and tree: `iter` and that tree's sampling weight."""
    terms = _variance_terms(model, *_all_cells(model))
    listed = _looked_up(rows, model, label, terms.tolist(), "array<double>")
    kept = [c for c in listed.columns if c != "value"]
    return listed.select(*kept, F.posexplode("value").alias("iter", "value"))


def value_leaf_influence(
    rows: DataFrame, model: StumpModel, target: DataFrame, label: str = "y", target_label: str | None = None
) -> DataFrame:
    """Effect of a row's weight on the loss of the `target` rows, structure fixed (after Sharchilev
    et al. 2018). A row whose upweighting lowers that loss is worth more.

    Target gradients are summed per (tree, leaf) from the target's cell counts first.
    """
    counted = _cells(target, model.features, model.means, target_label or label)
    patterns, y, n = counted[:, 0], counted[:, 1].astype(float), counted[:, 2]
    pull = n * (sigmoid(model.margins(patterns)[:, -1]) - y)
    side = model.sides(patterns)
    trees = np.arange(len(model.split_on))
    leaf_pull = np.stack([np.bincount(side[:, t], pull, 2) for t in trees])

    patterns, y = _all_cells(model)
    p = sigmoid(model.margins(patterns)[:, :-1])
    g, h = p - y[:, None], p * (1 - p)
    at = trees[None, :], model.sides(patterns)
    shift = -model.rate * (g + model.leaves[at] / model.rate * h) / (model.hessians[at] + model.penalty)
    influence = (leaf_pull[at] * shift).sum(axis=1)
    return _looked_up(rows, model, label, -influence, "double")


def predict_stumps(rows: DataFrame, model: StumpModel) -> DataFrame:
    """Add `probability`."""
    coefficient = [[0.0, 0.0] for _ in model.features]
    for j, leaf in zip(model.split_on, model.leaves):
        coefficient[j][0] += float(leaf[0])
        coefficient[j][1] += float(leaf[1])
    margin = F.lit(model.base)
    for (left, right), feature, mean in zip(coefficient, model.features, model.means):
        margin = margin + F.when(F.col(feature) > mean, right).otherwise(left)
    return rows.withColumn("probability", 1 / (1 + F.exp(-margin)))
