"""Newton-boosted histogram trees on feature arrays of any width, and the values read off them.

Features are cut at even steps between their smallest and largest value. A level of a tree needs
the gradient and curvature sums of each (node, feature, bin), one scan whose result has the size of
the model; several boosters that differ in their rows share the scans. Fixed cuts and ties that fall to
the first feature and cut make the result reproducible.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowworth.functions.blocks import matrix, sigmoid, vector
from rowworth.operators.sums import add_up
from rowworth.session import settle

# gains are compared after rounding, so that equal splits do not depend on the order of sums
GAIN_DIGITS = 9
# a class that a set of rows lacks counts as rarer than this
RAREST = 1e-6


@dataclass(frozen=True)
class Booster:
    edges: np.ndarray  # (features, bins - 1) cuts
    base: float
    feature: np.ndarray  # (trees, 2^depth - 1) by level and node, -1 without a split
    cut: np.ndarray  # (trees, 2^depth - 1) last bin that goes left
    leaves: np.ndarray  # (trees, 2^depth) leaf values
    hessians: np.ndarray  # (trees, 2^depth) training curvature
    rate: float
    penalty: float

    @property
    def leaf_norms(self) -> np.ndarray:
        return np.abs(self.leaves).sum(axis=1)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return binned(x, self.edges)

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """(rows, trees) leaf of each row in each tree."""
        return np.stack([node_of(bins, f, c) for f, c in zip(self.feature, self.cut)], axis=1) if len(self.feature) else np.zeros((len(bins), 0), int)

    def margins(self, leaf: np.ndarray) -> np.ndarray:
        """(rows, trees + 1) margin before each tree, and the final one."""
        steps = self.leaves[np.arange(len(self.leaves))[None, :], leaf]
        return self.base + np.hstack([np.zeros((len(leaf), 1)), np.cumsum(steps, axis=1)])


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    bins = np.zeros(x.shape, dtype=np.int64)
    for k in range(edges.shape[1]):
        bins += x > edges[None, :, k]
    return bins


def node_of(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Node of each row after the levels that `feature` and `cut` describe."""
    node = np.zeros(len(bins), dtype=np.int64)
    width = 1
    while width <= len(feature):
        at = width - 1 + node
        split = feature[at]
        right = (split >= 0) & (bins[np.arange(len(bins)), np.maximum(split, 0)] > cut[at])
        node = 2 * node + right
        width *= 2
    return node


def feature_edges(df: DataFrame, bins: int, features: str = "features") -> np.ndarray:
    """(features, bins - 1) even cuts between the extremes of each place; null and NaN are left out."""
    cells = df.select(F.posexplode(features).alias("pos", "x")).where(F.col("x").isNotNull() & ~F.isnan(F.col("x").cast("double")))
    found = cells.groupBy("pos").agg(F.min(F.col("x").cast("double")).alias("low"), F.max(F.col("x").cast("double")).alias("high"))
    rows = sorted(found.collect())
    low, high = (np.array([r[i] for r in rows], dtype=np.float64) for i in (1, 2))
    return low[:, None] + (high - low)[:, None] * np.arange(1, bins)[None, :] / bins


def fit_boosters(
    df: DataFrame,
    label: str = "y",
    features: str = "features",
    pools: str | None = None,
    rounds: int = 20,
    depth: int = 3,
    bins: int = 16,
    rate: float = 0.1,
    penalty: float = 1.0,
) -> list[Booster]:
    """One booster for each place of `pools`, an array of 0 or 1 saying whose rows these are; without it one of all rows.

    Rows without a label are left out. `depth` scans a round serve all boosters.
    """
    known = df.where(F.col(label).isNotNull())
    member = F.col(pools).cast("array<double>") if pools else F.array(F.lit(1.0))
    rows = settle(known.select(F.col(label).cast("double").alias("y"), F.col(features).alias("x"), member.alias("member")))
    edges = feature_edges(rows, bins, "x")
    width = len(edges)

    def labels(batches):
        total = 0.0
        for batch in batches:
            y, pool = vector(batch.column(0)), matrix(batch.column(2))
            if len(y):
                total = total + np.stack([pool.sum(axis=0), (pool * y[:, None]).sum(axis=0)])
        if isinstance(total, np.ndarray):
            yield 0, total

    sizes = add_up(rows, labels).get(0)
    if sizes is None:
        raise ValueError("a booster needs rows with a label")
    n, positive = sizes.reshape(2, -1)
    share = np.clip(positive / np.maximum(n, 1), RAREST, 1 - RAREST)
    base = np.log(share / (1 - share))
    count, nodes = len(n), 1 << depth
    empty = [np.zeros((0, nodes - 1), np.int64), np.zeros((0, nodes - 1), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes))]
    models = [Booster(edges, float(base[c]), *empty, rate, penalty) for c in range(count)]
    for _ in range(rounds):
        feature = np.full((count, nodes - 1), -1, dtype=np.int64)
        cut = np.zeros((count, nodes - 1), dtype=np.int64)
        below = np.zeros((count, nodes, 2))
        for level in range(depth):
            first = (1 << level) - 1
            sums = add_up(rows, _histograms(models, feature[:, :first], cut[:, :first], 1 << level, bins))
            for c in range(count):
                found = sums.get(c)
                if found is None:
                    continue
                split, place, sides = _best_splits(found.reshape(1 << level, width, bins, 2), penalty)
                feature[c, first : first + (1 << level)], cut[c, first : first + (1 << level)] = split, place
                below[c, : 2 << level] = sides
        leaves = -rate * below[:, :, 0] / (below[:, :, 1] + penalty)
        models = [
            Booster(
                edges, m.base, np.vstack([m.feature, feature[c : c + 1]]), np.vstack([m.cut, cut[c : c + 1]]),
                np.vstack([m.leaves, leaves[c : c + 1]]), np.vstack([m.hessians, below[c : c + 1, :, 1]]), rate, penalty,
            )
            for c, m in enumerate(models)
        ]
    return models


def _histograms(models: list[Booster], feature: np.ndarray, cut: np.ndarray, nodes: int, bins: int):
    """Gradient and curvature sums by node of the growing tree, feature and bin, a slot for each booster."""

    def partial(batches):
        width = len(models[0].edges)
        sums = np.zeros((len(models), nodes * width * bins, 2))
        seen = False
        for batch in batches:
            y, pool = vector(batch.column(0)), matrix(batch.column(2))
            if not len(y):
                continue
            seen = True
            binned_rows = models[0].bins(matrix(batch.column(1)))
            for c, model in enumerate(models):
                mine = pool[:, c] > 0
                if not mine.any():
                    continue
                here = binned_rows[mine]
                p = sigmoid(model.margins(model.leaf_of(here))[:, -1])
                node = node_of(here, feature[c], cut[c])
                at = ((node[:, None] * width + np.arange(width)[None, :]) * bins + here).ravel()
                for k, term in enumerate((p - y[mine], p * (1 - p))):
                    sums[c, :, k] += np.bincount(at, np.repeat(term, width), nodes * width * bins)
        if seen:
            for c in range(len(models)):
                yield c, sums[c]

    return partial


def _best_splits(sums: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature and cut of the largest gain at each node (ties: the first), and the sums of both sides."""
    nodes, width, bins, _ = sums.shape
    left = np.cumsum(sums, axis=2)
    total = left[:, :1, -1:, :]

    def score(part):
        return part[..., 0] ** 2 / (part[..., 1] + penalty)

    gain = np.round(score(left) + score(total - left) - score(total), GAIN_DIGITS)
    flat = gain[:, :, : bins - 1].reshape(nodes, -1)
    best = flat.argmax(axis=1)
    split, place = best // (bins - 1), best % (bins - 1)
    some = flat[np.arange(nodes), best] > 0
    sides = np.zeros((nodes, 2, 2))
    sides[:, 0] = np.where(some[:, None], left[np.arange(nodes), split, place], total[:, 0, 0])
    sides[:, 1] = total[:, 0, 0] - sides[:, 0]
    return np.where(some, split, -1), np.where(some, place, 0), sides.reshape(2 * nodes, 2)


def _terms(model: Booster, leaf: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = sigmoid(model.margins(leaf)[:, :-1])
    return p - y[:, None], p * (1 - p)


def _mvs(model: Booster, bins: np.ndarray, y: np.ndarray) -> np.ndarray:
    g, h = _terms(model, model.leaf_of(bins), y)
    return -np.minimum(1.0, np.sqrt(g**2 + model.leaf_norms[None, :] * h**2)).sum(axis=1)


def _filled(values: np.ndarray) -> pa.Array:
    # a null label has no value
    return pa.array(values, pa.float64(), mask=np.isnan(values))


def value_mvs(rows: DataFrame, model: Booster, label: str = "y", features: str = "features") -> DataFrame:
    """Minus the summed sampling weight min(1, sqrt(g^2 + l1 h^2)), taken before each tree; null without a label."""

    @F.arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return _filled(_mvs(model, model.bins(matrix(x)), vector(y)) if len(y) else np.zeros(0))

    return rows.withColumn("value", run(features, F.col(label).cast("double")))


def pool_values_mvs(models: list[Booster], features: Column, label: Column) -> Column:
    """An array: the value of the row under each booster."""

    @F.arrow_udf("array<double>")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        if not len(y):
            return pa.array([], pa.list_(pa.float64()))
        bins, y = models[0].bins(matrix(x)), vector(y)
        found = np.stack([_mvs(m, bins, y) for m in models], axis=1)
        return pa.array(found.tolist(), pa.list_(pa.float64()))

    return run(features, label.cast("double"))


def value_leaf_influence(
    rows: DataFrame, model: Booster, target: DataFrame, label: str = "y", target_label: str | None = None, features: str = "features"
) -> DataFrame:
    """Effect of a row's weight on the loss of the `target` rows with the trees as they are (after Sharchilev
    et al. 2018). A row whose upweighting lowers that loss is worth more; null without a label.

    The target's gradients are summed by (tree, leaf) first, so no (row, target) pair is formed.
    """
    trees, leaves = model.leaves.shape

    def pulls(batches):
        total = np.zeros((trees, leaves))
        for batch in batches:
            y = vector(batch.column(0))
            if len(y):
                leaf = model.leaf_of(model.bins(matrix(batch.column(1))))
                pull = sigmoid(model.margins(leaf)[:, -1]) - y
                for t in range(trees):
                    total[t] += np.bincount(leaf[:, t], pull, leaves)
        yield 0, total

    wanted = target.where(F.col(target_label or label).isNotNull()).select(F.col(target_label or label).cast("double"), features)
    pull = add_up(wanted, pulls).get(0, np.zeros(trees * leaves)).reshape(trees, leaves)

    @F.arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        if not len(y):
            return pa.array([], pa.float64())
        leaf = model.leaf_of(model.bins(matrix(x)))
        g, h = _terms(model, leaf, vector(y))
        at = np.arange(trees)[None, :], leaf
        shift = -model.rate * (g + model.leaves[at] / model.rate * h) / (model.hessians[at] + model.penalty)
        return _filled(-(pull[at] * shift).sum(axis=1))

    return rows.withColumn("value", run(features, F.col(label).cast("double")))


def predict_booster(rows: DataFrame, model: Booster, features: str = "features") -> DataFrame:
    """Add `probability`."""

    @F.arrow_udf("double")
    def run(x: pa.Array) -> pa.Array:
        return pa.array(sigmoid(model.margins(model.leaf_of(model.bins(matrix(x))))[:, -1]) if len(x) else [], pa.float64())

    return rows.withColumn("probability", run(features))
