"""Does dropping low- or high-valued rows help a model? Removal sweeps over one ranked table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowworth.operators.metrics import accuracy, auroc, average_precision, rmspe
from rowworth.operators.many_logistic import fit_many, probabilities
from rowworth.operators.models import fit_all, fit_classifier, predict
from rowworth.operators.ordering import attach_totals, rank_rows
from rowworth.operators.removal import LEVEL_SHARE, LEVELS, level_counts, ranked_negatives
from rowworth.session import settle

# steps and step length of the default learner
EPOCHS = 20
RATE = 1.0


def undersample_sweep(
    valued: DataFrame,
    val: DataFrame,
    label: str = "y",
    val_label: str = "y",
    estimator: Estimator | None = None,
    levels: int = LEVELS,
    epochs: int = EPOCHS,
    rate: float = RATE,
    seed: int = 0,
    exempt_positives: bool = True,
) -> DataFrame:
    """`(level, pct, counts, basic, high, low, random)`: validation PR-AUC without removal, and without the
    `counts` highest-valued, lowest-valued and randomly drawn negatives (rows of either label if not `exempt_positives`).

    Rows are ranked once by value and once by a seeded draw. The models differ only in the rows they see, so
    the default learner fits all of them in one scan a step and scores them in one; an `estimator`
    is fitted once for each.
    """
    counts = level_counts(valued.count(), levels)
    runs = [("basic", 0)] + [(side, level) for level in range(1, levels + 1) for side in ("high", "low", "random")]
    # class weights are those of the full table at every level
    sizes = {r[0]: r[1] for r in valued.groupBy(label).agg(F.count(F.lit(1))).collect()}
    total = sum(sizes.values())
    heavy = {y: (total / max(sizes.get(y, 0), 1)) ** 0.5 for y in (0, 1)}
    weight = F.when(F.col(label) == 1, heavy[1]).otherwise(heavy[0])
    rows = settle(_removal_places(valued, label, seed, exempt_positives).withColumn("_weight", weight))

    def kept(side: str, level: int):
        if side == "basic":
            return F.lit(True)
        beyond = F.col(f"_{side}") > counts[level - 1]
        return (F.col(label) == 1) | beyond if exempt_positives else beyond

    target = val.select("id", F.col(val_label).alias("truth"), "features")
    scored = _scored_runs(rows, target, runs, kept, label, "_weight", estimator, epochs, rate)
    areas = settle(average_precision(scored, "truth", "probability", by=["side", "level"]))
    basic = areas.where(F.col("side") == "basic").select(F.col("average_precision").alias("basic"))
    sides = areas.where(F.col("side") != "basic").groupBy("level").agg(
        *[F.max(F.when(F.col("side") == side, F.col("average_precision"))).alias(side) for side in ("high", "low", "random")]
    )
    removed = F.element_at(F.array(*[F.lit(k) for k in counts]), F.col("level"))
    return attach_totals(sides, basic).select(
        "level",
        F.round(F.col("level") * LEVEL_SHARE, 3).alias("pct"),
        removed.alias("counts"),
        "basic",
        "high",
        "low",
        "random",
    )


def _removal_places(valued: DataFrame, label: str, seed: int, exempt_positives: bool) -> DataFrame:
    """Rows with `_low`, `_high` and `_random`, their places among the rows that can go; only ids and keys are put in order."""
    group = F.col(label) if exempt_positives else F.lit(0)
    slim = settle(valued.select("id", "value", group.alias("_label")))
    by_value = ranked_negatives(slim, "_label").select("id", F.col("from_low").alias("_low"), F.col("from_high").alias("_high"))
    drawn = ranked_negatives(slim, "_label", "random", seed).select("id", F.col("from_low").alias("_random"))
    return valued.select("id", label, "features").join(by_value, "id").join(drawn, "id")


def _scored_runs(rows, target, runs, kept, label, weight, estimator, epochs, rate) -> DataFrame:
    """`(side, level, the target's columns but features, probability, predicted)` of the models of all runs."""
    carried = [c for c in target.columns if c != "features"]
    if estimator is None:
        row_weight = F.col(weight) if weight else F.lit(1.0)
        weights = F.array(*[F.when(kept(side, level), row_weight).otherwise(F.lit(0.0)) for side, level in runs])
        models = fit_many(rows.withColumn("_weights", weights), "_weights", label, epochs=epochs, rate=rate)[-1]
        names = F.array(*[F.struct(F.lit(side).alias("side"), F.lit(level).alias("level")) for side, level in runs])
        long = target.select(*carried, F.posexplode(probabilities(models, F.col("features"))).alias("_run", "probability"))
        run = names[F.col("_run")]
        return long.select(
            run["side"].alias("side"), run["level"].alias("level"), *carried, "probability",
            (F.col("probability") >= 0.5).cast("int").alias("predicted"),
        )
    models = fit_all(
        rows.sparkSession,
        [lambda run=run: fit_classifier(rows.where(kept(*run)), estimator, label, weight=weight) for run in runs],
    )
    scored = None
    for (side, level), model in zip(runs, models):
        part = predict(model, target).select(F.lit(side).alias("side"), F.lit(level).alias("level"), *carried, "probability", "predicted")
        scored = part if scored is None else scored.unionByName(part)
    return scored


def undersample_assays(
    long: DataFrame,
    aids: list[str],
    valuer: Callable[[DataFrame], DataFrame],
    estimator: Estimator | None = None,
    levels: int = LEVELS,
    **options,
) -> DataFrame:
    """The sweep for several assays of `(id, aid, activity, split, features)` rows, with `aid` in front.

    Stored by assay, each sweep reads its own partition only.
    """
    out = None
    for aid in aids:
        rows = long.where(F.col("aid") == aid).withColumn("y", (F.col("activity") > 0.5).cast("int"))
        train = settle(rows.where(F.col("split") == "train"))
        val = settle(rows.where(F.col("split") == "validation"))
        part = undersample_sweep(settle(valuer(train)), val, estimator=estimator, levels=levels, **options)
        part = part.select(F.lit(aid).alias("aid"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def sweep_replicates(
    train: DataFrame, val: DataFrame, valuer: Callable[[DataFrame, int], DataFrame], replicates: int = 5, **options
) -> DataFrame:
    """The sweep once for each seed, which the value method and the random removal take, with `replicate` in front."""
    out = None
    for seed in range(replicates):
        part = undersample_sweep(settle(valuer(train, seed)), val, seed=seed, **options)
        part = part.select(F.lit(seed).alias("replicate"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def _measure(scored: DataFrame, metric: str, by: list[str]) -> DataFrame:
    if metric == "auc":
        return auroc(scored, "truth", "probability", by, out="performance")
    if metric == "accuracy":
        return accuracy(scored, "truth", "predicted", by).withColumnRenamed("accuracy", "performance")
    return rmspe(scored, "truth", "predicted", by).withColumnRenamed("rmspe", "performance")


def remove_high_low(
    valued: DataFrame,
    valid: DataFrame,
    test: DataFrame,
    metric: str = "auc",
    label: str = "y",
    estimator: Estimator | None = None,
    bins: int = 20,
    epochs: int = EPOCHS,
    rate: float = RATE,
) -> DataFrame:
    """`(side, bin, valid, test)`: performance after removing bin * 5 % of all rows from the low or
    the high end. Where fewer than two label values remain nothing is fitted and the columns hold 0
    (1 for the error metric). The default learner fits the models of all bins in one scan a step."""
    slim = rank_rows(valued.select("id", "value"), ["value", "id"], out="_low").select("id", "_low")
    ranked = settle(valued.select("id", label, "features").join(slim, "id"))
    # two candidates, or more label values for a regression: what matters is whether they differ
    n = ranked.count()
    place = {"low": F.col("_low"), "high": n - F.col("_low") + 1}
    cuts = [int(b * n / bins) for b in range(bins)]
    spread = ranked.agg(
        *[
            (F.min(F.when(place[side] > k, F.col(label))) < F.max(F.when(place[side] > k, F.col(label)))).alias(
                f"{side}_{b}"
            )
            for side in place
            for b, k in enumerate(cuts)
        ]
    ).first()
    runs = [(s, b) for s in place for b in range(bins) if spread[f"{s}_{b}"]]
    target = valid.select("id", F.col(label).alias("truth"), "features", F.lit("valid").alias("part")).unionByName(
        test.select("id", F.col(label).alias("truth"), "features", F.lit("test").alias("part"))
    )
    # without any run a bin outside the grid stands in
    scored = _scored_runs(
        ranked, settle(target), runs or [("low", -1)], lambda s, b: place[s] > cuts[b], label, None, estimator, epochs, rate
    ).withColumnRenamed("level", "bin")
    measured = settle(_measure(scored, metric, ["side", "bin", "part"]))
    wide = measured.groupBy("side", "bin").agg(
        *[F.max(F.when(F.col("part") == p, F.col("performance"))).alias(p) for p in ("valid", "test")]
    )
    missing = F.lit(1.0 if metric == "rmspe" else 0.0)
    grid = valued.sparkSession.range(bins).select(
        F.explode(F.array(F.lit("low"), F.lit("high"))).alias("side"), F.col("id").cast("int").alias("bin")
    )
    return grid.join(wide, ["side", "bin"], "left").select(
        "side", "bin", *[F.coalesce(p, missing).alias(p) for p in ("valid", "test")]
    )


def learn_with_values(removal: DataFrame, metric: str = "auc") -> DataFrame:
    """Test performance at the removal level that is best on the validation rows."""
    better = F.col("valid") if metric == "rmspe" else -F.col("valid")
    order = F.struct(better, F.col("side") != "low", F.col("bin"))
    return removal.agg(
        F.min_by("side", order).alias("side"), F.min_by("bin", order).alias("bin"), F.min_by("test", order).alias("test")
    )


def learn_baseline(
    train: DataFrame, test: DataFrame, metric: str = "auc", label: str = "y", estimator: Estimator | None = None
) -> DataFrame:
    """Test performance without any removal."""
    model = fit_classifier(train, estimator, label)
    scored = predict(model, test.select("id", F.col(label).alias("truth"), "features"))
    return _measure(scored, metric, []).select(F.col("performance").alias("test"))
