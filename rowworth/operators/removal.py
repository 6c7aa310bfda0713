"""Taking and dropping rows by value. One ranked table answers every removal level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowworth.functions.columns import seeded_key
from rowworth.operators.ordering import attach_totals, rank_rows
from rowworth.session import settle

LEVELS = 19
LEVEL_SHARE = 0.05


def rank_batch(
    rest: DataFrame, acquisition: str, share: float, total: int | None = None, id_col: str = "id"
) -> DataFrame:
    """The lowest floor(total * share) rows of `rest`, or all if there are fewer.

    `total` is the size of the whole set when `rest` is only what is left of it.
    """
    if total is not None:
        return lowest_rows(rest, int(total * share), acquisition, id_col)
    ranked = rank_rows(rest, [acquisition, id_col], out="rank")
    size = ranked.agg(F.max("rank").alias("_n"))
    picked = attach_totals(ranked, size).where(F.col("rank") <= F.floor(F.col("_n") * F.lit(share)))
    return picked.drop("_n")


# sketch precision, and the shares of a group that the sketch answers for
_ACCURACY = 2000
_SHARES = [0.002 * 1.3**i for i in range(24)]


def _enough(count: int, filled: Column, at: Column) -> Column:
    """The sketch's answer for the first share whose rows are more than `count` in spite of its error; null if none is."""
    return F.coalesce(*[F.when(F.lit(share - 2 / _ACCURACY) * filled > count, at[i]) for i, share in enumerate(_SHARES)])


def value_bounds(df: DataFrame, count: int, values: Sequence[Column]) -> list[float | None]:
    """For each column of values a bound that more than `count` of them should not exceed, by a sketch; none if there are too few."""
    sketches = df.agg(
        *[F.count(v).alias(f"_n{i}") for i, v in enumerate(values)],
        *[F.percentile_approx(v, _SHARES, _ACCURACY).alias(f"_at{i}") for i, v in enumerate(values)],
    )
    return list(sketches.select(*[_enough(count, F.col(f"_n{i}"), F.col(f"_at{i}")) for i in range(len(values))]).first())


def lowest_rows(df: DataFrame, count: int, value: str, id_col: str = "id", by: Sequence[str] = ()) -> DataFrame:
    """The `count` rows of each group with the lowest (value, id); all where there are fewer. Null values come last.

    A quantile sketch bounds the value that the last of them can have, and only rows up to there are
    put in order. If a bound proves too low, all rows are.
    """
    by = list(by)
    if count <= 0:
        return df.select(*by, id_col, value).limit(0)
    slim = settle(df.select(*by, id_col, value))
    sketch = slim.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.count(value).alias("_filled"), F.percentile_approx(value, _SHARES, _ACCURACY).alias("_at")
    )
    bounds = settle(sketch.select(*by, "_n", _enough(count, F.col("_filled"), F.col("_at")).alias("_bound")))
    near = attach_totals(slim, bounds, by).where(F.col("_bound").isNull() | (F.col(value) <= F.col("_bound"))).select(*by, id_col, value)
    order = [F.col(value).asc_nulls_last(), id_col]
    taken = settle(rank_rows(near, order, by, "_rank").where(F.col("_rank") <= count).select(*by, id_col, value))
    if taken.count() < bounds.agg(F.sum(F.least("_n", F.lit(count)))).first()[0]:
        taken = rank_rows(slim, order, by, "_rank").where(F.col("_rank") <= count).select(*by, id_col, value)
    return taken


def ranked_negatives(
    valued: DataFrame, label: str = "primary", mode: str = "value", seed: int = 0, id_col: str = "id"
) -> DataFrame:
    """Add `from_low` and `from_high`, each row's place among the rows of its label, from 1.

    `mode="random"` places rows by a seeded shuffle instead of by value.
    """
    key = seeded_key(F.col(id_col), seed) if mode == "random" else F.col("value")
    ranked = rank_rows(valued.withColumn("_key", key), ["_key", id_col], [label], "from_low").drop("_key")
    ranked = settle(ranked)
    sizes = ranked.groupBy(label).agg(F.max("from_low").alias("_n"))
    both = attach_totals(ranked, sizes, [label])
    return both.withColumn("from_high", F.col("_n") - F.col("from_low") + 1).drop("_n")


def keep_after_removal(ranked: DataFrame, n_removed, side: str, label: str = "primary") -> DataFrame:
    """All positives, and the negatives beyond the `n_removed` lowest (`low`) or highest (`high`)."""
    place = F.col("from_high" if side == "high" else "from_low")
    return ranked.where((F.col(label) == 1) | (place > n_removed))


def remove_k(
    valued: DataFrame,
    n_removed: int | None = None,
    ratio: float | None = None,
    mode: str = "low",
    seed: int = 0,
    label: str | None = "primary",
    id_col: str = "id",
) -> DataFrame:
    """Drop negatives: lowest- or highest-valued, or seeded random ones.

    Give their number, or the positive-to-negative ratio to be left. With `label=None` rows of
    either label are dropped.
    """
    side = "high" if mode == "high" else "low"
    if label is None:
        # any label may go, so the whole table is one group without exempt rows
        everything = valued.withColumn("_any", F.lit(0))
        return remove_k(everything, n_removed, ratio, mode, seed, "_any", id_col).drop("_any")
    ranked = ranked_negatives(valued, label, "random" if mode == "random" else "value", seed, id_col)
    if ratio is None:
        return keep_after_removal(ranked, n_removed, side, label).select(*valued.columns)
    totals = valued.agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_q"))
    surplus = F.col("_q") - F.floor(F.col("_p") / F.lit(ratio))
    kept = keep_after_removal(attach_totals(ranked, totals), surplus, side, label)
    return kept.select(*valued.columns)


def level_counts(n_rows: int, levels: int = LEVELS) -> list[int]:
    """Rows to remove at each 5 % level; the small term keeps 0.05 * j * n from falling below a whole."""
    return [int(n_rows * LEVEL_SHARE * j + 1e-9) for j in range(1, levels + 1)]


def removal_schedule(valued: DataFrame, label: str = "primary", levels: int = LEVELS) -> DataFrame:
    """Per level and side: rows to remove, rows kept, and the mean value of the kept negatives.

    A negative survives the levels whose count is below its place. So each row is put once in
    the bin of its last level, and sums over the few bins replace a scan per level.
    """
    ranked = ranked_negatives(valued, label)
    totals = valued.agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(label) == 1).alias("_p"))
    counts = F.transform(
        F.sequence(F.lit(1), F.lit(levels)), lambda j: F.floor(F.col("_n") * LEVEL_SHARE * j + 1e-9)
    )
    planned = totals.withColumn("_counts", counts)
    negatives = attach_totals(ranked.where(F.col(label) == 0), planned)
    sides = negatives.select(
        "value",
        "_counts",
        F.explode(
            F.array(
                F.struct(F.lit("low").alias("side"), F.col("from_low").alias("place")),
                F.struct(F.lit("high").alias("side"), F.col("from_high").alias("place")),
            )
        ).alias("_s"),
    ).select("value", "_counts", "_s.side", "_s.place")
    last = F.size(F.filter("_counts", lambda c: c < F.col("place")))
    bins = sides.groupBy("side", last.alias("_last")).agg(
        F.count(F.lit(1)).alias("_c"), F.sum("value").alias("_v")
    )
    plan = planned.select("_p", F.posexplode("_counts").alias("level", "n_removed")).select(
        "_p", (F.col("level") + 1).alias("level"), "n_removed", F.explode(F.array(F.lit("low"), F.lit("high"))).alias("side")
    )
    # at most levels + 1 bins per side
    bins = F.broadcast(bins.withColumnRenamed("side", "_side"))
    joined = plan.join(bins, (F.col("side") == F.col("_side")) & (F.col("_last") >= F.col("level")), "left")
    return joined.groupBy("level", "side", "n_removed", "_p").agg(
        F.coalesce(F.sum("_c"), F.lit(0)).alias("_kept"), (F.sum("_v") / F.sum("_c")).alias("mean_kept")
    ).select("level", "side", "n_removed", (F.col("_p") + F.col("_kept")).alias("kept"), "mean_kept")


def corruption_curve(
    valued: DataFrame, noisy: str = "noisy", value: str = "value", bins: int = 20, id_col: str = "id"
) -> DataFrame:
    """Share of the known noisy rows met when rows are inspected from low value, per 5 % step.

    `optimal` and `random` are the curves of a perfect and of a blind order. Without noisy rows
    `found` and `optimal` are null.
    """
    ranked = settle(rank_rows(valued.select(id_col, value, noisy), [value, id_col], out="_rank"))
    totals = ranked.agg(F.max("_rank").alias("_n"), F.sum(noisy).alias("_bad"))
    # first bin b with rank <= floor(b * n / bins)
    bin_of = F.ceil(F.col("_rank") * bins / F.col("_n"))
    per_bin = (
        attach_totals(ranked, totals)
        .groupBy(bin_of.cast("int").alias("_bin"))
        .agg(F.sum(noisy).alias("_found"))
    )
    steps = totals.select("_n", "_bad", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    # at most `bins` rows on either side
    joined = steps.join(F.broadcast(per_bin), F.col("_bin") <= F.col("bin"), "left")
    summed = joined.groupBy("bin", "_n", "_bad").agg(F.coalesce(F.sum("_found"), F.lit(0)).alias("_sum"))
    step = F.col("bin") / bins
    return summed.select(
        "bin",
        F.try_divide("_sum", "_bad").alias("found"),
        F.when(F.col("_bad") > 0, F.least(step / F.nullif(F.col("_bad") / F.col("_n"), F.lit(0.0)), F.lit(1.0))).alias("optimal"),
        step.alias("random"),
    )
