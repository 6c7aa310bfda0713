"""Statistics over replicates, datasets and steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowworth.operators.ordering import attach_totals, running_totals


def replicate_stats(metrics: DataFrame, by: Sequence[str] = ("dataset", "method", "metric")) -> DataFrame:
    """Mean and population standard deviation over replicates."""
    return metrics.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def replicate_table(
    metrics: DataFrame, replicates: Sequence[int], by: Sequence[str] = ("dataset", "method", "metric")
) -> DataFrame:
    """The same with one column `rep_<r>` per replicate; naming them spares the pivot a pass."""
    wide = metrics.groupBy(*by).agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        *[F.max(F.when(F.col("replicate") == r, F.col("value"))).alias(f"rep_{r}") for r in replicates],
    )
    return wide


def dataset_mean(
    metrics: DataFrame,
    rates: DataFrame | None = None,
    precision: Sequence[str] = ("precision_fp", "precision_tp"),
) -> DataFrame:
    """Per method and metric: mean and sample deviation, over replicates, of the mean over datasets.

    With base `rates` (dataset, fp_rate, tp_rate) precision becomes gain over the base rate.
    """
    rows = metrics
    if rates is not None:
        rate = F.when(F.col("metric") == precision[0], F.col("fp_rate")).when(
            F.col("metric") == precision[1], F.col("tp_rate")
        )
        rows = attach_totals(rows, rates.select("dataset", "fp_rate", "tp_rate"), ["dataset"])
        rows = rows.withColumn("value", F.col("value") - F.coalesce(rate, F.lit(0.0)))
    per_replicate = rows.groupBy("method", "metric", "replicate").agg(F.avg("value").alias("value"))
    return per_replicate.groupBy("method", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    )


def curve_stats(curve: DataFrame) -> DataFrame:
    """Mean and population deviation of actives found per method and step, starting from 0 at step 0."""
    per_step = curve.groupBy("method", "step").agg(
        F.avg("found").alias("mean"), F.stddev_pop("found").alias("std")
    )
    start = curve.select("method").distinct().select(
        "method", F.lit(0).alias("step"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("std")
    )
    return start.unionByName(per_step)


def wilcoxon_signed_rank(
    diffs: DataFrame, by: Sequence[str] = (), diff: str = "diff", exact_up_to: int = 12
) -> DataFrame:
    """One-sided signed-rank test that differences tend to be positive.

    Zero differences are left out and tied sizes share their mean rank. The null distribution is
    exact for up to `exact_up_to` differences and normal (tie-corrected) above. `p_floor` is the
    smallest p that many differences can give; p is 1 when the differences sum to 0.
    """
    by = list(by)
    size = F.abs(F.col(diff))
    ties = (
        diffs.where(F.col(diff).isNotNull())
        .groupBy(*by, size.alias("_size"))
        .agg(F.count(F.lit(1)).alias("_c"), F.count_if(F.col(diff) > 0).alias("_plus"), F.sum(diff).alias("_sum"))
    )
    nonzero = running_totals(ties.where(F.col("_size") > 0), ["_size"], {"_cum": "_c"}, by)
    # doubled mean rank of a tie, so that it stays whole
    twice_rank = 2 * F.col("_cum") - F.col("_c") + 1
    ranked = nonzero.withColumn("_rank2", twice_rank)
    totals = ranked.groupBy(*by).agg(
        F.sum("_c").alias("n"),
        (F.sum(F.col("_plus") * F.col("_rank2")) / 2).alias("w_plus"),
        F.sum(F.pow("_c", F.lit(3)) - F.col("_c")).alias("_tie"),
    )
    # only groups small enough for the exact test gather their ranks
    small = totals.where(F.col("n") <= exact_up_to).select(*by, F.col("n").alias("_small"))
    listed = (
        attach_totals(ranked, small, by)
        .where(F.col("_small").isNotNull())
        .groupBy(*by)
        .agg(
            F.flatten(F.collect_list(F.array_repeat(F.col("_rank2").cast("int"), F.col("_c").cast("int")))).alias(
                "_ranks"
            )
        )
    )
    # _ways[s]: number of sign choices whose doubled positive rank sum is s
    ways = F.aggregate(
        "_ranks",
        F.array(F.lit(1.0)),
        lambda acc, r: F.zip_with(
            F.concat(acc, F.array_repeat(F.lit(0.0), r)),
            F.concat(F.array_repeat(F.lit(0.0), r), acc),
            lambda a, b: a + b,
        ),
    )
    listed = listed.select(*by, ways.alias("_ways"))
    sums = diffs.groupBy(*by).agg(F.sum(diff).alias("_total"))
    rows = attach_totals(attach_totals(sums, totals, by), listed, by) if by else sums.join(
        totals, F.lit(True), "left"
    ).join(listed, F.lit(True), "left")
    n = F.col("n")
    upper = F.slice("_ways", (2 * F.col("w_plus")).cast("int") + 1, F.size("_ways"))
    exact = F.aggregate(upper, F.lit(0.0), lambda s, x: s + x) / F.pow(F.lit(2.0), n)
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_tie") / 48)
    z = (F.col("w_plus") - n * (n + 1) / 4) / spread
    p = (
        F.when(n.isNull() | (F.col("_total") == 0), F.lit(1.0))
        .when(n <= exact_up_to, exact)
        .otherwise(_normal_upper_tail(z))
    )
    return rows.select(
        *by,
        F.coalesce(n, F.lit(0)).alias("n"),
        F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"),
        p.alias("p"),
        F.pow(F.lit(0.5), F.coalesce(n, F.lit(0))).alias("p_floor"),
    )


def significant(tests: DataFrame, n_datasets: int, level: float = 0.05) -> DataFrame:
    """Flag tests below `level` shared over the datasets."""
    return tests.withColumn("significant", (F.col("p") < level / n_datasets).cast("int"))


# Coefficients of the error-function approximation 7.1.26 in Abramowitz and
# Stegun, absolute error below 1.5e-7.
_ERF_P = 0.3275911
_ERF_A = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]


def _normal_upper_tail(z):
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + _ERF_P * x)
    poly = F.lit(0.0)
    for a in reversed(_ERF_A):
        poly = (poly + a) * t
    half = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, half).otherwise(1 - half)
