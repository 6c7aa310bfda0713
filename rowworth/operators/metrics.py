"""Ranking and classification metrics. Each is one aggregate, or one distributed sort and one
aggregate; `by` groups (dataset, method, replicate, ...) are computed together."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowworth.operators.ordering import attach_totals, rank_rows, running_totals
from rowworth.session import settle


def _ratio(top: Column, bottom: Column) -> Column:
    """0 where nothing was counted."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def base_rates(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of false and true positives among the judged rows of `label_views`."""
    return (
        df.where(F.col("is_eval") == 1)
        .groupBy(*by)
        .agg(F.avg("y_f").alias("fp_rate"))
        .withColumn("tp_rate", 1 - F.col("fp_rate"))
    )


def class_totals(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg")
    )


def _flag_sums(flag: str, truth: str) -> tuple[Column, Column]:
    judged = F.col("is_eval") == 1
    flagged = F.count_if(judged & (F.col(flag) == 1))
    hits = F.count_if(judged & (F.col(flag) == 1) & (F.col(truth) == 1))
    return hits, flagged


def precision_at_flag(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of the judged flagged rows, the share that is what the flag says; 0 when none is flagged."""
    return df.groupBy(*by).agg(
        _ratio(*_flag_sums("flag_lo", "y_f")).alias("precision_fp"),
        _ratio(*_flag_sums("flag_hi", "y_c")).alias("precision_tp"),
    )


def enrichment(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """`enrichment_*` is precision times base rate, as published; `enrichment_ratio_*` divides."""
    judged = F.count_if(F.col("is_eval") == 1)
    cols = []
    for side, flag, truth in (("fp", "flag_lo", "y_f"), ("tp", "flag_hi", "y_c")):
        precision = _ratio(*_flag_sums(flag, truth))
        rate = _ratio(F.count_if((F.col("is_eval") == 1) & (F.col(truth) == 1)), judged)
        cols += [
            (precision * rate).alias(f"enrichment_{side}"),
            _ratio(precision, rate).alias(f"enrichment_ratio_{side}"),
        ]
    return df.groupBy(*by).agg(*cols)


def bedroc(
    df: DataFrame,
    truth: str,
    value: str = "value",
    descending: bool = False,
    alpha: float = 20.0,
    by: Sequence[str] = (),
    id_col: str = "id",
    out: str = "bedroc",
) -> DataFrame:
    """Early-recognition score of a ranking (Truchon and Bayly 2007); null without both classes."""
    first = F.col(value).desc() if descending else F.col(value).asc()
    slim = df.select(*by, id_col, value, truth)
    ranked = rank_rows(slim, [first, id_col], by, "_rank")
    sizes = ranked.groupBy(*by).agg(F.max("_rank").alias("_n"))
    n = F.col("_n")
    sums = (
        attach_totals(ranked, sizes, by)
        .groupBy(*by)
        .agg(
            F.max("_n").alias("_n"),
            F.count_if(F.col(truth) == 1).alias("_hits"),
            F.sum(F.when(F.col(truth) == 1, F.exp(-alpha * F.col("_rank") / n))).alias("_weight"),
        )
    )
    share = F.col("_hits") / n
    rie = F.col("_weight") / (share * (1 - math.exp(-alpha)) / F.expm1(alpha / n))
    best = (1 - F.exp(-alpha * share)) / (share * (1 - math.exp(-alpha)))
    worst = (1 - F.exp(alpha * share)) / (share * (1 - math.exp(alpha)))
    mixed = (F.col("_hits") > 0) & (F.col("_hits") < n)
    return sums.select(*by, F.when(mixed, (rie - worst) / (best - worst)).alias(out))


def diversity_rate(df: DataFrame, group_key: str, by: Sequence[str] = (), error: float | None = None) -> DataFrame:
    """Distinct group keys per 100 flagged rows, over all flagged rows; 0 when none is flagged.

    With `error`, the relative standard deviation allowed, keys are counted by mergeable sketches of a
    fixed size, so that the keys themselves are not shuffled.
    """
    cols = []
    for side, flag in (("fp", "flag_lo"), ("tp", "flag_hi")):
        flagged = F.col(flag) == 1
        key = F.when(flagged, F.col(group_key))
        distinct = F.count_distinct(key) if error is None else F.approx_count_distinct(key, error)
        cols.append((100 * _ratio(distinct, F.count_if(flagged))).alias(f"diversity_{side}"))
    return df.groupBy(*by).agg(*cols)


def _score_counts(df: DataFrame, truth: str, score: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by, score).agg(
        F.count(F.lit(1)).alias("_c"), F.count_if(F.col(truth) == 1).alias("_pos")
    )


def average_precision(
    df: DataFrame, truth: str, score: str, by: Sequence[str] = (), out: str = "average_precision"
) -> DataFrame:
    """Sum of precision times recall step over distinct thresholds; null without positives."""
    by = list(by)
    counts = _score_counts(df, truth, score, by)
    steps = running_totals(counts, [F.col(score).desc()], {"_n": "_c", "_tp": "_pos"}, by)
    area = F.sum(F.col("_pos") * F.col("_tp") / F.col("_n")) / F.sum("_pos")
    return steps.groupBy(*by).agg(F.when(F.sum("_pos") > 0, area).alias(out))


def auroc(df: DataFrame, truth: str, score: str, by: Sequence[str] = (), out: str = "auroc") -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties counting half; no pair is formed."""
    by = list(by)
    counts = _score_counts(df, truth, score, by).withColumn("_neg", F.col("_c") - F.col("_pos"))
    steps = running_totals(counts, [score], {"_neg_to": "_neg"}, by)
    wins = F.sum(F.col("_pos") * (F.col("_neg_to") - F.col("_neg") / 2))
    pairs = F.sum("_pos") * F.sum("_neg")
    return steps.groupBy(*by).agg(F.when(pairs > 0, wins / pairs).alias(out))


def rmspe(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Root mean squared relative error; rows whose truth is 0 have none and are left out."""
    error = F.try_divide(F.col(truth) - F.col(predicted), F.col(truth))
    return df.groupBy(*by).agg(F.sqrt(F.avg(error * error)).alias("rmspe"))


def accuracy(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(truth) == F.col(predicted)).cast("int")).alias("accuracy"))


def nine_metrics(
    flagged: DataFrame, group_key: str, by: Sequence[str] = (), seconds: float = 0.0, id_col: str = "id"
) -> DataFrame:
    """The metric columns of one evaluation, one row per `by` group.

    Low values are ranked first for false positives, high values for true positives.
    """
    by = list(by)
    flagged = settle(
        flagged.select(
            *by, id_col, "value", "is_eval", "y_c", "y_f", "flag_hi", "flag_lo", F.col(group_key).alias("_group")
        )
    )
    judged = flagged.where(F.col("is_eval") == 1)
    parts = [
        precision_at_flag(flagged, by),
        enrichment(flagged, by).select(*by, "enrichment_fp", "enrichment_tp"),
        bedroc(judged, "y_f", by=by, id_col=id_col, out="bedroc_fp"),
        bedroc(judged, "y_c", descending=True, by=by, id_col=id_col, out="bedroc_tp"),
        diversity_rate(flagged, "_group", by),
    ]
    wide = parts[0].withColumn("time", F.lit(float(seconds)))
    for part in parts[1:]:
        wide = attach_totals(wide, part, by)
    return wide.select(*by, "time", *NINE[1:])


NINE = [
    "time",
    "precision_fp",
    "precision_tp",
    "enrichment_fp",
    "enrichment_tp",
    "bedroc_fp",
    "bedroc_tp",
    "diversity_fp",
    "diversity_tp",
]


def long_metrics(wide: DataFrame, by: Sequence[str], metrics: Sequence[str] = NINE) -> DataFrame:
    """`(by..., metric, value)` rows from metric columns."""
    return wide.select(*by, *[F.col(m).cast("double") for m in metrics]).unpivot(
        list(by), list(metrics), "metric", "value"
    )
