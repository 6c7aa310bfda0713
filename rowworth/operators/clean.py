"""From raw repeated measurements to one merged, checked screen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowworth.functions.columns import binarize_outcome, canonical_key, valid_key


def drop_null_key(df: DataFrame, key: str = "key") -> DataFrame:
    return df.where(F.col(key).isNotNull())


def min_non_null(df: DataFrame, least: int = 2) -> DataFrame:
    """Rows with at least `least` filled columns."""
    return df.dropna(thresh=least)


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=list(columns) if columns else None)


def consensus_label(
    df: DataFrame,
    label: str = "label",
    key: str = "key",
    score: str | None = "score",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per key: label 1 iff more than half of its measurements are 1, score averaged.

    Of the `keep` columns (an id, say) the smallest value of the key stays.

    The averages combine map-side, so a key with very many repeats costs one row per task.
    """
    aggs = [F.avg(label).alias("_share")]
    if score:
        aggs.append(F.avg(score).alias(score))
    aggs += [F.min(c).alias(c) for c in keep]
    grouped = df.groupBy(key).agg(*aggs)
    return grouped.withColumn(label, (F.col("_share") > 0.5).cast("int")).drop("_share")


def clean_screen(
    raw: DataFrame,
    label: str,
    active: str = "Active",
    score: str | None = "score",
    keep: Sequence[str] = (),
    pattern: str | None = None,
    canonical=canonical_key,
) -> DataFrame:
    """`(key, outcome, score)` rows to one clean row per canonical key."""
    rows = drop_null_key(raw).where(valid_key(F.col("key"), pattern))
    rows = rows.withColumn("key", canonical(F.col("key")))
    rows = rows.withColumn(label, binarize_outcome(F.col("outcome"), active))
    return consensus_label(rows, label, score=score, keep=keep)


def merge_screens(primary: DataFrame, confirmatory: DataFrame, pattern: str | None = None) -> DataFrame:
    """Keep every primary row; the trusted label is null where it was never measured."""
    merged = primary.join(confirmatory.select("key", "confirmatory"), "key", "left")
    return merged.where(valid_key(F.col("key"), pattern))


def qc_assertions(stages: dict[str, DataFrame], key: str = "key", label: str = "primary") -> DataFrame:
    """Per stage: rows, rows without label, rows beyond the first of their key, and `ok`."""
    report = None
    for stage, df in stages.items():
        line = df.agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col(label).isNull()).alias("missing_label"),
            (F.count(key) - F.count_distinct(key)).alias("repeated_key"),
        ).select(F.lit(stage).alias("stage"), "*")
        report = line if report is None else report.unionByName(line)
    ok = (F.col("missing_label") == 0) & (F.col("repeated_key") == 0)
    return report.withColumn("ok", ok.cast("int"))


def cleanup_report(stages: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows and actives for each `{stage: (table, 0/1 label column)}`."""
    report = None
    for stage, (df, label) in stages.items():
        line = df.agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(label) == 1).alias("n_active")
        ).select(F.lit(stage).alias("stage"), "*")
        report = line if report is None else report.unionByName(line)
    return report


def clean_multi_assay(long: DataFrame, pattern: str | None = None) -> DataFrame:
    """`(key, aid, activity, split)` to one row per assay and key: mean activity, commonest split.

    Counting (key, split) first keeps the second step at one row per distinct pair; ties in the
    count go to the alphabetically first split.
    """
    rows = drop_null_key(long).where(valid_key(F.col("key"), pattern) & F.col("activity").isNotNull())
    pairs = rows.groupBy("aid", "key", "split").agg(
        F.sum("activity").alias("_sum"), F.count(F.lit(1)).alias("_n")
    )
    return pairs.groupBy("aid", "key").agg(
        (F.sum("_sum") / F.sum("_n")).alias("activity"),
        F.min_by("split", F.struct(-F.col("_n"), F.col("split"))).alias("split"),
    )
