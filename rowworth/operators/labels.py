"""Label columns of a merged screen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_views(df: DataFrame, actives_only: bool = True) -> DataFrame:
    """Add `is_eval`, `y_c`, `y_f`: which rows can be judged, and their true / false positive label.

    A row can be judged when the trusted label exists and, unless `actives_only` is off, the
    noisy label is positive.
    """
    judged = F.col("confirmatory").isNotNull()
    if actives_only:
        judged = judged & (F.col("primary") == 1)
    judged = F.coalesce(judged, F.lit(False))
    trusted = F.col("confirmatory").cast("int")
    return df.select(
        "*",
        judged.cast("int").alias("is_eval"),
        F.when(judged, trusted).alias("y_c"),
        F.when(judged, 1 - trusted).alias("y_f"),
    )


def positives_only(df: DataFrame, label: str = "confirmatory") -> DataFrame:
    return df.where(F.col(label) == 1)
