"""Value scores that need no model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowworth.operators.rules import rule_alerts


def value_score(df: DataFrame) -> DataFrame:
    """The measured score is the value."""
    return df.withColumn("value", F.col("score").cast("double"))


def value_rules(
    df: DataFrame, patterns: Sequence[tuple[str, str]], text: str = "key", ranges: dict | None = None
) -> DataFrame:
    """Minus the number of alerts: many alerts suggest a false positive."""
    counted = rule_alerts(df, patterns, text, ranges)
    return counted.withColumn("value", -F.col("alerts").cast("double")).drop("alerts", "alert")


def scatter_scores(rows: DataFrame, scores: DataFrame, id_col: str = "id") -> DataFrame:
    """Scores of a subset on all rows: 0 and `scored` = 0 where there is none."""
    part = scores.select(id_col, F.col("value"), F.lit(1).alias("scored"))
    joined = rows.join(part, id_col, "left")
    return joined.withColumn("value", F.coalesce("value", F.lit(0.0))).withColumn(
        "scored", F.coalesce("scored", F.lit(0))
    )
