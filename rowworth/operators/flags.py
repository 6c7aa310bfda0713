"""Suspected false and true positives from the tails of the value scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowworth.operators.ordering import attach_totals, exact_percentiles


def percentile_flags(
    df: DataFrame,
    value: str = "value",
    label: str = "primary",
    percentile: float = 90.0,
    by: Sequence[str] = (),
    actives_only: bool = True,
) -> DataFrame:
    """Add `flag_hi` (value at or above the percentile) and `flag_lo` (at or below its mirror).

    Both thresholds come from the active rows and only active rows are flagged; with
    `actives_only=False` every row counts. Low value means suspected false positive.
    """
    pool = df.where(F.col(label) == 1) if actives_only else df
    probs = {"_p_hi": percentile / 100.0, "_p_lo": (100.0 - percentile) / 100.0}
    limits = exact_percentiles(pool, value, probs, by)
    eligible = (F.col(label) == 1) if actives_only else F.lit(True)
    rows = attach_totals(df, limits, by)
    hi = F.coalesce(eligible & (F.col(value) >= F.col("_p_hi")), F.lit(False))
    lo = F.coalesce(eligible & (F.col(value) <= F.col("_p_lo")), F.lit(False))
    return rows.select(*df.columns, hi.cast("int").alias("flag_hi"), lo.cast("int").alias("flag_lo"))
