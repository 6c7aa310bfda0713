"""Which positives are false? Value the rows, flag both tails, measure against the trusted label."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowworth.operators.flags import percentile_flags
from rowworth.operators.labels import label_views
from rowworth.operators.metrics import long_metrics, nine_metrics
from rowworth.session import settle

# (screen rows, seed) -> the same rows with `value`; low means suspected false positive
Valuer = Callable[[DataFrame, int], DataFrame]


def false_positives(
    screen: DataFrame,
    valuer: Valuer,
    dataset: str,
    method: str,
    replicates: int = 1,
    group_key: str = "key",
    timed: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(metrics, log). Replicates are a column: flags and metrics of all of them are one pass."""
    stacked, seconds = None, {}
    for r in range(replicates):
        start = time.monotonic()
        # features and texts are of no use any more
        valued = valuer(screen, r).select(*dict.fromkeys(["id", "primary", "confirmatory", "value", group_key]))
        valued = settle(valued.withColumn("replicate", F.lit(r)))
        seconds[r] = time.monotonic() - start if timed else 0.0
        stacked = valued if stacked is None else stacked.unionByName(valued)
    viewed = label_views(stacked).select(
        F.lit(dataset).alias("dataset"),
        F.lit(method).alias("method"),
        "replicate",
        "id",
        "primary",
        "value",
        "is_eval",
        "y_c",
        "y_f",
        F.col(group_key).alias("group_key"),
    )
    by = ["dataset", "method", "replicate"]
    flagged = settle(percentile_flags(viewed, by=by))
    took = F.create_map(*[F.lit(x) for r, s in seconds.items() for x in (r, float(s))])
    wide = nine_metrics(flagged, "group_key", by).withColumn("time", took[F.col("replicate")])
    log = flagged.where(F.col("is_eval") == 1).select(
        *by, "id", "y_f", "y_c", "flag_lo", "flag_hi", "value"
    )
    return long_metrics(wide, by), log
