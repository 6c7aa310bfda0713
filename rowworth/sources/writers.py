"""Writing splits, features, metrics, logs and curves, and the views over them."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _replace(rows: DataFrame, path: str, *by: str) -> None:
    """Write partitions, in place of those that are there under the same names."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_splits(train: DataFrame, val: DataFrame, path: str, dataset: str) -> None:
    """A second write of a dataset replaces the first."""
    both = train.withColumn("split", F.lit("train")).unionByName(val.withColumn("split", F.lit("val")))
    _replace(both.withColumn("dataset", F.lit(dataset)), path, "dataset", "split")


def write_features(features: DataFrame, path: str, dataset: str) -> None:
    """A second write of a dataset replaces the first."""
    _replace(features.withColumn("dataset", F.lit(dataset)), path, "dataset")


def write_run(rows: DataFrame, path: str, run: str) -> None:
    """Add the rows of a named run so that it can be repeated: each attempt has files of its own, and only a
    commit that is written after them makes it count. `read_runs` gives the last committed attempt of each run."""
    attempt = uuid.uuid4().hex
    marked = rows.withColumn("run", F.lit(run)).withColumn("attempt", F.lit(attempt))
    marked.write.mode("append").partitionBy("run", "attempt").parquet(f"{path}/rows")
    done = rows.sparkSession.createDataFrame([(run, attempt, time.time_ns())], COMMIT)
    done.coalesce(1).write.mode("append").json(f"{path}/commits")


COMMIT = "run string, attempt string, at long"


def _append(rows: DataFrame, path: str, mode: str, run: str | None, *by: str) -> None:
    if run is not None:
        write_run(rows, path, run)
    else:
        rows.write.mode(mode).partitionBy(*by).parquet(path)


def write_report(metrics: DataFrame, path: str, mode: str = "append", run: str | None = None) -> None:
    """Long `(dataset, method, replicate, metric, value)` rows; with `run` a second write replaces the first (see `write_run`)."""
    _append(metrics, path, mode, run, "method")


def write_log(log: DataFrame, path: str, mode: str = "append", run: str | None = None) -> None:
    """Prediction logs; with `run` a second write replaces the first (see `write_run`)."""
    _append(log, path, mode, run, "dataset", "method")


def write_curve(curve: DataFrame, path: str, mode: str = "append", run: str | None = None) -> None:
    """Curves; with `run` a second write replaces the first (see `write_run`)."""
    _append(curve, path, mode, run, "method")


def prediction_log(flagged: DataFrame, dataset: str, method: str, replicate: int) -> DataFrame:
    """Judged rows with their labels, flags and value."""
    return flagged.where(F.col("is_eval") == 1).select(
        F.lit(dataset).alias("dataset"),
        F.lit(method).alias("method"),
        F.lit(replicate).alias("replicate"),
        "id",
        "y_f",
        "y_c",
        "flag_lo",
        "flag_hi",
        "value",
    )


def align_logs(log: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Methods side by side per `(dataset, replicate, id)`: three columns for each method."""
    cells = []
    for m in methods:
        for name, source in (("fp", "flag_lo"), ("tp", "flag_hi"), ("score", "value")):
            cells.append(F.max(F.when(F.col("method") == m, F.col(source))).alias(f"{name}_{m}"))
    return log.groupBy("dataset", "replicate", "id").agg(
        F.max("y_f").alias("y_f"), F.max("y_c").alias("y_c"), *cells
    )


def stack_replicates(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def repeat_baseline(rows: DataFrame, replicates: int) -> DataFrame:
    """A replicate-free result once per replicate."""
    numbers = F.sequence(F.lit(0), F.lit(replicates - 1))
    return rows.withColumn("replicate", F.explode(numbers))


def summary_join(metrics: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Per dataset and metric, the replicate mean of each method in its own column."""
    return metrics.groupBy("dataset", "metric").agg(
        *[F.avg(F.when(F.col("method") == m, F.col("value"))).alias(m) for m in methods]
    )
