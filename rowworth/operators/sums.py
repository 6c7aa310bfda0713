"""Sums of numpy arrays over a table: the size of a model, whatever the size of the table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# tasks' sums meet in so many groups first, so that no task adds up those of all others;
# with no more cores than that, one step does
_GROUPS = 32


def add_up(df: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], Iterable[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    """`partial` gives (slot, array) for the batches of a task; the arrays of each slot are added up.

    The driver gets one flat float array for each slot. A table without rows in any task may give none.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        for slot, array in partial(batches):
            yield _row(slot, part, np.asarray(array, dtype=np.float64).ravel())

    def merged(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, raw in zip(batch.column(0).to_pylist(), batch.column(2)):
                array = np.frombuffer(raw.as_buffer(), dtype=np.float64)
                held[slot] = held[slot] + array if slot in held else array.copy()
        for slot, array in held.items():
            yield _row(slot, 0, array)

    schema = "slot int, part int, sums binary"
    sums = df.mapInArrow(run, schema)
    if df.sparkSession.sparkContext.defaultParallelism > _GROUPS:
        sums = sums.repartition("slot", F.pmod("part", F.lit(_GROUPS))).mapInArrow(merged, schema)
    sums = sums.repartition("slot").mapInArrow(merged, schema)
    return {row["slot"]: np.frombuffer(row["sums"], dtype=np.float64) for row in sums.collect()}


def _row(slot: int, part: int, array: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array([slot], pa.int32()), pa.array([part], pa.int32()), pa.array([array.tobytes()], pa.binary())],
        names=["slot", "part", "sums"],
    )
