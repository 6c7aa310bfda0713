"""Intermediate tables of iterative jobs, written to the shared folder and removed at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowworth.session import scratch_folder


class Keeper:
    """Cuts lineage by writing tables: each reread starts with a plan of one scan.

    checkpoint() also cuts the lineage, but its result keeps the constraints of the plan behind
    it, and those grow with every iteration.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._folder = scratch_folder(spark)
        self._count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self._folder}/{self._count}"
        self._count += 1
        df.write.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Remove what was kept; call it when no plan reads it any more."""
        jvm = self._spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._folder)
        path.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
