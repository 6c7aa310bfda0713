"""Reading screens, prepared splits, features and multi-assay matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowworth.operators.split import top_score_split
from rowworth.session import broadcast_if_small
from rowworth.sources.writers import COMMIT

# Column names of the public raw assay exports.
RAW_COLUMNS = {
    "key": "PUBCHEM_EXT_DATASOURCE_SMILES",
    "outcome": "PUBCHEM_ACTIVITY_OUTCOME",
    "score": "PUBCHEM_ACTIVITY_SCORE",
}
_RAW_TYPES = {"key": "string", "outcome": "string", "score": "double"}


def read_table(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A table by its file ending.

    Columns of CSV files are strings under the names of the header, whatever their order; only the
    header is read ahead, and files of one folder whose headers differ are refused. Files are
    split among tasks unless records may hold line breaks (`multi_line`).
    """
    if path.rstrip("/").endswith(".csv"):
        reader = spark.read.option("header", True).option("escape", '"').option("enforceSchema", False)
        return reader.option("multiLine", multi_line).csv(path)
    return spark.read.parquet(path)


def read_assay(
    spark: SparkSession,
    path: str,
    mapping: dict[str, str | Column] = RAW_COLUMNS,
    multi_line: bool = False,
) -> DataFrame:
    """`(key, outcome, score, ...)` from a raw assay table; other columns are ignored.

    Columns are taken by name; a score that is no number becomes null.
    """
    raw = read_table(spark, path, multi_line)
    picked = []
    for name, source in mapping.items():
        column = F.col(source) if isinstance(source, str) else source
        picked.append(column.try_cast(_RAW_TYPES[name]).alias(name) if name in _RAW_TYPES else column.alias(name))
    return raw.select(*picked)


def registry_lookup(registry: DataFrame, codename: str | Sequence[str]) -> DataFrame:
    """Assay pair(s) `(codename, primary_aid, confirmatory_aid)` of one or several names."""
    names = [codename] if isinstance(codename, str) else list(codename)
    return registry.where(F.col("codename").isin(names))


def registry_add(registry: DataFrame, codename: str, primary_aid: str, confirmatory_aid: str) -> DataFrame:
    """The registry with one more pair; a codename already there keeps its old pair."""
    spark = registry.sparkSession
    new = spark.range(1).select(
        F.lit(codename).alias("codename"),
        F.lit(primary_aid).alias("primary_aid"),
        F.lit(confirmatory_aid).alias("confirmatory_aid"),
    )
    known = registry.select("codename").where(F.col("codename") == codename)
    return registry.unionByName(new.join(known, "codename", "left_anti"), allowMissingColumns=True)


def read_prepared(spark: SparkSession, path: str, dataset: str) -> tuple[DataFrame, DataFrame]:
    """(train, validation) written by `write_splits`, each with its `label` column.

    Both filters are on partition folders, so only that dataset's files are listed and read.
    """
    rows = spark.read.parquet(path).where(F.col("dataset") == dataset)
    train = rows.where(F.col("split") == "train").withColumn("label", F.col("primary"))
    val = rows.where(F.col("split") == "val").withColumn("label", F.col("confirmatory"))
    return train, val


def read_features(rows: DataFrame, features: DataFrame | None, id_col: str = "id") -> DataFrame:
    """Rows with their stored `features`, matched by id; without a table the key itself is passed on.

    Rows without stored features stay, with null features.
    """
    if features is None:
        return rows.withColumn("features", F.col("key"))
    return rows.join(features.select(id_col, "features"), id_col, "left")


def from_columns(
    df: DataFrame,
    id_col: str,
    key: str,
    primary: str,
    score: str | None = None,
    confirmatory: str | None = None,
    features: str | None = None,
) -> DataFrame:
    """Any table under the standard column names; what is not given becomes null."""

    def pick(source: str | None, name: str, kind: str) -> Column:
        column = F.col(source) if source else F.lit(None)
        return column.cast(kind).alias(name)

    columns = [
        F.col(id_col).alias("id"),
        F.col(key).cast("string").alias("key"),
        pick(primary, "primary", "int"),
        pick(score, "score", "double"),
        pick(confirmatory, "confirmatory", "int"),
    ]
    if features:
        columns.append(F.col(features).alias("features"))
    return df.select(*columns)


def read_multi_assay(wide: DataFrame, ids: Sequence[str], prefix: str = "activity_") -> DataFrame:
    """Matrix with one nullable column per assay to `(ids..., aid, activity)`, measured cells only."""
    assays = [c for c in wide.columns if c.startswith(prefix)]
    long = wide.select(*ids, *[F.col(c).cast("double").alias(c[len(prefix) :]) for c in assays])
    names = [c[len(prefix) :] for c in assays]
    return long.unpivot(list(ids), names, "aid", "activity").where(F.col("activity").isNotNull())


def group_assays(long: DataFrame, mapping: DataFrame, group: str) -> DataFrame:
    """Cells of the assays whose `group` flag is 1 in the mapping table."""
    # an assay may hold a large share of all cells, so they are not shuffled onto it
    wanted = broadcast_if_small(mapping.where(F.col(group) == 1).select("aid"))
    return long.join(wanted, "aid", "left_semi")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the last committed attempt of each run that `write_run` has written; attempts without a commit don't count."""
    commits = spark.read.schema(COMMIT).json(f"{path}/commits")
    last = commits.groupBy("run").agg(F.max_by("attempt", F.struct("at", "attempt")).alias("attempt"))
    # names like 007 stay as they are
    rows = spark.read.option("mergeSchema", "true").parquet(f"{path}/rows")
    rows = rows.withColumn("run", F.col("run").cast("string")).withColumn("attempt", F.col("attempt").cast("string"))
    return rows.join(broadcast_if_small(last), ["run", "attempt"], "left_semi").drop("attempt")


def from_columns_split(
    df: DataFrame, id_col: str, key: str, primary: str, val: DataFrame | None = None, share: float = 0.1, **columns
) -> tuple[DataFrame, DataFrame]:
    """(train, validation) of any table: with a validation set of the caller's own, whose keys leave the training rows,
    or split on the way in by the best scores (see `top_score_split`)."""
    rows = from_columns(df, id_col, key, primary, **columns)
    if val is None:
        return top_score_split(rows, share)
    own = from_columns(val, id_col, key, primary, **columns)
    return rows.join(own.select("key").where("key IS NOT NULL").distinct(), "key", "left_anti").select(*rows.columns), own
