"""The given tables seen as screens, feature tables and labelled sets, in DataFrame and SQL form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowworth.functions.columns import canonical_key
from rowworth.operators.clean import clean_screen, merge_screens
from rowworth.operators.flags import percentile_flags
from rowworth.operators.baseline import value_score
from rowworth.operators.labels import label_views
from rowworth.operators.split import exclude_split, random_split
from rowworth.session import settle
from rowworth.sources.readers import read_assay


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """For work that is heavy per row: a table of a few files is read by as few tasks, so its rows
    are dealt out to all cores. With at least as many files as cores nothing is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def docs_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as a noisy screen: long texts count as active."""
    return read_assay(
        spark,
        f"{folder}/documents.parquet",
        {
            "id": "doc_id",
            "key": "text",
            "outcome": F.when(F.col("n_chars") >= 500, "Active").otherwise("Inactive"),
            "score": "n_chars",
            "source": "source",
        },
    )


def docs_trusted_raw(spark: SparkSession, folder: str) -> DataFrame:
    """The few documents with a quality label as the confirmatory screen."""
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), "quality")
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("key"))
    outcome = F.when(F.col("quality") == 1, "Active").otherwise("Inactive")
    return texts.join(labels, "id").select("id", "key", outcome.alias("outcome"))


def text_digest(key: Column) -> Column:
    """Whole texts are long keys, so their digests are grouped, shuffled and joined instead."""
    return F.sha2(canonical_key(key), 256)


def docs_screen(spark: SparkSession, folder: str) -> DataFrame:
    primary = clean_screen(docs_raw(spark, folder), "primary", keep=["id", "source"], canonical=text_digest)
    trusted = clean_screen(docs_trusted_raw(spark, folder), "confirmatory", score=None, canonical=text_digest)
    return merge_screens(primary, trusted)


def docs_flagged(spark: SparkSession, folder: str) -> DataFrame:
    # thresholds and flags both read the screen, which is far smaller than the texts behind it
    return percentile_flags(settle(value_score(label_views(docs_screen(spark, folder)))))


def parts_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as repeated measurements of a part: returned lines count as active."""
    return read_assay(
        spark,
        f"{folder}/lineitem.parquet",
        {
            "id": "l_partkey",
            "key": F.col("l_partkey").cast("string"),
            "outcome": F.when(F.col("l_returnflag") == "R", "Active").otherwise("Inactive"),
            # whole cents, so that averages do not depend on the order of summing
            "score": F.round(F.col("l_extendedprice") * 100),
        },
    )


def parts_trusted_raw(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").where(F.col("l_linenumber") == 1)
    return lines.select(
        F.col("l_partkey").cast("string").alias("key"),
        F.when(F.col("l_linestatus") == "F", "Active").otherwise("Inactive").alias("outcome"),
    )


def parts_screen(spark: SparkSession, folder: str) -> DataFrame:
    primary = clean_screen(parts_raw(spark, folder), "primary", keep=["id"])
    trusted = clean_screen(parts_trusted_raw(spark, folder), "confirmatory", score=None)
    return merge_screens(primary, trusted)


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as feature rows; the label is the upper half of the classes."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"),
        (F.col("label") >= 5).cast("int").alias("y"),
        F.col("embedding").alias("features"),
    )


def vector_split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = vectors(spark, folder)
    val = random_split(rows, 0.2, seed=7)
    return exclude_split(rows, val), val


LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as a table of four numeric features; the label is a return."""
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", *LINE_FEATURES,
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )


_CANON = r"sha256(trim(regexp_replace(lower(key), '[ \t\r\n]+', ' ', 'g')))"

DOCS_RAW_SQL = """
docs_raw AS (
  SELECT doc_id AS id, text AS key, CASE WHEN n_chars >= 500 THEN 'Active' ELSE 'Inactive' END AS outcome,
         CAST(n_chars AS DOUBLE) AS score, source
  FROM documents),
docs_trusted_raw AS (
  SELECT d.doc_id AS id, d.text AS key, CASE WHEN l.quality = 1 THEN 'Active' ELSE 'Inactive' END AS outcome
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

DOCS_SQL = (
    DOCS_RAW_SQL
    + f""",
docs_primary AS (
  SELECT key, CASE WHEN avg(CASE WHEN outcome = 'Active' THEN 1 ELSE 0 END) > 0.5 THEN 1 ELSE 0 END AS prim,
         avg(score) AS score, min(id) AS id, min(source) AS source
  FROM (SELECT {_CANON} AS key, outcome, score, id, source FROM docs_raw
        WHERE key IS NOT NULL AND length(trim(key)) > 0) GROUP BY key),
docs_trusted AS (
  SELECT key, CASE WHEN avg(CASE WHEN outcome = 'Active' THEN 1 ELSE 0 END) > 0.5 THEN 1 ELSE 0 END AS confirmatory
  FROM (SELECT {_CANON} AS key, outcome FROM docs_trusted_raw
        WHERE key IS NOT NULL AND length(trim(key)) > 0) GROUP BY key),
screen AS (
  SELECT p.id, p.key, p.prim, p.score, p.source, t.confirmatory
  FROM docs_primary p LEFT JOIN docs_trusted t ON p.key = t.key WHERE length(trim(p.key)) > 0)"""
)

# continues a WITH list that defines `screen`: judged rows, thresholds among actives, flags
FLAGGED_SQL = """,
viewed AS (
  SELECT *, CASE WHEN confirmatory IS NOT NULL AND prim = 1 THEN 1 ELSE 0 END AS is_eval,
         CASE WHEN confirmatory IS NOT NULL AND prim = 1 THEN confirmatory END AS y_c,
         CASE WHEN confirmatory IS NOT NULL AND prim = 1 THEN 1 - confirmatory END AS y_f,
         score AS value FROM screen),
limits AS (
  SELECT quantile_cont(value, 0.9) AS p_hi, quantile_cont(value, 0.1) AS p_lo FROM viewed WHERE prim = 1),
flagged AS (
  SELECT v.*, CASE WHEN prim = 1 AND value >= p_hi THEN 1 ELSE 0 END AS flag_hi,
         CASE WHEN prim = 1 AND value <= p_lo THEN 1 ELSE 0 END AS flag_lo FROM viewed v, limits)"""

DOCS_FLAGGED_SQL = DOCS_SQL + FLAGGED_SQL

PARTS_SQL = """
parts_primary AS (
  SELECT CAST(l_partkey AS VARCHAR) AS key,
         CASE WHEN avg(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) > 0.5 THEN 1 ELSE 0 END AS prim,
         avg(round(l_extendedprice * 100)) AS score, min(l_partkey) AS id
  FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY l_partkey),
parts_trusted AS (
  SELECT CAST(l_partkey AS VARCHAR) AS key,
         CASE WHEN avg(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) > 0.5 THEN 1 ELSE 0 END AS confirmatory
  FROM lineitem WHERE l_linenumber = 1 GROUP BY l_partkey),
screen AS (
  SELECT p.id, p.key, p.prim, p.score, t.confirmatory
  FROM parts_primary p LEFT JOIN parts_trusted t ON p.key = t.key)"""

PARTS_FLAGGED_SQL = PARTS_SQL + FLAGGED_SQL

VECTORS_SQL = """
vectors AS (
  SELECT vec_id AS id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y, embedding AS features FROM embeddings),
drawn AS (
  SELECT *, row_number() OVER (ORDER BY md5('7:' || CAST(id AS VARCHAR)), id) AS pos, count(*) OVER () AS n
  FROM vectors),
val AS (SELECT id, y, features FROM drawn WHERE pos <= ceil(n * 0.2)),
train AS (SELECT id, y, features FROM drawn WHERE pos > ceil(n * 0.2))"""
