"""Source and sink queries. Sinks write a table, and the query reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowworth.operators.split import top_score_split
from rowworth.registry import bindings as B
from rowworth.registry import query
from rowworth.registry.metrics import BALANCE_SQL, _rounded, balance_metrics, labelled_texts
from rowworth.session import scratch_folder
from rowworth.sources import readers as R
from rowworth.sources import writers as W


@query("read_assay", f"WITH {B.DOCS_RAW_SQL} SELECT id, key, outcome, score, source FROM docs_raw")
def read_assay(spark, folder):
    return B.docs_raw(spark, folder)


@query(
    "read_assay_csv",
    """SELECT CAST(p_partkey AS VARCHAR) AS key, p_type AS outcome, CAST(p_size AS DOUBLE) AS score FROM part""",
)
def read_assay_csv(spark, folder):
    path = scratch_folder(spark) + ".csv"
    raw = {
        "p_partkey": R.RAW_COLUMNS["key"],
        "p_type": R.RAW_COLUMNS["outcome"],
        "p_size": R.RAW_COLUMNS["score"],
    }
    # as in raw exports, other columns stand in front of and between those that are read
    part = B.table(spark, folder, "part").select(
        F.col("p_partkey").alias("PUBCHEM_CID"), *[F.col(a).alias(b) for a, b in reversed(raw.items())], F.col("p_brand").alias("OTHER")
    )
    part.write.option("header", True).csv(path)
    return R.read_assay(spark, path)


def brand_registry(spark, folder):
    """Brands as the registry of assay pairs."""
    return (
        B.table(spark, folder, "part")
        .groupBy(F.col("p_brand").alias("codename"))
        .agg(
            F.min("p_partkey").cast("string").alias("primary_aid"),
            F.max("p_partkey").cast("string").alias("confirmatory_aid"),
        )
    )


REGISTRY_SQL = """registry AS (
  SELECT p_brand AS codename, CAST(min(p_partkey) AS VARCHAR) AS primary_aid,
         CAST(max(p_partkey) AS VARCHAR) AS confirmatory_aid FROM part GROUP BY p_brand)"""


@query(
    "registry_lookup",
    f"WITH {REGISTRY_SQL} SELECT * FROM registry WHERE codename IN ('Brand#7', 'Brand#16')",
)
def registry_lookup(spark, folder):
    return R.registry_lookup(brand_registry(spark, folder), ["Brand#7", "Brand#16"])


@query(
    "registry_add",
    f"""WITH {REGISTRY_SQL}
SELECT * FROM registry UNION ALL SELECT 'Brand#new', '1', '2'
WHERE NOT EXISTS (SELECT 1 FROM registry WHERE codename = 'Brand#new')""",
)
def registry_add(spark, folder):
    grown = R.registry_add(brand_registry(spark, folder), "Brand#new", "1", "2")
    # a name that is there already keeps its pair
    return R.registry_add(grown, "Brand#7", "9", "9")


SPLIT_SQL = """judged AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, id) AS pos, count(*) OVER () AS n
  FROM screen WHERE confirmatory IS NOT NULL AND score IS NOT NULL AND prim IS NOT NULL),
val AS (SELECT * FROM judged WHERE pos <= floor(n * 0.1))"""


@query(
    "read_prepared",
    f"""WITH {B.PARTS_SQL}, {SPLIT_SQL}
SELECT 'val' AS split, id, confirmatory AS label, score FROM val
UNION ALL SELECT 'train', id, prim, score FROM screen WHERE id NOT IN (SELECT id FROM val)""",
)
def read_prepared(spark, folder):
    path = scratch_folder(spark)
    train, val = top_score_split(B.parts_screen(spark, folder))
    W.write_splits(train, val, path, "parts")
    stored_train, stored_val = R.read_prepared(spark, path, "parts")
    return stored_train.unionByName(stored_val).select("split", "id", "label", "score")


@query(
    "write_splits",
    f"""WITH {B.PARTS_SQL}, {SPLIT_SQL}, {B.DOCS_SQL.replace("screen AS", "docs AS")},
docs_judged AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, id) AS pos, count(*) OVER () AS n
  FROM docs WHERE confirmatory IS NOT NULL AND score IS NOT NULL),
both_sets AS (
  SELECT 'parts' AS dataset, CASE WHEN id IN (SELECT id FROM val) THEN 'val' ELSE 'train' END AS split, prim FROM screen
  UNION ALL
  SELECT 'docs', CASE WHEN id IN (SELECT id FROM docs_judged WHERE pos <= floor(n * 0.1)) THEN 'val' ELSE 'train' END, prim
  FROM docs)
SELECT dataset, split, count(*) AS n_rows, CAST(sum(prim) AS BIGINT) AS n_active FROM both_sets GROUP BY ALL""",
)
def write_splits(spark, folder):
    path = scratch_folder(spark)
    for name, screen in (("parts", B.parts_screen(spark, folder)), ("docs", B.docs_screen(spark, folder))):
        train, val = top_score_split(screen)
        W.write_splits(train.drop("source"), val.drop("source"), path, name)
    stored = spark.read.parquet(path)
    return stored.groupBy("dataset", "split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("primary").alias("n_active")
    )


@query(
    "read_features",
    """SELECT vec_id AS id, label AS "primary", len(embedding) AS width, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total
FROM embeddings""",
)
def read_features(spark, folder):
    path = scratch_folder(spark)
    rows = B.table(spark, folder, "embeddings")
    W.write_features(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("features")), path, "vectors")
    stored = spark.read.parquet(path).where(F.col("dataset") == "vectors")
    joined = R.read_features(rows.select(F.col("vec_id").alias("id"), F.col("label").alias("primary")), stored)
    total = F.aggregate("features", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return joined.select("id", "primary", F.size("features").alias("width"), F.round(total, 6).alias("total"))


@query(
    "write_features",
    """SELECT len(embedding) AS width, count(*) AS n_rows FROM embeddings GROUP BY 1""",
)
def write_features(spark, folder):
    path = scratch_folder(spark)
    W.write_features(B.vectors(spark, folder).select("id", "features"), path, "vectors")
    return spark.read.parquet(path).groupBy(F.size("features").alias("width")).agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "from_columns",
    """SELECT c_custkey AS id, c_name AS key, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS "primary",
  c_acctbal AS score, CAST(NULL AS INTEGER) AS confirmatory FROM customer""",
)
def from_columns(spark, folder):
    own = B.table(spark, folder, "customer").withColumn("good", F.col("c_acctbal") > 0)
    return R.from_columns(own, "c_custkey", "c_name", "good", score="c_acctbal")


@query(
    "read_multi_assay",
    """SELECT text AS key, lang AS split, 'quality' AS aid, CAST(quality AS DOUBLE) AS activity
FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL
UNION ALL SELECT text, lang, 'toxic', CAST(toxic AS DOUBLE)
FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic IS NOT NULL""",
)
def read_multi_assay(spark, folder):
    return R.read_multi_assay(labelled_texts(spark, folder), ["key", "split"])


@query("write_report", f"WITH {BALANCE_SQL} SELECT dataset, method, replicate, metric, round(value, 6) AS value FROM balance")
def write_report(spark, folder):
    path = scratch_folder(spark)
    W.write_report(balance_metrics(spark, folder), path)
    return _rounded(spark.read.parquet(path))


LOG_COLUMNS = ["dataset", "method", "replicate", "id", "y_f", "y_c", "flag_lo", "flag_hi", "value"]


@query(
    "write_log",
    f"""WITH {B.DOCS_FLAGGED_SQL}
SELECT 'docs' AS dataset, 'score' AS method, 0 AS replicate, id, y_f, y_c, flag_lo, flag_hi, value
FROM flagged WHERE is_eval = 1""",
)
def write_log(spark, folder):
    path = scratch_folder(spark)
    W.write_log(W.prediction_log(B.docs_flagged(spark, folder), "docs", "score", 0), path)
    return spark.read.parquet(path).select(*LOG_COLUMNS)


@query(
    "write_curve",
    """SELECT o_orderpriority AS method, CAST(month(o_orderdate) AS INTEGER) AS step, count(*) AS found
FROM orders GROUP BY 1, 2""",
)
def write_curve(spark, folder):
    path = scratch_folder(spark)
    curve = B.table(spark, folder, "orders").groupBy(
        F.col("o_orderpriority").alias("method"), F.month("o_orderdate").alias("step")
    )
    W.write_curve(curve.agg(F.count(F.lit(1)).alias("found")), path)
    return spark.read.parquet(path)
