"""Projection and predicate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowworth.functions import columns as C
from rowworth.operators import clean, labels
from rowworth.operators.split import top_score_split
from rowworth.registry import bindings as B
from rowworth.registry import query
from rowworth.registry.sources import SPLIT_SQL

# labels are missing for most documents, so the outer join has real gaps
GAPS_SQL = """gaps AS (
  SELECT d.doc_id, l.quality, l.toxic, CASE WHEN l.quality = 1 THEN d.lang END AS lang
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def gaps(spark, folder):
    texts = B.table(spark, folder, "documents").select("doc_id", "lang")
    rows = texts.join(B.table(spark, folder, "labels"), "doc_id", "left")
    return rows.select("doc_id", "quality", "toxic", F.when(F.col("quality") == 1, F.col("lang")).alias("lang"))


@query("drop_null_key", f"WITH {GAPS_SQL} SELECT * FROM gaps WHERE lang IS NOT NULL")
def drop_null_key(spark, folder):
    return clean.drop_null_key(gaps(spark, folder), "lang")


@query(
    "valid_key",
    """SELECT page_id, url FROM pages
WHERE length(trim(url)) > 0 AND regexp_matches(url, '^https?://[a-z.]+/[a-z]+/[0-9]+')""",
)
def valid_key(spark, folder):
    pages = B.table(spark, folder, "pages").select("page_id", "url")
    return pages.where(C.valid_key(F.col("url"), "^https?://[a-z.]+/[a-z]+/[0-9]+"))


@query(
    "canonical_key",
    r"""SELECT doc_id, trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g')) AS key FROM documents""",
)
def canonical_key(spark, folder):
    texts = B.table(spark, folder, "documents")
    return texts.select("doc_id", C.canonical_key(F.col("text")).alias("key"))


@query(
    "binarize_outcome",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders""",
)
def binarize_outcome(spark, folder):
    orders = B.table(spark, folder, "orders")
    return orders.select("o_orderkey", C.binarize_outcome(F.col("o_orderstatus"), "F").alias("label"))


@query(
    "label_views",
    f"""WITH {B.DOCS_FLAGGED_SQL} SELECT id, prim AS "primary", confirmatory, is_eval, y_c, y_f FROM viewed""",
)
def label_views(spark, folder):
    viewed = labels.label_views(B.docs_screen(spark, folder))
    return viewed.select("id", "primary", "confirmatory", "is_eval", "y_c", "y_f")


@query(
    "label_views_val",
    f"""WITH {B.DOCS_SQL}
SELECT id, prim AS "primary", confirmatory, CASE WHEN confirmatory IS NOT NULL THEN 1 ELSE 0 END AS is_eval,
       confirmatory AS y_c, 1 - confirmatory AS y_f FROM screen""",
)
def label_views_val(spark, folder):
    viewed = labels.label_views(B.docs_screen(spark, folder), actives_only=False)
    return viewed.select("id", "primary", "confirmatory", "is_eval", "y_c", "y_f")


@query(
    "positives_only",
    f"""WITH {B.PARTS_SQL} SELECT id, score FROM screen WHERE confirmatory = 1""",
)
def positives_only(spark, folder):
    return labels.positives_only(B.parts_screen(spark, folder)).select("id", "score")


@query(
    "min_non_null",
    f"""WITH {GAPS_SQL} SELECT * FROM gaps
WHERE (doc_id IS NOT NULL)::INT + (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT + (lang IS NOT NULL)::INT >= 2""",
)
def min_non_null(spark, folder):
    return clean.min_non_null(gaps(spark, folder), 2)


@query(
    "complete_cases",
    f"""WITH {GAPS_SQL} SELECT * FROM gaps
WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL AND lang IS NOT NULL""",
)
def complete_cases(spark, folder):
    return clean.complete_cases(gaps(spark, folder))


@query(
    "sanitize_numeric",
    """WITH f AS (
  SELECT l_orderkey, l_linenumber, l_partkey,
    CASE WHEN l_discount = 0 THEN CASE WHEN l_tax = 0 THEN 0 ELSE CASE WHEN l_tax < 0.04 THEN -1e9 ELSE 1e9 END END
         ELSE (CASE WHEN l_tax < 0.04 THEN -l_tax ELSE l_tax END) / l_discount END AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(x, 6) AS x FROM f""",
)
def sanitize_numeric(spark, folder):
    lines = B.table(spark, folder, "lineitem")
    tax, discount = F.col("l_tax"), F.col("l_discount")
    signed = F.when(tax < 0.04, -tax).otherwise(tax)
    # division by zero as floating-point hardware does it
    raw = (
        F.when(discount != 0, signed / discount)
        .when(tax == 0, F.lit(float("nan")))
        .when(tax < 0.04, F.lit(float("-inf")))
        .otherwise(F.lit(float("inf")))
    )
    clean_array = C.sanitize_numeric(F.array(raw))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", F.round(clean_array[0], 6).alias("x"))


@query(
    "qc_assertions",
    f"""WITH {B.PARTS_SQL}, {SPLIT_SQL},
stages AS (
  SELECT 'full' AS stage, key, prim FROM screen UNION ALL SELECT 'val', key, prim FROM val
  UNION ALL SELECT 'train', key, prim FROM screen WHERE id NOT IN (SELECT id FROM val)
  UNION ALL SELECT 'raw', CAST(l_partkey AS VARCHAR), 1 FROM lineitem)
SELECT stage, count(*) AS n_rows, count(*) FILTER (WHERE prim IS NULL) AS missing_label,
  count(key) - count(DISTINCT key) AS repeated_key,
  CASE WHEN count(*) FILTER (WHERE prim IS NULL) = 0 AND count(key) = count(DISTINCT key) THEN 1 ELSE 0 END AS ok
FROM stages GROUP BY stage""",
)
def qc_assertions(spark, folder):
    screen = B.parts_screen(spark, folder)
    train, val = top_score_split(screen)
    raw = B.parts_raw(spark, folder).withColumn("primary", F.lit(1))
    return clean.qc_assertions({"full": screen, "val": val, "train": train, "raw": raw})
