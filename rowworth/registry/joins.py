"""Join and set-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowworth.functions import columns as C
from rowworth.operators import split
from rowworth.operators.bit_pairs import fingerprint_classes, similar_pairs
from rowworth.operators.pairs import pair_similarity
from rowworth.registry import bindings as B
from rowworth.registry import query
from rowworth.registry.features import WORDS_SQL
from rowworth.registry.metrics import BALANCE_SQL, _rounded, balance_metrics, labelled_texts
from rowworth.registry.sources import SPLIT_SQL
from rowworth.session import settle
from rowworth.sources import readers as R
from rowworth.sources import writers as W


@query(
    "merge_screens",
    f"""WITH {B.PARTS_SQL} SELECT id, key, prim AS "primary", score, confirmatory FROM screen""",
)
def merge_screens(spark, folder):
    return B.parts_screen(spark, folder).select("id", "key", "primary", "score", "confirmatory")


@query(
    "exclude_split",
    f"""WITH {B.PARTS_SQL}, {SPLIT_SQL}
SELECT id, prim AS "primary", score FROM screen WHERE id NOT IN (SELECT id FROM val)""",
)
def exclude_split(spark, folder):
    train, _ = split.top_score_split(B.parts_screen(spark, folder))
    return train.select("id", "primary", "score")


def assay_groups(spark, folder):
    """Which assay belongs to which group: an assay is `rare` if under a fifth of its cells are positive."""
    long = R.read_multi_assay(labelled_texts(spark, folder), ["key", "split"])
    return long, long.groupBy("aid").agg((F.avg("activity") < 0.2).cast("int").alias("rare"))


@query(
    "group_assays",
    """WITH cells AS (
  SELECT d.text AS key, 'quality' AS aid, CAST(l.quality AS DOUBLE) AS activity
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL
  UNION ALL SELECT d.text, 'toxic', CAST(l.toxic AS DOUBLE)
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS NOT NULL)
SELECT aid, key, activity FROM cells
WHERE aid IN (SELECT aid FROM cells GROUP BY aid HAVING avg(activity) < 0.2)""",
)
def group_assays(spark, folder):
    long, groups = assay_groups(spark, folder)
    return R.group_assays(long, groups, "rare").select("aid", "key", "activity")


def two_methods_log(spark, folder):
    """Logs of two methods over the parts screen: the score, and the score of the part's last line."""
    lines = B.table(spark, folder, "lineitem")
    logs = []
    for method, column in (("price", "l_extendedprice"), ("quantity", "l_quantity")):
        judged = lines.groupBy(F.col("l_partkey").alias("id")).agg(
            F.max(column).alias("value"),
            F.max((F.col("l_linestatus") == "F").cast("int")).alias("y_c"),
        )
        logs.append(
            judged.select(
                F.lit("parts").alias("dataset"),
                F.lit(method).alias("method"),
                F.lit(0).alias("replicate"),
                "id",
                (1 - F.col("y_c")).alias("y_f"),
                "y_c",
                (F.col("value") < 20).cast("int").alias("flag_lo"),
                (F.col("value") >= 49).cast("int").alias("flag_hi"),
                "value",
            )
        )
    return W.stack_replicates(logs)


@query(
    "align_logs",
    """SELECT 'parts' AS dataset, 0 AS replicate, l_partkey AS id,
  1 - max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS y_f, max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS y_c,
  CASE WHEN max(l_extendedprice) < 20 THEN 1 ELSE 0 END AS fp_price, CASE WHEN max(l_extendedprice) >= 49 THEN 1 ELSE 0 END AS tp_price,
  max(l_extendedprice) AS score_price,
  CASE WHEN max(l_quantity) < 20 THEN 1 ELSE 0 END AS fp_quantity, CASE WHEN max(l_quantity) >= 49 THEN 1 ELSE 0 END AS tp_quantity,
  max(l_quantity) AS score_quantity
FROM lineitem GROUP BY l_partkey""",
)
def align_logs(spark, folder):
    return W.align_logs(two_methods_log(spark, folder), ["price", "quantity"])


METHODS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_AVERAGES = ", ".join(f"round(avg(value) FILTER (WHERE method = '{m}'), 6) AS \"{m}\"" for m in METHODS)


@query(
    "summary_join",
    f"""WITH {BALANCE_SQL}
SELECT dataset, metric, {_AVERAGES}
FROM balance GROUP BY dataset, metric""",
)
def summary_join(spark, folder):
    return _rounded(W.summary_join(balance_metrics(spark, folder), METHODS))


@query(
    "pair_similarity",
    f"""WITH {B.VECTORS_SQL},
flat AS (SELECT id, CAST(unnest(features) AS DOUBLE) AS x, generate_subscripts(features, 1) AS pos FROM vectors),
norm AS (SELECT id, sum(x * x) AS q FROM flat GROUP BY id),
dots AS (SELECT a.id, b.id AS ref_id, sum(a.x * b.x) AS d FROM flat a JOIN flat b USING (pos)
         WHERE a.id IN (SELECT id FROM train) AND b.id IN (SELECT id FROM val) GROUP BY 1, 2)
SELECT d.id, count(*) AS n_refs, round(avg(d / (a.q + b.q - d)), 6) AS mean_similarity,
       round(max(d / (a.q + b.q - d)), 6) AS nearest
FROM dots d JOIN norm a ON a.id = d.id JOIN norm b ON b.id = d.ref_id GROUP BY d.id""",
)
def similarity(spark, folder):
    train, val = B.vector_split(spark, folder)
    pairs = pair_similarity(train, val)
    return _rounded(
        pairs.groupBy("id").agg(
            F.count(F.lit(1)).alias("n_refs"),
            F.avg("similarity").alias("mean_similarity"),
            F.max("similarity").alias("nearest"),
        )
    )


@query(
    "pair_similarity_threshold",
    f"""WITH bits AS (SELECT DISTINCT id, CAST(('0x' || substr(md5(g), 1, 8)) AS BIGINT) % 1024 AS bit
  FROM (SELECT doc_id AS id, unnest({WORDS_SQL}) AS g FROM documents)),
size AS (SELECT id, count(*) AS n, md5(string_agg(bit::VARCHAR, ',' ORDER BY bit)) AS digest FROM bits GROUP BY id),
shared AS (SELECT a.id, b.id AS ref, count(*) AS s FROM bits a JOIN bits b ON a.bit = b.bit AND a.id <> b.id GROUP BY 1, 2),
near AS (SELECT x.id, count(*) AS n_links, max(CASE WHEN a.digest <> b.digest THEN x.s / (a.n + b.n - x.s) END) AS nearest
  FROM shared x JOIN size a ON a.id = x.id JOIN size b ON b.id = x.ref WHERE x.s / (a.n + b.n - x.s) >= 0.8 GROUP BY x.id)
SELECT d.doc_id AS id, min(d.doc_id) OVER (PARTITION BY digest) AS class_id,
  coalesce(n_links, 0) AS n_links, round(nearest, 6) AS nearest
FROM documents d JOIN size ON size.id = d.doc_id LEFT JOIN near ON near.id = d.doc_id
UNION ALL SELECT doc_id, doc_id, 0, NULL FROM documents WHERE doc_id NOT IN (SELECT id FROM size)""",
)
def similarity_threshold(spark, folder):
    """Per document: its class of equal fingerprints, how many others are similar, and the nearest other fingerprint."""
    texts = B.spread(B.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text"))
    listed = C.tokenize(F.col("text"), "([^ \\n]+)")
    classes = settle(fingerprint_classes(texts.select("id", C.hashed_fingerprint(listed, radius=0).alias("bits"))))
    sizes = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    alone = classes.where(F.col("id") == F.col("class_id")).select("id", "bits")
    pairs = similar_pairs(alone, threshold=0.8)
    # each pair from both ends, in one pass over the pairs
    ends = F.array(*[F.struct(F.col(a).alias("id"), F.col(b).alias("ref_id")) for a, b in (("id", "ref_id"), ("ref_id", "id"))])
    both = pairs.select("similarity", F.inline(ends))
    links = both.join(sizes.withColumnRenamed("class_id", "ref_id"), "ref_id").groupBy(F.col("id").alias("class_id")).agg(
        F.sum("n").alias("others"), F.max("similarity").alias("nearest")
    )
    counted = sizes.join(links, "class_id", "left")
    n_links = F.coalesce("others", F.lit(0)) + F.col("n") - 1
    counted = counted.select("class_id", n_links.alias("n_links"), F.round("nearest", 6).alias("nearest"))
    return classes.select("id", "class_id").join(counted, "class_id").select("id", "class_id", "n_links", "nearest")


@query(
    "stack_replicates",
    """SELECT method, count(*) AS n_rows, CAST(sum(flag_hi) AS BIGINT) AS n_hi FROM (
  SELECT 'price' AS method, CASE WHEN max(l_extendedprice) >= 49 THEN 1 ELSE 0 END AS flag_hi FROM lineitem GROUP BY l_partkey
  UNION ALL SELECT 'quantity', CASE WHEN max(l_quantity) >= 49 THEN 1 ELSE 0 END FROM lineitem GROUP BY l_partkey)
GROUP BY method""",
)
def stack_replicates(spark, folder):
    log = two_methods_log(spark, folder)
    return log.groupBy("method").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("flag_hi").alias("n_hi"))


@query(
    "repeat_baseline",
    """SELECT o_orderpriority AS method, r AS replicate, count(*) AS n FROM orders, range(5) x(r) GROUP BY 1, 2""",
)
def repeat_baseline(spark, folder):
    counts = B.table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("method")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return W.repeat_baseline(counts, 5)
