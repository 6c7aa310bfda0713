"""Consensus, aggregation and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowworth.functions.columns import class_weight
from rowworth.operators import metrics as M
from rowworth.operators import stats as S
from rowworth.operators.clean import clean_multi_assay, clean_screen, cleanup_report
from rowworth.operators.ordering import attach_totals
from rowworth.operators.split import top_score_split
from rowworth.registry import query
from rowworth.registry import bindings as B
from rowworth.session import settle
from rowworth.sources.readers import read_multi_assay


@query(
    "consensus_label",
    f"""WITH {B.PARTS_SQL}
SELECT key, prim AS "primary", score, id FROM parts_primary""",
)
def consensus_label(spark, folder):
    return clean_screen(B.parts_raw(spark, folder), "primary", keep=["id"])


@query(
    "cleanup_report",
    f"""WITH {B.DOCS_SQL},
judged AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS pos, count(*) OVER () AS n
           FROM screen WHERE confirmatory IS NOT NULL AND score IS NOT NULL),
val AS (SELECT * FROM judged WHERE pos <= floor(n * 0.1))
SELECT 'raw' AS stage, count(*) AS n_rows, count(*) FILTER (WHERE outcome = 'Active') AS n_active FROM docs_raw
UNION ALL SELECT 'clean', count(*), count(*) FILTER (WHERE prim = 1) FROM screen
UNION ALL SELECT 'train', count(*), count(*) FILTER (WHERE prim = 1) FROM screen
  WHERE id NOT IN (SELECT id FROM val)
UNION ALL SELECT 'val', count(*), count(*) FILTER (WHERE confirmatory = 1) FROM val""",
)
def report(spark, folder):
    raw = B.docs_raw(spark, folder).withColumn("active", (F.col("outcome") == "Active").cast("int"))
    screen = B.docs_screen(spark, folder)
    train, val = top_score_split(screen)
    return cleanup_report(
        {
            "raw": (raw, "active"),
            "clean": (screen, "primary"),
            "train": (train, "primary"),
            "val": (val, "confirmatory"),
        }
    )


def labelled_texts(spark, folder):
    """Quality and toxicity labels of the texts as a two-assay matrix; the language is its split."""
    texts = B.table(spark, folder, "documents").select("doc_id", F.col("text").alias("key"), F.col("lang").alias("split"))
    labels = B.table(spark, folder, "labels")
    return texts.join(labels, "doc_id").select(
        "key", "split", F.col("quality").alias("activity_quality"), F.col("toxic").alias("activity_toxic")
    )


@query(
    "clean_multi_assay",
    """WITH cells AS (
  SELECT d.text AS key, d.lang AS split, a.aid, a.activity FROM documents d
  JOIN (SELECT doc_id, 'quality' AS aid, quality AS activity FROM labels
        UNION ALL SELECT doc_id, 'toxic', toxic FROM labels) a ON d.doc_id = a.doc_id
  WHERE d.text IS NOT NULL AND length(trim(d.text)) > 0 AND a.activity IS NOT NULL),
pairs AS (SELECT aid, key, split, sum(activity) AS s, count(*) AS n FROM cells GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY aid, key ORDER BY n DESC, split) AS r FROM pairs),
means AS (SELECT aid, key, sum(s) / sum(n) AS activity FROM pairs GROUP BY aid, key)
SELECT m.aid, b.split, count(*) AS n_keys, CAST(round(avg(m.activity), 6) AS DOUBLE) AS mean_activity
FROM means m JOIN best b ON m.aid = b.aid AND m.key = b.key AND b.r = 1 GROUP BY m.aid, b.split""",
)
def multi_assay(spark, folder):
    long = read_multi_assay(labelled_texts(spark, folder), ["key", "split"])
    per_key = clean_multi_assay(long)
    return per_key.groupBy("aid", "split").agg(
        F.count(F.lit(1)).alias("n_keys"), F.round(F.avg("activity"), 6).alias("mean_activity")
    )


@query(
    "base_rates",
    f"""WITH {B.DOCS_FLAGGED_SQL}
SELECT round(avg(y_f), 6) AS fp_rate, round(1 - avg(y_f), 6) AS tp_rate FROM flagged WHERE is_eval = 1""",
)
def base_rates(spark, folder):
    return _rounded(M.base_rates(B.docs_flagged(spark, folder)))


@query(
    "class_weights",
    f"""WITH {B.PARTS_SQL},
n AS (SELECT count(*) FILTER (WHERE prim = 1) AS p, count(*) FILTER (WHERE prim = 0) AS q FROM screen)
SELECT id, prim AS "primary",
  round(CASE WHEN p = 0 OR q = 0 THEN 1 WHEN prim = 1 THEN sqrt((p + q) / p) ELSE sqrt((p + q) / q) END, 6) AS weight
FROM screen, n""",
)
def class_weights(spark, folder):
    screen = B.parts_screen(spark, folder)
    rows = attach_totals(screen, M.class_totals(screen, "primary"))
    weight = class_weight(F.col("primary"), F.col("n_pos"), F.col("n_neg"))
    return rows.select("id", "primary", F.round(weight, 6).alias("weight"))


@query(
    "precision_at_flag",
    f"""WITH {B.DOCS_FLAGGED_SQL},
c AS (SELECT count(*) FILTER (WHERE is_eval = 1 AND flag_lo = 1) AS lo,
  count(*) FILTER (WHERE is_eval = 1 AND flag_lo = 1 AND y_f = 1) AS lo_hit,
  count(*) FILTER (WHERE is_eval = 1 AND flag_hi = 1) AS hi,
  count(*) FILTER (WHERE is_eval = 1 AND flag_hi = 1 AND y_c = 1) AS hi_hit FROM flagged)
SELECT round(coalesce(lo_hit / nullif(lo, 0), 0), 6) AS precision_fp,
       round(coalesce(hi_hit / nullif(hi, 0), 0), 6) AS precision_tp FROM c""",
)
def precision_at_flag(spark, folder):
    return _rounded(M.precision_at_flag(B.docs_flagged(spark, folder)))


@query(
    "enrichment",
    f"""WITH {B.DOCS_FLAGGED_SQL},
c AS (SELECT count(*) FILTER (WHERE flag_lo = 1) AS lo, count(*) FILTER (WHERE flag_lo = 1 AND y_f = 1) AS lo_hit,
  count(*) FILTER (WHERE flag_hi = 1) AS hi, count(*) FILTER (WHERE flag_hi = 1 AND y_c = 1) AS hi_hit,
  avg(y_f) AS rf, avg(y_c) AS rc FROM flagged WHERE is_eval = 1)
SELECT round(coalesce(lo_hit / nullif(lo, 0), 0) * rf, 6) AS enrichment_fp,
       round(coalesce(hi_hit / nullif(hi, 0), 0) * rc, 6) AS enrichment_tp,
       round(coalesce(lo_hit / nullif(lo, 0), 0) / rf, 6) AS enrichment_ratio_fp,
       round(coalesce(hi_hit / nullif(hi, 0), 0) / rc, 6) AS enrichment_ratio_tp FROM c""",
)
def enrichment(spark, folder):
    return _rounded(M.enrichment(B.docs_flagged(spark, folder)))


def bedroc_sql(source, truth, order, out="bedroc"):
    """`out` over the rows of `source`, ranked by `order`; one SELECT."""
    return f"""
SELECT (rie - worst) / (best - worst) AS {out} FROM (
  SELECT w / (ra * (1 - exp(-20.0)) / (exp(20.0 / n) - 1)) AS rie,
         (1 - exp(-20.0 * ra)) / (ra * (1 - exp(-20.0))) AS best,
         (1 - exp(20.0 * ra)) / (ra * (1 - exp(20.0))) AS worst
  FROM (SELECT max(n) AS n, avg({truth}) AS ra, sum(CASE WHEN {truth} = 1 THEN exp(-20.0 * r / n) END) AS w
        FROM (SELECT {truth}, count(*) OVER () AS n, row_number() OVER (ORDER BY {order}) AS r FROM {source})))"""


@query(
    "bedroc",
    f"""WITH {B.DOCS_FLAGGED_SQL}, judged AS (SELECT * FROM flagged WHERE is_eval = 1),
a AS ({bedroc_sql("judged", "y_f", "value, id", "fp")}), b AS ({bedroc_sql("judged", "y_c", "value DESC, id", "tp")})
SELECT round(fp, 6) AS bedroc_fp, round(tp, 6) AS bedroc_tp FROM a, b""",
)
def bedroc(spark, folder):
    judged = settle(B.docs_flagged(spark, folder).where(F.col("is_eval") == 1).select("id", "value", "y_f", "y_c"))
    fp = M.bedroc(judged, "y_f", out="bedroc_fp")
    tp = M.bedroc(judged, "y_c", descending=True, out="bedroc_tp")
    return _rounded(attach_totals(fp, tp))


@query(
    "diversity_rate",
    f"""WITH {B.DOCS_FLAGGED_SQL}
SELECT round(coalesce(100.0 * count(DISTINCT source) FILTER (WHERE flag_lo = 1)
         / nullif(count(*) FILTER (WHERE flag_lo = 1), 0), 0), 6) AS diversity_fp,
       round(coalesce(100.0 * count(DISTINCT source) FILTER (WHERE flag_hi = 1)
         / nullif(count(*) FILTER (WHERE flag_hi = 1), 0), 0), 6) AS diversity_tp FROM flagged""",
)
def diversity_rate(spark, folder):
    return _rounded(M.diversity_rate(B.docs_flagged(spark, folder), "source"))


@query(
    "average_precision",
    """WITH c AS (SELECT l_returnflag = 'R' AS y, l_extendedprice AS s FROM lineitem),
g AS (SELECT s, count(*) AS n, count(*) FILTER (WHERE y) AS p FROM c GROUP BY s),
w AS (SELECT p, sum(n) OVER (ORDER BY s DESC) AS cn, sum(p) OVER (ORDER BY s DESC) AS cp FROM g)
SELECT round(CAST(sum(p * cp / cn) / sum(p) AS DOUBLE), 6) AS average_precision FROM w""",
)
def average_precision(spark, folder):
    return _rounded(M.average_precision(B.lines(spark, folder), "y", "l_extendedprice"))


@query(
    "auroc",
    """WITH c AS (SELECT l_linestatus, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_quantity AS s FROM lineitem),
g AS (SELECT l_linestatus, s, sum(y) AS p, sum(1 - y) AS q FROM c GROUP BY l_linestatus, s),
w AS (SELECT *, sum(q) OVER (PARTITION BY l_linestatus ORDER BY s) AS cq FROM g)
SELECT l_linestatus, round(CAST(sum(p * (cq - q / 2)) / (sum(p) * sum(q)) AS DOUBLE), 6) AS auroc
FROM w GROUP BY l_linestatus""",
)
def auroc(spark, folder):
    rows = B.table(spark, folder, "lineitem").select(
        "l_linestatus", "l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("y")
    )
    return _rounded(M.auroc(rows, "y", "l_quantity", by=["l_linestatus"]))


@query(
    "rmspe",
    """WITH m AS (SELECT l_quantity, avg(l_extendedprice) AS hat FROM lineitem GROUP BY l_quantity)
SELECT l.l_returnflag, round(sqrt(avg(((l_extendedprice - hat) / l_extendedprice) * ((l_extendedprice - hat) / l_extendedprice))), 6) AS rmspe
FROM lineitem l JOIN m ON l.l_quantity = m.l_quantity GROUP BY l.l_returnflag""",
)
def rmspe(spark, folder):
    rows = B.table(spark, folder, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    hat = rows.groupBy("l_quantity").agg(F.avg("l_extendedprice").alias("hat"))
    return _rounded(M.rmspe(attach_totals(rows, hat, ["l_quantity"]), "l_extendedprice", "hat", by=["l_returnflag"]))


@query(
    "accuracy",
    f"""WITH {B.PARTS_SQL}
SELECT round(avg(CASE WHEN prim = confirmatory THEN 1 ELSE 0 END), 6) AS accuracy
FROM screen WHERE confirmatory IS NOT NULL""",
)
def accuracy(spark, folder):
    judged = B.parts_screen(spark, folder).where(F.col("confirmatory").isNotNull())
    return _rounded(M.accuracy(judged, "confirmatory", "primary"))


NINE_SQL = f"""judged AS (SELECT * FROM flagged WHERE is_eval = 1),
c AS (SELECT count(*) FILTER (WHERE flag_lo = 1) AS lo, count(*) FILTER (WHERE flag_lo = 1 AND y_f = 1) AS lo_hit,
  count(*) FILTER (WHERE flag_hi = 1) AS hi, count(*) FILTER (WHERE flag_hi = 1 AND y_c = 1) AS hi_hit,
  avg(y_f) AS rf, avg(y_c) AS rc FROM judged),
d AS (SELECT coalesce(100.0 * count(DISTINCT source) FILTER (WHERE flag_lo = 1)
         / nullif(count(*) FILTER (WHERE flag_lo = 1), 0), 0) AS diversity_fp,
       coalesce(100.0 * count(DISTINCT source) FILTER (WHERE flag_hi = 1)
         / nullif(count(*) FILTER (WHERE flag_hi = 1), 0), 0) AS diversity_tp FROM flagged),
bf AS ({bedroc_sql("judged", "y_f", "value, id", "bedroc_fp")}),
bt AS ({bedroc_sql("judged", "y_c", "value DESC, id", "bedroc_tp")}),
nine AS (SELECT CAST(0 AS DOUBLE) AS time, coalesce(lo_hit / nullif(lo, 0), 0) AS precision_fp,
  coalesce(hi_hit / nullif(hi, 0), 0) AS precision_tp,
  coalesce(lo_hit / nullif(lo, 0), 0) * rf AS enrichment_fp, coalesce(hi_hit / nullif(hi, 0), 0) * rc AS enrichment_tp,
  bedroc_fp, bedroc_tp, diversity_fp, diversity_tp FROM c, d, bf, bt)"""


@query(
    "nine_metrics",
    f"""WITH {B.DOCS_FLAGGED_SQL}, {NINE_SQL}
SELECT metric, round(value, 6) AS value FROM (UNPIVOT nine ON COLUMNS(*) INTO NAME metric VALUE value)""",
)
def nine_metrics(spark, folder):
    wide = M.nine_metrics(B.docs_flagged(spark, folder), "source")
    return M.long_metrics(wide, []).select("metric", F.round("value", 6).alias("value"))


def balance_metrics(spark, folder):
    """Account balances as replicated results: nation is the dataset, segment the method."""
    customers = B.table(spark, folder, "customer")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("0:"), F.col("c_custkey").cast("string"))), 1, 4), 16, 10)
    return customers.select(
        F.col("c_nationkey").alias("dataset"),
        F.col("c_mktsegment").alias("method"),
        (draw.cast("int") % 5).alias("replicate"),
        F.col("c_acctbal").alias("value"),
    ).groupBy("dataset", "method", "replicate").agg(F.avg("value").alias("value")).withColumn(
        "metric", F.lit("precision_fp")
    )


BALANCE_SQL = """balance AS (
  SELECT c_nationkey AS dataset, c_mktsegment AS method,
         CAST(('0x' || substr(md5('0:' || CAST(c_custkey AS VARCHAR)), 1, 4)) AS INTEGER) % 5 AS replicate,
         avg(c_acctbal) AS value, 'precision_fp' AS metric
  FROM customer GROUP BY 1, 2, 3)"""


@query(
    "replicate_stats",
    f"""WITH {BALANCE_SQL}
SELECT dataset, method, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
  round(max(value) FILTER (WHERE replicate = 0), 6) AS rep_0, round(max(value) FILTER (WHERE replicate = 1), 6) AS rep_1,
  round(max(value) FILTER (WHERE replicate = 2), 6) AS rep_2, round(max(value) FILTER (WHERE replicate = 3), 6) AS rep_3,
  round(max(value) FILTER (WHERE replicate = 4), 6) AS rep_4
FROM balance GROUP BY dataset, method, metric""",
)
def replicate_stats(spark, folder):
    return _rounded(S.replicate_table(balance_metrics(spark, folder), range(5)))


@query(
    "dataset_mean",
    f"""WITH {BALANCE_SQL},
rates AS (SELECT s_nationkey AS dataset, avg(s_acctbal) AS fp_rate FROM supplier GROUP BY 1),
rel AS (SELECT method, metric, replicate, avg(value - coalesce(fp_rate, 0)) AS value
        FROM balance b LEFT JOIN rates r ON b.dataset = r.dataset GROUP BY 1, 2, 3)
SELECT method, metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM rel GROUP BY 1, 2""",
)
def dataset_mean(spark, folder):
    rates = (
        B.table(spark, folder, "supplier")
        .groupBy(F.col("s_nationkey").alias("dataset"))
        .agg(F.avg("s_acctbal").alias("fp_rate"))
        .withColumn("tp_rate", F.lit(0.0))
    )
    return _rounded(S.dataset_mean(balance_metrics(spark, folder), rates))


@query(
    "curve_stats",
    """WITH per AS (
  SELECT o_orderpriority AS method, CAST(month(o_orderdate) AS INTEGER) AS step, year(o_orderdate) AS replicate,
         count(*) AS found FROM orders GROUP BY 1, 2, 3)
SELECT method, step, round(avg(found), 6) AS mean, round(stddev_pop(found), 6) AS std FROM per GROUP BY 1, 2
UNION ALL SELECT DISTINCT method, 0, 0.0, 0.0 FROM per""",
)
def curve_stats(spark, folder):
    curve = (
        B.table(spark, folder, "orders")
        .groupBy(
            F.col("o_orderpriority").alias("method"),
            F.month("o_orderdate").alias("step"),
            F.year("o_orderdate").alias("replicate"),
        )
        .agg(F.count(F.lit(1)).alias("found"))
    )
    return _rounded(S.curve_stats(curve))


@query(
    "wilcoxon_signed_rank",
    f"""WITH {BALANCE_SQL},
ref AS (SELECT s_nationkey AS dataset, avg(s_acctbal) AS r FROM supplier GROUP BY 1),
d AS (SELECT b.dataset, method, replicate, value - r AS diff FROM balance b JOIN ref ON b.dataset = ref.dataset),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset, method ORDER BY abs(diff)) AS rk,
           count(*) OVER (PARTITION BY dataset, method) AS n FROM d WHERE diff <> 0),
obs AS (SELECT dataset, method, max(n) AS n, sum(CASE WHEN diff > 0 THEN rk ELSE 0 END) AS w FROM ranked GROUP BY 1, 2),
signs AS (SELECT r.dataset, r.method, s.m, sum(CASE WHEN (s.m >> CAST(r.rk - 1 AS INTEGER)) & 1 = 1 THEN r.rk ELSE 0 END) AS w0
          FROM ranked r, range(32) s(m) WHERE s.m < (1 << CAST(r.n AS INTEGER)) GROUP BY 1, 2, 3)
SELECT o.dataset, o.method, CAST(o.n AS BIGINT) AS n, CAST(o.w AS DOUBLE) AS w_plus,
  round(count(*) FILTER (WHERE w0 >= o.w) / pow(2, o.n), 6) AS p, round(pow(0.5, o.n), 6) AS p_floor
FROM obs o JOIN signs s ON o.dataset = s.dataset AND o.method = s.method GROUP BY o.dataset, o.method, o.n, o.w""",
)
def wilcoxon(spark, folder):
    reference = (
        B.table(spark, folder, "supplier")
        .groupBy(F.col("s_nationkey").alias("dataset"))
        .agg(F.avg("s_acctbal").alias("reference"))
    )
    diffs = attach_totals(balance_metrics(spark, folder), reference, ["dataset"])
    diffs = diffs.where(F.col("reference").isNotNull())
    diffs = diffs.select("dataset", "method", (F.col("value") - F.col("reference")).alias("diff"))
    return _rounded(S.wilcoxon_signed_rank(diffs, by=["dataset", "method"]))


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
