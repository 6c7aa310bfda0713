"""Queries on order: splits, flags, samples, removal and removal curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowworth.operators import removal, split
from rowworth.operators.baseline import value_score
from rowworth.operators.flags import percentile_flags
from rowworth.operators.labels import label_views
from rowworth.registry import bindings as B
from rowworth.registry import query
from rowworth.registry.sources import SPLIT_SQL
from rowworth.session import settle


@query(
    "top_score_split",
    f"""WITH {B.PARTS_SQL}, {SPLIT_SQL} SELECT id, prim AS "primary", score, confirmatory FROM val""",
)
def top_score_split(spark, folder):
    _, val = split.top_score_split(B.parts_screen(spark, folder))
    return val.select("id", "primary", "score", "confirmatory")


@query(
    "percentile_flags",
    f"""WITH {B.DOCS_FLAGGED_SQL} SELECT id, value, flag_hi, flag_lo FROM flagged""",
)
def flags(spark, folder):
    return B.docs_flagged(spark, folder).select("id", "value", "flag_hi", "flag_lo")


@query(
    "percentile_flags_subset",
    """WITH limits AS (
  SELECT l_returnflag AS f, quantile_cont(l_extendedprice, 0.9) AS hi, quantile_cont(l_extendedprice, 0.1) AS lo
  FROM lineitem GROUP BY 1)
SELECT l_returnflag, sum(CASE WHEN l_extendedprice >= hi THEN 1 ELSE 0 END)::BIGINT AS n_hi,
  sum(CASE WHEN l_extendedprice <= lo THEN 1 ELSE 0 END)::BIGINT AS n_lo, round(max(hi), 6) AS least_hi_limit
FROM lineitem JOIN limits ON l_returnflag = f GROUP BY 1""",
)
def flags_subset(spark, folder):
    from rowworth.operators.ordering import exact_percentiles

    lines = B.table(spark, folder, "lineitem").select(
        "l_returnflag", F.col("l_extendedprice").alias("value"), F.lit(1).alias("primary")
    )
    flagged = percentile_flags(lines, by=["l_returnflag"], actives_only=False)
    limits = exact_percentiles(lines, "value", {"hi": 0.9}, ["l_returnflag"])
    return (
        flagged.groupBy("l_returnflag")
        .agg(F.sum("flag_hi").alias("n_hi"), F.sum("flag_lo").alias("n_lo"))
        .join(limits.select("l_returnflag", F.round("hi", 6).alias("least_hi_limit")), "l_returnflag")
    )


@query(
    "rank_batch",
    f"""WITH {B.PARTS_SQL}, r AS (SELECT id, score, row_number() OVER (ORDER BY score, id) AS rank, count(*) OVER () AS n
  FROM screen)
SELECT id, score, rank FROM r WHERE rank <= floor(n * 0.05)""",
)
def rank_batch(spark, folder):
    screen = B.parts_screen(spark, folder)
    return removal.rank_batch(screen, "score", 0.05).select("id", "score", "rank")


VALUED_SQL = """valued AS (
  SELECT id, prim, score AS value, row_number() OVER (PARTITION BY prim ORDER BY score, id) AS lo,
         row_number() OVER (PARTITION BY prim ORDER BY score DESC, id DESC) AS hi,
         row_number() OVER (PARTITION BY prim ORDER BY md5('3:' || CAST(id AS VARCHAR)), id) AS rnd FROM screen),
n AS (SELECT count(*) FILTER (WHERE prim = 1) AS p, count(*) FILTER (WHERE prim = 0) AS q FROM screen)"""


@query(
    "remove_k",
    f"""WITH {B.PARTS_SQL}, {VALUED_SQL}
SELECT 'low' AS mode, id, prim AS "primary" FROM valued, n WHERE prim = 1 OR lo > q - floor(p / 0.5)
UNION ALL SELECT 'high', id, prim FROM valued, n WHERE prim = 1 OR hi > q - floor(p / 0.5)
UNION ALL SELECT 'random', id, prim FROM valued, n WHERE prim = 1 OR rnd > q - floor(p / 0.5)""",
)
def remove_k(spark, folder):
    valued = settle(value_score(B.parts_screen(spark, folder)).select("id", "primary", "value"))
    parts = [
        removal.remove_k(valued, ratio=0.5, mode=mode, seed=3).select(F.lit(mode).alias("mode"), "id", "primary")
        for mode in ("low", "high", "random")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "removal_schedule",
    f"""WITH {B.PARTS_SQL}, {VALUED_SQL},
k AS (SELECT j, CAST(floor((p + q) * 0.05 * j + 1e-9) AS BIGINT) AS k FROM n, range(1, 20) s(j))
SELECT CAST(j AS INTEGER) AS level, side, k AS n_removed,
  count(*) FILTER (WHERE prim = 1 OR CASE WHEN side = 'low' THEN lo ELSE hi END > k) AS kept,
  round(avg(value) FILTER (WHERE prim = 0 AND CASE WHEN side = 'low' THEN lo ELSE hi END > k), 2) AS mean_kept
FROM k, valued, (VALUES ('low'), ('high')) s(side) GROUP BY j, k, side""",
)
def removal_schedule(spark, folder):
    valued = settle(value_score(B.parts_screen(spark, folder)).select("id", "primary", "value"))
    return removal.removal_schedule(valued).withColumn("mean_kept", F.round("mean_kept", 2))


@query(
    "corruption_curve",
    f"""WITH {B.DOCS_FLAGGED_SQL},
r AS (SELECT y_f, row_number() OVER (ORDER BY value, id) AS pos, count(*) OVER () AS n, sum(y_f) OVER () AS bad
      FROM viewed WHERE is_eval = 1)
SELECT CAST(b AS INTEGER) AS bin, round(count(*) FILTER (WHERE y_f = 1 AND pos <= floor(b * n / 20)) / max(bad), 6) AS found,
  round(least(b * 0.05 / (max(bad) / max(n)), 1), 6) AS optimal, round(b * 0.05, 6) AS random
FROM r, range(1, 21) s(b) GROUP BY b""",
)
def corruption_curve(spark, folder):
    judged = value_score(label_views(B.docs_screen(spark, folder))).where(F.col("is_eval") == 1)
    curve = removal.corruption_curve(judged.withColumn("noisy", F.col("y_f")))
    return curve.select("bin", *[F.round(c, 6).alias(c) for c in ("found", "optimal", "random")])


@query(
    "stratified_split",
    f"""WITH {B.DOCS_SQL},
r AS (SELECT id, row_number() OVER (PARTITION BY confirmatory ORDER BY md5('0:' || CAST(id AS VARCHAR)), id) AS pos,
        count(*) OVER (PARTITION BY confirmatory) AS n FROM screen WHERE confirmatory IS NOT NULL)
SELECT id, confirmatory, CASE WHEN id IN (SELECT id FROM r WHERE pos <= floor(n * 0.2)) THEN 'val' ELSE 'train' END AS split
FROM screen""",
)
def stratified_split(spark, folder):
    rows = B.docs_screen(spark, folder).select("id", "confirmatory")
    return split.stratified_split(rows, "confirmatory", 0.2)


@query(
    "random_split",
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('0:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS pos,
  count(*) OVER () AS n FROM orders) SELECT o_orderkey FROM r WHERE pos <= ceil(n * 0.01)""",
)
def random_split(spark, folder):
    orders = B.table(spark, folder, "orders").select("o_orderkey")
    return split.random_split(orders, 0.01, id_col="o_orderkey")


@query(
    "undersample_to_ratio",
    f"""WITH {B.PARTS_SQL},
n AS (SELECT count(*) FILTER (WHERE prim = 1) AS p, count(*) FILTER (WHERE prim = 0) AS q FROM screen),
r AS (SELECT id, prim, row_number() OVER (PARTITION BY prim ORDER BY md5('1:' || CAST(id AS VARCHAR)), id) AS pos FROM screen)
SELECT id, prim AS "primary" FROM r, n
WHERE prim = CASE WHEN p <= q THEN 1 ELSE 0 END OR pos <= floor(least(p, q) / CAST(0.2 AS DOUBLE))""",
)
def undersample_to_ratio(spark, folder):
    screen = B.parts_screen(spark, folder).select("id", "primary")
    return split.undersample_to_ratio(screen, "primary", 0.2, seed=1)


@query(
    "random_order",
    """SELECT o_orderkey, row_number() OVER (ORDER BY md5('5:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS position FROM orders""",
)
def random_order(spark, folder):
    orders = B.table(spark, folder, "orders").select("o_orderkey")
    return split.random_order(orders, seed=5, id_col="o_orderkey")
