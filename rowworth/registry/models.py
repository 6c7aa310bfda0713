"""Fitted-model queries. Their results depend on an optimiser, so they have no SQL counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowworth.operators import boosting as T
from rowworth.operators import models as M
from rowworth.operators import surrogate as S
from rowworth.operators.metrics import accuracy, auroc
from rowworth.operators.ordering import attach_totals
from rowworth.operators.reinforce import value_reinforce
from rowworth.operators.split import exclude_split, random_split
from rowworth.plans.methods import compare_values
from rowworth.registry import bindings as B
from rowworth.registry import SQL, query
from rowworth.registry.valuation import EPOCHS, RATE
from rowworth.session import settle


def settled_split(spark, folder):
    train, val = B.vector_split(spark, folder)
    return settle(train), settle(val)


@query("fit_classifier")
def fit_classifier(spark, folder):
    train, val = settled_split(spark, folder)
    scored = settle(M.predict(M.fit_classifier(train, balanced=True), val))
    return attach_totals(auroc(scored, "y", "probability"), accuracy(scored, "y", "predicted"))


@query("predict")
def predict(spark, folder):
    train, val = settled_split(spark, folder)
    scored = M.predict(M.fit_classifier(train), val)
    return scored.select("id", "y", "probability", "predicted")


@query("fit_weighted")
def fit_weighted(spark, folder):
    train, val = settled_split(spark, folder)
    valued = value_reinforce(train, val)
    model = M.fit_classifier(valued, weight="value")
    return M.predict(model, val).select("id", "y", "probability", "predicted")


@query("margin_gap")
def margin_gap(spark, folder):
    train, val = settled_split(spark, folder)
    return M.margin_gap(train, val).select("id", "y", "gap")


@query("value_reinforce")
def reinforce(spark, folder):
    train, val = settled_split(spark, folder)
    return value_reinforce(train, val).select("id", "value")


BOOSTER = {"rounds": 3, "depth": 2, "bins": 8}


def booster_sql(rounds=BOOSTER["rounds"], depth=BOOSTER["depth"], bins=BOOSTER["bins"], rate=0.1, penalty=1.0):
    """Histogram trees on all features of `train`, unrolled; `trees` has each row of train and val in each tree."""
    cuts = " + ".join(f"CASE WHEN x > low + (high - low) * {k} / {bins} THEN 1 ELSE 0 END" for k in range(1, bins))
    cells = "SELECT id, CAST(unnest(features) AS DOUBLE) AS x, generate_subscripts(features, 1) AS j FROM"
    out = f"""
limits AS (SELECT j, min(x) AS low, max(x) AS high FROM ({cells} train) GROUP BY j),
binned AS MATERIALIZED (SELECT id, j, {cuts} AS b FROM ({cells} train UNION ALL {cells} val) JOIN limits USING (j)),
m0 AS MATERIALIZED (SELECT id, y, fits, ln(share / (1 - share)) AS f
  FROM (SELECT id, y, true AS fits FROM train UNION ALL SELECT id, y, false FROM val), (SELECT avg(y) AS share FROM train))"""
    for t in range(rounds):
        out += f""",
g{t} AS MATERIALIZED (SELECT id, y, fits, f, p - y AS g, p * (1 - p) AS h FROM (SELECT *, 1 / (1 + exp(-f)) AS p FROM m{t})),
n{t}_0 AS (SELECT id, 0 AS node FROM m{t})"""
        for level in range(depth):
            at = f"{t}_{level}"
            out += f""",
h{at} AS (SELECT node, j, b, sum(g) AS g, sum(h) AS h FROM n{at} JOIN g{t} USING (id) JOIN binned USING (id) WHERE fits GROUP BY ALL),
c{at} AS (SELECT node, j, b, sum(g) OVER upto AS gl, sum(h) OVER upto AS hl, sum(g) OVER whole AS gt, sum(h) OVER whole AS ht
  FROM h{at} WINDOW upto AS (PARTITION BY node, j ORDER BY b), whole AS (PARTITION BY node, j)),
s{at} AS (SELECT node, j, b FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, j, b) AS k
  FROM (SELECT node, j, b, round(gl * gl / (hl + {penalty}) + (gt - gl) * (gt - gl) / (ht - hl + {penalty}) - gt * gt / (ht + {penalty}), 9) AS gain
        FROM c{at} WHERE b < {bins - 1})) WHERE k = 1 AND gain > 0),
n{t}_{level + 1} AS MATERIALIZED (SELECT n.id, 2 * n.node + CASE WHEN x.b > s.b THEN 1 ELSE 0 END AS node
  FROM n{at} n LEFT JOIN s{at} s ON n.node = s.node LEFT JOIN binned x ON x.id = n.id AND x.j = s.j)"""
        out += f""",
l{t} AS (SELECT node, sum(h) AS hs, -{rate} * sum(g) / (sum(h) + {penalty}) AS w FROM n{t}_{depth} JOIN g{t} USING (id) WHERE fits GROUP BY node),
t{t} AS MATERIALIZED (SELECT {t} AS t, id, y, fits, f, g, h, node, coalesce(w, 0) AS w, coalesce(hs, 0) AS hs, (SELECT sum(abs(w)) FROM l{t}) AS l1
  FROM g{t} JOIN n{t}_{depth} USING (id) LEFT JOIN l{t} USING (node)),
m{t + 1} AS MATERIALIZED (SELECT id, y, fits, f + w AS f FROM t{t})"""
    stacked = " UNION ALL ".join(f"SELECT * FROM t{t}" for t in range(rounds))
    return out + f",\ntrees AS ({stacked})"


@query(
    "value_mvs_ensemble",
    f"""WITH {B.VECTORS_SQL}, {booster_sql()}
SELECT id, y, round(-sum(least(1, sqrt(g * g + l1 * h * h))), 6) AS value FROM trees WHERE fits GROUP BY id, y""",
)
def mvs_ensemble(spark, folder):
    train, _ = settled_split(spark, folder)
    model = T.fit_boosters(train, **BOOSTER)[0]
    return T.value_mvs(train, model).select("id", "y", F.round("value", 6).alias("value"))


@query(
    "value_leaf_influence_ensemble",
    f"""WITH {B.VECTORS_SQL}, {booster_sql()},
ends AS (SELECT id, 1 / (1 + exp(-f)) - y AS pull FROM m{BOOSTER["rounds"]} WHERE NOT fits),
leaf AS (SELECT t, node, sum(pull) AS pull FROM trees JOIN ends USING (id) GROUP BY t, node)
SELECT id, y, round(-sum(coalesce(pull, 0) * -0.1 * (g + w / 0.1 * h) / (hs + 1.0)), 6) AS value
FROM trees LEFT JOIN leaf USING (t, node) WHERE fits GROUP BY id, y""",
)
def leaf_ensemble(spark, folder):
    train, val = settled_split(spark, folder)
    model = T.fit_boosters(train, **BOOSTER)[0]
    return T.value_leaf_influence(train, model, val).select("id", "y", F.round("value", 6).alias("value"))


# name of a method and the query that holds its SQL
_NAMED = {
    "mvs": "value_mvs_ensemble",
    "leaf_test": "value_leaf_influence_ensemble",
    "tracin_self": "value_tracin_self",
    "tracin_test": "value_tracin_test",
    "tracin_pos": "value_tracin_pos",
    "shapley": "value_knn_shapley",
}


@query("values_by_name", "\nUNION ALL\n".join(f"SELECT '{name}' AS method, id, value FROM ({SQL[q]})" for name, q in _NAMED.items()))
def values_by_name(spark, folder):
    train, val = settled_split(spark, folder)
    steps = {"epochs": EPOCHS, "rate": RATE}
    options = {name: BOOSTER if name in ("mvs", "leaf_test") else {"k": 5} if name == "shapley" else steps for name in _NAMED}
    return compare_values(train, val, list(_NAMED), options=options).withColumn("value", F.round("value", 6))


def pool_and_rest(spark, folder):
    """A third of the vectors with a value that depends smoothly on the features."""
    rows = B.vectors(spark, folder)
    value = sum((F.col("features")[j].cast("double") for j in range(4)), F.lit(0.0))
    rows = rows.withColumn("value", value)
    pool = settle(random_split(rows, 0.33, seed=3))
    return pool, exclude_split(rows, pool).drop("value")


def _surrogate_query(name):
    @query(f"surrogate_{name}")
    def run(spark, folder):
        pool, rest = pool_and_rest(spark, folder)
        return S.SURROGATES[{"kernel_gp": "gp", "kernel_ridge": "ridge"}.get(name, name)](pool, rest).select(
            "id", "mean", "variance"
        )


for _name in ("gbt", "kernel_gp", "kernel_ridge"):
    _surrogate_query(_name)
