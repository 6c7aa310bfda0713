"""Value-score queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowworth.operators import logistic as L
from rowworth.operators import stumps as T
from rowworth.operators.baseline import scatter_scores, value_rules, value_score
from rowworth.operators.knn_shapley import value_knn_shapley
from rowworth.operators.labels import positives_only
from rowworth.operators.split import exclude_split, random_split, undersample_to_ratio
from rowworth.registry import bindings as B
from rowworth.registry import query
from rowworth.session import settle


@query(
    "value_score",
    f"""WITH {B.PARTS_SQL} SELECT id, score AS value FROM screen""",
)
def score(spark, folder):
    return value_score(B.parts_screen(spark, folder)).select("id", "value")


# a small catalogue of text alerts: links, mail addresses, digit runs, shouting, repeated marks
ALERTS = [
    ("link", "https?://"),
    ("mail", "[a-z0-9_.]+@[a-z0-9.]+"),
    ("digits", "[0-9]{6,}"),
    ("shouting", "[A-Z]{6,}"),
    ("marks", "[!?*#]{2,}"),
    ("license", "(?i)license|copyright"),
]
ALERT_SUM_SQL = " + ".join(
    f"CASE WHEN regexp_matches(key, '{pattern}') THEN 1 ELSE 0 END" for _, pattern in ALERTS
)


@query(
    "value_rules",
    f"WITH {B.DOCS_RAW_SQL} SELECT id, CAST(-({ALERT_SUM_SQL}) AS DOUBLE) AS value FROM docs_raw",
)
def rules(spark, folder):
    return value_rules(B.docs_raw(spark, folder), ALERTS).select("id", "value")


def knn_sql(train, val, k, keep=None):
    """Shapley values by the published recursion over all pairs of `train` and `val`."""
    cut = f"WHERE r < {keep}" if keep else ""
    return f"""pairs AS (
  SELECT v.id AS v, t.id, CASE WHEN t.y = v.y THEN 1 ELSE 0 END AS m,
         round(list_sum(list_transform(list_zip(t.features, v.features),
           lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2]))), 9) AS d
  FROM {train} t, {val} v),
ranked AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY d, id) AS r, count(*) OVER (PARTITION BY v) AS n FROM pairs),
terms AS (SELECT v, id, r, CASE WHEN r = n THEN m * least({k}, n) / ({k} * n)
            ELSE (m - lead(m) OVER (PARTITION BY v ORDER BY r)) / {k} * least({k}, r) / r END AS term FROM ranked),
shares AS (SELECT v, id, sum(term) OVER (PARTITION BY v ORDER BY r DESC) AS s FROM terms {cut})"""


@query(
    "value_knn_shapley",
    f"""WITH {B.VECTORS_SQL}, {knn_sql("train", "val", 5)}
SELECT id, round(sum(s) / (SELECT count(*) FROM val), 6) AS value FROM shares GROUP BY id""",
)
def knn(spark, folder):
    train, val = B.vector_split(spark, folder)
    return value_knn_shapley(train, val, k=5).select("id", F.round("value", 6).alias("value"))


@query(
    "shapley_suffix",
    f"""WITH {B.VECTORS_SQL}, {knn_sql("train", "val", 3, 50)}
SELECT t.id, round(coalesce(sum(s), 0) / (SELECT count(*) FROM val), 6) AS value
FROM train t LEFT JOIN shares s ON t.id = s.id GROUP BY t.id""",
)
def knn_nearest(spark, folder):
    train, val = B.vector_split(spark, folder)
    valued = value_knn_shapley(train, val, k=3, epsilon=0.02)
    return valued.select("id", F.round("value", 6).alias("value"))


@query(
    "scatter_scores",
    f"""WITH {B.VECTORS_SQL.replace("label >= 5", "label < 1")},
n AS (SELECT count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS q FROM train),
mixed AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('0:' || CAST(id AS VARCHAR)), id) AS place FROM train),
kept AS (SELECT id, y, features FROM mixed, n
         WHERE y = CASE WHEN p <= q THEN 1 ELSE 0 END OR place <= floor(least(p, q) / CAST(0.2 AS DOUBLE))),
{knn_sql("kept", "val", 5)},
v AS (SELECT id, sum(s) / (SELECT count(*) FROM val) AS value FROM shares GROUP BY id)
SELECT t.id, round(coalesce(value, 0), 6) AS value, CASE WHEN v.id IS NULL THEN 0 ELSE 1 END AS scored
FROM train t LEFT JOIN v ON t.id = v.id""",
)
def knn_undersampled(spark, folder):
    rows = B.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), (F.col("label") < 1).cast("int").alias("y"), F.col("embedding").alias("features")
    )
    val = random_split(rows, 0.2, seed=7)
    train = settle(exclude_split(rows, val))
    kept = undersample_to_ratio(train, "y", 0.2)
    scattered = scatter_scores(train, value_knn_shapley(kept, val, k=5))
    return scattered.select("id", F.round("value", 6).alias("value"), "scored")


EPOCHS, RATE = 3, 1.0


def gradient_steps_sql(rows="train"):
    """Weights after each epoch as w1..wE (pos, w), the intercept at the last position."""
    out = f"""
flat AS (SELECT id, y, CAST(unnest(features) AS DOUBLE) AS x, generate_subscripts(features, 1) AS pos FROM {rows}
         UNION ALL SELECT id, y, 1.0, 0 FROM {rows}),
size AS (SELECT count(*) AS n FROM {rows}),
w0 AS (SELECT DISTINCT pos, CAST(0 AS DOUBLE) AS w FROM flat)"""
    for e in range(1, EPOCHS + 1):
        out += f""",
p{e} AS (SELECT id, any_value(y) AS y, 1 / (1 + exp(-sum(x * w))) AS p FROM flat JOIN w{e - 1} USING (pos) GROUP BY id),
w{e} AS (SELECT pos, any_value(w) - {RATE} * sum((p - p{e}.y) * x) / any_value(n) AS w
         FROM flat JOIN p{e} USING (id) JOIN w{e - 1} USING (pos), size GROUP BY pos)"""
    return out


def _on_each_checkpoint(template):
    return " UNION ALL ".join(template.format(e=e) for e in range(1, EPOCHS + 1))


RESIDUAL_SQL = f"""{gradient_steps_sql()},
res AS ({_on_each_checkpoint('''SELECT {e} AS c, id, any_value(y) AS y, 1 / (1 + exp(-sum(x * w))) - any_value(y) AS r
  FROM flat JOIN w{e} USING (pos) GROUP BY id''')})"""


def _trained(spark, folder):
    train, val = B.vector_split(spark, folder)
    train = settle(train)
    return train, val, L.fit_checkpoints(train, epochs=EPOCHS, rate=RATE)


@query(
    "value_tracin_self",
    f"""WITH {B.VECTORS_SQL}, {RESIDUAL_SQL},
norms AS (SELECT id, sum(x * x) AS q FROM flat GROUP BY id)
SELECT id, round(-sum(r * r * q), 6) AS value FROM res JOIN norms USING (id) GROUP BY id""",
)
def tracin_self(spark, folder):
    train, _, checkpoints = _trained(spark, folder)
    return L.value_tracin_self(train, checkpoints).select("id", F.round("value", 6).alias("value"))


def tracin_test_sql(val):
    return f"""WITH {B.VECTORS_SQL}, {RESIDUAL_SQL},
target AS ({val}),
vflat AS (SELECT id, y, CAST(unnest(features) AS DOUBLE) AS x, generate_subscripts(features, 1) AS pos FROM target
          UNION ALL SELECT id, y, 1.0, 0 FROM target),
vres AS ({_on_each_checkpoint('''SELECT {e} AS c, id, 1 / (1 + exp(-sum(x * w))) - any_value(y) AS r
  FROM vflat JOIN w{e} USING (pos) GROUP BY id''')}),
g AS (SELECT c, pos, sum(r * x) / (SELECT count(*) FROM target) AS g FROM vres JOIN vflat USING (id) GROUP BY c, pos)
SELECT id, round(-sum(r * x * g), 6) AS value FROM res JOIN flat USING (id) JOIN g USING (c, pos) GROUP BY id"""


@query("value_tracin_test", tracin_test_sql("SELECT * FROM val"))
def tracin_test(spark, folder):
    train, val, checkpoints = _trained(spark, folder)
    return L.value_tracin_test(train, val, checkpoints).select("id", F.round("value", 6).alias("value"))


@query("value_tracin_pos", tracin_test_sql("SELECT * FROM val WHERE y = 1"))
def tracin_pos(spark, folder):
    train, val, checkpoints = _trained(spark, folder)
    valued = L.value_tracin_test(train, positives_only(val, "y"), checkpoints)
    return valued.select("id", F.round("value", 6).alias("value"))


@query(
    "influence_output",
    f"""WITH {B.VECTORS_SQL}, {RESIDUAL_SQL},
norms AS (SELECT id, sum(x * x) AS q FROM flat GROUP BY id),
v AS (SELECT id, any_value(y) AS y, -sum(r * r * q) AS value FROM res JOIN norms USING (id) GROUP BY id)
SELECT v.id, v.y, round(value, 6) AS value, round(r + v.y, 6) AS probability,
       CASE WHEN r + v.y >= 0.5 THEN 1 ELSE 0 END AS predicted
FROM v JOIN res ON v.id = res.id AND c = {EPOCHS}""",
)
def influence_output(spark, folder):
    train, _, checkpoints = _trained(spark, folder)
    beside = L.influence_output(L.value_tracin_self(train, checkpoints), checkpoints[-1])
    return beside.select(
        "id", "y", F.round("value", 6).alias("value"), F.round("probability", 6).alias("probability"), "predicted"
    )


ROUNDS = 6
BITS = len(B.LINE_FEATURES)


def booster_sql(rows="lineitem", rounds=ROUNDS, eta=0.1, penalty=1.0):
    """Counts per side pattern, then one margin column set per round."""
    means = ", ".join(f"avg({c}) AS m{j}" for j, c in enumerate(B.LINE_FEATURES))
    bits = ", ".join(f"CASE WHEN {c} > m{j} THEN 1 ELSE 0 END AS b{j}" for j, c in enumerate(B.LINE_FEATURES))
    names = ", ".join(f"b{j}" for j in range(BITS))
    out = f"""
means AS (SELECT {means}, avg(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS share FROM {rows}),
lines AS (SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, {bits}
          FROM {rows}, means),
f0 AS (SELECT {names}, y, n, ln(share / (1 - share)) AS f
       FROM (SELECT {names}, y, count(*) AS n FROM lines GROUP BY ALL), means)"""
    for t in range(rounds):
        side = f"b{t % BITS}"
        out += f""",
g{t} AS (SELECT *, 1 / (1 + exp(-f)) - y AS g, (1 / (1 + exp(-f))) * (1 - 1 / (1 + exp(-f))) AS h FROM f{t}),
s{t} AS (SELECT {side} AS side, sum(n * h) AS hs, -{eta} * sum(n * g) / (sum(n * h) + {penalty}) AS w FROM g{t} GROUP BY 1),
c{t} AS (SELECT {t} AS t, {names}, y, n, g, h, side, w, hs, (SELECT sum(abs(w)) FROM s{t}) AS l1
         FROM g{t} JOIN s{t} ON side = {side}),
f{t + 1} AS (SELECT {names}, y, n, f + w AS f FROM g{t} JOIN s{t} ON side = {side})"""
    stacked = " UNION ALL ".join(f"SELECT * FROM c{t}" for t in range(rounds))
    return out + f",\ntrees AS ({stacked})"


LINE_KEYS = ["l_orderkey", "l_partkey", "l_linenumber"]
_BIT_NAMES = [f"b{j}" for j in range(BITS)] + ["y"]
_SAME_CELL = " AND ".join(f"l.{b} = v.{b}" for b in _BIT_NAMES)
_CELL = ", ".join(_BIT_NAMES)


def _booster(spark, folder):
    rows = B.lines(spark, folder)
    return rows, T.fit_stumps(rows, B.LINE_FEATURES, rounds=ROUNDS)


@query(
    "value_mvs",
    f"""WITH {booster_sql()},
v AS (SELECT {_CELL}, -sum(least(1, sqrt(g * g + l1 * h * h))) AS value FROM trees GROUP BY ALL)
SELECT l_orderkey, l_partkey, l_linenumber, round(value, 6) AS value FROM lines l JOIN v ON {_SAME_CELL}""",
)
def mvs(spark, folder):
    rows, model = _booster(spark, folder)
    return T.value_mvs(rows, model).select(*LINE_KEYS, F.round("value", 6).alias("value"))


@query(
    "mvs_trajectory",
    f"""WITH {booster_sql()},
v AS (SELECT {_CELL}, t, least(1, sqrt(g * g + l1 * h * h)) AS value FROM trees)
SELECT l.l_linenumber, l.y, CAST(t AS INTEGER) AS iter, count(*) AS n_rows, round(avg(value), 6) AS mean_value
FROM lines l JOIN v ON {_SAME_CELL} GROUP BY ALL""",
)
def trajectory(spark, folder):
    rows, model = _booster(spark, folder)
    steps = T.mvs_trajectory(rows, model)
    return steps.groupBy("l_linenumber", "y", "iter").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("value"), 6).alias("mean_value")
    )


@query(
    "mvs_predict",
    f"""WITH {booster_sql("(SELECT * FROM lineitem WHERE l_linestatus = 'F')")},
cells AS (SELECT {", ".join(f"b{j}" for j in range(BITS))}, t, any_value(1 / (1 + exp(-f))) AS p, any_value(l1) AS l1
          FROM ({" UNION ALL ".join(f"SELECT c{t}.*, f FROM c{t} JOIN f{t} USING (" + _CELL + ")" for t in range(ROUNDS))})
          GROUP BY ALL),
fresh AS (SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
            {", ".join(f"CASE WHEN {c} > m{j} THEN 1 ELSE 0 END AS b{j}" for j, c in enumerate(B.LINE_FEATURES))}
          FROM lineitem, means WHERE l_linestatus <> 'F')
SELECT l_orderkey, l_partkey, l_linenumber,
  round(-sum(least(1, sqrt((p - y) * (p - y) + l1 * p * (1 - p) * p * (1 - p)))), 6) AS value
FROM (SELECT *, row_number() OVER () AS rid FROM fresh) JOIN cells USING ({", ".join(f"b{j}" for j in range(BITS))})
GROUP BY rid, l_orderkey, l_partkey, l_linenumber""",
)
def mvs_predict(spark, folder):
    source = B.table(spark, folder, "lineitem")
    rows = source.select(
        *LINE_KEYS, *B.LINE_FEATURES, "l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("y")
    )
    model = T.fit_stumps(rows.where(F.col("l_linestatus") == "F"), B.LINE_FEATURES, rounds=ROUNDS)
    fresh = rows.where(F.col("l_linestatus") != "F")
    return T.value_mvs(fresh, model).select(*LINE_KEYS, F.round("value", 6).alias("value"))


def leaf_sql(target):
    return f"""WITH {booster_sql()},
pull AS (SELECT {_CELL}, n * (1 / (1 + exp(-f)) - y) AS pull FROM f{ROUNDS} WHERE {target}),
leaf AS (SELECT t, side, sum(pull) AS pull FROM trees JOIN pull USING ({_CELL}) GROUP BY t, side),
v AS (SELECT {_CELL}, -sum(pull * -0.1 * (g + w / 0.1 * h) / (hs + 1.0)) AS value
      FROM trees JOIN leaf USING (t, side) GROUP BY ALL)
SELECT l_orderkey, l_partkey, l_linenumber, round(value, 6) AS value FROM lines l JOIN v ON {_SAME_CELL}"""


@query("value_leaf_influence_self", leaf_sql("y = 1"))
def leaf_self(spark, folder):
    rows, model = _booster(spark, folder)
    valued = T.value_leaf_influence(rows, model, rows.where(F.col("y") == 1))
    return valued.select(*LINE_KEYS, F.round("value", 6).alias("value"))


@query(
    "value_leaf_influence_test",
    leaf_sql("true").replace(
        f"FROM f{ROUNDS} WHERE true",
        f"""FROM (SELECT {", ".join(f"f.b{j}" for j in range(BITS))}, f.y, f.f, count(*) AS n
    FROM lines l JOIN f{ROUNDS} f ON {_SAME_CELL.replace("v.", "f.")} WHERE l.l_linenumber = 1 GROUP BY ALL)""",
    ),
)
def leaf_test(spark, folder):
    rows, model = _booster(spark, folder)
    target = rows.where(F.col("l_linenumber") == 1)
    valued = T.value_leaf_influence(rows, model, target)
    return valued.select(*LINE_KEYS, F.round("value", 6).alias("value"))
