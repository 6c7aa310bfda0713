"""The three applications, end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowworth.operators import logistic as L
from rowworth.operators import stumps as T
from rowworth.operators.baseline import value_rules, value_score
from rowworth.operators.split import exclude_split, random_split
from rowworth.plans import active_learning as A
from rowworth.plans import curves as C
from rowworth.plans import undersampling as U
from rowworth.plans.false_positives import false_positives
from rowworth.registry import bindings as B
from rowworth.registry import query
from rowworth.registry.metrics import NINE_SQL
from rowworth.registry.models import settled_split
from rowworth.registry.valuation import ALERTS, RESIDUAL_SQL
from rowworth.session import settle
from rowworth.sources.writers import stack_replicates


@query(
    "false_positives",
    f"""WITH {B.DOCS_FLAGGED_SQL}, {NINE_SQL}
SELECT 'docs' AS dataset, 'score' AS method, CAST(r AS INTEGER) AS replicate, metric, round(value, 6) AS value
FROM (UNPIVOT nine ON COLUMNS(*) INTO NAME metric VALUE value), range(3) x(r)""",
)
def fp_score(spark, folder):
    screen = settle(B.docs_screen(spark, folder))
    metrics, _ = false_positives(
        screen, lambda df, seed: value_score(df), "docs", "score", replicates=3, group_key="source", timed=False
    )
    return metrics.withColumn("value", F.round("value", 6))


@query("false_positives_methods")
def fp_methods(spark, folder):
    """Rules, booster and gradient tracing side by side on the documents screen."""
    text = F.col("text")
    counts = B.table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        "text",
        F.col("n_chars").cast("double").alias("f_length"),
        F.size(F.split(text, " ")).cast("double").alias("f_words"),
        F.regexp_count(text, F.lit("[0-9]")).cast("double").alias("f_digits"),
        F.regexp_count(text, F.lit("[.]")).cast("double").alias("f_stops"),
    )
    screen = settle(B.docs_screen(spark, folder).join(counts, "id"))
    names = ["f_length", "f_words", "f_digits", "f_stops"]

    def rules(df, seed):
        return value_rules(df, ALERTS, "text")

    def booster(df, seed):
        return T.value_mvs(df, T.fit_stumps(df, names, label="primary", rounds=40), label="primary")

    def tracing(df, seed):
        scaled = df.withColumn("features", F.array(*[F.log1p(c) / 10 for c in names]))
        return L.value_tracin_self(scaled, L.fit_checkpoints(scaled, label="primary", epochs=9, keep=[3, 6, 9]), "primary")

    parts = []
    # models read their rows many times, but no texts
    counted = settle(screen.drop("text"))
    for name, valuer, rows in (("rules", rules, screen), ("mvs", booster, counted), ("tracin_self", tracing, counted)):
        metrics, _ = false_positives(rows, valuer, "docs", name, replicates=2, group_key="source", timed=False)
        parts.append(metrics)
    return stack_replicates(parts)


def _rare_class(spark, folder):
    """Vectors of one class as the actives to be found."""
    rows = B.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), (F.col("label") < 1).cast("int").alias("y"), F.col("embedding").alias("features")
    )
    val = settle(random_split(rows, 0.2, seed=7))
    return settle(exclude_split(rows, val)), val


def _tracin_valuer(pool):
    return L.value_tracin_self(pool, L.fit_checkpoints(pool, epochs=3))


@query("active_learning")
def active_learning(spark, folder):
    train, _ = _rare_class(spark, folder)
    return A.active_learning(train, _tracin_valuer, "ridge", step_share=0.05, steps=6)


@query("active_learning_ucb")
def active_learning_ucb(spark, folder):
    train, _ = _rare_class(spark, folder)
    return A.active_learning(train, _tracin_valuer, "gp", "ucb", step_share=0.05, steps=6)


@query("active_learning_grid")
def active_learning_grid(spark, folder):
    train, _ = _rare_class(spark, folder)
    curves = C.grid_curves(C.METHODS, ["ridge", "gp"], ["greedy", "ucb"], replicates=2)
    return C.active_learning_curves(train, curves, step_share=0.05, steps=6)


@query(
    "active_learning_projections",
    """WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS y, o_totalprice AS price, -o_custkey AS customer FROM orders),
p AS (SELECT t.*, r, row_number() OVER (PARTITION BY r ORDER BY md5(CAST(r AS VARCHAR) || ':' || CAST(id AS VARCHAR)), id) AS pos,
  count(*) OVER (PARTITION BY r) AS n, sum(y) OVER (PARTITION BY r) AS all_y FROM t, range(2) x(r)),
m AS (UNPIVOT (SELECT id, y, r, pos, n, all_y, CAST(price AS DOUBLE) AS price, CAST(customer AS DOUBLE) AS customer FROM p)
  ON price, customer INTO NAME method VALUE v),
q AS (SELECT *, CASE WHEN pos <= ceil(n * CAST(0.01 AS DOUBLE)) THEN 0 ELSE ceil(
    row_number() OVER (PARTITION BY r, method, pos <= ceil(n * CAST(0.01 AS DOUBLE)) ORDER BY v, id) / floor(n * CAST(0.01 AS DOUBLE))) END AS round FROM m)
SELECT method || '_known_' || a AS method, CAST(r AS INTEGER) AS replicate, CAST(s AS INTEGER) AS step, count(*) AS n_sampled,
  CAST(sum(y) AS BIGINT) AS found, round(CAST(sum(y) AS DOUBLE) / max(all_y), 6) AS share
FROM q, range(7) z(s), (VALUES ('greedy'), ('ucb')) w(a) WHERE round <= s GROUP BY method, a, r, s""",
)
def active_learning_projections(spark, folder):
    """A grid whose values are columns of the orders themselves."""
    orders = B.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "P").cast("int").alias("y"), "o_totalprice", "o_custkey"
    )
    methods = {"price": F.col("o_totalprice"), "customer": -F.col("o_custkey")}
    curves = C.grid_curves(methods, ["known"], ["greedy", "ucb"], replicates=2)
    return C.active_learning_curves(orders, curves, methods).withColumn("share", F.round("share", 6))


@query("undersample_assays")
def undersample_assays(spark, folder):
    """Two classes of the vectors as two assays."""
    rows = B.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), "label", F.col("embedding").alias("features")
    )
    val = random_split(rows, 0.2, seed=7).select("id", F.lit("validation").alias("split"))
    marked = rows.join(val, "id", "left").withColumn("split", F.coalesce("split", F.lit("train")))
    cells = F.explode(
        F.array(*[F.struct(F.lit(str(c)).alias("aid"), (F.col("label") % 2 == c).cast("double").alias("activity")) for c in (0, 1)])
    )
    long = settle(marked.select("id", "features", "split", cells.alias("c")).select("id", "features", "split", "c.*"))
    return U.undersample_assays(long, ["0", "1"], _tracin_valuer)


@query("active_learning_greedy")
def active_learning_greedy(spark, folder):
    train, _ = _rare_class(spark, folder)
    return A.active_learning_greedy(train, step_share=0.05, steps=6)


RANDOM_SQL = """WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS y FROM orders),
p AS (SELECT *, row_number() OVER (ORDER BY md5('0:' || CAST(id AS VARCHAR)), id) AS pos, count(*) OVER () AS n, sum(y) OVER () AS all_y FROM t),
r AS (SELECT *, greatest(ceil((pos - ceil(n * CAST(0.01 AS DOUBLE))) / floor(n * CAST(0.01 AS DOUBLE))), 0) AS round FROM p)
"""


@query(
    "active_learning_random",
    RANDOM_SQL
    + """SELECT CAST(s AS INTEGER) AS step, count(*) AS n_sampled, CAST(sum(y) AS BIGINT) AS found,
  round(CAST(sum(y) AS DOUBLE) / max(all_y), 6) AS share FROM r, range(7) x(s) WHERE round <= s GROUP BY s""",
)
def active_learning_random(spark, folder):
    orders = B.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "P").cast("int").alias("y")
    )
    return A.active_learning_random(orders).withColumn("share", F.round("share", 6))


@query(
    "grow_pool",
    RANDOM_SQL + "SELECT id, CAST(round AS INTEGER) AS round FROM r WHERE round <= 1",
)
def grow_pool(spark, folder):
    from rowworth.operators.removal import rank_batch
    from rowworth.operators.split import random_order

    orders = B.table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))
    first = random_split(orders, 0.01).select("id", F.lit(0).alias("round"))
    rest = exclude_split(orders, first)
    batch = rank_batch(random_order(rest), "position", 0.01, orders.count())
    return A.grow_pool(first, batch, 1)


@query(
    "actives_found",
    """WITH s AS (SELECT l_orderkey, l_linenumber - 1 AS round, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem)
SELECT CAST(k AS INTEGER) AS step, count(*) AS n_sampled, CAST(sum(y) AS BIGINT) AS found,
  round(CAST(sum(y) AS DOUBLE) / (SELECT sum(y) FROM s), 6) AS share FROM s, range(7) x(k) WHERE round <= k GROUP BY k""",
)
def actives_found(spark, folder):
    lines = B.table(spark, folder, "lineitem").select(
        (F.col("l_linenumber") - 1).alias("round"), (F.col("l_returnflag") == "R").cast("int").alias("y")
    )
    # an id of its own for every line, the order of the file being enough for that
    rows = settle(lines.withColumn("id", F.monotonically_increasing_id()))
    return A.actives_found(rows, rows.select("id", "round")).withColumn("share", F.round("share", 6))


def _valued_vectors(spark, folder):
    train, val = settled_split(spark, folder)
    valued = settle(L.value_tracin_self(train, L.fit_checkpoints(train, epochs=3)))
    return valued, val


SWEEP = {"epochs": 5, "rate": 2.0}


def _many_sql(runs: str, weight: str, epochs: int = SWEEP["epochs"], rate: float = SWEEP["rate"]) -> str:
    """Gradient steps of all models side by side; `runs` lists (id, run, y) of the rows of each model."""
    out = f"""
fits AS MATERIALIZED (SELECT r.id, r.run, r.y, {weight} AS weight FROM ({runs}) r),
cells AS MATERIALIZED (SELECT id, CAST(unnest(features) AS DOUBLE) AS x, generate_subscripts(features, 1) AS pos FROM train
  UNION ALL SELECT id, 1.0, 0 FROM train),
sizes AS (SELECT run, sum(weight) AS size FROM fits GROUP BY run),
v0 AS MATERIALIZED (SELECT run, pos, CAST(0 AS DOUBLE) AS w FROM sizes, (SELECT DISTINCT pos FROM cells))"""
    for e in range(1, epochs + 1):
        out += f""",
q{e} AS MATERIALIZED (SELECT f.id, f.run, any_value(f.weight) * (1 / (1 + exp(-sum(x * w))) - any_value(f.y)) AS pull
  FROM fits f JOIN cells USING (id) JOIN v{e - 1} USING (run, pos) GROUP BY f.id, f.run),
v{e} AS MATERIALIZED (SELECT run, pos, any_value(w) - {rate} * sum(pull * x) / any_value(size) AS w
  FROM q{e} JOIN cells USING (id) JOIN v{e - 1} USING (run, pos) JOIN sizes USING (run) GROUP BY run, pos)"""
    return out + f""",
vcells AS MATERIALIZED (SELECT id, CAST(unnest(features) AS DOUBLE) AS x, generate_subscripts(features, 1) AS pos FROM val
  UNION ALL SELECT id, 1.0, 0 FROM val),
scored AS MATERIALIZED (SELECT run, v.id, any_value(v.y) AS y, 1 / (1 + exp(-sum(x * w))) AS s
  FROM val v JOIN vcells USING (id) JOIN v{epochs} USING (pos) GROUP BY run, v.id)"""


_VALUED_SQL = f"""{B.VECTORS_SQL}, {RESIDUAL_SQL},
norms AS (SELECT id, sum(x * x) AS q FROM flat GROUP BY id),
valued AS MATERIALIZED (SELECT id, any_value(res.y) AS y, -sum(r * r * q) AS value FROM res JOIN norms USING (id) GROUP BY id)"""

_SWEEP_RUNS = """SELECT id, 'basic:0' AS run, y FROM placed
  UNION ALL SELECT id, side || ':' || level, y FROM (UNPIVOT placed ON low, high, random INTO NAME side VALUE place), levels WHERE y = 1 OR place > k"""
_SWEEP_WEIGHT = "(SELECT w FROM classes c WHERE c.y = r.y)"


@query(
    "undersample_sweep",
    f"""WITH {_VALUED_SQL},
classes AS (SELECT y, sqrt(CAST((SELECT count(*) FROM valued) AS DOUBLE) / count(*)) AS w FROM valued GROUP BY y),
placed AS MATERIALIZED (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY value, id) AS low,
    row_number() OVER (PARTITION BY y ORDER BY value DESC, id DESC) AS high,
    row_number() OVER (PARTITION BY y ORDER BY md5('0:' || CAST(id AS VARCHAR)), id) AS random FROM valued),
levels AS (SELECT CAST(j AS INTEGER) AS level, CAST(floor((SELECT count(*) FROM valued) * CAST(0.05 AS DOUBLE) * j + 1e-9) AS INTEGER) AS k FROM range(1, 20) x(j)),
{_many_sql(_SWEEP_RUNS, _SWEEP_WEIGHT)},
steps AS (SELECT run, s, count(*) AS n, sum(y) AS p FROM scored GROUP BY run, s),
upto AS (SELECT run, p, sum(n) OVER (PARTITION BY run ORDER BY s DESC) AS cn, sum(p) OVER (PARTITION BY run ORDER BY s DESC) AS cp FROM steps),
area AS (SELECT run, CAST(sum(p * cp / cn) / sum(p) AS DOUBLE) AS ap FROM upto GROUP BY run)
SELECT level, round(level * 0.05, 3) AS pct, k AS counts, round((SELECT ap FROM area WHERE run = 'basic:0'), 6) AS basic,
  round(max(ap) FILTER (WHERE run = 'high:' || level), 6) AS high, round(max(ap) FILTER (WHERE run = 'low:' || level), 6) AS low,
  round(max(ap) FILTER (WHERE run = 'random:' || level), 6) AS random
FROM levels, area GROUP BY level, k""",
)
def undersample_sweep(spark, folder):
    valued, val = _valued_vectors(spark, folder)
    sweep = U.undersample_sweep(valued, val, **SWEEP)
    return sweep.select("level", "pct", "counts", *[F.round(c, 6).alias(c) for c in ("basic", "high", "low", "random")])


_REMOVAL_SQL = f"""{_VALUED_SQL},
parted AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY md5('1:' || CAST(id AS VARCHAR)), id)
    <= (SELECT ceil(count(*) * CAST(0.5 AS DOUBLE)) FROM val) AS first FROM val),
placed AS MATERIALIZED (SELECT id, y, row_number() OVER (ORDER BY value, id) AS low, row_number() OVER (ORDER BY value DESC, id DESC) AS high FROM valued),
cuts AS (SELECT CAST(b AS INTEGER) AS bin, floor(b * (SELECT count(*) FROM valued) / 20) AS k FROM range(20) x(b)),
kept AS MATERIALIZED (SELECT id, side || ':' || bin AS run, y FROM (UNPIVOT placed ON low, high INTO NAME side VALUE place), cuts WHERE place > k),
{_many_sql("SELECT * FROM kept WHERE run IN (SELECT run FROM kept GROUP BY run HAVING min(y) < max(y))", "1.0")},
steps AS (SELECT run, first, s, sum(y) AS p, sum(1 - y) AS n FROM scored JOIN parted USING (id) GROUP BY run, first, s),
upto AS (SELECT *, sum(n) OVER (PARTITION BY run, first ORDER BY s) AS cn FROM steps),
auc AS (SELECT run, first, CAST(sum(p * (cn - n / 2)) / (sum(p) * sum(n)) AS DOUBLE) AS a FROM upto GROUP BY run, first),
removal AS (SELECT side, bin, round(coalesce((SELECT max(a) FROM auc WHERE run = side || ':' || bin AND first), 0), 6) AS valid,
  round(coalesce((SELECT max(a) FROM auc WHERE run = side || ':' || bin AND NOT first), 0), 6) AS test
  FROM cuts, (VALUES ('low'), ('high')) x(side))"""


def _removal(spark, folder):
    valued, val = _valued_vectors(spark, folder)
    valid = settle(random_split(val, 0.5, seed=1))
    found = U.remove_high_low(valued, valid, exclude_split(val, valid), **SWEEP)
    return found.select("side", "bin", F.round("valid", 6).alias("valid"), F.round("test", 6).alias("test"))


@query("remove_high_low", f"WITH {_REMOVAL_SQL} SELECT * FROM removal")
def remove_high_low(spark, folder):
    return _removal(spark, folder)


@query(
    "learn_with_values",
    f"WITH {_REMOVAL_SQL} SELECT side, bin, test FROM removal ORDER BY valid DESC, side <> 'low', bin LIMIT 1",
)
def learn_with_values(spark, folder):
    return U.learn_with_values(_removal(spark, folder))


@query("learn_baseline")
def learn_baseline(spark, folder):
    train, val = settled_split(spark, folder)
    return U.learn_baseline(train, val)
