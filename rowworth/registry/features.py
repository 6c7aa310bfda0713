"""Feature queries: tokens, fingerprints, descriptors, scaling, rules, acquisition."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowworth.functions import columns as C
from rowworth.operators import features as X
from rowworth.operators.ordering import attach_totals
from rowworth.operators.rules import read_rules, rule_alerts, rules_found
from rowworth.registry import bindings as B
from rowworth.registry import query
from rowworth.registry.metrics import _rounded
from rowworth.registry.valuation import ALERT_SUM_SQL, ALERTS
from rowworth.session import settle

_PATTERN_SQL = C.TOKEN_PATTERN.replace("'", "''")
TOKENS_SQL = f"regexp_extract_all(text, '{_PATTERN_SQL}', 1)"


def tokens(spark, folder):
    texts = B.spread(B.table(spark, folder, "documents").select("doc_id", "text"))
    return texts.select(F.col("doc_id").alias("id"), C.tokenize(F.col("text")).alias("tokens"))


def words(spark, folder):
    texts = B.spread(B.table(spark, folder, "documents").select("doc_id", "text"))
    return texts.select(F.col("doc_id").alias("id"), C.tokenize(F.col("text"), "([^ \\n]+)").alias("tokens"))


WORDS_SQL = "regexp_extract_all(text, '([^ \\n]+)', 1)"


@query(
    "tokenize",
    f"""SELECT id, len(t) AS n_tokens, md5(array_to_string(t, '|')) AS digest
FROM (SELECT doc_id AS id, {TOKENS_SQL} AS t FROM documents)""",
)
def tokenize(spark, folder):
    listed = tokens(spark, folder)
    return listed.select(
        "id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", "|")).alias("digest")
    )


@query(
    "vocabulary",
    f"""WITH v AS (SELECT DISTINCT unnest({WORDS_SQL}) AS token FROM documents)
SELECT token, row_number() OVER (ORDER BY token) - 1 AS index FROM v""",
)
def vocabulary(spark, folder):
    return X.vocabulary(words(spark, folder))


ENCODED_SQL = f"""WITH docs AS (SELECT doc_id AS id, {WORDS_SQL} AS t FROM documents),
v AS (SELECT token, row_number() OVER (ORDER BY token) AS code FROM (SELECT DISTINCT unnest(t) AS token FROM docs)),
cells AS (SELECT id, unnest(t[1:120]) AS token, generate_subscripts(t[1:120], 1) AS pos FROM docs),
coded AS (SELECT id, list(code ORDER BY pos) AS codes FROM cells JOIN v USING (token) GROUP BY id)"""


@query(
    "encode_tokens",
    f"""{ENCODED_SQL}
SELECT docs.id, md5(array_to_string(list_concat(coalesce(codes, []), list_transform(range(120 - len(coalesce(codes, []))), lambda x: 0)), ',')) AS digest,
  len(t) > 120 AS is_cut FROM docs LEFT JOIN coded ON docs.id = coded.id""",
)
def encode_tokens(spark, folder):
    listed = settle(words(spark, folder))
    coded = X.encode_tokens(listed, X.vocabulary(listed), 120)
    digest = F.md5(F.array_join(F.col("codes").cast("array<string>"), ","))
    return coded.select("id", digest.alias("digest"), (F.size("tokens") > 120).alias("is_cut"))


@query(
    "encode_tokens_val",
    f"""{ENCODED_SQL}
SELECT docs.id, len(t) AS n_tokens, CAST(coalesce(list_sum(codes), 0) AS BIGINT) AS code_sum
FROM docs LEFT JOIN coded ON docs.id = coded.id WHERE len(t) <= 120""",
)
def encode_tokens_val(spark, folder):
    listed = settle(words(spark, folder))
    coded = X.encode_tokens(listed, X.vocabulary(listed), 120, too_long="drop")
    total = F.aggregate("codes", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return coded.select("id", F.size("tokens").alias("n_tokens"), total.alias("code_sum"))


def _grams_sql(width):
    shifted = " || ' ' || ".join(f"t[i + {j}]" for j in range(width))
    return f"list_transform(range(1, len(t) - {width - 2}), lambda i: {shifted})"


@query(
    "hashed_fingerprint",
    f"""WITH docs AS (SELECT doc_id AS id, {WORDS_SQL} AS t FROM documents),
grams AS (SELECT id, unnest(list_concat({_grams_sql(1)}, {_grams_sql(2)}, {_grams_sql(3)})) AS g FROM docs),
bits AS (SELECT DISTINCT id, CAST(('0x' || substr(md5(g), 1, 8)) AS BIGINT) % 1024 AS bit FROM grams)
SELECT docs.id, count(bit) AS n_bits, CAST(coalesce(sum(bit), 0) AS BIGINT) AS bit_sum
FROM docs LEFT JOIN bits ON docs.id = bits.id GROUP BY docs.id""",
)
def hashed_fingerprint(spark, folder):
    listed = words(spark, folder).select("id", C.hashed_fingerprint(F.col("tokens")).alias("bits"))
    total = F.aggregate("bits", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return listed.select("id", F.size("bits").cast("bigint").alias("n_bits"), total.alias("bit_sum"))


def docs_descriptors(spark, folder):
    """Six counts of a text as its feature array."""
    texts = B.table(spark, folder, "documents")
    text = F.col("text")
    counts = [
        F.col("n_chars"),
        F.size(F.split(text, " ")),
        F.regexp_count(text, F.lit("[0-9]")),
        F.regexp_count(text, F.lit("[A-Z]")),
        F.regexp_count(text, F.lit("[.]")),
        F.regexp_count(text, F.lit("[\n]")) / F.col("n_chars"),
    ]
    return texts.select(F.col("doc_id").alias("id"), "lang", C.numeric_descriptors(counts).alias("features"))


DESCRIPTORS_SQL = """desc_cells AS (
  SELECT doc_id AS id, lang, CAST(n_chars AS DOUBLE) AS f0, CAST(len(string_split(text, ' ')) AS DOUBLE) AS f1,
    CAST(len(regexp_extract_all(text, '[0-9]')) AS DOUBLE) AS f2, CAST(len(regexp_extract_all(text, '[A-Z]')) AS DOUBLE) AS f3,
    CAST(len(regexp_extract_all(text, '[.]')) AS DOUBLE) AS f4,
    CASE WHEN n_chars = 0 THEN 0 ELSE len(regexp_extract_all(text, '[\n]')) / n_chars END AS f5 FROM documents)"""


@query(
    "numeric_descriptors",
    f"""WITH {DESCRIPTORS_SQL}
SELECT id, f0, f1, f2, f3, f4, round(f5, 6) AS f5 FROM desc_cells""",
)
def numeric_descriptors(spark, folder):
    cells = docs_descriptors(spark, folder)
    return cells.select(
        "id", *[F.round(F.col("features")[j], 6 if j == 5 else 0).alias(f"f{j}") for j in range(6)]
    )


@query(
    "standardize",
    """WITH m AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS b, avg(l_discount) AS c, stddev_pop(l_discount) AS d
  FROM lineitem WHERE l_linestatus = 'F')
SELECT l_orderkey, l_partkey, l_linenumber, round((l_quantity - a) / b, 6) AS l_quantity, round((l_discount - c) / d, 6) AS l_discount
FROM lineitem, m""",
)
def standardize(spark, folder):
    rows = B.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_linestatus"
    )
    columns = ["l_quantity", "l_discount"]
    fitted = X.scaler(rows.where(F.col("l_linestatus") == "F"), columns)
    return _rounded(X.standardize(rows, fitted, columns).drop("l_linestatus"))


@query(
    "standardize_array",
    f"""WITH {B.VECTORS_SQL},
flat AS (SELECT id, 't' AS part, CAST(unnest(features) AS DOUBLE) AS x, generate_subscripts(features, 1) AS pos FROM train
         UNION ALL SELECT id, 'v', CAST(unnest(features) AS DOUBLE), generate_subscripts(features, 1) FROM val),
m AS (SELECT pos, avg(x) AS a, stddev_pop(x) AS s FROM flat WHERE part = 't' GROUP BY pos)
SELECT id, round(sum(((x - a) / s) * ((x - a) / s)), 6) AS norm FROM flat JOIN m USING (pos) WHERE part = 'v' GROUP BY id""",
)
def standardize_array(spark, folder):
    train, val = B.vector_split(spark, folder)
    scaled = X.standardize_array(val, X.array_scaler(train))
    return scaled.select("id", F.round(C.dot(F.col("features"), F.col("features")), 6).alias("norm"))


@query(
    "standardize_target",
    """WITH m AS (SELECT avg(c_acctbal) AS a, stddev_pop(c_acctbal) AS s FROM customer)
SELECT c_custkey AS id, round((c_acctbal - a) / s, 6) AS value FROM customer, m""",
)
def standardize_target(spark, folder):
    rows = B.table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    return _rounded(X.standardize_target(rows))


@query(
    "tanimoto",
    """WITH flat AS (SELECT vec_id AS id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
centre AS (SELECT label, pos, avg(x) AS c FROM flat GROUP BY label, pos),
s AS (SELECT id, sum(x * c) AS d, sum(x * x) AS q, sum(c * c) AS r FROM flat JOIN centre USING (label, pos) GROUP BY id)
SELECT id, round(d / (q + r - d), 6) AS similarity FROM s""",
)
def tanimoto(spark, folder):
    rows = B.table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    cells = rows.select("label", F.posexplode("embedding").alias("pos", "x"))
    centres = (
        cells.groupBy("label", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("c"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "c")))["c"].alias("centre"))
    )
    joined = attach_totals(rows, centres, ["label"])
    return joined.select("id", F.round(C.tanimoto(F.col("embedding"), F.col("centre")), 6).alias("similarity"))


@query(
    "tanimoto_bits",
    f"""WITH docs AS (SELECT doc_id AS id, lang, {WORDS_SQL} AS t FROM documents),
bits AS (SELECT DISTINCT id, lang, CAST(('0x' || substr(md5(g), 1, 8)) AS BIGINT) % 1024 AS bit
         FROM (SELECT id, lang, unnest({_grams_sql(1)}) AS g FROM docs)),
first_doc AS (SELECT lang, min(id) AS ref FROM docs GROUP BY lang),
size AS (SELECT id, lang, count(*) AS n FROM bits GROUP BY id, lang),
shared AS (SELECT a.id, count(*) AS s FROM bits a JOIN first_doc f ON a.lang = f.lang JOIN bits b ON b.id = f.ref AND a.bit = b.bit GROUP BY a.id)
SELECT d.id, coalesce(s / (z.n + r.n - s), 0) AS similarity
FROM docs d JOIN first_doc f ON d.lang = f.lang LEFT JOIN size z ON z.id = d.id LEFT JOIN size r ON r.id = f.ref
LEFT JOIN shared ON shared.id = d.id""",
)
def tanimoto_bits(spark, folder):
    texts = B.spread(B.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "lang", "text"))
    listed = C.tokenize(F.col("text"), "([^ \\n]+)")
    bits = settle(texts.select("id", "lang", C.hashed_fingerprint(listed, radius=0).alias("bits")))
    first = bits.groupBy("lang").agg(F.min_by("bits", "id").alias("ref"))
    similarity = C.tanimoto_bits(F.col("bits"), F.col("ref"))
    return attach_totals(bits, first, ["lang"]).select("id", similarity.alias("similarity"))


@query(
    "acq_greedy",
    """SELECT l_partkey AS id, round(avg(l_quantity), 6) AS acquisition FROM lineitem GROUP BY 1""",
)
def acq_greedy(spark, folder):
    spread = B.table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(
        F.avg("l_quantity").alias("mean")
    )
    return spread.select("id", F.round(C.acq_greedy(F.col("mean")), 6).alias("acquisition"))


@query(
    "acq_ucb",
    """SELECT l_partkey AS id, round(avg(l_quantity) + 2 * stddev_pop(l_quantity), 6) AS acquisition,
  round(avg(l_quantity) - 2 * stddev_pop(l_quantity), 6) AS exploring FROM lineitem GROUP BY 1""",
)
def acq_ucb(spark, folder):
    spread = B.table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(
        F.avg("l_quantity").alias("mean"), F.var_pop("l_quantity").alias("variance")
    )
    mean, variance = F.col("mean"), F.col("variance")
    return spread.select(
        "id",
        F.round(C.acq_ucb(mean, variance), 6).alias("acquisition"),
        F.round(C.acq_ucb(mean, variance, explore=-1), 6).alias("exploring"),
    )


@query(
    "rule_alerts",
    f"""SELECT id, {ALERT_SUM_SQL} + (CASE WHEN n_chars < 200 OR n_chars > 5000 THEN 1 ELSE 0 END) AS alerts,
  CASE WHEN {ALERT_SUM_SQL} + (CASE WHEN n_chars < 200 OR n_chars > 5000 THEN 1 ELSE 0 END) > 0 THEN 1 ELSE 0 END AS alert
FROM (SELECT doc_id AS id, text AS key, n_chars FROM documents)""",
)
def alerts(spark, folder):
    texts = B.spread(B.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", "n_chars"))
    return rule_alerts(texts, ALERTS, ranges={"n_chars": (200, 5000)}).select("id", "alerts", "alert")


_OPENING = "[A-Za-z]+ [A-Za-z]+"


@query(
    "rule_catalogue",
    f"""WITH rules AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS name, regexp_extract(text, '{_OPENING}') AS pattern FROM benchmark
  WHERE regexp_matches(text, '{_OPENING}')),
hits AS (SELECT doc_id AS id, name FROM documents, rules WHERE regexp_matches(text, pattern))
SELECT doc_id AS id, count(name) AS alerts, CASE WHEN count(name) > 0 THEN 1 ELSE 0 END AS alert,
  coalesce(string_agg(name, ',' ORDER BY name), '') AS rules
FROM documents LEFT JOIN hits ON doc_id = id GROUP BY doc_id""",
)
def rule_catalogue(spark, folder):
    """Rules from a table: the opening words of each benchmark item."""
    opening = F.regexp_extract("text", _OPENING, 0)
    rows = B.table(spark, folder, "benchmark").select(F.col("item_id").cast("string").alias("name"), F.nullif(opening, F.lit("")).alias("pattern"))
    rules = read_rules(rows)
    texts = B.spread(B.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text"))
    found = rules_found(rule_alerts(texts, rules), rules)
    return found.select("id", F.col("alerts").cast("long").alias("alerts"), "alert", F.array_join("rules", ",").alias("rules"))
