"""Queries over the given tables, one for each operator of this subpackage."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowworth.llm import (
    counterparts, decontaminate, html_text, near_text, near_vectors, packing, prefix_trie, quality, secrets, spelling, suffix_family, token_store, toxicity, warc,
)
from rowworth.llm.text import lean_batches
from rowworth.session import scratch_folder, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            lean_batches(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op3_minhash_near_dedup", sql=r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s
  FROM words),
alike AS (SELECT md5(array_to_string(list_sort(s), '|')) AS h, min(doc_id) AS node, any_value(s) AS s FROM sets WHERE len(s) > 0 GROUP BY 1),
items AS (SELECT node, unnest(s) AS x FROM alike),
pairs AS (
  SELECT a.node AS a, b.node AS b, count(*) AS same
  FROM items a JOIN items b ON a.x = b.x AND a.node < b.node GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN alike p ON p.node = a JOIN alike q ON q.node = b
  WHERE 100 * same >= 80 * (len(p.s) + len(q.s) - same)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT node, node AS top FROM alike UNION SELECT b.b, r.top FROM reach r JOIN both_ways b ON b.a = r.node WHERE r.top < b.b),
tops AS (SELECT node, min(top) AS top FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(t.top, d.doc_id) AS component_id,
       d.doc_id = coalesce(t.top, d.doc_id) AS kept
FROM sets d LEFT JOIN alike k ON len(d.s) > 0 AND md5(array_to_string(list_sort(d.s), '|')) = k.h LEFT JOIN tops t ON t.node = k.node
""")
def minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_text.near_duplicates(table(spark, folder, "documents"), size=4, percent=80)


@query("op6_nnls_packing")
def packing_nnls(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query("op8_perfect_hash_tokens")
def tokens_perfect_hash(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    target = scratch_folder(spark)
    token_store.write_tokens(docs, target)
    return token_store.token_digests(spark, target, docs.select(docs["doc_id"].alias("key")))


@query("op5_kmeans_near_vectors", sql=counterparts.VECTORS)
def vectors_kmeans(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, folder, "embeddings"), threshold=0.93)


@query("op10_warc_archive", sql=counterparts.ARCHIVE)
def warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    target = scratch_folder(spark)
    warc.write_archives(table(spark, folder, "pages"), target)
    found = warc.read_archives(spark, target, with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op1_simhash_decontamination")
def decontamination_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op4_secret_ownership", sql=counterparts.secret_spans(secrets.ASSIGN_HEAD, [
    ("assign", secrets.ASSIGN, "regexp_replace(m, HEAD, '')", "length(v) >= 12"),
    ("access", secrets.ACCESS, "m", "length(m) >= 18"),
    ("hex", secrets.HEX, "m", "true"),
    ("opaque", secrets.OPAQUE, "m", "regexp_matches(m, '^(-----|gh[pousr]_|eyJ)') OR (regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]'))"),
]))
def secret_ownership(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = secrets.find_secrets(docs, "source", F.concat_ws("/", docs["source"], docs["lang"]))
    return secrets.digest_columns(found)


@query("op7_importance_resampling")
def quality_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return quality.importance_resample(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op2_weak_toxicity")
def toxicity_weak(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op9_lstm_html_text")
def html_lstm(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_text(table(spark, folder, "pages"))


@query("op12_spelling_fm_index", sql=counterparts.SPELLING)
def spelling_fm_index(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"))


@query("op13_double_array_trie", sql=counterparts.TRIE)
def trie_double_array(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, folder, "conversations"))


@query("op11_suffix_array_dedup", sql=counterparts.REPEATS)
def suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_family.remove_repeats(table(spark, folder, "documents")).drop("spans")
