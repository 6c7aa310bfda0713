"""Corpus preparation in stages: each works on all rows that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowworth.llm import decontaminate, near_text, packing, quality, secrets
from rowworth.llm.text import lean_batches
from rowworth.session import broadcast_if_small, scratch_folder, settle, ship_package

#: SQL has no n-gram models, sketches or tokenizers: tests hold each stage against a brute-force version
ORACLE_SQL = None


def _ready(spark: SparkSession) -> None:
    ship_package(spark)
    lean_batches(spark)


def _version_name(docs: DataFrame) -> str:
    """A name for a column more, none of the table's own."""
    taken, name = {c.lower() for c in docs.columns}, "_version"
    while name in taken:
        name += "_"
    return name


def _versioned(docs: DataFrame) -> DataFrame:
    """A doc_id may be missing or repeated: with the hash of its text it names a row, or equal ones."""
    return docs.withColumn(_version_name(docs), F.xxhash64("text"))


def _matching(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Rows of `docs` of the same doc_id (missing or not) and text as one of `rows`, or (left_anti) the others."""
    version = _version_name(docs)
    there = broadcast_if_small(rows.select("doc_id", F.col(version).alias("version")).distinct()).alias("there")
    here = _versioned(docs).alias("here")
    same = F.col("here.doc_id").eqNullSafe(F.col("there.doc_id")) & F.col(f"here.{version}").eqNullSafe(F.col("there.version"))
    return here.join(there, same, how).select(*[F.col(f"here.`{c}`") for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    _ready(spark)
    found = quality.importance_resample(_versioned(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=(_version_name(docs),))
    return _matching(docs, found.where("NOT kept"), "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, similarity of 0.8. Of rows with equal id and text one stays."""
    _ready(spark)
    found = near_text.near_duplicates(_versioned(docs), size=5, percent=80, carry=(_version_name(docs),))
    kept = _matching(docs, found.where("NOT kept"), "left_anti")
    # whole rows are dealt out only where some are repeated
    repeated = settle(found.where("kept").groupBy("doc_id", _version_name(docs)).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    if repeated.isEmpty():
        return kept
    return _matching(kept, repeated, "left_anti").unionByName(_matching(kept, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    _ready(spark)
    found = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), versions=True)
    return _matching(docs, found.withColumnRenamed("version", _version_name(docs)), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced: live-looking ones and copied examples by marks of their own."""
    _ready(spark)
    version = _version_name(docs)
    marked = _versioned(docs)
    found = secrets.find_secrets(marked, "source", F.concat_ws("/", marked["source"], marked["lang"]), carry=(version,))
    # equal rows have equal spans
    spans = broadcast_if_small(found.where(F.size("spans") > 0).dropDuplicates(["doc_id", version]))
    marked = marked.alias("d").join(
        spans.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & F.col(f"d.{version}").eqNullSafe(F.col(f"s.{version}")), "left"
    )
    hit = F.col("s.spans").isNotNull()
    text = F.when(hit, secrets.redact(F.col("d.text"), F.col("s.spans"))).otherwise(F.col("d.text"))
    columns = []
    for name in docs.columns:
        column = F.col(f"d.`{name}`")
        if name == "text":
            column = text
        elif name == "n_chars":
            column = F.when(hit, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(column)
        columns.append(column.alias(name))
    return marked.select(*columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of all documents."""
    _ready(spark)
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("packing", pack_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written and reread for the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = scratch_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
