"""Every stage of the pipeline against the operator it calls, on its own input."""

import re

import corpus_pipeline
from pyspark.sql import functions as F
from rowworth.llm import decontaminate, near_text, quality
from rowworth.session import scratch_folder

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_folder(spark)
        stage(spark, docs, SMALL).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == columns
        if name == "quality":
            found = quality.importance_resample(before, spark.read.parquet(f"{SMALL}/labels.parquet")).where("kept")
        elif name == "near_dedup":
            found = near_text.near_duplicates(before, 5, 80).where("kept")
        elif name == "decontamination":
            leaks = {r.doc_id for r in decontaminate.find_leaks(before, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
            found = before.where(~before.doc_id.isin(list(leaks)))
        else:
            found = before
        assert kept[name] == {r.doc_id for r in found.select("doc_id").collect()}
        if name == "secrets":
            for r in docs.collect():
                assert r.n_chars == len(r.text) and not re.search(r"AKIA[A-Z0-9]{14}|[0-9a-f]{16}", r.text)
    assert sum(r.length for r in docs.collect()) > 0
    assert corpus_pipeline.run(spark, SMALL).count() == docs.count()


def test_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words here to keep", "en", None, 23), (3, "password=abcdefghijkl12 x", None, "s", 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for given in (docs, docs.limit(0)):
            found = stage(spark, given, SMALL)
            assert found.columns == docs.columns
            assert found.count() == given.count()
    texts = {r.doc_id: r.text for r in corpus_pipeline.redact_secrets(spark, docs, SMALL).collect()}
    assert texts[3] == "[secret] x" and texts[1] is None


def test_stages_drop_rows_with_repeated_or_missing_ids(spark):
    names = "doc_id long, text string, lang string, source string, n_chars long"

    def left(stage, rows):
        docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], names)
        return sorted(((r.doc_id, r.text) for r in stage(spark, docs, SMALL).collect()), key=repr)

    leak = max((r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()), key=len)
    clean = " ".join(f"clean{k}" for k in range(30))
    assert left(corpus_pipeline.drop_leaks, [(None, leak), (7, leak), (None, clean), (7, clean), (8, None)]) == [(7, clean), (8, None), (None, clean)]
    other = " ".join(f"other{k}" for k in range(30))
    lone = other.replace("other", "lone")
    rows = [(5, clean), (5, clean), (6, clean), (None, other), (None, lone), (None, lone), (4, None), (9, other), (9, clean)]
    assert left(corpus_pipeline.drop_near_copies, rows) == [(4, None), (5, clean), (9, other), (None, lone)]
    # the same stage on a table half of whose ids are missing, held against what the operator says of each row
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    found = quality.importance_resample(docs.withColumn("v", F.xxhash64("text")), spark.read.parquet(f"{SMALL}/labels.parquet"), carry=("v",))
    assert found.where("NOT kept AND doc_id IS NULL").count() > 0
    assert corpus_pipeline.keep_quality(spark, docs, SMALL).count() == found.where("kept").count()


def test_columns_of_the_table_stay(spark):
    rows = [(1, "password=abcdefghijkl12 and more", "en", "s", 31, 7, "x"), (2, "words without any secret", "en", "s", 24, 8, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _version long, version string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, SMALL)
        assert found.columns == docs.columns
        assert {(r.doc_id, r._version, r.version) for r in found.collect()} == {(1, 7, "x"), (2, 8, "y")}
