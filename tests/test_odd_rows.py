"""Rows and files that are not as they should be."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowworth.functions.blocks import matrix
from rowworth.operators.metrics import rmspe
from rowworth.operators.pairs import similarity
from rowworth.operators.removal import corruption_curve
from rowworth.operators.stumps import fit_stumps, value_mvs
from rowworth.operators.surrogate import _landmarks
from rowworth.plans.active_learning import actives_found, active_learning_random
from rowworth.session import broadcast_if_small
from rowworth.sources import readers, writers


def test_csv_columns_are_matched_by_name(spark, tmp_path):
    path = str(tmp_path / "raw.csv")
    raw = readers.RAW_COLUMNS
    rows = [(17, "45", "CCO", "Active", "x"), (18, None, 'C,"N', "Inactive", "y"), (19, "none", "C", "Active", "z")]
    names = ["PUBCHEM_CID", raw["score"], raw["key"], raw["outcome"], "OTHER"]
    spark.createDataFrame(rows, names).write.option("header", True).option("escape", '"').csv(path)
    found = readers.read_assay(spark, path).orderBy("key").collect()
    assert [tuple(r) for r in found] == [("C", "Active", None), ('C,"N', "Inactive", None), ("CCO", "Active", 45.0)]


def test_a_second_write_replaces(spark, tmp_path):
    rows = spark.range(10).select("id", F.lit(1).alias("primary"), F.lit(0).alias("confirmatory"))
    for name in ("a", "b", "a"):
        writers.write_splits(rows, rows, str(tmp_path / "s"), name)
        writers.write_features(rows, str(tmp_path / "f"), name)
    assert [df.count() for df in readers.read_prepared(spark, str(tmp_path / "s"), "a")] == [10, 10]
    assert spark.read.parquet(str(tmp_path / "f")).count() == 20


def test_rows_without_features_stay(spark):
    rows = spark.range(3).withColumn("key", F.lit("k"))
    features = spark.createDataFrame([(0, [1.0])], "id long, features array<double>")
    found = {r.id: r.features for r in readers.read_features(rows, features).collect()}
    assert found == {0: [1.0], 1: None, 2: None}


@pytest.mark.parametrize("rows", [[[1.0, 2.0, 3.0], [4.0]], [[1.0, 2.0], None]])
def test_uneven_arrays_are_refused(rows):
    with pytest.raises(ValueError):
        matrix(pa.array(rows, pa.list_(pa.float64())))


def test_even_arrays(spark):
    assert matrix(pa.array([[1.0, 2.0], [3.0, 4.0]])).tolist() == [[1.0, 2.0], [3.0, 4.0]]
    assert matrix(pa.array([], pa.list_(pa.float64()))).shape == (0, 0)


def test_nothing_to_divide_by(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "t double, p double")
    assert rmspe(df, "t", "p").first()[0] == 0.5
    clean = spark.range(20).select("id", F.col("id").cast("double").alias("value"), F.lit(0).alias("noisy"))
    assert {(r.found, r.optimal) for r in corruption_curve(clean).collect()} == {(None, None)}
    train = spark.range(30).select("id", F.lit(0).alias("y"))
    assert {r.share for r in active_learning_random(train).collect()} == {None}
    placed = train.select("id", F.lit(0).alias("round"))
    assert actives_found(train, placed).first().share is None
    # fewer rows than rounds can take a share of: one row each
    some = spark.range(30).select("id", F.lit(1).alias("y"))
    assert [r.n_sampled for r in active_learning_random(some).orderBy("step").collect()] == [1, 2, 3, 4, 5, 6, 7]


def test_null_labels_are_kept(spark):
    rng = np.random.RandomState(0)
    rows = [(i, float(rng.rand()), None if i % 5 == 0 else i % 2) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, x double, y int")
    found = value_mvs(df, fit_stumps(df, ["x"], rounds=5))
    assert found.count() == 50 and found.where("value IS NULL").count() == 10
    with pytest.raises(ValueError):
        fit_stumps(df.where("y = 1"), ["x"])


def test_all_landmarks_asked_for(spark):
    pool = spark.range(600).select("id", F.array(F.col("id").cast("double")).alias("features"))
    assert len(_landmarks(pool, "features", "id", 600, 0)) == 600


def test_distance_of_large_numbers():
    rows = np.random.RandomState(1).rand(40, 16) + 1e5
    apart = similarity(rows, rows, "distance")
    assert (np.diag(apart) == 0).all()
    assert np.allclose(apart, ((rows[:, None] - rows[None]) ** 2).sum(axis=2), atol=1e-6)


def test_long_nested_rows_are_not_broadcast(spark):
    df = spark.range(50).select("id", F.array(F.struct(F.repeat(F.lit("x"), 1000).alias("s"))).alias("a"))
    nested = broadcast_if_small(df, 20_000)
    assert "broadcast" not in nested._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" in broadcast_if_small(df, 200_000)._jdf.queryExecution().logical().toString().lower()
