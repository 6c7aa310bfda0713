import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rowworth.operators import ordering
from rowworth.operators.ordering import exact_percentiles, rank_rows, running_totals


def skewed(spark, n=3000):
    """One group holds most rows, and one value a third of them."""
    rng = np.random.default_rng(0)
    values = rng.normal(size=n).round(2)
    values[: n // 3] = 0.5
    groups = np.where(rng.random(n) < 0.8, "hot", rng.choice(["a", "b", "c"], n))
    pdf = pd.DataFrame({"id": np.arange(n), "g": groups, "v": values, "w": rng.integers(0, 5, n)})
    pdf = pdf.sample(frac=1, random_state=1)
    pdf.loc[pdf.g == "c", "g"] = None
    return pdf, spark.createDataFrame(pdf).repartition(8)


def test_rank_with_hot_value(spark):
    pdf, df = skewed(spark)
    got = rank_rows(df, ["v", "id"]).select("id", "rank").toPandas().set_index("id")["rank"]
    want = pdf.sort_values(["v", "id"]).reset_index(drop=True)
    assert got.loc[want["id"]].tolist() == list(range(1, len(pdf) + 1))


def test_rank_spreads_a_hot_group(spark):
    pdf, df = skewed(spark)
    ranked = rank_rows(df, [F.col("v").desc(), "id"], ["g"])
    got = ranked.select("id", "rank").toPandas().set_index("id")["rank"]
    for _, part in pdf.groupby("g", dropna=False):
        want = part.sort_values(["v", "id"], ascending=[False, True])["id"]
        assert got.loc[want].tolist() == list(range(1, len(part) + 1))


def test_running_totals_by_group(spark):
    pdf, df = skewed(spark)
    got = running_totals(df, ["v", "id"], {"sum_w": "w"}, ["g"]).toPandas().set_index("id")["sum_w"]
    for _, part in pdf.groupby("g", dropna=False):
        part = part.sort_values(["v", "id"])
        assert got.loc[part["id"]].tolist() == part["w"].cumsum().tolist()


def test_percentiles_equal_numpy(spark):
    pdf, df = skewed(spark)
    probs = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "top": 1.0}
    got = exact_percentiles(df, "v", probs, ["g"]).toPandas()
    for _, row in got.iterrows():
        part = pdf[pdf.g.isna()] if row["g"] is None or row["g"] != row["g"] else pdf[pdf.g == row["g"]]
        for name, p in probs.items():
            assert np.isclose(row[name], np.percentile(part["v"], 100 * p))
    assert len(got) == 4


def test_percentiles_of_a_bracketed_group(spark):
    """Enough rows for the sketch, with a third of them equal."""
    rng = np.random.default_rng(3)
    values = rng.normal(size=30_000)
    values[:10_000] = 1.0
    df = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(8)
    got = exact_percentiles(df, "v", {"a": 0.1, "b": 0.5, "c": 0.9, "d": 0.77}).first()
    assert np.allclose(tuple(got), np.percentile(values, [10, 50, 90, 77]))


def test_percentile_of_one_row(spark):
    df = spark.createDataFrame([(3.5,)], "v double")
    assert exact_percentiles(df, "v", {"a": 0.1, "b": 0.9}).first() == (3.5, 3.5)


def test_rank_is_the_same_again(spark):
    _, df = skewed(spark)
    assert rank_rows(df, ["v", "id"]).exceptAll(rank_rows(df, ["v", "id"])).count() == 0


def test_missed_brackets_are_widened(spark, monkeypatch):
    # a margin far below the sketch's error: places lie outside until it has grown
    monkeypatch.setattr(ordering, "_ACCURACY", 20)
    monkeypatch.setattr(ordering, "_MARGIN", 0.0005)
    rng = np.random.default_rng(8)
    values = rng.normal(size=20_000)
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(4)
    got = ordering.exact_percentiles(df, "v", {"a": 0.1, "b": 0.5, "c": 0.93}).first()
    assert np.allclose(list(got), np.quantile(values, [0.1, 0.5, 0.93]))
