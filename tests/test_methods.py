import pytest
from pyspark.sql import functions as F

from rowworth.operators.rules import read_rules, rule_alerts, rules_found
from rowworth.plans import methods


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, i % 2, [float(i % 2) + (i % 7) / 10, float(i % 5)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, y int, features array<double>")
    return df.where("id < 45"), df.where("id >= 45")


@pytest.mark.parametrize("name", sorted(set(methods.VALUE_METHODS) - {"reinforce"}))
def test_every_named_method_values_every_row(vectors, name):
    train, val = vectors
    options = {"rounds": 2, "depth": 2} if name in ("mvs", "leaf_self", "leaf_test") else {}
    found = methods.values_by_name(name, train, val, **options).collect()
    assert sorted(r.id for r in found) == list(range(45))
    assert all(r.value is not None for r in found)


def test_unknown_names_are_refused(vectors):
    with pytest.raises(ValueError, match="named"):
        methods.values_by_name("astrology", *vectors)
    with pytest.raises(ValueError, match="named"):
        methods.pool_valuer("astrology", vectors[1])


def test_a_pool_keeps_its_columns(vectors):
    train, val = vectors
    valued = methods.pool_valuer("tracin_test", val, epochs=2)(train)
    assert {"id", "y", "features", "value"} <= set(valued.columns)
    assert valued.count() == 45


def test_random_values_follow_the_seed(vectors):
    first, again, other = (methods.values_by_name("random", *vectors, seed=s).orderBy("id").collect() for s in (1, 1, 2))
    assert first == again != other


def test_rules_from_a_table(spark):
    rows = [("b", "x+"), ("a", "y"), ("b", "x+"), (None, "z"), ("c", None)]
    catalogue = spark.createDataFrame(rows, "name string, pattern string")
    rules = read_rules(catalogue)
    assert rules == [("", "z"), ("a", "y"), ("b", "x+")]
    assert read_rules(catalogue.limit(0)) == []
    with pytest.raises(ValueError, match="more than 2"):
        read_rules(catalogue, most=2)
    texts = spark.createDataFrame([(1, "xxy"), (2, "none"), (3, None), (4, "")], "id long, text string")
    found = {r.id: (r.alerts, r.alert, r.rules) for r in rules_found(rule_alerts(texts, rules), rules).collect()}
    assert found == {1: (2, 1, ["a", "b"]), 2: (0, 0, []), 3: (0, 0, []), 4: (0, 0, [])}
    assert [r.rules for r in rules_found(texts, []).collect()] == [[]] * 4


def test_large_catalogues_are_no_deep_expression(spark):
    texts = spark.range(3).select("id", F.concat(F.lit("w"), F.col("id")).alias("text"))
    rules = [(str(i), f"^w{i}$") for i in range(2000)]
    assert [r.alerts for r in rule_alerts(texts, rules).collect()] == [1, 1, 1]


def test_named_shapley_reads_training_rows_a_few_times(vectors, monkeypatch):
    from rowworth.operators import knn_shapley

    train, val = vectors
    n_val, wanted = val.count(), {r.id: r.value for r in methods.values_by_name("shapley", train, val, k=3, cell_rows=20).collect()}
    settled = []

    def settle(df):
        settled.append(df.checkpoint())
        return settled[-1]

    monkeypatch.setattr(knn_shapley, "settle", settle)
    # one order at a time
    monkeypatch.setattr(knn_shapley, "_HELD", 1)
    rows = methods.compare_values(train, val.coalesce(1), ["random", "shapley"], options={"shapley": {"k": 3}}).collect()
    found = {r.id: r.value for r in rows if r.method == "shapley"}
    assert found.keys() == wanted.keys() and max(abs(found[i] - wanted[i]) for i in wanted) < 1e-12
    blocks = [df for df in settled if "rows" in df.columns and df.selectExpr("sum(octet_length(rows) div 8)").first()[0] == n_val]
    assert len(blocks) == 1 and blocks[0].count() < n_val / 4
