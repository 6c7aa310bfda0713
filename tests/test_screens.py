import hashlib
import math

import pytest
from pyspark.sql import functions as F

from rowworth.functions import columns as C
from rowworth.operators import clean, flags, labels, metrics, removal, split, stats
from rowworth.sources import readers, writers


def screen(spark, rows):
    return spark.createDataFrame(rows, "id int, primary int, value double, confirmatory int")


def test_tie_is_inactive(spark):
    raw = spark.createDataFrame([("k", "Active", 1.0), ("k", "Inactive", 3.0)], "key string, outcome string, score double")
    got = clean.clean_screen(raw, "primary").select("key", "primary", "score").collect()
    assert got == [("k", 0, 2.0)]


def test_unmeasured_row_counts_in_thresholds_only(spark):
    rows = [(i, 1, float(i), i % 2) for i in range(10)] + [(10, 1, 100.0, None)]
    viewed = labels.label_views(screen(spark, rows))
    flagged = flags.percentile_flags(viewed)
    top = flagged.where(F.col("flag_hi") == 1).select("id", "is_eval").collect()
    assert {tuple(r) for r in top} == {(10, 0), (9, 1)}


def test_flat_values_are_in_both_tails(spark):
    flagged = flags.percentile_flags(labels.label_views(screen(spark, [(i, int(i % 3 != 0), 1.0, 1) for i in range(9)])))
    got = flagged.groupBy("primary").agg(F.sum("flag_hi"), F.sum("flag_lo"), F.count(F.lit(1))).collect()
    assert {tuple(r) for r in got} == {(1, 6, 6, 6), (0, 0, 0, 3)}


def test_flags_ignore_monotone_rescaling(spark):
    df = labels.label_views(screen(spark, [(i, 1, float(i * 7 % 50), i % 2) for i in range(50)]))
    plain = flags.percentile_flags(df).select("id", "flag_hi", "flag_lo")
    # a power keeps the order; the percentile is interpolated between the same two rows
    bent = flags.percentile_flags(df.withColumn("value", F.pow("value", F.lit(3)))).select("id", "flag_hi", "flag_lo")
    assert plain.exceptAll(bent).count() == 0


def test_nothing_flagged_gives_zero(spark):
    df = labels.label_views(screen(spark, [(1, 1, 0.0, 1), (2, 1, 1.0, 0)]))
    df = df.withColumn("flag_hi", F.lit(0)).withColumn("flag_lo", F.lit(0)).withColumn("g", F.lit("x"))
    assert metrics.precision_at_flag(df).first() == (0.0, 0.0)
    assert metrics.enrichment(df).first()[0] == 0.0
    assert metrics.diversity_rate(df, "g").first() == (0.0, 0.0)


@pytest.mark.parametrize("n,hits", [(10, 3), (50, 5)])
def test_bedroc_ends(spark, n, hits):
    best = spark.createDataFrame([(i, float(i), int(i < hits)) for i in range(n)], "id int, value double, y int")
    assert math.isclose(metrics.bedroc(best, "y").first()[0], 1.0, abs_tol=1e-9)
    assert math.isclose(metrics.bedroc(best, "y", descending=True).first()[0], 0.0, abs_tol=1e-9)


def test_bedroc_without_both_classes_is_null(spark):
    df = spark.createDataFrame([(i, float(i), 1) for i in range(4)], "id int, value double, y int")
    assert metrics.bedroc(df, "y").first()[0] is None


def test_average_precision_and_auroc_by_hand(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.1, 0)], "s double, y int")
    assert math.isclose(metrics.average_precision(df, "y", "s").first()[0], 0.5 * 1 + 0.5 * 2 / 4)
    # pairs won: 0.9 beats all three; 0.7 loses to 0.8, ties 0.7, beats 0.1
    assert math.isclose(metrics.auroc(df, "y", "s").first()[0], (3 + 0 + 0.5 + 1) / 6)


def test_one_class(spark):
    df = spark.createDataFrame([(0.9, 0), (0.1, 0)], "s double, y int")
    assert metrics.average_precision(df, "y", "s").first()[0] is None
    weight = C.class_weight(F.col("y"), F.lit(0), F.lit(2))
    assert {r[0] for r in df.select(weight).collect()} == {1.0}


def test_removing_more_than_there_is(spark):
    df = spark.createDataFrame([(i, int(i < 2), float(i)) for i in range(6)], "id int, primary int, value double")
    left = removal.remove_k(df, 100).select("id").collect()
    assert {r[0] for r in left} == {0, 1}


def test_removal_sets_are_nested(spark):
    df = spark.createDataFrame([(i, int(i % 5 == 0), float(i * 13 % 40)) for i in range(40)], "id int, primary int, value double")
    for mode in ("low", "high", "random"):
        kept = [
            {r[0] for r in removal.remove_k(df, k, mode=mode, seed=1).select("id").collect()} for k in (3, 10, 20)
        ]
        assert kept[0] > kept[1] > kept[2]


def test_corruption_curve_beats_random_when_values_know(spark):
    rows = [(i, float(i % 10 == 0) * -1 + i / 1000, int(i % 10 == 0)) for i in range(200)]
    curve = removal.corruption_curve(spark.createDataFrame(rows, "id int, value double, noisy int")).collect()
    assert all(r["found"] >= r["random"] - 1e-9 for r in curve)
    assert math.isclose(next(r for r in curve if r["bin"] == 2)["found"], 1.0)


def test_stratified_split_keeps_unlabelled_in_train(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 2) for i in range(60)], "id int, y int")
    got = split.stratified_split(df, "y", 0.25).groupBy("y", "split").count().collect()
    assert {tuple(r) for r in got} == {(None, "train", 20), (0, "train", 15), (0, "val", 5), (1, "train", 15), (1, "val", 5)}


def test_undersampling_takes_all_of_the_rare(spark):
    df = spark.createDataFrame([(i, int(i < 10)) for i in range(200)], "id int, y int")
    got = split.undersample_to_ratio(df, "y", 0.2).groupBy("y").count().collect()
    assert {tuple(r) for r in got} == {(1, 10), (0, 50)}


def test_clean_multi_assay_takes_commonest_split(spark):
    rows = [("k", "a", 1.0, "train"), ("k", "a", 0.0, "train"), ("k", "a", 1.0, "test"), ("", "a", 1.0, "test")]
    df = spark.createDataFrame(rows, "key string, aid string, activity double, split string")
    got = clean.clean_multi_assay(df).collect()
    assert len(got) == 1 and got[0]["split"] == "train" and math.isclose(got[0]["activity"], 2 / 3)


def test_wilcoxon_against_hand_values(spark):
    # three positive differences: p = 1/8; one of size 1 against: W+ = 5, p = 2/8
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", -1.0), ("b", 2.0), ("b", 3.0), ("z", 0.0), ("z", 0.0)],
        "g string, diff double",
    )
    got = {r["g"]: r for r in stats.wilcoxon_signed_rank(df, ["g"]).collect()}
    assert math.isclose(got["a"]["p"], 1 / 8) and math.isclose(got["b"]["p"], 2 / 8)
    assert got["z"]["p"] == 1.0 and got["z"]["n"] == 0
    exact = stats.wilcoxon_signed_rank(df.where("g = 'b'")).first()
    assert math.isclose(exact["p"], 2 / 8)


def test_wilcoxon_normal_is_close_to_exact(spark):
    df = spark.createDataFrame([(float((-1) ** (i % 3) * (i + 1)),) for i in range(12)], "diff double")
    exact = stats.wilcoxon_signed_rank(df).first()["p"]
    normal = stats.wilcoxon_signed_rank(df, exact_up_to=0).first()["p"]
    assert abs(exact - normal) < 0.03


def test_registry_keeps_known_names(spark):
    registry = spark.createDataFrame([("a", "1", "2")], "codename string, primary_aid string, confirmatory_aid string")
    grown = readers.registry_add(readers.registry_add(registry, "b", "3", "4"), "a", "9", "9")
    assert {tuple(r) for r in grown.collect()} == {("a", "1", "2"), ("b", "3", "4")}


def test_prepared_splits_are_pruned_by_partition(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"k{i}", 1, float(i), i % 2) for i in range(4)], "id int, key string, primary int, score double, confirmatory int")
    for name in ("x", "y"):
        writers.write_splits(rows.where("id > 1"), rows.where("id <= 1"), str(tmp_path / "d"), name)
    train, val = readers.read_prepared(spark, str(tmp_path / "d"), "x")
    assert {r["id"] for r in train.collect()} == {2, 3} and {r["label"] for r in val.collect()} == {0, 1}
    assert "PartitionFilters: [isnotnull(dataset" in train._jdf.queryExecution().toString()


def test_projections_accept_a_stream(spark, tmp_path):
    texts = spark.createDataFrame([(1, "CC(=O)Cl 123456"), (2, "c1ccccc1")], "id int, text string")
    texts.write.parquet(str(tmp_path / "t"))
    from rowworth.operators.rules import rule_alerts

    stream = spark.readStream.schema("id int, text string").parquet(str(tmp_path / "t"))
    scored = rule_alerts(stream, [("digits", "[0-9]{6,}")]).select(
        "id", "alerts", F.size(C.tokenize(F.col("text"))).alias("n")
    )
    assert scored.isStreaming
    run = scored.writeStream.format("memory").queryName("alerts").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert {tuple(r) for r in spark.sql("SELECT id, alerts FROM alerts").collect()} == {(1, 1), (2, 0)}


def test_fingerprint_of_repeats_is_small(spark):
    df = spark.createDataFrame([(["a"] * 50,), (["a"] * 3,), ([],)], "t array<string>")
    many, few, none = [r[0] for r in df.select(C.hashed_fingerprint(F.col("t"))).collect()]
    assert many == few and 0 < len(few) <= 3 and none == []


def test_fingerprints_of_runs_with_nulls(spark):
    rows = [["a", "b", None, "a", "b", "c"], ["a", None], [None], ["x"], [], None]

    def want(tokens, radius):
        tokens = tokens or []
        runs = [tokens[i : i + w] for w in range(1, radius + 2) for i in range(len(tokens) - w + 1)]
        grams = {" ".join(t for t in run if t is not None) for run in runs}
        return sorted({int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % 1024 for g in grams})

    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, t array<string>")
    for radius in (0, 2):
        bits = df.select("id", C.hashed_fingerprint(F.col("t"), radius=radius).alias("bits"))
        assert bits.schema["bits"].dataType.simpleString() == "array<bigint>"
        assert [r.bits for r in bits.orderBy("id").collect()] == [want(t, radius) for t in rows]
    # neither a comparator called for every step of a sort nor a slice for every run
    plan = bits._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "slice(" not in plan and "array_sort(" not in plan



def test_removing_from_all_labels(spark):
    df = spark.createDataFrame([(i, int(i < 2), float(i)) for i in range(6)], "id int, primary int, value double")
    left = removal.remove_k(df, 3, label=None).select("id").collect()
    assert {r[0] for r in left} == {3, 4, 5}


def test_runs_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "report")
    first = spark.createDataFrame([("d", "m", 0, "x", 1.0), ("d", "n", 0, "x", 2.0)], "dataset string, method string, replicate int, metric string, value double")
    second = first.limit(1).withColumn("value", F.lit(5.0))
    writers.write_report(first, path, run="007")
    writers.write_report(first, path, run="other")
    writers.write_report(first, path, run="007")
    assert sorted(r["value"] for r in readers.read_runs(spark, path).collect()) == [1.0, 1.0, 2.0, 2.0]
    writers.write_report(second, path, run="007")
    # files without a commit, as an attempt that was lost leaves them
    first.withColumn("run", F.lit("007")).withColumn("attempt", F.lit("lost")).write.mode("append").partitionBy("run", "attempt").parquet(f"{path}/rows")
    found = readers.read_runs(spark, path).collect()
    assert sorted((r["run"], r["value"]) for r in found) == [("007", 5.0), ("other", 1.0), ("other", 2.0)]


def test_diversity_by_sketch_is_near(spark):
    df = spark.range(20_000).select((F.col("id") % 7000).alias("g"), F.lit(1).alias("flag_lo"), (F.col("id") < 100).cast("int").alias("flag_hi"))
    exact, near = metrics.diversity_rate(df, "g").first(), metrics.diversity_rate(df, "g", error=0.02).first()
    assert all(abs(a - b) <= 0.1 * a for a, b in zip(exact, near)) and exact[0] == 35.0


def test_own_validation_set_or_split_on_the_way_in(spark):
    rows = spark.createDataFrame([(i, f"k{i % 40}", i % 2, float(i), i % 2) for i in range(50)], "n long, name string, hit int, s double, sure int")
    own = rows.where("n < 5")
    train, val = readers.from_columns_split(rows, "n", "name", "hit", own, score="s", confirmatory="sure")
    assert {r["key"] for r in val.collect()} == {f"k{i}" for i in range(5)}
    assert not {r["key"] for r in train.collect()} & {f"k{i}" for i in range(5)} and train.count() == 40
    train, val = readers.from_columns_split(rows, "n", "name", "hit", share=0.2, score="s", confirmatory="sure")
    assert sorted(r["id"] for r in val.collect()) == list(range(40, 50)) and train.count() == 40


def test_plain_rules_need_no_regex(spark):
    from rowworth.operators.rules import rule_alerts, rules_found

    rules = [("a", "is a"), ("b", "1[23]"), ("c", "No")]
    df = spark.createDataFrame([(1, "This art 13"), (2, "noé No"), (3, None)], "id int, text string")
    found = rules_found(rule_alerts(df, rules), rules)
    assert {r.id: (r.alerts, list(r.rules)) for r in found.collect()} == {1: (2, ["a", "b"]), 2: (1, ["c"]), 3: (0, [])}
    assert "RLIKE" not in rule_alerts(df, rules[:1])._jdf.queryExecution().optimizedPlan().toString()


def test_valued_screens_are_written_without_texts(spark, monkeypatch):
    from rowworth.plans import false_positives as plan

    written = []
    monkeypatch.setattr(plan, "settle", lambda df: (written.append(df.columns), df)[1])
    rows = [(i, f"k{i % 3}", 1, float(i), i % 2, "long text") for i in range(20)]
    screen = spark.createDataFrame(rows, "id long, key string, primary int, score double, confirmatory int, text string")
    metrics, _ = plan.false_positives(screen, lambda df, seed: df.withColumn("value", F.col("score")), "d", "m", 2)
    assert metrics.count() > 0 and written and not any("text" in columns for columns in written)
