import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowworth import registry
from rowworth.operators import logistic as L
from rowworth.operators import boosting, ordering, pairs, removal, stumps, surrogate
from rowworth.operators.bit_pairs import fingerprint_classes, similar_pairs
from rowworth.operators.features import encode_tokens, vocabulary
from rowworth.operators.knn_shapley import value_knn_shapley
from rowworth.operators.many_logistic import fit_many
from rowworth.operators.reinforce import value_reinforce
from rowworth.plans import active_learning as A
from rowworth.plans import curves as C
from rowworth.plans import undersampling as U
from rowworth.session import settle

registry.load()
SMALL = "/root/testdata/sf0.001"
SCHEMA = "id long, y int, features array<double>"


def points(n, seed, flip=0.0, width=3):
    """Two classes apart along the first axis; a share of the labels is wrong."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(n, width))
    x[:, 0] += 2.0 * (2 * y - 1)
    wrong = rng.random(n) < flip
    return [(i, int(y[i] ^ wrong[i]), x[i].tolist()) for i in range(n)], wrong


def as_frame(spark, rows, start=0):
    return spark.createDataFrame([(i + start, y, x) for i, y, x in rows], SCHEMA)


def brute_shapley(train, val, k):
    """Average over all orders of the marginal gain in the share of right votes among the k nearest."""

    def utility(members, v):
        near = sorted(members, key=lambda t: (sum((a - b) ** 2 for a, b in zip(t[2], v[2])), t[0]))[:k]
        return sum(t[1] == v[1] for t in near) / k

    n, out = len(train), {}
    for target in train:
        others = [t for t in train if t[0] != target[0]]
        total = 0.0
        for size in range(n):
            weight = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
            for group in itertools.combinations(others, size):
                for v in val:
                    total += weight * (utility([*group, target], v) - utility(group, v))
        out[target[0]] = total / len(val)
    return out


@pytest.mark.parametrize("n,k", [(3, 1), (3, 5), (7, 3), (8, 5)])
def test_shapley_equals_brute_force(spark, n, k):
    train, val = points(n, 1)[0], points(3, 2)[0]
    got = value_knn_shapley(as_frame(spark, train), as_frame(spark, val, 100), k=k).collect()
    want = brute_shapley(train, val, k)
    assert len(got) == n
    for row in got:
        assert math.isclose(row["value"], want[row["id"]], abs_tol=1e-9)


def test_nearest_rows_are_within_epsilon(spark):
    train, val = as_frame(spark, points(120, 3, 0.2)[0]).repartition(4), as_frame(spark, points(20, 4)[0], 1000)
    exact = {r["id"]: r["value"] for r in value_knn_shapley(train, val, k=3).collect()}
    near = {r["id"]: r["value"] for r in value_knn_shapley(train, val, k=3, epsilon=0.1).collect()}
    assert exact.keys() == near.keys()
    assert max(abs(exact[i] - near[i]) for i in exact) <= 0.1
    # with every row in reach nothing is cut off
    whole = value_knn_shapley(train, val, k=3, epsilon=1 / 200).collect()
    assert max(abs(exact[r["id"]] - r["value"]) for r in whole) < 1e-9


def test_small_blocks_change_nothing(spark, monkeypatch):
    left, right = as_frame(spark, points(20, 1)[0]), as_frame(spark, points(11, 2)[0], 50)
    whole = pairs.pair_similarity(left, right).collect()
    blocks = list(pairs.reference_blocks(right, block_bytes=4 * 8 * 3))
    assert [len(b.ids) for b in blocks] == [4, 4, 3]
    monkeypatch.setattr(pairs.reference_blocks, "__defaults__", (None, "features", "id", 4 * 8 * 3))
    cut = pairs.pair_similarity(left, right).collect()
    assert len(whole) == 220 and {(r[0], r[1], round(r[2], 9)) for r in whole} == {(r[0], r[1], round(r[2], 9)) for r in cut}


def test_tracing_equals_pairwise_mean(spark):
    train, val = points(30, 5)[0], points(9, 6)[0]
    a, b = as_frame(spark, train), as_frame(spark, val, 100)
    checkpoints = L.fit_checkpoints(a, epochs=3, rate=0.5)

    def gradients(rows, w):
        x = np.array([r[2] + [1.0] for r in rows])
        p = 1 / (1 + np.exp(-x @ w))
        return (p - np.array([r[1] for r in rows]))[:, None] * x

    want_test = -sum((gradients(train, w) @ gradients(val, w).T).mean(axis=1) for w in checkpoints)
    want_self = -sum((gradients(train, w) ** 2).sum(axis=1) for w in checkpoints)
    got_test = L.value_tracin_test(a, b, checkpoints).orderBy("id").toPandas()["value"]
    got_self = L.value_tracin_self(a, checkpoints).orderBy("id").toPandas()["value"]
    assert np.allclose(got_test, want_test) and np.allclose(got_self, want_self)
    assert (got_self <= 0).all()


def numeric(spark, rows):
    return spark.createDataFrame([(i, y, *x) for i, y, x in rows], "id long, y int, a double, b double, c double")


def test_leaf_influence_is_the_derivative(spark):
    """Against finite differences of one tree's leaf values."""
    rows = points(60, 7)[0]
    df = numeric(spark, rows)
    model = stumps.fit_stumps(df, ["a", "b", "c"], rounds=1)
    got = stumps.value_leaf_influence(df, model, df).orderBy("id").toPandas()["value"].to_numpy()
    y = np.array([r[1] for r in rows], dtype=float)
    side = np.array([r[2][0] > model.means[0] for r in rows])
    p0 = y.mean()

    def final_loss_change(i, eps=1e-6):
        weights = np.ones(len(y))
        weights[i] += eps
        leaf = np.array(
            [-0.1 * (weights * (p0 - y))[side == s].sum() / ((weights * p0 * (1 - p0))[side == s].sum() + 1) for s in (0, 1)]
        )
        base = np.array(
            [-0.1 * (p0 - y)[side == s].sum() / ((p0 * (1 - p0)) * (side == s).sum() + 1) for s in (0, 1)]
        )
        final = 1 / (1 + np.exp(-(model.base + base[side.astype(int)])))
        return ((final - y) * ((leaf - base) / eps)[side.astype(int)]).sum()

    for i in (0, 13, 42):
        assert math.isclose(got[i], -final_loss_change(i), rel_tol=1e-3, abs_tol=1e-6)


def test_cells_and_probability_agree(spark):
    df = numeric(spark, points(80, 8)[0])
    model = stumps.fit_stumps(df, ["a", "b", "c"], rounds=12)
    shown = stumps.predict_stumps(df.withColumn("p", stumps.pattern_column(model.features, model.means)), model).toPandas()
    want = 1 / (1 + np.exp(-model.margins(shown["p"].to_numpy())[:, -1]))
    assert np.allclose(shown["probability"], want)
    steps = stumps.mvs_trajectory(df, model).groupBy("id").agg(F.sum("value").alias("s"))
    joined = stumps.value_mvs(df, model).join(steps, "id").toPandas()
    assert np.allclose(joined["value"], -joined["s"])


def planted(spark):
    rows, wrong = points(400, 10, flip=0.1)
    clean, _ = points(100, 11)
    train = as_frame(spark, rows)
    noisy = spark.createDataFrame([(i, int(w)) for i, w in enumerate(wrong)], "id long, noisy int")
    return settle(train), settle(as_frame(spark, clean, 10_000)), noisy


def area(valued, noisy):
    curve = removal.corruption_curve(valued.join(noisy, "id"))
    return curve.agg(F.avg(F.col("found") - F.col("random"))).first()[0]


def test_every_method_finds_planted_noise(spark):
    train, val, noisy = planted(spark)
    checkpoints = L.fit_checkpoints(train, epochs=5)
    # the nearest rows decide the label, so Shapley values need the trusted validation rows only
    found = {
        "knn": value_knn_shapley(train, val, k=5),
        "tracin_self": L.value_tracin_self(train, checkpoints),
        # rows that help the validation rows come out low here, as published
        "tracin_test": L.value_tracin_test(train, val, checkpoints).withColumn("value", -F.col("value")),
    }
    flat = train.select("id", "y", *[F.col("features")[j].alias(f"f{j}") for j in range(3)])
    model = stumps.fit_stumps(flat, ["f0", "f1", "f2"], rounds=60)
    found["mvs"] = stumps.value_mvs(flat, model)
    target = val.select("id", "y", *[F.col("features")[j].alias(f"f{j}") for j in range(3)])
    found["leaf_test"] = stumps.value_leaf_influence(flat, model, target)
    fitted = boosting.fit_boosters(train, rounds=10, depth=2)[0]
    found["mvs_ensemble"] = boosting.value_mvs(train, fitted)
    found["leaf_ensemble"] = boosting.value_leaf_influence(train, fitted, val)
    found["reinforce"] = value_reinforce(train, val)
    gains = {name: area(valued.select("id", "value"), noisy) for name, valued in found.items()}
    assert {n: g for n, g in gains.items() if g < 0.1} == {}


def test_reinforced_values_are_probabilities_and_repeatable(spark):
    train, val, _ = planted(spark)
    first = value_reinforce(train, val, steps=2).select("id", "value")
    assert first.where("value > 0 and value < 1").count() == 400
    again = value_reinforce(train.repartition(5), val, steps=2).select("id", F.round("value", 9).alias("value"))
    assert first.select("id", F.round("value", 9).alias("value")).exceptAll(again).count() == 0


def test_surrogates_follow_the_value(spark):
    rows, _ = points(300, 12)
    df = as_frame(spark, rows).withColumn("value", F.col("features")[0])
    pool, rest = settle(df.where("id < 200")), settle(df.where("id >= 200").withColumnRenamed("value", "truth"))
    for name in ("gbt", "gp", "ridge"):
        options = {"n_models": 2, "rounds": 5} if name == "gbt" else {}
        got = surrogate.SURROGATES[name](pool, rest, **options)
        assert got.stat.corr("mean", "truth") > 0.7, name
        assert got.agg(F.min("variance")).first()[0] >= 0


def test_random_active_learning_takes_disjoint_batches(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(500)], "id long, y int")
    curve = A.active_learning_random(df, 0.02, 5).orderBy("step").collect()
    assert [r["n_sampled"] for r in curve] == [10 * (i + 1) for i in range(6)]


def test_greedy_active_learning_beats_random(spark):
    rows, _ = points(400, 13)
    # actives are the rare end of the first axis
    df = settle(spark.createDataFrame([(i, int(x[0] > 2.5), x) for i, _, x in rows], SCHEMA))
    greedy = A.active_learning_greedy(df, 0.1, 2).orderBy("step").collect()
    chance = A.active_learning_random(df, 0.1, 2).orderBy("step").collect()
    assert [r["n_sampled"] for r in greedy] == [40, 80, 120]
    assert greedy[-1]["found"] > chance[-1]["found"]


def test_sweep_has_every_level(spark):
    train, val, _ = planted(spark)
    valued = settle(L.value_tracin_self(train, L.fit_checkpoints(train, epochs=2)))
    sweep = U.undersample_sweep(valued, val, levels=3).orderBy("level").collect()
    assert [r["counts"] for r in sweep] == [20, 40, 60]
    assert all(0 <= r[c] <= 1 for r in sweep for c in ("basic", "high", "low", "random"))


def test_assays_query_has_every_level(spark, monkeypatch):
    asked = []

    def sweep(valued, val, estimator=None, levels=removal.LEVELS):
        asked.append(levels)
        return spark.createDataFrame([(k,) for k in removal.level_counts(valued.count(), levels)], "counts long")

    monkeypatch.setattr(U, "undersample_sweep", sweep)
    rows = registry.QUERIES["undersample_assays"](spark, SMALL)
    assert asked == [19, 19]
    assert {tuple(r) for r in rows.groupBy("aid").count().collect()} == {("0", 19), ("1", 19)}


def test_removal_handles_one_class_and_picks_best(spark):
    train, val, _ = planted(spark)
    # the value is the label, so removing from the low end leaves one class
    valued = train.withColumn("value", F.col("y").cast("double"))
    got = U.remove_high_low(valued, val, val, metric="accuracy", bins=4).collect()
    assert len(got) == 8
    assert next(r for r in got if r["side"] == "low" and r["bin"] == 3)["valid"] == 0.0
    best = U.learn_with_values(spark.createDataFrame(got)).first()
    assert best["test"] == max(r["test"] for r in got)


def brute_booster(x, y, rounds, depth, bins, rate=0.1, penalty=1.0):
    """Margins of every row before each tree and after the last, by looking at all splits."""
    low, high = x.min(axis=0), x.max(axis=0)
    binned = sum((x > low + (high - low) * k / bins).astype(int) for k in range(1, bins))
    share = y.mean()
    margins = [np.full(len(y), np.log(share / (1 - share)))]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margins[-1]))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), int)
        for _ in range(depth):
            after = 2 * node
            for m in np.unique(node):
                rows = node == m
                best = (0, None)
                for j in range(x.shape[1]):
                    for cut in range(bins - 1):
                        left = rows & (binned[:, j] <= cut)
                        right = rows & ~left
                        score = lambda r: g[r].sum() ** 2 / (h[r].sum() + penalty)
                        gain = round(score(left) + score(right) - score(rows), 9)
                        if gain > best[0]:
                            best = (gain, right)
                if best[1] is not None:
                    after[best[1]] += 1
            node = after
        step = np.zeros(len(y))
        for m in np.unique(node):
            rows = node == m
            step[rows] = -rate * g[rows].sum() / (h[rows].sum() + penalty)
        margins.append(margins[-1] + step)
    return np.stack(margins, axis=1)


def test_boosters_of_pools_equal_brute_force(spark):
    rows = points(90, 21, 0.1, width=5)[0]
    pools = np.random.default_rng(3).random((90, 3)) < [1.0, 0.5, 0.3]
    x, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    pools[[*x.argmin(axis=0), *x.argmax(axis=0)]] = True
    checked = 0
    df = spark.createDataFrame(
        [(i, y, x, [float(b) for b in p]) for (i, y, x), p in zip(rows, pools)] + [(900, None, rows[0][2], [1.0] * 3)],
        SCHEMA + ", pools array<double>",
    ).repartition(3)
    models = boosting.fit_boosters(df, pools="pools", rounds=3, depth=2, bins=6)
    for c, model in enumerate(models):
        mine = pools[:, c]
        # cuts come from all rows, so a pool is checked where it has the extremes
        mine = mine | np.isin(np.arange(90), [*x.argmin(axis=0), *x.argmax(axis=0)]) if c else mine
        if (mine == pools[:, c]).all():
            got = model.margins(model.leaf_of(model.bins(x[mine])))
            assert np.allclose(got, brute_booster(x[mine], y[mine], 3, 2, 6))
            checked += 1
    assert checked >= 2
    valued = boosting.value_mvs(df, models[0]).collect()
    assert next(r["value"] for r in valued if r["id"] == 900) is None
    assert all(r["value"] <= 0 for r in valued if r["id"] != 900)


def test_grid_takes_the_lowest_of_each_curve(spark):
    rows, _ = points(300, 22)
    df = settle(spark.createDataFrame([(i, int(x[0] > 2.2), x) for i, _, x in rows], SCHEMA).repartition(3))
    curves = C.grid_curves(C.METHODS, ["ridge", "gp"], ["greedy", "ucb"], 2)
    assert len(curves) == 16
    got = C.active_learning_curves(df, curves, step_share=0.1, steps=2, landmarks=20).collect()
    assert {(r["method"], r["replicate"]) for r in got} == {(c.name, c.replicate) for c in curves}
    assert all(r["n_sampled"] == 30 * (r["step"] + 1) and 0 <= r["share"] <= 1 for r in got) and len(got) == 48
    # a curve of its own goes the same way
    alone = C.active_learning_curves(df, curves[:1], step_share=0.1, steps=2, landmarks=20).collect()
    same = {(r["step"], r["found"]) for r in got if r["method"] == curves[0].name and r["replicate"] == 0}
    assert {(r["step"], r["found"]) for r in alone} == same
    with pytest.raises(ValueError):
        C.active_learning_curves(df, [C.Curve("mvs", "known", "greedy", 0)])


def brute_known_curve(rows, value, replicate, share, steps):
    """(n_sampled, found) after each step, a round at a time."""
    draw = lambda i: "" if i is None else hashlib.md5(f"{replicate}:{i}".encode()).hexdigest()
    place = lambda i: -1 if i is None else i
    taken = sorted((r[0] for r in rows), key=lambda i: (draw(i), place(i)))[: math.ceil(len(rows) * share)]
    out = []
    for step in range(steps + 1):
        if step:
            pool = set(taken) - {None}
            rest = sorted((value(r) is None, value(r) or 0.0, place(r[0])) for r in rows if r[0] not in pool)
            taken += [i if i >= 0 else None for _, _, i in rest[: int(len(rows) * share)]]
        met = [r[1] for i in taken for r in rows if i is not None and r[0] == i]
        out.append((len(met), sum(met)))
    return out


@pytest.mark.parametrize("kind", ["plain", "copies", "no ids", "mostly copies", "one id", "few values"])
def test_known_curves_are_those_of_single_rounds(spark, kind):
    rng = np.random.default_rng(31)
    rows = [(i, int(rng.random() < 0.3), float(rng.integers(0, 40)), float(rng.normal())) for i in range(300)]
    if kind == "copies":
        rows += [(i, y, a + i % 3, b) for i, y, a, b in rows[::7]]
    if kind == "no ids":
        rows = [(None if i % 9 == 0 else i, *r) for i, *r in rows]
    if kind == "mostly copies":
        rows = [(i % 45, *r) for i, *r in rows]
    if kind == "one id":
        rows = [(5, *r) for _, *r in rows]
    if kind == "few values":
        rows = [(i, y, a if i % 20 == 0 else None, float(i % 2)) for i, y, a, _ in rows]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double").repartition(3)
    methods = {"a": F.col("a"), "b": -F.col("b")}
    curves = C.grid_curves(methods, ["known"], ["greedy", "ucb"], 2)
    got = C.active_learning_curves(df, curves, methods, step_share=0.04, steps=5).collect()
    values = {"a": lambda r: r[2], "b": lambda r: -r[3]}
    for c in curves:
        mine = sorted((r["step"], r["n_sampled"], r["found"]) for r in got if r["method"] == c.name and r["replicate"] == c.replicate)
        expected = brute_known_curve(rows, values[c.method], c.replicate, 0.04, 5)
        # a step that adds nothing has no row
        assert [(n, k) for _, n, k in mine] == [expected[s] for s, _, _ in mine]
        assert {s for s, _, _ in mine} >= {s for s in range(6) if expected[s] != (expected[s - 1] if s else (0, 0))}


def test_known_curves_write_few_rows(spark, monkeypatch):
    """Not every row for every curve and round."""
    written = []

    def counting(df):
        df = settle(df)
        written.append(df.count())
        return df

    for module in (C, removal, ordering):
        monkeypatch.setattr(module, "settle", counting)
    df = spark.range(0, 20000, 1, 4).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), (F.hash("id") % 1000).alias("a"))
    curves = C.grid_curves({"a": None}, ["known"], ["greedy", "ucb"], 2)
    got = C.active_learning_curves(df, curves, {"a": F.col("a")}).collect()
    assert len(got) == 28 and all(r["n_sampled"] == 200 * (r["step"] + 1) for r in got)
    assert sum(written) < 3 * 20000


def test_one_curve_of_the_grid_is_the_single_loop(spark):
    rows, _ = points(200, 23)
    df = settle(spark.createDataFrame([(i, int(x[0] > 2.2), x) for i, _, x in rows], SCHEMA))

    def valuer(pool):
        return L.value_tracin_self(pool, L.fit_checkpoints(pool, epochs=3))

    single = A.active_learning(df, valuer, "ridge", step_share=0.1, steps=2, landmarks=15).collect()
    curve = C.active_learning_curves(df, [C.Curve("tracin_self", "ridge", "greedy", 0)], step_share=0.1, steps=2, landmarks=15).collect()
    assert {(r["step"], r["n_sampled"], r["found"]) for r in single} == {(r["step"], r["n_sampled"], r["found"]) for r in curve}


def test_lowest_rows_with_ties_nulls_and_small_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(i % 3), None if i % 11 == 0 else float(rng.integers(0, 6))) for i in range(400)] + [(1000 + i, 9, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, g int, v double").repartition(5)
    for count in (0, 1, 7, 130, 5000):
        got = {(r["g"], r["id"]) for r in removal.lowest_rows(df, count, "v", "id", ["g"]).collect()}
        want = set()
        for g in (0, 1, 2, 9):
            group = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is None, r[2] or 0, r[0]))
            want |= {(g, r[0]) for r in group[:count]}
        assert got == want


def test_many_models_equal_single_ones(spark):
    rows, _ = points(80, 24, 0.1)
    weights = [[1.0, float(i % 2), 2.0 if i < 40 else 0.5] for i in range(80)]
    df = spark.createDataFrame([(*r, w) for r, w in zip(rows, weights)], SCHEMA + ", w array<double>").repartition(3)
    many = fit_many(df, "w", epochs=3)
    single = L.fit_checkpoints(df, epochs=3)
    half = L.fit_checkpoints(df.where("id % 2 = 1"), epochs=3)
    for e in range(3):
        assert np.allclose(many[e][0], single[e]) and np.allclose(many[e][1], half[e])


def test_sweep_with_an_estimator_and_replicates(spark):
    from pyspark.ml.classification import LogisticRegression

    train, val, _ = planted(spark)
    valued = settle(L.value_tracin_self(train, L.fit_checkpoints(train, epochs=2)))
    own = U.undersample_sweep(valued, val, levels=1, estimator=LogisticRegression(maxIter=5), exempt_positives=False).collect()
    assert len(own) == 1 and all(0 <= own[0][c] <= 1 for c in ("basic", "high", "low", "random"))
    twice = U.sweep_replicates(valued, val, lambda rows, seed: rows, 2, levels=1, epochs=3).collect()
    assert sorted(r["replicate"] for r in twice) == [0, 1] and len({r["low"] for r in twice}) == 1

@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_similar_pairs_equal_all_pairs(spark, threshold):
    rng = np.random.default_rng(3)
    sets = [set(rng.choice(200, rng.integers(1, 60), replace=False).tolist()) for _ in range(60)]
    # near copies of every size, copies, empty and missing sets
    for s in sets[:40]:
        sets.append((s | {int(rng.integers(200))}) - {next(iter(s))} if len(s) > 1 else set(s))
        sets.append(s | set(rng.choice(200, len(s) // 5, replace=False).tolist()))
    rows = [(i, sorted(s)) for i, s in enumerate(sets)] + [(900, []), (901, None)]
    df = spark.createDataFrame(rows, "id long, bits array<int>")
    tanimoto = {(i, j): len(a & b) / len(a | b) for (i, a), (j, b) in itertools.product(enumerate(sets), repeat=2)}
    wanted = {p for p, v in tanimoto.items() if v >= threshold}
    found = similar_pairs(df, threshold=threshold).collect()
    assert len(found) == len({(r.id, r.ref_id) for r in found})
    assert {(r.id, r.ref_id) for r in found} == {(i, j) for i, j in wanted if i < j}
    assert all(r.similarity == tanimoto[r.id, r.ref_id] for r in found)
    two = similar_pairs(df.where("id < 50"), df.where("id >= 50"), threshold).collect()
    assert {(r.id, r.ref_id) for r in two} == {(i, j) for i, j in wanted if i < 50 <= j}


def test_fingerprint_classes_and_no_rows(spark):
    rows = [(5, [3, 1]), (2, [1, 3, 3]), (7, [1]), (8, []), (9, None), (4, [])]
    df = spark.createDataFrame(rows, "id long, bits array<int>")
    found = {r.id: (r.class_id, r.bits) for r in fingerprint_classes(df).collect()}
    assert found == {5: (2, [1, 3]), 2: (2, [1, 3]), 7: (7, [1]), 8: (8, None), 9: (9, None), 4: (4, None)}
    assert similar_pairs(df.where("id > 99")).count() == 0


def test_frequent_tokens_are_coded_the_same_by_shuffle(spark):
    rows = [(i, ["the", f"w{i % 37}", None, "the", f"x{i}"][: i % 6]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    vocab = vocabulary(df).where("token <> 'w3'")
    small = encode_tokens(df, vocab, 4).select("id", "codes")
    large = encode_tokens(df, vocab, 4, max_broadcast=0).select("id", "codes")
    assert small.exceptAll(large).count() == large.exceptAll(small).count() == 0


@pytest.mark.parametrize("cell_rows", [3, 40])
def test_shapley_in_cells_equals_one_cell(spark, cell_rows):
    rng = np.random.default_rng(8)
    # few places, so that many distances are equal and edges fall among them
    rows = [(int(i), int(rng.integers(2)), rng.integers(0, 3, 2).astype(float).tolist()) for i in rng.permutation(120)]
    train, val = as_frame(spark, rows), as_frame(spark, rows[:15], 1000)
    whole = {r.id: r.value for r in value_knn_shapley(train, val, k=4).collect()}
    cut = {r.id: r.value for r in value_knn_shapley(train.repartition(5), val, k=4, cell_rows=cell_rows).collect()}
    assert whole.keys() == cut.keys() and len(whole) == 120
    assert max(abs(whole[i] - cut[i]) for i in whole) < 1e-12


def test_reinforced_values_for_numbers(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 2))
    y = 10 + x @ [2.0, -1.0]
    wrong = rng.random(240) < 0.15
    rows = [(i, float(y[i] + (8 if wrong[i] else 0)), x[i].tolist()) for i in range(200)]
    clean = [(i, float(y[i]), x[i].tolist()) for i in range(200, 240)]
    train, val = (settle(spark.createDataFrame(r, "id long, y double, features array<double>")) for r in (rows, clean))
    valued = value_reinforce(train, val, steps=3, draws=6, metric="rmspe").collect()
    bad = [r.value for r in valued if wrong[r.id]]
    good = [r.value for r in valued if not wrong[r.id]]
    assert len(valued) == 200 and np.mean(bad) < np.mean(good)
    with pytest.raises(ValueError):
        value_reinforce(train, val, metric="other")


def test_shapley_shuffles_no_pairs(spark, monkeypatch):
    from rowworth.operators import knn_shapley

    rng = np.random.default_rng(9)
    rows = [(int(i), int(rng.integers(2)), rng.integers(0, 3, 2).astype(float).tolist()) for i in rng.permutation(90)]
    train, val = as_frame(spark, rows).repartition(4), as_frame(spark, rows[:30], 1000)
    # pieces of a few rows, so that tasks put orders together from many
    monkeypatch.setattr(knn_shapley, "_PACKED_ROWS", 7)
    found = value_knn_shapley(train, val, k=4)
    assert "row_number" not in found._jdf.queryExecution().executedPlan().toString()
    cut = {r.id: r.value for r in value_knn_shapley(train, val, k=4, cell_rows=20).collect()}
    whole = {r.id: r.value for r in found.collect()}
    assert whole.keys() == cut.keys() and max(abs(whole[i] - cut[i]) for i in whole) < 1e-12
    # rows that share an id share a value
    twice = {r.id: r.value for r in value_knn_shapley(train.unionByName(train), val, k=4).collect()}
    want = {r.id: r.value for r in value_knn_shapley(train.unionByName(train), val, k=4, cell_rows=1 << 16).collect()}
    assert len(twice) == 90 and max(abs(twice[i] - want[i]) for i in want) < 1e-12


def test_shapley_reads_training_rows_a_few_times(spark, monkeypatch):
    from rowworth.operators import knn_shapley

    rng = np.random.default_rng(12)
    rows = [(int(i), int(rng.integers(3)), rng.integers(0, 4, 3).astype(float).tolist()) for i in rng.permutation(150)]
    train, val = as_frame(spark, rows).repartition(3), as_frame(spark, rows[:120], 1000).coalesce(2)
    wanted = {r.id: r.value for r in value_knn_shapley(train, val, k=4, cell_rows=40).collect()}
    settled = []

    def settle(df):
        settled.append(df.checkpoint())
        return settled[-1]

    monkeypatch.setattr(knn_shapley, "settle", settle)
    # one order at a time; with 0 bytes of training rows kept, distances are worked out as these pass by
    monkeypatch.setattr(knn_shapley, "_HELD", 150)
    for kept in (0, 1 << 20):
        monkeypatch.setattr(knn_shapley, "_KEPT_BYTES", kept)
        settled.clear()
        found = {r.id: r.value for r in value_knn_shapley(train, val, k=4).collect()}
        assert found.keys() == wanted.keys() and max(abs(found[i] - wanted[i]) for i in wanted) < 1e-12
        blocks = [df for df in settled if "rows" in df.columns and df.selectExpr("sum(octet_length(rows) div 8)").first()[0] == 120]
        assert len(blocks) == 1
        assert blocks[0].count() <= 4 if kept else blocks[0].count() == 120


def test_orders_by_one_number_and_by_distance():
    from rowworth.operators.knn_shapley import _Orders

    rng = np.random.default_rng(13)
    # equal distances, also 0, between numbers whose sums round
    x = rng.integers(0, 3, (400, 4)) / 10 + 7
    labels, ref_y = rng.integers(0, 3, 400), np.sort(rng.integers(0, 3, 30)).astype(np.int8)
    got = []
    for quick in (False, True):
        orders = _Orders(400, 5, 13, quick)
        orders.labels[:] = labels
        orders.begin(x[:30], ref_y, 30)
        places = rng.permutation(100)
        for part in (slice(100, 400), places):
            orders.fill(part, x[part])
        orders.add()
        got.append(orders.result())
    assert np.abs(got[0][0] - got[1][0]).max() < 1e-12 and abs(got[0][1] - got[1][1]) < 1e-12
    d = np.round(((x[:30, None] - x[None]) ** 2).sum(axis=2), 9)
    wanted = np.zeros(400)
    for mine, own in zip(d, ref_y):
        order = np.lexsort((np.arange(400), mine))
        match = labels[order] == own
        s = match[-1] * 5 / (5 * 400)
        for r in range(400, 0, -1):
            if r < 400:
                s += (float(match[r - 1]) - match[r]) / 5 * min(5, r) / r
            wanted[order[r - 1]] += s
    assert np.abs(got[1][0] - wanted).max() < 1e-12


@pytest.mark.parametrize("size", [1e-4, 1e5])
def test_shapley_of_features_of_any_size(spark, size):
    rng = np.random.default_rng(14)
    rows = [(i, int(rng.integers(2)), (rng.normal(size=3) * size).tolist()) for i in range(80)]
    train, val = as_frame(spark, rows), as_frame(spark, rows[:20], 1000)
    whole = {r.id: r.value for r in value_knn_shapley(train, val, k=4).collect()}
    cut = {r.id: r.value for r in value_knn_shapley(train, val, k=4, cell_rows=30).collect()}
    assert whole.keys() == cut.keys() and max(abs(whole[i] - cut[i]) for i in whole) < 1e-12


def test_similar_pairs_write_no_other_pairs(spark):
    rng = np.random.default_rng(5)
    # common bits in every set, and numbers that share slots, also negative ones
    for places in (1024, 10**9):
        numbers = rng.integers(-places if places > 1024 else 0, places, 400)
        sets = [set(numbers[:20].tolist()) | set(rng.choice(numbers, rng.integers(1, 40)).tolist()) for _ in range(150)]
        sets += [s | {int(rng.choice(numbers))} for s in sets[:50]]
        df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, bits array<long>")
        wanted = {(i, j): len(a & b) / len(a | b) for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2)}
        found = similar_pairs(df, threshold=0.8)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "HashAggregate" not in plan
        assert {(r.id, r.ref_id): r.similarity for r in found.collect()} == {p: v for p, v in wanted.items() if v >= 0.8}
