"""All curves of an active-learning grid at once: a round is the same few scans for one curve or for many."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowworth.functions.blocks import matrix
from rowworth.functions.columns import acq_greedy, acq_ucb, draw_bound, seeded_key
from rowworth.operators.boosting import fit_boosters, pool_values_mvs
from rowworth.operators.many_logistic import fit_many, self_influence
from rowworth.operators.ordering import rank_rows
from rowworth.operators.pairs import similarity
from rowworth.operators.removal import lowest_rows, value_bounds
from rowworth.operators.sums import add_up
from rowworth.session import broadcast_if_small, settle

_JITTER = 1e-6

# (pool rows with id, y, features and an array column saying in which pools a row is, that column)
# -> an array column: the row's value in each pool
PoolsValuer = Callable[[DataFrame, str], Column]


def tracing(pools: DataFrame, member: str, epochs: int = 3, rate: float = 1.0) -> Column:
    """Gradient tracing of the rows on themselves."""
    return self_influence(fit_many(pools, member, epochs=epochs, rate=rate), F.col("features"), F.col("y"))


def mvs(pools: DataFrame, member: str, rounds: int = 5, depth: int = 3, bins: int = 16) -> Column:
    """Sampling weights of a booster."""
    return pool_values_mvs(fit_boosters(pools, pools=member, rounds=rounds, depth=depth, bins=bins), F.col("features"), F.col("y"))


#: value methods by name; a method can also be a column expression over the rows, known for all of them
METHODS: dict[str, PoolsValuer] = {"tracin_self": tracing, "mvs": mvs}
#: surrogates by name; "known" takes the value of a column expression as it is
SURROGATES = ("ridge", "gp", "known")


@dataclass(frozen=True)
class Curve:
    method: str
    surrogate: str
    acquisition: str
    replicate: int

    @property
    def name(self) -> str:
        return f"{self.method}_{self.surrogate}_{self.acquisition}"


@dataclass(frozen=True)
class _Fitted:
    """A kernel model of one curve's pool: landmark rows, their weights, and for variances an inner matrix."""

    landmarks: np.ndarray
    alpha: np.ndarray
    inner: np.ndarray | None

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = similarity(x, self.landmarks, "tanimoto")
        spread = np.zeros(len(k)) if self.inner is None else np.maximum(1.0 - ((k @ self.inner) * k).sum(axis=1), 0.0)
        return k @ self.alpha, spread


def grid_curves(methods, surrogates: list[str], acquisitions: list[str], replicates: int) -> list[Curve]:
    return [Curve(m, s, a, r) for r in range(replicates) for m in methods for s in surrogates for a in acquisitions]


def active_learning_curves(
    train: DataFrame,
    curves: list[Curve],
    methods: dict[str, PoolsValuer | Column] | None = None,
    step_share: float = 0.01,
    steps: int = 6,
    label: str = "y",
    explore: int = 1,
    landmarks: int = 200,
    seed: int = 0,
) -> DataFrame:
    """`(method, replicate, step, n_sampled, found, share)` of all curves, the replicate being the seed of the first pool.

    One slim table `(curve, id, round)` grows; a row's pools are an array beside its features. Each
    round values all pools, fits all surrogates and scores the rest in scans that all curves
    share, and one grouped order takes the lowest rows of each curve. Known values do not change
    from round to round, so all rounds of their curves share one order.
    """
    methods = methods or METHODS
    for curve in curves:
        if curve.surrogate not in SURROGATES:
            raise ValueError(f"no surrogate is named {curve.surrogate}")
        if curve.surrogate == "known" and not isinstance(methods[curve.method], Column):
            raise ValueError("only a column expression is known for rows that are not measured")
    total = train.count()
    columns = {n: m for n, m in methods.items() if isinstance(m, Column)}
    rows = train.select(
        "id", F.col(label).alias("y"), *([] if "features" not in train.columns else ["features"]),
        *[c.cast("double").alias(f"_known_{n}") for n, c in columns.items()],
    )
    batch = int(total * step_share)
    fitted = [c for c in curves if c.surrogate != "known"]
    known = [c for c in curves if c.surrogate == "known"]
    found = []
    if fitted:
        sampled = _first_pools(train, fitted, step_share, total)
        for step in range(1, steps + 1):
            marked = rows.join(_members(sampled), "id", "left").withColumn("_pools", F.array(*_in_pools(fitted, "double"))).drop("_in")
            scores = _scores(marked, fitted, methods, explore, landmarks, seed)
            slim = settle(marked.select("id", "_pools", scores.alias("_scores")))
            taken = _lowest_outside(slim, len(fitted), batch)
            sampled = settle(sampled.unionByName(taken.select("curve", "id", F.lit(step).alias("round"))))
        found.append(_found(train, sampled, fitted, label))
    if known:
        first = _first_pools(train, known, step_share, total)
        later = _known_rounds(rows, first, known, batch, steps, int(np.ceil(total * step_share)), explore)
        found.append(_found(train, first.unionByName(later), known, label))
    return reduce(DataFrame.unionByName, found)


def _members(sampled: DataFrame) -> DataFrame:
    """Each pooled id with the curves `_in` whose pools have it."""
    return broadcast_if_small(settle(sampled.groupBy("id").agg(F.collect_list("curve").alias("_in"))))


def _in_pools(curves: list[Curve], kind: str) -> list[Column]:
    """For each curve whether its pool has the row, after a left join with the members."""
    inside = F.coalesce("_in", F.array().cast("array<int>"))
    return [F.array_contains(inside, i).cast(kind) for i in range(len(curves))]


def _below(values: list[Column], bounds: list[float | None]) -> list[Column]:
    """Whether each value is within its bound; without a bound all are, also missing ones."""
    return [F.lit(True) if bound is None else F.coalesce(v <= bound, F.lit(False)) for v, bound in zip(values, bounds)]


def _entries(near: DataFrame, curves: int) -> DataFrame:
    """`(curve, id, acquisition)` of the curves that a row is `_open` for."""
    entries = [F.when(F.col("_open")[i], F.struct(F.lit(i).alias("curve"), F.col("_scores")[i].alias("acquisition"))) for i in range(curves)]
    exploded = near.select("id", F.explode(F.array(*entries)).alias("_e")).where("_e IS NOT NULL")
    return exploded.select("_e.curve", "id", "_e.acquisition")


def _ranked(entries: DataFrame) -> DataFrame:
    """Add `_rank`, from 1 for the lowest of each curve; missing values come last."""
    return rank_rows(entries, [F.col("acquisition").asc_nulls_last(), "id"], ["curve"], "_rank")


def _lowest_outside(slim: DataFrame, curves: int, batch: int) -> DataFrame:
    """`(curve, id)` of the `batch` lowest rows outside each pool; all where there are fewer.

    Only rows under a sketched bound become rows by curve; a curve that gets too few of them takes all its rows.
    """
    outside = [F.col("_pools")[i] == 0 for i in range(curves)]
    scores = [F.when(out, F.col("_scores")[i]) for i, out in enumerate(outside)]
    bounds = value_bounds(slim, batch, scores)
    while True:
        opened = [out & low for out, low in zip(outside, _below(scores, bounds))]
        near = slim.where(reduce(Column.__or__, opened)).select("id", "_scores", F.array(*opened).alias("_open"))
        taken = settle(_ranked(_entries(near, curves)).where(F.col("_rank") <= batch).select("curve", "id"))
        got = {r["curve"]: r["count"] for r in taken.groupBy("curve").count().collect()}
        short = [bound is not None and got.get(i, 0) < batch for i, bound in enumerate(bounds)]
        if not any(short):
            return taken
        bounds = [None if s else bound for s, bound in zip(short, bounds)]


def _known_rounds(
    rows: DataFrame, first: DataFrame, curves: list[Curve], batch: int, steps: int, pooled: int, explore: int
) -> DataFrame:
    """`(curve, id, round)` beyond the first pools, of `pooled` rows each, where no value depends on a pool.

    The batches of all rounds are pieces of one order by value. Sketches bound the values of the rows that any
    round can take; only those are looked up in the first pools and put in order. If ids repeat among
    them, a batch takes copies out of later rounds, so these rows go round by round.
    """
    wanted = batch * steps
    if wanted <= 0:
        return first.limit(0)
    values = [_acquisition(F.col(f"_known_{c.method}"), F.lit(0.0), c, explore) for c in curves]
    bounds = value_bounds(rows, wanted + pooled, values)
    members = _members(first)
    while True:
        low = _below(values, bounds)
        near = rows.where(reduce(Column.__or__, low)).select("id", F.array(*values).alias("_scores"), F.array(*low).alias("_low"))
        opened = F.array(*[F.get("_low", F.lit(i)) & ~taken for i, taken in enumerate(_in_pools(curves, "boolean"))])
        near = settle(near.join(members, "id", "left").select("id", "_scores", opened.alias("_open")))
        copies = near.groupBy("id").agg(*[F.count_if(F.col("_open")[i]).alias(f"_c{i}") for i in range(len(curves))])
        sizes = copies.agg(
            *[F.coalesce(F.sum(f"_c{i}"), F.lit(0)) for i in range(len(curves))],
            *[F.count_if(F.col("id").isNotNull() & (F.col(f"_c{i}") > 0)) for i in range(len(curves))],
        ).first()
        n_rows, n_ids = sizes[: len(curves)], sizes[len(curves) :]
        # each round takes no more ids than rows, so that many ids last for all rounds
        short = [bound is not None and n < wanted for n, bound in zip(n_ids, bounds)]
        if not any(short):
            break
        bounds = [None if s else bound for s, bound in zip(short, bounds)]
    rest = _entries(near, len(curves))
    if n_rows == n_ids:
        ranked = _ranked(rest).where(F.col("_rank") <= wanted)
        return settle(ranked.select("curve", "id", F.ceil(F.col("_rank") / batch).cast("int").alias("round")))
    taken = first.limit(0)
    for step in range(1, steps + 1):
        lowest = settle(lowest_rows(rest, batch, "acquisition", "id", ["curve"]).select("curve", "id"))
        taken = taken.unionByName(lowest.withColumn("round", F.lit(step)))
        # rows without an id are in no pool
        rest = settle(rest.join(lowest.distinct(), ["curve", "id"], "left_anti"))
    return settle(taken)


def _first_pools(train: DataFrame, curves: list[Curve], share: float, total: int) -> DataFrame:
    """The seeded first sample of each replicate, for each of its curves.

    Draws are evenly spread, so a bound on them lets little more than the sample pass, and only that is put in order; if it
    lets less pass, as where ids repeat, it is raised.
    """
    seeds = sorted({c.replicate for c in curves})
    size = int(np.ceil(total * share))
    keys = {s: seeded_key(F.col("id"), s) for s in seeds}
    slack = size + 10 * int(size**0.5) + 20
    while True:
        bound = draw_bound(slack / max(total, 1))
        # rows without an id have no draw and come first
        early = {s: F.lit(True) if slack >= total else F.coalesce(key <= bound, F.lit(True)) for s, key in keys.items()}
        draws = [F.when(early[s], F.struct(F.lit(s).alias("replicate"), key.alias("_draw"))) for s, key in keys.items()]
        some = train.where(reduce(Column.__or__, early.values()))
        drawn = settle(some.select("id", F.explode(F.array(*draws)).alias("d")).where("d IS NOT NULL").select("id", "d.*"))
        placed = settle(rank_rows(drawn, ["_draw", "id"], ["replicate"], "_rank").where(F.col("_rank") <= size))
        if slack >= total or placed.count() >= min(size, total) * len(seeds):
            break
        slack *= 10
    mine = F.element_at(
        F.create_map(*[x for s in seeds for x in (F.lit(s), F.array(*[F.lit(i) for i, c in enumerate(curves) if c.replicate == s]))]),
        F.col("replicate"),
    )
    return settle(placed.select(F.explode(mine).alias("curve"), "id", F.lit(0).alias("round")))


def _acquisition(mean: Column, variance: Column, curve: Curve, explore: int) -> Column:
    return acq_ucb(mean, variance, explore=explore) if curve.acquisition == "ucb" else acq_greedy(mean)


def _scores(marked: DataFrame, curves: list[Curve], methods: dict, explore: int, landmarks: int, seed: int) -> Column:
    """An array: each curve's acquisition of the row."""
    pool = settle(marked.where(F.exists("_pools", lambda p: p > 0)))
    predicted = _predicted(_fit_surrogates(_valued(pool, curves, methods), curves, landmarks, seed), F.col("features"))
    return F.array(*[_acquisition(predicted["mean"][i], predicted["variance"][i], c, explore) for i, c in enumerate(curves)])


def _valued(pool: DataFrame, curves: list[Curve], methods: dict) -> DataFrame:
    """Pool rows with `_values`, an array by curve: z-scores within the pool, null outside it."""
    valued, place = pool, {}
    for number, name in enumerate(sorted({c.method for c in curves})):
        mine = [i for i, c in enumerate(curves) if c.method == name]
        if isinstance(methods[name], Column):
            column = F.array(*[F.col(f"_known_{name}") for _ in mine])
        else:
            member = f"_of_{number}"
            pool = pool.withColumn(member, F.array(*[F.col("_pools")[i] for i in mine]))
            column = methods[name](pool, member)
        valued = valued.withColumn(f"_v_{number}", column)
        place |= {i: (number, k) for k, i in enumerate(mine)}
    values = [F.when(F.col("_pools")[i] > 0, F.col(f"_v_{place[i][0]}")[place[i][1]]) for i in range(len(curves))]
    valued = settle(valued.select("id", "features", F.array(*values).alias("_values")))
    moments = valued.agg(*[f(F.col("_values")[k]) for k in range(len(curves)) for f in (F.avg, F.stddev_pop)]).first()
    scaled = []
    for k in range(len(curves)):
        mean, std = moments[2 * k] or 0.0, moments[2 * k + 1] or 0.0
        scaled.append((F.col("_values")[k] - F.lit(mean)) / F.lit(std if std > 0 else 1.0))
    return valued.select("id", "features", F.array(*scaled).alias("_values"))


def _landmark_rows(valued: DataFrame, count: int, places: int, seed: int) -> list[np.ndarray]:
    """For each pool the `count` rows that a seeded draw puts first; they are model data.

    Draws are evenly spread, so a bound on them lets little more than that pass; if it lets less
    pass, it is doubled.
    """
    drawn = valued.select("id", "features", "_values", seeded_key(F.col("id"), seed).alias("_draw"))
    sizes = drawn.agg(*[F.count(F.col("_values")[k]) for k in range(places)]).first()
    slack = count + 10 * int(count**0.5) + 20
    while True:
        bounds = [1.0 if slack >= n else slack / n for n in sizes]
        keep = [F.col("_values")[k].isNotNull() & ((F.col("_draw") <= draw_bound(b)) | F.lit(b >= 1)) for k, b in enumerate(bounds)]
        picked = drawn.select("id", "_draw", "features", F.array(*keep).alias("_keep")).where(F.exists("_keep", lambda x: x))
        got = picked.orderBy("_draw", "id").toArrow()
        chosen = np.array(got["_keep"].to_pylist(), dtype=bool).reshape(-1, places)
        if all(chosen[:, k].sum() >= min(count, sizes[k]) for k in range(places)):
            x = matrix(got["features"])
            return [x[np.flatnonzero(chosen[:, k])[:count]] for k in range(places)]
        slack *= 2


def _fit_surrogates(valued: DataFrame, curves: list[Curve], count: int, seed: int) -> list[_Fitted]:
    landmarks = _landmark_rows(valued, count, len(curves), seed)

    def partial(batches):
        sums = [np.zeros((len(z), len(z) + 1)) for z in landmarks]
        for batch in batches:
            if batch.num_rows:
                x, values = matrix(batch.column(0)), matrix(batch.column(1))
                for k, z in enumerate(landmarks):
                    mine = ~np.isnan(values[:, k])
                    kernel = similarity(x[mine], z, "tanimoto")
                    sums[k][:, :-1] += kernel.T @ kernel
                    sums[k][:, -1] += kernel.T @ values[mine, k]
        yield from enumerate(sums)

    sums = add_up(valued.select("features", "_values"), partial)
    out = []
    for k, curve in enumerate(curves):
        z, size = landmarks[k], len(landmarks[k])
        full = sums[k].reshape(size, size + 1)
        gram, target = full[:, :-1], full[:, -1]
        kernel = similarity(z, z, "tanimoto") + _JITTER * np.eye(size)
        if curve.surrogate == "ridge":
            out.append(_Fitted(z, np.linalg.solve(gram + kernel, target), None))
        else:
            posterior = np.linalg.inv(kernel + gram)
            out.append(_Fitted(z, posterior @ target, np.linalg.inv(kernel) - posterior))
    return out


def _predicted(models: list[_Fitted], features: Column) -> Column:
    """A struct of two arrays, mean and variance by curve."""

    @F.arrow_udf("struct<mean: array<double>, variance: array<double>>")
    def run(x: pa.Array) -> pa.Array:
        rows = matrix(x)
        found = [m.predict(rows) if len(x) else (np.zeros(0), np.zeros(0)) for m in models]
        both = [pa.array(np.stack(part, axis=1).tolist(), pa.list_(pa.float64())) for part in zip(*found)]
        return pa.StructArray.from_arrays(both, names=["mean", "variance"])

    return run(features)


def _found(train: DataFrame, sampled: DataFrame, curves: list[Curve], label: str) -> DataFrame:
    """Sizes and actives of each curve's pool after each step; no actives at all: null share."""
    actives = train.select("id", F.col(label).alias("_y"))
    per_round = settle(
        sampled.join(actives, "id").groupBy("curve", "round").agg(F.count(F.lit(1)).alias("_c"), F.sum("_y").alias("_a"))
    )
    # as many rows as curves and rounds
    earlier = F.broadcast(per_round.select(F.col("curve").alias("_curve"), F.col("round").alias("_r"), "_c", "_a"))
    summed = (
        per_round.select("curve", F.col("round").alias("step"))
        .join(earlier, (F.col("curve") == F.col("_curve")) & (F.col("_r") <= F.col("step")))
        .groupBy("curve", "step").agg(F.sum("_c").alias("n_sampled"), F.sum("_a").alias("found"))
    )
    everything = train.agg(F.sum(label)).first()[0]
    names = F.array(*[F.struct(F.lit(c.name).alias("method"), F.lit(c.replicate).alias("replicate")) for c in curves])[F.col("curve")]
    return summed.select(
        names["method"].alias("method"), names["replicate"].alias("replicate"), "step", "n_sampled", "found",
        F.try_divide("found", F.lit(everything)).alias("share"),
    )
