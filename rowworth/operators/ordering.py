"""Global order without a global window.

A window with no partition key (or with one hot key) sorts everything in one task. Here the
rows are range-partitioned on (group, order) instead, so any group or tied value spreads over
as many tasks as it needs. What crosses partitions is one small row per (partition, group).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowworth.session import broadcast_if_small, settle

# monotonically_increasing_id keeps the partition number above this bit
_PARTITION_SHIFT = 33


@dataclass(frozen=True)
class Ordered:
    """Rows laid out along an order; `_at` in `rows` rises along it.

    The layout is written once, because range bounds are sampled and must not change between
    the passes that read it. Ranks and running sums of one layout need no further sort.
    """

    rows: DataFrame
    by: tuple[str, ...]

    @classmethod
    def of(cls, df: DataFrame, order: Sequence, by: Sequence[str] = ()) -> Ordered:
        keys = [F.col(b) for b in by] + [F.col(o) if isinstance(o, str) else o for o in order]
        placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        return cls(settle(placed.withColumn("_at", F.monotonically_increasing_id())), tuple(by))

    def with_rank(self, out: str = "rank") -> Ordered:
        """Add the 1-based row number within the group."""
        joined = self._with_runs({"n": F.count(F.lit(1))}, backwards=False)
        rank = F.col("_at") - F.col("_first") + 1 + F.col("_other_n")
        return Ordered(joined.select(*self.rows.columns, rank.alias(out)), self.by)

    def with_totals(self, totals: dict[str, str], backwards: bool = False) -> Ordered:
        """Add inclusive running sums `{new column: summed column}`, from the end if `backwards`."""
        joined = self._with_runs({out: F.sum(col) for out, col in totals.items()}, backwards)
        # a (partition, group) run never exceeds one range partition
        local = Window.partitionBy("_run_part", *self.by).orderBy("_at")
        local = (
            local.rowsBetween(Window.currentRow, Window.unboundedFollowing)
            if backwards
            else local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        sums = [(F.sum(col).over(local) + F.col(f"_other_{out}")).alias(out) for out, col in totals.items()]
        return Ordered(joined.select(*self.rows.columns, *sums), self.by)

    def plain(self) -> DataFrame:
        return self.rows.drop("_at")

    def _with_runs(self, aggs: dict[str, Column], backwards: bool) -> DataFrame:
        """Attach the first `_at` of the row's run (its group within its partition), and as
        `_other_*` the sums over the group's runs in earlier (or later) partitions."""
        part = F.shiftright("_at", _PARTITION_SHIFT)
        runs = self.rows.groupBy(*self.by, part.alias("_part")).agg(
            F.min("_at").alias("_first"), *[c.alias(name) for name, c in aggs.items()]
        )
        # a group has at most one run per partition
        other = Window.partitionBy(*(self.by or [F.lit(0)])).orderBy("_part")
        other = (
            other.rowsBetween(1, Window.unboundedFollowing)
            if backwards
            else other.rowsBetween(Window.unboundedPreceding, -1)
        )
        runs = runs.select(
            *[F.col(b).alias(f"_run_by{i}") for i, b in enumerate(self.by)],
            F.col("_part").alias("_run_part"),
            "_first",
            *[F.coalesce(F.sum(name).over(other), F.lit(0)).alias(f"_other_{name}") for name in aggs],
        )
        # without groups there are as many rows as partitions
        runs = broadcast_if_small(settle(runs)) if self.by else F.broadcast(runs)
        match = reduce(
            lambda a, b: a & b,
            [F.col(b).eqNullSafe(F.col(f"_run_by{i}")) for i, b in enumerate(self.by)],
            part == F.col("_run_part"),
        )
        return self.rows.join(runs, match)


def rank_rows(df: DataFrame, order: Sequence, by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """1-based row number along `order` (which must end in a unique column), per `by` group."""
    return Ordered.of(df, order, by).with_rank(out).plain()


def running_totals(
    df: DataFrame, order: Sequence, totals: dict[str, str], by: Sequence[str] = ()
) -> DataFrame:
    """Inclusive running sums `{new column: summed column}` along `order`, per `by` group."""
    return Ordered.of(df, order, by).with_totals(totals).plain()


def attach_totals(df: DataFrame, totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Join per-group totals to rows; without groups `totals` is a one-row aggregate.

    Totals are written and measured first, so that few groups are broadcast and the rows need not
    be shuffled onto them, which would put a hot group in one task.
    """
    if not by:
        return df.crossJoin(F.broadcast(totals))
    renamed = totals.select(
        *[F.col(c).alias(f"_tot_{c}") if c in by else F.col(c) for c in totals.columns]
    )
    match = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_tot_{b}")) for b in by])
    return df.join(broadcast_if_small(settle(renamed)), match, "left").drop(*[f"_tot_{b}" for b in by])


# sketch precision; its rank error is at most n / _ACCURACY
_ACCURACY = 10000
# the exact place is looked for this far, as a share of n, on both sides of the sketch's answer
_MARGIN = 10 / _ACCURACY


def exact_percentiles(
    df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Linear-interpolated percentiles, one row per `by` group, column per entry of `probs`.

    A quantile sketch brackets each place; one more scan counts what lies below the bracket and
    the values inside it, and only those are sorted. So the table is not shuffled, and neither a
    hot value nor a large group has to fit in one buffer. If a place lies outside its bracket, the
    brackets are widened, in the end to all values.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    margin = _MARGIN
    while True:
        found = settle(_bracketed(rows, probs, list(by), margin))
        if margin >= 1 or found.where("_missed").isEmpty():
            return found.drop("_missed")
        margin *= 10


def _bracketed(rows: DataFrame, probs: dict[str, float], by: list[str], margin: float) -> DataFrame:
    """Percentiles of `_v`, and `_missed` where a place lies outside the bracket of `margin` on both sides."""
    edges = [min(max(p + side, 0.0), 1.0) for p in probs.values() for side in (-margin, margin)]
    # interpolation reaches one row further than the sketch's own place; where the margin is less
    # than a few rows, all values are in the bracket
    tiny = F.lit(margin >= 1) | (F.count(F.lit(1)) * margin < 4)
    whole = F.flatten(F.array_repeat(F.array(F.min("_v"), F.max("_v")), len(probs)))
    sketch = settle(
        rows.groupBy(*by).agg(
            F.count(F.lit(1)).alias("_n"),
            F.when(tiny, whole).otherwise(F.percentile_approx("_v", edges, _ACCURACY)).alias("_edges"),
        )
    )
    ends = [(F.col("_edges")[2 * i], F.col("_edges")[2 * i + 1]) for i in range(len(probs))]
    inside = reduce(lambda a, b: a | b, [F.col("_v").between(low, high) for low, high in ends])
    # values between brackets are only counted, under the bracket end before them (null: before all)
    before = [F.when(high < F.col("_v"), high) for _, high in ends]
    gap = before[0] if len(before) == 1 else F.greatest(*before)
    counts = (
        attach_totals(rows, sketch, by)
        .groupBy(*by, F.when(inside, F.col("_v")).otherwise(gap).alias("_v"), (~inside).cast("int").alias("_gap"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    cumulative = running_totals(counts, [F.col("_v").asc_nulls_first(), "_gap"], {"_cum": "_c"}, by)
    placed = attach_totals(cumulative, sketch.select(*by, "_n"), by)
    picks = []
    for name, p in probs.items():
        at = F.lit(p) * (F.col("_n") - 1)
        for bound, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            # cumulative counts are distinct, so the smallest one beyond the place is its row
            first = F.min_by(F.struct("_v", "_gap"), F.when(F.col("_cum") > place, F.col("_cum")))
            picks.append(first.alias(f"_{bound}_{name}"))
    picked = placed.groupBy(*by).agg(F.max("_n").alias("_n"), *picks)
    out, missed = [], []
    for name, p in probs.items():
        at = F.lit(p) * (F.col("_n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        missed += [lo["_gap"] == 1, hi["_gap"] == 1]
        out.append((lo["_v"] + (hi["_v"] - lo["_v"]) * (at - F.floor(at))).alias(name))
    return picked.select(*by, *out, F.coalesce(reduce(lambda a, b: a | b, missed), F.lit(False)).alias("_missed"))
