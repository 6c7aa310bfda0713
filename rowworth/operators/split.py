"""Splits and seeded samples. Randomness is an order by `md5(seed:id)`, the same on every run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowworth.functions.columns import seeded_key
from rowworth.operators.clean import complete_cases
from rowworth.operators.ordering import attach_totals, rank_rows
from rowworth.session import broadcast_if_small, settle


def ranked_share(
    df: DataFrame, order: Sequence, share: float, by: Sequence[str] = (), round_up: bool = False
) -> DataFrame:
    """The leading `share` of each group along `order`; the cut is on an exact rank.

    Every column of `df` is laid out along the order, so callers give what the order needs and
    join the rest by id.
    """
    ranked = rank_rows(df, order, by, "_rank")
    sizes = ranked.groupBy(*by).agg(F.max("_rank").alias("_n"))
    quota = F.col("_n") * F.lit(share)
    quota = F.ceil(quota) if round_up else F.floor(quota)
    return attach_totals(ranked, sizes, by).where(F.col("_rank") <= quota).select(*df.columns)


def top_score_split(df: DataFrame, share: float = 0.1, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(train, validation): validation is the best-scored `share` of the fully measured rows."""
    judged = complete_cases(df, ["primary", "score", "confirmatory"])
    taken = settle(ranked_share(judged.select(id_col, "score"), [F.col("score").desc(), id_col], share).select(id_col))
    return exclude_split(df, taken, id_col), _taken(judged, taken, id_col)


def _taken(df: DataFrame, taken: DataFrame, id_col: str) -> DataFrame:
    """Rows of `df` whose id (one row each) was taken."""
    return df.join(broadcast_if_small(taken), id_col, "left_semi").select(*df.columns)


def exclude_split(df: DataFrame, taken: DataFrame, id_col: str = "id") -> DataFrame:
    return df.join(taken.select(id_col), id_col, "left_anti")


def random_order(df: DataFrame, seed: int = 0, id_col: str = "id", out: str = "position") -> DataFrame:
    """Seeded shuffle: the position of each row in it."""
    keyed = df.withColumn("_draw", seeded_key(F.col(id_col), seed))
    return rank_rows(keyed, ["_draw", id_col], out=out).drop("_draw")


def random_split(df: DataFrame, share: float, seed: int = 0, id_col: str = "id") -> DataFrame:
    """A seeded sample of ceil(share * n) rows."""
    keyed = df.select(id_col).withColumn("_draw", seeded_key(F.col(id_col), seed))
    taken = settle(ranked_share(keyed, ["_draw", id_col], share, round_up=True).select(id_col))
    return _taken(df, taken, id_col)


def stratified_split(
    df: DataFrame, label: str, share: float = 0.1, seed: int = 0, id_col: str = "id"
) -> DataFrame:
    """Mark floor(share * n) rows of each label value `val`; all others, also unlabelled, `train`."""
    keyed = df.where(F.col(label).isNotNull()).select(id_col, label).withColumn("_draw", seeded_key(F.col(id_col), seed))
    val = ranked_share(keyed, ["_draw", id_col], share, by=[label])
    marked = df.join(val.select(id_col, F.lit("val").alias("split")), id_col, "left")
    return marked.withColumn("split", F.coalesce("split", F.lit("train")))


def undersample_to_ratio(
    df: DataFrame, label: str, ratio: float, seed: int = 0, id_col: str = "id"
) -> DataFrame:
    """All rows of the rarer label, and a seeded floor(n_rare / ratio) of the other."""
    keyed = df.select(id_col, label).withColumn("_draw", seeded_key(F.col(id_col), seed))
    ranked = rank_rows(keyed, ["_draw", id_col], by=[label], out="_rank")
    totals = df.agg(F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg"))
    rare = F.least("_pos", "_neg")
    in_rare = F.col(label) == F.when(F.col("_pos") <= F.col("_neg"), 1).otherwise(0)
    kept = attach_totals(ranked, totals).where(in_rare | (F.col("_rank") <= F.floor(rare / F.lit(ratio))))
    return _taken(df, settle(kept.select(id_col)), id_col)
