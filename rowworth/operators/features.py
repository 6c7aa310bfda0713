"""Feature columns that need a pass over the table: vocabularies, encodings, scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowworth.operators.ordering import rank_rows
from rowworth.session import fits

#: a token with more than this share of all tokens is frequent; at most 1 / share tokens are
FREQUENT_SHARE = 1e-4
_SALTS = 1024


def vocabulary(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """`(token, index)`: distinct tokens in string order, numbered from 0."""
    # distinct within the row first: a long text explodes to its own vocabulary only
    seen = df.select(F.explode(F.array_distinct(tokens)).alias("token")).distinct()
    ranked = rank_rows(seen, ["token"], out="index")
    return ranked.withColumn("index", F.col("index") - 1)


def encode_tokens(
    df: DataFrame,
    vocab: DataFrame,
    length: int = 120,
    too_long: str = "truncate",
    tokens: str = "tokens",
    id_col: str = "id",
    max_broadcast: int = 64 << 20,
) -> DataFrame:
    """Add `codes`: token indices + 1, padded with 0 to `length`.

    Rows with more tokens are cut (training rows) or dropped (`too_long="drop"`, validation rows).
    A token takes part only up to `length`, so the gathered list of one row is bounded by it.
    A vocabulary over `max_broadcast` bytes is shuffled, but for its frequent tokens, which are looked up in a
    broadcast table of at most 1 / FREQUENT_SHARE rows.
    """
    if too_long == "drop":
        df = df.where(F.size(tokens) <= length)
    cells = df.select(id_col, F.posexplode(F.slice(tokens, 1, length)).alias("_pos", "token"))
    found = cells.join(F.broadcast(vocab), "token", "left") if fits(vocab, max_broadcast) else _look_up(cells, vocab)
    coded = found.select(
        id_col, F.struct("_pos", (F.coalesce(F.col("index"), F.lit(-1)) + 1).cast("int").alias("code")).alias("_cell")
    )
    lists = coded.groupBy(id_col).agg(F.array_sort(F.collect_list("_cell"))["code"].alias("_codes"))
    joined = df.join(lists, id_col, "left")
    filled = F.coalesce(F.col("_codes"), F.array().cast("array<int>"))
    padded = F.concat(filled, F.array_repeat(F.lit(0), F.lit(length) - F.size(filled)))
    return joined.withColumn("codes", padded).drop("_codes")


def _look_up(cells: DataFrame, vocab: DataFrame) -> DataFrame:
    """Add `index` to the tokens without sending a frequent one to a single task."""
    counts = cells.groupBy("token").agg(F.count(F.lit(1)).alias("_n"))
    total = cells.agg(F.count(F.lit(1))).first()[0]
    frequent = counts.where(F.col("_n") > F.lit(FREQUENT_SHARE * total)).select("token")
    known = vocab.join(F.broadcast(frequent), "token").select("token", F.col("index").alias("_known"), F.lit(True).alias("_seen"))
    marked = cells.join(F.broadcast(known), "token", "left")
    # what is known already meets nothing in the shuffle and is spread over it
    spread = F.pmod(F.xxhash64(*[c for c in cells.columns]), F.lit(_SALTS)) + 1
    marked = marked.select(
        *[c for c in cells.columns if c != "token"], "_known",
        F.when(F.col("_seen").isNull(), F.col("token")).alias("token"),
        F.when(F.col("_seen").isNull(), F.lit(0)).otherwise(spread).alias("_salt"),
    )
    joined = marked.join(vocab.withColumn("_salt", F.lit(0).cast("long")), ["token", "_salt"], "left")
    return joined.withColumn("index", F.coalesce("_known", "index"))


def scaler(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of means and population deviations; a constant column divides by 1."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"_mean_{c}"), F.stddev_pop(c).alias(f"_std_{c}")]
    fitted = train.agg(*aggs)
    for c in columns:
        std = F.col(f"_std_{c}")
        fitted = fitted.withColumn(f"_std_{c}", F.when(std > 0, std).otherwise(F.lit(1.0)))
    return fitted


def standardize(df: DataFrame, fitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z-scores under a scaler fitted elsewhere (on the training rows)."""
    joined = df.crossJoin(F.broadcast(fitted))
    scaled = {c: (F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_std_{c}") for c in columns}
    return joined.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def standardize_target(df: DataFrame, value: str = "value") -> DataFrame:
    """z-score of the values before regression."""
    return standardize(df, scaler(df, [value]), [value])


def array_scaler(train: DataFrame, features: str = "features") -> DataFrame:
    """`(pos, mean, std)` per array element."""
    cells = train.select(F.posexplode(features).alias("pos", "x"))
    fitted = cells.groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return fitted.withColumn("std", F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1.0)))


def standardize_array(df: DataFrame, fitted: DataFrame, features: str = "features") -> DataFrame:
    """z-scores of an array column under `array_scaler`, whose size is the array's, not the table's."""
    packed = fitted.agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "std"))).alias("_scale"))
    scaled = F.zip_with(features, "_scale", lambda x, s: (x - s["mean"]) / s["std"])
    return df.crossJoin(F.broadcast(packed)).withColumn(features, scaled).drop("_scale")
