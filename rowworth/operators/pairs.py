"""Rows against a reference set: a block nested loop.

The reference side is cut into blocks of a fixed byte size. Each block is broadcast and the big
side is scanned once per block, without a shuffle; a reference set under the bound is one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowworth.functions.blocks import matrix, vector
from rowworth.operators.ordering import rank_rows
from rowworth.session import settle

BLOCK_BYTES = 32 << 20
# pair values computed at once inside a task
_TILE = 1 << 20
# distances this close count as equal, so that ties do not depend on rounding noise
DISTANCE_DIGITS = 9


@dataclass
class Block:
    ids: np.ndarray
    x: np.ndarray
    y: np.ndarray | None


def reference_blocks(
    df: DataFrame, label: str | None = None, features: str = "features", id_col: str = "id",
    block_bytes: int = BLOCK_BYTES,
) -> Iterator[Block]:
    """The reference rows in blocks that stay under `block_bytes`; one is held at a time."""
    columns = [id_col, features] + ([label] if label else [])
    slim = df.select(*columns)
    n, width = slim.agg(F.count(F.lit(1)), F.max(F.size(features))).first()
    if not n:
        return
    per_block = max(1, block_bytes // (8 * max(width, 1)))
    if n <= per_block:
        yield _block(slim, label, features, id_col)
        return
    ranked = rank_rows(slim, [id_col], out="_rank")
    cut = settle(ranked.withColumn("_block", F.floor((F.col("_rank") - 1) / per_block)))
    for b in range(-(-n // per_block)):
        yield _block(cut.where(F.col("_block") == b), label, features, id_col)


def _block(df: DataFrame, label: str | None, features: str, id_col: str) -> Block:
    got = df.toArrow()
    y = vector(got[label]).astype(np.int8) if label else None
    return Block(vector(got[id_col]), matrix(got[features]), y)


def similarity(x: np.ndarray, r: np.ndarray, kind: str) -> np.ndarray:
    """Squared distance or Tanimoto similarity of every row of `x` to every row of `r`."""
    if kind == "distance" and len(r):
        # distances do not depend on the origin; near it their terms are small and little is lost
        centre = r.mean(axis=0)
        x, r = x - centre, r - centre
    dot = x @ r.T
    norms = (x * x).sum(axis=1)[:, None] + (r * r).sum(axis=1)[None, :]
    if kind == "distance":
        apart = norms - 2 * dot
        # what the subtraction leaves of equal rows
        apart[apart < 1e-13 * norms] = 0.0
        return np.round(apart, DISTANCE_DIGITS)
    rest = norms - dot
    return np.divide(dot, rest, out=np.zeros_like(dot), where=rest != 0)


def pair_similarity(
    left: DataFrame, right: DataFrame, kind: str = "tanimoto", features: str = "features", id_col: str = "id"
) -> DataFrame:
    """`(id, ref_id, similarity)` of each left row to each reference row."""
    out = None
    for block in reference_blocks(right, None, features, id_col):
        part = _pairs(left, block, kind, features, id_col)
        out = part if out is None else out.unionByName(part)
    return out


def _pairs(left: DataFrame, block: Block, kind: str, features: str, id_col: str) -> DataFrame:
    shared = left.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        ref = shared.value
        step = max(1, _TILE // len(ref.ids))
        for batch in batches:
            ids, x = vector(batch.column(0)), matrix(batch.column(1))
            for at in range(0, len(ids), step):
                values = similarity(x[at : at + step], ref.x, kind)
                yield pa.record_batch(
                    [
                        pa.array(np.repeat(ids[at : at + step], len(ref.ids)), pa.int64()),
                        pa.array(np.tile(ref.ids, len(values)), pa.int64()),
                        pa.array(values.ravel(), pa.float64()),
                    ],
                    names=["id", "ref_id", "similarity"],
                )

    slim = left.select(F.col(id_col).cast("bigint"), features)
    return slim.mapInArrow(run, "id bigint, ref_id bigint, similarity double")
