"""Packing by non-negative least squares over shallow combinations of piece lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowworth.llm.text import batches
from rowworth.llm.tokens import shared_encoder
from rowworth.session import scratch_folder, settle

VOCABULARY = "word_bpe_49k.json"
WINDOW = 2048
UNIT = 16
# rows of one task are numbered below this; the task's number stands above
_PART = 33


def nnls(matrix: np.ndarray, target: np.ndarray, rounds: int = 0) -> np.ndarray:
    """x >= 0 with the least |matrix x - target|, by active sets: one column joins at a time."""
    columns = matrix.shape[1]
    x, passive = np.zeros(columns), np.zeros(columns, dtype=bool)
    for _ in range(rounds or 3 * matrix.shape[0]):
        gradient = matrix.T @ (target - matrix @ x)
        gradient[passive] = -np.inf
        best = int(gradient.argmax())
        if gradient[best] <= 1e-9 * (1 + np.abs(target).max()):
            break
        passive[best] = True
        while True:
            at = np.flatnonzero(passive)
            free = np.linalg.lstsq(matrix[:, at], target, rcond=None)[0]
            low = free <= 1e-12
            if not low.any():
                x[:] = 0
                x[at] = free
                break
            now = x[at]
            share = np.min(now[low] / np.maximum(now[low] - free[low], 1e-300))
            x[at] = np.maximum(now + min(share, 1.0) * (free - now), 0)
            drop = at[low & (x[at] <= 1e-9)]
            if not len(drop):
                drop = at[low]
            passive[drop] = False
            x[drop] = 0
    return x


def combinations(units: int) -> list[tuple[int, ...]]:
    """All multisets of two or three lengths that fill `units` exactly, long ones first."""
    two = [(a, units - a) for a in range(units - 1, units // 2 - 1, -1) if units - a <= a]
    three = [
        (a, b, units - a - b)
        for a in range(units - 2, 0, -1)
        for b in range(min(a, units - a - 1), 0, -1)
        if units - a - b <= b
    ]
    return two + three


def plan_repeats(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """How often to use which combination, given how many pieces have 1, 2, ... units.

    Least squares against the histogram (errors weigh by length), rounded down and held to the
    pieces that are there; then every combination once more, greedily, on what is left.
    """
    units = len(histogram)
    combos = combinations(units)
    use = np.zeros((units, len(combos)))
    for column, combo in enumerate(combos):
        for length in combo:
            use[length - 1, column] += 1
    weight = np.arange(1, units + 1, dtype=float)
    scale = max(float(histogram.max()), 1.0)
    solved = nnls(use * weight[:, None], histogram / scale * weight) * scale
    left = histogram.astype(np.int64).copy()
    repeats = np.zeros(len(combos), dtype=np.int64)

    def take(column: int, wish: int) -> None:
        lengths, times = np.unique(np.array(combos[column]) - 1, return_counts=True)
        count = min(wish, int((left[lengths] // times).min()))
        left[lengths] -= count * times
        repeats[column] += count

    for column in np.argsort(-solved, kind="stable"):
        take(column, int(solved[column]))
    for column in range(len(combos)):
        take(column, int(left.max()))
    return [(combos[c], int(repeats[c])) for c in np.flatnonzero(repeats)]


def _encode(vocabulary: str, end: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(vocabulary, words_only=True)
        key = TaskContext.get().partitionId() << _PART
        width = encoder.width
        closing = end.to_bytes(width, "little")
        for ids, texts in batches(["doc_id", "text"], rows, size=2000):
            payloads = [found + closing for found in encoder.encode_all(texts)]
            yield pa.record_batch(
                {
                    "key": pa.array(range(key, key + len(ids)), pa.int64()), "doc_id": pa.array(ids, pa.int64()),
                    "doc_tokens": pa.array([len(p) // width for p in payloads], pa.int64()),
                    "width": pa.array([width] * len(ids), pa.int32()), "ids": pa.array(payloads, pa.binary()),
                }
            )
            key += len(ids)

    return run


def _cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, totals, widths, payloads, pieces in batches(["doc_id", "doc_tokens", "width", "ids", "pieces"], rows):
        out = []
        for doc, total, width, payload, cuts in zip(ids, totals, widths, payloads, pieces):
            whole = np.frombuffer(payload, dtype=f"<u{width}").astype("<u4")
            for cut in cuts:
                at, long = cut["start"], cut["length"]
                out.append((doc, at, long, zlib.crc32(whole[at : at + long].tobytes()), total, cut["sequence_id"], cut["offset"]))
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        yield pa.record_batch([pa.array([r[i] for r in out], pa.int64()) for i in range(7)], names=names)


def _placed(rows: DataFrame, by: list[str], values: dict[str, str]) -> DataFrame:
    """Exclusive running sums of `values` in the order of `key`, within `by`.

    Sums run inside each task's share of the keys; only one row per share and group is added up
    across shares, so no window holds the table.
    """
    part = F.shiftright("key", _PART)
    rows = rows.withColumn("_part", part)
    inner = Window.partitionBy("_part", *by).orderBy("key", "start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.groupBy("_part", *by).agg(*[F.sum(v).alias(f"_{n}") for n, v in values.items()])
    outer = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = sums.select("_part", *by, *[(F.sum(f"_{n}").over(outer) - F.col(f"_{n}")).alias(f"_{n}") for n in values])
    joined = rows.join(before, ["_part", *by])
    return joined.withColumns(
        {n: F.sum(v).over(inner) - F.col(v) + F.col(f"_{n}") for n, v in values.items()}
    ).drop("_part", *[f"_{n}" for n in values])


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = 1, window: int = WINDOW, unit: int = UNIT) -> DataFrame:
    """Pieces of all `docs(doc_id, text)`: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids end with `end`. Whole windows of it are sequences of their own. Of the rest,
    the multiple of `unit` tokens is a piece whose length takes part in the plan: combinations of
    two or three lengths that fill a window exactly, repeated as non-negative least squares
    against the length histogram (window / unit numbers) says. Pieces no combination takes, and
    the ends of fewer than `unit` tokens, follow each other in full windows. What is left of the
    last one goes into sequences of powers of two, so no sequence has padding.

    Null texts count as empty: the end id alone. Rows with a null or a repeated doc_id are packed
    as documents of their own. An empty table gives no piece. Other columns are not read. `window`
    must be a power of two and a multiple of `unit`.
    """
    if window & (window - 1) or window % unit or window // unit < 2:
        raise ValueError("window must be a power of two and a multiple of unit")
    spark = docs.sparkSession
    folder = scratch_folder(spark)
    schema = "key long, doc_id long, doc_tokens long, width int, ids binary"
    docs.select("doc_id", "text").mapInArrow(_encode(vocabulary, end), schema).write.option("compression", "zstd").parquet(folder)
    encoded = spark.read.schema(schema).parquet(folder)
    rest = F.col("doc_tokens") % window
    lengths = settle(
        encoded.select(
            "key", F.floor(F.col("doc_tokens") / window).alias("full"), F.floor(rest / unit).alias("units"),
            (rest % unit).alias("tail"), F.lit(0).alias("start"), "doc_tokens",
        )
    )
    units = window // unit
    counts = lengths.groupBy("units").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("full")).collect()
    histogram = np.zeros(units, dtype=np.int64)
    for row in counts:
        if row.units:
            histogram[row.units - 1] = row.n
    sequences = sum(row.full for row in counts)

    # slots: pieces number low..high-1 of a length are the q-th of a combination's sequences
    slots, used = [], np.zeros(units + 1, dtype=np.int64)
    for combo, repeats in plan_repeats(histogram) if histogram.any() else []:
        for q, length in enumerate(combo):
            slots.append((length, int(used[length]), int(used[length]) + repeats, sequences, sum(combo[:q]) * unit))
            used[length] += repeats
        sequences += repeats
    slot = "units long, low long, high long, first long, offset long"
    slots = F.broadcast(spark.createDataFrame(slots, slot))

    whole = _placed(lengths.where("full > 0"), [], {"first": "full"})
    whole = whole.select("key", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("k"), "first").select(
        "key", (F.col("k") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"),
        (F.col("first") + F.col("k")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    mains = lengths.where("units > 0").withColumn("one", F.lit(1))
    ranked = _placed(mains, ["units"], {"rank": "one"})
    inside = (ranked["units"] == slots["units"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    taken = settle(
        ranked.join(slots, inside, "left").select(
            "key", (F.col("full") * window).alias("start"), (ranked["units"] * unit).alias("length"),
            (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset",
        )
    )
    tails = lengths.where("tail > 0").select("key", (F.col("doc_tokens") - F.col("tail")).alias("start"), F.col("tail").alias("length"))
    stream = settle(_placed(taken.where("sequence_id IS NULL").select("key", "start", "length").union(tails), [], {"at": "length"}))
    total = stream.agg(F.sum("length")).first()[0] or 0
    full = total // window
    bounds, low = [], 0
    for bit in range(window.bit_length() - 2, -1, -1):
        if (total % window) >> bit & 1:
            bounds.append((low, low + (1 << bit)))
            low += 1 << bit

    def bin_of(number, low, high):
        return F.struct(number.cast("long").alias("bin"), low.cast("long").alias("low"), high.cast("long").alias("high"))

    last = [bin_of(F.lit(full + i), F.lit(full * window + a), F.lit(full * window + b)) for i, (a, b) in enumerate(bounds)]
    nothing = F.array().cast("array<struct<bin:bigint,low:bigint,high:bigint>>")
    last = F.array(*last) if last else nothing
    span = F.sequence(F.floor(F.col("at") / window), F.floor((F.col("at") + F.col("length") - 1) / window))
    bins = F.flatten(F.transform(span, lambda w: F.when(w < full, F.array(bin_of(w, w * window, (w + 1) * window))).otherwise(last)))
    low, high = F.greatest("at", "bin.low"), F.least(F.col("at") + F.col("length"), F.col("bin.high"))
    rest = (
        stream.withColumn("bin", F.explode(bins))
        .where(low < high)
        .select(
            "key", (F.col("start") + low - F.col("at")).alias("start"), (high - low).alias("length"),
            (F.col("bin.bin") + sequences).alias("sequence_id"), (low - F.col("bin.low")).alias("offset"),
        )
    )
    pieces = reduce(DataFrame.union, [whole, taken.where("sequence_id IS NOT NULL"), rest])
    piece = F.struct("start", "length", "sequence_id", "offset")
    cuts = pieces.groupBy("key").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return encoded.join(cuts, "key").mapInArrow(_cut, out)
