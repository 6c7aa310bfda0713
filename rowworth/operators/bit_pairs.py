"""Pairs of fingerprints above a Tanimoto threshold, without a row for any other pair.

Sets become bitmaps, sorted by size and packed into pieces. Pieces whose sizes can be similar meet in a task, which
counts shared bits a few words at a time: what the rest of the words could add decides which pairs are counted on.
Only similar pairs leave the task, so what is written and shuffled grows with the rows and the pairs found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowworth.session import settle

#: bits below this number have a slot each; others are hashed into SLOTS, and sets that seem similar are compared
MOST_SLOTS, SLOTS = 4096, 1024
# rows of a piece, and rows of one side that are counted against a whole piece at once
_PIECE, _TILE = 1024, 64
# words that are counted for all pairs, and for those left
_STEP = 4


def _pack(df: DataFrame, slots: int, hashed: bool) -> DataFrame:
    """`(piece, low, high, ids, sizes, own, words)`: rows by size, as numpy writes them; `own` counts slots in use."""
    words = slots // 64

    def run(batches):
        for batch in batches:
            ids, sets = batch.column(0).to_numpy(), batch.column(1)
            ends, flat = sets.offsets.to_numpy(), sets.values.to_numpy(zero_copy_only=False)
            flat = flat[ends[0] : ends[-1]].astype(np.int64)
            ends = ends - ends[0]
            sizes = np.diff(ends)
            at = (_mix(flat.view(np.uint64)) % np.uint64(slots)).astype(np.int64) if hashed else flat
            for low in range(0, len(ids), _PIECE):
                high = min(low + _PIECE, len(ids))
                bitmap = np.zeros((high - low, slots), dtype=np.uint8)
                bitmap[np.repeat(np.arange(high - low), sizes[low:high]), at[ends[low] : ends[high]]] = 1
                packed = np.packbits(bitmap, axis=1).view(np.uint64).reshape(high - low, words)
                fields = [ids[low:high], sizes[low:high].astype(np.int32), bitmap.sum(axis=1, dtype=np.int32), packed.T]
                yield pa.record_batch(
                    [pa.array([v], pa.int64()) for v in (int(batch.column(2)[low].as_py()), int(sizes[low]), int(sizes[high - 1]))]
                    + [pa.array([np.ascontiguousarray(f).tobytes()], pa.binary()) for f in fields],
                    names=["piece", "low", "high", "ids", "sizes", "own", "words"],
                )

    placed = df.withColumn("_n", F.size("bits")).repartitionByRange("_n", "id").sortWithinPartitions("_n", "id")
    numbered = placed.select("id", "bits", F.monotonically_increasing_id().alias("piece"))
    return numbered.mapInArrow(run, "piece bigint, low bigint, high bigint, ids binary, sizes binary, own binary, words binary")


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambled 64 bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def fingerprint_classes(df: DataFrame, bits: str = "bits", id_col: str = "id") -> DataFrame:
    """`(id, class_id, bits)`: rows with equal fingerprints have the smallest of their ids as class.

    Bits are distinct and sorted. A row whose fingerprint is null or empty is a class of its own without bits.
    """
    clean = F.array_sort(F.array_distinct(F.filter(bits, lambda b: b.isNotNull()))).cast("array<bigint>")
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), clean.alias("bits"))
    rows = rows.withColumn("bits", F.when(F.size("bits") > 0, F.col("bits")))
    digest = F.sha2(F.array_join(F.col("bits").cast("array<string>"), ","), 256)
    rows = settle(rows.withColumn("_digest", digest))
    # one small row per distinct fingerprint, summed before the shuffle, however many copies there are
    first = rows.where("bits IS NOT NULL").groupBy("_digest").agg(F.min("id").alias("class_id"))
    joined = rows.join(first, "_digest", "left")
    return joined.select("id", F.coalesce("class_id", "id").alias("class_id"), "bits")


def _near(mine: tuple, theirs: tuple, threshold: float, apart: bool):
    """(places in `mine`, places in `theirs`, most bits they can share) of the pairs that can be similar, tile by tile."""
    (sizes, own, words), (their_sizes, their_own, their_words) = mine, theirs
    share = threshold / (1 + threshold)
    kind = np.int16 if max(sizes[-1], their_sizes[-1]) < 1 << 14 else np.int32
    least, their_least = (np.floor(share * n + 1e-9).astype(kind) for n in (sizes, their_sizes))
    # what the words not counted yet, and the bits beyond the slots in use, can add
    rest, their_rest = (
        (n - np.bitwise_count(w[:_STEP]).sum(axis=0, dtype=np.int32)).astype(kind) for n, w in ((sizes, words), (their_sizes, their_words))
    )
    for low in range(0, len(sizes), _TILE):
        part = slice(low, low + _TILE)
        shared = np.zeros((len(sizes[part]), len(their_sizes)), dtype=kind)
        for a, b in zip(words[:_STEP], their_words[:_STEP]):
            shared += np.bitwise_count(a[part, None] & b)
        a, b = least[part, None], their_least
        can = (shared >= a - rest[part, None] + b) & (shared >= a + (b - their_rest))
        if not apart:
            # within one piece each pair is met once
            can &= np.arange(low, low + len(can))[:, None] < np.arange(len(their_sizes))
        i, j = np.nonzero(can)
        shared = shared[i, j].astype(np.int64)
        i += low
        needed = share * (sizes[i].astype(np.int64) + their_sizes[j]) - 1e-6
        left, their_left = rest[i].astype(np.int64), their_rest[j].astype(np.int64)
        for at in range(_STEP, len(words), _STEP):
            if not len(i):
                break
            for a, b in zip(words[at : at + _STEP], their_words[at : at + _STEP]):
                x, y = a[i], b[j]
                shared += np.bitwise_count(x & y)
                left -= np.bitwise_count(x)
                their_left -= np.bitwise_count(y)
            keep = shared + np.minimum(left, their_left) >= needed
            i, j, shared, needed, left, their_left = (v[keep] for v in (i, j, shared, needed, left, their_left))
        if len(i):
            yield i, j, shared + np.minimum(left, their_left)


def similar_pairs(left: DataFrame, right: DataFrame | None = None, threshold: float = 0.8) -> DataFrame:
    """`(id, ref_id, similarity)` of every pair of `(id, bits)` rows with a Tanimoto similarity of at least `threshold`.

    Without `right` each pair of rows of `left` appears once, the smaller id first. Ids are distinct on a side, bits
    are distinct within a row (collapse copies with `fingerprint_classes` first, else each pair of copies is a row).
    Rows with null or empty bits, or without an id, are similar to nothing. Exact: no pair is lost and none below the
    threshold is found. Time grows with the pairs of rows of similar size, at a few nanoseconds each.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0, at most at 1")
    alone = right is None
    sides = [
        side.where((F.size("bits") > 0) & F.col("id").isNotNull()).select(F.col("id").cast("bigint"), F.col("bits").cast("array<bigint>"))
        for side in ([left] if alone else [left, right])
    ]
    ends = [side.agg(F.min(F.array_min("bits")), F.max(F.array_max("bits"))).first() for side in sides]
    least, most = min(e[0] or 0 for e in ends), max(e[1] or 0 for e in ends)
    hashed = least < 0 or most >= MOST_SLOTS
    slots = SLOTS if hashed else (most // 64 + 1) * 64
    packed = [settle(_pack(side, slots, hashed)) for side in sides]
    cores = left.sparkSession.sparkContext.defaultParallelism
    mine = packed[0].repartition(4 * cores, "piece")
    theirs = packed[-1].select(*[F.col(c).alias(f"ref_{c}") for c in packed[-1].columns]).coalesce(max(1, cores // 2))
    alike = (F.col("high") >= threshold * F.col("ref_low") - 1e-6) & (F.col("ref_high") >= threshold * F.col("low") - 1e-6)
    alike = alike & (F.col("piece") <= F.col("ref_piece")) if alone else alike
    met = mine.hint("shuffle_replicate_nl").join(theirs, alike)

    def run(batches):
        def opened(fields):
            ids, sizes, own, words = (np.frombuffer(f.as_buffer(), dtype=t) for f, t in zip(fields, (np.int64, np.int32, np.int32, np.uint64)))
            return ids, (sizes, own, words.reshape(-1, len(ids)))

        for batch in batches:
            for row in zip(*batch.columns):
                (ids, a), (ref_ids, b) = opened(row[3:7]), opened(row[10:])
                for i, j, shared in _near(a, b, threshold, not alone or row[0].as_py() != row[7].as_py()):
                    one, other = ids[i], ref_ids[j]
                    similarity = shared / (a[0][i].astype(np.int64) + b[0][j] - shared)
                    keep = np.full(len(i), True) if hashed else similarity >= threshold
                    if alone:
                        one, other = np.minimum(one, other), np.maximum(one, other)
                        keep &= one != other
                    yield pa.record_batch([pa.array(v[keep]) for v in (one, other, similarity)], names=["id", "ref_id", "similarity"])

    pairs = met.mapInArrow(run, "id bigint, ref_id bigint, similarity double")
    if not hashed:
        return pairs
    # several bits may share a slot: the sets themselves decide
    fetched = pairs.select("id", "ref_id").join(sides[0].withColumnRenamed("bits", "_mine"), "id").join(
        sides[-1].select(F.col("id").alias("ref_id"), F.col("bits").alias("_theirs")), "ref_id"
    )
    shared = F.size(F.array_intersect("_mine", "_theirs"))
    similarity = F.col("_shared") / (F.size("_mine") + F.size("_theirs") - F.col("_shared"))
    judged = fetched.withColumn("_shared", shared).select("id", "ref_id", similarity.alias("similarity"))
    return judged.where(F.col("similarity") >= threshold)
