"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside them."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowworth.llm.components import components
from rowworth.session import settle

# vectors the centres are fitted on, at most, whatever the size of the table
FIT_ROWS = 20_000
# vectors that are multiplied at a time with those of a piece; pieces and, on average, cells hold TILES times as many
BLOCK, TILES = 512, 4
# bytes of a piece's vectors, and of a part of the pieces; a task holds one part and meets it with another
PIECE_BYTES, PART_BYTES = 1 << 20, 8 << 20
MOST_CELLS = 256
_TINY = 1e-9


def spherical_kmeans(rows: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Unit centres; starts at every so many-th row and keeps a centre that loses all its rows."""
    centres = rows[np.linspace(0, len(rows) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        home = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, rows)
        norms = np.linalg.norm(sums, axis=1)
        centres[norms > 0] = sums[norms > 0] / norms[norms > 0, None]
    return centres


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; a row's result does not depend on the rows beside it."""
    x = vectors.astype(np.float64)
    # scaled first, so that squares neither overflow nor vanish
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.vecdot(x, x))[:, None]


def _directions(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, vectors, unit vectors) of the rows that have a direction, for each width."""
    wide = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(wide, dtype=np.int64) - wide
    for dims in np.unique(wide[wide > 0]):
        at = np.flatnonzero(wide == dims)
        x = flat[starts[at][:, None] + np.arange(dims)]
        # null numbers have become NaN
        sound = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if sound.any():
            yield at[sound], x[sound], _scaled(x[sound])


def _mark(unit: np.ndarray) -> bytes:
    """What stands for a direction in keys."""
    return hashlib.blake2b(unit.tobytes(), digest_size=16).digest()


def _marks(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        marks: list[bytes | None] = [None] * batch.num_rows
        dims = [0] * batch.num_rows
        for at, _, units in _directions(batch.column("embedding")):
            for i, unit in zip(at, units):
                marks[i], dims[i] = _mark(unit), len(unit)
        more = [pa.array(marks, pa.binary()), pa.array(dims, pa.int32())]
        yield pa.record_batch([batch.column("vec_id"), batch.column("label"), *more], names=["vec_id", "label", "mark", "dims"])


def _drawn(share: float):
    """Unit vectors of about this share of the directions."""
    below = min(1 << 32, int(share * (1 << 32)) + 1)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = {}
            for _, _, units in _directions(batch.column("embedding")):
                for unit in units:
                    mark = _mark(unit)
                    if int.from_bytes(mark[:4]) < below:
                        found[mark] = unit
            fields = [list(found), [len(u) for u in found.values()], [u.tobytes() for u in found.values()]]
            yield pa.record_batch([pa.array(f, t) for f, t in zip(fields, (pa.binary(), pa.int32(), pa.binary()))], names=["mark", "dims", "unit"])

    return run


def _placed(centres: dict[int, np.ndarray], reach: float):
    """Each vector with its home cell and, as bits, the cells whose border is less than `reach` away;
    equal directions of a batch and label are one row."""
    gaps = {dims: np.linalg.norm(c[:, None, :] - c[None, :, :], axis=2) for dims, c in centres.items()}
    names = ["label", "dims", "home", "mark", "node", "rows", "seen", "vector"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ids, labels = batch.column("vec_id").to_pylist(), batch.column("label").to_pylist()
            found: dict[tuple, list] = {}
            for at, vectors, units in _directions(batch.column("embedding")):
                dims = units.shape[1]
                c = centres[dims]
                # one product at a time, so that equal directions have one home in whatever batch they are
                dots = np.vecdot(units[:, None, :], c[None, :, :])
                best = dots.argmax(axis=1)
                far = (dots[np.arange(len(at)), best][:, None] - dots) / np.maximum(gaps[dims][best], 1e-12)
                seen = np.packbits(far <= reach + _TINY, axis=1)
                for i, vector, unit, home, bits in zip(at, vectors, units, best, seen):
                    mark = _mark(unit)
                    row = found.get((labels[i], mark))
                    if row is None:
                        found[labels[i], mark] = [labels[i], dims, home, mark, ids[i], 1, bits.tobytes(), vector.tobytes()]
                    else:
                        row[4], row[5] = min(row[4], ids[i]), row[5] + 1
            if found:
                yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*found.values()), types)], names=names)

    return run


def _pieces(most: int, most_bytes: int):
    """Rows in order of label, width, home cell and direction in pieces of one cell; equal directions, which follow
    each other, become one member."""

    def piece(key: tuple, members: list) -> pa.RecordBatch:
        label, dims, home = key
        _, nodes, rows, seen, vectors = zip(*members)
        bits = np.frombuffer(b"".join(seen), dtype=np.uint8).reshape(len(seen), -1)
        visited = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits, axis=0))).tolist()
        fields = [label, dims, home, visited, np.array(nodes, dtype=np.int64).tobytes(), np.array(rows, dtype=np.int64).tobytes(), bits.tobytes(), b"".join(vectors)]
        types = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        names = ["label", "dims", "home", "visited", "nodes", "rows", "seen", "vectors"]
        return pa.record_batch([pa.array([f], t) for f, t in zip(fields, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members = None, []
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("label", "dims", "home", "mark", "node", "rows", "seen", "vector")]
            for label, dims, home, mark, node, rows, seen, vector in zip(*columns):
                key = (label, dims, home)
                if key == at and members[-1][0] == mark:
                    members[-1][1:3] = min(members[-1][1], node), members[-1][2] + rows
                    continue
                if key != at or len(members) >= max(1, min(most, most_bytes // len(vector))):
                    if members:
                        yield piece(at, members)
                    at, members = key, []
                members.append([mark, node, rows, seen, vector])
        if members:
            yield piece(at, members)

    return run


def _linked(x: np.ndarray, y: np.ndarray, threshold: float, block: int) -> np.ndarray:
    """Which rows of `x` and `y` have a product of at least `threshold`."""
    linked = np.empty((len(x), len(y)), dtype=bool)
    for at in range(0, len(x), block):
        dots = x[at : at + block] @ y.T
        part = np.greater_equal(dots, threshold - _TINY, out=linked[at : at + block])
        if not part.any():
            continue
        # the product of blocks may round another way than a sum of its own
        for i, j in zip(*np.nonzero(part & (dots <= threshold + _TINY))):
            part[i, j] = math.fsum(x[at + i] * y[j]) >= threshold
    return linked


def _products(threshold: float, block: int, kind: type):
    def side(home, nodes, rows, seen, vectors):
        ids = np.frombuffer(nodes.as_buffer(), dtype=np.int64)
        weight = np.frombuffer(rows.as_buffer(), dtype=np.int64)
        bits = np.unpackbits(np.frombuffer(seen.as_buffer(), dtype=np.uint8).reshape(len(ids), -1), axis=1).astype(bool)
        return ids, weight, home.as_py(), bits, _scaled(np.frombuffer(vectors.as_buffer(), dtype=kind).reshape(len(ids), -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, *fields in zip(*batch.columns):
                same = same.as_py()
                a, rows_a, home_a, seen_a, x = side(*fields[:5])
                b, rows_b, home_b, seen_b, y = side(*fields[5:])
                if home_a == home_b:
                    linked = _linked(x, y, threshold, block)
                else:
                    # of two linked vectors one comes near to the other's cell
                    come, met = seen_a[:, home_b], seen_b[:, home_a]
                    linked = np.zeros((len(a), len(b)), dtype=bool)
                    linked[come] = _linked(x[come], y, threshold, block)
                    linked[np.ix_(~come, met)] = _linked(x[~come], y[met], threshold, block)
                if same:
                    np.fill_diagonal(linked, False)
                    linked &= linked.T
                i, j = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
                if not len(i):
                    continue
                part = linked[np.ix_(i, j)]
                at, bt, top = a[i], b[j], np.iinfo(np.int64).max
                low_a, low_b = at.copy(), bt.copy()
                while True:
                    new_a = np.minimum(low_a, np.where(part, low_b[None, :], top).min(axis=1))
                    new_b = np.minimum(low_b, np.where(part, new_a[:, None], top).min(axis=0))
                    if (new_a == low_a).all() and (new_b == low_b).all():
                        break
                    low_a, low_b = new_a, new_b
                out = [(at, low_a, part @ rows_b[j])] if same else [(at, low_a, part @ rows_b[j]), (bt, low_b, rows_a[i] @ part)]
                node, low, others = (np.concatenate(v) for v in zip(*out))
                yield pa.record_batch({"node": pa.array(node, pa.int64()), "low": pa.array(low, pa.int64()), "others": pa.array(others, pa.int64())})

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93, fit_rows: int = FIT_ROWS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors(vec_id, embedding, label)`.

    Two rows are linked when their labels are equal and the cosine in double precision is at
    least `threshold`. Equal directions of a label are one node that counts its rows, so a hot
    vector meets itself in an aggregate. Centres are fitted by spherical k-means on at most
    `fit_rows` vectors; every vector lies in its cell and notes the cells whose
    border lies within half the linking angle: of two linked vectors of different cells one is
    that near to the border between them, so no link is lost whatever the centres. Cells are cut
    into pieces, written once, and pairs of pieces are the unit of work: those of one cell, and those of two of which one
    has vectors near the other, by these vectors only. Tasks read them where they lie, so no vector is written once
    for each cell or partner. A product reports a count and a smallest neighbour for a vector, not
    its pairs. The smallest vec_id of a group is its representative.

    Vectors that are null, empty, zero or hold null or non-finite numbers, and rows with a null
    label or vec_id, are linked with nothing and kept; a null vec_id has a null component.
    Vectors of different widths are never linked. Repeated rows link with each other and get
    equal results; rows sharing a vec_id but not a vector count as one vector.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    kind = np.float32 if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64
    embedding = F.col("embedding").cast("array<float>" if kind is np.float32 else "array<double>")
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), embedding.alias("embedding"))
    marks = settle(rows.mapInArrow(_marks, "vec_id long, label string, mark binary, dims int"))
    heads = settle(
        marks.where("vec_id IS NOT NULL AND label IS NOT NULL AND mark IS NOT NULL")
        .groupBy("label", "mark")
        .agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("rows"), F.first("dims").alias("dims"))
    )
    sums = heads.agg(F.count(F.lit(1)), F.count_distinct("label"), F.collect_set("dims"), F.sum(F.col("dims").cast("long")))
    total, labels, widths, numbers = sums.first()
    cells = max(1, min(MOST_CELLS, round(total / max(labels, 1) / (TILES * block))))
    sound = rows.where("vec_id IS NOT NULL AND label IS NOT NULL")
    drawn = sound.mapInArrow(_drawn(min(1.0, fit_rows / max(total, 1))), "mark binary, dims int, unit binary")
    drawn = settle(drawn.dropDuplicates(["mark"])) if widths else None
    centres: dict[int, np.ndarray] = {}
    for dims in widths:
        fit = [np.frombuffer(r.unit, dtype=np.float64) for r in drawn.where(F.col("dims") == dims).orderBy("mark").limit(fit_rows).select("unit").collect()]
        centres[dims] = spherical_kmeans(np.stack(fit), min(cells, len(fit))) if fit else np.eye(1, dims)
    reach = math.sin(math.acos(threshold) / 2)
    schema = "label string, dims int, home int, mark binary, node long, rows long, seen binary, vector binary"
    # cells are dealt out by a hash and cut where they are large, so that any two parts have some work together
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    parts = max(math.ceil(math.sqrt(4 * cores)), -(-(numbers or 0) * np.dtype(kind).itemsize // PART_BYTES))
    order = ["spot", "label", "dims", "home", "mark"]
    placed = sound.mapInArrow(_placed(centres, reach), schema).withColumn("spot", F.xxhash64("label", "dims", "home"))
    placed = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = "label string, dims int, home int, visited array<int>, nodes binary, rows binary, seen binary, vectors binary"
    pieces = placed.mapInArrow(_pieces(TILES * block, PIECE_BYTES), schema).withColumn("piece", F.monotonically_increasing_id())
    pieces = settle(pieces).coalesce(parts)
    a, b = pieces.alias("a"), pieces.select(*[F.col(c).alias(f"{c}_b") for c in pieces.columns]).alias("b")
    near = F.expr("home = home_b OR array_contains(visited, home_b) OR array_contains(visited_b, home)")
    met = a.hint("shuffle_replicate_nl").join(b, F.expr("label = label_b AND dims = dims_b AND piece <= piece_b") & near)
    fields = ["home", "nodes", "rows", "seen", "vectors"]
    met = met.select(F.expr("piece = piece_b").alias("same"), *fields, *[f"{f}_b" for f in fields])
    found = settle(met.mapInArrow(_products(threshold, block, kind), "node long, low long, others long"))
    others = found.groupBy("node").agg(F.sum("others").alias("others"))
    tops = components(found.select(F.col("node").alias("a"), F.col("low").alias("b")))
    by_node = (
        heads.join(others, "node", "left")
        .join(tops, "node", "left")
        .select("label", "mark", (F.coalesce("others", F.lit(0)) + F.col("rows") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    )
    whole = marks.join(settle(by_node), ["label", "mark"], "left")
    component = F.coalesce("component_id", "vec_id")
    return whole.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
