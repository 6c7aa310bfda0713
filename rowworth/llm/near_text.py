"""MinHash near-duplicates: one-permutation sketches, banded buckets, star-shaped candidate links."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowworth.llm.components import components
from rowworth.llm.keeping import Keeper
from rowworth.llm.text import ORDER, SALT, U64, batches, mix, shingles, word_hashes
from rowworth.operators.ordering import running_totals
from rowworth.session import broadcast_if_small, settle

BANDS = 30
ROWS = 5
# buckets up to this many open nodes are compared pair by pair, larger ones in blocks
FEW = 16
# shingles of the nodes in one block
BLOCK_SHINGLES = 1 << 19
# columns of the incidence matrices that a task holds at a time
_COLUMNS = 4096
_BINS = BANDS * ROWS
# the order in which an empty bin tries the others, fixed for all texts
_PROBES = np.array([np.random.RandomState(7919 + b).permutation(_BINS) for b in range(_BINS)])
_BIN_EDGES = np.arange(_BINS + 1, dtype=U64) << U64(32)


def one_permutation_sketch(values: np.ndarray) -> np.ndarray:
    """The smallest hash in each bin; an empty bin copies the first full one of its probe order."""
    hashed = mix(values + SALT)
    bins = ((hashed >> U64(32)) * U64(_BINS)) >> U64(32)
    keys = np.sort((bins << U64(32)) | (hashed & U64(0xFFFFFFFF)))
    at = np.searchsorted(keys, _BIN_EDGES)
    full = at[1:] > at[:-1]
    sketch = np.zeros(_BINS, dtype=U64)
    sketch[full] = keys[at[:-1][full]]
    empty = np.flatnonzero(~full)
    if len(empty):
        probes = _PROBES[empty]
        source = probes[np.arange(len(empty)), full[probes].argmax(axis=1)]
        sketch[empty] = sketch[source]
    return sketch


def band_keys(sketch: np.ndarray) -> np.ndarray:
    rows = sketch.reshape(BANDS, ROWS)
    return mix((rows * ORDER[:ROWS]).sum(axis=1, dtype=U64) + np.arange(BANDS, dtype=U64) * SALT).view(np.int64)


def _sketches(size: int, carry: tuple[str, ...]):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, *others in batches(["doc_id", "text", *carry], rows):
            counts, digests, keys = [], [], []
            for text in texts:
                found = np.unique(shingles(word_hashes(text), size))
                counts.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                keys.append(band_keys(one_permutation_sketch(found)).tolist() if len(found) else None)
            yield pa.record_batch(
                {
                    "doc_id": pa.array(ids, pa.int64()),
                    "n_shingles": pa.array(counts, pa.int64()),
                    "digest": pa.array(digests, pa.binary()),
                    "bands": pa.array(keys, pa.list_(pa.int64())),
                    **{name: pa.array(values, pa.int64()) for name, values in zip(carry, others)},
                }
            )

    return run


def _sets(size: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in batches(["text"], rows):
            found = [np.unique(shingles(word_hashes(t), size)).tobytes() for t in texts]
            names = [hashlib.blake2b(f, digest_size=16).digest() for f in found]
            yield pa.record_batch({"node": pa.array(names, pa.binary()), "words": pa.array(found, pa.binary())})

    return run


def _sets_of(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, words) of `nodes(node, rep)`: the set of a text is made from the row of the smallest doc_id that has it."""
    reps = broadcast_if_small(nodes.select(F.col("rep").alias("doc_id")).distinct())
    sets = docs.join(reps, "doc_id", "left_semi").select("text").mapInArrow(_sets(size), "node binary, words binary")
    # rows that share a doc_id have other sets, too
    return sets.join(broadcast_if_small(nodes.select("node").distinct()), "node", "left_semi").dropDuplicates(["node"])


def _overlaps(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact intersections; the hub's set stays decoded while its rows follow each other."""
    hub_raw, hub = b"", np.empty(0, dtype=U64)
    for a, b, left, right in batches(["a", "b", "left", "right"], rows):
        same = []
        for x, y in zip(left, right):
            if x != hub_raw:
                hub_raw, hub = x, np.frombuffer(x, dtype=U64)
            other = np.frombuffer(y, dtype=U64)
            same.append(len(np.intersect1d(hub, other, assume_unique=True)))
        yield pa.record_batch({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "same": pa.array(same, pa.int64())})


def _confirm(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of `pairs(a, b)` for which 100 * intersection >= percent * union, by their full sets."""
    n = nodes.select("node", "rep", "n")
    fit = (
        pairs.join(n.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("rep").alias("rep_a")), "a")
        .join(n.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("rep").alias("rep_b")), "b")
        .where(F.greatest("n_a", "n_b") * percent <= F.least("n_a", "n_b") * 100)
    )
    fit = settle(fit)
    ends = fit.select(F.col("a").alias("node"), F.col("rep_a").alias("rep")).union(fit.select("b", "rep_b")).distinct()
    sets = settle(_sets_of(docs, ends, size))
    joined = fit.join(sets.select(F.col("node").alias("b"), F.col("words").alias("right")), "b").join(
        sets.select(F.col("node").alias("a"), F.col("words").alias("left")), "a"
    )
    found = joined.select("a", "b", "left", "right").mapInArrow(_overlaps, "a binary, b binary, same long")
    counted = found.join(fit.select("a", "b", "n_a", "n_b"), ["a", "b"])
    union = F.col("n_a") + F.col("n_b") - F.col("same")
    return counted.where(F.col("same") * 100 >= union * percent).select("a", "b")


def _packed(table: pa.Table) -> pa.Table:
    """The nodes of one block as one row."""
    lists = {new: pa.array([table.column(old).to_pylist()], pa.list_(pa.binary())) for new, old in (("nodes", "node"), ("labels", "component"), ("sets", "words"))}
    return pa.table({"block": table.column("block").slice(0, 1), **lists})


def linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of `left` are alike enough to which of `right`: products of incidence matrices over the words both sides have."""

    def flat(sets):
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    (words_a, row_a), (words_b, row_b) = flat(left), flat(right)
    both = np.intersect1d(words_a, words_b)

    def placed(words, row):
        at = np.minimum(np.searchsorted(both, words), max(len(both) - 1, 0))
        there = both[at] == words if len(both) else np.zeros(len(words), dtype=bool)
        order = np.argsort(at[there], kind="stable")
        return at[there][order], row[there][order]

    (at_a, row_a), (at_b, row_b) = placed(words_a, row_a), placed(words_b, row_b)
    same = np.zeros((len(left), len(right)), dtype=np.float64)
    for low in range(0, len(both), _COLUMNS):
        parts = []
        for at, row, count in ((at_a, row_a, len(left)), (at_b, row_b, len(right))):
            first, last = np.searchsorted(at, [low, low + _COLUMNS])
            part = np.zeros((count, min(_COLUMNS, len(both) - low)), dtype=np.float32)
            part[row[first:last], at[first:last] - low] = 1
            parts.append(part)
        same += parts[0] @ parts[1].T
    sizes_a, sizes_b = (np.array([len(s) for s in sets], dtype=np.float64) for sets in (left, right))
    return same * 100 >= (sizes_a[:, None] + sizes_b[None, :] - same) * percent


def _forest(percent: int):
    """A spanning forest, over the components known so far, of the links between two blocks."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["nodes_a", "labels_a", "sets_a", "nodes_b", "labels_b", "sets_b"]
        for nodes_a, labels_a, sets_a, nodes_b, labels_b, sets_b in (
            tuple(c[0] for c in part) for part in batches(columns, rows, 1)
        ):
            hits = linked([np.frombuffer(w, dtype=U64) for w in sets_a], [np.frombuffer(w, dtype=U64) for w in sets_b], percent)
            _, label = np.unique(np.array([l.hex() for l in labels_a + labels_b]), return_inverse=True)
            top, own, others = list(range(len(label))), label[: len(nodes_a)], label[len(nodes_a) :]
            i, j = np.nonzero(hits & (own[:, None] != others[None, :]))
            _, once = np.unique(own[i] * len(label) + others[j], return_index=True)
            ends_a, ends_b = [], []

            def root(x):
                while top[x] != x:
                    top[x] = top[top[x]]
                    x = top[x]
                return x

            for x, y, k in zip(own[i[once]].tolist(), others[j[once]].tolist(), once.tolist()):
                x, y = root(x), root(y)
                if x != y:
                    top[max(x, y)] = min(x, y)
                    ends_a.append(nodes_a[i[k]])
                    ends_b.append(nodes_b[j[k]])
            yield pa.record_batch({"a": pa.array(ends_a, pa.binary()), "b": pa.array(ends_b, pa.binary())})

    return run


def _links_in_blocks(docs: DataFrame, open_rows: DataFrame, size: int, percent: int, keeper: Keeper) -> DataFrame:
    """Links between the nodes of `open_rows(bucket, node, rep, n, component, home)` that share a bucket, as forests of block pairs.

    Nodes are put in order by their largest bucket and cut into blocks by the size of their sets, so
    a bucket lies in few blocks; two blocks are compared if some bucket has nodes in both.
    """
    nodes = open_rows.select("node", "rep", "n", "component", "home").dropDuplicates(["node"])
    laid = running_totals(nodes, ["home", "node"], {"upto": "n"})
    laid = keeper.keep(laid.withColumn("block", F.floor((F.col("upto") - 1) / BLOCK_SHINGLES)))
    words = _sets_of(docs, laid, size)
    blocks = keeper.keep(
        laid.select("block", "node", "component").join(words, "node").groupBy("block")
        .applyInArrow(_packed, "block long, nodes array<binary>, labels array<binary>, sets array<binary>")
    )
    places = keeper.keep(open_rows.select("bucket", "node").join(laid.select("node", "block"), "node").select("bucket", "block").distinct())
    pairs = places.select("bucket", F.col("block").alias("i")).join(places.select("bucket", F.col("block").alias("j")), "bucket")
    pairs = pairs.where("i <= j").select("i", "j").distinct()

    def side(name, key):
        return blocks.select(F.col("block").alias(key), *[F.col(c).alias(f"{c}_{name}") for c in ("nodes", "labels", "sets")])

    whole = pairs.join(side("a", "i"), "i").join(side("b", "j"), "j")
    return whole.drop("i", "j").mapInArrow(_forest(percent), "a binary, b binary")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (and `carry`, long columns) for every row of `docs(doc_id, text)`.

    A text's set holds its distinct shingles of `size` words (ASCII white space splits words, A-Z
    are lowered; a shorter text is one shingle). Documents are linked when 100 * intersection >=
    percent * union; component_id is the smallest doc_id reachable and that document is kept.

    Texts with equal sets become one node first, named by the digest of its set. Nodes whose sketches agree in a whole band share
    a bucket. First each node is linked with the smallest node of its largest bucket, then every bucket
    whose nodes are not yet in one component is linked as a star around a node of its first
    component, so pairs grow with the rows of buckets, never with their squares. What can still link lies in buckets with
    several open nodes: up to FEW are paired; larger buckets are cut into blocks, and a
    task compares two blocks by products of incidence matrices and gives a spanning forest of the
    links it finds. No pair that matters is dropped.
    At the threshold a pair misses all 30 bands of 5 with a chance of 7e-6.

    Null and empty texts have no shingles, are linked with nothing and kept. Rows with a null
    doc_id get the component of a row with an id and an equal set, or else a null one and are kept. Repeated rows get equal results; rows sharing a
    doc_id but not a text are each judged by their own text. Other columns are not read.
    """
    carried = docs.select("doc_id", "text", *carry)
    docs = docs.select("doc_id", "text")
    schema = ", ".join(["doc_id long, n_shingles long, digest binary, bands array<long>", *(f"`{c}` long" for c in carry)])
    keeper = Keeper(docs.sparkSession)
    sketches = settle(carried.mapInArrow(_sketches(size, carry), schema))
    named = sketches.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    nodes = settle(
        named.groupBy(F.col("digest").alias("node"))
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    )
    links = None

    def grown(found: DataFrame) -> DataFrame:
        nonlocal links
        links = keeper.keep(found if links is None else links.union(found))
        return components(links)

    def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
        return rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))

    exploded = nodes.select("node", "rep", "n", F.explode("bands").alias("bucket")).distinct()
    sizes = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("rep", "node")).alias("first")).where("rows > 1")
    members = keeper.keep(exploded.join(sizes, "bucket").select("bucket", "node", "rep", "n", "rows", F.col("first.node").alias("first")))
    # the largest bucket of each node
    home = members.groupBy("node").agg(F.max(F.struct("rows", "bucket", "first")).alias("home"))
    tested = keeper.keep(home.where("home.first <> node").select(F.col("home.first").alias("a"), F.col("node").alias("b")))
    labels = grown(_confirm(docs, nodes, tested, size, percent))

    marked = keeper.keep(labelled(members.select("bucket", "node", "rep", "n"), labels))
    buckets = marked.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct("component", "rep", "node")).alias("hub")
    ).where("low < high").select("bucket", F.col("hub.node").alias("hub"), "low")
    open_rows = keeper.keep(marked.join(buckets, "bucket"))
    stars = open_rows.where("component <> low").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    stars = keeper.keep(stars.join(tested, ["a", "b"], "left_anti"))
    if not stars.isEmpty():
        labels = grown(_confirm(docs, nodes, stars, size, percent))
        # the hubs have met all nodes of other components than theirs
        rest = keeper.keep(labelled(open_rows.where("node <> hub").select("bucket", "node", "rep", "n"), labels))
        unfinished = rest.groupBy("bucket").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("rows")
        ).where("low < high").select("bucket", "rows")
        rest = rest.join(unfinished, "bucket")
        homes = rest.groupBy("node").agg(F.max(F.struct("rows", "bucket")).alias("home"))
        rest = keeper.keep(
            rest.join(homes.select("node", F.col("home.bucket").alias("home"), (F.col("home.rows") > FEW).alias("many")), "node")
        )
        few = rest.where(F.col("rows") <= FEW)
        left = few.select("bucket", F.col("node").alias("a"), F.col("many").alias("many_a"), F.col("component").alias("of_a"))
        right = few.select("bucket", F.col("node").alias("b"), "many", "component")
        pairs = left.join(right, "bucket").where("a < b AND of_a <> component AND NOT (many_a AND many)").select("a", "b").distinct()
        if not rest.isEmpty():
            found, blocks = _confirm(docs, nodes, pairs, size, percent), rest.where("many")
            if not blocks.isEmpty():
                found = found.union(_links_in_blocks(docs, blocks, size, percent, keeper))
            labels = grown(found)
    component = nodes.select("node", "rep").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    component = settle(component)
    least = component.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_set = component.join(least, "component").select(F.col("node").alias("digest"), "component_id")
    whole = sketches.join(settle(of_set), "digest", "left")
    keeper.clear()
    found = F.coalesce("component_id", "doc_id")
    return whole.select("doc_id", *carry, "n_shingles", found.alias("component_id"), F.col("doc_id").eqNullSafe(found).alias("kept"))
