"""Prefix trie of conversations: double arrays over ranges of turn paths, upper nodes merged across ranges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowworth.llm.text import batches
from rowworth.session import broadcast_if_small, settle

# a turn in a path: MD5 of role and text, then the text's bytes as a big-endian number
_TURN = 24
_EMPTY_HASH = hashlib.sha256().hexdigest()
# ids of conversations in one piece of a hash's input
_PIECE = 1000
_FREE = -1


def pack_double_array(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """BASE, CHECK, symbol and depth of each slot of a trie over sorted distinct sequences of dense ids.

    The child of slot s by id c lies in slot BASE[s] + c, and CHECK holds its parent there. Slot 0
    is the root. Single children take the next free slot; several go past the last one used, since
    their ids may lie apart, and the gaps fill with single ones.
    """
    lengths = np.array([len(s) for s in sequences], dtype=np.int64)
    size = int(lengths.sum()) + 2
    base, check = np.zeros(size, dtype=np.int64), np.full(size, _FREE, dtype=np.int64)
    symbol, depth = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int64)
    check[0] = 0
    state = np.zeros(len(sequences), dtype=np.int64)
    next_free, top = 1, 1
    for d in range(int(lengths.max()) if len(lengths) else 0):
        going = np.flatnonzero(lengths > d)
        ids = np.array([sequences[i][d] for i in going], dtype=np.int64)
        # sorted sequences: children of one slot follow each other, and so do equal ones
        fresh = np.ones(len(going), dtype=bool)
        fresh[1:] = (np.diff(state[going]) != 0) | (np.diff(ids) != 0)
        parent, child = state[going][fresh], ids[fresh]
        starts = np.flatnonzero(np.diff(parent, prepend=-1))
        for low, high in zip(starts, [*starts[1:], len(parent)]):
            if high - low == 1:
                while next_free < len(check) and check[next_free] != _FREE:
                    next_free += 1
                offset = next_free - int(child[low])
            else:
                offset = top - int(child[low:high].min())
            slots = child[low:high] + offset
            last = int(slots.max())
            if last >= len(check):
                more = max(len(check), last + 1 - len(check))
                base, depth = (np.concatenate([x, np.zeros(more, dtype=np.int64)]) for x in (base, depth))
                check, symbol = (np.concatenate([x, np.full(more, -1, dtype=np.int64)]) for x in (check, symbol))
            base[parent[low]] = offset
            check[slots], symbol[slots], depth[slots] = parent[low], child[low:high], d + 1
            top = max(top, last + 1)
        state[going] = base[state[going]] + ids
    return base, check, symbol, depth


def walk(base: np.ndarray, check: np.ndarray, sequence: np.ndarray) -> list[int]:
    """Slots from the root along `sequence`, as far as the trie goes."""
    path = [0]
    for c in sequence:
        slot = int(base[path[-1]] + c)
        if not 0 < slot < len(check) or check[slot] != path[-1]:
            break
        path.append(slot)
    return path


def _dense(paths: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Paths as dense turn ids, numbered where they first appear, and the text bytes of each id."""
    turns = np.frombuffer(b"".join(paths), dtype=[("key", "S16"), ("bytes", ">u8")])
    # S16 would lose trailing zeros: two integers name a turn
    pairs = np.frombuffer(b"".join(paths), dtype=">u8").reshape(-1, 3)
    _, first, named = np.unique(pairs[:, :2].astype(np.uint64), axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first)
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.arange(len(order))
    ids = number[named.reshape(-1)]
    cuts = np.cumsum([len(p) // _TURN for p in paths])[:-1]
    return np.split(ids, cuts), turns["bytes"][first[order]].astype(np.int64)


def _shard(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of one range of paths. Only those on the way to its first and last path can lie in others too."""
    paths, counts, least, ends = [], [], [], []
    for part in batches(["path", "rows", "least", "ends"], rows, 4096):
        for held, values in zip((paths, counts, least, ends), part):
            held.extend(values)
    if not paths:
        return
    shard = TaskContext.get().partitionId()
    sequences, text_bytes = _dense(paths)
    base, check, symbol, depth = pack_double_array(sequences)
    used = np.flatnonzero(check != _FREE)
    n, low = np.zeros(len(check), dtype=np.int64), np.full(len(check), np.iinfo(np.int64).max)
    hashed = np.full(len(check), "", dtype=object)
    for sequence, rows_here, smallest, digest in zip(sequences, counts, least, ends):
        slot = 0
        for c in sequence:
            slot = base[slot] + c
        n[slot], low[slot], hashed[slot] = rows_here, smallest, digest
    # upwards, a level at a time
    by_depth = used[np.argsort(depth[used], kind="stable")]
    levels = np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1)
    for level in reversed(levels[1:]):
        np.add.at(n, check[level], n[level])
        np.minimum.at(low, check[level], low[level])
    edge = np.zeros(len(check), dtype=bool)
    ways = [walk(base, check, sequences[0]), walk(base, check, sequences[-1])]
    for way in ways:
        edge[way] = True
    children, leaves, saved = (np.zeros(len(check), dtype=np.int64) for _ in range(3))
    children += np.bincount(check[used[used > 0]], minlength=len(check))
    inner = used[~edge[used]]
    own_bytes = np.where(symbol >= 0, np.append(text_bytes, 0)[symbol], 0)
    leaves[inner] = children[inner] == 0
    saved[inner] = (n[inner] - 1) * own_bytes[inner]
    # what an edge node has beside other edge nodes
    children[:] = 0
    np.add.at(children, check[inner], 1)
    for level in reversed(levels[1:]):
        np.add.at(leaves, check[level], leaves[level])
        np.add.at(saved, check[level], saved[level])
    keys: dict[int, tuple[str, str | None]] = {}
    for way, path in zip(ways, (paths[0], paths[-1])):
        running, above = hashlib.md5(), None
        for d, slot in enumerate(way):
            if d:
                running.update(path[(d - 1) * _TURN : d * _TURN])
            keys[slot] = (running.hexdigest(), above)
            above = running.hexdigest()
    left, right = set(ways[0]), set(ways[1])
    for at in range(0, len(used), 20_000):
        slots = used[at : at + 20_000]
        above = check[slots]
        yield pa.record_batch(
            {
                "key": pa.array([keys[s][0] if s in keys else None for s in slots.tolist()], pa.string()),
                "parent_key": pa.array([keys[s][1] if s in keys else keys[p][0] if p in keys else None for s, p in zip(slots.tolist(), above.tolist())], pa.string()),
                "conv_id": pa.array(low[slots]), "depth": pa.array(depth[slots]),
                "parent_conv_id": pa.array(low[above], mask=slots == 0), "n_convs": pa.array(n[slots]),
                "n_children": pa.array(children[slots]), "n_leaves": pa.array(leaves[slots]), "saved_tokens": pa.array(saved[slots]),
                "own_bytes": pa.array(own_bytes[slots]), "ends": pa.array(hashed[slots].tolist(), pa.string()),
                "first": pa.array([2 * shard + (s not in left) for s in slots.tolist()], pa.int64()),
                "last": pa.array([2 * shard + (s in right) for s in slots.tolist()], pa.int64()),
            }
        )


_NODES = (
    "key string, parent_key string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, own_bytes long, ends string, first long, last long"
)


def _pieces(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring ids of one path, joined by commas."""
    now, ids = None, []

    def piece() -> pa.RecordBatch:
        return pa.record_batch(
            {"name": pa.array([now], pa.binary()), "low": pa.array([ids[0]], pa.int64()), "ids": pa.array([",".join(map(str, ids))], pa.string())}
        )

    for names, convs in batches(["name", "conv_id"], rows, 4096):
        for name, conv in zip(names, convs):
            if ids and (name != now or len(ids) >= _PIECE):
                yield piece()
                ids.clear()
            now = name
            ids.append(conv)
    if ids:
        yield piece()


def _hashes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each path, which follow each other in order."""
    now, running, done = None, None, []

    def batch() -> pa.RecordBatch:
        found = pa.record_batch({"name": pa.array([n for n, _ in done], pa.binary()), "ends": pa.array([h for _, h in done], pa.string())})
        done.clear()
        return found

    for names, ids in batches(["name", "ids"], rows, 1024):
        for name, piece in zip(names, ids):
            if running is not None and name == now:
                running.update(b"," + piece.encode())
                continue
            if running is not None:
                done.append((now, running.hexdigest()))
            now, running = name, hashlib.sha256(piece.encode())
        if len(done) >= 4096:
            yield batch()
    if running is not None:
        done.append((now, running.hexdigest()))
        yield batch()


def conversation_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path) of `conv_id, turn, role, text`: 24 bytes for each turn in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    entry = F.concat(
        F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))),
        F.unhex(F.lpad(F.hex(F.octet_length("text").cast("long")), 16, "0")),
    )
    named = slim.select("conv_id", "turn", "role", entry.alias("entry"))
    # few or no turns share a place; only those are put in order by their texts
    shared = settle(named.groupBy("conv_id", "turn").agg(F.min("entry").alias("low"), F.max("entry").alias("high")).where("low <> high"))
    if shared.isEmpty():
        placed = F.struct("turn", "entry")
    else:
        place = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
        tied = slim.withColumn("entry", entry).alias("s").join(
            shared.alias("t"), F.col("s.conv_id").eqNullSafe(F.col("t.conv_id")) & F.col("s.turn").eqNullSafe(F.col("t.turn")), "left_semi"
        )
        ranks = tied.withColumn("rank", F.rank().over(place)).select("conv_id", "turn", "entry", "rank").distinct()
        named = named.alias("n").join(
            ranks.alias("r"),
            (F.col("n.conv_id") == F.col("r.conv_id")) & F.col("n.turn").eqNullSafe(F.col("r.turn")) & (F.col("n.entry") == F.col("r.entry")),
            "left",
        ).select("n.conv_id", "n.turn", "n.entry", F.coalesce("r.rank", F.lit(0)).alias("rank"))
        placed = F.struct("turn", "rank", "entry")
    return named.groupBy("conv_id").agg(
        F.unhex(F.concat_ws("", F.transform(F.sort_array(F.collect_list(placed)), lambda t: F.hex(t["entry"])))).alias("path")
    )


def rebuild(paths: DataFrame, family: int = 5, modulus: int = 9) -> DataFrame:
    """Paths whose first h turns are those of the family's first conversation; h is a draw from conv_id."""
    own = paths.alias("c")
    heads = paths.where(F.pmod("conv_id", F.lit(family)) == 0).select(
        F.col("conv_id").alias("of"), F.substring("path", 1, (modulus - 1) * _TURN).alias("head")
    )
    drawn = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(modulus)) * _TURN
    joined = own.join(heads.alias("h"), F.col("c.conv_id") - F.pmod("c.conv_id", F.lit(family)) == F.col("h.of"), "left")
    head = F.coalesce("h.head", F.unhex(F.lit("")))
    cut = drawn.cast("int")
    rest = F.col("c.path").substr(cut + 1, F.octet_length("c.path"))
    return joined.select("c.conv_id", F.concat(head.substr(F.lit(1), cut), rest).alias("path"))


def build_trie(paths: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of `(conv_id, path)`."""
    paths = settle(paths.withColumn("name", F.unhex(F.md5("path"))))
    pieces = paths.select("name", "conv_id").repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")
    pieces = pieces.mapInArrow(_pieces, "name binary, low long, ids string")
    hashes = pieces.repartition("name").sortWithinPartitions("name", "low").mapInArrow(_hashes, "name binary, ends string")
    equal = paths.groupBy("name").agg(F.first("path").alias("path"), F.count(F.lit(1)).alias("rows"), F.min("conv_id").alias("least"))
    ranged = equal.join(hashes, "name").select("path", "rows", "least", "ends").repartitionByRange("path").sortWithinPartitions("path")
    nodes = settle(ranged.mapInArrow(_shard, _NODES))
    # nodes on the borders of ranges: one row for each range that has them
    edges = settle(
        nodes.where("key IS NOT NULL").groupBy("key").agg(
            F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
            F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
            F.sum("saved_tokens").alias("saved_tokens"), F.max("own_bytes").alias("own_bytes"), F.max("ends").alias("ends"),
            F.min("first").alias("first"), F.max("last").alias("last"),
        )
    )
    below = edges.groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    counted = edges.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    own_leaf, own_saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("own_bytes")
    counted = settle(counted.select("*", own_leaf.alias("own_leaf"), own_saved.alias("own_saved")))
    # border paths in order: a node's subtree is the rest of the path that first has it, and all that later paths add until the last one with it
    tail = Window.partitionBy("first").orderBy(F.desc("depth"))
    steps = counted.select(F.col("first").alias("at"), "own_leaf", "own_saved")
    steps = steps.union(counted.select(F.col("last").alias("at"), F.lit(0).alias("own_leaf"), F.lit(0).alias("own_saved")))
    steps = steps.groupBy("at").agg(F.sum("own_leaf").alias("leaf"), F.sum("own_saved").alias("saved"))
    upto = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # at most two rows for each task of the trie
    sums = settle(steps.select("at", F.sum("leaf").over(upto).alias("leaf"), F.sum("saved").over(upto).alias("saved")))
    spans = counted.select(
        "*", F.sum("own_leaf").over(tail).alias("tail_leaf"), F.sum("own_saved").over(tail).alias("tail_saved")
    )
    sums = broadcast_if_small(sums)
    whole = settle(
        spans.alias("e").join(sums.alias("a"), F.col("e.first") == F.col("a.at"))
        .join(sums.alias("b"), F.col("e.last") == F.col("b.at"))
        .select(
            "e.key", "e.parent_key", "e.conv_id", "e.depth", "e.n_convs", "e.n_children",
            (F.col("e.n_leaves") + F.col("e.tail_leaf") + F.col("b.leaf") - F.col("a.leaf")).alias("n_leaves"),
            (F.col("e.saved_tokens") + F.col("e.tail_saved") + F.col("b.saved") - F.col("a.saved")).alias("saved_tokens"), "e.ends",
        )
    )
    parents = broadcast_if_small(whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above")))
    inner = nodes.where("key IS NULL").join(parents, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("above", "parent_conv_id"))
    upper = whole.join(parents, "parent_key", "left").withColumnRenamed("above", "parent_conv_id")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    ends = F.when(F.col("ends") == "", F.lit(_EMPTY_HASH)).otherwise(F.col("ends")).alias("ends_sha256")
    return inner.select(*columns, ends).unionByName(upper.select(*columns, ends))


def conversation_trie(turns: DataFrame, family: int = 5, modulus: int = 9) -> DataFrame:
    """Nodes of the trie of rebuilt conversations, one row each.

    `turns(conv_id, turn, role, text)` are put in order of turn (null first; where turns share a
    place by role, then text) and rebuilt (see `rebuild`); a node is a distinct sequence of first
    turns. A turn is known by the MD5 of its role and text.

    Equal conversations become one path first. Paths are range-partitioned in order, so a shard
    is a range of prefixes and any common beginning, or conversation, can be cut between shards. A
    shard packs BASE and CHECK over the dense ids of its turns and sums up its nodes. Only nodes
    on the way to a shard's first and last path can be in other shards too: these are merged by
    their prefix, and their subtrees are summed over the borders in order.

    Null roles and texts are empty. Rows with a null conv_id belong to no conversation. A rebuilt
    conversation without turns is a member of the root alone. Repeated rows are turns of their own.
    Other columns are not read. An empty table gives no rows. One conversation's turns (24 bytes
    each) meet in one task.
    """
    return build_trie(rebuild(conversation_paths(turns), family, modulus))
