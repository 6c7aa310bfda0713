"""Repeated passages: suffix arrays of document ranges, scanned against and merged into levels that grow geometrically."""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowworth.llm.text import SALT, U64, _BASE, _BASE_INVERSE, _BYTE_CODES, _powers, batches, mix
from rowworth.session import settle

# text in one block, the range of documents that a task holds at a time
BLOCK_BYTES = 2 << 20
# text whose keys one task compares, and suffixes in one family
KEYED_BYTES = 32 << 20
FAMILY_SUFFIXES = 1 << 20
# suffixes that make a batch
BATCH_SUFFIXES = 1 << 17
# suffixes in one snippet; longer runs (of one letter, say) are cut
_RUN = 256


class Family:
    """Sorted distinct suffixes, cut at a fixed length, in levels of falling size.

    A batch is scanned against each level in one merge of two sorted arrays. What is new becomes a
    level, and levels of about equal size are merged, so a suffix is moved a logarithmic number of
    times.
    """

    def __init__(self):
        self.levels: list[np.ndarray] = []

    @staticmethod
    def merge(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both arrays in order, and which of `high` are also in `low`."""
        both = np.concatenate([low, high])
        order = np.argsort(both, kind="stable")  # two sorted runs: a merge
        both = both[order]
        again = np.zeros(len(both), dtype=bool)
        again[1:] = both[1:] == both[:-1]
        known = np.zeros(len(high), dtype=bool)
        at = order[again]
        known[at[at >= len(low)] - len(low)] = True
        return both[~again], known

    def add(self, suffixes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Which of a batch's suffixes an earlier batch has, or the batch itself at a smaller rank."""
        order = np.argsort(suffixes, kind="stable")
        array = suffixes[order]
        first = np.ones(len(array), dtype=bool)
        first[1:] = array[1:] != array[:-1]
        group = np.cumsum(first) - 1
        distinct = array[first]
        known = np.zeros(len(distinct), dtype=bool)
        for level in self.levels:
            known |= self.merge(level, distinct)[1]
        least = np.minimum.reduceat(ranks[order], np.flatnonzero(first)) if len(array) else ranks
        found = np.empty(len(array), dtype=bool)
        found[order] = known[group] | (ranks[order] > least[group])
        fresh = distinct[~known]
        while len(fresh) and self.levels and len(self.levels[-1]) <= 2 * len(fresh):
            fresh = self.merge(self.levels.pop(), fresh)[0]
        if len(fresh):
            self.levels.append(fresh)
        return found


def _packed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for ids, texts in batches(["doc_id", "text"], rows):
        packed = [press.compress((t or "").encode("utf-8", "surrogatepass")) for t in texts]
        sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
        salts = [int.from_bytes(p[-8:], "little") & 0xFFFF for p in packed]
        yield pa.record_batch(
            {"doc_id": pa.array(ids, pa.int64()), "salt": pa.array(salts, pa.int64()), "size": pa.array(sizes, pa.int64()), "packed": pa.array(packed, pa.binary())}
        )


def _blocks(block_bytes: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, numbers = TaskContext.get().partitionId(), itertools.count()
        unpack, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=5)

        def block(held):
            return pa.record_batch(
                {
                    "block": pa.array([(part << 32) + next(numbers)], pa.int64()), "low": pa.array([held[0][0]], pa.int64()),
                    "ids": pa.array([[key for key, _, _ in held]], pa.list_(pa.int64())),
                    "sizes": pa.array([[size for _, size, _ in held]], pa.list_(pa.int64())),
                    # texts side by side take less than one by one
                    "packed": pa.array([press.compress(b"".join(unpack.decompress(packed) for _, _, packed in held))], pa.binary()),
                }
            )

        held, held_bytes, run_rows, run_bytes, alone = [], 0, [], 0, True
        for part_rows in batches(["doc_id", "size", "packed"], rows):
            for row in zip(*part_rows):
                if run_rows and row[0] != run_rows[-1][0]:
                    if alone:
                        yield block(run_rows)
                    else:
                        if held and held_bytes + run_bytes > block_bytes:
                            yield block(held)
                            held, held_bytes = [], 0
                        held, held_bytes = held + run_rows, held_bytes + run_bytes
                    run_rows, run_bytes, alone = [], 0, False
                if run_rows and run_bytes + row[1] > block_bytes:
                    # one doc_id with many texts: blocks of its own
                    if held:
                        yield block(held)
                        held, held_bytes = [], 0
                    yield block(run_rows)
                    run_rows, run_bytes, alone = [], 0, True
                run_rows.append(row)
                run_bytes += row[1]
        if held:
            yield block(held)
        # the next range may begin with the last doc_id of this one, as this one's first may end the one before
        if run_rows:
            yield block(run_rows)

    return run


class Block:
    """Bytes of a range of documents and the runs of neighbouring suffixes that share a key.

    The key of a suffix is the least hash of any `gram` bytes in its first `least` bytes: equal
    stretches of that length have equal keys wherever they are, and neighbours mostly share one.
    """

    def __init__(self, ids: list[int], sizes: list[int], packed: bytes, least: int):
        self.least = least
        self.ids = np.array(ids, dtype=np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8)
        self.ends = np.cumsum(sizes, dtype=np.int64)
        self.begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        long = self.ends - self.begins >= least
        begins, stops = self.begins[long], self.ends[long] - least + 1
        self.runs = self.sizes = self.doc = np.empty(0, dtype=np.int64)
        self.keys = np.empty(0, dtype=U64)
        if not len(begins):
            self.distinct, self.named = self.keys, self.runs
            return
        found = self._least_hashes()
        cut = np.zeros(len(found) + 1, dtype=bool)
        cut[1:-1] = found[1:] != found[:-1]
        cut[begins] = cut[stops] = True
        starts = np.flatnonzero(cut)
        sizes = np.diff(starts, append=len(found))
        doc = np.searchsorted(self.begins, starts, side="right") - 1
        # of documents without bytes, several begin where the next one does: the last of them is meant
        inside = starts + least <= self.ends[doc]
        starts, sizes, doc = starts[inside], sizes[inside], doc[inside]
        pieces = -(-sizes // _RUN)
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.runs = np.repeat(starts, pieces) + nth * _RUN
        self.sizes = np.minimum(np.repeat(sizes, pieces) - nth * _RUN, _RUN)
        self.doc = np.repeat(doc, pieces)
        self.keys = mix(found[self.runs] + SALT)
        self.distinct, self.named = np.unique(self.keys, return_inverse=True)

    def _least_hashes(self) -> np.ndarray:
        gram = max(1, self.least * 2 // 5)
        count = len(self.data)
        sums = np.zeros(count + 1, dtype=U64)
        np.cumsum(_BYTE_CODES[self.data] * _powers(_BASE, count), out=sums[1:])
        least = mix((sums[gram:] - sums[:-gram]) * _powers(_BASE_INVERSE, count - gram + 1))
        width, wanted = 1, self.least - gram + 1
        while 2 * width <= wanted:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < wanted:
            least = np.minimum(least[: width - wanted], least[wanted - width :])
        return least

    def dealt(self, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys by shard and short name: their numbers, shards and names."""
        shard, name = self.distinct % U64(shards), self.distinct >> U64(32)
        order = np.lexsort((name, shard))
        return order, shard[order].astype(np.int64), name[order].astype(np.uint32)

    def flagged(self, shards: int, flags: list[dict]) -> np.ndarray:
        """Runs whose key another block has."""
        order, shard, _ = self.dealt(shards)
        marks = np.zeros(len(order), dtype=bool)
        for flag in flags or ():
            low, high = np.searchsorted(shard, [flag["shard"], flag["shard"] + 1])
            marks[order[low:high]] = _bits(flag["bits"], high - low)
        return marks[self.named] if len(marks) else np.empty(0, dtype=bool)

    def repeated_inside(self) -> np.ndarray:
        """Runs whose key documents of two ids in this block have."""
        ids = self.ids[self.doc]
        low = np.full(len(self.distinct), np.iinfo(np.int64).max)
        high = np.full(len(self.distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, self.named, ids)
        np.maximum.at(high, self.named, ids)
        return (low < high)[self.named] if len(low) else np.empty(0, dtype=bool)

    def snippets(self, runs: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Distinct stretches of bytes of the given runs, in order, and which of them each run is."""
        raw = self.data.tobytes()
        texts = [raw[a : a + n + self.least - 1] for a, n in zip(self.runs[runs].tolist(), self.sizes[runs].tolist())]
        known = sorted(set(texts))
        number = {t: i for i, t in enumerate(known)}
        return known, np.array([number[t] for t in texts], dtype=np.int64)


def _bits(raw: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=count).astype(bool)


def _suffixes(snippets: list[bytes] | bytes, lengths: np.ndarray, least: int) -> np.ndarray:
    """First `least` bytes of each suffix of each snippet that is long enough."""
    data = np.frombuffer(snippets if isinstance(snippets, bytes) else b"".join(snippets), dtype=np.uint8)
    counts = lengths - least + 1
    begins = np.repeat(np.cumsum(lengths) - lengths, counts)
    at = begins + np.arange(len(begins)) - np.repeat(np.cumsum(counts) - counts, counts)
    if not len(at):
        return np.empty(0, dtype=f"S{least}")
    windows = np.lib.stride_tricks.sliding_window_view(data, least)[at]
    return np.ascontiguousarray(windows).view(f"S{least}").reshape(-1)


def _keys(least: int, shards: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for numbers, ids, sizes, packed in batches(["block", "ids", "sizes", "packed"], rows, 1):
            _, shard, names = Block(ids[0], sizes[0], packed[0], least).dealt(shards)
            at = np.flatnonzero(np.diff(shard, prepend=-1))
            payloads = []
            for low, high in zip(at, [*at[1:], len(shard)]):
                steps = np.diff(names[low:high], prepend=np.uint32(0)).astype("<u4")
                payloads.append(press.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes()))
            yield pa.record_batch(
                {"shard": pa.array(shard[at]), "block": pa.array(numbers * len(at), pa.int64()), "payload": pa.array(payloads, pa.binary())}
            )

    return run


def _flags(table: pa.Table) -> pa.Table:
    """Which keys of each block are keys of another one too (or share a name with one)."""
    unpack = zstandard.ZstdDecompressor()
    names = []
    for payload in table.column("payload").to_pylist():
        planes = np.frombuffer(unpack.decompress(payload), dtype=np.uint8)
        names.append(np.cumsum(np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1), dtype=np.uint32))
    every = np.sort(np.concatenate([np.unique(n) for n in names]))
    shared = np.unique(every[1:][every[1:] == every[:-1]])
    bits, counts = [], []
    for n in names:
        at = np.minimum(np.searchsorted(shared, n), max(len(shared) - 1, 0))
        hit = shared[at] == n if len(shared) else np.zeros(len(n), dtype=bool)
        bits.append(np.packbits(hit).tobytes())
        counts.append(int(hit.sum()))
    return pa.table(
        {"block": table.column("block"), "shard": table.column("shard"), "bits": pa.array(bits, pa.binary()), "shared": pa.array(counts, pa.int64())}
    )


def _snippet_shards(block: Block, runs: np.ndarray, families: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Snippets of `runs` by family: their bytes, families, and for each run its snippet's number there."""
    texts, named = block.snippets(runs)
    family = np.zeros(len(texts), dtype=np.int64)
    family[named] = ((block.keys[runs] >> U64(20)) % U64(families)).astype(np.int64)
    order = np.argsort(family, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return [texts[i] for i in order], family[order], place[named], order


def _sent(least: int, shards: int, families: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for numbers, lows, ids, sizes, packed, flags in batches(["block", "low", "ids", "sizes", "packed", "flags"], rows, 1):
            block = Block(ids[0], sizes[0], packed[0], least)
            texts, family, _, _ = _snippet_shards(block, np.flatnonzero(block.flagged(shards, flags[0])), families)
            at = np.flatnonzero(np.diff(family, prepend=-1))
            payloads = []
            for low, high in zip(at, [*at[1:], len(family)]):
                lengths = np.array([len(t) for t in texts[low:high]], dtype="<u2")
                payloads.append(press.compress(len(lengths).to_bytes(4, "little") + lengths.tobytes() + b"".join(texts[low:high])))
            yield pa.record_batch(
                {
                    "family": pa.array(family[at]), "low": pa.array(lows * len(at), pa.int64()), "block": pa.array(numbers * len(at), pa.int64()),
                    "payload": pa.array(payloads, pa.binary()),
                }
            )

    return run


def _scanned(table: pa.Table, least: int) -> pa.Table:
    """One family: batches of blocks in order of their documents, each against all before it."""
    unpack = zstandard.ZstdDecompressor()
    order = np.lexsort((table.column("block").to_numpy(), table.column("low").to_numpy()))
    lows, payloads = table.column("low").to_numpy()[order], table.column("payload")
    grown, bits = Family(), [b""] * len(order)
    waiting: list[tuple[int, np.ndarray]] = []

    def scan():
        found = grown.add(np.concatenate([s for _, s in waiting]), np.repeat([lows[i] for i, _ in waiting], [len(s) for _, s in waiting]))
        cuts = np.cumsum([len(s) for _, s in waiting])[:-1]
        for (i, _), hit in zip(waiting, np.split(found, cuts)):
            bits[i] = np.packbits(hit).tobytes()
        waiting.clear()

    for i, row in enumerate(order.tolist()):
        raw = unpack.decompress(payloads[row].as_py())
        count = int.from_bytes(raw[:4], "little")
        lengths = np.frombuffer(raw, dtype="<u2", count=count, offset=4).astype(np.int64)
        # blocks of one doc_id know nothing of each other, so no batch ends between them
        if waiting and lows[i] != lows[i - 1] and sum(len(s) for _, s in waiting) >= BATCH_SUFFIXES:
            scan()
        waiting.append((i, _suffixes(raw[4 + 2 * count :], lengths, least)))
    scan()
    return pa.table({"block": table.column("block").take(pa.array(order)), "family": table.column("family").take(pa.array(order)), "bits": pa.array(bits, pa.binary())})


def _removed(block: Block, flagged: np.ndarray, families: int, replies: list[dict]) -> np.ndarray:
    """Bytes of the block that a repeated stretch covers."""
    cover = np.zeros(len(block.data) + 1, dtype=np.int64)

    def mark(runs: np.ndarray, hit: np.ndarray):
        counts = block.sizes[runs]
        at = np.repeat(block.runs[runs], counts) + np.arange(len(hit)) - np.repeat(np.cumsum(counts) - counts, counts)
        np.add.at(cover, at[hit], 1)
        np.add.at(cover, at[hit] + block.least, -1)

    def spread(named: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Places in the suffixes of the snippets for every suffix of the runs."""
        begins = (np.cumsum(counts) - counts)[named]
        each = counts[named]
        return np.repeat(begins, each) + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)

    runs = np.flatnonzero(flagged)
    if len(runs):
        texts, family, named, _ = _snippet_shards(block, runs, families)
        counts = np.array([len(t) for t in texts], dtype=np.int64) - block.least + 1
        totals = np.concatenate([[0], np.cumsum(counts)])
        known = np.zeros(int(totals[-1]), dtype=bool)
        for reply in replies or ():
            low, high = totals[np.searchsorted(family, [reply["family"], reply["family"] + 1])]
            known[low:high] = _bits(reply["bits"], high - low)
        mark(runs, known[spread(named, counts)])
    runs = np.flatnonzero(block.repeated_inside())
    if len(runs):
        texts, named = block.snippets(runs)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        ids = block.ids[block.doc[runs]]
        least = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(least, named, ids)
        suffixes = _suffixes(texts, lengths, block.least)
        counts = lengths - block.least + 1
        order = np.argsort(suffixes, kind="stable")
        first = np.ones(len(order), dtype=bool)
        first[1:] = suffixes[order[1:]] != suffixes[order[:-1]]
        smallest = np.empty(len(order), dtype=np.int64)
        smallest[order] = np.minimum.reduceat(np.repeat(least, counts)[order], np.flatnonzero(first))[np.cumsum(first) - 1]
        mark(runs, smallest[spread(named, counts)] < np.repeat(ids, block.sizes[runs]))
    return np.cumsum(cover[:-1]) > 0


def _results(least: int, shards: int, families: int, with_kept: bool):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, lengths, packed, flags, replies in batches(["ids", "sizes", "packed", "flags", "replies"], rows, 1):
            block = Block(ids[0], lengths[0], packed[0], least)
            gone = _removed(block, block.flagged(shards, flags[0]), families, replies[0])
            raw = block.data.tobytes()
            for at in range(0, len(block.ids), 2000):
                spans, kept = [], []
                for low, high in zip(block.begins[at : at + 2000].tolist(), block.ends[at : at + 2000].tolist()):
                    here = gone[low:high]
                    if here.any():
                        edges = np.flatnonzero(np.diff(here, prepend=False, append=False)).tolist()
                        spans.append(list(zip(edges[::2], edges[1::2])))
                        kept.append(block.data[low:high][~here].tobytes())
                    else:
                        spans.append([])
                        kept.append(raw[low:high])
                sizes = (block.ends - block.begins)[at : at + 2000]
                columns = {
                    "doc_id": pa.array(block.ids[at : at + 2000]), "n_bytes": pa.array(sizes),
                    "n_removed": pa.array(sizes - np.array([len(k) for k in kept], dtype=np.int64)),
                    "n_spans": pa.array([len(s) for s in spans], pa.int64()),
                    "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                    "spans": pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                }
                yield pa.record_batch(columns | ({"kept": pa.array(kept, pa.binary())} if with_kept else {}))

    return run


def remove_repeats(docs: DataFrame, min_bytes: int = 50, with_kept: bool = False, block_bytes: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (and kept, the bytes left) for every row of `docs(doc_id, text)`.

    A byte goes if a stretch of `min_bytes` bytes that covers it also starts in a document with a
    smaller doc_id; stretches lie within one document and are judged on the input. `spans` are the
    maximal removed runs (start and end in the UTF-8 bytes).

    Documents are range-partitioned by doc_id into blocks. Every suffix has a key that equal
    suffixes share, and neighbours mostly share one, so a block has about one for 15 bytes. Blocks
    first exchange short names of their distinct keys; one bit a key comes back. Snippets of text
    around keys that two blocks have go, once a block, to the key's family: there blocks arrive in
    order of their documents, in batches whose suffix arrays are scanned against the levels before
    them (see `Family`). One bit a suffix comes back, and the block itself settles what its own
    documents share. A passage that a third of all documents hold is one key, and one snippet, a block.

    Null and empty texts have no bytes. Rows with a null doc_id come after no document and before
    none: nothing is removed from them or because of them. Rows that share a doc_id are one document in several
    texts: they lose nothing to each other. Repeated rows get equal results. Other columns are not
    read. An empty table gives no rows.
    """
    if min_bytes < 2:
        raise ValueError("stretches need two bytes or more")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = docs.where("doc_id IS NOT NULL").mapInArrow(_packed, "doc_id long, salt long, size long, packed binary")
    ranged = packed.repartitionByRange("doc_id", "salt").sortWithinPartitions("doc_id")
    blocks = settle(
        ranged.mapInArrow(_blocks(block_bytes or BLOCK_BYTES), "block long, low long, ids array<long>, sizes array<long>, packed binary")
    )
    total = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, n: s + n))).first()[0] or 0
    shards = max(16, -(-total // KEYED_BYTES))
    keys = blocks.select("block", "ids", "sizes", "packed").mapInArrow(_keys(min_bytes, shards), "shard long, block long, payload binary")
    flags = settle(keys.groupBy("shard").applyInArrow(_flags, "block long, shard long, bits binary, shared long"))
    # a shared key stands for about fifteen suffixes
    families = max(16, -(-15 * (flags.agg(F.sum("shared")).first()[0] or 0) // FAMILY_SUFFIXES))
    by_block = flags.where("shared > 0").groupBy("block").agg(F.collect_list(F.struct("shard", "bits")).alias("flags"))
    told = blocks.select("block", "low", "ids", "sizes", "packed").join(by_block, "block")
    snippets = told.mapInArrow(_sent(min_bytes, shards, families), "family long, low long, block long, payload binary")
    scan = functools.partial(_scanned, least=min_bytes)
    replies = snippets.groupBy("family").applyInArrow(lambda t: scan(t), "block long, family long, bits binary")
    replies = replies.groupBy("block").agg(F.collect_list(F.struct("family", "bits")).alias("replies"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"
    schema += ", kept binary" if with_kept else ""
    answered = by_block.join(replies, "block", "left")
    whole = blocks.select("block", "ids", "sizes", "packed").join(settle(answered), "block", "left")
    found = whole.select("ids", "sizes", "packed", "flags", "replies").mapInArrow(_results(min_bytes, shards, families, with_kept), schema)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    lost = docs.where("doc_id IS NULL").select(
        "doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2(raw, 256).alias("kept_sha256"), F.expr("cast(array() as array<struct<start: long, end: long>>)").alias("spans"),
        *([raw.alias("kept")] if with_kept else []),
    )
    return found.unionByName(lost)
