"""Token ids in binary shards, read by document key through a minimal perfect hash index."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowworth.llm.files import open_store, read_json, write_json, write_whole
from rowworth.llm.perfect_hash import PerfectHash, fingerprints
from rowworth.llm.text import U64, batches
from rowworth.llm.tokens import shared_encoder, vocabulary_width
from rowworth.session import settle

VOCABULARY = "byte_bpe_50k.json"
# keys in one index file; a task holds one at a time
BUCKET_KEYS = 100_000
_ENTRY = np.dtype([("print", "<u4"), ("shard", "<u4"), ("at", "<u8"), ("ids", "<u8")])
_DIRECTORY = "key long, shard long, at long, ids long, total long"


def _shard(folder: str, number: int) -> str:
    return f"{folder}/ids/shard-{number:06d}.ids"


def _bucket(folder: str, number: int) -> str:
    return f"{folder}/index/bucket-{number:06d}.mph"


def _write_shard(folder: str, vocabulary: str, end: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(vocabulary, words_only=False)
        width = encoder.width
        store, root = open_store(folder)
        number, closing = TaskContext.get().partitionId(), end.to_bytes(encoder.width, "little")
        first = next(rows, None)
        while first is not None and not first.num_rows:
            first = next(rows, None)
        if first is None:
            return
        keys, starts, counts = [], [], []

        def write(stream):
            at = 0
            for ids, texts in batches(["doc_id", "text"], itertools.chain([first], rows), size=2000):
                for key, found in zip(ids, encoder.encode_all(texts)):
                    payload = found + closing
                    stream.write(payload)
                    if keys and keys[-1] == key:
                        counts[-1] += len(payload) // width
                    else:
                        keys.append(key)
                        starts.append(at)
                        counts.append(len(payload) // width)
                    at += len(payload) // width

        write_whole(store, _shard(root, number), write)
        size = sum(counts)
        for part in range(0, len(keys), 10_000):
            cut = slice(part, part + 10_000)
            here = len(keys[cut])
            yield pa.record_batch(
                {
                    "key": pa.array(keys[cut], pa.int64()), "shard": pa.array([number] * here, pa.int64()),
                    "at": pa.array(starts[cut], pa.int64()), "ids": pa.array(counts[cut], pa.int64()),
                    "total": pa.array([size] * here, pa.int64()),
                }
            )

    return run


def _by_bucket(rows: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Rows sorted by bucket, one bucket at a time."""
    held: list[list[np.ndarray]] = []
    now = None
    for batch in rows:
        bucket = batch.column(batch.schema.get_field_index("bucket")).to_numpy()
        values = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in columns]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for low, high in itertools.pairwise([0, *cuts, len(bucket)]):
            if low == high:
                continue
            if now is not None and bucket[low] != now:
                yield now, [np.concatenate(v) for v in zip(*held)]
                held = []
            now = int(bucket[low])
            held.append([v[low:high] for v in values])
    if held:
        yield now, [np.concatenate(v) for v in zip(*held)]


def _write_index(folder: str):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        for bucket, (keys, shard, at, ids) in _by_bucket(rows, ["key", "shard", "at", "ids"]):
            keys = keys.astype(np.int64).view(U64)
            index = PerfectHash.build(keys)
            entries = np.zeros(len(keys), dtype=_ENTRY)
            slots = index.slots(keys)
            for name, values in (("print", fingerprints(keys)), ("shard", shard), ("at", at), ("ids", ids)):
                entries[name][slots] = values
            write_whole(store, _bucket(root, bucket), lambda s: s.write(index.to_bytes() + entries.tobytes()))
            yield pa.record_batch({"bucket": pa.array([bucket], pa.int64()), "keys": pa.array([len(keys)], pa.int64())})

    return run


def _bucket_of(buckets: int):
    return F.pmod(F.xxhash64("key"), F.lit(buckets))


def write_tokens(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end: int = 0) -> dict:
    """Encode `docs(doc_id, text)` into `folder`; the manifest, also written there as the last file.

    Rows are range-partitioned by doc_id, so shards follow each other in ascending order and a
    partition is one file `ids/shard-N.ids`: the bare little-endian ids (of two
    bytes if the vocabulary has at most 65,536, else of four), document after
    document, each with `end`. The index is split by key hash into buckets of about BUCKET_KEYS;
    `index/bucket-N.mph` holds a minimal perfect hash and, at each slot, fingerprint, shard,
    first id and number of ids. Files appear by rename, the manifest last: a folder without
    manifest.json is not complete. The driver sees one row per shard.

    Null texts count as empty and have the end id alone. Rows that share a doc_id are one
    document of several texts, in text order. Rows with a null doc_id come first in the payload,
    without a key. An empty table gives no shard.
    """
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    directory = settle(ordered.mapInArrow(_write_shard(folder, vocabulary, end), _DIRECTORY))
    sums = directory.groupBy("shard").agg(F.max("total").alias("total"), F.min("key").alias("low"), F.max("key").alias("high"))
    shards, start = [], 0
    for row in sums.orderBy("shard").collect():
        shards.append({"shard": row.shard, "start": start, "ids": row.total, "low": row.low, "high": row.high})
        start += row.total
    keyed = directory.where("key IS NOT NULL")
    buckets = max(1, -(-keyed.count() // BUCKET_KEYS))
    indexed = (
        keyed.withColumn("bucket", _bucket_of(buckets))
        .repartition(min(buckets, 10_000), "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_write_index(folder), "bucket long, keys long")
    )
    keys = indexed.agg(F.sum("keys")).first()[0] or 0
    width = vocabulary_width(vocabulary)
    manifest = {"vocabulary": vocabulary, "width": width, "end": end, "shards": shards, "buckets": buckets, "keys": keys, "ids": start}
    write_json(f"{folder}/manifest.json", manifest)
    return manifest


def _look_up(folder: str):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        for bucket, (keys,) in _by_bucket(rows, ["key"]):
            with store.open_input_stream(_bucket(root, bucket)) as stream:
                raw = stream.read()
            index, at = PerfectHash.from_bytes(raw)
            entries = np.frombuffer(raw, dtype=_ENTRY, offset=at)
            asked = keys.astype(np.int64).view(U64)
            slots = index.slots(asked)
            entry = entries[np.maximum(slots, 0)]
            known = (slots >= 0) & (entry["print"] == fingerprints(asked))
            entry = entry[known]
            yield pa.record_batch(
                {"key": pa.array(keys[known].astype(np.int64))}
                | {c: pa.array(entry[c].astype(np.int64)) for c in ("shard", "at", "ids")}
            )

    return run


def _read_ids(folder: str, width: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        number, stream = None, None
        for keys, shard, at, ids in batches(["key", "shard", "at", "ids"], rows):
            payloads = []
            for s, first, count in zip(shard, at, ids):
                if s != number:
                    if stream:
                        stream.close()
                    number, stream = s, store.open_input_file(_shard(root, s))
                payloads.append(stream.read_at(width * count, width * first))
            yield pa.record_batch(
                {"key": pa.array(keys, pa.int64()), "shard": pa.array(shard, pa.int64()), "at": pa.array(at, pa.int64()),
                 "payload": pa.array(payloads, pa.binary())}
            )
        if stream:
            stream.close()

    return run


def _digests(folder: str, width: int, starts: dict[int, int]):
    read = _read_ids(folder, width)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, shard, at, payloads in batches(["key", "shard", "at", "payload"], read(rows)):
            yield pa.record_batch(
                {
                    "doc_id": pa.array(keys, pa.int64()),
                    "start": pa.array([starts[s] + a for s, a in zip(shard, at)], pa.int64()),
                    "n_tokens": pa.array([len(p) // width for p in payloads], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(np.frombuffer(p, dtype=f"<u{width}").astype("<u4")) for p in payloads], pa.int64()),
                }
            )

    return run


def locate(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """(key, shard, at, ids) of the `keys(key)` that the index knows; unknown and null keys give no row.

    An unknown key passes for a known one only if its 32-bit fingerprint agrees by chance.
    """
    buckets = read_json(f"{folder}/manifest.json")["buckets"]
    asked = keys.where("key IS NOT NULL").select(F.col("key").cast("long").alias("key")).distinct().withColumn("bucket", _bucket_of(buckets))
    parts = asked.repartition(min(buckets, 10_000), "bucket").sortWithinPartitions("bucket")
    return parts.mapInArrow(_look_up(folder), "key long, shard long, at long, ids long")


def read_tokens(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """(key, shard, at, payload) of the given keys: index, then one positioned read each."""
    width = read_json(f"{folder}/manifest.json")["width"]
    places = locate(spark, folder, keys).repartitionByRange("shard", "at").sortWithinPartitions("shard", "at")
    return places.mapInArrow(_read_ids(folder, width), "key long, shard long, at long, payload binary")


def token_digests(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the given keys, from the files."""
    manifest = read_json(f"{folder}/manifest.json")
    starts = {s["shard"]: s["start"] for s in manifest["shards"]}
    places = locate(spark, folder, keys).repartitionByRange("shard", "at").sortWithinPartitions("shard", "at")
    return places.mapInArrow(_digests(folder, manifest["width"], starts), "doc_id long, start long, n_tokens long, ids_crc32 long")
