"""WARC archives of pages: sorted, rolled by compressed size, committed by rename and manifest."""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowworth.llm.files import open_store, read_json, write_json, write_whole
from rowworth.llm.text import batches
from rowworth.session import broadcast_if_small, settle

ROLL_BYTES = 64 << 20
# records carry a date that does not depend on when they are written
DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LINE_BREAKS = re.compile(r"[\x00-\x1f\x7f]+")
_FILE = "file string, records long, bytes long, sha1 string"
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP headers of its page and no payload."""
    digest = payload_digest(payload)
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    target = _LINE_BREAKS.sub(" ", url or "").strip()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Page-Id", "" if page_id is None else str(page_id)),
    ]
    if url is None or target != url:
        # the exact value, where the line above can't hold it
        raw = "" if url is None else base64.b64encode(url.encode("utf-8", "surrogatepass")).decode()
        fields.append(("WARC-Page-Url", f"none{raw}" if url is None else f"b64:{raw}"))
    if refers_to is not None:
        fields += [
            ("WARC-Profile", _PROFILE),
            ("WARC-Refers-To", record_id(refers_to, digest)),
            ("WARC-Refers-To-Page", str(refers_to)),
        ]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def decode_record(raw: bytes) -> dict:
    """The fields of a record, with its digests checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no WARC record: {first[:80]}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    if fields["WARC-Block-Digest"] != f"sha1:{payload_digest(block)}":
        raise ValueError("a record's block digest is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and payload_digest(payload) != digest:
        raise ValueError("a record's payload digest is wrong")
    exact = fields.get("WARC-Page-Url", "")
    url = fields["WARC-Target-URI"]
    if exact:
        url = None if exact == "none" else base64.b64decode(exact.removeprefix("b64:")).decode("utf-8", "surrogatepass")
    number = fields["WARC-Page-Id"]
    return {
        "page_id": int(number) if number else None,
        "url": url,
        "payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": int(fields["WARC-Refers-To-Page"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def _write_files(folder: str, roll: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        task = TaskContext.get().partitionId()
        columns = batches(["page_id", "url", "payload", "refers_to"], rows, 64)
        records = itertools.chain.from_iterable(zip(*c) for c in columns)
        head = next(records, None)
        for number in itertools.count():
            if head is None:
                return
            name, done = f"pages-{task:06d}-{number:05d}.warc.gz", {"records": 0, "bytes": 0}
            whole = hashlib.sha1()

            def write(stream):
                nonlocal head
                while head is not None and done["bytes"] < roll:
                    # a gzip member each, without a time, so that equal records give equal bytes
                    member = gzip.compress(encode_record(*head), compresslevel=6, mtime=0)
                    stream.write(member)
                    whole.update(member)
                    done["records"] += 1
                    done["bytes"] += len(member)
                    head = next(records, None)

            write_whole(store, f"{root}/{name}", write)
            yield pa.record_batch(
                {"file": pa.array([name]), "records": pa.array([done["records"]], pa.int64()),
                 "bytes": pa.array([done["bytes"]], pa.int64()), "sha1": pa.array([whole.hexdigest()])}
            )

    return run


def _members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    inflate, parts, raw = zlib.decompressobj(31), [], b""
    while True:
        raw = raw or stream.read(size)
        if not raw:
            if parts or inflate.unconsumed_tail:
                raise ValueError("an archive ends inside a record")
            return
        parts.append(inflate.decompress(raw))
        raw = b""
        if inflate.eof:
            raw = inflate.unused_data
            yield b"".join(parts)
            inflate, parts = zlib.decompressobj(31), []


def _read_files(folder: str, with_payload: bool):
    names = [f.split()[0] for f in _RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        for (files,) in batches(["file"], rows):
            for file in files:
                with store.open_input_stream(f"{root}/{file}") as stream:
                    members = _members(stream)
                    while chunk := list(itertools.islice(members, 256)):
                        found = [decode_record(m) for m in chunk]
                        if not with_payload:
                            for r in found:
                                r["payload"] = None
                        yield pa.record_batch([pa.array([r[n] for r in found], k) for n, k in zip(names, kinds)], names=names)

    return run


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, min_bytes: int = 0) -> dict:
    """Archive `pages(page_id, url, html)` into `folder`; the manifest, also written there last.

    Records lie in order of page_id: rows are range-partitioned and sorted, each task starts a
    file and goes on to the next one beyond `roll_bytes` of compressed records. Payload is the
    html in UTF-8 (null: empty). Of records with equal payloads of at least `min_bytes` bytes,
    the one with the smallest page_id is a response and the others revisit it; the digest of a
    hot payload is pre-aggregated and its join can be split. Headers and digests are made anew
    and hold no clock or host, so a retried task writes the same bytes; files appear by rename,
    and a folder without manifest.json is not complete.

    Rows that share the smallest page_id of their payload are all responses. A row with a null
    page_id is archived after the others; it revisits a page with an id and an equal payload if
    there is one and is a response otherwise. A null url is kept as null. An empty table gives a
    manifest without files.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= min_bytes, F.sha1("payload")))
    first = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("times"))
    # payloads only travel for this join where the repeated ones are too many to broadcast
    first = settle(first.where("times > 1").drop("times"))
    marked = rows.join(broadcast_if_small(first), "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    ordered = (
        marked.select("page_id", "url", "payload", refers.alias("refers_to"), F.col("page_id").isNull().alias("last"))
        .repartitionByRange("last", "page_id")
        .sortWithinPartitions("last", "page_id", "url", "payload")
        .drop("last")
    )
    files = settle(ordered.mapInArrow(_write_files(folder, roll_bytes), _FILE)).orderBy("file").collect()
    manifest = {"files": [f.asDict() for f in files], "records": sum(f.records for f in files)}
    write_json(f"{folder}/manifest.json", manifest)
    return manifest


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """All records of a complete folder, digests checked; a file is read by one task, record by record.

    A revisit has no payload of its own: join on refers_to for it.
    """
    files = read_json(f"{folder}/manifest.json")["files"]
    rows = spark.createDataFrame([(f["file"],) for f in files], "file string")
    # a task for each file, however many tasks the list itself came in
    rows = rows.repartition(max(1, min(len(files), 10_000)), "file")
    found = rows.mapInArrow(_read_files(folder, with_payload), _RECORD)
    return found if with_payload else found.drop("payload")
