"""Word and shingle hashes of whole texts in numpy, for code that runs inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_BYTE_CODES = np.random.RandomState(20240611).randint(0, 1 << 62, 256, dtype=np.int64).astype(U64) * U64(4) + U64(1)
# odd, so that it has an inverse modulo 2^64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
SALT = U64(0xD1B54A32D192ED03)
ORDER = np.array([pow(0xBF58476D1CE4E5B9, k + 1, 1 << 64) for k in range(64)], dtype=U64)


def _powers(base: int, count: int) -> np.ndarray:
    """base^0 .. base^(count-1) modulo 2^64, kept in a table that doubles when it is too short."""
    table = _POWERS.get(base)
    if table is None:
        table = np.ones(1, dtype=U64)
    while len(table) < count:
        table = np.concatenate([table, table * U64(pow(base, len(table), 1 << 64))])
    _POWERS[base] = table
    return table[:count]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def fold(text: str | None) -> np.ndarray:
    """UTF-8 bytes with A-Z in lower case; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return _FOLD[np.frombuffer(raw, dtype=np.uint8)]


def word_bounds(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no ASCII white space."""
    inside = np.zeros(len(buffer) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[buffer]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span lies."""
    if not len(starts):
        return np.empty(0, dtype=U64)
    codes = _BYTE_CODES[buffer] * _powers(_BASE, len(buffer))
    sums = np.zeros(len(buffer) + 1, dtype=U64)
    np.cumsum(codes, out=sums[1:])
    shifted = (sums[ends] - sums[starts]) * _powers(_BASE_INVERSE, len(buffer))[starts]
    return mix(shifted + (ends - starts).astype(U64) * SALT)


def word_hashes(text: str | None) -> np.ndarray:
    buffer = fold(text)
    return span_hashes(buffer, *word_bounds(buffer))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words in order; of the whole sequence if it is shorter."""
    count = len(words)
    if count == 0:
        return words
    width = min(size, count)
    total = np.zeros(count - width + 1, dtype=U64)
    for k in range(width):
        total += words[k : count - width + 1 + k] * ORDER[k]
    return mix(total + U64(width * int(SALT) % (1 << 64)))


def batches(columns: list[str], rows: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[tuple[list, ...]]:
    """Arrow batches as lists of Python values, one list for each column, `size` rows at a time."""
    for batch in rows:
        found = [batch.column(batch.schema.get_field_index(c)) for c in columns]
        for at in range(0, batch.num_rows, size):
            yield tuple(c.slice(at, size).to_pylist() for c in found)
    _give_back()


def _give_back() -> None:
    """Hand freed memory back to the system: a Python worker lives on after its task, idle or for the next one."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # no glibc: nothing to trim


HASH_KEYS = 1 << 40


def hash_key(*by: str) -> Column:
    """A number under HASH_KEYS, spread by the hash of `by`."""
    return F.pmod(F.xxhash64(*by, F.lit(29)), F.lit(HASH_KEYS))


def hash_sample(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """At most `rows` rows, those with the smallest hashes of `by`.

    Only about four times as many pass a bound on the hash before they are ordered, so what is
    ordered does not grow with the number of tasks.
    """
    share = min(1.0, 4 * (rows + 50) / max(df.count(), 1))
    drawn = hash_key(*by)
    return df.where(drawn <= int(share * HASH_KEYS)).orderBy(drawn, *by).limit(rows)


def lean_batches(spark: SparkSession) -> None:
    """Hold Arrow batches of this session to 8 MB and 2000 rows: texts are long, and a task's JVM
    and Python sides each hold a batch several times over."""
    for name, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 8 << 20)):
        spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
