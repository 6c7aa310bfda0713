"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowworth.llm.text import ORDER, SALT, U64, batches, fold, hash_sample, mix, span_hashes, word_bounds
from rowworth.operators.ordering import exact_percentiles
from rowworth.session import broadcast_if_small, settle

BUCKETS = 1 << 15
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = 1
_KIND[ord("0") : ord("9") + 1] = 2


def ngram_buckets(text: str | None) -> np.ndarray:
    """Buckets of a text's n-grams, in four ranges of equal size: words, their pairs, word forms, their pairs.

    A form says how a word is made (letters, digits, which mark it starts and ends with, whether
    it repeats the word before).
    """
    buffer = fold(text)
    starts, ends = word_bounds(buffer)
    if not len(starts):
        return np.empty(0, dtype=np.int64)
    words = span_hashes(buffer, starts, ends)
    pairs = mix(words[:-1] * ORDER[0] + words[1:] * ORDER[1])
    first, last = buffer[starts], buffer[ends - 1]
    edge = np.where(_KIND[first] == 0, first, _KIND[first]).astype(U64) * U64(256) + np.where(_KIND[last] == 0, last, _KIND[last])
    long = np.minimum(ends - starts, 3).astype(U64)
    again = np.zeros(len(words), dtype=U64)
    again[1:] = words[1:] == words[:-1]
    forms = mix((edge * U64(4) + long) * U64(2) + again)
    form_pairs = mix(forms[:-1] * ORDER[2] + forms[1:] * ORDER[3] + SALT)
    part = U64(BUCKETS // 4)
    groups = [words, pairs, forms, form_pairs]
    return np.concatenate([(g % part + U64(k) * part).astype(np.int64) for k, g in enumerate(groups)])


def _count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's n-grams: one row for each bucket met, raw and target counts."""
    raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for texts, wanted in batches(["text", "target"], rows):
        for text, is_target in zip(texts, wanted):
            counts = np.bincount(ngram_buckets(text), minlength=BUCKETS)
            raw += counts
            if is_target:
                target += counts
    met = np.flatnonzero(raw)
    yield pa.record_batch({"bucket": pa.array(met), "raw": pa.array(raw[met]), "target": pa.array(target[met])})


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """ln(target share / raw share) of each bucket, smoothed, within each range."""

    def shares(counts):
        counts = (counts + 0.5).reshape(4, -1)
        return np.log(counts / counts.sum(axis=1, keepdims=True)).ravel()

    return shares(target) - shares(raw)


def _score(ratios: np.ndarray, length: float):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            scores = []
            for (texts,) in batches(["text"], [batch]):
                for text in texts:
                    found = ngram_buckets(text)
                    scores.append(float(ratios[found].mean() * length) if len(found) else 0.0)
            kept = batch.select([n for n in batch.schema.names if n != "text"])
            yield kept.append_column("log_weight", pa.array(scores, pa.float64()))

    return run


def best_split(scores: np.ndarray, good: np.ndarray) -> float:
    """The cut with the fewest labelled rows on the wrong side, in the middle of its gap."""
    order = np.argsort(scores, kind="stable")
    scores, good = scores[order], good[order]
    # cut i: rows before i are rejected
    wrong = np.concatenate([[0], np.cumsum(good)]) + np.concatenate([[0], np.cumsum(~good)])[-1] - np.concatenate([[0], np.cumsum(~good)])
    # cuts between equal scores are none
    wrong[1:-1][scores[1:] == scores[:-1]] = len(scores) + 1
    at = int(wrong.argmin())
    if at == 0:
        return -math.inf
    if at == len(scores):
        return math.inf
    return float(scores[at - 1] + scores[at]) / 2


def importance_resample(
    docs: DataFrame, labels: DataFrame, length: float = 64.0, fit_rows: int = 50_000, seed: int = 11, carry: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, log_weight, key, kept (and `carry`) for every row of `docs(doc_id, text)`.

    Two generative models of hashed n-grams are counted: raw over all rows, target over the rows
    that `labels(doc_id, quality)` gives quality 1. A document's log weight is its mean log ratio
    of target to raw, times `length` n-grams. Sampling is Gumbel top-k: key = log weight + Gumbel
    noise drawn from the doc_id, and the k largest keys are kept. k is the number of all rows
    whose log weight lies beyond the cut that separates the labelled ones best (at most
    `fit_rows` of them are looked at for the cut; every row counts for k). Keys equal to the k-th
    are all kept.

    Null and empty texts have no n-gram, so a log weight of 0. A null doc_id draws like any other
    value. Repeated rows get equal keys. Without rows of quality 1 every weight is 0; without
    labels of both kinds nothing is rejected. An empty table gives no row. Several labels of one
    doc_id count as the largest.
    """
    labels = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    marked = docs.select("doc_id", "text", *carry).join(broadcast_if_small(labels), "doc_id", "left")
    counts = marked.select("text", (F.coalesce("_quality", F.lit(0)) == 1).alias("target")).mapInArrow(_count, "bucket long, raw long, target long")
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[row.bucket], target[row.bucket] = row.raw, row.target
    ratios = log_ratios(raw, target) if target.any() else np.zeros(BUCKETS)
    names = ["doc_id", *carry, "_quality"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.select(*names).schema.fields)
    scored = settle(marked.select(*names, "text").mapInArrow(_score(ratios, length), f"{fields}, log_weight double"))

    seen = hash_sample(scored.where("_quality IS NOT NULL").select("doc_id", "log_weight", "_quality"), fit_rows, "doc_id")
    seen = np.array([(r[0], r[1]) for r in seen.select("log_weight", "_quality").collect()]).reshape(-1, 2)
    good = seen[:, 1] == 1
    cut = best_split(seen[:, 0], good) if good.any() and not good.all() else -math.inf
    share = (F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    keyed = scored.withColumn("key", F.col("log_weight") - F.log(-F.log(share)))
    rows, k = keyed.agg(F.count(F.lit(1)), F.count(F.when(F.col("log_weight") >= cut, 1))).first()
    if k == rows or k == 0:
        kept = F.lit(k > 0)
    else:
        # half a place below the k-th largest key
        bound = exact_percentiles(keyed, "key", {"bound": (rows - k - 0.5) / (rows - 1)}).first().bound
        kept = F.col("key") >= bound
    return keyed.select("doc_id", *carry, "log_weight", "key", kept.alias("kept"))
