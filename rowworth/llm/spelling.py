"""Spelling variants: a two-way FM-index over the delimited vocabulary, searched half by half with one error."""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowworth.llm.text import batches
from rowworth.session import broadcast_if_small, settle

RUN = "A-Za-zÀ-ÿ"
# code points of vocabulary in one index
SHARD_CHARS = 1 << 16
# words that a task counts before it hands them on
HELD_WORDS = 200_000
_LOWER = bytes(c + 32 if ord("A") <= c <= ord("Z") else c for c in range(256))
# symbols of the indexed text: its end, the delimiter between words, then code points in order
_END, _DELIMITER, _FIRST = 0, 1, 2


def _counts(min_length: int, slip: int):
    runs = re.compile(f"[{RUN}]{{{min_length},}}")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def handed_on() -> pa.RecordBatch:
            batch = pa.record_batch({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return batch

        for ids, texts in batches(["doc_id", "text"], rows):
            for key, text in zip(ids, texts):
                start = zlib.crc32(f"{'' if key is None else key}:".encode())
                lowered = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
                for word, times in Counter(runs.findall(lowered)).items():
                    drawn = zlib.crc32(word.encode(), start)
                    if drawn % slip == 0:
                        at = drawn % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < min_length:
                            continue
                    held[word] += times
                if len(held) >= HELD_WORDS:
                    yield handed_on()
        if held:
            yield handed_on()

    return run


def vocabulary(docs: DataFrame, min_length: int = 7, min_count: int = 2, slip: int = 31) -> DataFrame:
    """(word, n) of `docs(doc_id, text)`: maximal runs of letters, A-Z lowered, one code point of every `slip`-th draw lost."""
    # a run shorter than min_length can't grow, so it is never looked at
    counted = docs.select("doc_id", "text").mapInArrow(_counts(min_length, slip), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes of `text` in order, by doubling the length that is ranked; the last symbol is its smallest and unique."""
    rank = text.astype(np.int64)
    width = 1
    while True:
        further = np.zeros(len(rank), dtype=np.int64)
        further[: len(rank) - width] = rank[width:] + 1
        both = rank * (len(rank) + int(rank.max()) + 2) + further
        order = np.argsort(both, kind="stable")
        steps = np.zeros(len(rank), dtype=np.int64)
        steps[1:] = np.cumsum(np.diff(both[order]) != 0)
        rank = np.empty(len(steps), dtype=np.int64)
        rank[order] = steps
        if steps[-1] == len(steps) - 1:
            return order
        width *= 2


class OneWay:
    """How many smaller symbols come before each place of the text's Burrows-Wheeler transform."""

    def __init__(self, text: np.ndarray, symbols: int):
        before = text[suffix_order(text) - 1]
        self.less = np.zeros((len(text) + 1, symbols + 1), dtype=np.int32)
        seen = np.zeros((len(text), symbols), dtype=np.int32)
        seen[np.arange(len(text)), before] = 1
        np.cumsum(seen, axis=0, out=seen)
        np.cumsum(seen, axis=1, out=self.less[1:, 1:])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))]).astype(np.int64)

    def step(self, own, other, size, symbol):
        """Intervals after one more symbol: `own` in this index, `other` in that of the reversed text."""
        below, above = self.less[own, symbol], self.less[own, symbol + 1]
        below_end, above_end = self.less[own + size, symbol], self.less[own + size, symbol + 1]
        count = above - below
        return self.first[symbol] + count, other + (below_end - below), (above_end - below_end) - count

    def children(self, own, size) -> tuple[np.ndarray, np.ndarray]:
        """(state, symbol) of all letters that follow any occurrence."""
        counts = np.diff(self.less[own + size] - self.less[own], axis=1)
        state, symbol = np.nonzero(counts[:, _FIRST:])
        return state, symbol + _FIRST


class VocabularyIndex:
    """Words between delimiters, indexed in both directions; an interval of suffix ranks stands for a piece of text."""

    def __init__(self, words: list[str]):
        self.words = sorted(words)
        joined = np.frombuffer("".join(self.words).encode("utf-32-le"), dtype=np.uint32)
        self.letters = np.unique(joined)
        lengths = np.array([len(w) for w in self.words], dtype=np.int64)
        text = np.full(len(joined) + len(lengths) + 1, _DELIMITER, dtype=np.int64)
        letters = np.arange(len(joined)) + np.repeat(np.arange(len(lengths)), lengths) + 1
        text[letters] = np.searchsorted(self.letters, joined) + _FIRST
        symbols = len(self.letters) + _FIRST
        end = np.array([_END])
        self.forward = OneWay(np.concatenate([text, end]), symbols)
        self.backward = OneWay(np.concatenate([text[::-1], end]), symbols)

    def _patterns(self, queries: list[str], reverse: bool) -> tuple[np.ndarray, np.ndarray]:
        """A row for each query: its symbols and the closing delimiter; -1 for letters that no word has."""
        lengths = np.array([len(q) for q in queries], dtype=np.int64)
        table = np.full((len(queries), int(lengths.max()) + 1), _DELIMITER, dtype=np.int64)
        joined = np.frombuffer("".join(q[::-1] if reverse else q for q in queries).encode("utf-32-le"), dtype=np.uint32)
        at = np.minimum(np.searchsorted(self.letters, joined), len(self.letters) - 1)
        row = np.repeat(np.arange(len(queries)), lengths)
        table[row, np.arange(len(joined)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.where(
            self.letters[at] == joined, at + _FIRST, -1
        )
        return table, lengths

    def near(self, queries: list[str], reverse: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers of words one error away whose left half (`reverse`: right half) is the query's.

        The half is matched exactly from the delimiter inwards, then the search extends across the
        other half to the second delimiter and may differ once.
        """
        # to the right an occurrence is followed in the reversed text's index, to the left in the text's own
        way = self.forward if reverse else self.backward
        table, lengths = self._patterns(queries, reverse)
        half = lengths - lengths // 2 if reverse else lengths // 2
        query = np.arange(len(queries))
        place = np.zeros(len(queries), dtype=np.int64)
        own = np.full(len(queries), way.first[_DELIMITER])
        other, size = own.copy(), np.full(len(queries), way.first[_DELIMITER + 1] - way.first[_DELIMITER])
        exact = (query, place, own, other, size)
        erring = tuple(np.empty(0, dtype=np.int64) for _ in range(5))
        found, steps = [], 0

        def matched(states):
            query, place, own, other, size = states
            symbol = table[query, place]
            there = symbol >= 0
            query, place, own, other, size, symbol = (x[there] for x in (query, place, own, other, size, symbol))
            own, other, size = way.step(own, other, size, symbol)
            some = size > 0
            return tuple(x[some] for x in (query, place + 1, own, other, size))

        while len(exact[0]) or len(erring[0]):
            if len(erring[0]):
                erring = matched(erring)
                done = erring[1] > lengths[erring[0]]
                # the text between two delimiters: ranks of delimiters follow the order of the words
                rank = (erring[2] if reverse else erring[3])[done]
                found.append((erring[0][done], rank - 2))
                erring = tuple(x[~done] for x in erring)
            fresh = []
            if len(exact[0]):
                query, place, own, other, size = (x[exact[1] >= half[exact[0]]] for x in exact)
                inside = place < lengths[query]
                fresh.append((query[inside], place[inside] + 1, own[inside], other[inside], size[inside]))
                state, symbol = way.children(own, size)
                q, p, i = query[state], place[state], inside[state]
                after = way.step(own[state], other[state], size[state], symbol)
                fresh.append((q, p, *after))
                swapped = i & (table[q, p] != symbol)
                fresh.append((q[swapped], p[swapped] + 1, *(x[swapped] for x in after)))
                exact = matched(exact)
                within = exact[1] <= lengths[exact[0]]
                exact = tuple(x[within] for x in exact)
            if fresh:
                erring = tuple(np.concatenate(parts) for parts in zip(erring, *fresh))
            steps += 1
            if steps % 16 == 0 and len(erring[0]):
                # in long runs of one letter many errors come to the same
                _, once = np.unique(np.stack(erring), axis=1, return_index=True)
                erring = tuple(x[once] for x in erring)
        if not found:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        both = np.concatenate([q for q, _ in found]) * len(self.words) + np.concatenate([w for _, w in found])
        both = np.unique(both)
        return both // len(self.words), both % len(self.words)


def _answers(index: VocabularyIndex, times: np.ndarray, queries: list[str], reverse: bool) -> pa.RecordBatch:
    """For each query its near words in this index: how many, and the commonest one."""
    asked, word = index.near(queries, reverse)
    if reverse:
        # those that keep the left half too have been found from that side
        keep = np.array([index.words[w][: len(queries[q]) // 2] != queries[q][: len(queries[q]) // 2] for q, w in zip(asked, word)], dtype=bool)
        asked, word = asked[keep], word[keep]
    order = np.lexsort((word, -times[word], asked))
    asked, word = asked[order], word[order]
    first = np.flatnonzero(np.diff(asked, prepend=-1))
    count = np.diff(first, append=len(asked))
    return pa.record_batch(
        {
            "word": pa.array([queries[q] for q in asked[first]], pa.string()),
            "found": pa.array(count, pa.int64()),
            "best_n": pa.array(times[word[first]], pa.int64()),
            "best": pa.array([index.words[w] for w in word[first]], pa.string()),
        }
    )


def _search(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by shard, words to be indexed first; the others only ask."""
    now, index, times = None, None, None
    waiting: list[tuple[str, int]] = []

    def indexed():
        nonlocal index, times
        waiting.sort()
        words = [w for w, _ in waiting]
        times = np.array([n for _, n in waiting], dtype=np.int64)
        index = VocabularyIndex(words)
        waiting.clear()
        return words

    for shards, own, words, counts in batches(["shard", "own", "word", "n"], rows, 4096):
        for (shard, target), part in itertools.groupby(zip(shards, own, words, counts), key=lambda r: (r[0], r[1])):
            if shard != now:
                if waiting:
                    asking = indexed()
                    yield _answers(index, times, asking, now.startswith("s"))
                now, index = shard, None
            if target:
                waiting.extend((w, n) for _, _, w, n in part)
            else:
                if waiting:
                    asking = indexed()
                    yield _answers(index, times, asking, now.startswith("s"))
                if index is not None:
                    yield _answers(index, times, [w for _, _, w, _ in part], now.startswith("s"))
    if waiting:
        asking = indexed()
        yield _answers(index, times, asking, now.startswith("s"))


def _dealt(words: DataFrame, side: str, key) -> DataFrame:
    """(shard, own, word, n): words with one key meet in a shard; a key with many words has several,
    each of them indexed in one and asked for in all."""
    keyed = words.withColumn("key", key)
    sizes = keyed.groupBy("key").agg(F.sum(F.char_length("word") + 1).alias("chars"))
    total = sizes.agg(F.sum("chars")).first()[0] or 0
    shards = max(1, -(-total // SHARD_CHARS))
    # at most one row for each short key of the alphabet, and only keys that fill a shard
    heavy = sizes.where(F.col("chars") > SHARD_CHARS).select("key", F.ceil(F.col("chars") / SHARD_CHARS).cast("int").alias("blocks"))
    marked = keyed.join(broadcast_if_small(heavy), "key", "left")
    light = marked.where("blocks IS NULL").select(
        F.concat(F.lit(side), F.pmod(F.xxhash64("key"), F.lit(shards))).alias("shard"), F.lit(True).alias("own"), "word", "n"
    )
    block = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    split = marked.where("blocks IS NOT NULL").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = split.select(F.concat_ws(":", F.lit(side), "key", "block").alias("shard"), (F.col("block") == block).alias("own"), "word", "n")
    return light.unionByName(split)


def spelling_variants(docs: DataFrame, min_length: int = 7, min_count: int = 2, ratio: int = 10, slip: int = 31) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of `docs(doc_id, text)` that is long and frequent enough.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF in whole texts, with A-Z lowered; a run
    whose draw (crc32 of `<doc_id>:<run>`) is a multiple of `slip` loses a code point. Two words are
    near if one insertion, deletion or replacement turns one into the other. A word's form is its
    commonest near word (ties: the smallest) if that is at least `ratio` times as common; root follows
    forms to the last one.

    One error lies in one half, so the other half is exact. Words that share their first letters
    meet in a shard, and once more those that share their last letters; each shard indexes its words
    in both directions and asks for all of them at once. A key that fills more than one index has
    blocks: every word is in one of them and asks in all. Only counts and the best word leave a task.

    Null and empty texts have no words; a null doc_id counts as an empty text in the draw. Repeated
    rows count again. Other columns are not read. An empty table gives no rows.
    """
    if min_length < 2:
        raise ValueError("halves of words need min_length of 2 or more")
    words = settle(vocabulary(docs, min_length, min_count, slip))
    letters = min(3, min_length // 2)
    dealt = _dealt(words, "p", F.substring("word", 1, letters)).unionByName(_dealt(words, "s", F.substring("word", -letters, letters)))
    answers = (
        dealt.repartition("shard").sortWithinPartitions("shard", F.desc("own"))
        .mapInArrow(_search, "word string, found long, best_n long, best string")
    )
    near = answers.groupBy("word").agg(
        F.sum("found").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("top")
    )
    top_n = -F.col("top.less")
    formed = settle(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(top_n >= ratio * F.col("n"), F.col("top.best")).alias("form"),
            F.when(top_n >= ratio * F.col("n"), top_n).alias("form_n"),
        )
    )
    # each jump doubles the way; counts grow by `ratio` with every form, so few jumps reach the end
    jumps = settle(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = settle(jumps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        jumps = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return formed.join(jumps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
