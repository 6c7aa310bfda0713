"""Removed repeats against a brute-force version, and on nulls, empties, ties, repeats and odd columns."""

import hashlib
import random

import numpy as np
import pytest

from rowworth.llm import suffix_family

SCHEMA = "doc_id long, text string, block long, low long, ids string, packed string"


def brute(rows, least=50):
    starts = {}
    for key, text in rows:
        raw = (text or "").encode()
        if key is not None:
            for i in range(len(raw) - least + 1):
                part = raw[i : i + least]
                starts[part] = min(key, starts.get(part, key))
    found = []
    for key, text in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        if key is not None:
            for i in range(len(raw) - least + 1):
                if starts[raw[i : i + least]] < key:
                    gone[i : i + least] = [True] * least
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        found.append((-1 if key is None else key, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(found)


def answers(spark, rows, least=50, **options):
    docs = spark.createDataFrame([(k, t, 1, 2, "i", "p") for k, t in rows], SCHEMA)
    found = suffix_family.remove_repeats(docs, least, **options).collect()
    for r in found:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)


def corpus():
    rng = random.Random(8)
    syllables = ["ka", "lo", "né", "ri", "tu", "so", "ß "]

    def prose(size):
        return "".join(rng.choice(syllables) + rng.choice(["", "", " "]) for _ in range(size))

    passages = [prose(rng.randrange(15, 80)) for _ in range(12)]
    rows = []
    for key in range(150):
        pieces = [prose(rng.randrange(0, 60)) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            passage = rng.choice(passages)
            cut = rng.randrange(len(passage) // 2)
            pieces.insert(rng.randrange(len(pieces)), passage[cut : len(passage) - rng.randrange(3)])
        rows.append((key * 3, "".join(pieces)))
    copy = prose(300)
    rows += [(1000 + i, copy if i % 3 else copy[: 100 + i] + "X" + copy[100 + i :]) for i in range(60)]
    rows += [(2000, None), (2001, ""), (2002, "short"), (2003, "a" * 3000), (2004, "b" + "a" * 700), (2005, "ab" * 400), (2006, "ba" * 300)]
    rows += [(None, copy), (None, None), (5, copy[:200]), (5, copy[:120]), (5, copy[100:260]), rows[3], rows[3], (-7, passages[0])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block_bytes", [None, 3000, 400])
def test_removed_as_brute_force(spark, block_bytes):
    rows = corpus()
    want = brute(rows)
    assert sum(w[2] for w in want) > 10_000
    assert answers(spark, rows, block_bytes=block_bytes) == want


def test_small_batches_and_other_lengths(spark, monkeypatch):
    rows = corpus()
    assert answers(spark, rows, least=17, block_bytes=2000) == brute(rows, 17)
    assert answers(spark, [(1, "abcab"), (2, "bca"), (3, "cab"), (4, "x")], least=2) == brute([(1, "abcab"), (2, "bca"), (3, "cab"), (4, "x")], 2)


def test_kept_bytes_and_small_tables(spark):
    docs = spark.createDataFrame([(1, "é" * 40), (2, "x" + "é" * 40 + "yz")], "doc_id long, text string")
    found = {r.doc_id: bytes(r.kept) for r in suffix_family.remove_repeats(docs, with_kept=True).collect()}
    assert found == {1: ("é" * 40).encode(), 2: b"xyz"}
    assert answers(spark, []) == []
    assert answers(spark, [(None, "x" * 100), (1, "x" * 100)]) == brute([(None, "x" * 100), (1, "x" * 100)])


def test_one_document_in_many_blocks(spark):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdef ") for _ in range(400))
    rows = [(4, text)] * 30 + [(4, text[50:] + str(i)) for i in range(30)] + [(5, text), (3, text[:70])]
    assert answers(spark, rows, block_bytes=900) == brute(rows)


def test_family_levels_fall_and_know_everything():
    rng = random.Random(10)
    family, seen = suffix_family.Family(), set()
    for rank in range(60):
        batch = [bytes(rng.choices(b"ab\x00", k=6)) for _ in range(rng.randrange(1, 30))]
        got = family.add(np.array(batch, dtype="S6"), np.full(len(batch), rank))
        assert got.tolist() == [b in seen for b in batch]
        seen |= set(batch)
        sizes = [len(level) for level in family.levels]
        assert sum(sizes) == len(seen) and all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    both = np.array([b"x", b"x", b"y", b"y"], dtype="S6")
    assert suffix_family.Family().add(both, np.array([2, 1, 3, 3])).tolist() == [True, False, False, False]
