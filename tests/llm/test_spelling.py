"""Spelling variants against a brute-force version, and on nulls, empties, ties, repeats and odd columns."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rowworth.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, text string, word string, n long, shard string, key string, root string"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, min_length=7, min_count=2, ratio=10):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            drawn = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if drawn % 31 == 0:
                word = word[: drawn % len(word)] + word[drawn % len(word) + 1 :]
            counts[word] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    around = {w: [v for v in counts if near(v, w)] for w in counts}
    form = {}
    for word, others in around.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= ratio * counts[word]:
            form[word] = best
    found = {}
    for word, n in counts.items():
        root = word
        while root in form:
            root = form[root]
        found[word] = (form.get(word), root, n, len(around[word]), counts.get(form.get(word)))
    return found


def corpus():
    rng = random.Random(11)
    letters = "abcéñ"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 12))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaaa"]
    stems += [stem + "b" for stem in stems[:10]]

    def slip(word):
        at, kind = rng.randrange(len(word)), rng.randrange(4)
        return [word, word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1 :]][kind]

    rows = []
    for key in range(120):
        picked = [rng.choice(stems[: rng.choice([3, 70])]) for _ in range(60)]
        rows.append((key, " ".join(slip(w) if rng.random() < 0.1 else w.title() for w in picked)))
    rows += [(200, None), (201, ""), (202, "1 2 ,"), (None, rows[0][1]), (3, rows[3][1]), (203, "Ünîcöde×÷ unicode " * 3)]
    return rows


def answers(spark, rows, **options):
    docs = spark.createDataFrame([(k, t, "w", 1, "s", "k", "r") for k, t in rows], COLUMNS)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(docs, **options).collect()}


def test_variants_as_brute_force(spark):
    rows = corpus()
    want = brute(rows)
    assert sum(w[0] is not None for w in want.values()) > 5 and max(w[3] for w in want.values()) > 3
    assert answers(spark, rows) == want


def test_common_beginnings_are_split(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SHARD_CHARS", 60)
    rows = corpus()
    assert answers(spark, rows, ratio=2) == brute(rows, ratio=2)


def test_short_words_and_odd_tables(spark):
    rows = [(1, "cat bat cat bat cat hat hat Cat cart"), (2, "cart cat"), (3, None)]
    assert answers(spark, rows, min_length=3, ratio=2) == brute(rows, min_length=3, ratio=2)
    assert answers(spark, []) == {}
    assert answers(spark, [(1, "x" * 2_000 + " " + "x" * 2_000), (2, "x" * 2_001)], min_count=1).keys() == brute(
        [(1, "x" * 2_000 + " " + "x" * 2_000), (2, "x" * 2_001)], min_count=1).keys()
    with pytest.raises(ValueError):
        answers(spark, [], min_length=1)


def test_suffixes_in_order():
    rng = random.Random(2)
    for _ in range(20):
        text = [rng.randrange(1, 4) for _ in range(rng.randrange(1, 40))] + [0]
        assert list(spelling.suffix_order(np.array(text))) == sorted(range(len(text)), key=lambda i: text[i:])


def test_halves_find_all_errors():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(2, 8))) for _ in range(120)})
    index = spelling.VocabularyIndex(words)
    queries = words + ["zzzz", "abzab"]
    left = set(zip(*(x.tolist() for x in index.near(queries, False))))
    right = set(zip(*(x.tolist() for x in index.near(queries, True))))
    want = {(q, w) for q, a in enumerate(queries) for w, b in enumerate(words) if near(a, b)}
    assert left | right == want
    assert left >= {(q, w) for q, w in want if queries[q][: len(queries[q]) // 2] == words[w][: len(queries[q]) // 2]}
