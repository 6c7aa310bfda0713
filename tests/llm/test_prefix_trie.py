"""The conversation trie against a brute-force version, and on nulls, empties, ties, repeats and odd columns."""

import hashlib
import random
import zlib

import numpy as np

from rowworth.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, key string, depth int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        whole[conv] = tuple(own.get(conv - conv % 5, [])[:h] + turns[h:])
    members, ends = {}, {}
    for conv, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], set()).add(conv)
        ends.setdefault(turns, []).append(conv)
    children = {p: set() for p in members}
    for prefix in members:
        if prefix:
            children[prefix[:-1]].add(prefix)
    leaves, saved = {}, {}
    for prefix in sorted(members, key=len, reverse=True):
        below = children[prefix]
        own_saved = (len(members[prefix]) - 1) * len(prefix[-1][1].encode()) if prefix else 0
        leaves[prefix] = sum(leaves[p] for p in below) if below else 1
        saved[prefix] = own_saved + sum(saved[p] for p in below)
    return sorted(
        (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
        for p in members
    )


def answers(spark, rows):
    turns = spark.createDataFrame([(*r, "x", "y", 7) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in prefix_trie.conversation_trie(turns).select(*COLUMNS).collect())


def keyed(rows):
    return sorted(rows, key=lambda r: (r[:2], r[3:]))


def corpus():
    rng = random.Random(5)
    rows = []
    for conv in range(400):
        length = rng.randrange(0, 9) if conv % 7 else 1
        opening = ["hello", "Grüße", "x"][rng.choice([0, 0, 0, 1, 2])]
        for turn in range(length):
            text = opening if turn == 0 else f"t{rng.randrange(3)}" if turn < 3 else f"é{rng.randrange(6)}"
            rows.append((conv, turn, rng.choice(["user", "assistant"]) if turn > 2 else "user", text))
    rows += [(1000 + i, t, "user", f"copy {t}") for i in range(300) for t in range(4)]
    rows += [(2000, None, None, None), (2000, 1, "", "a"), (2000, 1, "", "b"), (2000, 1, "", "b"), (None, 1, "user", "lost"), (2001, 0, None, "")]
    rows += [(3000, t, "user", str(t % 11)) for t in range(300)]
    rng.shuffle(rows)
    return rows


def test_trie_as_brute_force(spark):
    rows = corpus()
    assert keyed(answers(spark, rows)) == keyed(brute(rows))


def test_trie_in_many_shards(spark):
    adaptive, parts = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        rows = corpus()
        assert keyed(answers(spark, rows)) == keyed(brute(rows))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_small_tables(spark):
    for rows in ([], [(7, 0, "user", "a")], [(None, 0, "user", "a")], [(5, 0, "u", "a"), (6, 0, "u", "b"), (11, 3, "u", "long " * 50_000)]):
        assert keyed(answers(spark, rows)) == keyed(brute(rows))


def test_double_array_knows_its_sequences():
    rng = random.Random(6)
    sequences = sorted({tuple(rng.randrange(30) for _ in range(rng.randrange(0, 6))) for _ in range(300)})
    base, check, symbol, depth = prefix_trie.pack_double_array([np.array(s, dtype=np.int64) for s in sequences])
    nodes = {s[:d] for s in sequences for d in range(len(s) + 1)}
    assert int((check >= 0).sum()) == len(nodes)
    ends = {tuple(s): prefix_trie.walk(base, check, np.array(s, dtype=np.int64)) for s in nodes}
    assert all(len(way) == len(s) + 1 and (not s or symbol[way[-1]] == s[-1]) and depth[way[-1]] == len(s) for s, way in ends.items())
    assert len({way[-1] for way in ends.values()}) == len(nodes)
    assert len(prefix_trie.walk(base, check, np.array([29, 29, 29, 29, 29, 29, 29]))) < 8
