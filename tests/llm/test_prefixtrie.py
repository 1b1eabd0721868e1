"""The prefix trie against a plain one, with small blocks and segments."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from scriptspark.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n_convs long"


def brute(rows):
    """Rows of the contract from (conv_id, turn, role, text)."""
    turns = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            turns[c].append(((t is not None, t or 0), role or "", text or ""))
    turns = {c: [x[1:] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = int(c / 5) * 5
        built[c] = tuple(own if c == base else turns.get(base, [])[:h] + own[h:])
    nodes = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    kids = defaultdict(set)
    for seq in nodes:
        if seq:
            kids[seq[:-1]].add(seq)
    saved, leaves = defaultdict(int), defaultdict(int)
    for seq, members in nodes.items():
        for d in range(len(seq) + 1):
            saved[seq[:d]] += (len(members) - 1) * len(seq[-1][1].encode()) if seq else 0
            leaves[seq[:d]] += not kids[seq]
    out = []
    for seq, members in nodes.items():
        ends = sorted(c for c in members if built[c] == seq)
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(members), len(seq), min(nodes[seq[:-1]]) if seq else None, len(members), len(kids[seq]), leaves[seq], saved[seq], digest))
    return sorted(out, key=str)


def made(spark, rows, segment=64, block=20_000):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, prefixtrie.trie(*prefixtrie.rebuilt(prefixtrie.numbered(df)), segment, block).collect()), key=str)


def family(rng, ids, turns, words):
    return [(c, t, rng.choice(["user", "assistant"][:1 + words // 3]), rng.choice("a bb ccc é dd".split()[:words])) for c in ids for t in range(rng.randrange(turns))]


@pytest.mark.parametrize(("segment", "block"), [(64, 20_000), (2, 3), (3, 1), (1, 4), (64, 2)])
def test_against_plain_trie(spark, segment, block):
    rng = random.Random(segment * 10 + block)
    rows = family(rng, range(-7, 40), 9, 2) + family(rng, range(40, 60), 4, 5) + family(rng, [71, 72, 75], 30, 1)
    assert made(spark, rows, segment, block) == brute(rows)


def test_copies_and_odd_rows(spark):
    same = [(c, t, "user", "hello") for c in range(0, 200, 5) for t in range(3)]
    odd = [(1000, None, None, None), (1000, None, "user", "x"), (1000, 0, "user", "x"), (1000, 0, "user", "x"), (None, 1, "user", "lost"), (1001, 5, "user", ""), (1003, 0, "", None)]
    rows = same + odd
    assert made(spark, rows, 64, 5) == brute(rows)


def test_conversation_over_many_tasks(spark):
    rows = [(3, t, "user", str(t % 5)) for t in range(700)] + [(4, t, "user", str(t % 5)) for t in range(500)] + [(0, t, "user", str(t % 5)) for t in range(4)]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        turns = prefixtrie.numbered(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))
        assert {(r.conv_id, r.pos) for r in turns.collect()} == {(c, t) for c, t, *_ in rows}
        assert made(spark, rows, 8, 10) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_empty_table(spark):
    assert made(spark, []) == []


def test_extents_by_binary_search():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 5, 300)
    table = prefixtrie.Minima(x)
    for a, d in zip(rng.integers(0, 300, 200).tolist(), rng.integers(0, 5, 200).tolist(), strict=True):
        up = next((p for p in range(a, 300) if x[p] < d), 300)
        down = next((p for p in range(a, -1, -1) if x[p] < d), 0)
        one = np.array([a])
        assert (int(table.upto(one, np.array([d]), 300)[0]), int(table.back(one, np.array([d]), 0)[0])) == (up, down)
        b = int(rng.integers(a, 300))
        assert int(table.least(one, np.array([b]))[0]) == x[a : b + 1].min()
