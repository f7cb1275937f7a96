"""The conversation trie against a plain walk over all prefixes."""

import hashlib
import random
import zlib

import pytest

from tidelint.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", len(text or ""), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        base = c - int(c / 100) * 100
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - base, [])[:h] + turns[h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for node, own in members.items():
        below = [k for k in members if k[:len(node)] == node]
        children = {k for k in below if len(k) == len(node) + 1}
        leaves = [k for k in below if not any(len(o) == len(k) + 1 and o[:len(k)] == k for o in below)]
        saved = sum((len(members[k]) - 1) * (len(k[-1][1]) if k else 0) for k in below)
        ends = ",".join(str(c) for c in sorted(own) if len(rebuilt[c]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(seed, n):
    r = random.Random(seed)
    out = []
    for c in [*range(0, n, 100), *r.sample(range(-250, n), 60)]:
        out += [(c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", None]), r.choice(["a", "bé", "日本語", "", None, "long " * 9])) for t in range(r.randrange(1, 8))]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_equals_plain_walk(spark, seed):
    rows = made(seed, 400)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "2 AS k1", "'x' AS n", "3 AS base").repartition(3)
    assert got(prefix_trie.nodes(df)) == plain(rows)


def test_hot_groups(spark, monkeypatch):
    """A third of all conversations alike, many children of one node, and ids joined in several blocks."""
    monkeypatch.setattr(prefix_trie, "_HOT", 8)
    monkeypatch.setattr(prefix_trie, "_IDS", 3)
    monkeypatch.setattr(prefix_trie, "_BATCH", 16)
    rows = [(c, t, "user", f"turn {t}") for c in range(1, 300, 3) for t in range(8)]
    rows += [(c, t, "user", f"turn {min(t, 5)}" if t < 6 else f"own {c}") for c in range(2, 300, 3) for t in range(8)]
    assert got(prefix_trie.nodes(spark.createDataFrame(rows, SCHEMA).repartition(4))) == plain(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "lost"), (7, 0, "user", "only"), (7, 0, "user", "only"), (205, None, None, None), (200, 1, "user", "b" * 50_000), (200, 0, "user", "b"), (9_007_199_254_740_993, 0, "u", "x")]
    assert got(prefix_trie.nodes(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    assert prefix_trie.nodes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.nodes(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0
