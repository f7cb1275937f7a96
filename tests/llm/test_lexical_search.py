"""Ranked search against plain scoring of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidelint.llm import lexical_search
from tidelint.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=20):
    counted = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    counted = [(i, c, c.total()) for i, c in counted if c]
    n, length = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        asked, found = Counter(TERM.findall((text or "").translate(LOWER))), []
        for i, c, own in counted:
            m = 75 + 25 * own * n // length
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, times in asked.items() if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(seed, n, words=400):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    text = lambda size: " ".join(r.choices(vocabulary, weights, k=size))
    docs = [(i, text(r.randrange(1, 120))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(40)]                                    # ties
    docs += [docs[3], (None, docs[3][1]), (n + 50, None), (n + 51, ""), (n + 52, "... --"), (n + 53, "W1 ÉTÉ w1_w2 日本語 " * 2_000), (n + 54, "w0 " * 3)]
    items = [(j, text(r.randrange(1, 30))) for j in range(12)]
    return docs, items + [items[0], (90, None), (91, "unknown"), (92, "été w1 W2 日本語 w1"), (None, "w0 w5"), (93, "")]


@pytest.mark.parametrize("small", [False, True])
def test_equals_plain(spark, monkeypatch, small):
    if small:
        for name, value in (("_DOCS", 70), ("_ITEMS", 4), ("_STEP", 50), ("_KNOWN", 20)):
            monkeypatch.setattr(lexical_search, name, value)
    docs, items = made(1, 900)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS term", "2 AS df", "3 AS q", "4 AS score").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "'x' AS term")
    assert got(lexical_search.ranked(df, asked)) == plain(docs, items)
    assert got(lexical_search.ranked(df, asked, k=3)) == plain(docs, items, 3)


def test_empty_tables(spark):
    docs, items = (spark.createDataFrame([], s) for s in ("doc_id long, text string", "item_id long, text string"))
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lexical_search.ranked(docs, items).count() == 0
    assert lexical_search.ranked(one, items).count() == 0
    assert lexical_search.ranked(docs, one.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert lexical_search.ranked(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string"), one.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_windows_are_skipped():
    """What bounds leave out can be no better: against sums over all lists, for items of short and long lists."""
    import pyarrow as pa
    r = np.random.default_rng(4)
    n, rows = 3_000, [(0, 0, None, np.arange(3_000).tobytes(), r.integers(5, 400, 3_000).tobytes())]
    for j in range(30):
        docs = np.sort(r.choice(n, int(n / (1 + j)), replace=False)).astype(np.int32)
        rows.append((0, 0, f"t{j}".encode(), docs.tobytes(), r.integers(1, 9, len(docs)).tobytes()))
    cell = lexical_search.Cell(pa.table([list(c) for c in zip(*rows)], names=["part", "seq", "term", "docs", "numbers"]), 5_000, 900_000)
    for size in (1, 3, 12, 30):
        weights = {f"t{j}".encode(): int(r.integers(1, 5_000)) for j in r.choice(30, size, replace=False)}
        full = np.zeros(n, np.int64)
        for term, weight in weights.items():
            docs, gain = cell.lists[term]
            full[docs] += weight * gain
        order = np.lexsort((np.arange(n), -full))[:20]
        ids, scores = cell.best(weights, 20)
        assert ids.tolist() == order[full[order] > 0].tolist() and scores.tolist() == full[ids].tolist()


def test_long_text_is_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lexical_search, "_STEP", 7)
    text = "ab1 cdé, ÉF-ghijklmnop  日本語日本語 x".encode() * 9
    assert [t for some in lexical_search.terms(text) for t in some] == lexical_search._TERM.findall(text.lower())


def test_registered():
    assert "op11_lexical_search" in QUERIES
