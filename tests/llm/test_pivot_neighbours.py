"""Links and components of vectors against all pairs."""

import numpy as np
import pytest

from tidelint.llm import pivot_neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, limit=0.93):
    fine = [k for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = [set() for _ in rows], list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for at, i in enumerate(fine):
        for j in fine[at + 1:]:
            a, b = (np.array(rows[k][1], np.float32).astype(np.float64) for k in (i, j))
            if rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= limit:
                links[i].add(j)
                links[j].add(i)
                root[top(i)] = top(j)
    least = {}
    for k in fine:
        least[top(k)] = min(rows[k][0], least.get(top(k), rows[k][0]))
    out = []
    for k, (i, _, _) in enumerate(rows):
        component = least.get(top(k), i) if k in fine else i
        out.append((i, len(links[k]), component, i == component))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def spread(r, centre, size, angle):
    """Vectors at about that angle from a direction."""
    side = r.normal(size=(size, len(centre)))
    side -= (side @ centre)[:, None] * centre
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    return np.cos(angle) * centre + np.sin(angle) * side


def made(seed, hot=150):
    r = np.random.default_rng(seed)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(r.normal(size=(n, 32)))
    rows = [(v, int(r.integers(4))) for v in unit(300)]
    for c in unit(25):
        rows += [(v, 1) for v in spread(r, c, int(r.integers(2, 9)), r.uniform(0, 0.12))]
    centre = unit(1)[0]
    rows += [(v, 2) for v in spread(r, centre, hot, 0.1)] + [(v, 2) for v in spread(r, centre, hot // 3, 0.28)]     # a hot group and some around it
    rows += [(centre * 3, 2)] * 20 + [(centre, None), (centre, 0)]
    rows = [(i, [float(x) for x in v], label) for i, (v, label) in enumerate(rows)]
    n = len(rows)
    odd = [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 32, 1), (n + 3, [float("nan")] + [1.0] * 31, 2), (n + 4, [None] + [1.0] * 31, 2), (n + 5, [1.0, 2.0], 2),
           (n + 6, [2.0, 4.0], 2), (n + 7, [float("inf")] * 32, 2), (None, rows[-4][1], 2), rows[-4], (n + 8, [1e-30] * 32, 3), (n + 9, [3e30] * 32, 3)]
    return rows + odd


@pytest.mark.parametrize("cut", [False, True])
def test_links_and_components(spark, monkeypatch, cut):
    if cut:
        for name, value in (("_LIST", 12), ("_FEW", 4), ("_CHUNK", 40)):
            monkeypatch.setattr(pivot_neighbours, name, value)
    rows = made(3)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS row", "2 AS n", "'x' AS ball", "3 AS kind").repartition(3)
    mine, want = got(pivot_neighbours.linked(df)), plain(rows)
    assert len(mine) == len(want) and [r[0] for r in mine] == [r[0] for r in want]
    assert all(a[1] <= b[1] for a, b in zip(mine, want))                    # never a link below the limit
    assert sum(r[1] for r in mine) >= 0.97 * sum(r[1] for r in want)
    assert sum(a == b for a, b in zip(mine, want)) >= 0.9 * len(want)


def test_exact_where_all_meet(spark, monkeypatch):
    """With two pivots all vectors meet in one list, so balls, blocks and members must give every link."""
    monkeypatch.setattr(pivot_neighbours, "_LEAST", 2)
    monkeypatch.setattr(pivot_neighbours, "_MOST", 2)
    monkeypatch.setattr(pivot_neighbours, "PIVOTS", 2)
    for few, size in ((16, 2048), (3, 64)):
        monkeypatch.setattr(pivot_neighbours, "_FEW", few)
        monkeypatch.setattr(pivot_neighbours, "_LIST", size)
        rows = made(5, 90)
        assert got(pivot_neighbours.linked(spark.createDataFrame(rows, SCHEMA).repartition(2))) == plain(rows)


def test_recall_at_the_limit():
    """Pairs just above the limit share two of their four nearest pivots nearly always."""
    r = np.random.default_rng(1)
    pivots = pivot_neighbours._spread_out(pivot_neighbours._unit(r.normal(size=(2000, 64))), 256)
    a = pivot_neighbours._unit(r.normal(size=(4000, 64)))
    for cosine, least in ((0.95, 0.9), (0.98, 0.97)):
        b = np.stack([spread(r, x, 1, np.arccos(cosine))[0] for x in a])
        x, y = pivot_neighbours._near(a, pivots), pivot_neighbours._near(b, pivots)
        shared = (x[:, :, None] == y[:, None, :]).sum((1, 2))
        assert (shared >= 2).mean() >= least, (cosine, (shared >= 2).mean())


def test_empty(spark):
    assert pivot_neighbours.linked(spark.createDataFrame([], SCHEMA)).count() == 0
    assert got(pivot_neighbours.linked(spark.createDataFrame([(4, None, 1), (None, None, None)], SCHEMA))) == [(4, 0, 4, True), (None, 0, None, True)]
