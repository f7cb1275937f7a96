"""Scans, medians and spreads against pandas, whole and split, with a hot series."""

import numpy as np
import pandas as pd
import pytest
from helpers import frame
from pyspark.sql import functions as F

from tidelint.operators import sigma as sg
from tidelint.operators import stats
from tidelint.operators.ordering import (FirstAfter, Last, Next, Position, Prev, RunningMax, RunningSum, ordered)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    parts = []
    for name, n in (("hot", 400), ("a", 37), ("b", 1), ("c", 5)):
        v = rng.normal(20, 5, n).round(2)
        v[rng.random(n) < 0.3] = np.nan
        parts.append(pd.DataFrame({"k": name, "t": rng.permutation(n), "v": v}))
    return pd.concat(parts).sample(frac=1, random_state=1).reset_index(drop=True)


def test_scans_match_pandas(spark, layout, data):
    s = ordered(frame(spark, data), "k", "t").scan(
        p=Prev("v"), n=Next("v"), last=Last("v"), before=Last("v", inclusive=False), nxt=FirstAfter("v"),
        after=FirstAfter("v", inclusive=False), total=RunningSum(F.col("v").isNotNull().cast("long")),
        top=RunningMax("v"), pos=Position())
    got = s.rows.toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    want = data.sort_values(["k", "t"]).reset_index(drop=True)
    g = want.groupby("k")["v"]
    want["p"], want["n"] = g.shift(1), g.shift(-1)
    want["last"], want["nxt"] = g.ffill(), g.bfill()
    want["before"] = want.groupby("k")["last"].shift(1)
    want["after"] = want.groupby("k")["nxt"].shift(-1)
    want["total"] = want["v"].notna().astype(int).groupby(want["k"]).cumsum()
    want["top"] = g.cummax().groupby(want["k"]).ffill()
    want["pos"] = want.groupby("k").cumcount()
    for c in ("p", "n", "last", "before", "nxt", "after", "total", "top", "pos"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), err_msg=c)


def test_split_cuts_a_hot_series(spark, data):
    spark.conf.set("spark.tidelint.pieceRows", "50")
    try:
        s = ordered(frame(spark, data), "k", "t")
        sizes = s.df.groupBy("k", "_piece").count().collect()
    finally:
        spark.conf.unset("spark.tidelint.pieceRows")
    hot = [r["count"] for r in sizes if r["k"] == "hot"]
    assert 5 <= len(hot) <= 12 and max(hot) <= 120
    assert all(r["_piece"] is None for r in sizes if r["k"] != "hot")


def test_quantiles_are_exact_for_large_groups(spark, layout):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": ["hot"] * 9001 + ["small"] * 4 + ["tied"] * 3000,
                        "v": np.r_[rng.normal(0, 1, 9001), [1.0, 2.0, 4.0, 9.0], np.repeat([3.0, 7.0], 1500)]})
    got = stats.group_quantiles(frame(spark, pdf), "k", {"m": (F.col("v"), 0.5), "hi": (F.col("v"), 0.995)}).toPandas().set_index("k")
    want = pdf.groupby("k")["v"].quantile([0.5, 0.995]).unstack()
    np.testing.assert_allclose(got.loc[want.index, "m"], want[0.5])
    np.testing.assert_allclose(got.loc[want.index, "hi"], want[0.995])


def defined_sigma(pop, win):
    """The spread row by row, from slices."""
    v, n = pop.to_numpy(float), len(pop)

    def rows(x, f):
        first = np.arange(n) - win + 1 + (win - 1) // 2
        cuts = [x[max(a, 0):a + win] for a in first]
        return np.array([f(c) if np.isfinite(c).sum() >= 3 else np.nan for c in cuts])

    if not 11 <= win < n:
        whole = 1.4826 * np.nanmedian(np.abs(v - np.nanmedian(v))) if np.isfinite(v).any() else np.nan
        return pd.Series(whole if whole > 0 else np.nanstd(v), index=pop.index)
    mad = 1.4826 * rows(np.abs(v - rows(v, np.nanmedian)), np.nanmedian)
    own = np.where(mad > 0, mad, rows(v, lambda c: np.nanstd(c, ddof=1)))
    later = [next((x for x in [*own[i:], *own[:i][::-1]] if np.isfinite(x)), np.nan) for i in range(n)]
    return pd.Series(later, index=pop.index)


def test_rolling_sigma(spark, layout, data):
    gap = data.copy()
    gap.loc[(gap.k == "hot") & gap.t.between(0, 30), "v"] = np.nan        # windows without values
    win = {"hot": 31, "a": 12, "b": 5, "c": 30}
    df = ordered(frame(spark, gap), "k", "t").scan(pos=Position()).rows
    sizes = gap.groupby("k").size()
    df = df.withColumns({"n": F.element_at(F.create_map(*[F.lit(x) for k in win for x in (k, int(sizes[k]))]), F.col("k")).cast("long"),
                         "w": F.element_at(F.create_map(*[F.lit(x) for kv in win.items() for x in kv]), F.col("k")).cast("long")})
    got = sg.rolling_sigma(df, "k", "pos", "n", {"s": (F.col("v"), "w")}).toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    want = gap.sort_values(["k", "t"]).reset_index(drop=True)
    want["s"] = pd.concat([defined_sigma(g["v"], win[k]) for k, g in want.groupby("k")])
    assert len(got) == len(want)
    np.testing.assert_allclose(got["s"].astype(float), want["s"].astype(float))


@pytest.mark.parametrize("n, win", [(1, 11), (40, 11), (500, 12), (501, 31), (300, 299)])
def test_sliding_medians_and_deviations(n, win):
    rng = np.random.default_rng(n + win)
    v = rng.normal(5, 3, n).round(1)
    v[rng.random(n) < 0.25] = np.nan
    v[n // 3:n // 3 + win + 5] = np.where(rng.random(len(v[n // 3:n // 3 + win + 5])) < 0.5, 4.0, np.nan)     # constant stretches
    windows = sg.Windows(v, win)
    first = np.arange(n) - win + 1 + (win - 1) // 2
    cuts = [v[max(a, 0):a + win] for a in first]
    cuts = [c[np.isfinite(c)] for c in cuts]
    np.testing.assert_allclose(windows.median(), [np.median(c) if len(c) >= 3 else np.nan for c in cuts])
    want = np.array([np.std(c, ddof=1) if len(c) >= 3 else np.nan for c in cuts])
    got = windows.deviation(np.arange(n))
    np.testing.assert_allclose(got, want, atol=1e-12)
    flat = np.array([len(c) >= 3 and len(set(c)) == 1 for c in cuts])
    assert (got[flat] == 0).all()


def test_values_that_are_all_missing():
    assert np.isnan(sg.local_spread(np.full(30, np.nan), 11)).all()


def test_quantiles_with_other_aggregates(spark):
    """Groups without a value, null keys and several columns come back from the one pass."""
    pdf = pd.DataFrame({"k": ["a"] * 5 + ["b"] * 2 + [None] * 3, "v": [1.0, 2, 3, 4, np.nan, np.nan, np.nan, 7, 8, 9], "w": [5.0, 4, 3, 2, 1, 0, -1, np.nan, np.nan, 6]})
    got = stats.group_quantiles(frame(spark, pdf), "k", {"m": (F.col("v"), 0.5), "q": (F.col("w"), 0.25)}, more={"n": F.count(F.lit(1))}).toPandas()
    got = {(r.k if isinstance(r.k, str) else None): (r.m, r.q, r.n) for r in got.itertuples()}
    assert got["a"] == (2.5, 2.0, 5) and got[None] == (8.0, 6.0, 3)
    assert np.isnan(got["b"][0]) and got["b"][1:] == (-0.75, 2)


def test_nothing_is_written_for_short_series(spark, data, monkeypatch):
    """Building a query over short series counts them once and stores nothing."""
    import tidelint.operators.ordering as o
    monkeypatch.setattr(o, "shared_folder", None)
    df = frame(spark, data)
    cuts = o.measured(df, "k", "t")
    assert cuts.none
    s = ordered(df, "k", "t", cuts).scan(p=Prev("v")).scan(n=Next("p"))
    assert s.rows.count() == len(data)
