"""Work that grew faster than its tables: pieces of long series, blocks of intervals, joins of a table with itself."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelint.operators import preprocess as pp
from tidelint.operators import sigma as sg
from tidelint.operators import timejoin as tj
from tidelint.operators.ordering import Position, ordered


def test_a_worker_holds_short_runs_of_a_long_series(spark, monkeypatch):
    """Pieces for the spread are as long as their windows need, however long the pieces of a scan are."""
    most, whole = 40 + 2 * 11, sg.whole_groups

    def watched(batches, group):
        for t, starts in whole(batches, group):
            longest = max(b - a for a, b in zip(starts, [*starts[1:], t.num_rows], strict=True))
            assert longest <= most, longest
            yield t, starts

    monkeypatch.setattr(sg, "whole_groups", watched)
    monkeypatch.setattr(sg, "_RUN", 40, raising=False)
    v = np.random.default_rng(5).normal(10, 2, 900).round(2)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "t": range(900), "v": v}))
    spark.conf.set("spark.tidelint.pieceRows", "300")
    try:
        df = ordered(df, "k", "t").scan(pos=Position()).rows.withColumns({"n": F.lit(900).cast("long"), "w": F.lit(11).cast("long")})
        got = sg.rolling_sigma(df, "k", "pos", "n", {"s": (F.col("v"), "w")}).toPandas().sort_values("t")
    finally:
        spark.conf.unset("spark.tidelint.pieceRows")
    np.testing.assert_allclose(got["s"], sg.filled(sg.local_spread(v, 11)))


def intervals(spark, n):
    rng = np.random.default_rng(n)
    start = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 10**12, n), unit="us")
    span = pd.to_timedelta(rng.integers(0, 10**11, n), unit="us")
    files = pd.DataFrame({"k": rng.choice(["a", "b"], n), "s": start, "e": start + span, "f": [f"f{i}" for i in range(n)]})
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 10**12, 60), unit="us")
    points = pd.DataFrame({"k": rng.choice(["a", "b", "c"], 60), "i": range(60), "at": at})
    points.loc[0, "at"], points.loc[0, "k"] = files.s[0] - pd.Timedelta("1h"), files.k[0]            # on an edge
    points.loc[1, "at"], points.loc[1, "k"] = files.e[1] + pd.Timedelta("1h"), files.k[1]
    return files, points


def ntz(spark, pdf, *columns):
    return spark.createDataFrame(pdf).withColumns({x: F.col(x).cast("timestamp_ntz") for x in columns})


def test_shortest_cover(spark, layout):
    files, points = intervals(spark, 150)
    hour, want = pd.Timedelta("1h"), {}
    for p in points.itertuples():
        over = [(f.e - f.s, f.f) for f in files[files.k == p.k].itertuples() if f.s - hour <= p.at <= f.e + hour]
        want[p.i] = min(over)[1] if over else None
    at = ntz(spark, points, "at")
    at = at.union(at.limit(1).select(F.lit(None).cast("string"), F.lit(-1).cast("long"), "at")).union(at.limit(1).select("k", F.lit(-2).cast("long"), F.lit(None).cast("timestamp_ntz")))
    held = ntz(spark, files, "s", "e")
    held = held.union(held.limit(1).select("k", "s", F.lit(None).cast("timestamp_ntz"), F.lit("open"))).union(held.select(F.lit(None).cast("string"), "s", "e", "f").limit(1))
    got = {r.i: r.f for r in tj.covering_interval(at, held, "k", "at", "s", "e", "f").collect()}
    assert got == want | {-1: None, -2: None}


def test_blocks_follow_the_points_that_are_asked(spark, monkeypatch):
    """An interval is cut at the points it holds, not at its microseconds, which took about 200 blocks an interval."""
    files, points = intervals(spark, 400)
    blocks, made = tj._blocks, spark.sparkContext.accumulator(0)

    def counted(lo, hi):
        cut = blocks(lo, hi)
        seen = F.udf(lambda x: made.add(len(x)) or x, "array<struct<level:int,block:bigint>>")
        return seen(cut)

    monkeypatch.setattr(tj, "_blocks", counted)
    tj.covering_interval(ntz(spark, points, "at"), ntz(spark, files, "s", "e"), "k", "at", "s", "e", "f").collect()
    assert 0 < made.value <= 10 * len(files)


def explained(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["k", ["k"]])
def test_deployment_reads_its_table_once(spark, key):
    """Short series share one exchange; the table was joined with itself, eight scans in all."""
    rows = [("a", 1, 5.0, None, None), ("a", 2, None, "x", None), ("a", 3, 6.0, None, None), ("a", 4, 7.0, None, None), ("a", 5, None, None, "x"), ("a", 6, 8.0, None, None),
            (None, 1, 1.0, None, None), (None, 2, 2.0, "x", None), (None, 3, None, None, "x"), ("b", 1, 1.0, None, None), ("b", 2, 1.0, None, None), ("b", 3, 2.0, "x", None)]
    df = spark.createDataFrame(rows, "k string, t int, v double, d string, e string")
    out = pp.deployment_window(df, key, "t", "v", ["d"], ["e"], ["d", "e"])
    got = sorted((r.k or "", r.t) for r in out.collect())
    assert got == [("", 1), ("", 2), ("a", 3), ("a", 4), ("b", 1), ("b", 2), ("b", 3)]
    assert "Join" not in explained(out)
