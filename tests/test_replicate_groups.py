"""Deployments of files against one pass over a site, in one piece and in many."""

import numpy as np
import pandas as pd
import pytest
from helpers import frame

from tidelint.operators import catalog as ca

DAY = pd.Timedelta(days=1)


def one_pass(files):
    """files: (name, start, end); the oldest group that fits takes a file."""
    groups, out = [], {}
    for name, start, end in sorted(files, key=lambda f: (f[1], f[0])):
        for g in groups:
            apart = max(abs(g["start"] - start), abs(g["end"] - end))
            lengths = sorted([g["end"] - g["start"], end - start])
            alike = lengths[0] > pd.Timedelta(0) and lengths[1] - lengths[0] <= 0.05 * lengths[1]
            if apart <= DAY or (alike and apart <= 3 * DAY):
                g["end"] = max(g["end"], end)
                out[name] = g["name"]
                break
        else:
            groups.append({"name": name, "start": start, "end": end})
            out[name] = name
    return out


def spans(seed, n):
    """A site whose starts never pause for three days, so that groups reach over every border."""
    r = np.random.default_rng(seed)
    start = pd.Timestamp("2026-01-01") + pd.to_timedelta(np.cumsum(r.integers(0, 20, n)), "h")
    length = pd.to_timedelta(r.choice([24, 240, 250, 2000], n) + r.integers(-9, 10, n), "h")
    return pd.DataFrame({"site": "a", "name": [f"f{i:04d}" for i in r.permutation(n)], "start": start, "end": start + length})


@pytest.mark.parametrize("rows", [None, 25, 400])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_one_pass(spark, seed, rows):
    long, short = spans(seed, 500), spans(seed + 10, 30).assign(site="b")
    calm = spans(seed + 20, 40).assign(site="c")
    calm["start"] += pd.to_timedelta(np.arange(40) * 5, "D")
    calm["end"] += pd.to_timedelta(np.arange(40) * 5, "D")
    lone = pd.DataFrame({"site": ["a", "b"], "name": ["x1", "x2"], "start": [pd.NaT, pd.Timestamp("2026-01-05")], "end": [pd.Timestamp("2026-01-05"), pd.NaT]})
    pdf = pd.concat([long, short, calm, lone]).sample(frac=1, random_state=seed)
    if rows:
        spark.conf.set("spark.tidelint.pieceRows", str(rows))
    try:
        got = ca.group_replicates(frame(spark, pdf).repartition(4), "site", "name", "start", "end").collect()
    finally:
        spark.conf.unset("spark.tidelint.pieceRows")
    want = {(s, n): d for s, g in pdf.dropna().groupby("site") for n, d in one_pass(list(g[["name", "start", "end"]].itertuples(index=False, name=None))).items()}
    want |= {("a", "x1"): "x1", ("b", "x2"): "x2"}
    assert {(r.site, r.name): r.deployment for r in got} == want and len(got) == len(want)


def test_empty(spark):
    pdf = spans(1, 3)
    assert ca.group_replicates(frame(spark, pdf).limit(0), "site", "name", "start", "end").count() == 0
