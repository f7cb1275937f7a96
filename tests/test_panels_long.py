"""Panels of long series: the rows of short ones, dealt and sorted once however many operators scan them."""

import numpy as np
import pandas as pd
import pytest
from helpers import frame

from tidelint.operators import ordering
from tidelint.plans import panels as pn

SITES, VARIABLES = ["a", "b"], ["T", "S", "P"]


def readings():
    """Two sites, two semesters: instants that several loggers share, long gaps, nulls at both ends and beside borders."""
    rng = np.random.default_rng(3)
    parts = []
    for site, start, n in (("a", "2024-02-01", 150), ("b", "2024-06-29", 140), ("c", "2024-03-01", 20), ("a", "2023-05-01", 10)):
        step = rng.choice([0, 0, 20, 59, 60, 61, 300], n)
        pdf = pd.DataFrame({"site": site, "ts": pd.Timestamp(start) + pd.to_timedelta(np.cumsum(step), unit="min")})
        for name, missing in zip(VARIABLES, (0.15, 0.45, 0.1), strict=True):
            pdf[name] = np.where(rng.random(n) < missing, np.nan, rng.normal(20, 3, n).round(2))
        pdf.loc[[0, 1, 2, n - 2, n - 1], ["T", "P"]] = np.nan
        parts.append(pdf)
    out = pd.concat(parts, ignore_index=True)
    out.loc[out.ts.dt.month > 6, "S"] = np.nan               # a variable that a slice does not hold
    out["sample_no"] = rng.permutation(len(out))
    return out


def expected(pdf):
    rows = pdf[pdf.site.isin(SITES) & (pdf.ts.dt.year == 2024)].assign(semester=lambda x: np.where(x.ts.dt.month <= 6, 1, 2))
    out = {}
    for (site, semester), part in rows.groupby(["site", "semester"]):
        for var in VARIABLES:
            s = part.sort_values(["ts", "sample_no"])[["ts", "sample_no", var]].set_axis(["ts", "no", "v"], axis=1)
            origin = s.ts.min().normalize()
            s = s[s.v.notna() | ~s.ts.duplicated(keep=False)]
            held = np.flatnonzero(s.v.notna())
            if len(held) == 0:
                continue
            s = s.iloc[held[0]:held[-1] + 1]
            nodes = []
            for t, no, v, after in zip(s.ts, s.no, s.v, s.ts.shift(-1), strict=True):
                nodes.append((t, no, v))
                if after > t + pd.Timedelta("1h"):
                    nodes.append((t + pd.Timedelta("1h"), no, np.nan))
            v = np.array([x[2] for x in nodes])
            known = ~np.isnan(v)
            used = known if (~known).sum() > 0.25 * len(v) else np.ones(len(v), bool)
            index = np.cumsum(used) - 1
            fit = np.full(len(v), np.nan)
            if var != "P" and used.sum() > 1:
                fit[used] = np.maximum(np.polyval(np.polyfit(index[used], np.where(known, v, v[known].mean())[used], 1), index[used]), 0)
            for (t, no, x), f in zip(nodes, fit, strict=True):
                out[site, semester, var, t, no] = (x, f, (t - origin) / pd.Timedelta("1h"))
    return out


PANELS = {"site_parameters": pn.site_parameters, "parameter_across_sites": pn.parameter_across_sites}


@pytest.mark.parametrize("name", PANELS)
def test_panel(spark, layout, name):
    want = expected(readings())
    df = PANELS[name](frame(spark, readings()), VARIABLES, SITES, 2024, degree=1)
    assert set(df.columns) == {"site", "semester", "var", "ts", "sample_no", "value", "fit"} | ({"hours"} if "across" in name else set())
    got = df.toPandas()
    keys = list(zip(got.site, got.semester, got["var"], got.ts, got.sample_no, strict=True))
    assert len(keys) == len(want) and set(keys) == set(want)
    columns = ["value", "fit", "hours"][:len(df.columns) - 5]
    np.testing.assert_allclose(got[columns].to_numpy(float), [want[k][:len(columns)] for k in keys], rtol=1e-8, atol=1e-8)


@pytest.mark.parametrize("name", PANELS)
def test_unfitted_panel_keeps_no_column_of_its_own(spark, layout, name):
    assert "_piece" not in PANELS[name](frame(spark, readings()), VARIABLES, SITES, 2024).columns


def test_window_of_a_long_panel(spark, layout):
    """A window of clock hours from the first midnight of the semester, on stored rows."""
    got = pn.parameter_across_sites(frame(spark, readings()), VARIABLES, SITES, 2024, "2024-02-01 06:00:00", "2024-02-03 12:00:00").toPandas()
    assert len(got) and got.hours.between(6, 60).all()


@pytest.mark.parametrize("name", PANELS)
def test_long_rows_are_stored_twice_and_measured_once(spark, monkeypatch, name):
    """Every scan and every aggregate stored the rows again, 4 or 5 times, and measured them anew, 4 times."""
    seen = {"measured": 0, "stored": 0}
    measured, kept = ordering.measured, type(spark.range(1)).checkpoint

    def counted(*a):
        seen["measured"] += 1
        return measured(*a)

    def stored(self, *a):
        seen["stored"] += 1
        return kept(self, *a)

    for module in (ordering, pn):
        monkeypatch.setattr(module, "measured", counted)
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", stored)
    spark.conf.set("spark.tidelint.pieceRows", "16")
    try:
        df = PANELS[name](frame(spark, readings()), VARIABLES, SITES, 2024, degree=1)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.tidelint.pieceRows")
    assert seen == {"measured": 1, "stored": 2}
    assert "SortMergeJoin" not in plan
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
