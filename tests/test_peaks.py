"""Turning points of casts, from the definition of a peak's prominence and width."""

import numpy as np
import pandas as pd
import pytest
from helpers import column, frame

from tidelint.operators import peaks
from tidelint.operators.preprocess import cast_phase


def defined(v):
    """Peaks and widths one by one, outwards from each peak."""
    out, n = [], len(v)
    for first in range(1, n):
        last = first
        while last + 1 < n and v[last + 1] == v[first]:
            last += 1
        if last + 1 >= n or not (v[first - 1] < v[first] and v[last + 1] < v[first]):
            continue
        p = (first + last) // 2
        sides = []
        for way in (-1, 1):
            i, low, base = p, v[p], p
            while 0 <= i < n and v[i] <= v[p]:
                if v[i] < low:
                    low, base = v[i], i
                i += way
            sides.append((low, base))
        level = v[p] - (v[p] - max(sides[0][0], sides[1][0])) / 2
        ends = []
        for way, (_, base) in zip((-1, 1), sides):
            i = p
            while i != base and v[i] > level:
                i += way
            ends.append(i + (-way) * (level - v[i]) / (v[i - way] - v[i]) if v[i] < level else i)
        out.append((p, ends[1] - ends[0]))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_widths_by_definition(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(300, 1200))
    v = (20 * np.sin(np.arange(n) / r.uniform(20, 90)) + np.cumsum(r.normal(0, 0.2, n)) + r.normal(0, 0.5, n)).round(int(r.integers(0, 3)))
    if seed % 2:
        v[r.random(n) < 0.004] = np.nan
    at, widths = peaks.peak_widths(v)
    want = defined(v)
    assert at.tolist() == [p for p, _ in want]
    wide = [i for i, (_, w) in enumerate(want) if w >= 50]
    np.testing.assert_allclose(widths[wide], [want[i][1] for i in wide])
    assert sum(widths >= 50) == len(wide)


def test_first_wide_peak_not_the_deepest():
    """A cast of several dips turns at the first one that is wide enough; a dip of 50 to 100 samples counts only where none is wider."""
    dip = lambda width, depth: depth * (1 - np.abs(np.linspace(-1, 1, width)))
    cast = np.concatenate([dip(41, 9), dip(121, 30), dip(241, 20), dip(301, 80)])
    assert peaks.turning_point(cast) == 41 + 121 + 120
    assert peaks.turning_point(cast[:162]) == 41 + 60
    assert peaks.turning_point(cast[:41]) is None
    assert peaks.turning_point(np.arange(500.0)) is None and peaks.turning_point(np.zeros(0)) is None
    assert peaks.turning_point(np.full(400, np.nan)) is None and peaks.turning_point(np.full(400, 3.0)) is None


def test_plateau_turns_in_its_middle():
    cast = np.concatenate([np.arange(200.0), np.full(11, 200.0), np.arange(200.0)[::-1]])
    assert peaks.turning_point(cast) == 205


def test_phases(spark):
    deep = np.concatenate([np.arange(150.0), np.arange(150.0)[::-1]])
    pdf = pd.concat([pd.DataFrame({"k": "a", "sample_no": np.arange(300), "p": deep}),
                     pd.DataFrame({"k": "b", "sample_no": np.arange(20), "p": np.arange(20.0)}),
                     pd.DataFrame({"k": "c", "sample_no": np.arange(3), "p": [np.nan] * 3})])
    got = cast_phase(frame(spark, pdf).repartition(3), "k", "sample_no", "p")
    a = got.where("k = 'a'")
    assert column(a, "descending") == [i <= 149 for i in range(300)] and column(a, "ascending") == [i >= 149 for i in range(300)]
    assert got.where("k <> 'a' and descending and ascending").count() == 23
    assert cast_phase(frame(spark, pdf).limit(0), "k", "sample_no", "p").count() == 0
