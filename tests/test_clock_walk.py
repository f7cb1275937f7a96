"""Half days of collapsed clocks against a walk from row to row."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from helpers import frame

from tidelint.operators.clocks import repair_collapsed, walked_clock


def walk(stamps, half):
    """Stamps and steps on the interval of one reading, or None where it has to stop."""
    days = list(dict.fromkeys(t.normalize() for t in stamps))
    place = [days.index(t.normalize()) for t in stamps]
    within = [(t.hour % 12) * 3600 + t.minute * 60 + t.second for t in stamps]
    steps = Counter(b - a for a, b, p, q in zip(within, within[1:], place, place[1:]) if p == q and b > a)
    if len(stamps) < 4 or not steps:
        return None
    usual = steps.most_common(1)[0][0]
    now, out, hits = place[0] * 86400 + within[0] + half * 43200, [], 0
    out.append(half)
    for p, w in zip(place[1:], within[1:]):
        times = [t for t in (p * 86400 + w, p * 86400 + w + 43200) if t > now]
        if not times:
            return None
        best = min(times, key=lambda t: abs(t - now - usual))
        hits += best - now == usual
        out.append((best - p * 86400 - w) // 43200)
        now = best
    return [t.normalize() + pd.Timedelta(seconds=w + h * 43200) for t, w, h in zip(stamps, within, out)], hits


def broken(seed):
    """A clock without AM/PM whose dates lack parts, or lie in the wrong order."""
    r = np.random.default_rng(seed)
    true = pd.date_range("2026-03-01", periods=int(r.integers(3, 260)), freq=str(r.choice(["1h", "30min", "7h", "12h", "95min"]))) + pd.Timedelta(hours=int(r.integers(24)))
    keep = r.random(len(true)) > r.choice([0, 0.02, 0.4])
    for d in r.choice(np.arange(1, 12), 2):
        keep &= ~((true.day == d) & (true.hour < 12)) if r.random() < 0.5 else ~(true.day == d)
    true = true[keep]
    if seed % 5 == 0:
        true = true[r.permutation(len(true))]
    if seed % 7 == 0 and len(true) > 9:
        true = true.insert(8, true[2])
    return [t - pd.Timedelta(hours=12) if t.hour >= 12 else t for t in true]


def test_equals_the_walk(spark, layout):
    series = {f"s{i}": broken(i) for i in range(40)} | {"few": broken(1)[:3]}
    pdf = pd.concat([pd.DataFrame({"k": k, "row": np.arange(len(v)), "ts": pd.Series(v, dtype="datetime64[ns]")}) for k, v in series.items() if len(v)])
    got = walked_clock(frame(spark, pdf).repartition(3), "k", "row").toPandas().sort_values(["k", "row"])
    ended = 0
    for k, g in got.groupby("k"):
        for name, half in (("am", 0), ("pm", 1)):
            want = walk(series[k], half) if len(series[k]) >= 4 else None
            if want is None:
                ended += 1
                assert len(g) < 4 or not g[f"{name}_ok"].all(), (k, name)
            else:
                assert g[f"{name}_ok"].all() and list(g[name]) == want[0] and g[f"{name}_step"].sum() == want[1], (k, name)
    assert 10 < ended < 60


def test_refusals(spark):
    hours = pd.date_range("2026-01-01", periods=24 * 40, freq="h")
    lux, temp = np.maximum(0.0, -np.cos(hours.hour * np.pi / 12)) * 900, 20 + np.cos((hours.hour - 13.7) * np.pi / 12)
    folded = hours.normalize() + pd.to_timedelta(hours.hour % 12, unit="h")
    shuffled = folded[np.random.default_rng(1).permutation(len(folded))]
    parts = [("sound", folded, lux, temp), ("back", shuffled, lux, temp), ("dark", folded, lux * 0, np.full(len(hours), np.nan)),
             ("dusk", folded, np.roll(lux, 6), np.roll(temp, 8))]
    pdf = pd.concat([pd.DataFrame({"k": k, "row": np.arange(len(t)), "ts": t, "lux": x, "temp": y}) for k, t, x, y in parts])
    rows, verdicts = repair_collapsed(frame(spark, pdf), "k", "row")
    verdict = {r.k: r.verdict for r in verdicts.collect()}
    assert verdict["sound"] == "repaired" and verdict["back"] == "refused: no time is left for a row"
    assert verdict["dark"] == "refused: no half can be chosen" and verdict["dusk"].startswith(("refused", "repaired"))
    got = rows.where("k = 'sound'").toPandas().sort_values("row")
    assert list(got.ts) == list(hours)
    assert repair_collapsed(frame(spark, pdf).limit(0), "k", "row")[1].count() == 0
