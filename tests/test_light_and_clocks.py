"""Published fixtures of the light channel and the clock repairs."""

import numpy as np
import pandas as pd
import pytest
from helpers import column, frame
from pyspark.sql import functions as F

from tidelint.functions.solar import clear_sky_factor
from tidelint.operators import clocks as ck
from tidelint.operators import light as li


def daylight(spark, scale, start="2026-01-01"):
    """Hourly light: 10000 x scale per day from 8 to 16 h."""
    t = pd.date_range(start, periods=24 * len(scale), freq="1h")
    lux = np.where((t.hour >= 8) & (t.hour <= 16), 10000.0, 0.0) * np.repeat(scale, 24)
    return pd.DataFrame({"series_id": "s", "sample_no": np.arange(len(t)), "ts": t, "lux": lux})


PERM = [1] * 10 + [.8, .6, .45, .4] + [.3] * 16
REC = [1] * 10 + [.8, .6, .45, .4] + [.3] * 6 + [.9] * 10
BOTH = [1] * 10 + [.3] * 3 + [.9] * 5 + [.3] * 12


@pytest.mark.parametrize("scale, cutoff, recovers", [(PERM, "2026-01-13", False), (REC, None, True), (BOTH, "2026-01-19", True)])
def test_fouling(spark, layout, scale, cutoff, recovers):
    r = li.fouling_baseline(frame(spark, daylight(spark, scale)), "series_id").first()
    assert r["evaluable"] and r["baseline"] == 10000 and r["recovers"] == recovers
    assert (str(r["cutoff"])[:10] if r["cutoff"] else None) == cutoff


def test_light_flags(spark):
    pdf = daylight(spark, PERM)
    pdf.loc[100, "lux"] = np.nan
    df = frame(spark, pdf)
    f = column(li.light_flag(df, li.fouling_baseline(df, "series_id"), "series_id", out="f"), "f")
    assert f[24] == 1 and f[100] == 9 and f[-1] == 4
    short = frame(spark, daylight(spark, [1] * 5))
    v = li.fouling_baseline(short, "series_id")
    assert not v.first()["evaluable"]
    assert set(column(li.light_flag(short, v, "series_id", out="f"), "f")) == {2}


def test_fixed_cutoff(spark):
    long = li.fixed_cutoff(frame(spark, daylight(spark, [1] * 100)), "series_id", days=60).first()
    assert str(long["cutoff"]) == "2026-03-02 00:00:00"
    assert li.fixed_cutoff(frame(spark, daylight(spark, [1] * 30)), "series_id", days=60).first()["cutoff"] is None


def test_clear_sky(spark):
    days = frame(spark, pd.DataFrame({"d": pd.date_range("2026-01-01", periods=365)}))
    got = days.select(F.dayofyear("d").alias("n"), clear_sky_factor(F.col("d"), -17.96).alias("s"), clear_sky_factor(F.col("d"), 40.0).alias("k")).toPandas().set_index("n")
    assert abs(got["s"].max() - 1) < 1e-6 and 0.62 < got.loc[172, "s"] < 0.74 and got.loc[172, "k"] > 0.95


def sunny(shift=0, scale=1.0, base=0.0, days=40):
    t = pd.date_range("2021-08-20", periods=24 * days, freq="1h")
    lux = np.clip(np.sin((t.hour - 6) / 12 * np.pi), 0, None) * 20000 * scale + base
    return pd.DataFrame({"series_id": "s", "sample_no": np.arange(len(t)), "ts": t + pd.Timedelta(hours=shift), "lux": lux})


def test_clock_phase(spark):
    ok = li.clock_phase(frame(spark, sunny()), "series_id").first()
    assert abs(ok["peak_hour"] - 12) < 0.2 and ok["daylight_fraction"] > 0.99 and ok["shift_h"] is None
    late = li.clock_phase(frame(spark, sunny(12)), "series_id").first()
    assert late["shift_h"] == 12 and late["daylight_fraction"] < 0.01
    fouled = li.clock_phase(frame(spark, sunny(scale=.01, base=5)), "series_id").first()
    assert fouled["shift_h"] is None and fouled["evaluable"]
    dark = li.clock_phase(frame(spark, sunny(scale=0).head(40)), "series_id").first()
    assert not dark["evaluable"]
    folded = sunny()
    folded["ts"] = folded.ts.where(folded.ts.dt.hour < 13, folded.ts - pd.Timedelta(hours=12))
    c = li.clock_phase(frame(spark, folded), "series_id").first()
    assert c["collapsed"] and c["shift_h"] is None


def test_swapped_clock_is_repaired(spark, layout):
    rows, verdict = ck.repair_swapped(frame(spark, sunny(12)), "series_id")
    assert verdict.first()["verdict"] == "repaired"
    assert rows.agg(F.min("ts")).first()[0] == pd.Timestamp("2021-08-21")
    assert ck.repair_swapped(frame(spark, sunny()), "series_id")[1].first()["verdict"] == "sound"


@pytest.mark.parametrize("start", [0, 5, 9, 14, 20, 22])
@pytest.mark.parametrize("step", [1, 2])
def test_collapsed_clock_is_rebuilt(spark, start, step):
    t = pd.date_range("2021-08-20", periods=24 * 30 // step, freq=f"{step}h") + pd.Timedelta(hours=start)
    pdf = pd.DataFrame({"series_id": "s", "row": np.arange(len(t)), "truth": t,
                        "ts": np.where(t.hour >= 12, t - pd.Timedelta(hours=12), t),
                        "lux": np.clip(np.sin((t.hour - 6) / 12 * np.pi), 0, None) * 20000.0,
                        "temp": 25 + np.cos((t.hour - 14) / 24 * 2 * np.pi)})
    rows, verdict = ck.repair_collapsed(frame(spark, pdf), "series_id", "row")
    assert verdict.first()["verdict"] == "repaired"
    assert rows.where("ts <> truth").count() == 0


def test_collapsed_clock_without_light_uses_temperature(spark, layout):
    t = pd.date_range("2021-08-20 09:00", periods=24 * 30, freq="1h")
    pdf = pd.DataFrame({"series_id": "s", "row": np.arange(len(t)), "truth": t, "ts": np.where(t.hour >= 12, t - pd.Timedelta(hours=12), t),
                        "lux": np.full(len(t), np.nan), "temp": 25 + np.cos((t.hour - 14) / 24 * 2 * np.pi)})
    rows, verdict = ck.repair_collapsed(frame(spark, pdf), "series_id", "row")
    assert verdict.first()["verdict"] == "repaired" and rows.where("ts <> truth").count() == 0
    ragged = pdf.assign(ts=pdf.ts + pd.to_timedelta(np.random.default_rng(2).integers(0, 50, len(t)), "min"))
    assert ck.repair_collapsed(frame(spark, ragged), "series_id", "row")[1].first()["verdict"].startswith("refused")
