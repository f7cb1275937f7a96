"""Published fixtures of currents, replicates, the database and the exports."""

import numpy as np
import pandas as pd
import pytest
from helpers import column, frame
from pyspark.sql import functions as F

from tidelint.operators import catalog as ca
from tidelint.operators import corpus as co
from tidelint.operators import currents as cu
from tidelint.operators import database as db
from tidelint.operators import replicates as rp
from tidelint.operators import timejoin as tj
from tidelint.operators.series import mooring_or_profile
from tidelint.operators.trends import fit, series_trend
from tidelint.plans.qualify import qualify_light, qualify_scalar
from tidelint.sources import products as pr
from tidelint.sources import text_exports as te
from tidelint.streaming.stateless import range_flags

NAMES = {k: k for k in ("speed", "strength", "state", "stdev", "tilt")}


def test_currents(spark):
    pdf = pd.DataFrame({"sample_no": range(6), "speed": [20.0, 400, 20, 20, 20, np.nan], "strength": [-30.0] * 6,
                        "state": [0.0, 0, 1, 0, 0, 0], "stdev": [5.0, 5, 5, 80, 5, 5], "tilt": [5.0, 5, 5, 5, 20, 5]})
    out = cu.current_flags(frame(spark, pdf), NAMES)
    flags = column(out, "Flag")
    assert flags[0] == "11112" and flags[1][0] == "4" and flags[2][1] == "4" and flags[3][2] == "3" and flags[4][3] == "3" and flags[5] == "99999"
    assert column(out, "Flag_cur") == [1, 4, 4, 3, 3, 9]
    assert column(cu.current_flags(frame(spark, pdf), NAMES, off=frozenset({"cur_range"})), "Flag_cur")[1] == 1


def combined_pair():
    t = pd.date_range("2026-01-01", periods=10, freq="1h")
    a = pd.DataFrame({"deployment": "d", "replicate": 0, "ts": t, "temp": 25.0, "lux": 10000.0, "Flag_T": 1, "Flag_lux": [1] * 5 + [4] * 5})
    b = a.assign(replicate=1, temp=25.2, lux=11000.0, Flag_lux=[1] * 8 + [4] * 2)
    b.loc[3, "temp"] = 26.0
    b.loc[5:, "lux"] = 5500.0
    return a, b


def test_combine(spark, layout):
    a, b = combined_pair()
    r = rp.combine(frame(spark, pd.concat([a, b], ignore_index=True)), "deployment").orderBy("ts").toPandas()
    assert abs(r.temp[0] - 25.1) < 1e-9 and r.temp[3] == 25.5 and r.spread[3] == 1.0 and r.Flag_T[3] == 3
    assert r.lux[0] == 11000 and r.lux[6] == 5500 and r.Flag_lux.tolist() == [1] * 8 + [4, 4]


def test_combine_coarse_and_copies(spark):
    a, b = combined_pair()
    r = rp.combine(frame(spark, pd.concat([a, b.iloc[::2]], ignore_index=True)), "deployment").orderBy("ts").toPandas()
    assert abs(r.spread[0] - .2) < 1e-9 and np.isnan(r.spread[1])
    twice = pd.concat([a, b, b.iloc[[2]]], ignore_index=True)
    assert rp.combine(frame(spark, twice), "deployment").count() == 10
    clash = pd.concat([a, b, b.iloc[[2]].assign(temp=9.0)], ignore_index=True)
    assert rp.combine(frame(spark, clash), "deployment").count() == 0
    rep = rp.conflict_report(frame(spark, clash), ["deployment", "replicate"], ["temp", "lux", "Flag_T", "Flag_lux"])
    assert rep.where("replicate = 1").first()["conflicts"] == 1


def season(change=None, days=190):
    t = pd.date_range("2026-01-01", periods=24 * days, freq="1h")
    rng = np.random.default_rng(0)
    base = 28 - 4 * np.arange(len(t)) / len(t) + 0.8 * np.sin(np.arange(len(t)) / 24 / 9)
    one = pd.DataFrame({"deployment": "d", "replicate": 0, "ts": t, "temp": base + rng.normal(0, .05, len(t)), "Flag_T": 1})
    two = one.assign(replicate=1, temp=base + rng.normal(0, .05, len(t)))
    if change:
        two["temp"] = change(two["temp"].to_numpy(), np.arange(len(t)) / 24, base)
    days_ = pd.DataFrame({"deployment": "d", "day": t[::24], "reference": base[::24] + 1})
    return pd.concat([one, two], ignore_index=True), days_


def verdict(spark, rows, ref):
    return rp.referee(frame(spark, rows), frame(spark, ref), "deployment")[1].first()


def test_referee(spark):
    rows, ref = season()
    assert verdict(spark, rows, ref)["verdict"] == "replicates agree"
    rows, ref = season(lambda v, d, b: np.where(d > 45, v[45 * 24], v))
    r = verdict(spark, rows, ref)
    assert r["recommended"] == 0 and r["disagrees"]
    assert verdict(spark, rows, ref.assign(deployment="x"))["recommended"] is None
    rows, ref = season(lambda v, d, b: np.where(d > 90, v + 3, v))
    r = verdict(spark, rows, ref)
    assert r["recommended"] == 0
    rng = np.random.default_rng(4)
    rows, ref = season(lambda v, d, b: v + 3)
    ref["reference"] = rng.normal(25, 3, len(ref))
    assert verdict(spark, rows, ref)["recommended"] is None


def test_co2(spark, layout):
    head = "Measurement type,Year,Month,Day,Hour,Minute,Second,Reference A/D,Current A/D,CO2 (PPM),Corrected disolved CO2 (PPM)"
    minutes = [0, 2, 4, 6, 26, 28, 30, 32]
    lines = [head, *[f"W M,2026,1,1,12,{m},0,1,2,9,{500 + i * 10}" for i, m in enumerate(minutes[:4])], head,
             *[f"W M,2026,1,1,12,{m},0,1,2,9,{540 + i * 10}" for i, m in enumerate(minutes[4:])], "W M,broken"]
    co2 = te.parse_co2(frame(spark, pd.DataFrame({"file": "f", "line_no": range(len(lines)), "line": lines})))
    assert co2.count() == 8
    grid = pd.DataFrame({"file": "f", "sample_no": range(35), "ts": pd.date_range("2026-01-01 11:59", periods=35, freq="1min")})
    got = column(tj.interpolate(frame(spark, grid), co2, "file", {"co2": "x"}, "bracket"), "x")
    at = dict(zip(grid.ts.dt.strftime("%H:%M"), got, strict=True))
    assert at["11:59"] is None and at["12:00"] == 500 and at["12:01"] == 505 and at["12:15"] is None
    assert at["12:29"] == 555 and at["12:33"] is None


def test_nearest_prefers_the_later_of_two(spark, layout):
    t = pd.DataFrame({"k": "a", "sample_no": [0, 1, 2], "ts": pd.to_datetime(["2026-01-01 00:05", "2026-01-01 00:20", "2026-01-01 03:00"])})
    s = pd.DataFrame({"k": "a", "ts": pd.to_datetime(["2026-01-01 00:00", "2026-01-01 00:10", "2026-01-01 00:20"]), "v": [1.0, 2.0, 3.0]})
    assert column(tj.nearest(frame(spark, t), frame(spark, s), "k", {"v": "v"}, 300.0), "v") == [2.0, 3.0, None]


def test_scalar_text(spark, tmp_path):
    lines = ["Description;Platform", "x", "y", "Record Time;Record Number;Pressure[kPa];Temperature[DegC];Salinity[PSU]",
             "01/02/2026 10:00:00;1;131,7655;28,5;35,1", "01/02/2026 10:00:10;2;131,8;28,6;35,1", "01/02/2026 10:00:20;3;131,9;28,64612;35,1", ";;;;"]
    (tmp_path / "a.csv").write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "b.csv").write_text("\n".join(lines).replace("[kPa]", ""), encoding="utf-8")
    rows, refused = te.parse_scalar(te.read_lines(spark, str(tmp_path)))
    got = rows.orderBy("line_no").toPandas()
    assert len(got) == 3 and abs(got["Pressure (dbar)"][0] - 13.17655) < 1e-9 and got["Temperature (degC)"][2] == 28.64612
    assert str(got["Datetime"][0]) == "2026-02-01 10:00:00"
    assert refused.count() == 1 and "no unit" in refused.first()["reason"]


def test_light_text(spark, tmp_path):
    head = '"#","Data Hora, GMT-03:00","Temp, °C","Intensidade, lum/ft²","Acoplador desligado","Fim do ficheiro"'
    rows = [f'"{i}","{1 + i // 24:02d}/03/18 {i % 24}h0min0s","{25 + i % 3 / 10}","{i}","",""' for i in range(24 * 20)]
    rows[3] = '"3","01/03/18 3h0min0s","","","Registado",""'
    (tmp_path / "p.csv").write_bytes(("Título\n" + head + "\n" + "\n".join(rows)).encode("cp1252"))
    parsed, refused = te.parse_light(te.read_lines(spark, str(tmp_path)))
    assert refused.count() == 0 and parsed.count() == 480
    r = parsed.where("line_no = 12").first()
    assert str(r["ts"]) == "2018-03-01 10:00:00" and abs(r["lux"] - 10 * 10.7639) < 1e-9 and r["order_note"] == "day-first"
    assert te.finish_light(parsed).count() == 476        # before the launch, and the event row, are gone
    assert te.classify(te.read_lines(spark, str(tmp_path))).first()["instrument"] == "HOBO"


def qualified(site, n=3, first="2026-01-01"):
    return pd.DataFrame({"Datetime": pd.date_range(first, periods=n, freq="1h"), "Site": site, "Salinity (PSU)": [35.0 + i for i in range(n)]})


def test_database(spark, tmp_path):
    root = tmp_path / "x" / "qualified scalar"
    root.mkdir(parents=True)
    for name, pdf in (("a.csv", qualified("A")), ("b.csv", qualified("B")), ("copy.csv", qualified("A")), ("REPORT_x.csv", qualified("Z"))):
        pdf.to_csv(root / name, index=False)
    found = pr.discover(spark, str(tmp_path), ["qualified scalar"], "REPORT_")
    paths = sorted(r["path"] for r in found.collect())
    assert [p.rsplit("/", 1)[1] for p in paths] == ["a.csv", "b.csv", "copy.csv"]
    schema = "Datetime timestamp_ntz, Site string, `Salinity (PSU)` double"
    frames = [(p.rsplit("/", 1)[1], spark.read.schema(schema).option("header", True).csv(p)) for p in paths]
    u = db.unify(frames, "tscp")
    clean = db.drop_exact_duplicates(u, [db.SOURCE, db.FILE_NO, db.ROW_NO], [db.FILE_NO, db.ROW_NO])
    assert u.count() == 9 and clean.count() == 6
    assert {r[db.SOURCE] for r in clean.select(db.SOURCE).distinct().collect()} == {"a.csv", "b.csv"}
    assert db.overlaps(clean, ["Site", "Datetime"]).count() == 0
    light = frame(spark, pd.DataFrame({"Datetime": pd.to_datetime(["2026-01-01"]), "Site": ["A"], "Luminosity (lux)": [1.0]}))
    with pytest.raises(ValueError, match="never mix"):
        db.unify([*frames, ("l.csv", light)], "tscp")


def test_cells_are_no_overlaps(spark):
    pdf = pd.DataFrame([{"Datetime": pd.Timestamp("2026-01-01") + pd.Timedelta(hours=h), "Site": "A", "Column": "c", "Cell": k, "Flag_cur": 1}
                        for h in range(4) for k in range(3)])
    key = db.overlap_key(pdf.columns)
    assert key == ["Site", "Datetime", "Column", "Cell"]
    df = frame(spark, pdf.assign(source_file="f"))
    assert db.overlaps(df, key).count() == 0
    clash = df.unionByName(df.limit(1).withColumn("Flag_cur", F.lit(3).cast("bigint")))
    assert db.overlaps(clash, key).first()["rows"] == 2


def test_mooring_or_profile(spark):
    parts = [("a", 50, "30min"), ("b", 19, "10min"), ("c", 300, "10s"), ("d", 1, "1s")]
    pdf = pd.concat([pd.DataFrame({"k": k, "ts": pd.date_range("2026-01-01", periods=n, freq=f)}) for k, n, f in parts], ignore_index=True)
    got = {r["k"]: (r["verdict"], r["step_s"]) for r in mooring_or_profile(frame(spark, pdf), "k").collect()}
    assert got == {"a": ("TSCP Mooring", 1800.0), "b": ("TSCP Mooring", 600.0), "c": ("TSCP Profile", 10.0), "d": (None, None)}


def brute_groups(spans):
    groups, out = [], {}
    day = pd.Timedelta(days=1)
    for _i, r in spans.sort_values(["start", "name"]).iterrows():
        for g in groups:
            ds, de = abs(r.start - g["s"]), abs(r.end - g["e"])
            a, b = (r.end - r.start).total_seconds(), (g["e"] - g["s"]).total_seconds()
            if (ds <= day and de <= day) or (ds <= 3 * day and de <= 3 * day and min(a, b) > 0 and abs(a - b) / max(a, b) <= 0.05):
                g["s"], g["e"] = min(r.start, g["s"]), max(r.end, g["e"])
                out[r["name"]] = g["id"]
                break
        else:
            groups.append({"id": r["name"], "s": r.start, "e": r.end})
            out[r["name"]] = r["name"]
    return out


def test_replicate_groups_match_brute_force(spark, layout):
    rng = np.random.default_rng(8)
    start = pd.Timestamp("2026-01-01") + pd.to_timedelta(rng.integers(0, 120 * 24, 60), "h")
    spans = pd.DataFrame({"site": "A", "name": [f"f{i:02d}" for i in range(60)], "start": start, "end": start + pd.to_timedelta(rng.integers(24, 240, 60), "h")})
    got = ca.group_replicates(frame(spark, spans), "site", "name", "start", "end").collect()
    assert {r["name"]: r["deployment"] for r in got} == brute_groups(spans)


def test_trends_match_polyfit(spark, layout):
    rng = np.random.default_rng(6)
    x = np.arange(60.0)
    y = 5 + 0.1 * x - 0.002 * x ** 2 + 1e-5 * x ** 3 + rng.normal(0, .1, 60) + 3
    df = frame(spark, pd.DataFrame({"k": "a", "sample_no": range(60), "x": x, "y": y}))
    for degree in (1, 2, 3):
        got = column(fit(df, "k", F.col("x"), F.col("y"), degree), "fit")
        np.testing.assert_allclose(got, np.polyval(np.polyfit(x, y, degree), x), rtol=1e-8)
    gap = y.copy()
    gap[[0, 5, 6, 59]] = np.nan
    got = series_trend(frame(spark, pd.DataFrame({"k": "a", "sample_no": range(60), "y": gap})), "k", "sample_no", "y", 2)
    filled = np.where(np.isnan(gap[1:59]), np.nanmean(gap), gap[1:59])
    np.testing.assert_allclose(column(got, "fit"), np.polyval(np.polyfit(np.arange(58), filled, 2), np.arange(58)), rtol=1e-8)


def test_corpus_checks(spark):
    pdf = pd.DataFrame({"p": ["a"] * 20 + ["b"] * 20, "sample_no": list(range(20)) * 2, "ts": list(pd.date_range("2026-01-01", periods=20, freq="1h")) * 2,
                        "T": [25125.0 + i for i in range(20)] + [25.1] * 18 + [50.0, 60.0], "Flag_T": [4] * 20 + [1] * 18 + [4, 1]})
    df = frame(spark, pdf)
    hit = co.scale_defects(df, ["p"], {"T": "T"}, {"T": (8, 35)}).collect()
    assert [(r["p"], r["verdict"], r["factor"]) for r in hit] == [("a", "LOST SEPARATOR", 1000.0)]
    bad = {r["p"]: (r["n_out"], r["n_caught"], r["unflagged"]) for r in co.impossible_values(df, ["p"], {"T": "T"}, {"T": "Flag_T"}, {"T": (-5, 40)}, {"T": (8, 35)}).collect()}
    assert bad == {"a": (20, 20, False), "b": (2, 1, True)}
    inv = {(r["p"], r["kind"]) for r in co.invariants(df, ["p"], ["sample_no"], "ts", {"T": "T"}, {"T": "Flag_T"}).collect()}
    assert ("b", "implausible_good") in inv and ("a", "implausible_good") not in inv


def test_qualify_jobs(spark, layout):
    n = 240
    t = pd.date_range("2026-01-01", periods=n, freq="1h")
    v = 25 + np.sin(np.arange(n) / 7)
    v[100] = 60.0
    pdf = pd.DataFrame({"series_id": "a", "Site": "X", "line_no": range(n), "Datetime": t, "Temperature (degC)": v, "Salinity (PSU)": 35.0 + np.arange(n) % 3 / 10, "Pressure (dbar)": 20.0 + np.arange(n) % 5})
    out = qualify_scalar(frame(spark, pdf), remove_bad=True).orderBy("`Sample number`").toPandas()
    assert len(out) == n and out.Flag_T[100] == 4 and np.isnan(out["Temperature (degC)"][100]) and len(out.Flag[0]) == 40
    assert out["Depth (m)"].notna().all() and str(out.Datetime[0]) == "2025-12-31 21:00:00"
    lights = pd.DataFrame({"series_id": "a", "line_no": range(n), "ts": t, "temp": v, "lux": np.where((t.hour > 5) & (t.hour < 18), 9000.0, 0.0)})
    table, seen = qualify_light(frame(spark, lights))
    r = table.orderBy("`Sample number`").toPandas()
    assert len(r.Flag[0]) == 6 and r.Flag_T[100] == 4 and set(r.Flag_lux) == {1} and seen.first()["evaluable"]


def test_stream_of_readings(spark, tmp_path):
    src = str(tmp_path / "in")
    pdf = pd.DataFrame({"series_id": "a", "Temperature (degC)": [20.0, 50.0, 36.0, -1.0]})
    batch = frame(spark, pdf)
    batch.write.parquet(src)
    q = (range_flags(spark.readStream.schema(batch.schema).parquet(src)).writeStream.format("memory").queryName("flags_out").trigger(availableNow=True).start())
    q.awaitTermination(60)
    got = sorted((r["f_sensor_T"], r["f_environment_T"]) for r in spark.sql("select * from flags_out").collect())
    assert got == [(1, 1), (1, 3), (4, 3), (9, 9)]
