"""Published fixtures of the per-sample tests.

Fixed values: the inputs (seeds, arrays) and the digits expected of them.
"""

import numpy as np
import pandas as pd
from helpers import column, frame, series
from pyspark.sql import functions as F

from tidelint.functions.flags import range_flag
from tidelint.operators import preprocess as pp
from tidelint.operators import qc_tests as qc
from tidelint.plans import layouts
from tidelint.plans.criteria import Criteria, Factor
from tidelint.plans.test_plan import Test, light_logger_plan, mooring_plan, profile_plan, rollup, run_plan

KEYS, BY = ["series_id"], ["ts", "sample_no"]


def one_test(spark, values, test, window="WHOLE", step="60s", plan=None, **factor):
    crit = Criteria(spike={"T": Factor(window=window, **factor)}, rate={"T": Factor(window=window, **factor)})
    df = series(spark, values, step=step).withColumnRenamed("v", "T")
    out = run_plan(df, plan or [test], {"T": "T"}, KEYS, BY, criteria=crit)
    return column(out, f"f_{test.family}_{test.variable}")


def test_ranges(spark):
    df = series(spark, [20, 21, 50, None, 22])
    assert column(df.withColumn("f", range_flag(F.col("v"), 15, 35)), "f") == [1, 1, 4, 9, 1]
    assert column(df.withColumn("f", range_flag(F.col("v"), 15, 35, 3)), "f") == [1, 1, 3, 9, 1]


def test_spike(spark, layout):
    v = 25 + np.random.default_rng(0).normal(0, 0.01, 50)
    v[25] = 40
    f = one_test(spark, v, Test("T", "spike"))
    assert f[25] == 4 and f[0] == 2 and f[-1] == 2


def test_step_is_not_a_spike(spark):
    v = np.r_[np.full(40, 20.0), np.full(40, 26.0)] + np.random.default_rng(1).normal(0, 0.02, 80)
    assert one_test(spark, v, Test("T", "spike")).count(4) <= 1


def test_flat_line(spark, layout):
    def flags(v):
        return column(qc.flat_line(series(spark, v), KEYS, BY, {"f": F.col("v")}, 20, 15), "f")
    assert flags([float(i) * 1.1 for i in range(30)] + [7.7] * 25)[-1] == 4
    v = [7.7] * 35
    v[10] = v[20] = None
    f = flags(v)
    assert f[10] == 9 and f[-1] == 4 and f[0] == 2 and f[16] == 3


def test_resolution(spark):
    r = qc.resolution(series(spark, [25.0, 7.125, 3.5, None]), KEYS, {"e": F.col("v"), "w": F.floor(F.col("v")).cast("double")}).first()
    assert abs(r["e"] - 1e-3) < 1e-12 and r["w"] == 1.0


def test_rate(spark):
    v = 2 * np.sin(np.linspace(0, 6, 100)) + 25
    v[50] += 8
    f = one_test(spark, v, Test("T", "rate"), window="30M")
    assert f[50] == 3 and 4 not in f and f[0] == 2


def test_rate_only_heeds_its_own_earlier_digits(spark, layout):
    v = [25 + 0.1 * np.sin(i) for i in range(30)]
    v[15] = 50.0                                   # fails the sensor range of T
    plan = [Test("T", "sensor"), Test("S", "sensor"), Test("T", "rate"), Test("S", "rate")]
    df = series(spark, v).withColumnRenamed("v", "T").withColumn("S", F.lit(30.0) + F.col("sample_no") % 2)
    out = run_plan(df, plan, {"T": "T", "S": "S"}, KEYS, BY, criteria=Criteria())
    t, s = column(out, "f_rate_T"), column(out, "f_rate_S")
    assert t[15] == 2 and t[16] == 2 and s[15] != 2


def test_rate_with_a_window_too_small_uses_the_series(spark):
    v = 25 + 0.05 * np.sin(np.arange(200))
    v[100] = 40
    assert one_test(spark, v, Test("T", "rate"), window="30M", step="1h")[100] == 3


def test_constant_series(spark):
    assert set(one_test(spark, [5.0] * 30, Test("T", "spike"))[1:-1]) == {1}
    assert set(one_test(spark, [5.0] * 30, Test("T", "rate"))[1:]) == {3}


def test_gradient(spark, layout):
    z = np.arange(1.0, 51)
    v = 25 - 0.5 * z + np.random.default_rng(7).normal(0, 0.01, 50)

    def flags(values):
        df = series(spark, values, z=z)
        return column(qc.vertical_gradient(df, KEYS, BY, F.col("z"), {"f": F.col("v")}, 4.0, 3.0), "f")
    assert 4 not in flags(v)
    v2 = v.copy()
    v2[25] += 3
    f = flags(v2)
    assert 4 in (f[25], f[26]) and f[0] == 2


def test_density_inversion(spark, layout):
    depth = np.arange(1.0, 11)
    temp = np.linspace(25, 16, 10)

    def flags(t):
        df = series(spark, t, depth=depth, s=np.full(10, 35.0))
        return column(qc.density_inversion(df, KEYS, "sample_no", F.col("v"), F.col("s"), F.col("depth"), F.col("depth"), "f"), "f")
    assert 3 not in flags(temp)
    hot = temp.copy()
    hot[5] = 30
    assert flags(hot)[5] == 3


def test_seawater_matches_published_values(spark):
    """Check values of the public 75-term density polynomial."""
    from tidelint.functions.seawater import with_density
    pdf = pd.DataFrame({"sa": [34.8915, 35.0256, 34.8472, 34.7324], "ct": [28.4392, 22.7862, 10.2262, 4.3236], "p": [50.0, 125.0, 250.0, 1000.0]})
    got = with_density(frame(spark, pdf), F.col("sa"), F.col("ct"), F.col("p"), "rho").toPandas().sort_values("p")["rho"]
    np.testing.assert_allclose(got, [1022.262457966867, 1024.427195413316, 1027.790152759127, 1032.002453224572], rtol=1e-12)


def test_depth(spark):
    from tidelint.functions.seawater import depth_from_pressure
    d = series(spark, [110.0]).select(depth_from_pressure(F.col("v"), 17.5).alias("d")).first()["d"]
    assert abs(d - 99) < 1


def test_below_zero(spark):
    pdf = pd.DataFrame({"Chlorophyll (ug/L)": [.5, -.2, -10], "PAR (umol/m2/s)": [800, -.01, 0], "Temperature (degC)": [25.0, -1, 26],
                        "Luminosity (lux)": [12000, 0, -1.2]})
    env = Criteria().environment
    rules = {n: pp.zero_rule(n, env) for n in pdf.columns}
    df = frame(spark, pdf.assign(i=range(3)))
    got = pp.clean_below_zero(df, rules).orderBy("i").toPandas()
    assert got["Chlorophyll (ug/L)"].tolist()[:2] == [.5, 0] and np.isnan(got["Chlorophyll (ug/L)"][2])
    assert got["PAR (umol/m2/s)"].tolist() == [800, 0, 0] and got["Luminosity (lux)"].tolist() == [12000, 0, 0]
    assert np.isnan(got["Temperature (degC)"][1])
    rep = {r["var"]: (r["clamped"], r["discarded"]) for r in pp.below_zero_report(df, rules).collect()}
    assert rep == {"Chlorophyll (ug/L)": (1, 1), "PAR (umol/m2/s)": (1, 0), "Temperature (degC)": (0, 1), "Luminosity (lux)": (1, 0)}


def test_removal_and_rollup_keep_oxygen_and_co2_apart(spark):
    plan = [Test("O2", "sensor"), Test("CO2", "sensor")]
    df = frame(spark, pd.DataFrame({"sample_no": [0, 1, 2], "f_sensor_O2": [1, 4, 1], "f_sensor_CO2": [1, 1, 4],
                                    "O2 level (uM)": [200.0] * 3, "CO2 Level (ppm)": [400.0] * 3}))
    r = rollup(df, plan)
    assert column(r, "Flag_O2") == [1, 4, 1] and column(r, "Flag_CO2") == [1, 1, 4] and column(r, "Flag") == ["11", "41", "14"]
    cut = layouts.remove_flagged(r, layouts.FLAG_OF, bad=True, suspect=False)
    assert column(cut, "O2 level (uM)") == [200.0, None, 200.0] and column(cut, "CO2 Level (ppm)") == [400.0, 400.0, None]


def test_ph_removal_spares_chlorophyll(spark):
    df = frame(spark, pd.DataFrame({"sample_no": [0, 1], "pH": [8.0, 2.0], "Chlorophyll (ug/L)": [1.0, 1.0], "Flag_pH": [1, 4], "Flag_chl": [1, 1]}))
    cut = layouts.remove_flagged(df, layouts.FLAG_OF, bad=True, suspect=False)
    assert column(cut, "pH") == [8.0, None] and column(cut, "Chlorophyll (ug/L)") == [1.0, 1.0]


def test_derived_flags(spark):
    plan = [Test("T", "sensor"), Test("S", "sensor"), Test("P", "sensor")]
    df = frame(spark, pd.DataFrame({"sample_no": range(5), "f_sensor_T": [1, 1, 3, 1, 1], "f_sensor_S": [1, 4, 1, 1, 9], "f_sensor_P": [1, 1, 1, 4, 1]}))
    r = rollup(df, plan)
    assert column(r, "Flag_dens") == [1, 4, 3, 1, 9] and column(r, "Flag_depth") == [1, 1, 1, 4, 1]


def test_plan_sizes_and_absent_columns(spark):
    assert (len(mooring_plan()), len(profile_plan()), len(light_logger_plan())) == (40, 44, 6)
    df = series(spark, np.linspace(20, 21, 40)).withColumnRenamed("v", "T")
    out = run_plan(df, mooring_plan(), {"T": "T"}, KEYS, BY).first()
    assert out["f_sensor_S"] == 2 and out["f_flat_P"] == 2 and out["f_sensor_T"] == 1


def test_layouts():
    assert layouts.layout_of(["Flag_cur"]) == "doppler" and layouts.layout_of(["Luminosity (lux)"]) == "hobo"
    assert layouts.layout_of(["Salinity (PSU)", "Luminosity (lux)"]) == "tscp"
    assert layouts.known_instrument(["Datetime", "Site", "Flag_cur", "Horizontal speed (cm/s)"]) == "Doppler"
    assert layouts.known_instrument(["Datetime", "Site", "Temperature (degC)", "Luminosity (lux)"]) == "HOBO"
    assert layouts.known_instrument(["Datetime", "Site", "Flag", "Salinity (PSU)"]) == "Seaguard"
    assert layouts.known_instrument(["Datetime", "Site", "Salinity (PSU)"]) is None


def test_lost_decimal(spark):
    def fixed(v):
        return pp.fix_scale(series(spark, v), KEYS, "v", "x").orderBy("sample_no").select("x", "scale_note").collect()
    r = fixed([25125, 30862, 28853, 26097] * 5)
    assert r[0]["x"] == 25.125 and r[0]["scale_note"] == "rescaled"
    for v in ([25.1, 26.2] * 10, list(np.linspace(-84.77, 156.53, 12) * 1.01 + 200), [25125, 30862]):
        assert [x["x"] for x in fixed(v)] == [float(y) for y in v]


def test_edge_trim(spark, layout):
    v = [31.0] * 3 + [25.0] * 200 + [33.0, 34.0]
    assert pp.trim_edges(series(spark, v, step="1h"), KEYS, BY, "v").count() == 200
    noisy = [31.0 if i % 2 else 20.0 for i in range(40)]
    assert pp.trim_edges(series(spark, noisy, step="1h"), KEYS, BY, "v").count() == 40


def test_headers_as_a_column(spark):
    """The column forms agree with the plain ones on every small header."""
    from itertools import combinations

    from pyspark.sql import functions as F

    names = ["Datetime", "Site", "Flag", "Flag_cur", "Horizontal speed (cm/s)", "Temperature (degC)", "Luminosity (lux)", "Salinity (PSU)", "pH"]
    headers = [list(h) for size in range(0, 6) for h in combinations(names, size)]
    df = spark.createDataFrame([(h,) for h in headers], "header array<string>")
    got = df.select("header", layouts.layout_column(F.col("header")).alias("layout"), layouts.instrument_column(F.col("header")).alias("instrument")).collect()
    assert len(got) == len(headers)
    assert all(r.layout == layouts.layout_of(r.header) and r.instrument == layouts.known_instrument(r.header) for r in got)
