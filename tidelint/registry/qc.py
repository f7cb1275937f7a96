"""Queries for the per-sample quality tests and the test plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelint.functions import seawater
from tidelint.functions.flags import range_flag, worst_of
from tidelint.functions.timespec import window_samples
from tidelint.operators import qc_tests as qc
from tidelint.operators import reports
from tidelint.operators.ordering import Next, Position, Prev, measured, ordered
from tidelint.operators.series import mooring_or_profile, sampling_profile, with_sampling
from tidelint.operators.sigma import attach_global_sigma, rolling_sigma
from tidelint.plans.criteria import Criteria, Factor
from tidelint.plans.test_plan import (flags_long, mooring_plan, profile_plan, rollup, run_plan)
from tidelint.registry.base import (EV, WATER, scalar_series, sigma_sql, steps_sql, water_series)

KEYS = ["series_id"]
BY = ["ts", "sample_no"]
QUERIES, SQL = {}, {}


def _numbered(df):
    """Rows with their position, series length and sampling step."""
    cuts = measured(df, KEYS, BY)
    return ordered(with_sampling(df, KEYS, BY, cuts=cuts), KEYS, BY, cuts).scan(
        pos=Position(), before=Prev("v"), after=Next("v")).rows


def _with_sigma(df, window, value=None):
    df = df.withColumn("win", window_samples(window, F.col("interval_s"), F.col("n")))
    return rolling_sigma(df, KEYS, "pos", "n", {"sigma": (F.col("v") if value is None else value, "win")})


# ------------------------------------------------------------------ flagship
def spike_screen(spark, path):
    """Sensor range, environmental range and spike against the whole-series
    spread, rolled up and counted per series and flag."""
    s = scalar_series(spark, path)
    cuts = measured(s, KEYS, BY)
    s = attach_global_sigma(s, KEYS, {"sigma": F.col("v")}, cuts)
    rows = ordered(s, KEYS, BY, cuts).scan(before=Prev("v"), after=Next("v")).rows
    v = F.col("v")
    flags = [range_flag(v, 0, 300), range_flag(v, 1, 150, 3),
             qc.spike_flag(v, F.col("before"), F.col("after"), F.col("sigma"), 3.0, 2.5)]
    return (rows.select("series_id", worst_of(flags).alias("flag"))
            .groupBy("series_id", "flag").agg(F.count(F.lit(1)).alias("n")))


_SPIKE = """CASE WHEN x IS NULL THEN 9 WHEN sp IS NULL OR sigma IS NULL THEN 2
  WHEN sp > 3.0 * sigma THEN 4 WHEN sp > 2.5 * sigma THEN 3 ELSE 1 END"""
_NB = """nb AS (SELECT *, abs(x - (lag(x) OVER w + lead(x) OVER w) / 2) AS sp,
  lag(x) OVER w AS bx, lead(x) OVER w AS ax FROM sg
  WINDOW w AS (PARTITION BY series_id ORDER BY pos))"""
_WORST = """CASE WHEN 4 IN ({0}) THEN 4 WHEN 3 IN ({0}) THEN 3 WHEN 9 IN ({0}) THEN 9
  WHEN 1 IN ({0}) THEN 1 WHEN 2 IN ({0}) THEN 2 ELSE 5 END"""

QUERIES["spike_screen"] = spike_screen
SQL["spike_screen"] = f"""WITH {EV}, {steps_sql('ev')}, {sigma_sql('steps', 'v', 'sg', None)}, {_NB},
fl AS (SELECT series_id,
  CASE WHEN x IS NULL THEN 9 WHEN x < 0 OR x > 300 THEN 4 ELSE 1 END AS f1,
  CASE WHEN x IS NULL THEN 9 WHEN x < 1 OR x > 150 THEN 3 ELSE 1 END AS f2,
  {_SPIKE} AS f3 FROM nb)
SELECT series_id, CAST({_WORST.format('f1, f2, f3')} AS INTEGER) AS flag, count(*) AS n
FROM fl GROUP BY 1, 2"""


# ------------------------------------------------------------- W1, W2, Q21, Q7
def w1_window_samples(spark, path):
    prof = sampling_profile(scalar_series(spark, path), KEYS, BY)
    out = [window_samples(w, F.col("interval_s"), F.col("n")).alias(n) for n, w in
           (("w_2d", "2D"), ("w_36h", "36H"), ("w_90m", "90M"), ("w_45s", "45S"), ("w_whole", "WHOLE"))]
    return prof.select("series_id", *out)


QUERIES["w1_window_samples"] = w1_window_samples
SQL["w1_window_samples"] = f"""WITH {EV}, {steps_sql('ev')}
SELECT series_id, CAST(floor(172800.0 / interval_s) AS BIGINT) AS w_2d,
  CAST(floor(129600.0 / interval_s) AS BIGINT) AS w_36h,
  CAST(floor(5400.0 / interval_s) AS BIGINT) AS w_90m,
  CAST(floor(45.0 / interval_s) AS BIGINT) AS w_45s, n AS w_whole FROM prof"""


def w2_sampling_profile(spark, path):
    """In arrival order (sample_no), so backward steps can occur."""
    s = scalar_series(spark, path).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    p = sampling_profile(s, KEYS, ["sample_no"])
    return p.select("series_id", "n", "t_start", "t_end", F.round("interval_s", 7).alias("interval_s"),
                    "backwards", "duplicates", "gaps", F.round("max_gap_s", 6).alias("max_gap_s"), "usable")


QUERIES["w2_sampling_profile"] = w2_sampling_profile
SQL["w2_sampling_profile"] = f"""WITH {EV},
h AS (SELECT series_id, sample_no, date_trunc('hour', ts) AS ts FROM ev),
st AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY series_id ORDER BY sample_no) AS step FROM h),
a AS (SELECT series_id, count(*) AS n, CAST(min(ts) AS TIMESTAMP) AS t_start, CAST(max(ts) AS TIMESTAMP) AS t_end,
  median(step) AS med, count(*) FILTER (step < 0) AS backwards, max(step) AS mx,
  count(*) - count(DISTINCT ts) AS duplicates FROM st GROUP BY 1),
g AS (SELECT series_id, count(*) FILTER (step > 3 * med) AS gaps FROM st JOIN a USING (series_id) GROUP BY 1)
SELECT series_id, n, t_start, t_end, round(med / 1e6, 7) AS interval_s, backwards, CAST(duplicates AS BIGINT) AS duplicates,
  gaps, CASE WHEN gaps > 0 THEN round(mx / 1e6, 6) END AS max_gap_s,
  n >= 2 AND coalesce(med > 0, false) AS usable FROM a JOIN g USING (series_id)"""


def q21_mooring_or_profile(spark, path):
    """Sessions are the days of a user."""
    s = scalar_series(spark, path).withColumn("day", F.col("ts").cast("date"))
    return mooring_or_profile(s, ["series_id", "day"]).select(
        "series_id", F.col("day").cast("string").alias("day"), F.round("hours", 6).alias("hours"), F.round("step_s", 7).alias("step_s"), "verdict")


QUERIES["q21_mooring_or_profile"] = q21_mooring_or_profile
SQL["q21_mooring_or_profile"] = f"""WITH {EV}, d AS (SELECT *, CAST(ts AS DATE) AS day FROM ev),
st AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY series_id, day ORDER BY ts) AS step FROM d),
a AS (SELECT series_id, day, count(*) AS n, (max(epoch_us(ts)) - min(epoch_us(ts))) / 3.6e9 AS h,
  coalesce(median(step), 0) / 1e6 AS s FROM st GROUP BY 1, 2)
SELECT series_id, CAST(day AS VARCHAR) AS day, CASE WHEN n >= 2 THEN round(h, 6) END AS hours, CASE WHEN n >= 2 THEN round(s, 7) END AS step_s,
  CASE WHEN n < 2 THEN NULL WHEN h >= 4 OR s >= 300 THEN 'TSCP Mooring' ELSE 'TSCP Profile' END AS verdict FROM a"""


def q7_resolution(spark, path):
    s = scalar_series(spark, path)
    return qc.resolution(s, KEYS, {"eps_v": F.col("v"), "eps_fifth": F.floor(F.col("value")).cast("double"),
                                   "eps_tenth": F.round("value", 1)}).select(
        "series_id", *[F.round(x, 6).alias(x) for x in ("eps_v", "eps_fifth", "eps_tenth")])


QUERIES["q7_resolution"] = q7_resolution
SQL["q7_resolution"] = f"""WITH {EV}
SELECT series_id,
  round(pow(10.0, -max(length(rtrim(split_part(CAST(v AS VARCHAR), '.', 2), '0')))), 6) AS eps_v,
  1.0 AS eps_fifth,
  round(pow(10.0, -max(length(rtrim(split_part(CAST(round(value, 1) AS VARCHAR), '.', 2), '0')))), 6) AS eps_tenth
FROM ev GROUP BY 1"""


# ------------------------------------------------------------------------ W3
def w3_robust_sigma(spark, path):
    rows = _with_sigma(_numbered(scalar_series(spark, path)), "5D")
    return rows.select("series_id", "sample_no", F.round("sigma", 8).alias("sigma"))


QUERIES["w3_robust_sigma"] = w3_robust_sigma
SQL["w3_robust_sigma"] = f"""WITH {EV}, {steps_sql('ev')}, {sigma_sql('steps', 'v', 'sg', 432000)}
SELECT series_id, sample_no, round(sigma, 8) AS sigma FROM sg"""


def w3_sigma_long_series(spark, path):
    """Few, long series: one per event type, a six-hour window."""
    s = scalar_series(spark, path).withColumn("series_id", F.col("event_type"))
    rows = _with_sigma(_numbered(s), "6H")
    return rows.select("series_id", "sample_no", F.round("sigma", 8).alias("sigma"))


QUERIES["w3_sigma_long_series"] = w3_sigma_long_series
SQL["w3_sigma_long_series"] = f"""WITH {EV}, et AS (SELECT event_type AS series_id, ts, sample_no, v FROM ev),
{steps_sql('et')}, {sigma_sql('steps', 'v', 'sg', 21600)}
SELECT series_id, sample_no, round(sigma, 8) AS sigma FROM sg"""


# ------------------------------------------------------------------- Q1, Q2
def q1_sensor_range(spark, path):
    return scalar_series(spark, path).select("series_id", "sample_no", range_flag(F.col("v"), 2, 300).alias("flag"))


def q2_environment_range(spark, path):
    return scalar_series(spark, path).select("series_id", "sample_no", range_flag(F.col("v"), 5, 150, 3).alias("flag"))


QUERIES["q1_sensor_range"] = q1_sensor_range
SQL["q1_sensor_range"] = f"""WITH {EV} SELECT series_id, sample_no,
CAST(CASE WHEN v IS NULL THEN 9 WHEN v < 2 OR v > 300 THEN 4 ELSE 1 END AS INTEGER) AS flag FROM ev"""
QUERIES["q2_environment_range"] = q2_environment_range
SQL["q2_environment_range"] = f"""WITH {EV} SELECT series_id, sample_no,
CAST(CASE WHEN v IS NULL THEN 9 WHEN v NOT BETWEEN 5 AND 150 THEN 3 ELSE 1 END AS INTEGER) AS flag FROM ev"""


# ------------------------------------------------------------------- Q3, Q4
def q3_spike(spark, path):
    rows = _with_sigma(_numbered(scalar_series(spark, path)), "5D")
    return rows.select("series_id", "sample_no", qc.spike_flag(
        F.col("v"), F.col("before"), F.col("after"), F.col("sigma"), 3.0, 2.5).alias("flag"))


QUERIES["q3_spike"] = q3_spike
SQL["q3_spike"] = f"""WITH {EV}, {steps_sql('ev')}, {sigma_sql('steps', 'v', 'sg', 432000)}, {_NB}
SELECT series_id, sample_no, CAST({_SPIKE} AS INTEGER) AS flag FROM nb"""


def q4_light_spike(spark, path):
    """PAR-like channel: zero at night, spread from positive values only."""
    s = scalar_series(spark, path)
    hour = F.hour("ts")
    s = s.withColumn("v", F.when(F.col("v").isNull(), F.lit(None).cast("double"))
                     .when((hour >= 6) & (hour < 18), F.col("v")).otherwise(0.0))
    v = F.col("v")
    rows = _with_sigma(_numbered(s), "5D", F.when(v > 0, v))
    return rows.select("series_id", "sample_no", qc.spike_flag(
        v, F.col("before"), F.col("after"), F.col("sigma"), 3.0, 2.5, zero_is_quiet=True).alias("flag"))


QUERIES["q4_light_spike"] = q4_light_spike
SQL["q4_light_spike"] = f"""WITH {EV},
par AS (SELECT series_id, ts, sample_no, CASE WHEN v IS NULL THEN NULL
  WHEN hour(ts) >= 6 AND hour(ts) < 18 THEN v ELSE 0.0 END AS v FROM ev),
{steps_sql('par')}, {sigma_sql('steps', 'CASE WHEN v > 0 THEN v END', 'sg', 432000)},
nb AS (SELECT *, lag(v) OVER w AS bx, lead(v) OVER w AS ax FROM sg WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
sp AS (SELECT *, abs(v - (bx + ax) / 2) AS sp FROM nb)
SELECT series_id, sample_no, CAST(CASE WHEN v IS NULL THEN 9 WHEN v = 0 AND bx = 0 AND ax = 0 THEN 1
  WHEN sp IS NULL OR sigma IS NULL THEN 2 WHEN sp > 3.0 * sigma THEN 4 WHEN sp > 2.5 * sigma THEN 3 ELSE 1 END AS INTEGER) AS flag
FROM sp"""


# ------------------------------------------------------------------------ Q5
def q5_rate_of_change(spark, path):
    rows = _with_sigma(_numbered(scalar_series(spark, path)), "5D")
    v, before = F.col("v"), F.col("before")
    bad = F.lit(False)
    for f in (range_flag(v, 0, 300), range_flag(v, 1, 150, 3),
              qc.spike_flag(v, before, F.col("after"), F.col("sigma"), 3.0, 2.5)):
        bad = bad | f.isin(4, 9)
    rows = rows.withColumn("bad", bad)
    rows = ordered(rows, KEYS, "pos").scan(pb=Prev((F.col("pos") > 0) & F.col("bad"))).rows
    return rows.select("series_id", "sample_no", qc.rate_flag(
        v, before, F.col("pos") == 0, F.col("bad"), F.col("pb"), F.col("sigma"), 2.5).alias("flag"))


QUERIES["q5_rate_of_change"] = q5_rate_of_change
SQL["q5_rate_of_change"] = f"""WITH {EV}, {steps_sql('ev')}, {sigma_sql('steps', 'v', 'sg', 432000)}, {_NB},
b AS (SELECT *, (x IS NULL OR x < 0 OR x > 300 OR ({_SPIKE}) IN (4, 9)) AS bad FROM nb),
p AS (SELECT *, lag(pos > 0 AND bad) OVER (PARTITION BY series_id ORDER BY pos) AS pb FROM b)
SELECT series_id, sample_no, CAST(CASE WHEN x IS NULL THEN 9
  WHEN pos = 0 OR bx IS NULL OR bad OR coalesce(pb, false) THEN 2
  WHEN abs(x - bx) >= 2.5 * sigma THEN 3 ELSE 1 END AS INTEGER) AS flag FROM p"""


# ------------------------------------------------------------------------ Q6
def q6_flat_line(spark, path):
    """Values coarsened to tens, so that runs occur."""
    s = scalar_series(spark, path).withColumn("v", F.floor(F.col("v") / 50).cast("double"))
    return qc.flat_line(s, KEYS, BY, {"flag": F.col("v")}, fail=6, suspect=4).select(
        "series_id", "sample_no", "flag")


QUERIES["q6_flat_line"] = q6_flat_line
SQL["q6_flat_line"] = f"""WITH {EV}, c AS (SELECT series_id, ts, sample_no, floor(v / 50) AS v FROM ev),
ok AS (SELECT *, row_number() OVER w AS rk, lag(v) OVER w AS pv FROM c WHERE v IS NOT NULL AND v <> -9
  WINDOW w AS (PARTITION BY series_id ORDER BY ts, sample_no)),
st AS (SELECT *, max(CASE WHEN pv IS NULL OR abs(v - pv) > 1 THEN rk END)
  OVER (PARTITION BY series_id ORDER BY rk) AS rs FROM ok),
fl AS (SELECT series_id, sample_no, CASE WHEN rk - rs + 1 >= 6 THEN 4 WHEN rk - rs + 1 >= 4 THEN 3
  WHEN rs = 1 AND rk < 6 THEN 2 ELSE 1 END AS flag FROM st)
SELECT c.series_id, c.sample_no, CAST(coalesce(flag, 9) AS INTEGER) AS flag
FROM c LEFT JOIN fl USING (series_id, sample_no)"""


# ------------------------------------------------------------------------ Q8
def q8_vertical_gradient(spark, path):
    """Casts are users; depth follows the day of the month."""
    s = water_series(spark, path).withColumn(
        "z", F.when(F.col("sample_no") % 31 != 0, F.hour("ts") + F.dayofmonth("ts") * 24.0))
    return qc.vertical_gradient(s, KEYS, BY, F.col("z"), {"flag": F.col("T")}).select(
        "series_id", "sample_no", "flag")


QUERIES["q8_vertical_gradient"] = q8_vertical_gradient
SQL["q8_vertical_gradient"] = f"""WITH {WATER},
z AS (SELECT *, CASE WHEN sample_no % 31 <> 0 THEN hour(ts) + day(ts) * 24.0::DOUBLE END AS z FROM water),
d AS (SELECT *, z - lag(z) OVER w AS dz, "T" - lag("T") OVER w AS dv FROM z
  WINDOW w AS (PARTITION BY series_id ORDER BY ts, sample_no)),
g AS (SELECT *, CASE WHEN abs(dz) >= 0.05 THEN dv / dz END AS gr FROM d),
m AS (SELECT *, abs(gr - median(gr) OVER (PARTITION BY series_id)) AS dev FROM g),
s AS (SELECT series_id, count(gr) AS ct, 1.4826 * median(dev) AS mad, stddev_pop(gr) AS sd FROM m GROUP BY 1),
j AS (SELECT m.*, CASE WHEN ct >= 4 THEN CASE WHEN mad > 0 THEN mad ELSE sd END END AS sigma FROM m JOIN s USING (series_id))
SELECT series_id, sample_no, CAST(CASE WHEN "T" IS NULL THEN 9 WHEN dev IS NULL OR sigma IS NULL OR sigma <= 0 THEN 2
  WHEN dev >= 3.0 * sigma THEN 4 WHEN dev >= 2.5 * sigma THEN 3 ELSE 1 END AS INTEGER) AS flag FROM j"""


# ------------------------------------------------------------------------ Q9
def _poly_sql(terms, names):
    parts = []
    for powers, coef in terms.items():
        parts.append("*".join([repr(coef) + "::DOUBLE"] + [f"pow({n}, {p})" for n, p in zip(names, powers) if p]))
    return "(" + " + ".join(parts) + ")"


def seawater_sql(s, t, p):
    """SQL expressions (absolute salinity, potential and conservative temperature, sigma0)."""
    sa = f"({s} * {seawater.SP_TO_SA!r}::DOUBLE)"
    s1 = f"({sa} * {35.0 / 35.16504!r}::DOUBLE)"
    k = seawater.PT0
    pt = (f"({t} + {p} * ({k['1']!r}::DOUBLE + {s1} * {k['s']!r}::DOUBLE + {p} * {k['p']!r}::DOUBLE + {t} * ("
          f"{k['t']!r}::DOUBLE + {s1} * {k['ts']!r}::DOUBLE + {t} * {k['tt']!r}::DOUBLE + {p} * {k['tp']!r}::DOUBLE)))")
    ct = "(" + _poly_sql(seawater.POT_ENTHALPY, ("xs", "(pt * 0.025)")) + f" / {seawater.CP0!r})"
    vol = _poly_sql(seawater.SPECVOL, ("xd", "(ct * 0.025)", "(0.0)"))
    return sa, pt, ct, vol


def sigma0_ctes(source, s="S", t="T", p="P", out="sw"):
    sa, pt, ct, vol = seawater_sql(f'"{s}"', f'"{t}"', f'"{p}"')
    f = seawater.S_FACTOR
    return f"""{out}0 AS (SELECT *, {sa} AS sa, {pt} AS pt FROM {source}),
{out}1 AS (SELECT *, sqrt(sa * {f!r}) AS xs, sqrt(sa * {f!r} + 0.5971840214030754) AS xd FROM {out}0),
{out}2 AS (SELECT *, {ct} AS ct FROM {out}1),
{out} AS (SELECT *, 1.0 / {vol} - 1000.0 AS sigma0 FROM {out}2)"""


def q9_density_inversion(spark, path):
    s = water_series(spark, path)
    return qc.density_inversion(s, KEYS, "sample_no", F.col("T"), F.col("S"), F.col("P"), F.col("P"),
                                "flag").select("series_id", "sample_no", "flag")


QUERIES["q9_density_inversion"] = q9_density_inversion
SQL["q9_density_inversion"] = f"""WITH {WATER}, {sigma0_ctes('water')},
ok AS (SELECT *, lag(sigma0) OVER w AS up, lead(sigma0) OVER w AS dn FROM sw
  WHERE sigma0 IS NOT NULL AND "P" IS NOT NULL WINDOW w AS (PARTITION BY series_id ORDER BY "P", sample_no)),
f AS (SELECT series_id, sample_no,
  CASE WHEN coalesce(sigma0 < up - 0.03, false) OR coalesce(dn < sigma0 - 0.03, false) THEN 3 ELSE 1 END AS flag FROM ok)
SELECT sw.series_id, sw.sample_no, CAST(CASE WHEN sigma0 IS NULL THEN 2 ELSE coalesce(flag, 1) END AS INTEGER) AS flag
FROM sw LEFT JOIN f USING (series_id, sample_no)"""


# ------------------------------------------------- Q16, Q17, Q18, G2, G3, B8
_CRITERIA = Criteria(
    spike={v: Factor(window="5D") for v in Criteria().spike},
    rate={v: Factor(window="5D") for v in "TSCP"}, flat_fail=6, flat_suspect=4)
_COLUMNS = {v: v for v in "TSCP"}


def _planned(spark, path, plan=None, depth=None):
    s = water_series(spark, path)
    if depth:
        s = s.withColumn("z", F.dayofmonth("ts") * 24.0 + F.hour("ts"))
    return run_plan(s, plan or mooring_plan(), _COLUMNS, KEYS, BY, criteria=_CRITERIA, depth=depth)


def q16_test_plan(spark, path):
    """Every test of the mooring plan over the four variables that are present."""
    plan = mooring_plan()
    return reports.test_report(flags_long(_planned(spark, path), plan, ["series_id"]),
                               ["position", "test", "var"])


def q17_rollup(spark, path):
    rolled = rollup(_planned(spark, path), mooring_plan())
    return rolled.select("series_id", "sample_no", "Flag", *[f"Flag_{v}" for v in (
        "T", "S", "C", "P", "pH", "chl", "O2", "org", "tur", "PAR", "CO2")])


def q18_derived_flags(spark, path):
    rolled = rollup(_planned(spark, path, profile_plan(), depth="z"), profile_plan())
    return rolled.groupBy("Flag_T", "Flag_S", "Flag_P", "Flag_dens", "Flag_depth").agg(
        F.count(F.lit(1)).alias("n"))


def g2_test_report(spark, path):
    plan = mooring_plan()
    long = flags_long(_planned(spark, path), plan, ["series_id"])
    return reports.test_report(long, ["series_id", "test", "var"])


def g3_overall_report(spark, path):
    rolled = rollup(_planned(spark, path), mooring_plan())
    base = [f"Flag_{v}" for v in ("T", "S", "C", "P", "pH", "chl", "O2", "org", "tur")]
    rep = reports.overall_report(rolled, KEYS, base, base)
    prof = sampling_profile(water_series(spark, path), KEYS, BY).select(
        "series_id", "t_start", "t_end", "backwards", "duplicates", "gaps", F.round("max_gap_s", 6).alias("max_gap_s"))
    return rep.join(prof, "series_id")


def _plan_sql():
    """The whole mooring plan in SQL for T, S, C and P; other variables are 2."""
    lim = {"T": ((-5, 40), (8, 35)), "S": ((0, 45), (20, 37.5)), "C": ((0, 75), (5, 75)), "P": ((0, 6000), (0, 6000))}
    ctes = [WATER, steps_sql("water")]
    for v, ((a, b), (e, g)) in lim.items():
        sg = f"s{v}"
        ctes.append(sigma_sql("steps", f'"{v}"', sg, 432000))
        ctes.append(f"""{sg}n AS (SELECT *, lag(x) OVER w AS bx, abs(x - (lag(x) OVER w + lead(x) OVER w) / 2) AS sp FROM {sg}
  WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
{sg}1 AS (SELECT *, CASE WHEN x IS NULL THEN 9 WHEN x < {a} OR x > {b} THEN 4 ELSE 1 END AS f1,
  CASE WHEN x IS NULL THEN 9 WHEN x < {e} OR x > {g} THEN 3 ELSE 1 END AS f2, {_SPIKE} AS f3 FROM {sg}n),
{sg}2 AS (SELECT *, (f1 IN (4, 9) OR f2 IN (4, 9) OR f3 IN (4, 9)) AS bad FROM {sg}1),
{sg}3 AS (SELECT *, lag(pos > 0 AND bad) OVER (PARTITION BY series_id ORDER BY pos) AS pb FROM {sg}2),
{sg}e AS (SELECT series_id, pow(10.0, -coalesce(max(length(rtrim(split_part(printf('%.12f', x), '.', 2), '0'))), 0)) AS eps
  FROM {sg} GROUP BY 1),
{sg}k AS (SELECT series_id, pos, x, row_number() OVER w AS rk, lag(x) OVER w AS px FROM {sg} WHERE x IS NOT NULL AND x <> -9
  WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
{sg}t AS (SELECT *, max(CASE WHEN px IS NULL OR abs(x - px) > eps THEN rk END) OVER (PARTITION BY series_id ORDER BY rk) AS rs
  FROM {sg}k JOIN {sg}e USING (series_id)),
{sg}l AS (SELECT series_id, pos, CASE WHEN rk - rs + 1 >= 6 THEN 4 WHEN rk - rs + 1 >= 4 THEN 3
  WHEN rs = 1 AND rk < 6 THEN 2 ELSE 1 END AS fl FROM {sg}t),
{sg}f AS (SELECT q.series_id, q.sample_no, q.pos, f1, f2, f3,
  CASE WHEN q.x IS NULL THEN 9 WHEN pos = 0 OR bx IS NULL OR bad OR coalesce(pb, false) THEN 2
    WHEN abs(q.x - bx) >= 2.5 * sigma THEN 3 ELSE 1 END AS f4,
  {'5' if v == 'P' else 'coalesce(fl, 9)'} AS f5 FROM {sg}3 q LEFT JOIN {sg}l USING (series_id, pos))""")
    cols = ", ".join(f"{v}.f{i} AS {v}{i}" for v in lim for i in range(1, 6))
    ctes.append(f"""pl AS (SELECT T.series_id, T.sample_no, {cols} FROM sTf AS T
  JOIN sSf AS S USING (series_id, sample_no) JOIN sCf AS C USING (series_id, sample_no)
  JOIN sPf AS P USING (series_id, sample_no))""")
    return ",\n".join(ctes)


def _digit(test):
    n = {"sensor": 1, "environment": 2, "spike": 3, "rate": 4, "flat": 5}[test.family]
    return f"{test.variable}{n}" if test.variable in "TSCP" else "2"


_PLAN = _plan_sql()
_LONG = f"""lg AS (SELECT series_id, unnest([{', '.join(
    f"{{'position': {i + 1}, 'test': '{t.label}', 'var': '{t.variable}', 'flag': {_digit(t)}}}"
    for i, t in enumerate(mooring_plan()))}]) AS e FROM pl)"""
_COUNTS = ", ".join(f"count(*) FILTER (e.flag = {k}) AS n{k}" for k in (1, 2, 3, 4, 5, 9))
QUERIES["q16_test_plan"] = q16_test_plan
SQL["q16_test_plan"] = f"""WITH {_PLAN}, {_LONG}
SELECT CAST(e.position AS INTEGER) AS position, e.test AS test, e.var AS var, {_COUNTS} FROM lg GROUP BY 1, 2, 3"""
QUERIES["g2_test_report"] = g2_test_report
SQL["g2_test_report"] = f"""WITH {_PLAN}, {_LONG}
SELECT series_id, e.test AS test, e.var AS var, {_COUNTS} FROM lg GROUP BY 1, 2, 3"""
_FLAG = " || ".join(f"CAST({_digit(t)} AS VARCHAR)" for t in mooring_plan())
_ROLL = {v: _WORST.format(", ".join(f"{v}{i}" for i in range(1, 6))) for v in "TSCP"}
QUERIES["q17_rollup"] = q17_rollup
SQL["q17_rollup"] = f"""WITH {_PLAN} SELECT series_id, sample_no, {_FLAG} AS "Flag",
{', '.join(f'CAST({_ROLL[v]} AS INTEGER) AS "Flag_{v}"' for v in 'TSCP')},
{', '.join(f'CAST(2 AS INTEGER) AS "Flag_{v}"' for v in ('pH', 'chl', 'O2', 'org', 'tur', 'PAR', 'CO2'))} FROM pl"""
QUERIES["g3_overall_report"] = g3_overall_report
SQL["g3_overall_report"] = f"""WITH {_PLAN}, r AS (SELECT series_id,
{', '.join(f'{_ROLL[v]} AS "{v}"' for v in 'TSCP')} FROM pl),
c AS (SELECT series_id, count(*) AS total, count(*) FILTER (4 NOT IN ("T", "S", "C", "P")) AS valid,
{', '.join(f'count(*) FILTER ("{v}" = {k}) AS "{v}_{w}"' for v in 'TSCP' for k, w in ((4, 'bad'), (3, 'suspect'), (9, 'missing')))},
{', '.join(f'0::BIGINT AS "{v}_{w}"' for v in ('pH', 'chl', 'O2', 'org', 'tur') for w in ('bad', 'suspect', 'missing'))}
FROM r GROUP BY 1),
p AS (SELECT series_id, min(ts) AS t_start, max(ts) AS t_end, count(*) FILTER (step < 0) AS backwards,
  count(*) - count(DISTINCT ts) AS duplicates, count(*) FILTER (step > 3 * interval_s * 1e6) AS gaps, max(step) AS mx
  FROM steps JOIN (SELECT series_id, interval_s FROM prof) USING (series_id) GROUP BY 1)
SELECT c.*, t_start, t_end, backwards, duplicates, gaps,
  CASE WHEN gaps > 0 THEN round(mx / 1e6, 6) END AS max_gap_s FROM c JOIN p USING (series_id)"""
QUERIES["q18_derived_flags"] = q18_derived_flags
_GRAD = ",\n".join(f"""g{v}d AS (SELECT *, "{v}" - lag("{v}") OVER w AS dv,
  (day(ts) * 24.0 + hour(ts)) - lag(day(ts) * 24.0 + hour(ts)) OVER w AS dz FROM water
  WINDOW w AS (PARTITION BY series_id ORDER BY ts, sample_no)),
g{v}g AS (SELECT *, CASE WHEN abs(dz) >= 0.05 THEN dv / dz::DOUBLE END AS gr FROM g{v}d),
g{v}m AS (SELECT *, abs(gr - median(gr) OVER (PARTITION BY series_id)) AS dev FROM g{v}g),
g{v}s AS (SELECT series_id, count(gr) AS ct, 1.4826 * median(dev) AS mad, stddev_pop(gr) AS sd FROM g{v}m GROUP BY 1),
g{v}f AS (SELECT m.series_id, m.sample_no, CASE WHEN "{v}" IS NULL THEN 9
  WHEN dev IS NULL OR ct < 4 OR (CASE WHEN mad > 0 THEN mad ELSE sd END) <= 0 THEN 2
  WHEN dev >= 3.0 * (CASE WHEN mad > 0 THEN mad ELSE sd END) THEN 4
  WHEN dev >= 2.5 * (CASE WHEN mad > 0 THEN mad ELSE sd END) THEN 3 ELSE 1 END AS fg
  FROM g{v}m m JOIN g{v}s USING (series_id))""" for v in "TS")
_SEV = "list_position([4, 3, 9, 1, 2, 5], {})"
SQL["q18_derived_flags"] = f"""WITH {_PLAN}, {_GRAD}, {sigma0_ctes('water')},
ok AS (SELECT *, (day(ts) * 24.0 + hour(ts)) AS vz FROM sw WHERE sigma0 IS NOT NULL),
nb AS (SELECT *, lag(sigma0) OVER w AS up, lead(sigma0) OVER w AS dn FROM ok
  WINDOW w AS (PARTITION BY series_id ORDER BY vz, sample_no)),
df AS (SELECT series_id, sample_no, CASE WHEN coalesce(sigma0 < up - 0.03, false) OR coalesce(dn < sigma0 - 0.03, false)
  THEN 3 ELSE 1 END AS dens FROM nb),
al AS (SELECT pl.*, gTf.fg AS "T6", gSf.fg AS "S6", coalesce(dens, 2) AS dens FROM pl
  JOIN gTf USING (series_id, sample_no) JOIN gSf USING (series_id, sample_no) LEFT JOIN df USING (series_id, sample_no)),
r AS (SELECT {_WORST.format('T1, T2, T3, T4, T5, T6, dens')} AS "Flag_T",
  {_WORST.format('S1, S2, S3, S4, S5, S6, dens')} AS "Flag_S", {_ROLL['P']} AS "Flag_P" FROM al)
SELECT CAST("Flag_T" AS INTEGER) AS "Flag_T", CAST("Flag_S" AS INTEGER) AS "Flag_S", CAST("Flag_P" AS INTEGER) AS "Flag_P",
  CAST([4, 3, 9, 1, 2, 5][least({_SEV.format('"Flag_T"')}, {_SEV.format('"Flag_S"')})] AS INTEGER) AS "Flag_dens",
  CAST("Flag_P" AS INTEGER) AS "Flag_depth", count(*) AS n FROM r GROUP BY 1, 2, 3, 4, 5"""
