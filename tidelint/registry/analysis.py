"""Queries for reports, trends, panels, corpus checks and clock repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelint.functions import seawater
from tidelint.operators import clocks as ck
from tidelint.operators import corpus as co
from tidelint.operators import database as db
from tidelint.operators import light as li
from tidelint.operators import reports as rep
from tidelint.operators.ordering import Position, ordered
from tidelint.operators.trends import profile_trend, series_trend
from tidelint.plans import panels as pn
from tidelint.plans.criteria import VARIABLES
from tidelint.plans.test_plan import mooring_plan
from tidelint.registry.base import EV, LIGHT, WATER, light_series, scalar_series, water_series
from tidelint.registry.qc import _poly_sql, sigma0_ctes
from tidelint.registry.timing import LIGHT12, _by_third, _PHASE

QUERIES, SQL = {}, {}


def add(name, fn, sql):
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


# ----------------------------------------------------------- G1 G4 G14 G16 G20
def g1_statistics(spark, path):
    return rep.statistics_table(water_series(spark, path), ["T", "S", "C", "P"], ["site"])


_R2 = "round_even(({}) * 100, 0) / 100"
add("g1_statistics", g1_statistics, f"""WITH {WATER}, u AS (SELECT site, unnest([{{'k': 'T', 'v': "T"}}, {{'k': 'S', 'v': "S"}}, {{'k': 'C', 'v': "C"}}, {{'k': 'P', 'v': "P"}}]) AS e FROM water)
SELECT site, e.k AS var, {_R2.format('max(e.v)')} AS max, {_R2.format('min(e.v)')} AS min, {_R2.format('avg(e.v)')} AS mean, {_R2.format('median(e.v)')} AS median,
{_R2.format('stddev_pop(e.v)')} AS std FROM u WHERE e.v IS NOT NULL GROUP BY 1, 2""")


def g4_flag_legend(spark, path):
    """The legend beside how often each variable was measured."""
    legend = rep.flag_legend(spark, mooring_plan())
    n = rep.unpivot(water_series(spark, path), ["sample_no"], ["T", "S", "C", "P"]).groupBy("var").agg(F.count("value").alias("measured"))
    return legend.join(n.withColumnRenamed("var", "variable"), "variable", "left").select("flag_position", "test", "variable", F.coalesce("measured", F.lit(0)).alias("measured"))


add("g4_flag_legend", g4_flag_legend, f"""WITH {WATER}, l(flag_position, test, variable) AS (VALUES {', '.join(f"({i + 1}, '{t.label}', '{t.variable}')" for i, t in enumerate(mooring_plan()))}),
n AS (SELECT count("T") AS t, count("S") AS s, count("C") AS c, count("P") AS p FROM water)
SELECT flag_position, test, variable, CASE variable WHEN 'T' THEN t WHEN 'S' THEN s WHEN 'C' THEN c WHEN 'P' THEN p ELSE 0 END AS measured FROM l CROSS JOIN n""")


def g14_parameter_extent(spark, path):
    long = rep.unpivot(water_series(spark, path), ["site"], ["T", "S", "C", "P"])
    out = db.parameter_extent(long, ["site", "var"], F.col("value"))
    return out.select("site", "var", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


add("g14_parameter_extent", g14_parameter_extent, f"""WITH {WATER}, u AS (SELECT site, unnest([{{'k': 'T', 'v': "T"}}, {{'k': 'S', 'v': "S"}}, {{'k': 'C', 'v': "C"}}, {{'k': 'P', 'v': "P"}}]) AS e FROM water),
m AS (SELECT site, e.k AS var, min(e.v) AS lo, max(e.v) AS hi FROM u GROUP BY 1, 2), p AS (SELECT *, CASE WHEN hi > lo THEN 0.2 * (hi - lo) WHEN hi <> 0 THEN 0.2 * abs(hi) ELSE 1 END AS pad FROM m)
SELECT site, var, round(greatest(lo - pad, 0), 6) AS low, round(hi + pad, 6) AS high FROM p""")


def _ts_source(spark, path):
    w = water_series(spark, path)
    return w.withColumns({"Flag_T": (F.col("sample_no") % 3 + 1).cast("int"), "Flag_S": F.when(F.col("site") == "S4", 4).otherwise(1)})


def g16_ts_bounds(spark, path):
    p = pn.ts_points(_ts_source(spark, path), "S", "T", "P")
    b = pn.ts_bounds(p, ["site"], "sa", "ct", ["Flag_S", "Flag_T"])
    return b.select("site", *[F.round(x, 6).alias(x) for x in ("x_min", "x_max", "y_min", "y_max")])


_TSB = f"""{WATER}, {sigma0_ctes('water')},
tg AS (SELECT *, coalesce(sample_no % 3 + 1 = 1 AND site <> 'S4' AND sa IS NOT NULL AND ct IS NOT NULL, false) AS gd FROM sw),
ta AS (SELECT *, max(gd::INT) OVER (PARTITION BY site) AS anyg FROM tg),
tq AS (SELECT site, quantile_cont(sa, 0.005) AS x0, quantile_cont(sa, 0.995) AS x1, quantile_cont(ct, 0.005) AS y0, quantile_cont(ct, 0.995) AS y1 FROM ta
  WHERE CASE WHEN anyg = 1 THEN gd ELSE sa IS NOT NULL AND ct IS NOT NULL END GROUP BY 1),
to1 AS (SELECT site, CASE WHEN x1 - x0 < 0.3 THEN (x0 + x1) / 2 - 0.15 ELSE x0 END AS x0, CASE WHEN x1 - x0 < 0.3 THEN (x0 + x1) / 2 + 0.15 ELSE x1 END AS x1,
  CASE WHEN y1 - y0 < 1.5 THEN (y0 + y1) / 2 - 0.75 ELSE y0 END AS y0, CASE WHEN y1 - y0 < 1.5 THEN (y0 + y1) / 2 + 0.75 ELSE y1 END AS y1 FROM tq),
tb AS (SELECT site, x0 - 0.05 * (x1 - x0) AS x_min, x1 + 0.05 * (x1 - x0) AS x_max, y0 - 0.1 * (y1 - y0) AS y_min, y1 + 0.1 * (y1 - y0) AS y_max FROM to1)"""
add("g16_ts_bounds", g16_ts_bounds, f"WITH {_TSB} SELECT site, round(x_min, 6) AS x_min, round(x_max, 6) AS x_max, round(y_min, 6) AS y_min, round(y_max, 6) AS y_max FROM tb")


def q30_ts_columns(spark, path):
    p = pn.ts_points(_ts_source(spark, path), "S", "T", "P")
    return p.select("series_id", "sample_no", "semester", *[F.round(x, 6).alias(x) for x in ("sa", "pt", "ct", "sigma0")])


add("q30_ts_columns", q30_ts_columns, f"""WITH {WATER}, {sigma0_ctes('water')} SELECT series_id, sample_no, CAST(CASE WHEN month(ts) <= 6 THEN 1 ELSE 2 END AS INTEGER) AS semester,
round(sa, 6) AS sa, round(pt, 6) AS pt, round(ct, 6) AS ct, round(sigma0, 6) AS sigma0 FROM sw""")


def _p6(spark, path, mode):
    p = pn.ts_points(_ts_source(spark, path), "S", "T", "P")
    out = pn.ts_diagram(p, ["semester"], "S", ["Flag_S", "Flag_T"], mode)
    return out.select("semester", "kind", *[F.round(c, 5).alias(c) for c in ("x", "y", "sigma")])


def p6_ts_diagram(spark, path):
    """The points of the diagram, and the nodes of its density grid."""
    return _p6(spark, path, "conservative")


def p6_ts_diagram_potential(spark, path):
    return _p6(spark, path, "potential")


_GRID_RHO = _poly_sql(seawater.SPECVOL, ("xd", "(tt * 0.025)", "(0.0)"))


def _p6_sql(x, y):
    """The diagram over two columns of the points."""
    bounds = _TSB.replace("PARTITION BY site", "PARTITION BY 1").replace("tq AS (SELECT site,", "tq AS (SELECT 1 AS site,")
    bounds = bounds.replace("quantile_cont(sa,", f"quantile_cont({x},").replace("quantile_cont(ct,", f"quantile_cont({y},")
    return f"""WITH {bounds},
gd AS (SELECT *, greatest(3, round_even((x_max - x_min) / 0.1 + 1, 0))::INT AS nx, greatest(3, round_even(y_max - y_min + 1, 0))::INT AS ny FROM tb),
gi AS (SELECT *, unnest(range(0, nx)) AS i FROM gd), gj AS (SELECT *, unnest(range(0, ny)) AS j FROM gi),
gs AS (SELECT *, (1.0 + (nx - 2) * i / (nx - 1)) * 0.1 + x_min AS ss, 1.0 + (ny - 2) * j / (ny - 1) + y_min AS tt FROM gj),
gx AS (SELECT *, sqrt(ss * {seawater.S_FACTOR!r} + 0.5971840214030754) AS xd FROM gs), gr AS (SELECT ss, tt, 1.0 / {_GRID_RHO} - 1000 AS sigma FROM gx)
SELECT 1::INTEGER AS semester, 'point' AS kind, round({x}, 5) AS x, round({y}, 5) AS y, NULL::DOUBLE AS sigma FROM sw WHERE {x} IS NOT NULL AND {y} IS NOT NULL
UNION ALL SELECT 1, 'node', round(ss, 5), round(tt, 5), round(sigma, 5) FROM gr"""


add("p6_ts_diagram", p6_ts_diagram, _p6_sql("sa", "ct"))
add("p6_ts_diagram_potential", p6_ts_diagram_potential, _p6_sql('"S"', "pt"))


def g20_outside_range(spark, path):
    long = rep.unpivot(water_series(spark, path), ["series_id"], ["T", "S", "C", "P"])
    lo = F.when(F.col("var") == "T", 8.0).when(F.col("var") == "S", 20.0).otherwise(5.0)
    hi = F.when(F.col("var") == "T", 35.0).when(F.col("var") == "S", 37.5).otherwise(75.0)
    return rep.outside_range(long, ["series_id", "var"], F.col("value"), lo, hi)


add("g20_outside_range", g20_outside_range, f"""WITH {WATER}, u AS (SELECT series_id, unnest([{{'k': 'T', 'v': "T"}}, {{'k': 'S', 'v': "S"}}, {{'k': 'C', 'v': "C"}}, {{'k': 'P', 'v': "P"}}]) AS e FROM water)
SELECT series_id, e.k AS var, count(*) FILTER (e.v < CASE e.k WHEN 'T' THEN 8 WHEN 'S' THEN 20 ELSE 5 END OR e.v > CASE e.k WHEN 'T' THEN 35 WHEN 'S' THEN 37.5 ELSE 75 END) AS outside,
count(e.v) AS total FROM u GROUP BY 1, 2""")


# ------------------------------------------------------------------ G17 G18
def _trend_sql(src, keys, order, out):
    return f"""{out}0 AS (SELECT *, row_number() OVER w - 1 AS pos, count(v) OVER w AS seen FROM {src} WINDOW w AS (PARTITION BY {keys} ORDER BY {order})),
{out}1 AS (SELECT *, min(CASE WHEN v IS NOT NULL THEN pos END) OVER p AS f, max(CASE WHEN v IS NOT NULL THEN pos END) OVER p AS l,
  count(v) OVER p AS nv, avg(v) OVER p AS mv FROM {out}0 WINDOW p AS (PARTITION BY {keys})),
{out}2 AS (SELECT *, (l - f + 1) - nv > 0.25 * (l - f + 1) AS sparse FROM {out}1 WHERE pos BETWEEN f AND l),
{out}3 AS (SELECT *, CASE WHEN sparse THEN seen - 1 ELSE pos - f END AS idx, coalesce(v, mv) AS y FROM {out}2 WHERE NOT sparse OR v IS NOT NULL),
{out}c AS (SELECT {keys}, regr_slope(y, idx) AS b, regr_intercept(y, idx) AS a FROM {out}3 GROUP BY {keys}),
{out} AS (SELECT {out}3.*, greatest(a + b * idx, 0) AS fit FROM {out}3 JOIN {out}c USING ({keys}))"""


def g17_trend(spark, path):
    out = series_trend(scalar_series(spark, path), "series_id", ["ts", "sample_no"], "v", 1)
    return out.select("series_id", "sample_no", F.round("fit", 5).alias("fit"))


add("g17_trend", g17_trend, f"WITH {EV}, {_trend_sql('ev', 'series_id', 'ts, sample_no', 'tr')} SELECT series_id, sample_no, round(fit, 5) AS fit FROM tr")


def g17_trend_cubic(spark, path):
    out = series_trend(scalar_series(spark, path), "event_type", ["ts", "sample_no"], "v", 3)
    return out.select("event_type", "sample_no", F.round("fit", 4).alias("fit"))


# The cubic in SQL: projections on orthogonal polynomials of the index, made by their three-term recurrence.
add("g17_trend_cubic", g17_trend_cubic, f"""WITH {EV}, {_trend_sql('ev', 'event_type', 'ts, sample_no', 'tr')},
o0 AS (SELECT event_type, sample_no, y, idx / 1000.0 - avg(idx / 1000.0) OVER (PARTITION BY event_type) AS p1 FROM tr3),
o1 AS (SELECT *, p1 * p1 - sum(p1 * p1 * p1) OVER w / sum(p1 * p1) OVER w * p1 - avg(p1 * p1) OVER w AS p2 FROM o0 WINDOW w AS (PARTITION BY event_type)),
o2 AS (SELECT *, p1 * p2 - sum(p1 * p2 * p2) OVER w / sum(p2 * p2) OVER w * p2 - sum(p2 * p2) OVER w / sum(p1 * p1) OVER w * p1 AS p3 FROM o1
  WINDOW w AS (PARTITION BY event_type))
SELECT event_type, sample_no, round(greatest(avg(y) OVER w + sum(y * p1) OVER w / sum(p1 * p1) OVER w * p1 + sum(y * p2) OVER w / sum(p2 * p2) OVER w * p2
  + sum(y * p3) OVER w / sum(p3 * p3) OVER w * p3, 0), 4) AS fit FROM o2 WINDOW w AS (PARTITION BY event_type)""")


def g18_profile_trend(spark, path):
    out = profile_trend(water_series(spark, path), "site", "T", "P", 1)
    return out.select("site", "sample_no", F.round("fit", 6).alias("fit"))


add("g18_profile_trend", g18_profile_trend, f"""WITH {WATER}, b AS (SELECT * FROM water WHERE "T" IS NOT NULL AND "P" IS NOT NULL),
k AS (SELECT site, regr_slope("T", "P") AS sl, regr_intercept("T", "P") AS ic FROM b GROUP BY 1)
SELECT site, sample_no, round(greatest(ic + sl * "P", 0), 6) AS fit FROM b JOIN k USING (site)""")


# ------------------------------------------------------------------- P1 - P8
_SITES = ["S0", "S1", "S2", "S3", "S4"]


def p1_site_parameters(spark, path):
    out = pn.site_parameters(water_series(spark, path), ["T", "S", "P"], _SITES, 2024, degree=1)
    return out.select("site", "semester", "var", "ts", "sample_no", F.round("value", 6).alias("value"), F.round("fit", 5).alias("fit"))


_LONG3 = """u AS (SELECT site, CAST(CASE WHEN month(ts) <= 6 THEN 1 ELSE 2 END AS INTEGER) AS semester, ts, sample_no,
  unnest([{'k': 'T', 'v': "T"}, {'k': 'S', 'v': "S"}, {'k': 'P', 'v': "P"}]) AS e FROM water WHERE year(ts) = 2024),
lo AS (SELECT site, semester, ts, sample_no, e.k AS var, e.v AS v FROM u),
vi AS (SELECT *, count(v) OVER (PARTITION BY site, semester, var ORDER BY ts, sample_no) AS a,
  count(v) OVER (PARTITION BY site, semester, var ORDER BY ts DESC, sample_no DESC) AS z FROM lo),
tm AS (SELECT site, semester, ts, sample_no, var, v, lead(ts) OVER (PARTITION BY site, semester, var ORDER BY ts, sample_no) AS nx FROM vi WHERE a > 0 AND z > 0),
gn AS (SELECT site, semester, ts, sample_no, var, v FROM tm UNION ALL SELECT site, semester, ts + INTERVAL 1 HOUR, sample_no, var, NULL FROM tm WHERE nx > ts + INTERVAL 1 HOUR),
gf AS (SELECT * FROM gn WHERE var <> 'P')"""
_P1 = f"{WATER}, {_LONG3}, {_trend_sql('gf', 'site, semester, var', 'ts, sample_no', 'tr')}"
add("p1_site_parameters", p1_site_parameters, f"""WITH {_P1} SELECT gn.site, gn.semester, gn.var, gn.ts, gn.sample_no, round(gn.v, 6) AS value, round(fit, 5) AS fit
FROM gn LEFT JOIN tr ON tr.site = gn.site AND tr.semester = gn.semester AND tr.var = gn.var AND tr.ts = gn.ts AND tr.sample_no = gn.sample_no""")


def p2_across_sites(spark, path):
    out = pn.parameter_across_sites(water_series(spark, path), ["T", "S", "P"], _SITES, 2024, degree=1)
    return out.select("site", "semester", "var", "sample_no", F.round("hours", 6).alias("hours"), F.round("value", 6).alias("value"), F.round("fit", 5).alias("fit"))


add("p2_across_sites", p2_across_sites, f"""WITH {_P1}, og AS (SELECT site, semester, var, epoch_us(date_trunc('day', min(ts))) AS o FROM lo GROUP BY 1, 2, 3)
SELECT gn.site, gn.semester, gn.var, gn.sample_no, round((epoch_us(gn.ts) - o) / 3.6e9, 6) AS hours, round(gn.v, 6) AS value, round(fit, 5) AS fit
FROM gn JOIN og USING (site, semester, var) LEFT JOIN tr ON tr.site = gn.site AND tr.semester = gn.semester AND tr.var = gn.var AND tr.ts = gn.ts AND tr.sample_no = gn.sample_no""")


def p3_profile(spark, path):
    out = pn.profile_parameters(water_series(spark, path).withColumn("z", F.col("C") / 2), ["T", "S"], "z", _SITES, 2024)
    return out.select("site", "semester", "var", "sample_no", F.round("depth", 6).alias("depth"), F.round("value", 6).alias("value"), F.round("fit", 6).alias("fit"))


add("p3_profile", p3_profile, f"""WITH {WATER}, {_LONG3.replace("{'k': 'P', 'v': " + chr(34) + "P" + chr(34) + "}", "{'k': 'Z', 'v': NULL::DOUBLE}")},
dz AS (SELECT tm.*, w."C" / 2 AS z FROM tm JOIN water w USING (sample_no) WHERE var <> 'Z'),
k AS (SELECT site, semester, var, regr_slope(v, z) AS s, regr_intercept(v, z) AS i FROM dz GROUP BY 1, 2, 3)
SELECT site, semester, var, sample_no, round(z, 6) AS depth, round(v, 6) AS value, CASE WHEN v IS NOT NULL AND z IS NOT NULL THEN round(greatest(i + s * z, 0), 6) END AS fit FROM dz JOIN k USING (site, semester, var)""")


def _light_panel_source(spark, path):
    s = light_series(spark, path)
    return s.withColumns({"spread": F.when(F.col("sample_no") % 4 == 0, F.col("temp") / 50), "Flag_lux": F.when(F.dayofmonth("ts") > 22, 4).otherwise(1)})


def p4_light_at_site(spark, path):
    out = pn.light_at_site(_light_panel_source(spark, path), _SITES, [2023, 2024], degree=1)
    return out.select("site", "var", "ts", "sample_no", F.round("value", 6).alias("value"), F.round("half_bar", 8).alias("half_bar"), F.round("fit", 6).alias("fit"), "cutoff")


_P4 = LIGHT + f""", tv AS (SELECT site, ts, sample_no, temp AS v, CASE WHEN sample_no % 4 = 0 AND temp > 0 THEN temp / 50 / 2 END AS hb FROM light WHERE temp IS NOT NULL),
{_trend_sql('tv', 'site', 'ts, sample_no', 'tr')}, ct AS (SELECT site, min(ts) AS cutoff FROM light WHERE day(ts) > 22 GROUP BY 1),
pa AS (SELECT site, 'temp' AS var, ts, sample_no, v AS value, hb AS half_bar, fit FROM tr UNION ALL
SELECT site, 'lux', ts, sample_no, lux, NULL, NULL FROM light WHERE lux IS NOT NULL UNION ALL
SELECT site, 'daily_peak', CAST(date_trunc('day', ts) AS TIMESTAMP), NULL, max(lux), NULL, NULL FROM light WHERE lux IS NOT NULL GROUP BY 1, 2, 3)"""
add("p4_light_at_site", p4_light_at_site, f"""WITH {_P4} SELECT site, var, ts, sample_no, round(value, 6) AS value, round(half_bar, 8) AS half_bar, round(fit, 6) AS fit, cutoff FROM pa LEFT JOIN ct USING (site)""")


def p5_light_across_sites(spark, path):
    out = pn.light_across_sites(_light_panel_source(spark, path), _SITES, [2024], degree=1)
    return out.select("site", "var", "sample_no", F.round("hours", 6).alias("hours"), F.round("value", 6).alias("value"), F.round("fit", 6).alias("fit"), F.round("cutoff_hours", 6).alias("cutoff_hours"))


add("p5_light_across_sites", p5_light_across_sites, f"""WITH {_P4}, og AS (SELECT site, epoch_us(date_trunc('day', min(ts))) AS o FROM light GROUP BY 1)
SELECT site, var, sample_no, round((epoch_us(ts) - o) / 3.6e9, 6) AS hours, round(value, 6) AS value, round(fit, 6) AS fit, round((epoch_us(cutoff) - o) / 3.6e9, 6) AS cutoff_hours
FROM pa JOIN og USING (site) LEFT JOIN ct USING (site)""")


def p8_single_variable(spark, path):
    return pn.single_variable(scalar_series(spark, path), "v", ["series_id"], "2024-01-02 00:00:00", "2024-01-29 12:00:00").select("series_id", "sample_no", "v", "axis_from", "axis_to")


add("p8_single_variable", p8_single_variable, f"""WITH {EV}, r AS (SELECT *, min(ts) OVER (PARTITION BY series_id) AS a, max(ts) OVER (PARTITION BY series_id) AS z FROM ev
  WHERE v IS NOT NULL AND ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-29 12:00:00')
SELECT series_id, sample_no, v, CAST(date_trunc('day', a) AS TIMESTAMP) AS axis_from, CAST(CASE WHEN date_trunc('day', z) < z THEN date_trunc('day', z) + INTERVAL 1 DAY ELSE z END AS TIMESTAMP) AS axis_to FROM r""")


# ------------------------------------------------------------------- C1 - C3
def _corpus(spark, path):
    """Products are users; some lost their separator, some break the limits."""
    s = scalar_series(spark, path)
    k = F.substring("series_id", 2, 20).cast("long") % 4
    return s.select("series_id", "ts", "sample_no",
                    F.when(k == 0, F.floor(F.col("v") / 18 * 1000 + 8000).cast("double")).when(k == 1, F.col("v") * 100 + 0.25 + 5000).otherwise(F.col("v") / 8 - 2).alias("T"),
                    (F.col("value") / 10).alias("O2"), (F.col("value") / 5 - 3).alias("org"),
                    F.when(F.col("sample_no") % 19 == 0, 7).when(F.col("v").isNull(), 9).when((F.col("v") / 8 - 2 > 40) & (F.col("sample_no") % 2 == 0), 4).otherwise(1).alias("Flag_T"),
                    F.when(F.col("value") > 200, 3).otherwise(1).alias("Flag_org"), F.lit(1).alias("Flag_O2"))


_CORPUS = EV + """, cp AS (SELECT series_id, ts, sample_no, CASE CAST(substr(series_id, 2) AS BIGINT) % 4 WHEN 0 THEN floor(v / 18 * 1000 + 8000) WHEN 1 THEN v * 100 + 0.25::DOUBLE + 5000 ELSE v / 8 - 2 END AS t,
  value / 10 AS o2, value / 5 - 3 AS org, CASE WHEN sample_no % 19 = 0 THEN 7 WHEN v IS NULL THEN 9 WHEN v / 8 - 2 > 40 AND sample_no % 2 = 0 THEN 4 ELSE 1 END AS ft,
  CASE WHEN value > 200 THEN 3 ELSE 1 END AS fo FROM ev)"""
_SENSOR = {k: s for k, (_c, s, _e) in VARIABLES.items() if s}
_ENV = {k: e for k, (_c, _s, e) in VARIABLES.items() if e}
_VALS, _FLAGS = {"T": "T", "O2": "O2", "org": "org"}, {"T": "Flag_T", "O2": "Flag_O2", "org": "Flag_org"}


def c1_scale_defects(spark, path):
    out = co.scale_defects(_corpus(spark, path), ["series_id"], _VALS, _ENV)
    return out.select("series_id", "var", "n", F.round("vmin", 6).alias("vmin"), F.round("vmax", 6).alias("vmax"), "integers", "factor", "verdict")


def c2_impossible_values(spark, path):
    out = co.impossible_values(_corpus(spark, path), ["series_id"], _VALS, _FLAGS, _SENSOR, _ENV)
    return out.select("series_id", "var", "n_out", "n_caught", F.round("worst", 6).alias("worst"), "unflagged")


_CLONG = _CORPUS + """, cl AS (SELECT series_id, 'T' AS var, t AS v, ft AS f, 8.0 AS elo, 35.0 AS ehi, -5.0 AS slo, 40.0 AS shi FROM cp UNION ALL
SELECT series_id, 'O2', o2, 1, 120, 450, 0, 500 FROM cp UNION ALL SELECT series_id, 'org', org, fo, 0, 50, 0, 50 FROM cp)"""
add("c1_scale_defects", c1_scale_defects, f"""WITH {_CLONG}, g AS (SELECT series_id, var, count(*) AS n, min(v) AS vmin, max(v) AS vmax, avg((v BETWEEN elo AND ehi)::INT) AS i,
  avg((v = round(v))::INT) > 0.98 AS integers, avg((v / 10 BETWEEN elo AND ehi)::INT) AS f1, avg((v / 100 BETWEEN elo AND ehi)::INT) AS f2, avg((v / 1000 BETWEEN elo AND ehi)::INT) AS f3 FROM cl WHERE v IS NOT NULL GROUP BY 1, 2),
h AS (SELECT *, CASE WHEN f1 > 0.98 THEN 10.0 WHEN f2 > 0.98 THEN 100.0 WHEN f3 > 0.98 THEN 1000.0 END::DOUBLE AS factor FROM g WHERE n >= 10 AND i <= 0.02)
SELECT series_id, var, n, round(vmin, 6) AS vmin, round(vmax, 6) AS vmax, integers, factor, CASE WHEN integers AND factor IS NOT NULL THEN 'LOST SEPARATOR' ELSE 'not a scale defect' END AS verdict FROM h""")
add("c2_impossible_values", c2_impossible_values, f"""WITH {_CLONG}, g AS (SELECT series_id, var, count(*) AS n, count(*) FILTER (v < slo OR v > shi) AS n_out,
  count(*) FILTER ((v < slo OR v > shi) AND (f = 4 OR (var = 'org' AND f = 3))) AS n_caught, max(abs(v)) FILTER (v < slo OR v > shi) AS worst FROM cl WHERE v IS NOT NULL GROUP BY 1, 2)
SELECT series_id, var, n_out, n_caught, round(worst, 6) AS worst, n_caught < n_out AS unflagged FROM g WHERE n >= 10 AND n_out > 0""")


def c3_invariants(spark, path):
    c = _corpus(spark, path)
    out = co.invariants(c, ["series_id"], ["sample_no"], "ts", _VALS, _FLAGS)
    return out.select("series_id", "kind", "name", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


add("c3_invariants", c3_invariants, f"""WITH {_CORPUS}, g AS (SELECT series_id, count(*) AS n, count(*) FILTER (ft = 7) AS c7,
  count(*) FILTER (fo = 1 AND org < 0) AS no, min(org) FILTER (fo = 1 AND org < 0) AS mo, count(*) FILTER (o2 < 0) AS n2, min(o2) FILTER (o2 < 0) AS m2,
  count(*) FILTER (ft = 1 AND (t < -5 OR t > 45)) AS np, min(t) FILTER (ft = 1) AS pl, max(t) FILTER (ft = 1) AS ph, avg((ft = 9)::INT) AS ms FROM cp GROUP BY 1)
SELECT series_id, 'invalid_flag_code' AS kind, 'Flag_T' AS name, c7::DOUBLE AS n, 7.0::DOUBLE AS low, 7.0::DOUBLE AS high FROM g WHERE c7 > 0 UNION ALL
SELECT series_id, 'negative_in_good', 'org', no, round(mo, 6), NULL FROM g WHERE no > 0 UNION ALL SELECT series_id, 'negative_in_good', 'O2', n2, round(m2, 6), NULL FROM g WHERE n2 > 0 UNION ALL
SELECT series_id, 'implausible_good', 'T', np, round(pl, 6), round(ph, 6) FROM g WHERE np > 0 UNION ALL
SELECT series_id, 'blanked_fraction', 'Flag_T', n, round(ms, 3), NULL FROM g""")


# ------------------------------------------------------------------- C4 - C8
def _late(spark, path):
    """Groups 4 to 7 run twelve hours late."""
    s = _by_third(spark, path)
    g = F.substring("series_id", 2, 3).cast("int")
    return s.withColumn("ts", F.when(g.between(4, 7), F.col("ts") + F.expr("INTERVAL 12 HOURS")).otherwise(F.col("ts")))


_LATE = LIGHT12 + """, lt AS (SELECT series_id, sample_no, temp, lux, CASE WHEN CAST(substr(series_id, 2) AS INTEGER) BETWEEN 4 AND 7 THEN ts + INTERVAL 12 HOUR ELSE ts END AS ts FROM l12)"""


def c4_swapped_clock(spark, path):
    rows, _verdict = ck.repair_swapped(_late(spark, path), "series_id")
    return rows.select("series_id", "sample_no", "ts")


def c4_swapped_verdict(spark, path):
    return ck.repair_swapped(_late(spark, path), "series_id")[1]


def _phase_again(pre, src):
    body = _PHASE.replace("FROM clk", f"FROM {src}")
    for n in ("ph0", "ph1", "ph2", "ph3"):
        body = body.replace(n, pre + n)
    return body.replace("ph AS (", f"{pre}ph AS (")


_C4 = f"""{_LATE}, {_phase_again('a', 'lt')}, ac AS (SELECT series_id, CASE WHEN offset_h >= 8 THEN 12 END AS acc, stamps FROM aph),
mv AS (SELECT lt.series_id, lux, ts + INTERVAL 12 HOUR AS ts FROM lt JOIN ac USING (series_id) WHERE acc IS NOT NULL), {_phase_again('b', 'mv')},
vd AS (SELECT ac.series_id, acc, CASE WHEN acc IS NULL THEN 'sound' WHEN bph.offset_h < 8 AND NOT bph.collapsed AND bph.evaluable AND bph.dl / bph.al >= 0.9 AND bph.stamps = ac.stamps THEN 'repaired' ELSE 'refused' END AS verdict
  FROM ac LEFT JOIN bph USING (series_id))"""
add("c4_swapped_clock", c4_swapped_clock, f"WITH {_C4} SELECT series_id, sample_no, CASE WHEN verdict = 'repaired' THEN ts + INTERVAL 12 HOUR ELSE ts END AS ts FROM lt JOIN vd USING (series_id)")
add("c4_swapped_verdict", c4_swapped_verdict, f"WITH {_C4} SELECT series_id, CAST(acc AS INTEGER) AS accused_h, verdict FROM vd")


def _collapsed(spark, path):
    """Hourly series whose clock lost its AM/PM mark; one group lacks some mornings, the last is irregular."""
    s = scalar_series(spark, path)
    s = s.withColumn("series_id", F.concat(F.lit("g"), (F.substring("series_id", 2, 20).cast("long") % 4).cast("string")))
    s = ordered(s.select("series_id", "sample_no", "ts", "value"), "series_id", "sample_no").scan(pos=Position()).rows
    g = F.substring("series_id", 2, 3).cast("int")
    true = F.timestamp_add("HOUR", (F.col("pos") + g * 8).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    true = F.when(g == 3, F.date_trunc("minute", "ts").cast("timestamp_ntz")).otherwise(true)
    s = s.withColumn("true_ts", true)
    hour = F.hour("true_ts")
    s = s.where((g != 1) | ~F.dayofmonth("true_ts").isin(5, 11) | (hour >= 12))
    return s.select("series_id", "sample_no", "true_ts", (20 + 3 * F.cos((hour - 14) / 24.0 * 6.283185307179586)).alias("temp"),
                    F.when((hour >= 6) & (hour < 18), F.col("value") * 100 + 1).otherwise(0.0).alias("lux"),
                    F.when(hour >= 12, F.col("true_ts") - F.expr("INTERVAL 12 HOURS")).otherwise(F.col("true_ts")).alias("ts"))


def c5_collapsed_clock(spark, path):
    rows, verdict = ck.repair_collapsed(_collapsed(spark, path), "series_id", "sample_no")
    out = rows.join(verdict.select("series_id", F.substring_index("verdict", ":", 1).alias("verdict")), "series_id")
    return out.select("series_id", "sample_no", "ts", "verdict")


_C5 = f"""{EV}, q AS (SELECT sample_no, ts, value, CAST(substr(series_id, 2) AS BIGINT) % 4 AS g FROM ev),
p AS (SELECT 'g' || g AS series_id, sample_no, ts, value, row_number() OVER (PARTITION BY g ORDER BY sample_no) - 1 AS k, g FROM q),
t AS (SELECT *, CASE WHEN g = 3 THEN date_trunc('minute', ts) ELSE TIMESTAMP '2024-01-01' + to_hours(CAST(k + g * 8 AS INTEGER)) END AS tt FROM p),
c AS (SELECT series_id, sample_no, CASE WHEN hour(tt) >= 12 THEN tt - INTERVAL 12 HOUR ELSE tt END AS ts,
  CASE WHEN hour(tt) >= 6 AND hour(tt) < 18 THEN value * 100 + 1 ELSE 0.0 END AS lux FROM t WHERE g <> 1 OR day(tt) NOT IN (5, 11) OR hour(tt) >= 12),
b AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY sample_no) AS i, date_trunc('day', ts) AS d, (hour(ts) % 12) * 3600 + minute(ts) * 60 + second(ts) AS w FROM c),
o AS (SELECT series_id, d, row_number() OVER (PARTITION BY series_id ORDER BY min(i)) - 1 AS di FROM b GROUP BY 1, 2),
r AS (SELECT b.*, di * 86400 + w AS base FROM b JOIN o USING (series_id, d)),
s AS (SELECT series_id, i, w - lag(w) OVER v AS step, d = lag(d) OVER v AS same FROM r WINDOW v AS (PARTITION BY series_id ORDER BY i)),
m AS (SELECT series_id, step, count(*) AS n, min(i) AS f FROM s WHERE same AND step > 0 GROUP BY 1, 2),
iv AS (SELECT series_id, arg_max(step, n * 1000000000 - f) AS iv FROM m GROUP BY 1),
walk AS (SELECT series_id, h.seed, 1::BIGINT AS i, (base + h.seed * 43200)::BIGINT AS t, 0::BIGINT AS hit FROM r, (VALUES (0), (1)) h(seed) WHERE i = 1
  UNION ALL SELECT * FROM (SELECT x.series_id, x.seed, r.i, CASE WHEN base > t AND abs(base - t - iv) <= abs(base + 43200 - t - iv) THEN base WHEN base + 43200 > t THEN base + 43200 END::BIGINT AS nt,
    (CASE WHEN base > t AND abs(base - t - iv) <= abs(base + 43200 - t - iv) THEN base ELSE base + 43200 END - t = iv)::BIGINT AS hit
    FROM walk x JOIN r ON r.series_id = x.series_id AND r.i = x.i + 1 JOIN iv ON iv.series_id = x.series_id) WHERE nt IS NOT NULL),
n AS (SELECT series_id, count(*) AS n FROM r GROUP BY 1),
ok AS (SELECT series_id, seed, sum(hit) / greatest(max(n) - 1, 1) AS pace FROM walk JOIN n USING (series_id) GROUP BY 1, 2 HAVING count(*) = max(n) AND max(n) >= 4),
z AS (SELECT walk.series_id || '.' || seed AS series_id, d + to_seconds(t - di * 86400) AS ts, lux FROM walk JOIN r USING (series_id, i) JOIN o USING (series_id, d) JOIN ok USING (series_id, seed))"""
add("c5_collapsed_clock", c5_collapsed_clock, f"""WITH RECURSIVE {_C5}, {_phase_again('a', 'z')},
j AS (SELECT ok.series_id, seed, pace, offset_h, evaluable FROM ok JOIN aph ON aph.series_id = ok.series_id || '.' || seed),
x AS (SELECT series_id, bool_and(evaluable) AND min(offset_h) <= 3 AS lit, min(seed) AS least, min(offset_h) FILTER (seed = 0) AS o0, min(offset_h) FILTER (seed = 1) AS o1,
  min(pace) FILTER (seed = 0) AS p0, min(pace) FILTER (seed = 1) AS p1 FROM j GROUP BY 1),
e AS (SELECT series_id, lit, CASE WHEN o0 IS NULL OR o1 IS NULL THEN least WHEN abs(o0 - o1) < 1e-6 THEN (p1 > p0)::INT ELSE (o1 < o0)::INT END AS seed FROM x),
f AS (SELECT j.series_id, j.seed FROM e JOIN j USING (series_id, seed) WHERE lit AND pace >= 0.95)
SELECT r.series_id, r.sample_no, CAST(CASE WHEN f.seed IS NULL THEN r.ts ELSE d + to_seconds(t - di * 86400) END AS TIMESTAMP) AS ts, CASE WHEN f.seed IS NULL THEN 'refused' ELSE 'repaired' END AS verdict
FROM r JOIN o USING (series_id, d) LEFT JOIN f ON f.series_id = r.series_id LEFT JOIN walk ON walk.series_id = r.series_id AND walk.seed = f.seed AND walk.i = r.i""")


def _region_daily(spark, path):
    """Regional wave: one value per day, for every group."""
    s = scalar_series(spark, path)
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    ref = s.groupBy(day).agg((25 + 3 * F.sin(F.dayofmonth(F.first("ts")) / 5.0)).alias("reference"))
    return ref.withColumn("series_id", F.explode(F.array(*[F.lit(f"g{i}") for i in range(11)])))


def _lost_epoch(spark, path):
    s = _by_third(spark, path)
    day = F.dayofmonth("ts")
    g = F.substring("series_id", 2, 3).cast("int")
    temp = F.when(g == 3, F.col("temp")).otherwise(25 + 3 * F.sin(day / 5.0) + F.col("temp") / 1000)
    return s.select("series_id", "sample_no", (F.col("ts") - F.expr("INTERVAL 9605 HOURS")).alias("ts"), temp.alias("temp"), "lux")


def c6_epoch_repair(spark, path):
    s = _by_third(spark, path)
    archived = s.groupBy("series_id").agg(F.min("ts").cast("date").alias("archived_day"))
    ref = _region_daily(spark, path)
    out = ck.repair_epoch(_lost_epoch(spark, path), archived, ref, "series_id", min_days=20)
    return out.select("series_id", "hour_shift", "day_shift", "days", F.round("corr", 6).alias("corr"), "verdict")


add("c6_epoch_repair", c6_epoch_repair, f"""WITH {LIGHT12}, lo AS (SELECT series_id, sample_no, ts - INTERVAL 9605 HOUR AS ts, lux,
  CASE WHEN series_id = 'g3' THEN temp ELSE 25 + 3 * sin(day(ts) / 5.0) + temp / 1000 END AS temp FROM l12), clk AS (SELECT * FROM lo), {_PHASE},
ar AS (SELECT series_id, CAST(min(ts) AS DATE) AS ad FROM l12 GROUP BY 1), st AS (SELECT series_id, min(ts) AS t0 FROM lo GROUP BY 1),
pl AS (SELECT series_id, evaluable, ad, CAST(round_even(12 - peak_hour, 0) AS INTEGER) AS hs, t0 FROM st JOIN ph USING (series_id) JOIN ar USING (series_id)),
pd AS (SELECT *, date_diff('day', CAST(t0 + to_hours(hs) AS DATE), ad) AS dsh FROM pl),
rf AS (SELECT DISTINCT CAST(ts AS DATE) AS d, 25 + 3 * sin(day(ts) / 5.0) AS ref FROM l12),
ow AS (SELECT lo.series_id, CAST(lo.ts + to_hours(CAST(dsh * 24 + hs AS INTEGER)) AS DATE) AS d, avg(temp) AS own FROM lo JOIN pd USING (series_id) WHERE hs IS NOT NULL GROUP BY 1, 2 HAVING avg(temp) IS NOT NULL),
ft AS (SELECT series_id, count(*) AS days, corr(own, ref) AS cr FROM ow JOIN rf USING (d) WHERE series_id <> 'g11' GROUP BY 1)
SELECT series_id, hs AS hour_shift, CAST(dsh AS INTEGER) AS day_shift, coalesce(days, 0) AS days, round(cr, 6) AS corr,
CASE WHEN NOT evaluable THEN 'refused: no usable light' WHEN days IS NULL THEN 'refused: no reference' WHEN days < 20 THEN 'refused: too few days'
  WHEN coalesce(cr, -1) < 0.5 THEN 'refused: does not follow the region' ELSE 'accepted' END AS verdict FROM pd LEFT JOIN ft USING (series_id)""")


def c7_epoch_report(spark, path):
    s = _by_third(spark, path)
    span = s.groupBy("series_id").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    g = F.substring("series_id", 2, 3).cast("int")
    name = F.concat(F.lit("HB_"), F.date_format(F.col("a") + F.expr("INTERVAL 40 DAYS"), "ddMMyy"), F.lit("_"), F.date_format(F.col("z"), "ddMMyy"), F.lit(".csv"))
    s = s.join(span.select("series_id", F.when(g % 3 == 0, "plain.csv").otherwise(name).alias("file")), "series_id")
    return ck.epoch_report(s, "series_id", "file")


add("c7_epoch_report", c7_epoch_report, f"""WITH {LIGHT12}, clk AS (SELECT * FROM l12), {_PHASE}, sp AS (SELECT series_id, min(ts) AS data_from, max(ts) AS data_to FROM l12 GROUP BY 1),
n AS (SELECT *, CAST(substr(series_id, 2) AS INTEGER) % 3 <> 0 AS nm, CAST(CAST(data_from + INTERVAL 40 DAY AS DATE) AS TIMESTAMP) AS nf, CAST(CAST(data_to AS DATE) AS TIMESTAMP) AS nt FROM sp)
SELECT series_id, CASE WHEN nm THEN 'HB_' || strftime(nf, '%d%m%y') || '_' || strftime(nt, '%d%m%y') || '.csv' ELSE 'plain.csv' END AS file, data_from, data_to,
CASE WHEN nm THEN nf END AS name_from, CASE WHEN nm THEN nt END AS name_to, CAST(floor((epoch_us(data_to) - epoch_us(data_from)) / 8.64e10) AS BIGINT) AS data_days,
CASE WHEN nm THEN CAST(floor((epoch_us(nt) - epoch_us(nf)) / 8.64e10) AS BIGINT) END AS name_days, CASE WHEN nm THEN CAST(floor((epoch_us(nf) - epoch_us(data_from)) / 8.64e10) AS BIGINT) END AS offset_days,
round(peak_hour, 1) AS light_peak_h FROM n JOIN ph USING (series_id)""")


def c8_wrong_clock_gate(spark, path):
    late = _late(spark, path)
    return ck.wrong_clock_gate(late, li.clock_phase(late, "series_id"), "series_id").select("series_id", "sample_no", "ts")


add("c8_wrong_clock_gate", c8_wrong_clock_gate, f"""WITH {_LATE}, {_phase_again('a', 'lt')} SELECT series_id, sample_no, ts FROM lt
WHERE series_id NOT IN (SELECT series_id FROM aph WHERE offset_h >= 8)""")
