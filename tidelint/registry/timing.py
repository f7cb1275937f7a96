"""Queries for joins in time, replicates and light."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelint.functions.flags import range_flag
from tidelint.operators import light as li
from tidelint.operators import replicates as rp
from tidelint.operators import reports
from tidelint.operators import timejoin as tj
from tidelint.operators.ordering import Prev, ordered
from tidelint.registry.base import EV, LIGHT, light_series, scalar_series, table

QUERIES, SQL = {}, {}
LATITUDE = -17.5


def add(name, fn, sql):
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


# ------------------------------------------------------------------ J1 J2 J3
def _halves(spark, path):
    """Even events are targets, odd events are sources, per event type."""
    s = scalar_series(spark, path)
    return s.where(F.col("sample_no") % 2 == 0), s.where(F.col("sample_no") % 2 == 1)


def j1_interpolate_bracket(spark, path):
    t, s = _halves(spark, path)
    out = tj.interpolate(t.select("event_type", "ts", "sample_no"), s, "event_type", {"value": "co2"}, "bracket")
    return out.select("event_type", "sample_no", F.round("co2", 6).alias("co2"))


def j2_interpolate_nearest(spark, path):
    t, s = _halves(spark, path)
    out = tj.interpolate(t.select("event_type", "ts", "sample_no"), s, "event_type", {"value": "other"}, "nearest")
    return out.select("event_type", "sample_no", F.round("other", 6).alias("other"))


_SIDES = EV + """, t AS (SELECT event_type, ts, sample_no FROM ev WHERE sample_no % 2 = 0),
s0 AS (SELECT event_type, ts AS st, epoch_us(ts) AS u, value FROM ev WHERE sample_no % 2 = 1),
s AS (SELECT *, u - lag(u) OVER w AS bg, lead(u) OVER w - u AS ag FROM s0 WINDOW w AS (PARTITION BY event_type ORDER BY u)),
st AS (SELECT event_type, median(bg) AS med, min(u) AS u0, max(u) AS u1 FROM s GROUP BY 1),
l AS (SELECT t.*, epoch_us(t.ts) AS x, s.u AS lu, s.value AS lv, s.bg, s.ag FROM t ASOF LEFT JOIN s
  ON t.event_type = s.event_type AND t.ts >= s.st),
lr AS (SELECT l.*, s.u AS ru, s.value AS rv FROM l ASOF LEFT JOIN s ON l.event_type = s.event_type AND l.ts < s.st),
j AS (SELECT lr.*, med, x BETWEEN u0 AND u1 AS ins,
  CASE WHEN lu = x THEN lv ELSE (rv - lv) / (ru - lu) * (x - lu) + lv END AS y FROM lr JOIN st USING (event_type))"""
add("j1_interpolate_bracket", j1_interpolate_bracket, f"""WITH {_SIDES} SELECT event_type, sample_no,
CASE WHEN ins AND (CASE WHEN lu = x THEN coalesce(bg, ag) ELSE ru - lu END) <= 2 * med THEN round(y, 6) END AS co2 FROM j""")
add("j2_interpolate_nearest", j2_interpolate_nearest, f"""WITH {_SIDES} SELECT event_type, sample_no,
CASE WHEN ins AND least(x - lu, ru - x) <= 2 * med THEN round(y, 6) END AS other FROM j""")


def j2_sensor_groups(spark, path):
    """Three sensor groups per site on the axis of the largest."""
    s = scalar_series(spark, path).withColumn("grp", F.expr("CASE WHEN sample_no % 6 < 3 THEN 0 WHEN sample_no % 6 < 5 THEN 1 ELSE 2 END"))
    out = tj.merge_sensor_groups(s.select("site", "ts", "sample_no", "grp", "value"), "site", "grp", [1, 2], ["value"])
    return out.select("site", "sample_no", "value", F.round("`value.1`", 6).alias("value_1"), F.round("`value.2`", 6).alias("value_2"))


def _grp(k):
    return f"""s{k}0 AS (SELECT site, ts AS st, epoch_us(ts) AS u, value FROM g WHERE grp = {k}),
s{k} AS (SELECT *, u - lag(u) OVER (PARTITION BY site ORDER BY u) AS bg FROM s{k}0),
t{k} AS (SELECT site, median(bg) AS med, min(u) AS u0, max(u) AS u1 FROM s{k} GROUP BY 1),
l{k} AS (SELECT m.*, s.u AS lu, s.value AS lv FROM m ASOF LEFT JOIN s{k} s ON m.site = s.site AND m.ts >= s.st),
r{k} AS (SELECT l.*, s.u AS ru, s.value AS rv FROM l{k} l ASOF LEFT JOIN s{k} s ON l.site = s.site AND l.ts < s.st),
o{k} AS (SELECT site, sample_no, CASE WHEN x BETWEEN u0 AND u1 AND least(x - lu, ru - x) <= 2 * med
  THEN round(CASE WHEN lu = x THEN lv ELSE (rv - lv) / (ru - lu) * (x - lu) + lv END, 6) END AS v FROM r{k} JOIN t{k} USING (site))"""


add("j2_sensor_groups", j2_sensor_groups, f"""WITH {EV},
g AS (SELECT *, CASE WHEN sample_no % 6 < 3 THEN 0 WHEN sample_no % 6 < 5 THEN 1 ELSE 2 END AS grp FROM ev),
m AS (SELECT site, ts, sample_no, value, epoch_us(ts) AS x FROM g WHERE grp = 0), {_grp(1)}, {_grp(2)}
SELECT m.site, m.sample_no, m.value, o1.v AS value_1, o2.v AS value_2 FROM m
JOIN o1 USING (site, sample_no) JOIN o2 USING (site, sample_no)""")


def j3_nearest(spark, path):
    t, s = _halves(spark, path)
    out = tj.nearest(t.select("event_type", "ts", "sample_no"), s, "event_type", {"value": "twin"}, 600.0)
    return out.select("event_type", "sample_no", "twin")


add("j3_nearest", j3_nearest, f"""WITH {_SIDES} SELECT event_type, sample_no,
CASE WHEN lu IS NULL OR (ru - x) <= (x - lu) THEN CASE WHEN ru - x <= 600000000 THEN rv END
  ELSE CASE WHEN x - lu <= 600000000 THEN lv END END AS twin FROM j""")


def j4_covering_interval(spark, path):
    """Casts are events; the candidate files are each site's user-days."""
    s = scalar_series(spark, path)
    files = (s.groupBy("site", "series_id", F.to_date("ts").alias("d")).agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
             .withColumn("file", F.concat("series_id", F.lit("_"), F.col("d").cast("string"))))
    casts = s.select("site", "sample_no", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start"))
    out = tj.covering_interval(casts, files, "site", "start", "t0", "t1", "file")
    return out.select("site", "sample_no", "file")


add("j4_covering_interval", j4_covering_interval, f"""WITH {EV},
f AS (SELECT site, series_id || '_' || CAST(ts AS DATE) AS file, min(ts) AS t0, max(ts) AS t1 FROM ev GROUP BY site, series_id, CAST(ts AS DATE)),
c AS (SELECT DISTINCT site, date_trunc('hour', ts) AS start FROM ev),
b AS (SELECT c.site, c.start, arg_min(file, (t1 - t0, file)) AS file FROM c JOIN f ON c.site = f.site
  AND c.start >= t0 - INTERVAL 1 HOUR AND c.start <= t1 + INTERVAL 1 HOUR GROUP BY 1, 2)
SELECT ev.site, sample_no, file FROM ev LEFT JOIN b ON ev.site = b.site AND date_trunc('hour', ev.ts) = b.start""")


# --------------------------------------------------------------- replicates
def loggers(spark, path):
    """Two loggers per deployment following one regional wave; some drift,
    some are noisy, some carry an unrelated pattern."""
    s = scalar_series(spark, path)
    day = F.dayofmonth("ts")
    dep = F.concat(F.lit("d"), (F.substring("series_id", 2, 20).cast("long") % 8).cast("string"))
    rep = (F.col("sample_no") % 2).cast("int")
    s = s.select(dep.alias("deployment"), rep.alias("replicate"), "ts", "sample_no", "value", day.alias("day_no"))
    two = F.col("replicate") == 1
    d = F.col("deployment")
    temp = (25 + 3 * F.sin(F.col("day_no") / 3.0) + F.col("value") / 2000
            + F.when(two & d.isin("d0", "d1") & (F.col("day_no") > 15), 3.0).otherwise(0.0)
            + F.when(two & (d == "d2"), 6 * F.sin(F.col("day_no") / 3.0)).otherwise(0.0)
            + F.when(two & (d == "d3"), (F.col("day_no") % 7) - 3.0).otherwise(0.0))
    return s.select("deployment", "replicate", "ts", "sample_no", temp.alias("temp"), (F.col("value") * 100).alias("lux"),
                    F.when(F.col("sample_no") % 37 == 0, 4).otherwise(1).alias("Flag_T"),
                    F.when(two & (F.col("day_no") > 20), 4).otherwise(1).alias("Flag_lux"))


LOGGERS = EV + """, lg0 AS (SELECT 'd' || (CAST(substr(series_id, 2) AS BIGINT) % 8) AS deployment,
  CAST(sample_no % 2 AS INTEGER) AS replicate, ts, sample_no, value, day(ts) AS dn FROM ev),
lg AS (SELECT deployment, replicate, ts, sample_no, 25 + 3 * sin(dn / 3.0) + value / 2000
  + CASE WHEN replicate = 1 AND deployment IN ('d0', 'd1') AND dn > 15 THEN 3.0 ELSE 0 END
  + CASE WHEN replicate = 1 AND deployment = 'd2' THEN 6 * sin(dn / 3.0) ELSE 0 END
  + CASE WHEN replicate = 1 AND deployment = 'd3' THEN (dn % 7) - 3.0 ELSE 0 END AS temp, value * 100 AS lux,
  CASE WHEN sample_no % 37 = 0 THEN 4 ELSE 1 END AS flag_t,
  CASE WHEN replicate = 1 AND dn > 20 THEN 4 ELSE 1 END AS flag_lux FROM lg0)"""


def _near_sql(value_cols, tol):
    """CTE al: both replicates on the first one's stamps."""
    cols = ", ".join(f"CASE WHEN hit THEN CASE WHEN rgt THEN r_{v} ELSE l_{v} END END AS {v}" for v in value_cols)
    lc = ", ".join(f"s.{v} AS l_{v}" for v in value_cols)
    rc = ", ".join(f"s.{v} AS r_{v}" for v in value_cols)
    return f"""gr AS (SELECT deployment, ts, median(epoch_us(ts) - prev) OVER (PARTITION BY deployment) / 2e6 AS half FROM
  (SELECT deployment, ts, lag(epoch_us(ts)) OVER (PARTITION BY deployment ORDER BY ts) AS prev FROM src WHERE replicate = 0)),
tg AS (SELECT gr.*, rep AS replicate, epoch_us(ts) AS x FROM gr CROSS JOIN (VALUES (0), (1)) v(rep)),
al_l AS (SELECT t.*, epoch_us(s.ts) AS lu, {lc} FROM tg t ASOF LEFT JOIN src s
  ON t.deployment = s.deployment AND t.replicate = s.replicate AND t.ts >= s.ts),
al_r AS (SELECT t.*, epoch_us(s.ts) AS ru, {rc} FROM al_l t ASOF LEFT JOIN src s
  ON t.deployment = s.deployment AND t.replicate = s.replicate AND t.ts < s.ts),
al_d AS (SELECT *, (x IS DISTINCT FROM lu) AND (lu IS NULL OR coalesce(ru - x <= x - lu, false)) AS rgt FROM al_r),
al_h AS (SELECT *, coalesce((CASE WHEN rgt THEN ru - x ELSE x - lu END) <= {tol} * 1e6, false) AS hit FROM al_d),
al AS (SELECT deployment, replicate, ts, {cols} FROM al_h)"""


def q24_combine(spark, path):
    out = rp.combine(loggers(spark, path), "deployment")
    return out.select("deployment", "ts", "temp", "spread", "lux", "Flag_T", "Flag_lux")


_SRC = "src AS (SELECT deployment, replicate, ts, temp, lux, flag_t, flag_lux FROM lg)"
add("q24_combine", q24_combine, f"""WITH {LOGGERS}, {_SRC}, {_near_sql(['temp', 'lux', 'flag_t', 'flag_lux'], 'half')},
g AS (SELECT deployment, ts, count(CASE WHEN flag_t <= 2 THEN temp END) AS nt, avg(CASE WHEN flag_t <= 2 THEN temp END) AS t,
  max(CASE WHEN flag_t <= 2 THEN temp END) - min(CASE WHEN flag_t <= 2 THEN temp END) AS sp,
  count(CASE WHEN coalesce(flag_lux, 0) <> 4 THEN lux END) AS nl, max(CASE WHEN coalesce(flag_lux, 0) <> 4 THEN lux END) AS lc,
  max(lux) AS la FROM al GROUP BY 1, 2)
SELECT deployment, ts, round_even(t * 10000, 0) / 10000 AS temp, CASE WHEN nt >= 2 THEN round_even(sp * 10000, 0) / 10000 END AS spread,
round_even((CASE WHEN nl >= 1 THEN lc ELSE la END) * 10000, 0) / 10000 AS lux,
CAST(CASE WHEN nt = 0 THEN 9 WHEN nt >= 2 AND sp > 0.5 THEN 3 ELSE 1 END AS INTEGER) AS "Flag_T",
CAST(CASE WHEN nl >= 1 THEN 1 WHEN la IS NOT NULL THEN 4 ELSE 9 END AS INTEGER) AS "Flag_lux" FROM g""")


def q22_disagreement(spark, path):
    out = rp.disagreement(loggers(spark, path), "deployment")
    return out.select("deployment", F.round("fraction_over", 6).alias("fraction_over"), F.round("max_spread", 6).alias("max_spread"),
                      "conflicting", "disagrees")


_CMP = f"src AS (SELECT deployment, replicate, ts, CASE WHEN flag_t <= 2 THEN temp END AS v FROM lg), {_near_sql(['v'], '1800')}, " + """
gs AS (SELECT deployment, ts, CASE WHEN count(v) >= 2 THEN max(v) - min(v) END AS spread FROM al GROUP BY 1, 2),
go AS (SELECT *, coalesce(spread > 0.5, false) AS ov FROM gs),
sm AS (SELECT deployment, avg(ov::INT) AS fo, coalesce(max(spread), 0) AS ms FROM go GROUP BY 1)"""
add("q22_disagreement", q22_disagreement, f"""WITH {LOGGERS}, {_CMP}
SELECT deployment, round(fo, 6) AS fraction_over, round(ms, 6) AS max_spread, false AS conflicting, fo >= 0.2 AS disagrees FROM sm""")


def _region(spark, path):
    """The wave every deployment should follow, one value per day with data."""
    s = scalar_series(spark, path)
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    days = s.groupBy(day.alias("day")).agg(F.avg("value").alias("v"))
    days = days.select("day", (24 + 3 * F.sin(F.dayofmonth("day") / 3.0) + F.col("v") / 500).alias("reference"))
    # the last deployment has no contemporaneous neighbours
    return days.withColumn("deployment", F.explode(F.array(*[F.lit(f"d{i}") for i in range(7)])))


def q23_referee_scores(spark, path):
    scores, _v = rp.referee(loggers(spark, path), _region(spark, path), "deployment")
    return scores.select("deployment", "replicate", *[F.round(x, 6).alias(x) for x in (
        "change_corr", "bias", "bias_shift", "amplitude", "amplitude_ratio")])


def q23_referee(spark, path):
    return rp.referee(loggers(spark, path), _region(spark, path), "deployment")[1].select(
        "deployment", "verdict", "recommended")


_REF = f"""{_CMP},
rd AS (SELECT CAST(ts AS DATE) AS d, 24 + 3 * sin(day(CAST(ts AS DATE)) / 3.0) + avg(value) / 500 AS ref FROM ev GROUP BY 1),
r1 AS (SELECT d, ref, CASE WHEN lag(d) OVER w = d - 1 THEN ref - lag(ref) OVER w END AS dref FROM rd WINDOW w AS (ORDER BY d)),
rs AS (SELECT count(dref) AS points, max(ref) - min(ref) AS ramp FROM r1),
ds AS (SELECT deployment, CAST(ts AS DATE) AS d, avg(ov::INT) > 0.5 AS dis FROM go GROUP BY 1, 2),
ow AS (SELECT deployment, replicate, CAST(ts AS DATE) AS d, avg(v) AS m FROM al GROUP BY 1, 2, 3 HAVING avg(v) IS NOT NULL),
o1 AS (SELECT *, CASE WHEN lag(d) OVER w = d - 1 THEN m - lag(m) OVER w END AS dm FROM ow
  WINDOW w AS (PARTITION BY deployment, replicate ORDER BY d)),
am AS (SELECT deployment, replicate, max(m) - min(m) AS amplitude FROM o1 GROUP BY 1, 2),
jn AS (SELECT o1.*, r1.ref, r1.dref, coalesce(dis, false) AS dis FROM o1 JOIN r1 USING (d) LEFT JOIN ds USING (deployment, d)
  WHERE deployment <> 'd7'),
sq AS (SELECT deployment, replicate, CASE WHEN count(CASE WHEN dm IS NOT NULL THEN dref END) >= 2 THEN corr(dm, dref) END AS change_corr,
  avg(m - ref) AS bias, avg(CASE WHEN dis THEN m - ref END) - avg(CASE WHEN NOT dis THEN m - ref END) AS bias_shift FROM jn GROUP BY 1, 2),
sc AS (SELECT am.*, change_corr, bias, bias_shift, CASE WHEN deployment <> 'd7' THEN amplitude / ramp END AS amplitude_ratio,
  CASE WHEN deployment <> 'd7' THEN points END AS points FROM am LEFT JOIN sq USING (deployment, replicate) CROSS JOIN rs)"""
add("q23_referee_scores", q23_referee_scores, f"""WITH {LOGGERS}, {_REF} SELECT deployment, replicate, round(change_corr, 6) AS change_corr,
round(bias, 6) AS bias, round(bias_shift, 6) AS bias_shift, round(amplitude, 6) AS amplitude,
round(amplitude_ratio, 6) AS amplitude_ratio FROM sc""")
add("q23_referee", q23_referee, f"""WITH {LOGGERS}, {_REF},
u AS (SELECT deployment, max(points) AS points, count(change_corr) AS nu, max(change_corr) AS c1, min(change_corr) AS c2,
  arg_max(replicate, change_corr) AS bc, max(abs(bias_shift)) AS dr, min(abs(bias_shift)) AS sy, count(bias_shift) AS ns,
  arg_min(replicate, abs(bias_shift)) AS bs, max(greatest(amplitude_ratio, 1 / amplitude_ratio)) AS fa,
  min(greatest(amplitude_ratio, 1 / amplitude_ratio)) AS cl, arg_min(replicate, greatest(amplitude_ratio, 1 / amplitude_ratio)) AS bw FROM sc GROUP BY 1),
v AS (SELECT deployment, bc, bs, bw, CASE WHEN fo < 0.2 THEN 'replicates agree'
  WHEN points IS NULL THEN 'disagreement, no reference to arbitrate' WHEN points < 4 THEN 'disagreement, reference too short'
  WHEN nu < 2 THEN 'disagreement, not enough comparable replicates' WHEN c1 < 0.5 THEN 'disagreement, reference does not describe this site'
  WHEN c1 - c2 >= 0.3 THEN 'tracks the reference'
  WHEN c1 >= 0.7 AND ns >= 2 AND dr >= 1 AND dr >= 2 * greatest(sy, 1e-6) THEN 'offset stayed put'
  WHEN c1 >= 0.7 AND fa >= 2 AND cl <= 1.5 THEN 'swing matches the reference'
  ELSE 'disagreement, replicates score too close to separate' END AS verdict FROM sm JOIN u USING (deployment))
SELECT deployment, verdict, CAST(CASE verdict WHEN 'tracks the reference' THEN bc WHEN 'offset stayed put' THEN bs
  WHEN 'swing matches the reference' THEN bw END AS INTEGER) AS recommended FROM v""")


def q25_single_replicate(spark, path):
    """Keep each deployment's replicate with more acceptable readings."""
    lg = loggers(spark, path)
    best = (lg.where(F.col("Flag_T") <= 2).groupBy("deployment", "replicate").count()
            .groupBy("deployment").agg(F.max_by("replicate", F.struct("count", "replicate")).alias("replicate")))
    return rp.keep_single(lg, best, "deployment").select("deployment", "sample_no", F.round("temp", 6).alias("temp"), "spread", "Flag_T")


add("q25_single_replicate", q25_single_replicate, f"""WITH {LOGGERS},
c AS (SELECT deployment, replicate, count(*) AS k FROM lg WHERE flag_t <= 2 GROUP BY 1, 2),
b AS (SELECT deployment, arg_max(replicate, (k, replicate)) AS replicate FROM c GROUP BY 1)
SELECT deployment, sample_no, round(temp, 6) AS temp, NULL::DOUBLE AS spread, CAST(flag_t AS INTEGER) AS "Flag_T"
FROM lg JOIN b USING (deployment, replicate)""")


def s4_stamp_conflicts(spark, path):
    lg = loggers(spark, path).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return rp.conflict_report(lg.withColumn("temp", F.when(F.col("sample_no") % 5 != 0, F.floor(F.col("temp") / 2))),
                              ["deployment", "replicate"], ["temp"])


add("s4_stamp_conflicts", s4_stamp_conflicts, f"""WITH {LOGGERS},
h AS (SELECT deployment, replicate, date_trunc('hour', ts) AS ts, CASE WHEN sample_no % 5 <> 0 THEN floor(temp / 2) END AS t FROM lg),
g AS (SELECT deployment, replicate, ts, count(*) AS k, count(DISTINCT t) + CASE WHEN count(*) > count(t) THEN 1 ELSE 0 END > 1 AS cf FROM h GROUP BY 1, 2, 3)
SELECT deployment, replicate, CAST(sum(CASE WHEN cf THEN 0 ELSE k - 1 END) AS BIGINT) AS extra_copies, count(*) FILTER (cf) AS conflicts,
CAST(min(ts) FILTER (cf) AS TIMESTAMP) AS first_conflict FROM g GROUP BY 1, 2""")


# ------------------------------------------------------- G5 G6 G7 G9 G10 G11
def g5_daily(spark, path):
    s = light_series(spark, path)
    mx, mean = li.daily_peak(s, "series_id"), li.daily_peak(s, "series_id", value="temp", how="mean")
    out = mx.withColumnRenamed("peak", "lux_max").join(mean.withColumnRenamed("peak", "temp_mean"), ["series_id", "day"], "full")
    return out.select("series_id", "day", "lux_max", F.round("temp_mean", 6).alias("temp_mean"))


add("g5_daily", g5_daily, f"""WITH {LIGHT} SELECT series_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, max(lux) AS lux_max,
round(avg(temp), 6) AS temp_mean FROM light GROUP BY 1, 2 HAVING count(lux) > 0 OR count(temp) > 0""")


def g6_adaptive_resample(spark, path):
    """Suppliers span years, quarters of orders span months, users span weeks."""
    s = table(spark, path, "lineitem").select(
        (F.col("l_suppkey") % 50).alias("series"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("v"))
    ev = scalar_series(spark, path).select((F.substring("series_id", 2, 20).cast("long") + 1000).alias("series"), "ts", F.col("v"))
    mid = table(spark, path, "orders").select(
        (F.year("o_orderdate") * 10 + F.quarter("o_orderdate") + 10000).cast("long").alias("series"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.floor("o_totalprice").cast("double").alias("v"))
    out = rp.resample(s.unionByName(ev).unionByName(mid), "series", "ts", "v")
    return out.select("series", "cadence", F.col("bin").cast("string").alias("bin"), F.round("mean", 6).alias("mean"))


add("g6_adaptive_resample", g6_adaptive_resample, f"""WITH {EV}, a AS (SELECT l_suppkey % 50 AS series, l_shipdate AS ts, l_quantity AS v FROM lineitem
UNION ALL SELECT CAST(substr(series_id, 2) AS BIGINT) + 1000, ts, v FROM ev
UNION ALL SELECT year(o_orderdate) * 10 + quarter(o_orderdate) + 10000, CAST(o_orderdate AS TIMESTAMP), floor(o_totalprice) FROM orders),
s AS (SELECT series, min(ts) AS t0, max(ts) AS t1, (epoch_us(max(ts)) - epoch_us(min(ts))) / 8.64e10 AS days FROM a GROUP BY 1),
c AS (SELECT *, CASE WHEN days > 150 THEN 'MS' WHEN days > 30 THEN 'W' ELSE 'D' END AS cadence FROM s),
lab AS (SELECT series, cadence, v, CASE cadence WHEN 'MS' THEN CAST(date_trunc('month', ts) AS DATE)
  WHEN 'W' THEN CAST(date_trunc('week', ts) AS DATE) + 6 ELSE CAST(ts AS DATE) END AS bin FROM a JOIN c USING (series)),
m AS (SELECT series, cadence, bin, avg(v) AS mean FROM lab GROUP BY 1, 2, 3),
e AS (SELECT series, cadence, CAST(unnest(CASE cadence WHEN 'MS' THEN generate_series(date_trunc('month', t0)::TIMESTAMP, t1, INTERVAL 1 MONTH)
  WHEN 'W' THEN generate_series(date_trunc('week', t0)::TIMESTAMP + INTERVAL 6 DAY, date_trunc('week', t1)::TIMESTAMP + INTERVAL 6 DAY, INTERVAL 7 DAY)
  ELSE generate_series(date_trunc('day', t0)::TIMESTAMP, t1, INTERVAL 1 DAY) END) AS DATE) AS bin FROM c)
SELECT series, cadence, CAST(bin AS VARCHAR) AS bin, round(mean, 6) AS mean FROM e LEFT JOIN m USING (series, cadence, bin)""")


def _products(spark, path):
    s = scalar_series(spark, path)
    return s.select("site", F.col("series_id").alias("product"), "ts", (F.col("v") / 10).alias("temp"),
                    F.when(F.col("sample_no") % 23 == 0, 3).otherwise(1).alias("Flag_T"))


def g7_regional_reference(spark, path):
    out = rp.regional_reference(_products(spark, path), "2024-01-03 00:00:00", "2024-01-27 23:59:59", min_rows=50)
    return out.select("site", "day", F.round("reference", 6).alias("reference"), "products")


_REGION = """pr AS (SELECT site, series_id AS product, ts, v / 10 AS temp FROM ev WHERE sample_no % 23 <> 0
  AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-27 23:59:59'),
en AS (SELECT site, product FROM pr GROUP BY 1, 2 HAVING count(*) >= 50),
dm AS (SELECT site, product, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, avg(temp) AS m FROM pr JOIN en USING (site, product)
  GROUP BY 1, 2, 3 HAVING count(temp) > 0),
rg AS (SELECT s.site, dm.day, avg(m) AS reference, count(*) AS products FROM (SELECT DISTINCT site FROM pr) s JOIN dm ON dm.site <> s.site GROUP BY 1, 2)"""
add("g7_regional_reference", g7_regional_reference, f"""WITH {EV}, {_REGION}
SELECT site, day, round(reference, 6) AS reference, products FROM rg""")


def g11_reference_comparison(spark, path):
    p = _products(spark, path)
    ref = rp.regional_reference(p, "2024-01-03 00:00:00", "2024-01-27 23:59:59", min_rows=50)
    out = rp.comparison(p, ref.select("site", "day", "reference"), ["site", "product"], "ts", "temp")
    return out.select("site", "product", "days", *[F.round(x, 6).alias(x) for x in ("corr", "bias", "amplitude")])


add("g11_reference_comparison", g11_reference_comparison, f"""WITH {EV}, {_REGION},
o AS (SELECT site, series_id AS product, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, avg(v / 10) AS m FROM ev GROUP BY 1, 2, 3)
SELECT site, product, count(*) AS days, round(corr(m, reference), 6) AS corr, round(avg(m - reference), 6) AS bias,
round(max(m) - min(m), 6) AS amplitude FROM o JOIN rg USING (site, day) WHERE m IS NOT NULL GROUP BY 1, 2""")


def g9_temperature_peak(spark, path):
    s = scalar_series(spark, path)
    out = li.temperature_peak_hour(s, "event_type", value="v")
    return out.select("event_type", "days", F.round("peak_hour", 6).alias("peak_hour"))


add("g9_temperature_peak", g9_temperature_peak, f"""WITH {EV},
d AS (SELECT event_type, CAST(ts AS DATE) AS d, count(*) AS n, arg_min(ts, (-v, ts)) AS mx FROM ev WHERE v IS NOT NULL GROUP BY 1, 2),
h AS (SELECT event_type, 2 * pi() / 24 * (hour(mx) + minute(mx) / 60.0) AS ang FROM d WHERE n >= 8),
g AS (SELECT event_type, count(*) AS days, sum(cos(ang)) AS x, sum(sin(ang)) AS y FROM h GROUP BY 1)
SELECT event_type, days, CASE WHEN days >= 20 THEN round((atan2(y, x) * 24 / (2 * pi()) + 24) % 24, 6) END AS peak_hour FROM g""")


def g10_direction_change(spark, path):
    """Circular rate of change of a heading, per user."""
    s = scalar_series(spark, path).withColumn("heading", F.col("value") * 7 % 360)
    s = ordered(s, "series_id", ["ts", "sample_no"]).scan(before=Prev("heading")).rows
    mc, ms = li.circular_std(F.col("heading"))
    g = s.groupBy("series_id").agg(mc.alias("mc"), ms.alias("ms"),
                                   F.max(li.direction_change(F.col("heading"), F.col("before"))).alias("max_turn"))
    return g.select("series_id", F.round(li.spread_degrees(F.col("mc"), F.col("ms")), 6).alias("spread"), F.round("max_turn", 6).alias("max_turn"))


add("g10_direction_change", g10_direction_change, f"""WITH {EV}, h AS (SELECT series_id, ts, sample_no, value * 7 % 360 AS hd FROM ev),
t AS (SELECT *, abs(((hd - lag(hd) OVER (PARTITION BY series_id ORDER BY ts, sample_no) + 540) % 360 + 360) % 360 - 180) AS turn FROM h)
SELECT series_id, round(degrees(sqrt(-2 * ln(least(sqrt(pow(avg(cos(radians(hd))), 2) + pow(avg(sin(radians(hd))), 2)), 1)))), 6) AS spread,
round(max(turn), 6) AS max_turn FROM t GROUP BY 1""")


# ---------------------------------------------------------------- Q10 - Q14
def q10_fixed_cutoff(spark, path):
    out = li.fixed_cutoff(light_series(spark, path), "series_id", days=28)
    return out.select("series_id", "cutoff")


add("q10_fixed_cutoff", q10_fixed_cutoff, f"""WITH {LIGHT} SELECT series_id,
CASE WHEN max(ts) >= min(ts) + INTERVAL 28 DAY THEN min(ts) + INTERVAL 28 DAY END AS cutoff FROM light GROUP BY 1""")


def _by_third(spark, path):
    """Light per group of three users, dense enough for daily peaks."""
    s = light_series(spark, path)
    return s.withColumn("series_id", F.concat(F.lit("g"), (F.substring("series_id", 2, 20).cast("long") % 12).cast("string")))


LIGHT12 = LIGHT + """, l12 AS (SELECT 'g' || (CAST(substr(series_id, 2) AS BIGINT) % 12) AS series_id, ts, sample_no, temp, lux FROM light)"""


def _clear_sky_sql(day, lat):
    from tidelint.functions.solar import yearly_maximum
    dec = f"(radians(23.44) * -cos(2 * pi() * (dayofyear({day}) + 10) / 365.25))"
    sine = f"greatest(sin(pi() / 2 - abs(radians({lat}) - {dec})), 0.05)"
    return f"({sine} * pow(0.75, 1.0 / {sine}) / {yearly_maximum(lat)!r})"


def _fouling_sql(lat):
    w = f"pk / {_clear_sky_sql('day', lat)}" if lat is not None else "pk"
    return f"""dp AS (SELECT series_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, max(lux) AS pk FROM l12 WHERE lux IS NOT NULL GROUP BY 1, 2),
dw AS (SELECT *, {w} AS wk, row_number() OVER (PARTITION BY series_id ORDER BY day) - 1 AS rn, count(*) OVER (PARTITION BY series_id) AS days FROM dp),
bs AS (SELECT *, max(CASE WHEN rn < 7 THEN wk END) OVER (PARTITION BY series_id) AS base FROM dw),
bl AS (SELECT *, wk < 0.5 * base AS lo FROM bs),
ft AS (SELECT *, max(CASE WHEN NOT lo THEN rn END) OVER (PARTITION BY series_id) AS lg, min(CASE WHEN lo THEN rn END) OVER (PARTITION BY series_id) AS fl FROM bl),
vd AS (SELECT series_id, max(days) AS days, max(base) AS base, max(lg) AS lg, max(fl) AS fl,
  min(CASE WHEN rn = coalesce(lg + 1, 0) THEN day END) AS cut, count(*) FILTER (rn >= fl) AS na, count(*) FILTER (rn >= fl AND NOT lo) AS nr FROM ft GROUP BY 1),
vf AS (SELECT *, days >= 10 AND base > 0 AS ok FROM vd),
fb AS (SELECT series_id, days, ok AS evaluable, CASE WHEN ok THEN base END AS baseline, CASE WHEN ok THEN 0.5 * base END AS threshold,
  CASE WHEN ok AND fl IS NOT NULL AND (lg IS NULL OR days - 1 - lg >= 3) THEN cut END AS cutoff,
  CASE WHEN ok AND fl < lg THEN nr / na ELSE 0.0 END AS recovery_fraction FROM vf)"""


def q11_fouling_baseline(spark, path):
    out = li.fouling_baseline(_by_third(spark, path), "series_id", latitude=LATITUDE)
    return out.select("series_id", "days", "evaluable", F.round("baseline", 4).alias("baseline"), F.round("threshold", 4).alias("threshold"),
                      "cutoff", F.round("recovery_fraction", 6).alias("recovery_fraction"), "recovers")


def q11_fouling_uncorrected(spark, path):
    out = li.fouling_baseline(_by_third(spark, path), "series_id")
    return out.select("series_id", "days", "evaluable", "baseline", "cutoff", F.round("recovery_fraction", 6).alias("recovery_fraction"))


add("q11_fouling_baseline", q11_fouling_baseline, f"""WITH {LIGHT12}, {_fouling_sql(LATITUDE)} SELECT series_id, days, evaluable,
round(baseline, 4) AS baseline, round(threshold, 4) AS threshold, cutoff, round(recovery_fraction, 6) AS recovery_fraction,
recovery_fraction > 0.2 AS recovers FROM fb""")
add("q11_fouling_uncorrected", q11_fouling_uncorrected, f"""WITH {LIGHT12}, {_fouling_sql(None)} SELECT series_id, days, evaluable, baseline, cutoff,
round(recovery_fraction, 6) AS recovery_fraction FROM fb""")


def q11_fouling_by_place(spark, path):
    """Every series under the sky of its own latitude; the last two have none."""
    s = _by_third(spark, path)
    g = F.substring("series_id", 2, 3).cast("int")
    lat = F.element_at(F.array(*[F.lit(x) for x in (-1.0, -30.0, -60.0, 45.0, 68.0)]), g % 5 + 1)
    places = s.select("series_id").distinct().where(g < 10).select("series_id", lat.alias("latitude"))
    out = li.fouling_baseline(s, "series_id", places=places)
    return out.select("series_id", "days", "evaluable", F.round("baseline", 4).alias("baseline"), "cutoff", F.round("recovery_fraction", 6).alias("recovery_fraction"))


_SKY = "{sine} * pow(0.75, 1.0 / {sine})".format(sine="greatest(sin(pi() / 2 - abs(radians(lat) - radians(23.44) * -cos(2 * pi() * ({d} + 10) / 365.25))), 0.05)")
add("q11_fouling_by_place", q11_fouling_by_place, f"""WITH {LIGHT12}, pl AS (SELECT DISTINCT series_id, [-1.0, -30.0, -60.0, 45.0, 68.0][CAST(substr(series_id, 2) AS INTEGER) % 5 + 1]::DOUBLE AS lat FROM l12 WHERE CAST(substr(series_id, 2) AS INTEGER) < 10),
mx AS (SELECT series_id, any_value(lat) AS lat, max({_SKY.format(d='d')}) AS top FROM pl, range(1, 366) r(d) GROUP BY 1),
{_fouling_sql(None).replace('max(lux) AS pk FROM l12', 'max(lux) AS pk0 FROM l12').replace('dw AS (SELECT *, pk AS wk', 'dq AS (SELECT dp.*, pk0 / coalesce(' + _SKY.format(d='dayofyear(day)') + ' / top, 1.0) AS pk FROM dp LEFT JOIN mx USING (series_id)), dw AS (SELECT *, pk AS wk').replace('FROM dp),', 'FROM dq),')}
SELECT series_id, days, evaluable, round(baseline, 4) AS baseline, cutoff, round(recovery_fraction, 6) AS recovery_fraction FROM fb""")


def g3_light_report(spark, path):
    """Totals of light loggers: temperature range and light window."""
    s = _by_third(spark, path)
    flagged = li.light_flag(s, li.fouling_baseline(s, "series_id", latitude=LATITUDE), "series_id", out="Flag_lux")
    rows = flagged.withColumn("Flag_T", range_flag(F.col("temp"), 2, 12))
    return reports.overall_report(rows, ["series_id"], ["Flag_T"], ["Flag_T"])


add("g3_light_report", g3_light_report, f"""WITH {LIGHT12}, {_fouling_sql(LATITUDE)}, f AS (SELECT series_id, CASE WHEN temp IS NULL THEN 9 WHEN temp < 2 OR temp > 12 THEN 4 ELSE 1 END AS t,
CASE WHEN lux IS NULL THEN 9 WHEN NOT coalesce(evaluable, false) THEN 2 WHEN ts >= cutoff THEN 4 ELSE 1 END AS x FROM l12 LEFT JOIN fb USING (series_id))
SELECT series_id, count(*) AS total, count(*) FILTER (t <> 4) AS valid, count(*) FILTER (t = 4) AS "T_bad", count(*) FILTER (t = 3) AS "T_suspect", count(*) FILTER (t = 9) AS "T_missing",
count(*) FILTER (x = 4) AS lux_bad, count(*) FILTER (x = 3) AS lux_suspect, count(*) FILTER (x = 9) AS lux_missing FROM f GROUP BY 1""")


def q12_clock_phase(spark, path):
    """Groups 4 to 7 run twelve hours late; 8 to 11 on a collapsed clock."""
    s = _by_third(spark, path)
    g = F.substring("series_id", 2, 3).cast("int")
    late = F.col("ts") + F.expr("INTERVAL 12 HOURS")
    fold = F.date_trunc("hour", F.when(F.hour("ts") >= 12, F.col("ts") - F.expr("INTERVAL 12 HOURS")).otherwise(F.col("ts"))).cast("timestamp_ntz")
    s = s.withColumn("ts", F.when(g.between(4, 7), late).when(g >= 8, fold).otherwise(F.col("ts")))
    out = li.clock_phase(s, "series_id")
    return out.select("series_id", "stamps", "lit", "collapsed", "evaluable", F.round("peak_hour", 6).alias("peak_hour"),
                      F.round("daylight_fraction", 6).alias("daylight_fraction"), F.round("offset_h", 6).alias("offset_h"), "shift_h", "anomalous")


_PHASE = """ph0 AS (SELECT series_id, count(ts) AS stamps, count(DISTINCT ts) AS dst, max(hour(ts)) AS mh, count(*) FILTER (lux > 0) AS lit,
  sum(lux * cos(2 * pi() / 24 * (hour(ts) + minute(ts) / 60.0))) FILTER (lux > 0) AS x,
  sum(lux * sin(2 * pi() / 24 * (hour(ts) + minute(ts) / 60.0))) FILTER (lux > 0) AS y,
  coalesce(sum(lux) FILTER (lux > 0 AND hour(ts) >= 6 AND hour(ts) < 18), 0) AS dl, sum(lux) FILTER (lux > 0) AS al FROM clk GROUP BY 1),
ph1 AS (SELECT *, stamps >= 50 AND mh <= 12 AND 1 - dst / stamps > 0.1 AS collapsed FROM ph0),
ph2 AS (SELECT *, lit >= 50 AND NOT collapsed AS evaluable FROM ph1),
ph3 AS (SELECT *, CASE WHEN evaluable THEN (atan2(y, x) * 24 / (2 * pi()) + 24) % 24 END AS peak_hour FROM ph2),
ph AS (SELECT *, abs((peak_hour + 24) % 24 - 12) AS offset_h FROM ph3)"""
add("q12_clock_phase", q12_clock_phase, f"""WITH {LIGHT12}, clk AS (SELECT series_id, lux, CASE WHEN CAST(substr(series_id, 2) AS INTEGER) BETWEEN 4 AND 7
  THEN ts + INTERVAL 12 HOUR WHEN CAST(substr(series_id, 2) AS INTEGER) >= 8 THEN date_trunc('hour', CASE WHEN hour(ts) >= 12 THEN ts - INTERVAL 12 HOUR ELSE ts END)
  ELSE ts END AS ts FROM l12), {_PHASE}
SELECT series_id, stamps, lit, collapsed, evaluable, round(peak_hour, 6) AS peak_hour, CASE WHEN evaluable THEN round(dl / al, 6) END AS daylight_fraction,
round(offset_h, 6) AS offset_h, CAST(CASE WHEN offset_h >= 8 THEN 12 END AS INTEGER) AS shift_h, coalesce(offset_h >= 4 AND offset_h < 8, false) AS anomalous FROM ph""")


def g8_circular_peak(spark, path):
    out = li.clock_phase(light_series(spark, path), "site")
    return out.select("site", F.round("peak_hour", 6).alias("peak_hour"), F.round("daylight_fraction", 6).alias("daylight_fraction"))


add("g8_circular_peak", g8_circular_peak, f"""WITH {LIGHT}, clk AS (SELECT site AS series_id, ts, lux FROM light), {_PHASE}
SELECT series_id AS site, round(peak_hour, 6) AS peak_hour, round(dl / al, 6) AS daylight_fraction FROM ph""")


def q13_clear_sky(spark, path):
    from tidelint.functions.solar import clear_sky_factor
    days = table(spark, path, "orders").groupBy(F.col("o_orderdate").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.select("day", "n", F.round(clear_sky_factor(F.col("day"), -17.96), 8).alias("south"),
                       F.round(clear_sky_factor(F.col("day"), 40.0), 8).alias("north"))


add("q13_clear_sky", q13_clear_sky, f"""WITH d AS (SELECT CAST(o_orderdate AS TIMESTAMP) AS day, count(*) AS n FROM orders GROUP BY 1)
SELECT day, n, round({_clear_sky_sql('day', -17.96)}, 8) AS south, round({_clear_sky_sql('day', 40.0)}, 8) AS north FROM d""")


def q14_light_window(spark, path):
    s = _by_third(spark, path)
    verdict = li.fouling_baseline(s, "series_id", latitude=LATITUDE)
    return li.light_flag(s, verdict, "series_id", out="flag").select("series_id", "sample_no", "flag")


add("q14_light_window", q14_light_window, f"""WITH {LIGHT12}, {_fouling_sql(LATITUDE)} SELECT series_id, sample_no,
CAST(CASE WHEN lux IS NULL THEN 9 WHEN NOT coalesce(evaluable, false) THEN 2 WHEN ts >= cutoff THEN 4 ELSE 1 END AS INTEGER) AS flag
FROM l12 LEFT JOIN fb USING (series_id)""")


def q29_light_envelope(spark, path):
    s = _by_third(spark, path)
    flagged = li.light_flag(s, li.fouling_baseline(s, "series_id"), "series_id", out="Flag_lux")
    peaks = li.daily_peak(s, "series_id")
    return peaks.join(li.cutoff_start(flagged, "series_id"), "series_id", "left").select("series_id", "day", "peak", "cutoff")


add("q29_light_envelope", q29_light_envelope, f"""WITH {LIGHT12}, {_fouling_sql(None)},
c AS (SELECT series_id, min(ts) AS cutoff FROM l12 JOIN fb USING (series_id) WHERE lux IS NOT NULL AND evaluable AND ts >= fb.cutoff GROUP BY 1)
SELECT series_id, day, pk AS peak, c.cutoff FROM dp LEFT JOIN c USING (series_id)""")


def p10_light_review(spark, path):
    s = _by_third(spark, path)
    verdict = li.fouling_baseline(s, "series_id", latitude=LATITUDE)
    out = li.threshold_curve(li.daily_peak(s, "series_id"), verdict, "series_id", LATITUDE)
    return out.select("series_id", "day", "peak", F.round("raw_threshold", 4).alias("raw_threshold"), "cutoff")


add("p10_light_review", p10_light_review, f"""WITH {LIGHT12}, {_fouling_sql(LATITUDE)}
SELECT series_id, day, pk AS peak, round(threshold * {_clear_sky_sql('day', LATITUDE)}, 4) AS raw_threshold, cutoff
FROM dp JOIN fb USING (series_id)""")


def p9_replicate_review(spark, path):
    """Readings of every replicate beside the reference, with its score."""
    lg, region = loggers(spark, path), _region(spark, path)
    scores, verdicts = rp.referee(lg, region, "deployment")
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    rows = lg.select("deployment", "replicate", "sample_no", "temp", day.alias("day"))
    out = (rows.join(region, ["deployment", "day"], "left").join(scores, ["deployment", "replicate"], "left")
           .join(verdicts.select("deployment", "recommended"), "deployment", "left"))
    return out.select("deployment", "replicate", "sample_no", F.round("temp", 6).alias("temp"), F.round("reference", 6).alias("reference"),
                      F.round("change_corr", 6).alias("change_corr"),
                      F.coalesce(F.col("recommended") == F.col("replicate"), F.lit(False)).alias("sound"))


add("p9_replicate_review", p9_replicate_review, f"""{SQL['q23_referee'].rsplit('SELECT deployment, verdict', 1)[0].rstrip()},
nm AS (SELECT deployment, CASE verdict WHEN 'tracks the reference' THEN bc WHEN 'offset stayed put' THEN bs
  WHEN 'swing matches the reference' THEN bw END AS best FROM v)
SELECT lg.deployment, lg.replicate, sample_no, round(temp, 6) AS temp,
CASE WHEN lg.deployment <> 'd7' THEN round(ref, 6) END AS reference, round(change_corr, 6) AS change_corr, coalesce(best = lg.replicate, false) AS sound
FROM lg LEFT JOIN rd ON CAST(lg.ts AS DATE) = rd.d LEFT JOIN sc ON sc.deployment = lg.deployment AND sc.replicate = lg.replicate
LEFT JOIN nm ON nm.deployment = lg.deployment""")
