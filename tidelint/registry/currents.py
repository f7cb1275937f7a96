"""Queries for current-profiler tables and transit windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelint.operators import currents as cu
from tidelint.operators.ordering import Position, ordered
from tidelint.operators.selection import depth_band, time_window
from tidelint.plans.qualify import qualify_currents
from tidelint.registry.base import CELLS, WATER, cells, table, water_series

QUERIES, SQL = {}, {}
_COLS = {k: k for k in ("speed", "strength", "state", "stdev", "tilt")}
_CURRENT = ["speed", "direction", "east", "north"]


def add(name, fn, sql):
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


def flagged(spark, path):
    return cu.current_flags(cells(spark, path), _COLS)


FLAGGED = CELLS + """, fl0 AS (SELECT *, CASE WHEN speed < 0 OR speed > 300 THEN 4 ELSE 1 END AS f1,
  CASE WHEN state <> 0 OR strength < -60 OR strength >= 0 THEN 4 ELSE 1 END AS f2, CASE WHEN stdev > 50 THEN 3 ELSE 1 END AS f3,
  CASE WHEN tilt IS NULL THEN 2 WHEN tilt > 35 THEN 4 WHEN tilt > 15 THEN 3 ELSE 1 END AS f4 FROM cells),
fl AS (SELECT *, CASE WHEN speed IS NULL THEN '99999' ELSE f1 || '' || f2 || f3 || f4 || '2' END AS flag,
  CASE WHEN speed IS NULL THEN 9 WHEN 4 IN (f1, f2, f3, f4) THEN 4 WHEN 3 IN (f1, f2, f3, f4) THEN 3 ELSE 1 END AS fc FROM fl0)"""


def q15_current_qc(spark, path):
    return flagged(spark, path).select("record", "cell", "part", "ts", "speed", "Flag", "Flag_cur")


add("q15_current_qc", q15_current_qc, f"""WITH {FLAGGED} SELECT record, cell, part, ts, speed, flag AS "Flag", CAST(fc AS INTEGER) AS "Flag_cur" FROM fl""")


def q15_current_product(spark, path):
    """The qualified table of a current profiler: local time, reviewed, fixed digits."""
    d = cells(spark, path).withColumnRenamed("ts", "Datetime").withColumn("Datetime", F.col("Datetime").cast("timestamp_ntz"))
    out = qualify_currents(d, _COLS, reviewed=True)
    return out.select("site", "record", "cell", "part", "Datetime", "speed", "Flag", "Flag_cur")


add("q15_current_product", q15_current_product, f"""WITH {FLAGGED} SELECT site, record, cell, part, CAST(ts AS TIMESTAMP) - INTERVAL 3 HOUR AS "Datetime", speed,
CASE WHEN speed IS NULL THEN '99999' ELSE f1 || '' || f2 || f3 || f4 || '1' END AS "Flag", CAST(fc AS INTEGER) AS "Flag_cur" FROM fl""")


def q15_current_qc_off(spark, path):
    d = cu.current_flags(cells(spark, path), _COLS, off=frozenset({"cur_range", "cur_tilt"}), reviewed=True)
    return d.groupBy("site", "Flag", "Flag_cur").agg(F.count(F.lit(1)).alias("n"))


add("q15_current_qc_off", q15_current_qc_off, f"""WITH {FLAGGED} SELECT site, CASE WHEN speed IS NULL THEN '99999' ELSE '5' || f2 || f3 || '51' END AS "Flag",
CAST(CASE WHEN speed IS NULL THEN 9 WHEN f2 = 4 THEN 4 WHEN f3 = 3 THEN 3 ELSE 1 END AS INTEGER) AS "Flag_cur", count(*) AS n FROM fl GROUP BY 1, 2, 3""")


def a4_tidy_cells(spark, path):
    """A line is a record with two columns of two cells each."""
    li = table(spark, path, "lineitem")
    blocks = {(col, k): {"speed": F.col("l_quantity") * k, "strength": F.col(v) * -100.0}
              for col, v in (("up", "l_tax"), ("down", "l_discount")) for k in (1, 2)}
    d = cu.tidy_cells(li, ["l_orderkey", "l_partkey", "l_shipdate", "l_suppkey"], blocks)
    return d.groupBy("l_suppkey", "column", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.sum("speed").alias("speed"), F.round(F.sum("strength"), 4).alias("strength"))


def a4_cell_counts(spark, path):
    return cu.cell_counts(cells(spark, path), ["site"])


add("a4_tidy_cells", a4_tidy_cells, """WITH u AS (SELECT l_suppkey, 'up' AS "column", k AS cell, l_quantity * k AS speed, l_tax * -100.0 AS s FROM lineitem, (VALUES (1), (2)) v(k)
UNION ALL SELECT l_suppkey, 'down', k, l_quantity * k, l_discount * -100.0 FROM lineitem, (VALUES (1), (2)) v(k))
SELECT l_suppkey, "column", CAST(cell AS INTEGER) AS cell, count(*) AS n, sum(speed) AS speed, round(sum(s), 4) AS strength FROM u GROUP BY 1, 2, 3""")
add("a4_cell_counts", a4_cell_counts, f"""WITH {CELLS}, p AS (SELECT site, ts, count(*) AS k FROM cells GROUP BY 1, 2)
SELECT site, count(*) AS records, max(k) AS cells FROM p GROUP BY 1""")


def b16_available_depths(spark, path):
    return cu.available_depths(flagged(spark, path), ["site"], "depth", _CURRENT)


add("b16_available_depths", b16_available_depths, f"""WITH {FLAGGED} SELECT DISTINCT site, depth FROM fl
WHERE fc <> 4 AND depth IS NOT NULL AND speed IS NOT NULL AND direction IS NOT NULL AND east IS NOT NULL AND north IS NOT NULL""")


def g12_mean_speed(spark, path):
    d = cu.mean_speed_by_depth(flagged(spark, path), "site", "depth", "speed")
    return d.select("site", "depth", F.round("mean_speed", 6).alias("mean_speed"))


add("g12_mean_speed", g12_mean_speed, f"""WITH {FLAGGED}, m AS (SELECT site, depth, avg(speed) AS ms FROM fl WHERE fc <> 4 AND speed IS NOT NULL GROUP BY 1, 2),
k AS (SELECT *, count(*) OVER (PARTITION BY site) AS nd FROM m), s AS (SELECT * FROM k WHERE nd >= 2)
SELECT site, depth, round(ms, 6) AS mean_speed FROM s WHERE (SELECT count(DISTINCT site) FROM s) >= 2""")


def g13_heat_map(spark, path):
    d = cu.heat_map(flagged(spark, path), ["site"], "depth", "ts", {"speed": "speed", "direction": "direction"})
    return d.select("site", "depth", "ts", F.round("speed", 6).alias("speed"), F.round("direction", 5).alias("direction"))


add("g13_heat_map", g13_heat_map, f"""WITH {FLAGGED} SELECT site, depth, ts, round(avg(speed), 6) AS speed, round(avg(direction), 5) AS direction
FROM fl WHERE fc <> 4 GROUP BY 1, 2, 3""")


def g15_speed_scale(spark, path):
    d = cu.speed_scale(flagged(spark, path), ["site"], "speed")
    return d.select("site", F.round("speed_max", 6).alias("speed_max"))


add("g15_speed_scale", g15_speed_scale, f"WITH {FLAGGED} SELECT site, round(max(speed) * 1.05, 6) AS speed_max FROM fl WHERE fc <> 4 GROUP BY 1")


def q20_tilt_report(spark, path):
    rec = cu.tilt_records(cells(spark, path), ["site", "ts"], "tilt")
    return cu.tilt_report(rec, "site", "ts")


add("q20_tilt_report", q20_tilt_report, f"""WITH {CELLS}, r AS (SELECT site, ts, max(tilt) AS tilt FROM cells GROUP BY 1, 2),
o AS (SELECT *, coalesce(tilt >= 45, false) AS ov, coalesce(lag(tilt >= 45) OVER (PARTITION BY site ORDER BY ts), false) AS pv FROM r)
SELECT site, count(*) AS records, count(*) FILTER (tilt > 15 AND tilt <= 35) AS suspect, count(*) FILTER (tilt > 35) AS bad,
count(*) FILTER (ov) AS lying, count(*) FILTER (ov AND NOT pv) AS lying_spans FROM o GROUP BY 1""")


def q27_spread_depths(spark, path):
    return cu.spread_depths(flagged(spark, path), "site", "depth")


_SEL = """ds AS (SELECT site, depth, row_number() OVER (PARTITION BY site ORDER BY depth) - 1 AS i, count(*) OVER (PARTITION BY site) AS n
  FROM (SELECT DISTINCT site, depth FROM {0}) d),
sel AS (SELECT site, depth FROM ds WHERE n <= 4 OR i IN (0, round_even((n - 1) * 1 / 3.0, 0), round_even((n - 1) * 2 / 3.0, 0), n - 1))"""
add("q27_spread_depths", q27_spread_depths, f"WITH {FLAGGED}, {_SEL.format('fl')} SELECT site, depth FROM sel")


def _vectors(spark, path):
    """Surviving cells with a vector, at the drawn depths."""
    ok = flagged(spark, path).where((F.col("Flag_cur") != 4) & F.col("east").isNotNull() & F.col("north").isNotNull())
    return ok.join(cu.spread_depths(ok, "site", "depth"), ["site", "depth"], "left_semi")


_VEC = FLAGGED + """, ok AS (SELECT * FROM fl WHERE fc <> 4 AND east IS NOT NULL AND north IS NOT NULL), """ + _SEL.format("ok") + """,
vec AS (SELECT ok.* FROM ok JOIN sel USING (site, depth))"""


def q27_decimation(spark, path):
    d = cu.decimated(_vectors(spark, path), "site", "depth", ["ts", "record", "part", "east", "north", "direction", "stdev", "strength"])
    return d.select("site", "depth", "ts", "record", "part", "east", "north")


add("q27_decimation", q27_decimation, f"""WITH {_VEC},
r AS (SELECT *, row_number() OVER (PARTITION BY site, depth ORDER BY ts, record, part, east, north, direction, stdev, strength) - 1 AS i,
  count(*) OVER (PARTITION BY site, depth) AS n FROM vec),
k AS (SELECT *, max(n) OVER (PARTITION BY site) AS mx FROM r)
SELECT site, depth, ts, record, part, east, north FROM k WHERE i % greatest(CAST(ceil(mx / 60.0) AS BIGINT), 1) = 0""")


def q28_broken_lines(spark, path):
    v = _vectors(spark, path)
    depths = v.select("site", "depth").distinct()
    return cu.broken_lines(v, cells(spark, path), "site", "ts", depths, ["east", "north"])


def q28_connected_lines(spark, path):
    return _vectors(spark, path).select("site", "depth", "ts", "east", "north")


add("q28_broken_lines", q28_broken_lines, f"""WITH {_VEC}, t AS (SELECT DISTINCT site, ts FROM cells), d AS (SELECT DISTINCT site, depth FROM vec),
f AS (SELECT site, depth, ts, min((east, north)) AS m FROM vec GROUP BY 1, 2, 3)
SELECT t.site, d.depth, t.ts, struct_extract_at(m, 1) AS east, struct_extract_at(m, 2) AS north FROM t JOIN d USING (site) LEFT JOIN f ON f.site = t.site AND f.depth = d.depth AND f.ts = t.ts""")
add("q28_connected_lines", q28_connected_lines, f"WITH {_VEC} SELECT site, depth, ts, east, north FROM vec")


def q19_transits(spark, path):
    """Users' pressure as depth; stamps drawn together so that two minutes hold
    several samples."""
    s = ordered(water_series(spark, path), "series_id", ["ts", "sample_no"]).scan(pos=Position()).rows
    s = s.withColumn("ts", F.timestamp_add("SECOND", (F.col("pos") * 50 + F.when(F.col("pos") % 7 == 6, 400).otherwise(0)).cast("int"),
                                           F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))
    s = s.withColumn("depth", F.when(F.col("P") > 20, F.col("P")).otherwise(F.lit(20.0)))
    s = s.withColumn("ts", F.timestamp_add("SECOND", (F.floor(F.col("pos") / 7) * 450).cast("int"), F.col("ts")))
    return cu.transit_windows(s, "series_id", ["ts", "pos"], "depth", rate=60.0)


add("q19_transits", q19_transits, f"""WITH {WATER},
p0 AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ts, sample_no) - 1 AS pos, CASE WHEN "P" > 20 THEN "P" ELSE 20.0 END AS z FROM water),
p AS (SELECT *, pos * 50 + CASE WHEN pos % 7 = 6 THEN 400 ELSE 0 END + (pos // 7) * 450 AS s FROM p0),
n AS (SELECT *, count(*) OVER (PARTITION BY series_id) - 1 AS last FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY s, pos) - 1 AS k FROM n),
f AS (SELECT *, max(k) OVER (PARTITION BY series_id ORDER BY s RANGE BETWEEN CURRENT ROW AND 120 FOLLOWING) AS far FROM o),
g AS (SELECT *, least(greatest(far, k + 1), last) AS pk FROM f),
j AS (SELECT g.*, q.s AS ps, q.z AS pz FROM g JOIN o q ON q.series_id = g.series_id AND q.k = g.pk),
h AS (SELECT *, k < last AND (ps - s) > 0 AND abs(pz - z) >= 60.0 * ((ps - s) / 60.0) AS fast FROM j),
r AS (SELECT *, fast AND NOT coalesce(lag(fast) OVER w, false) AS op, NOT fast AND coalesce(lag(fast) OVER w, false) AS cl FROM h WINDOW w AS (PARTITION BY series_id ORDER BY k)),
u AS (SELECT *, sum(op::INT) OVER (PARTITION BY series_id ORDER BY k) AS run FROM r),
w1 AS (SELECT series_id, run, min(k) FILTER (op) AS i0, min(s) FILTER (op) AS s0, min(least(greatest(k, pk), last)) FILTER (cl) AS i1 FROM u WHERE run > 0 GROUP BY 1, 2),
w2 AS (SELECT w1.*, o.s AS s1 FROM w1 JOIN o ON o.series_id = w1.series_id AND o.k = w1.i1),
w3 AS (SELECT *, coalesce(s0 - lag(s1) OVER (PARTITION BY series_id ORDER BY run) > 120, true) AS nw FROM w2),
w4 AS (SELECT *, sum(nw::INT) OVER (PARTITION BY series_id ORDER BY run) AS win FROM w3),
w5 AS (SELECT series_id, win, min(i0) AS a, arg_max(i1, run) AS b FROM w4 GROUP BY 1, 2)
SELECT w5.series_id, a AS first_pos, b AS last_pos, max(z) - min(z) AS depth_range FROM w5 JOIN o ON o.series_id = w5.series_id AND o.k BETWEEN a AND b
GROUP BY w5.series_id, win, a, b HAVING max(z) - min(z) >= 0.3""")


def p7_current_set(spark, path):
    """Heat map, lines and arrows of a site in one long table."""
    d = depth_band(time_window(flagged(spark, path), "1996-01-01 00:00:00", "2000-12-31 00:00:00"), 2.0, 12.0, "depth")
    heat = cu.heat_map(d, ["site"], "depth", "ts", {"a": "speed", "b": "direction"}).withColumn("panel", F.lit("heat"))
    ok = d.where((F.col("Flag_cur") != 4) & F.col("east").isNotNull() & F.col("north").isNotNull())
    v = ok.join(cu.spread_depths(ok, "site", "depth"), ["site", "depth"], "left_semi")
    lines = cu.broken_lines(v, d, "site", "ts", v.select("site", "depth").distinct(), ["east", "north"]) \
        .select("site", "depth", "ts", F.col("east").alias("a"), F.col("north").alias("b"), F.lit("lines").alias("panel"))
    arrows = cu.decimated(v, "site", "depth", ["ts", "record", "part", "east", "north", "direction", "stdev", "strength"]) \
        .select("site", "depth", "ts", F.col("east").alias("a"), F.col("north").alias("b"), F.lit("arrows").alias("panel"))
    both = heat.select("site", "depth", "ts", "a", "b", "panel").unionByName(lines).unionByName(arrows)
    return both.groupBy("panel", "site", "depth").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("a"), 4).alias("a"), F.round(F.sum("b"), 3).alias("b"))


_P7 = FLAGGED + """, w AS (SELECT * FROM fl WHERE ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-12-31' AND depth BETWEEN 2 AND 12),
ok AS (SELECT * FROM w WHERE fc <> 4 AND east IS NOT NULL AND north IS NOT NULL), """ + _SEL.format("ok") + """,
vec AS (SELECT ok.* FROM ok JOIN sel USING (site, depth)), t AS (SELECT DISTINCT site, ts FROM w), dd AS (SELECT DISTINCT site, depth FROM vec),
f AS (SELECT site, depth, ts, min((east, north)) AS m FROM vec GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY site, depth ORDER BY ts, record, part, east, north, direction, stdev, strength) - 1 AS i,
  count(*) OVER (PARTITION BY site, depth) AS n FROM vec), k AS (SELECT *, max(n) OVER (PARTITION BY site) AS mx FROM r),
al AS (SELECT 'heat' AS panel, site, depth, ts, avg(speed) AS a, avg(direction) AS b FROM w WHERE fc <> 4 GROUP BY 1, 2, 3, 4
UNION ALL SELECT 'lines', t.site, dd.depth, t.ts, struct_extract_at(m, 1), struct_extract_at(m, 2) FROM t JOIN dd USING (site) LEFT JOIN f ON f.site = t.site AND f.depth = dd.depth AND f.ts = t.ts
UNION ALL SELECT 'arrows', site, depth, ts, east, north FROM k WHERE i % greatest(CAST(ceil(mx / 60.0) AS BIGINT), 1) = 0)"""
add("p7_current_set", p7_current_set, f"WITH {_P7} SELECT panel, site, depth, count(*) AS n, round(sum(a), 4) AS a, round(sum(b), 3) AS b FROM al GROUP BY 1, 2, 3")
