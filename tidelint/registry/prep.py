"""Queries for preprocessing, filters and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelint.functions import labels, seawater
from tidelint.operators import preprocess as pp
from tidelint.operators import selection as sel
from tidelint.operators.ordering import Next, Position, ordered
from tidelint.operators.reports import unpivot
from tidelint.plans import layouts
from tidelint.plans.criteria import Criteria
from tidelint.plans.test_plan import Test, run_plan
from tidelint.plans.criteria import REGIONS
from tidelint.plans.qualify import places_of
from tidelint.registry.base import CELLS, EV, WATER, cells, scalar_series, table, water_series
from tidelint.sources import stamps

KEYS = ["series_id"]
BY = ["ts", "sample_no"]
QUERIES, SQL = {}, {}


def add(name, fn, sql):
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


def b1_units(spark, path):
    w = water_series(spark, path)
    k = F.substring("series_id", 2, 20).cast("long") % 3
    return w.select("series_id", "sample_no",
                    pp.to_dbar(F.col("P"), F.when(k == 0, "kPa").when(k == 1, "bar").otherwise("dbar")).alias("pressure"),
                    pp.to_ms_cm(F.col("C"), F.when(k == 0, "S/m").otherwise("mS/cm")).alias("conductivity"))


add("b1_units", b1_units, f"""WITH {WATER}, k AS (SELECT *, CAST(substr(series_id, 2) AS BIGINT) % 3 AS k FROM water)
SELECT series_id, sample_no, CASE k WHEN 0 THEN "P" / 10 WHEN 1 THEN "P" * 10 ELSE "P" END AS pressure,
CASE k WHEN 0 THEN "C" * 10 ELSE "C" END AS conductivity FROM k""")


def b2_depth(spark, path):
    return water_series(spark, path).select(
        "series_id", "sample_no", seawater.depth_from_pressure(F.col("P"), -17.5).alias("depth"))


add("b2_depth", b2_depth, f"""WITH {WATER}, q AS (SELECT *, "P" - 10.1325 AS q, pow(sin(-17.5 / 57.29578), 2) AS x FROM water),
g AS (SELECT *, 9.780318 * (1.0 + (5.2788e-3 + 2.36e-5 * x) * x) + 1.092e-6 * q AS g FROM q)
SELECT series_id, sample_no, round_even((((((-1.82e-15 * q + 2.279e-10) * q - 2.2512e-5) * q + 9.72659) * q) / g) * 100, 0) / 100 AS depth FROM g""")


def site_places(sites):
    """The region of each site, by its number, and with it its latitude."""
    names = F.array(*[F.lit(name) for name, _lat, _lon in REGIONS])
    return places_of(sites.select("site", F.element_at(names, (F.substring("site", 2, 9).cast("int") % len(REGIONS)) + 1).alias("region")), "site")


def b2_depth_by_site(spark, path):
    w = water_series(spark, path)
    w = w.join(site_places(w.select("site").distinct()), "site")
    return w.select("series_id", "sample_no", seawater.depth_from_pressure(F.col("P"), F.col("latitude")).alias("depth"))


add("b2_depth_by_site", b2_depth_by_site, f"""WITH {WATER}, q AS (SELECT *, "P" - 10.1325 AS q,
pow(sin([-1.0, -4.5, -8.5, -17.5, -23.5, -30.0][CAST(substr(site, 2) AS INTEGER) % 6 + 1]::DOUBLE / 57.29578), 2) AS x FROM water),
g AS (SELECT *, 9.780318 * (1.0 + (5.2788e-3 + 2.36e-5 * x) * x) + 1.092e-6 * q AS g FROM q)
SELECT series_id, sample_no, round_even((((((-1.82e-15 * q + 2.279e-10) * q - 2.2512e-5) * q + 9.72659) * q) / g) * 100, 0) / 100 AS depth FROM g""")

_RULES = {"Chlorophyll (ug/L)": "chl", "PAR (umol/m2/s)": "par", "Temperature (degC)": "t"}


def _noisy(spark, path):
    """Values shifted so that some are small and some grossly negative."""
    s = scalar_series(spark, path)
    return s.select("series_id", "sample_no", (F.col("v") / 8 - 3).alias("Chlorophyll (ug/L)"),
                    (F.col("v") - 20).alias("PAR (umol/m2/s)"), (F.col("v") / 10 - 2).alias("Temperature (degC)"))


def _rules():
    env = Criteria().environment
    return {n: pp.zero_rule(n, env) for n in _RULES}


def b3_below_zero(spark, path):
    d = pp.clean_below_zero(_noisy(spark, path), _rules())
    return d.select("series_id", "sample_no", *[F.col(f"`{n}`").alias(a) for n, a in _RULES.items()])


def b3_below_zero_report(spark, path):
    return pp.below_zero_report(_noisy(spark, path), _rules(), ["series_id"])


_NOISY = f"""{EV}, nz AS (SELECT series_id, sample_no, v / 8 - 3 AS chl, v - 20 AS par, v / 10 - 2 AS t FROM ev)"""
add("b3_below_zero", b3_below_zero, f"""WITH {_NOISY} SELECT series_id, sample_no,
CASE WHEN chl < -1.5 THEN NULL WHEN chl < 0 THEN 0.0 ELSE chl END AS chl,
CASE WHEN par < 0 THEN 0.0 ELSE par END AS par, CASE WHEN t <= 0 THEN NULL ELSE t END AS t FROM nz""")
add("b3_below_zero_report", b3_below_zero_report, f"""WITH {_NOISY},
u AS (SELECT series_id, 'Chlorophyll (ug/L)' AS var, count(*) FILTER (chl < 0 AND chl >= -1.5) AS clamped,
  count(*) FILTER (chl < -1.5) AS discarded FROM nz GROUP BY 1 UNION ALL
SELECT series_id, 'PAR (umol/m2/s)', count(*) FILTER (par < 0), 0 FROM nz GROUP BY 1 UNION ALL
SELECT series_id, 'Temperature (degC)', 0, count(*) FILTER (t <= 0) FROM nz GROUP BY 1)
SELECT * FROM u WHERE clamped > 0 OR discarded > 0""")


def b4_clock_shift(spark, path):
    return pp.shift_hours(scalar_series(spark, path), -3).select("series_id", "sample_no", "ts")


add("b4_clock_shift", b4_clock_shift, f"WITH {EV} SELECT series_id, sample_no, ts - INTERVAL 3 HOUR AS ts FROM ev")


def b5_secondary_temperature(spark, path):
    s = water_series(spark, path).withColumnsRenamed({"T": "Temperature (degC)"})
    s = s.withColumns({"Internal Temperature": F.col("C"), "Temperature #2": F.col("S")})
    kept = pp.drop_secondary_temperatures(s)
    return kept.select("series_id", "sample_no", F.col("`Temperature (degC)`").alias("temperature"),
                       F.lit(len(kept.columns)).alias("n_columns"))


add("b5_secondary_temperature", b5_secondary_temperature,
    f'WITH {WATER} SELECT series_id, sample_no, "T" AS temperature, 8::INTEGER AS n_columns FROM water')


def b6_surface_cut(spark, path):
    s = water_series(spark, path).withColumn("Depth (m)", F.col("P") / 10)
    s = pp.surface_cut(s, "Depth (m)", ["T", "S", "C", "P", "Depth (m)"])
    return s.select("series_id", "sample_no", "T", "S", F.col("`Depth (m)`").alias("depth"))


add("b6_surface_cut", b6_surface_cut, f"""WITH {WATER}, d AS (SELECT *, "P" / 10 AS depth FROM water)
SELECT series_id, sample_no, CASE WHEN depth < 0.5 THEN NULL ELSE "T" END AS "T",
CASE WHEN depth < 0.5 THEN NULL ELSE "S" END AS "S", CASE WHEN depth < 0.5 THEN NULL ELSE depth END AS depth FROM d""")


def b7_dismissals(spark, path):
    """Errors dismiss the whole row, clicks the temperature, of the same sample."""
    w = water_series(spark, path).withColumns({
        "Flag_T": F.lit(1), "Flag_S": F.lit(1), "Flag_dens": F.lit(1)})
    e = scalar_series(spark, path)
    cuts = e.where(F.col("event_type").isin("error", "click")).select(
        "series_id", "sample_no", F.when(F.col("event_type") == "click", "T").alias("variable"))
    out = pp.dismiss(w, cuts, ["series_id", "sample_no"], {"T": "T", "S": "S"},
                     {"Flag_T": ("T",), "Flag_S": ("S",), "Flag_dens": ("T", "S")})
    return out.select("series_id", "sample_no", "T", "S", "Flag_T", "Flag_S", "Flag_dens")


add("b7_dismissals", b7_dismissals, f"""WITH {WATER}, e AS (SELECT sample_no, event_type FROM ev)
SELECT series_id, sample_no, CASE WHEN event_type IN ('error', 'click') THEN NULL ELSE "T" END AS "T",
CASE WHEN event_type = 'error' THEN NULL ELSE "S" END AS "S",
CAST(CASE WHEN event_type IN ('error', 'click') THEN 5 ELSE 1 END AS INTEGER) AS "Flag_T",
CAST(CASE WHEN event_type = 'error' THEN 5 ELSE 1 END AS INTEGER) AS "Flag_S",
CAST(CASE WHEN event_type IN ('error', 'click') THEN 5 ELSE 1 END AS INTEGER) AS "Flag_dens" FROM water JOIN e USING (sample_no)""")


def b7_cell_dismissals(spark, path):
    """Records of returned parts are cut whole; cells of part 7 mod 11 alone."""
    d = cells(spark, path).withColumn("Flag_cur", F.lit(1))
    cuts = d.where(F.col("part") % 97 == 0).select("record", F.lit(None).cast("int").alias("cell")).unionByName(
        d.where(F.col("part") % 11 == 7).select("record", "cell"))
    out = pp.dismiss_cells(d, cuts, ["record"], "cell", ["speed", "strength"], ["tilt"], ["Flag_cur"])
    return out.select("record", "cell", "part", "speed", "strength", "tilt", "Flag_cur", "ts")


add("b7_cell_dismissals", b7_cell_dismissals, f"""WITH {CELLS},
r AS (SELECT DISTINCT record, 1 AS rec FROM cells WHERE part % 97 = 0),
k AS (SELECT DISTINCT record, cell, 1 AS cut FROM cells WHERE part % 11 = 7)
SELECT record, cell, part, CASE WHEN rec IS NULL AND cut IS NULL THEN speed END AS speed,
CASE WHEN rec IS NULL AND cut IS NULL THEN strength END AS strength, CASE WHEN rec IS NULL THEN tilt END AS tilt,
CAST(CASE WHEN rec IS NULL AND cut IS NULL THEN 1 ELSE 5 END AS INTEGER) AS "Flag_cur", ts
FROM cells LEFT JOIN r USING (record) LEFT JOIN k USING (record, cell)""")


def b8_switches(spark, path):
    plan = [Test("T", "sensor"), Test("S", "sensor"), Test("PAR", "sensor"), Test("S", "spike"), Test("P", "flat")]
    off = Criteria().with_off("temperature sensor range", "salinity spikes", "PAR sensor range")
    out = run_plan(water_series(spark, path), plan, {"T": "T", "S": "S", "P": "P"}, KEYS, BY, criteria=off)
    return out.select("series_id", "sample_no", "f_sensor_T", "f_sensor_S", "f_sensor_PAR", "f_spike_S", "f_flat_P")


add("b8_switches", b8_switches, f"""WITH {WATER} SELECT series_id, sample_no, 5::INTEGER AS "f_sensor_T",
CAST(CASE WHEN "S" IS NULL THEN 9 WHEN "S" NOT BETWEEN 0 AND 45 THEN 4 ELSE 1 END AS INTEGER) AS "f_sensor_S",
2::INTEGER AS "f_sensor_PAR", 5::INTEGER AS "f_spike_S", 5::INTEGER AS "f_flat_P" FROM water""")


def b9_time_window(spark, path):
    s = sel.select_rows(scalar_series(spark, path), ["S0", "S2", "S3"], [2023, 2024])
    return sel.time_window(s, "2024-01-08 06:00:00", "2024-01-21 18:00:00").select("series_id", "sample_no", "ts", "v")


add("b9_time_window", b9_time_window, f"""WITH {EV} SELECT series_id, sample_no, ts, v FROM ev
WHERE site IN ('S0', 'S2', 'S3') AND year(ts) IN (2023, 2024)
AND ts BETWEEN TIMESTAMP '2024-01-08 06:00:00' AND TIMESTAMP '2024-01-21 18:00:00'""")


def b10_depth_band(spark, path):
    return sel.depth_band(cells(spark, path), 4.0, 10.0, "depth").groupBy("site", "depth").agg(
        F.count(F.lit(1)).alias("n"))


add("b10_depth_band", b10_depth_band,
    f"WITH {CELLS} SELECT site, depth, count(*) AS n FROM cells WHERE depth BETWEEN 4 AND 10 GROUP BY 1, 2")


def b11_semester(spark, path):
    return cells(spark, path).groupBy("site", F.year("ts").alias("year"), sel.semester(F.col("ts")).alias("semester")) \
        .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


add("b11_semester", b11_semester, f"""WITH {CELLS} SELECT site, CAST(year(ts) AS INTEGER) AS year,
CAST(CASE WHEN month(ts) <= 6 THEN 1 ELSE 2 END AS INTEGER) AS semester, count(*) AS n, min(ts) AS first, max(ts) AS last
FROM cells GROUP BY 1, 2, 3""")

_WORDS = list(labels.MONTH_WORDS)


def b12_semester_tag(spark, path):
    o = table(spark, path, "orders")
    word = F.element_at(F.array(*[F.lit(w) for w in [*_WORDS, "SEMANA"]]), (F.col("o_orderkey") % 25 + 1).cast("int"))
    o = o.select("o_orderkey", F.concat(F.lit("CAMP "), (F.col("o_custkey") % 30).cast("string"), F.lit("a "), F.lower(word),
                                        F.lit(" "), F.year("o_orderdate").cast("string")).alias("label"))
    return o.select("o_orderkey", labels.semester_tag(F.col("label")).alias("tag"),
                    labels.campaign_date(F.col("label")).cast("string").alias("campaign"))


_ORD_LABEL = f"""lb AS (SELECT o_orderkey, o_orderdate, o_custkey, [{', '.join(repr(w) for w in [*_WORDS, 'SEMANA'])}][o_orderkey % 25 + 1] AS word,
  [{', '.join(str(labels.MONTH_WORDS.get(w, 'NULL')) for w in [*_WORDS, 'SEMANA'])}][o_orderkey % 25 + 1] AS mon FROM orders)"""
add("b12_semester_tag", b12_semester_tag, f"""WITH {_ORD_LABEL} SELECT o_orderkey,
year(o_orderdate) || CASE WHEN mon <= 6 THEN 'S1' WHEN mon > 6 THEN 'S2' END AS tag,
CASE WHEN mon IS NOT NULL THEN CAST(make_date(year(o_orderdate), mon, 1) AS VARCHAR) END AS campaign FROM lb""")


def b13_first_midnight(spark, path):
    s = sel.first_midnight_hours(scalar_series(spark, path), ["site"])
    anchor = s.agg(F.min("ts").alias("first"))
    s = sel.clock_window(s, anchor, "2024-01-02 06:00:00", "2024-01-12 18:00:00")
    return s.select("site", "sample_no", F.round("hours", 6).alias("hours"))


add("b13_first_midnight", b13_first_midnight, f"""WITH {EV},
h AS (SELECT *, (epoch_us(ts) - epoch_us(date_trunc('day', min(ts) OVER (PARTITION BY site)))) / 3.6e9 AS hours,
  date_trunc('day', min(ts) OVER ()) AS anchor FROM ev)
SELECT site, sample_no, round(hours, 6) AS hours FROM h
WHERE hours BETWEEN (epoch_us(TIMESTAMP '2024-01-02 06:00:00') - epoch_us(anchor)) / 3.6e9
AND (epoch_us(TIMESTAMP '2024-01-12 18:00:00') - epoch_us(anchor)) / 3.6e9""")


def _qualified(spark, path):
    w = water_series(spark, path)
    return w.select(F.col("sample_no").alias("Sample number"), F.col("ts").alias("Datetime"), F.col("site").alias("Site"),
                    (F.col("T") / 3).alias("Temperature (degC)"), (F.col("S") / 7).alias("Salinity (PSU)"),
                    F.col("C").alias("Chlorophyll (ug/L)"), (F.col("P") / 11).alias("O2 level (uM)"),
                    (F.col("C") * 9).alias("CO2 Level (ppm)"), F.col("P").alias("Pitch[Deg]"),
                    (F.col("sample_no") % 5).cast("int").alias("Flag_T"), (F.col("sample_no") % 3 + 2).cast("int").alias("Flag_O2"),
                    (F.col("sample_no") % 4 + 1).cast("int").alias("Flag_CO2"), F.lit("11").alias("Flag"))


_QUAL = WATER + """, ql AS (SELECT sample_no, ts, site, "T" / 3 AS t, "S" / 7 AS s, "C" AS chl, "P" / 11 AS o2, "C" * 9 AS co2,
  sample_no % 5 AS ft, sample_no % 3 + 2 AS fo, sample_no % 4 + 1 AS fc FROM water)"""


def _flat(df):
    return df.toDF(*[n.split(" (")[0].replace(" ", "_").lower() for n in df.columns])


def b14_layout(spark, path):
    return _flat(layouts.ordered_layout(_qualified(spark, path), layouts.SCALAR_LAYOUT)).drop(
        "depth", "battery_voltage", "ph", "density", "tss", "turbidity", "luminosity")


add("b14_layout", b14_layout, f"""WITH {_QUAL} SELECT sample_no AS sample_number, ts AS datetime, site,
round_even(t * 10000, 0) / 10000 AS temperature, round_even(s * 10000, 0) / 10000 AS salinity, NULL::DOUBLE AS conductivity, NULL::DOUBLE AS pressure,
round_even(co2 * 10000, 0) / 10000 AS co2_level, round_even(o2 * 10000, 0) / 10000 AS o2_level, NULL::DOUBLE AS o2_content, NULL::DOUBLE AS par,
round_even(chl * 10000, 0) / 10000 AS chlorophyll, NULL::DOUBLE AS dissolved_organic_matter, NULL::DOUBLE AS soundspeed, '11' AS flag,
CAST(ft AS INTEGER) AS flag_t, CAST(fo AS INTEGER) AS flag_o2, CAST(fc AS INTEGER) AS flag_co2 FROM ql""")


def b15_removal(spark, path):
    out = layouts.remove_flagged(_qualified(spark, path), layouts.FLAG_OF, bad=True, suspect=True)
    return _flat(out).select("sample_number", "temperature", "o2_level", "co2_level", "chlorophyll")


add("b15_removal", b15_removal, f"""WITH {_QUAL} SELECT sample_no AS sample_number,
CASE WHEN ft NOT IN (3, 4) THEN t END AS temperature, CASE WHEN fo NOT IN (3, 4) THEN o2 END AS o2_level,
CASE WHEN fc NOT IN (3, 4) THEN co2 END AS co2_level, chl AS chlorophyll FROM ql""")


def b17_coverage(spark, path):
    c = sel.coverage(scalar_series(spark, path), keys=["site"])
    req = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-30 22:00:00").cast("timestamp_ntz")
    return c.withColumn("window_ok", sel.valid_window(*req, F.col("available_from"), F.col("available_to")))


add("b17_coverage", b17_coverage, f"""WITH {EV}, a AS (SELECT site, min(ts) AS first, max(ts) AS last FROM ev GROUP BY 1),
b AS (SELECT *, CAST(date_trunc('minute', first) AS TIMESTAMP) AS available_from, CAST(CASE WHEN date_trunc('minute', last) < last
  THEN date_trunc('minute', last) + INTERVAL 1 MINUTE ELSE last END AS TIMESTAMP) AS available_to FROM a)
SELECT *, TIMESTAMP '2024-01-02' >= available_from AND TIMESTAMP '2024-01-30 22:00:00' <= available_to AS window_ok FROM b""")


def b18_lost_decimal(spark, path):
    """A third of the users lost their separator, a third carries decimals out of range."""
    s = scalar_series(spark, path)
    k = F.substring("series_id", 2, 20).cast("long") % 3
    s = s.withColumn("t", F.when(k == 0, F.floor(F.col("v") / 10 * 1000).cast("double"))
                     .when(k == 1, F.floor(F.col("v") * 1000) + 100.5).otherwise(F.col("v") / 10))
    return pp.fix_scale(s, KEYS, "t", "fixed").select("series_id", "sample_no", F.round("fixed", 6).alias("fixed"), "scale_note")


add("b18_lost_decimal", b18_lost_decimal, f"""WITH {EV},
k AS (SELECT *, CASE CAST(substr(series_id, 2) AS BIGINT) % 3 WHEN 0 THEN floor(v / 10 * 1000)
  WHEN 1 THEN floor(v * 1000) + 100.5 ELSE v / 10 END AS t FROM ev),
g AS (SELECT series_id, count(t) AS n, count(*) FILTER (t BETWEEN -5 AND 60) AS i, count(*) FILTER (t <> round(t)) AS fr,
  count(*) FILTER (t / 10 BETWEEN -5 AND 60) AS f1, count(*) FILTER (t / 100 BETWEEN -5 AND 60) AS f2,
  count(*) FILTER (t / 1000 BETWEEN -5 AND 60) AS f3 FROM k GROUP BY 1),
f AS (SELECT *, CASE WHEN n >= 10 AND i <= 0.02 * n AND fr <= 0.02 * n THEN
  CASE WHEN f1 > 0.98 * n THEN 10 WHEN f2 > 0.98 * n THEN 100 WHEN f3 > 0.98 * n THEN 1000 ELSE 1 END ELSE 1 END AS factor FROM g)
SELECT series_id, sample_no, round(t / factor, 6) AS fixed,
CASE WHEN NOT (n >= 10 AND i <= 0.02 * n) THEN NULL WHEN fr > 0.02 * n THEN 'carries decimals'
  WHEN factor > 1 THEN 'rescaled' ELSE 'no factor' END AS scale_note FROM k JOIN f USING (series_id)""")


def b19_date_order(spark, path):
    """Each user's stamps as text: day-first, month-first or a wordy clock, one
    file per half month."""
    s = scalar_series(spark, path)
    k = F.substring("series_id", 2, 20).cast("long") % 3
    s = s.withColumn("file", F.concat("series_id", F.when(F.dayofmonth("ts") <= 12, "a").otherwise("b")))
    text = (F.when(k == 0, F.date_format("ts", "dd/MM/yy HH:mm:ss")).when(k == 1, F.date_format("ts", "MM/dd/yyyy HH:mm:ss"))
            .otherwise(F.concat(F.date_format("ts", "dd/MM/yy H"), F.lit("h"), F.minute("ts").cast("string"), F.lit("min"),
                                F.second("ts").cast("string"), F.lit("s"))))
    s = stamps.parse_stamps(s.withColumn("text", text), ["file"], "text", "parsed")
    return s.select("file", "sample_no", "parsed", "order_note")


add("b19_date_order", b19_date_order, f"""WITH {EV}, k AS (SELECT *, CAST(substr(series_id, 2) AS BIGINT) % 3 AS k,
  series_id || CASE WHEN day(ts) <= 12 THEN 'a' ELSE 'b' END AS file, date_trunc('second', ts) AS s FROM ev)
SELECT file, sample_no, CAST(CASE WHEN k = 1 AND day(ts) <= 12
  THEN make_timestamp(year(s), day(s), month(s), hour(s), minute(s), second(s)) ELSE s END AS TIMESTAMP) AS parsed,
CASE WHEN day(ts) <= 12 THEN 'day-first assumed' WHEN k = 1 THEN 'month-first' ELSE 'day-first' END AS order_note FROM k""")


def b20_deployment_window(spark, path):
    """Signups detach the logger, purchases end the deployment."""
    s = scalar_series(spark, path)
    s = s.withColumns({"detached": F.when(F.col("event_type") == "signup", "Logged"),
                       "ended": F.when((F.col("event_type") == "purchase") & (F.dayofmonth("ts") > 18), "Logged")})
    return pp.deployment_window(s, KEYS, "ts", "v", ["detached"], ["ended"], ["detached", "ended"]).select("series_id", "sample_no")


add("b20_deployment_window", b20_deployment_window, f"""WITH {EV},
e AS (SELECT *, event_type = 'signup' AS de, event_type = 'purchase' AND day(ts) > 18 AS en FROM ev),
s AS (SELECT *, min(CASE WHEN de THEN ts END) OVER (PARTITION BY series_id) AS st FROM e),
t AS (SELECT *, min(CASE WHEN en AND (st IS NULL OR ts > st) THEN ts END) OVER (PARTITION BY series_id) AS et FROM s),
w AS (SELECT *, (st IS NULL OR ts >= st) AND (et IS NULL OR ts < et) AS ins FROM t),
c AS (SELECT *, count(v) OVER (PARTITION BY series_id) AS m, count(CASE WHEN ins THEN v END) OVER (PARTITION BY series_id) AS kp FROM w)
SELECT series_id, sample_no FROM c WHERE (ins OR (m > 0 AND kp < 0.5 * m)) AND NOT ((de OR en) AND v IS NULL)""")


def b21_edge_trim(spark, path):
    s = scalar_series(spark, path).withColumn("temp", F.col("v") / 40 + 20)
    return pp.trim_edges(s, KEYS, BY, "temp").select("series_id", "sample_no")


add("b21_edge_trim", b21_edge_trim, f"""WITH {EV},
p AS (SELECT *, v / 40 + 20 AS temp, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n,
  epoch_us(ts) - lag(epoch_us(ts)) OVER w AS step FROM ev WINDOW w AS (PARTITION BY series_id ORDER BY ts, sample_no)),
d AS (SELECT *, n - 1 - pos AS back, CASE WHEN median(step) OVER (PARTITION BY series_id) > 0
  THEN greatest(CAST(floor(86400.0 / (median(step) OVER (PARTITION BY series_id) / 1e6)) AS BIGINT), 4) ELSE 12 END AS nd FROM p),
r AS (SELECT *, median(CASE WHEN pos < 5 * nd THEN temp END) OVER (PARTITION BY series_id) AS hd,
  median(CASE WHEN back < 5 * nd THEN temp END) OVER (PARTITION BY series_id) AS tl FROM d),
s AS (SELECT *, max(CASE WHEN pos >= nd OR NOT coalesce(abs(temp - hd) > 1.5, false) THEN 1 ELSE 0 END)
    OVER (PARTITION BY series_id ORDER BY pos) AS inn,
  max(CASE WHEN back >= nd OR NOT coalesce(abs(temp - tl) > 1.5, false) THEN 1 ELSE 0 END)
    OVER (PARTITION BY series_id ORDER BY back) AS outt FROM r),
g AS (SELECT *, count(*) FILTER (inn = 0) OVER (PARTITION BY series_id) + count(*) FILTER (outt = 0) OVER (PARTITION BY series_id) AS cut FROM s)
SELECT series_id, sample_no FROM g WHERE cut > 0.1 * n OR (inn = 1 AND outt = 1)""")


def b22_cast_phase(spark, path):
    """A site's samples as one cast: dips of 260 samples, each deeper than the
    last, under noise, with gaps."""
    s = ordered(water_series(spark, path), "site", BY).scan(pos=Position()).rows
    dip = F.abs((F.col("pos") + 60) % 260 - 130) * (0.2 + (F.col("pos") % 1040) / 8000.0)
    s = s.withColumn("P", F.when(F.col("sample_no") % 97 != 0, 60.0 - dip + F.col("C") / 100))
    return pp.cast_phase(s, "site", "pos", "P").select("site", "sample_no", "descending", "ascending")


add("b22_cast_phase", b22_cast_phase, f"""WITH {WATER},
n AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ts, sample_no) - 1 AS i FROM water),
x AS (SELECT site, sample_no, i, CASE WHEN sample_no % 97 <> 0 THEN 60.0::DOUBLE - abs((i + 60) % 260 - 130) * (0.2::DOUBLE + (i % 1040) / 8000.0::DOUBLE) + "C" / 100 END AS v FROM n),
w AS (SELECT *, lag(v) OVER (PARTITION BY site ORDER BY i) AS b, lead(v) OVER (PARTITION BY site ORDER BY i) AS a FROM x),
p AS (SELECT site, i AS p, v AS vp FROM w WHERE v > b AND v > a),
g AS (SELECT p.site, p, vp, coalesce(max(q.i) FILTER (q.i < p), -1) AS lw, coalesce(min(q.i) FILTER (q.i > p), 1000000000) AS rw
  FROM p LEFT JOIN x q ON q.site = p.site AND (q.v > vp OR q.v IS NULL) GROUP BY ALL),
m AS (SELECT g.*, min(q.v) FILTER (q.i < p) AS lm, min(q.v) FILTER (q.i > p) AS rm FROM g JOIN x q ON q.site = g.site AND q.i > lw AND q.i < rw GROUP BY ALL),
h AS (SELECT *, vp - (vp - greatest(lm, rm)) / 2 AS h FROM m),
e AS (SELECT h.site, p, h, max(q.i) FILTER (q.i < p) AS l, min(q.i) FILTER (q.i > p) AS r FROM h JOIN x q ON q.site = h.site AND q.i > lw AND q.i < rw AND q.v <= h GROUP BY ALL),
d AS (SELECT e.site, p, (r - (h - r0.v) / (r1.v - r0.v)) - (l + (h - l0.v) / (l1.v - l0.v)) AS width FROM e
  JOIN x l0 ON l0.site = e.site AND l0.i = l JOIN x l1 ON l1.site = e.site AND l1.i = l + 1
  JOIN x r0 ON r0.site = e.site AND r0.i = r JOIN x r1 ON r1.site = e.site AND r1.i = r - 1),
t AS (SELECT site, coalesce(min(p) FILTER (width >= 100), min(p) FILTER (width >= 50)) AS turn FROM d GROUP BY 1)
SELECT x.site, sample_no, coalesce(i <= turn, true) AS descending, coalesce(i >= turn, true) AS ascending FROM x LEFT JOIN t ON t.site = x.site""")


def b23_null_repeats(spark, path):
    s = scalar_series(spark, path).withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return pp.drop_null_repeats(s, ["series_id"], "ts", "v").select("series_id", "sample_no", "v")


add("b23_null_repeats", b23_null_repeats, f"""WITH {EV}, c AS (SELECT *, count(*) OVER (PARTITION BY series_id, date_trunc('day', ts)) AS k FROM ev)
SELECT series_id, sample_no, v FROM c WHERE NOT (v IS NULL AND k > 1)""")


def b24_present_parameters(spark, path):
    w = water_series(spark, path).withColumns({
        "S": F.when(F.col("site") != "S1", F.col("S")), "P": F.when(~F.col("site").isin("S2", "S4"), F.col("P"))})
    long = unpivot(w, ["site", "sample_no"], ["T", "S", "P"])
    return pp.present_parameters(long, ["site"]).select("site", "sample_no", "var", "value")


add("b24_present_parameters", b24_present_parameters, f"""WITH {WATER},
u AS (SELECT site, sample_no, 'T' AS var, "T" AS value FROM water UNION ALL
SELECT site, sample_no, 'S', CASE WHEN site <> 'S1' THEN "S" END FROM water UNION ALL
SELECT site, sample_no, 'P', CASE WHEN site NOT IN ('S2', 'S4') THEN "P" END FROM water)
SELECT site, sample_no, var, value FROM u WHERE (site, var) IN (SELECT (site, var) FROM u GROUP BY site, var HAVING count(value) > 0)""")


def q26_gap_nodes(spark, path):
    s = ordered(scalar_series(spark, path), KEYS, BY).scan(after=Next("ts")).rows
    return sel.gap_nodes(s, F.col("after"), "ts", "v").select("series_id", "ts", "v")


add("q26_gap_nodes", q26_gap_nodes, f"""WITH {EV}, n AS (SELECT *, lead(ts) OVER (PARTITION BY series_id ORDER BY ts, sample_no) AS nx FROM ev)
SELECT series_id, ts, v FROM n UNION ALL SELECT series_id, ts + INTERVAL 1 HOUR, NULL FROM n WHERE nx > ts + INTERVAL 1 HOUR""")
