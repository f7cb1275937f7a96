"""Queries for exports, the database and the product catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidelint.functions import labels
from tidelint.operators import catalog as ca
from tidelint.operators import database as db
from tidelint.operators.ordering import Position, ordered
from tidelint.plans.criteria import VARIABLES
from tidelint.plans.layouts import filled_columns, instrument_column, layout_column
from tidelint.registry.base import EV, LIGHT, WATER, light_series, scalar_series, table, water_series
from tidelint.registry.prep import _ORD_LABEL, _WORDS
from tidelint.sources import products as pr
from tidelint.sources import provenance as pv
from tidelint.sources import text_exports as te

QUERIES, SQL = {}, {}


def add(name, fn, sql):
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


def _text(column):
    return F.coalesce(F.replace(column.cast("string"), F.lit("."), F.lit(",")), F.lit(""))


# ------------------------------------------------------------------ A1 - A8
def scalar_lines(spark, path):
    """Each user's export: two title lines, a header and semicolon rows with
    comma decimals. Every seventh user's header names no unit."""
    w = water_series(spark, path)
    rows = w.select("series_id", (F.col("sample_no") + 10).alias("line_no"), F.concat_ws(
        ";", F.date_format("ts", "dd/MM/yyyy HH:mm:ss"), F.col("sample_no").cast("string"), _text(F.col("P") * 10),
        _text(F.col("T")), _text(F.col("S")), _text(F.col("C") / 10), F.lit("x")).alias("line"))
    files = w.select("series_id").distinct()
    bare = F.substring("series_id", 2, 20).cast("long") % 7 == 0
    head = F.concat(F.lit("Record Time;Record Number;"), F.when(bare, "Pressure").otherwise("Pressure[kPa]"),
                    F.lit(";Temperature[DegC];Salinity[PSU];Conductivity[S/m];Comment"))
    top = files.select("series_id", F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("line_no"), t.alias("line")) for i, t in (
        (0, F.lit("Description;Seaguard II Platform")), (1, F.lit("Product Name;5650")), (2, head))])).alias("e"))
    return rows.unionByName(top.select("series_id", "e.*")).withColumnRenamed("series_id", "file")


def a1_scalar_export(spark, path):
    rows, _refused = te.parse_scalar(scalar_lines(spark, path))
    return rows.select("file", F.col("line_no").alias("line_no"), F.col("Datetime").alias("ts"), F.col("`Pressure (dbar)`").alias("pressure"),
                       F.col("`Temperature (degC)`").alias("temperature"), F.col("`Salinity (PSU)`").alias("salinity"),
                       F.col("`Conductivity (mS/cm)`").alias("conductivity"), F.col("pH").alias("ph"))


def a1_refused_exports(spark, path):
    return te.parse_scalar(scalar_lines(spark, path))[1]


add("a1_scalar_export", a1_scalar_export, f"""WITH {WATER} SELECT series_id AS file, sample_no + 10 AS line_no, CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts,
("P" * 10) / 10 AS pressure, "T" AS temperature, "S" AS salinity, ("C" / 10) * 10 AS conductivity, NULL::DOUBLE AS ph
FROM water WHERE CAST(substr(series_id, 2) AS BIGINT) % 7 <> 0""")
add("a1_refused_exports", a1_refused_exports, f"""WITH {EV} SELECT DISTINCT series_id AS file, 'no unit in column ''Pressure''' AS reason FROM ev
WHERE CAST(substr(series_id, 2) AS BIGINT) % 7 = 0""")


def light_lines(spark, path):
    """Light exports: quoted commas or plain semicolons, lux or lumens, both
    date orders, event columns."""
    s = light_series(spark, path)
    uid = F.substring("series_id", 2, 20).cast("long")
    quoted = uid % 2 == 1
    stamp = F.when(uid % 3 == 1, F.date_format("ts", "MM/dd/yy HH:mm:ss")).otherwise(F.date_format("ts", "dd/MM/yy HH:mm:ss"))
    cells = [F.col("sample_no").cast("string"), stamp, F.coalesce(F.col("temp").cast("string"), F.lit("")),
             F.coalesce(F.col("lux").cast("string"), F.lit("")), F.when(F.col("sample_no") % 50 == 3, "Logged").otherwise(""), F.lit("")]
    body = F.when(quoted, F.concat_ws(",", *[F.concat(F.lit('"'), x, F.lit('"')) for x in cells])).otherwise(F.concat_ws(";", *cells))
    rows = s.select("series_id", (F.col("sample_no") + 10).alias("line_no"), body.alias("line"))
    files = s.select("series_id").distinct()
    head = F.when(quoted, '"#","Date Time, GMT-03:00","Temp, C","Intensity, Lux","Coupler Detached","End Of File"').otherwise(
        "#;Date Time;Temp (C);Intensity (lum/ft2);Coupler Detached;End Of File")
    top = files.select("series_id", F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("line_no"), t.alias("line")) for i, t in (
        (0, F.lit("Plot Title: x")), (1, head))])).alias("e"))
    return rows.unionByName(top.select("series_id", "e.*")).withColumnRenamed("series_id", "file")


def a2_light_export(spark, path):
    rows, _refused = te.parse_light(light_lines(spark, path))
    return rows.select("file", "line_no", "ts", "temp", F.round("lux", 6).alias("lux"), F.col("detached").isNotNull().alias("detached"), "order_note")


add("a2_light_export", a2_light_export, f"""WITH {LIGHT}, k AS (SELECT *, CAST(substr(series_id, 2) AS BIGINT) AS uid, date_trunc('second', ts) AS s,
  max(day(ts)) OVER (PARTITION BY series_id) AS md FROM light)
SELECT series_id AS file, sample_no + 10 AS line_no, CAST(CASE WHEN uid % 3 = 1 AND md <= 12 THEN make_timestamp(year(s), day(s), month(s), hour(s), minute(s), second(s)) ELSE s END AS TIMESTAMP) AS ts,
temp, round(CASE WHEN uid % 2 = 1 THEN lux ELSE lux * 10.7639::DOUBLE END, 6) AS lux, sample_no % 50 = 3 AS detached,
CASE WHEN md <= 12 THEN 'day-first assumed' WHEN uid % 3 = 1 THEN 'month-first' ELSE 'day-first' END AS order_note FROM k""")


def co2_lines(spark, path):
    """Each site's CO2 export with a repeated header and misshapen rows."""
    s = scalar_series(spark, path)
    parts = [F.date_format("ts", p) for p in ("yyyy", "M", "d", "H", "m")]
    body = F.concat_ws(",", F.lit("W M"), *parts, F.lit("0"), F.lit("1"), F.col("value").cast("string"),
                       F.coalesce((F.col("v") * 2).cast("string"), F.lit("")))
    line = F.when(F.col("sample_no") % 41 == 0, F.lit("W M,2024")).when(
        F.col("sample_no") % 100 == 7, F.lit("Measurement type,Year,Month,Day,Hour,Minute,Second,Reference A/D,CO2 (PPM),Corrected disolved CO2 (PPM)")).otherwise(body)
    rows = s.select(F.col("site").alias("file"), (F.col("sample_no") + 1).alias("line_no"), line.alias("line"))
    top = s.select(F.col("site").alias("file")).distinct().select("file", F.lit(0).cast("long").alias("line_no"), F.lit(
        "Measurement type,Year,Month,Day,Hour,Minute,Second,Reference A/D,CO2 (PPM),Corrected disolved CO2 (PPM)").alias("line"))
    return rows.unionByName(top)


def a3_co2_export(spark, path):
    return te.parse_co2(co2_lines(spark, path))


add("a3_co2_export", a3_co2_export, f"""WITH {EV} SELECT site AS file, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS ts, arg_min(v * 2, sample_no) AS co2 FROM ev
WHERE v IS NOT NULL AND sample_no % 41 <> 0 AND sample_no % 100 <> 7 GROUP BY 1, 2""")


def a5_classify(spark, path):
    tag = [F.concat(F.lit(p), F.col("file")).alias("file") for p in ("s-", "l-", "c-")]
    lines = [x(spark, path).withColumn("file", t) for x, t in zip((scalar_lines, light_lines, co2_lines), tag, strict=True)]
    return te.classify(lines[0].unionByName(lines[1]).unionByName(lines[2]))


add("a5_classify", a5_classify, f"""WITH {EV}, u AS (SELECT DISTINCT series_id FROM ev) SELECT 's-' || series_id AS file, 'Seaguard' AS instrument FROM u
UNION ALL SELECT 'l-' || series_id, 'HOBO' FROM u UNION ALL SELECT DISTINCT 'c-' || site, NULL FROM ev""")


def _listing(spark, path):
    d = table(spark, path, "documents")
    folder = F.element_at(F.array(*[F.lit(x) for x in ("qualified scalar", "qualified light", "raw")]), (F.col("doc_id") % 3 + 1).cast("int"))
    name = F.concat(F.when(F.col("doc_id") % 4 == 0, "REPORT_").otherwise("p"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 0, ".xlsx").otherwise(".csv"))
    return d.select("doc_id", "lang", F.concat_ws("/", F.lit("root"), "lang", "source", folder, name).alias("path"))


def a6_discovery(spark, path):
    return pr.pick_products(_listing(spark, path), ["qualified scalar", "qualified light"], "REPORT_").select("doc_id", "path")


add("a6_discovery", a6_discovery, """SELECT doc_id, 'root/' || lang || '/' || source || CASE doc_id % 3 WHEN 0 THEN '/qualified scalar/' ELSE '/qualified light/' END || 'p' || doc_id || '.csv' AS path
FROM documents WHERE doc_id % 3 <> 2 AND doc_id % 5 <> 0 AND doc_id % 4 <> 0""")

def a7_layouts(spark, path):
    """Layout and instrument of each series from the columns that it fills."""
    w = water_series(spark, path)
    g = F.substring("series_id", 2, 20).cast("long") % 4
    wide = w.select("series_id", F.col("ts").alias("Datetime"), F.when(F.col("site") != "S4", F.col("site")).alias("Site"), F.when(g == 0, F.lit(1)).alias("Flag_cur"),
                    F.when(g == 0, F.col("C")).alias("Horizontal speed (cm/s)"), F.when(g.isin(1, 2), F.col("T")).alias("Temperature (degC)"),
                    F.when((g == 1) & (F.col("sample_no") % 2 == 0), F.col("C")).alias("Luminosity (lux)"), F.when(g == 2, F.lit("1")).alias("Flag"),
                    F.when(g == 2, F.col("S")).alias("Salinity (PSU)"))
    found = filled_columns(wide, ["series_id"], wide.columns[1:])
    return found.select("series_id", layout_column(F.col("header")).alias("layout"), F.coalesce(instrument_column(F.col("header")), F.lit("none")).alias("instrument"), "n")


add("a7_layouts", a7_layouts, f"""WITH {WATER}, w AS (SELECT *, CAST(substr(series_id, 2) AS BIGINT) % 4 AS g FROM water),
h AS (SELECT series_id, count(*) AS n, count(*) FILTER (site <> 'S4') > 0 AS site, count("C") FILTER (g = 0) > 0 AS speed, count(*) FILTER (g = 0) > 0 AS cur,
  count("T") FILTER (g IN (1, 2)) > 0 AS t, count("C") FILTER (g = 1 AND sample_no % 2 = 0) > 0 AS lux, count(*) FILTER (g = 2) > 0 AS flag, count("S") FILTER (g = 2) > 0 AS sal FROM w GROUP BY 1)
SELECT series_id, CASE WHEN cur OR speed THEN 'doppler' WHEN lux AND NOT sal THEN 'hobo' ELSE 'tscp' END AS layout,
CASE WHEN NOT site THEN 'none' WHEN cur AND speed THEN 'Doppler' WHEN t AND lux THEN 'HOBO' WHEN flag AND sal THEN 'Seaguard' ELSE 'none' END AS instrument, n FROM h""")


def a8_table_sink(spark, path):
    """Written by site and read back from the shared folder."""
    target = f"{pr.shared_folder(spark)}/tables-{uuid.uuid4()}"
    pr.write_table(water_series(spark, path).select("site", "series_id", "sample_no", "ts", "T", "S"), target)
    return pr.read_table(spark, target).select("site", "series_id", "sample_no", "ts", "T", "S")


add("a8_table_sink", a8_table_sink, f'WITH {WATER} SELECT site, series_id, sample_no, ts, "T", "S" FROM water')


# ----------------------------------------------------------------- A9 - A11
def product_rows(spark, path):
    o = table(spark, path, "orders")
    k = F.col("o_custkey")
    inst = F.element_at(F.array(*[F.lit(x) for x in ("HOBO", "SEAGUARD", "DOPPLER")]), (k % 3 + 1).cast("int"))
    sem = F.concat(F.year("o_orderdate").cast("string"), F.when(F.month("o_orderdate") <= 6, "S1").otherwise("S2"))
    site = F.concat(F.lit("N"), (k % 25).cast("string"))
    bucket = F.when(k % 5 == 0, "/_EXP/").otherwise("/")
    name = F.concat_ws("_", site, sem, inst, (k % 2).cast("string"), F.lit("QLF.csv"))
    return o.select(F.concat(inst, F.lit("/qualified/"), sem, bucket, site, F.lit("/data/"), name).alias("path"),
                    F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), "o_orderkey",
                    F.when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice")).alias("co2"))


_PROD = """pr AS (SELECT ['HOBO', 'SEAGUARD', 'DOPPLER'][o_custkey % 3 + 1] AS inst, year(o_orderdate) || CASE WHEN month(o_orderdate) <= 6 THEN 'S1' ELSE 'S2' END AS sem,
  CASE WHEN o_custkey % 5 = 0 THEN '_EXP' ELSE '' END AS bucket, 'N' || (o_custkey % 25) AS site, o_custkey % 2 AS k, CAST(o_orderdate AS TIMESTAMP) AS ts, o_orderkey,
  CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice END AS co2 FROM orders),
pp AS (SELECT *, site || '_' || sem || '_' || inst || '_' || k || '_QLF' AS product, inst || '/qualified/' || sem || '/' || CASE WHEN bucket <> '' THEN bucket || '/' ELSE '' END
  || site || '/data/' || site || '_' || sem || '_' || inst || '_' || k || '_QLF.csv' AS path FROM pr),
ix AS (SELECT path, product, inst AS instrument, sem AS semester, bucket, site, count(*) AS n_rows, min(ts) AS t_start, max(ts) AS t_end, count(co2) AS co2_points FROM pp GROUP BY ALL)"""


def provenance_lines(spark, path):
    """Lines of one provenance file per product folder: two blocks a product, of
    which the later counts, some without a CO2 file, and a note in between."""
    index = ca.product_index(product_rows(spark, path), "path", "ts", "co2")
    k = F.substring_index(F.regexp_replace("product", "_QLF$", ""), "_", -1).cast("int")
    n = F.regexp_extract("site", r"(\d+)", 1).cast("int")

    def block(version, no):
        co2 = F.when((n + k) % 3 != 0, F.concat(F.lit("  co2 : c"), n.cast("string"), F.lit(".txt"))).otherwise(F.lit("  note: no CO2"))
        lines = [F.col("product"), F.concat(F.lit("  tipo      : "), F.lit(version)), F.concat(F.lit("\tcampaign: C"), F.col("semester")),
                 F.concat(F.lit("  cast : "), F.col("t_start").cast("string")), co2, F.lit("   "), F.concat(F.lit("  stations: st"), n.cast("string"), F.lit(" ")),
                 F.concat(F.lit("  inputs : raw/"), n.cast("string"), F.lit(".csv | raw/"), (n % 4).cast("string"), F.lit(version), F.lit(".csv")), F.lit("")]
        return F.transform(F.array(*[F.struct(F.lit(i).alias("i"), x.alias("line")) for i, x in enumerate(lines)]),
                           lambda x: F.struct((x["i"] + no + 100 * k).cast("long").alias("line_no"), x["line"].alias("line")))

    note = F.array(F.struct((F.lit(90) + 100 * k).cast("long").alias("line_no"), F.lit("  free text: not a block").alias("line")),
                   F.struct((F.lit(91) + 100 * k).cast("long").alias("line_no"), F.lit("").alias("line")))
    every = index.select(F.concat(pv.folder_of(F.col("path")), F.lit("/provenance.txt")).alias("file"),
                         F.explode(F.concat(block("old", 0), block("new", 20), note)).alias("x"))
    return every.select("file", "x.*")


def a9_product_index(spark, path):
    index = ca.product_index(product_rows(spark, path), "path", "ts", "co2")
    return pv.with_provenance(index, pv.provenance_blocks(provenance_lines(spark, path)))


_PROD = _PROD.replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4, 5, 6")
add("a9_product_index", a9_product_index, f"""WITH {_PROD} SELECT ix.*, 'new' AS kind, 'C' || semester AS campaign, strftime(t_start, '%Y-%m-%d %H:%M:%S') AS cast_start,
CASE WHEN (CAST(substr(site, 2) AS INTEGER) + CAST(string_split(product, '_')[-2] AS INTEGER)) % 3 <> 0 THEN 'c' || substr(site, 2) || '.txt' ELSE '-' END AS co2_file,
'st' || substr(site, 2) AS stations, 'raw/' || substr(site, 2) || '.csv | raw/' || (CAST(substr(site, 2) AS INTEGER) % 4) || 'new.csv' AS inputs FROM ix""")


def s8_provenance_inputs(spark, path):
    """Raw exports of the provenance files that feed more than one product."""
    return ca.shared_inputs(a9_product_index(spark, path), "product", "inputs")


add("s8_provenance_inputs", s8_provenance_inputs, f"""WITH {_PROD}, x AS (SELECT product, unnest(['raw/' || substr(site, 2) || '.csv', 'raw/' || (CAST(substr(site, 2) AS INTEGER) % 4) || 'new.csv']) AS source FROM ix)
SELECT source, count(DISTINCT product) AS products FROM x GROUP BY 1 HAVING count(DISTINCT product) > 1""")


def _delivery(spark, path):
    rows = product_rows(spark, path)
    return ca.delivery(ca.product_index(rows, "path", "ts", "co2"), rows, "HOBO", ["N3", "N6", "N9", "N12"], 1996, 1999)


def a10_delivery_rows(spark, path):
    return _delivery(spark, path)[0].select("path", "o_orderkey", "ts")


def a10_included_products(spark, path):
    return _delivery(spark, path)[1].select("product", "site", "semester", "n_rows", "t_start", "t_end")


_CHOSEN = "instrument = 'HOBO' AND site IN ('N3', 'N6', 'N9', 'N12') AND CAST(substr(semester, 1, 4) AS INTEGER) BETWEEN 1996 AND 1999"
add("a10_delivery_rows", a10_delivery_rows, f"""WITH {_PROD} SELECT path, o_orderkey, ts FROM pp WHERE path IN (SELECT path FROM ix WHERE {_CHOSEN}) AND year(ts) BETWEEN 1996 AND 1999""")
add("a10_included_products", a10_included_products, f"WITH {_PROD} SELECT product, site, semester, n_rows, t_start, t_end FROM ix WHERE {_CHOSEN}")


def a11_latest_provenance(spark, path):
    o = table(spark, path, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", "o_totalprice")
    out = ca.latest_blocks(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return out.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


add("a11_latest_provenance", a11_latest_provenance, """SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM
(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")


def a11_replaced_blocks(spark, path):
    """Orders by customer, of which every third customer is replaced by the latest order alone."""
    o = table(spark, path, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    target = f"{pr.shared_folder(spark)}/blocks-{uuid.uuid4()}"
    pv.replace_blocks(o, target, "o_custkey")
    pv.replace_blocks(ca.latest_blocks(o.where("o_custkey % 3 = 0"), ["o_custkey"], ["o_orderdate", "o_orderkey"]), target, "o_custkey")
    return pv.read_blocks(spark, target, "o_custkey").select("o_custkey", "o_orderkey", "o_totalprice")


add("a11_replaced_blocks", a11_replaced_blocks, """SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey % 3 <> 0 UNION ALL SELECT o_custkey, o_orderkey, o_totalprice FROM
(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1 AND o_custkey % 3 = 0""")


# ----------------------------------------------------------- S1 - S3, O, G19
def _frames(spark, path):
    w = water_series(spark, path)
    base = w.select(F.col("ts").alias("Datetime"), F.col("site").alias("Site"), F.col("T").alias("Temperature (degC)"),
                    F.col("S").alias("Salinity (PSU)"), F.col("sample_no").alias(db.ROW_NO))
    a = base.withColumn("Datetime", F.when(F.col(db.ROW_NO) % 59 != 0, F.col("Datetime")))
    b = w.select(F.col("ts").alias("Datetime"), F.col("site").alias("Site"), F.col("C").alias("Conductivity (mS/cm)"),
                 F.col("sample_no").alias(db.ROW_NO)).withColumn("Datetime", F.col("Datetime") + F.expr("INTERVAL 365 DAYS"))
    copy = base.where(F.col("Site").isin("S1", "S2"))
    clash = base.where(F.col("Site") == "S3").withColumn("Temperature (degC)", F.col("`Temperature (degC)`") + 1)
    return [("a.csv", a), ("b.csv", b), ("copy.csv", copy), ("clash.csv", clash)]


_DB = WATER + """, un AS (SELECT CASE WHEN sample_no % 59 <> 0 THEN ts END AS ts, site, "T" AS t, "S" AS s, NULL::DOUBLE AS c, sample_no, 'a.csv' AS src, 0 AS fno FROM water
UNION ALL SELECT ts + INTERVAL 365 DAY, site, NULL, NULL, "C", sample_no, 'b.csv', 1 FROM water
UNION ALL SELECT ts, site, "T", "S", NULL, sample_no, 'copy.csv', 2 FROM water WHERE site IN ('S1', 'S2')
UNION ALL SELECT ts, site, "T" + 1, "S", NULL, sample_no, 'clash.csv', 3 FROM water WHERE site = 'S3'),
ud AS (SELECT * FROM un WHERE ts IS NOT NULL),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ts, site, t, s, c ORDER BY fno, sample_no) AS rn FROM ud) WHERE rn = 1)"""


def _unified(spark, path):
    return db.unify(_frames(spark, path), "tscp")


def _deduplicated(spark, path):
    return db.drop_exact_duplicates(_unified(spark, path), [db.SOURCE, db.FILE_NO, db.ROW_NO], [db.FILE_NO, db.ROW_NO])


def _plain(df):
    return df.select(F.col("Datetime").alias("ts"), F.col("Site").alias("site"), F.col("`Temperature (degC)`").alias("t"), F.col("`Salinity (PSU)`").alias("s"),
                     F.col("`Conductivity (mS/cm)`").alias("c"), db.ROW_NO, db.SOURCE)


add("s1_union", lambda spark, path: _plain(_unified(spark, path)),
    f"WITH {_DB} SELECT ts, site, t, s, c, sample_no AS row_no, src AS source_file FROM ud")
add("s2_exact_duplicates", lambda spark, path: _plain(_deduplicated(spark, path)),
    f"WITH {_DB} SELECT ts, site, t, s, c, sample_no AS row_no, src AS source_file FROM dd")


def s3_overlaps(spark, path):
    o = db.overlaps(_deduplicated(spark, path), ["Site", "Datetime"])
    return o.select(F.col("Site").alias("site"), F.col("Datetime").alias("ts"), "source_file", "rows")


def s3_offenders(spark, path):
    return db.overlap_offenders(db.overlaps(_deduplicated(spark, path), ["Site", "Datetime"]))


_OV = _DB + """, ov AS (SELECT *, count(*) OVER (PARTITION BY site, ts) AS k FROM dd)"""
add("s3_overlaps", s3_overlaps, f"WITH {_OV} SELECT site, ts, src AS source_file, count(*) AS rows FROM ov WHERE k > 1 GROUP BY 1, 2, 3")
add("s3_offenders", s3_offenders, f"WITH {_OV} SELECT src AS source_file, count(*) AS rows FROM ov WHERE k > 1 GROUP BY 1")
add("o1_sorted_database", lambda spark, path: _plain(db.sorted_database(_deduplicated(spark, path))),
    f"WITH {_DB} SELECT ts, site, t, s, c, sample_no AS row_no, src AS source_file FROM dd ORDER BY site, ts, fno, sample_no")
add("o2_site_blocks", lambda spark, path: _plain(db.sorted_database(_deduplicated(spark, path), by_first_sample=True)),
    f"WITH {_DB} SELECT ts, site, t, s, c, sample_no AS row_no, src AS source_file FROM dd ORDER BY min(ts) OVER (PARTITION BY site), ts, fno, sample_no")


def o3_out_of_order(spark, path):
    s = scalar_series(spark, path).withColumn("ts", F.date_trunc("hour", F.timestamp_add("MINUTE", (F.col("value") * 10).cast("int"), F.col("ts"))).cast("timestamp_ntz"))
    return db.out_of_order(s, "series_id", "sample_no")


add("o3_out_of_order", o3_out_of_order, f"""WITH {EV}, m AS (SELECT series_id, sample_no, date_trunc('hour', ts + to_minutes(CAST(trunc(value * 10) AS INTEGER))) AS t FROM ev),
l AS (SELECT series_id, t < lag(t) OVER (PARTITION BY series_id ORDER BY sample_no) AS b FROM m) SELECT series_id, count(*) FILTER (b) AS backwards FROM l GROUP BY 1""")


def o4_shortest_series(spark, path):
    s = scalar_series(spark, path)
    spans = s.groupBy("site", "series_id").agg((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("span"))
    return spans.groupBy("site").agg(F.min_by("series_id", F.struct("span", "series_id")).alias("series_id"), F.min("span").alias("span"))


add("o4_shortest_series", o4_shortest_series, f"""WITH {EV}, p AS (SELECT site, series_id, epoch_us(max(ts)) - epoch_us(min(ts)) AS span FROM ev GROUP BY 1, 2)
SELECT site, arg_min(series_id, (span, series_id)) AS series_id, min(span) AS span FROM p GROUP BY 1""")


def g19_database_summary(spark, path):
    return db.summary(_plain(_deduplicated(spark, path)))


add("g19_database_summary", g19_database_summary, f"WITH {_DB} SELECT count(*) AS rows, count(DISTINCT site) AS sites, min(ts) AS first, max(ts) AS last, count(DISTINCT src) AS sources FROM dd")
add("g19_site_summary", lambda spark, path: db.site_summary(_plain(_deduplicated(spark, path))),
    f"WITH {_DB} SELECT site, count(*) AS rows, min(ts) AS first, max(ts) AS last FROM dd GROUP BY 1")


# ------------------------------------------------------------------ J5 - J9
def j5_excluded_files(spark, path):
    files = table(spark, path, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"), "lang")
    bad = table(spark, path, "labels").where(F.col("quality") == 0).select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"))
    return ca.drop_excluded(files, bad)


add("j5_excluded_files", j5_excluded_files, "SELECT 'doc_' || doc_id AS name, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")


def j5_exclusions_reported(spark, path):
    """Series' weeks are deployments; every third series was excluded, some
    with an unreadable span."""
    s = scalar_series(spark, path)
    spans = s.groupBy(F.col("site").alias("folder"), "series_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    uid = F.substring("series_id", 2, 20).cast("long")
    excluded = spans.where(uid % 3 == 0).select("folder", F.col("series_id").alias("name"), F.when(uid % 2 == 0, F.col("start")).alias("start"), F.when(uid % 2 == 0, F.col("end")).alias("end"))
    out = ca.exclusions_of(spans.withColumnRenamed("series_id", "deployment"), excluded, "folder")
    return out.select("folder", "deployment", "name", "placed")


add("j5_exclusions_reported", j5_exclusions_reported, f"""WITH {EV}, sp AS (SELECT site AS folder, series_id, min(ts) AS s, max(ts) AS e, CAST(substr(series_id, 2) AS BIGINT) AS u FROM ev GROUP BY 1, 2),
x AS (SELECT folder, series_id AS name, u, s, e FROM sp WHERE u % 3 = 0)
SELECT sp.folder, sp.series_id AS deployment, x.name, x.u % 2 = 0 AS placed FROM sp JOIN x ON x.folder = sp.folder
AND (x.u % 2 <> 0 OR (abs(epoch_us(x.s) - epoch_us(sp.s)) <= 86400000000 AND abs(epoch_us(x.e) - epoch_us(sp.e)) <= 86400000000))""")


def j6_preferred_exports(spark, path):
    d = table(spark, path, "documents")
    name = F.concat(F.lit("d"), F.floor(F.col("doc_id") / 2).cast("string"), F.when((F.col("doc_id") % 2 == 0) | (F.col("doc_id") % 3 == 0), ".csv").otherwise(".xlsx"))
    return ca.preferred_exports(d.select("lang", name.alias("name")), "lang")


add("j6_preferred_exports", j6_preferred_exports, """WITH f AS (SELECT lang, 'd' || (doc_id // 2) AS stem, CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN '.csv' ELSE '.xlsx' END AS ext FROM documents)
SELECT lang, stem, stem || max(ext) AS name FROM f GROUP BY 1, 2""")


def j7_subset_buckets(spark, path):
    li, pt = table(spark, path, "lineitem"), table(spark, path, "part")
    buckets = li.select(F.col("l_orderkey").alias("bucket"), (F.col("l_orderkey") % 5).alias("site"), (F.col("l_partkey") % 50).alias("name"))
    files = pt.select((F.col("p_partkey") % 5).alias("site"), (F.floor(F.col("p_partkey") / 5) % 40).alias("name"))
    return ca.subset_buckets(buckets, files, "bucket", "site")


add("j7_subset_buckets", j7_subset_buckets, """WITH b AS (SELECT DISTINCT l_orderkey AS bucket, l_orderkey % 5 AS site, l_partkey % 50 AS name FROM lineitem),
f AS (SELECT DISTINCT p_partkey % 5 AS site, (p_partkey // 5) % 40 AS name, true AS ok FROM part)
SELECT bucket, site, count(*) AS files, bool_and(coalesce(ok, false)) AS redundant FROM b LEFT JOIN f USING (site, name) GROUP BY 1, 2""")


def j8_owning_campaign(spark, path):
    o = table(spark, path, "orders")
    word = F.element_at(F.array(*[F.lit(w) for w in [*_WORDS, "SEMANA"]]), (F.col("o_orderkey") % 25 + 1).cast("int"))
    filed = o.select("o_custkey", F.concat_ws(" ", F.lit("CAMP"), word, F.year("o_orderdate").cast("string")).alias("campaign"),
                     F.date_add(F.lit("1995-01-01").cast("date"), (F.col("o_custkey") % 2000).cast("int")).alias("data_end"))
    return ca.owning_campaign(filed, ["o_custkey"], "campaign", labels.campaign_date(F.col("campaign")), F.col("data_end"))


add("j8_owning_campaign", j8_owning_campaign, f"""WITH {_ORD_LABEL}, f AS (SELECT o_custkey, 'CAMP ' || word || ' ' || year(o_orderdate) AS campaign,
  coalesce(date_diff('day', DATE '1995-01-01' + CAST(o_custkey % 2000 AS INTEGER), CASE WHEN mon IS NOT NULL THEN make_date(year(o_orderdate), mon, 1) END), 1000000) AS late FROM lb)
SELECT o_custkey, arg_min(campaign, (CASE WHEN late < 0 THEN 1 ELSE 0 END, late, campaign)) AS owner, count(DISTINCT campaign) AS campaigns FROM f GROUP BY 1""")


def j9_limit_lookup(spark, path):
    """Limits as a table joined to long readings (eleven fixed rows)."""
    from tidelint.operators.reports import unpivot
    limits = spark.createDataFrame([(k, *e) for k, (_c, _s, e) in VARIABLES.items() if e], "var string, low double, high double")
    long = unpivot(water_series(spark, path), ["series_id", "sample_no"], ["T", "S", "C", "P"])
    v = F.col("value")
    out = long.join(F.broadcast(limits), "var", "left")
    return out.groupBy("series_id", "var").agg(F.count_if((v < F.col("low")) | (v > F.col("high"))).alias("outside"), F.count(v).alias("n"))


add("j9_limit_lookup", j9_limit_lookup, f"""WITH {WATER}, u AS (SELECT series_id, unnest([{{'k': 'T', 'v': "T"}}, {{'k': 'S', 'v': "S"}}, {{'k': 'C', 'v': "C"}}, {{'k': 'P', 'v': "P"}}]) AS e FROM water),
l(var, lo, hi) AS (VALUES ('T', 8.0, 35.0), ('S', 20.0, 37.5), ('C', 5.0, 75.0), ('P', 0.0, 6000.0))
SELECT series_id, var, count(*) FILTER (e.v < lo OR e.v > hi) AS outside, count(e.v) AS n FROM u JOIN l ON l.var = e.k GROUP BY 1, 2""")


# ----------------------------------------------------------------- S5 - S10
def s5_casts(spark, path):
    s = ca.cast_numbers(scalar_series(spark, path), "site", ["ts", "sample_no"], "ts")
    return s.groupBy("site", "cast_no").agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("sessions"))


add("s5_casts", s5_casts, f"""WITH {EV}, g AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w > 900000000, true) AS o FROM ev WINDOW w AS (PARTITION BY site ORDER BY ts, sample_no)),
c AS (SELECT *, sum(o::INT) OVER (PARTITION BY site ORDER BY ts, sample_no) AS cast_no FROM g)
SELECT site, CAST(cast_no AS BIGINT) AS cast_no, min(ts) AS start, count(*) AS sessions FROM c GROUP BY 1, 2""")


def s6_replicate_groups(spark, path):
    """Files are user-weeks; the grouping walks spans in start order."""
    s = scalar_series(spark, path)
    name = F.concat("series_id", F.lit("w"), F.ceil(F.dayofmonth("ts") / 7).cast("string"))
    spans = s.groupBy("site", name.alias("name")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    return ca.group_replicates(spans, "site", "name", "start", "end")


add("s6_replicate_groups", s6_replicate_groups, f"""WITH RECURSIVE {EV},
sp AS (SELECT site, series_id || 'w' || CAST(ceil(day(ts) / 7.0) AS INTEGER) AS name, epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS z FROM ev GROUP BY 1, 2),
f AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY a, name) AS k FROM sp),
w AS (SELECT site, k, name, name AS deployment, [{{'n': name, 'a': a, 'z': z}}] AS g FROM f WHERE k = 1
  UNION ALL SELECT site, k, name, CASE WHEN p IS NULL THEN name ELSE g[p].n END,
    CASE WHEN p IS NULL THEN list_append(g, {{'n': name, 'a': a, 'z': z}})
      ELSE list_concat(list_concat(g[:p - 1], [{{'n': g[p].n, 'a': least(g[p].a, a), 'z': greatest(g[p].z, z)}}]), g[p + 1:]) END
  FROM (SELECT f.*, w.g, nullif(list_position(list_transform(w.g, lambda x: greatest(abs(x.a - f.a), abs(x.z - f.z)) <= 86400000000
    OR greatest(abs(x.a - f.a), abs(x.z - f.z)) <= 259200000000 AND least(x.z - x.a, f.z - f.a) > 0
      AND abs((x.z - x.a) - (f.z - f.a)) <= 0.05 * greatest(x.z - x.a, f.z - f.a)), true), 0) AS p
    FROM w JOIN f ON f.site = w.site AND f.k = w.k + 1))
SELECT site, name, deployment FROM w""")


def s7_identical_sets(spark, path):
    """Each document is a product of two files: its text and its language tag."""
    d = table(spark, path, "documents")
    files = d.select("doc_id", F.md5("text").alias("digest")).unionByName(d.select("doc_id", F.md5("lang").alias("digest")))
    return ca.identical_sets(files, "doc_id", "digest", [F.col("doc_id")])


add("s7_identical_sets", s7_identical_sets, """WITH s AS (SELECT doc_id, list_sort([md5(text), md5(lang)]) AS sig FROM documents),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY sig) AS first FROM s) SELECT doc_id, 2::BIGINT AS files, CASE WHEN first <> doc_id THEN first END AS duplicate_of FROM f""")


def _inputs(spark, path):
    c = table(spark, path, "customer")
    k = F.col("c_custkey")
    one = F.concat(F.lit("f"), (k % 10).cast("string"))
    two = F.concat(one, F.lit(" | f"), (k % 7 + 50).cast("string"))
    return c.select(k.alias("product"), F.when(k % 3 == 0, one).when(k % 11 == 0, F.lit("-")).otherwise(two).alias("inputs"), F.floor("c_acctbal").alias("made"))


_INP = """pi AS (SELECT c_custkey AS product, CASE WHEN c_custkey % 3 = 0 THEN 'f' || (c_custkey % 10) WHEN c_custkey % 11 = 0 THEN '-'
  ELSE 'f' || (c_custkey % 10) || ' | f' || (c_custkey % 7 + 50) END AS inputs, CAST(floor(c_acctbal) AS BIGINT) AS made FROM customer),
ln AS (SELECT product, made, trim(s) AS source FROM (SELECT product, made, unnest(string_split(inputs, '|')) AS s FROM pi) WHERE trim(s) NOT IN ('', '-'))"""
add("s8_shared_inputs", lambda spark, path: ca.shared_inputs(_inputs(spark, path), "product", "inputs"),
    f"WITH {_INP} SELECT source, count(DISTINCT product) AS products FROM ln GROUP BY 1 HAVING count(DISTINCT product) > 1")


def s9_superseded(spark, path):
    p = _inputs(spark, path)
    pairs = p.select(F.col("product").alias("stale"), (F.col("product") + 10).alias("keeper"))
    return ca.superseded(p, pairs)


add("s9_superseded", s9_superseded, f"""WITH {_INP}, d AS (SELECT DISTINCT * FROM ln)
SELECT o.product AS stale, o.product + 10 AS keeper, bool_and(n.source IS NOT NULL) AS contained, max(k.made) > max(o.made) AS newer,
bool_and(n.source IS NOT NULL) AND max(k.made) > max(o.made) AS superseded
FROM d o JOIN pi k ON k.product = o.product + 10 LEFT JOIN d n ON n.product = o.product + 10 AND n.source = o.source GROUP BY 1, 2""")


def s10_product_names(spark, path):
    c = table(spark, path, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return ca.numbered_names(c, ["c_nationkey", "c_mktsegment"], ["c_custkey"], F.concat_ws("_", F.concat(F.lit("N"), F.col("c_nationkey").cast("string")), "c_mktsegment"))


add("s10_product_names", s10_product_names, """SELECT c_custkey, c_nationkey, c_mktsegment, 'N' || c_nationkey || '_' || c_mktsegment || CASE WHEN count(*) OVER w2 > 1
THEN '_' || row_number() OVER w ELSE '' END || '_QLF' AS name FROM customer WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey), w2 AS (PARTITION BY c_nationkey, c_mktsegment)""")


def g21_without_light(spark, path):
    s = light_series(spark, path).withColumn("lux", F.when(~F.col("series_id").isin("u1", "u6") & (F.col("site") != "S2"), F.col("lux")))
    return ca.without_light(s, ["site"], "series_id", "lux")


add("g21_without_light", g21_without_light, f"""WITH {LIGHT}, d AS (SELECT site, series_id, count(CASE WHEN series_id NOT IN ('u1', 'u6') AND site <> 'S2' THEN lux END) = 0 AS dark FROM light GROUP BY 1, 2)
SELECT site, bool_and(dark) AS temperature_only FROM d GROUP BY 1""")


def g22_modal_step(spark, path):
    s = ordered(scalar_series(spark, path).withColumn("m", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9)), "series_id", ["ts", "sample_no"])
    from tidelint.operators.ordering import Prev
    s = s.scan(before=Prev("m"), pos=Position())
    return ca.modal_step(s.rows.withColumn("step", F.col("m") - F.col("before")), ["series_id"], "step")


add("g22_modal_step", g22_modal_step, f"""WITH {EV}, m AS (SELECT series_id, CAST(floor(epoch_us(ts) / 3.6e9) AS BIGINT) AS h, ts, sample_no FROM ev),
s AS (SELECT series_id, h - lag(h) OVER (PARTITION BY series_id ORDER BY ts, sample_no) AS step FROM m),
c AS (SELECT series_id, step, count(*) AS k FROM s WHERE step > 0 GROUP BY 1, 2) SELECT series_id, arg_max(step, (k, -step)) AS interval FROM c GROUP BY 1""")
