"""Logger exports as text: one job over any number of files.

Every parser takes a frame of lines (``file``, ``line_no`` from 0, ``line``)
and returns rows; the frame usually comes from ``read_lines``. Only a header -
one line per file - is looked at by Python.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelint.operators.ordering import Position, attach_aggregates, ordered
from tidelint.operators.preprocess import (deployment_window, fix_scale, to_dbar, to_ms_cm, trim_edges)
from tidelint.sources.stamps import parse_stamps, stamp

# Canonical scalar columns and the header pattern of each, in
# matching order. A header cell takes the first pattern that is still free.
SCALAR_HEADERS = (
    ("Datetime", r"(?i)time"), ("Pressure (dbar)", r"(?i)pressure"), ("Depth (m)", r"(?i)prof|depth"),
    ("Temperature (degC)", r"(?i)temperature"), ("Conductivity (mS/cm)", r"(?i)conductivity"),
    ("Salinity (PSU)", r"(?i)salinity"), ("Density (kg/m3)", r"(?i)density"),
    ("Soundspeed (m/s)", r"(?i)soundspeed|speed of sound"), ("Turbidity (FTU)", r"(?i)turbidity"),
    ("TSS (mg/L)", r"TSS"), ("Chlorophyll (ug/L)", r"(?i)chlorophyll"),
    ("Dissolved organic matter (ppb)", r"(?i)organic"), ("pH", r"^(?!.*raw).*pH.*$"),
    ("PAR (umol/m2/s)", r"PAR"), ("O2 level (uM)", r"(?i)^(?=.*O2)(?=.*uM).*$"),
    ("O2 content (mg/L)", r"(?i)^(?=.*O2)(?=.*content).*$"))
# Unit spellings of the two columns that need converting.
UNITS = {"Pressure (dbar)": (("dbar", r"(?i)(deci\s*bar|dbar)"), ("kPa", r"(?i)k\s*pa"), ("bar", r"(?i)bar")),
         "Conductivity (mS/cm)": (("mS/cm", r"(?i)ms\s*/\s*cm"), ("S/m", r"(?i)s\s*/\s*m"))}
# Header words of light/temperature exports, in two languages.
TIME_HEADER = r"data\s*hora|date\s*time"
LIGHT_HEADER = r"intensidade|intensity|lux|lum"
EVENT_HEADER = r"acoplador|coupler|anfitri|host|parado|stopped|fim do ficheiro|end of file|bateria|battery"
DETACHED_HEADER = r"acoplador desligado|coupler detached"
ENDED_HEADER = r"acoplador ligado|coupler attached|anfitri|host|parado|stopped|fim do ficheiro|end of file"
LUX_PER_LUMEN_FT2 = 10.7639


def _windows_extras() -> tuple[str, str]:
    """Where Windows-1252 differs from Latin-1: the bytes 80 to 9F."""
    codes = [b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")]
    return "".join(map(chr, codes)), bytes(codes).decode("cp1252")


_WINDOWS_EXTRAS = _windows_extras()


def read_lines(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """Numbered lines of every matching file below ``path``.

    The text source keeps a line's bytes as they are, so each line is decoded
    on its own: UTF-8 where valid, else Windows-1252.
    """
    raw = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
           .text(path)
           .select(F.col("_metadata.file_path").alias("file"),
                   F.col("_metadata.file_block_start").alias("_block"), "value")
           .withColumn("_row", F.monotonically_increasing_id()))
    # a split's rows keep their order, and splits are ordered by their offset
    s = ordered(raw, "file", ["_block", "_row"]).scan(line_no=Position())
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    text = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.translate(latin, *_WINDOWS_EXTRAS))
    return s.rows.select("file", "line_no", F.regexp_replace(text, "^﻿", "").alias("line"))


def _number(text: Column) -> Column:
    # an empty cell must not reach the parser: it fails by exception
    clean = F.trim(text)
    return F.when(clean != "", F.replace(clean, F.lit(","), F.lit("."))).try_cast("double")


def _header_of(lines: DataFrame, is_header: Column) -> DataFrame:
    """Every line with its file's first header line (``_h.no``, ``_h.line``)."""
    entry = F.struct(F.col("line_no").alias("no"), F.col("line").alias("line"))
    return attach_aggregates(lines, "file", {"_h": F.min(F.when(is_header, entry))})


def map_scalar_header(cells: list[str]) -> tuple[dict[str, int], dict[str, str], str | None]:
    """Column index per canonical name, declared units, and why a header is refused."""
    where, units = {}, {}
    for i, cell in enumerate(cells):
        name = next((n for n, p in SCALAR_HEADERS if n not in where and re.search(p, cell)), None)
        if name is None:
            continue
        if name in UNITS:
            m = re.search(r"[\[\(]([^\]\)]*)[\]\)]", cell)
            unit = next((u for u, p in UNITS[name] if m and re.fullmatch(p, m.group(1).strip())), None)
            if unit is None:
                return where, units, f"no unit in column '{cell}'"
            units[name] = unit
        where[name] = i
    return where, units, None if "Datetime" in where else "no time column"


_SCALAR_HEADER = "struct<at: array<int>, pressure: string, conductivity: string, refused: string>"


def _scalar_header(headers: pd.Series) -> pd.DataFrame:
    out = []
    for h in headers:
        if h is None:
            out.append((None, None, None, "no header line"))
            continue
        where, units, refused = map_scalar_header([x.strip() for x in h.split(";")])
        out.append(([where.get(n, -1) for n, _p in SCALAR_HEADERS], units.get("Pressure (dbar)"),
                    units.get("Conductivity (mS/cm)"), refused))
    return pd.DataFrame(out, columns=["at", "pressure", "conductivity", "refused"])


def parse_scalar(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scalar exports: canonical columns in standard units, and refused files.

    Semicolon cells below the line that names the record time; either decimal
    sign; day-first stamps; rows without a time dropped.
    """
    is_header = F.contains(F.lower("line"), F.lit("record time"))
    # one header line per file is mapped, then joined back to the file's rows
    headers = lines.groupBy("file").agg(F.min(F.when(is_header, F.struct(
        F.col("line_no").alias("no"), F.col("line").alias("line")))).alias("_h"))
    headers = headers.select("file", F.col("_h.no").alias("_no"), F.pandas_udf(_scalar_header, _SCALAR_HEADER)("_h.line").alias("_m"))
    refused = headers.where(F.col("_m.refused").isNotNull()).select("file", F.col("_m.refused").alias("reason"))
    good = headers.where(F.col("_m.refused").isNull())
    rows = lines.join(good, "file").where(F.col("line_no") > F.col("_no"))
    rows = rows.withColumn("_c", F.split("line", ";"))
    # one parsing expression for all columns keeps the generated code small
    # enough to be compiled
    numbers = F.transform("_m.at", lambda i: F.when(i >= 0, _number(F.get("_c", i))))
    at_time = F.col("_m.at")[0]
    rows = rows.select("file", "line_no", "_m.pressure", "_m.conductivity", numbers.alias("_v"),
                       stamp(F.when(at_time >= 0, F.get("_c", at_time)), F.lit(True)).alias("Datetime"))
    out = [F.col("Datetime")]
    for i, (name, _p) in enumerate(SCALAR_HEADERS[1:], start=1):
        value = F.col("_v")[i]
        if name == "Pressure (dbar)":
            value = to_dbar(value, F.coalesce("pressure", F.lit("dbar")))
        elif name == "Conductivity (mS/cm)":
            value = to_ms_cm(value, F.coalesce("conductivity", F.lit("mS/cm")))
        out.append(value.alias(name))
    return rows.select("file", "line_no", *out).where(F.col("Datetime").isNotNull()), refused


def map_light_header(cells: list[str]) -> dict:
    """Cell positions of a light/temperature header."""
    out = {"time": -1, "date": -1, "hour": -1, "temp": -1, "light": -1, "factor": 1.0,
           "events": [], "detached": [], "ended": [], "refused": None}
    for i, cell in enumerate(cells):
        low = cell.lower()
        if out["time"] < 0 and re.search(TIME_HEADER, low):
            out["time"] = i
        elif out["temp"] < 0 and "temp" in low:
            out["temp"] = i
        elif out["light"] < 0 and re.search(LIGHT_HEADER, low):
            out["light"] = i
        elif re.search(EVENT_HEADER, low):
            out["events"].append(i)
            out["detached"] += [i] if re.search(DETACHED_HEADER, low) else []
            out["ended"] += [i] if re.search(ENDED_HEADER, low) else []
    if out["time"] < 0:
        for i, cell in enumerate(cells):
            if out["date"] < 0 and re.fullmatch(r"\s*(data|date)\s*", cell, re.IGNORECASE):
                out["date"] = i
            if out["hour"] < 0 and re.match(r"\s*(hora|time|hour)\b", cell, re.IGNORECASE):
                out["hour"] = i
        if out["date"] < 0 or out["hour"] < 0:
            out["refused"] = "no time column"
    if out["temp"] < 0:
        out["refused"] = out["refused"] or "no temperature column"
    if out["light"] >= 0:
        label = cells[out["light"]].lower()
        if re.search(r"lum/?\s*ft|lumen", label):
            out["factor"] = LUX_PER_LUMEN_FT2
        elif "lux" not in label:
            out["refused"] = out["refused"] or "light column without a unit"
    return out


_LIGHT_HEADER = ("struct<sep: string, time: int, date: int, hour: int, temp: int, light: int, factor: double, "
                 "events: array<int>, detached: array<int>, ended: array<int>, refused: string>")


def split_cells(line: str, sep: str) -> list[str]:
    """Cells of a delimited line; delimiters inside quotes do not count."""
    return [x.strip().strip('"') for x in re.split(_outside_quotes(sep), line)]


def _outside_quotes(sep: str) -> str:
    return sep + r'(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _light_header(headers: pd.Series) -> pd.DataFrame:
    rows = []
    for h in headers:
        if h is None:
            rows.append({"refused": "no header line"})
            continue
        sep = ";" if h.count(";") > h.count(",") else ","
        rows.append({"sep": sep, **map_light_header(split_cells(h, sep))})
    names = [f.split(":")[0].strip() for f in _LIGHT_HEADER[7:-1].split(", ")]
    return pd.DataFrame(rows).reindex(columns=names)


def parse_light(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Light/temperature exports as they are: stamps, values, event marks.

    A header names a time and a temperature within the first 20 lines. Returns
    rows and refused files; ``finish_light`` does the deployment clean-up.
    """
    low = F.lower("line")
    is_header = (F.col("line_no") < 20) & F.rlike(low, F.lit(TIME_HEADER + r"|(?=.*\bdat[ae]\b)(?=.*\b(hora|time|hour)\b)")) \
        & F.contains(low, F.lit("temp"))
    headers = lines.groupBy("file").agg(F.min(F.when(is_header, F.struct(
        F.col("line_no").alias("no"), F.col("line").alias("line")))).alias("_h"))
    headers = headers.select("file", F.col("_h.no").alias("_no"), F.pandas_udf(_light_header, _LIGHT_HEADER)("_h.line").alias("_m"))
    refused = headers.where(F.col("_m.refused").isNotNull()).select("file", F.col("_m.refused").alias("reason"))
    rows = lines.join(headers.where(F.col("_m.refused").isNull()), "file").where(F.col("line_no") > F.col("_no"))
    by_sep = F.when(F.col("_m.sep") == ";", F.split("line", _outside_quotes(";"))).otherwise(F.split("line", _outside_quotes(",")))
    rows = rows.withColumn("_c", F.transform(by_sep, lambda x: F.trim(F.trim(x), F.lit('"'))))

    def cell(name: str) -> Column:
        return F.when(F.col(f"_m.{name}") >= 0, F.get("_c", F.col(f"_m.{name}")))

    def marked(name: str) -> Column:
        hit = F.exists(F.col(f"_m.{name}"), lambda i: F.coalesce(F.length(F.get("_c", i)) > 0, F.lit(False)))
        return F.when(hit, F.lit(1))

    hour = cell("hour")
    split_stamp = F.when(F.rlike(hour, F.lit(r"^\s*\d{1,4}[/-]")), hour).otherwise(F.concat_ws(" ", cell("date"), hour))
    rows = rows.select("file", "line_no", F.when(F.col("_m.time") >= 0, cell("time")).otherwise(split_stamp).alias("_text"),
                       _number(cell("temp")).alias("temp"), (_number(cell("light")) * F.col("_m.factor")).alias("lux"),
                       marked("detached").alias("detached"), marked("ended").alias("ended"), marked("events").alias("event"))
    parsed = parse_stamps(rows, ["file"], "_text", "ts").where(F.col("ts").isNotNull())
    return parsed.drop("_text"), refused


def finish_light(rows: DataFrame, tolerance: float = 1.5) -> DataFrame:
    """Lost decimals, deployment window, event-only rows and edge trim."""
    fixed = fix_scale(rows, "file", "temp", "_t").drop("temp", "scale_note").withColumnRenamed("_t", "temp")
    inside = deployment_window(fixed, "file", "ts", "temp", ["detached"], ["ended"], ["event"])
    kept = inside.select("file", "line_no", "ts", "temp", "lux")
    return trim_edges(kept, "file", ["ts", "line_no"], "temp", "ts", tolerance)


def parse_co2(lines: DataFrame) -> DataFrame:
    """CO2 exports: repeated headers and misshapen rows skipped, the corrected
    column preferred, first reading per instant."""
    text = F.trim("line")
    is_header = F.startswith(F.lower(text), F.lit("measurement type"))
    work = _header_of(lines.where(text != ""), is_header)
    cells = F.transform(F.split("line", ","), lambda x: F.trim(x))
    head = F.transform(F.split(F.col("_h.line"), ","), lambda x: F.trim(x))
    work = work.where(~is_header & (F.col("line_no") > F.col("_h.no"))).select("file", "line_no", cells.alias("_c"), head.alias("_n"))
    work = work.where(F.size("_c") == F.size("_n"))

    def position(pattern: str) -> Column:
        return F.array_position(F.transform("_n", lambda x: F.rlike(F.lower(x), F.lit(pattern))), True).cast("int")

    def cell(at: Column) -> Column:
        return F.try_element_at("_c", F.when(at > 0, at))

    corrected, plain = position(r"corrected\s+dis+olved\s+co2"), position(r"^co2 \(ppm\)$")
    value = cell(F.when(corrected > 0, corrected).otherwise(plain)).try_cast("double")
    parts = [cell(F.array_position("_n", n).cast("int")).try_cast("double") for n in ("Year", "Month", "Day", "Hour", "Minute", "Second")]
    ts = F.try_make_timestamp_ntz(*[p.cast("int") for p in parts[:5]], parts[5])
    rows = work.select("file", "line_no", ts.alias("ts"), value.alias("co2")).where(F.col("ts").isNotNull() & F.col("co2").isNotNull())
    return rows.groupBy("file", "ts").agg(F.min_by("co2", "line_no").alias("co2"))


def classify(lines: DataFrame) -> DataFrame:
    """Instrument family of each raw file from its first 40 lines."""
    low = F.lower("line")
    g = lines.where(F.col("line_no") < 40).groupBy("file").agg(
        F.bool_or(F.rlike(low, F.lit("seaguard|aanderaa"))).alias("_s"),
        F.bool_or(F.rlike(low, F.lit("plot title|hoboware"))).alias("_h"),
        F.bool_or(F.rlike(low, F.lit(TIME_HEADER))).alias("_t"),
        F.bool_or(F.rlike(low, F.lit("intensity|intensidade|lum/ft|lux"))).alias("_l"))
    return g.select("file", F.when(F.col("_s"), "Seaguard").when(F.col("_h") | (F.col("_t") & F.col("_l")), "HOBO").alias("instrument"))
