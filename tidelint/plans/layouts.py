"""Fixed output layouts of qualified tables, and how to tell them apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelint.functions.flags import BAD, SUSPECT
from tidelint.functions.rounding import round_even
from tidelint.operators.qc_tests import c

# Columns of a qualified scalar table, in order.
SCALAR_LAYOUT = (
    "Sample number", "Datetime", "Site", "Depth (m)", "Temperature (degC)", "Salinity (PSU)",
    "Conductivity (mS/cm)", "Pressure (dbar)", "Density (kg/m3)", "CO2 Level (ppm)",
    "O2 level (uM)", "O2 content (mg/L)", "PAR (umol/m2/s)", "Turbidity (FTU)", "TSS (mg/L)",
    "Chlorophyll (ug/L)", "pH", "Dissolved organic matter (ppb)", "Luminosity (lux)",
    "Soundspeed (m/s)", "Battery voltage (V)", "Flag", "Flag_T", "Flag_S", "Flag_C", "Flag_P",
    "Flag_pH", "Flag_chl", "Flag_O2", "Flag_org", "Flag_tur", "Flag_PAR", "Flag_CO2", "Flag_lux",
    "Flag_dens", "Flag_depth")
# Columns of a qualified light/temperature table, in order.
LIGHT_LAYOUT = (
    "Sample number", "Datetime", "Site", "Temperature (degC)", "Temperature spread (degC)",
    "Luminosity (lux)", "Battery voltage (V)", "Flag", "Flag_T", "Flag_lux")
# Which rollup flag speaks for a data column.
FLAG_OF = {
    "Temperature (degC)": "Flag_T", "Salinity (PSU)": "Flag_S", "Conductivity (mS/cm)": "Flag_C",
    "Pressure (dbar)": "Flag_P", "pH": "Flag_pH", "Chlorophyll (ug/L)": "Flag_chl",
    "O2 level (uM)": "Flag_O2", "O2 content (mg/L)": "Flag_O2", "CO2 Level (ppm)": "Flag_CO2",
    "Dissolved organic matter (ppb)": "Flag_org", "Turbidity (FTU)": "Flag_tur",
    "TSS (mg/L)": "Flag_tur", "PAR (umol/m2/s)": "Flag_PAR", "Luminosity (lux)": "Flag_lux",
    "Density (kg/m3)": "Flag_dens", "Depth (m)": "Flag_depth"}
# Derived columns keep their values: no removal is defined for them.
_NEVER_REMOVED = {"Density (kg/m3)", "Depth (m)"}
_TEXT = {"Site", "Flag"}


def ordered_layout(df: DataFrame, layout: tuple[str, ...]) -> DataFrame:
    """Fixed columns in fixed order: missing ones null, unknown ones dropped,
    flags only where a test wrote them, doubles rounded half-even to 4."""
    types = dict(df.dtypes)
    out = []
    for name in layout:
        if name not in types:
            if not name.startswith("Flag_"):
                out.append(F.lit(None).cast("string" if name in _TEXT else "double").alias(name))
        elif types[name] in ("double", "float"):
            out.append(round_even(c(name), 4).alias(name))
        else:
            out.append(c(name))
    return df.select(*out)


def remove_flagged(df: DataFrame, columns: dict[str, str], bad: bool, suspect: bool) -> DataFrame:
    """Blank values by their own variable's flag; rows and flags stay."""
    out = {}
    for name, flag_name in columns.items():
        if name in _NEVER_REMOVED or flag_name not in df.columns or name not in df.columns:
            continue
        drop = F.lit(False)
        if bad:
            drop = drop | (F.col(flag_name) == BAD)
        if suspect:
            drop = drop | (F.col(flag_name) == SUSPECT)
        out[name] = F.when(~F.coalesce(drop, F.lit(False)), c(name))
    return df.withColumns(out) if out else df


def layout_of(columns) -> str:
    """doppler, hobo or tscp; the last is also the default."""
    names = set(columns)
    if names & {"Flag_cur", "Horizontal speed (cm/s)"}:
        return "doppler"
    if "Luminosity (lux)" in names and "Salinity (PSU)" not in names:
        return "hobo"
    return "tscp"


# Columns that only a scalar table has.
_SCALAR_MARKERS = {"Salinity (PSU)", "Conductivity (mS/cm)", "Pressure (dbar)", "Density (kg/m3)",
                   "Dissolved Oxygen (mg/L)", "Chlorophyll (ug/L)"}


def known_instrument(columns) -> str | None:
    """Instrument of a qualified header, or None when it proves nothing."""
    names = set(columns)
    if not {"Datetime", "Site"} <= names:
        return None
    if {"Flag_cur", "Horizontal speed (cm/s)"} <= names:
        return "Doppler"
    if {"Temperature (degC)", "Luminosity (lux)"} <= names:
        return "HOBO"
    if "Flag" in names and names & _SCALAR_MARKERS:
        return "Seaguard"
    return None


def filled_columns(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, header, n): of each group the columns that hold a value, and its rows."""
    held = [F.when(F.count(c(n)) > 0, F.lit(n)) for n in names]
    return df.groupBy(*keys).agg(F.array_compact(F.array(*held)).alias("header"), F.count(F.lit(1)).alias("n"))


def _all_in(header: Column, names) -> Column:
    return F.size(F.array_intersect(header, F.array(*[F.lit(n) for n in sorted(names)]))) == len(names)


def _any_in(header: Column, names) -> Column:
    return F.arrays_overlap(header, F.array(*[F.lit(n) for n in sorted(names)]))


def layout_column(header: Column) -> Column:
    """``layout_of`` for a column of headers."""
    return (F.when(_any_in(header, {"Flag_cur", "Horizontal speed (cm/s)"}), "doppler")
            .when(_all_in(header, {"Luminosity (lux)"}) & ~_any_in(header, {"Salinity (PSU)"}), "hobo").otherwise("tscp"))


def instrument_column(header: Column) -> Column:
    """``known_instrument`` for a column of headers; null where a header proves nothing."""
    return F.when(_all_in(header, {"Datetime", "Site"}), F.when(_all_in(header, {"Flag_cur", "Horizontal speed (cm/s)"}), "Doppler")
                  .when(_all_in(header, {"Temperature (degC)", "Luminosity (lux)"}), "HOBO")
                  .when(_all_in(header, {"Flag"}) & _any_in(header, _SCALAR_MARKERS), "Seaguard"))
