"""Qualification of many series at once: clean, test, roll up, lay out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelint.functions import seawater
from tidelint.operators import light as li
from tidelint.operators import preprocess as pp
from tidelint.operators.currents import current_flags
from tidelint.operators.ordering import Position, attach, ordered
from tidelint.operators.qc_tests import CurrentLimits, c
from tidelint.operators.timejoin import interpolate
from tidelint.plans import layouts
from tidelint.plans.criteria import REGIONS, VARIABLES, Criteria
from tidelint.plans.test_plan import (light_logger_plan, mooring_plan, profile_plan, rollup, run_plan)

SERIES, SITE, TIME, SAMPLE = "series_id", "Site", "Datetime", "Sample number"


def region_table(spark: SparkSession) -> DataFrame:
    """Region, latitude and longitude: six fixed rows."""
    return spark.createDataFrame(list(REGIONS), "region string, latitude double, longitude double")


def places_of(regions: DataFrame, site: str = SITE) -> DataFrame:
    """(site, latitude, longitude) from the region of each site (``site``, ``region``)."""
    return regions.join(region_table(regions.sparkSession), "region").select(site, "latitude", "longitude")


def latitude_of(region: str) -> float:
    return {name: lat for name, lat, _lon in REGIONS}[region]


def prepare_scalar(df: DataFrame, criteria: Criteria, gmt: bool, profile: bool, row: str,
                   co2: DataFrame | None = None, places: DataFrame | None = None) -> DataFrame:
    """Local time, CO2 merge, depth, non-physical values, surface cut.

    ``places`` (Site, ``latitude``) gives the depth at each site its own
    latitude; sites that are not in it take that of the criteria."""
    if gmt:
        df = pp.shift_hours(df, -3, TIME)
    if co2 is not None:
        # the CO2 clock is local already and never shifted
        df = interpolate(df, co2, SERIES, {"co2": "CO2 Level (ppm)"}, "bracket", ts=TIME, tie=row)
    df = pp.drop_secondary_temperatures(df)
    if pp.has_only_pressure(df):
        name = next(n for n in df.columns if "pressure" in n.lower())
        latitude = F.lit(float(criteria.latitude))
        if places is not None:
            df = attach(df, places.select(SITE, F.col("latitude").alias("_latitude")), SITE)
            latitude = F.coalesce("_latitude", latitude)
        df = df.withColumn("Depth (m)", seawater.depth_from_pressure(c(name), latitude)).drop("_latitude")
    df = ordered(df, SERIES, row).scan(_n=Position()).rows
    df = df.withColumn(SAMPLE, F.col("_n") + 1).drop("_n")
    values = [n for n, t in df.dtypes if t == "double"]
    df = pp.clean_below_zero(df, {n: pp.zero_rule(n, criteria.environment) for n in values})
    return pp.surface_cut(df, "Depth (m)", values) if profile and "Depth (m)" in df.columns else df


def qualify_scalar(df: DataFrame, criteria: Criteria | None = None, profile: bool = False, gmt: bool = True,
                   co2: DataFrame | None = None, remove_bad: bool = False, remove_suspect: bool = False,
                   row: str = "line_no", places: DataFrame | None = None) -> DataFrame:
    """Qualify scalar series with canonical column names.

    ``row`` is the recording order inside a series. The result has the fixed
    layout, the flag string and one rollup flag per variable.
    """
    criteria = criteria or Criteria()
    df = prepare_scalar(df, criteria, gmt, profile, row, co2, places)
    plan = profile_plan() if profile else mooring_plan()
    columns = {k: name for k, (name, _s, _e) in VARIABLES.items() if name in df.columns}
    depth = "Depth (m)" if "Depth (m)" in df.columns else None
    flagged = run_plan(df, plan, columns, SERIES, [SAMPLE], TIME, criteria, depth)
    rolled = layouts.remove_flagged(rollup(flagged, plan), layouts.FLAG_OF, remove_bad, remove_suspect)
    return _published(rolled, layouts.SCALAR_LAYOUT)


def qualify_light(df: DataFrame, criteria: Criteria | None = None, mode: str = "adaptive",
                  remove_bad: bool = False, remove_suspect: bool = False,
                  places: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Qualify light/temperature series (``ts``, ``temp``, ``lux``).

    Returns the qualified table and one verdict per series: clock phase and
    light window. ``mode`` is ``adaptive`` or ``fixed``; ``places`` (Site,
    ``latitude``) corrects the sky over each site.
    """
    criteria = criteria or Criteria()
    df = ordered(df, SERIES, ["ts", "line_no"]).scan(_n=Position()).rows
    df = df.withColumns({SAMPLE: F.col("_n") + 1}).drop("_n")
    df = pp.clean_below_zero(df, {"temp": ("positive", 0.0), "lux": ("light", 0.0)})
    plan = light_logger_plan()
    flagged = run_plan(df, plan, {"T": "temp"}, SERIES, [SAMPLE], "ts", criteria, logger=True)
    phase = li.clock_phase(df, SERIES)
    if mode == "fixed":
        window = li.fixed_cutoff(df, SERIES, days=criteria.light_fixed_days)
    else:
        own = df.select(SERIES, SITE).distinct().join(places, SITE).select(SERIES, "latitude") if places is not None else None
        window = li.fouling_baseline(df, SERIES, places=own, baseline_days=criteria.light_baseline_days,
                                     cutoff_fraction=criteria.light_cutoff_fraction,
                                     sustain_days=criteria.light_sustain_days, latitude=criteria.latitude)
    flagged = li.light_flag(flagged, window, SERIES)
    rolled = rollup(flagged, plan).withColumnsRenamed({"ts": TIME, "temp": "Temperature (degC)", "lux": "Luminosity (lux)"})
    rolled = layouts.remove_flagged(rolled, layouts.FLAG_OF, remove_bad, remove_suspect)
    return _published(rolled, layouts.LIGHT_LAYOUT), phase.join(window, SERIES, "left")


def qualify_currents(df: DataFrame, columns: dict[str, str], limits: CurrentLimits | None = None,
                     gmt: bool = True, reviewed: bool = False) -> DataFrame:
    """Qualify current cells: a projection, so streams pass through as well."""
    if gmt:
        df = pp.shift_hours(df, -3, TIME)
    return current_flags(df, columns, limits, reviewed=reviewed)


def _published(df: DataFrame, layout: tuple[str, ...]) -> DataFrame:
    return layouts.ordered_layout(df, (SERIES, *layout))
