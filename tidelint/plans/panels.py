"""The rows behind each chart; drawing them is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelint.functions import seawater
from tidelint.functions.timespec import micros
from tidelint.operators import light as li
from tidelint.operators.ordering import PIECE, Cuts, FirstAfter, Last, Next, attach, attach_aggregates, measured, ordered
from tidelint.operators.preprocess import drop_null_repeats, present_parameters
from tidelint.operators.qc_tests import c
from tidelint.operators.reports import unpivot
from tidelint.operators.selection import (clock_window, first_midnight_hours, gap_nodes, semester,
                                          select_rows, time_window)
from tidelint.operators.stats import group_quantiles
from tidelint.operators.trends import fit, series_trend

TIE = "sample_no"


def valid_interval(df: DataFrame, keys, by, value: str, cuts: Cuts | None = None) -> DataFrame:
    """Rows between the first and the last reading of each series."""
    if PIECE in df.columns and cuts is not None and cuts.few(keys):
        # stored rows of few series: their ends are one small table
        at = F.struct(*[c(n) for n in by])
        reading = F.when(c(value).isNotNull(), at)
        ends = attach_aggregates(df, keys, {"_begin": F.min(reading), "_end": F.max(reading)}, cuts, light=True)
        return ends.where(at.between(F.col("_begin"), F.col("_end"))).select(*[c(x) for x in df.columns])
    s = ordered(df, keys, by, cuts).scan(_before=Last(F.when(c(value).isNotNull(), F.lit(1))),
                                   _behind=FirstAfter(F.when(c(value).isNotNull(), F.lit(1))))
    return s.df.where(F.col("_before").isNotNull() & F.col("_behind").isNotNull()).select(*[c(x) for x in df.columns])


def with_gap_nodes(df: DataFrame, keys, value: str = "value", cuts: Cuts | None = None) -> DataFrame:
    """Trimmed series with a null point after each sample before a long gap."""
    by = ["ts", TIE]
    trimmed = valid_interval(df, keys, by, value, cuts)
    s = ordered(trimmed, keys, by, cuts).scan(_next=Next("ts"))
    return gap_nodes(s.df, F.col("_next"), "ts", value).select(*[c(x) for x in df.columns])


def _unpivoted(rows: DataFrame, variables: list[str]) -> tuple[DataFrame, Cuts]:
    """Series of site, semester and variable, cut as all readings of their site's semester are.

    Rows of long series get their piece here, once for all variables, and keep
    it through the operators that follow: these rows are dealt and sorted once.
    """
    slices = ["site", "semester"]
    cuts = measured(rows, slices, ["ts", TIE])
    laid = cuts.numbered(rows)
    long = unpivot(laid, [*slices, "ts", TIE, *([] if cuts.none else [PIECE])], variables)
    return long, cuts.crossed("var", variables)


def _fitted(df: DataFrame, keys: list[str], degree: int | None, unfitted: list[str], cuts: Cuts) -> DataFrame:
    if degree is None:
        return df.drop(PIECE).withColumn("fit", F.lit(None).cast("double"))
    return series_trend(df, keys, ["ts", TIE], "value", degree, only=~F.col("var").isin(list(unfitted)), keep_all=True, cuts=cuts)


def site_parameters(df: DataFrame, variables: list[str], sites: list[str], year: int, start=None, end=None,
                    degree: int | None = None, unfitted: tuple[str, ...] = ("P",)) -> DataFrame:
    """Every parameter at every site per semester, with its tendency. Pressure
    is dominated by the tide and never fitted."""
    rows = time_window(select_rows(df, sites, [year]), start, end)
    rows = rows.withColumn("semester", semester(F.col("ts")))
    long, cuts = _unpivoted(rows, variables)
    long = present_parameters(long, ["site", "semester"], cuts=cuts)
    keys = ["site", "semester", "var"]
    nodes = with_gap_nodes(drop_null_repeats(long, keys, "ts", "value", cuts), keys, cuts=cuts)
    return _fitted(nodes, keys, degree, list(unfitted), cuts)


def parameter_across_sites(df: DataFrame, variables: list[str], sites: list[str], year: int, start=None,
                           end=None, degree: int | None = None, unfitted: tuple[str, ...] = ("P",)) -> DataFrame:
    """One parameter over all sites on hours since each site's first midnight."""
    rows = select_rows(df, sites, [year]).withColumn("semester", semester(F.col("ts")))
    keys = ["site", "semester", "var"]
    long, cuts = _unpivoted(rows, variables)
    long = drop_null_repeats(long, keys, "ts", "value", cuts)
    long = first_midnight_hours(long, keys, cuts=cuts)
    if start is not None and end is not None:
        # the window keeps its day offset from the semester's first midnight
        anchors = rows.groupBy("semester").agg(F.date_trunc("day", F.min("ts")).cast("timestamp_ntz").alias("_zero"))
        lo, hi = [(micros(F.lit(t).cast("timestamp_ntz")) - micros(F.col("_zero"))) / 3.6e9 for t in (start, end)]
        long = attach(long, anchors, "semester").where(F.col("hours").between(lo, hi)).drop("_zero")
    origin = long.groupBy(*keys).agg(F.min(micros(F.col("ts")) - (F.col("hours") * 3.6e9)).cast("long").alias("_origin"))
    nodes = with_gap_nodes(long.drop("hours"), keys, cuts=cuts)
    nodes = attach(nodes, origin, keys, cuts)
    nodes = nodes.withColumn("hours", (micros(F.col("ts")) - F.col("_origin")) / 3.6e9).drop("_origin")
    return _fitted(nodes, keys, degree, list(unfitted), cuts)


def profile_parameters(df: DataFrame, variables: list[str], depth: str, sites: list[str], year: int,
                       start=None, end=None, degree: int = 1) -> DataFrame:
    """Parameters against depth per site and semester, with their tendency."""
    rows = time_window(select_rows(df, sites, [year]), start, end)
    rows = rows.withColumn("semester", semester(F.col("ts"))).withColumn("_z", c(depth))
    cuts = measured(rows, ["site", "semester"], ())
    long = present_parameters(unpivot(rows, ["site", "semester", "ts", TIE, "_z"], variables), ["site", "semester"], cuts=cuts)
    keys = ["site", "semester", "var"]
    long = valid_interval(drop_null_repeats(long, keys, "ts", "value", cuts), keys, ["ts", TIE], "value", cuts)
    both = F.col("value").isNotNull() & F.col("_z").isNotNull()
    return fit(long, keys, F.col("_z"), F.col("value"), degree, used=both, cuts=cuts).withColumnRenamed("_z", "depth")


def light_at_site(df: DataFrame, sites: list[str], years: list[int] | None = None, start=None, end=None,
                  degree: int | None = None) -> DataFrame:
    """Temperature with its replicate bars, light with its daily peak, and the
    start of the fouling window, over all years in one series per site."""
    rows = time_window(select_rows(df, sites, years), start, end)
    temp = rows.where(F.col("temp").isNotNull()).select("site", "ts", TIE, F.lit("temp").alias("var"), F.col("temp").alias("value"),
                                                         F.when(F.col("spread") > 0, F.col("spread") / 2).alias("half_bar"))
    lux = rows.where(F.col("lux").isNotNull()).select("site", "ts", TIE, F.lit("lux").alias("var"), F.col("lux").alias("value"),
                                                       F.lit(None).cast("double").alias("half_bar"))
    if degree is not None:
        temp = series_trend(temp, "site", ["ts", TIE], "value", degree)
    else:
        temp = temp.withColumn("fit", F.lit(None).cast("double"))
    peak = li.daily_peak(rows, "site").select("site", F.col("day").alias("ts"), F.lit(None).cast("long").alias(TIE), F.lit("daily_peak").alias("var"),
                                              F.col("peak").alias("value"), F.lit(None).cast("double").alias("half_bar"), F.lit(None).cast("double").alias("fit"))
    out = temp.unionByName(lux.withColumn("fit", F.lit(None).cast("double"))).unionByName(peak)
    return attach(out, li.cutoff_start(rows, "site"), "site")


def light_across_sites(df: DataFrame, sites: list[str], years: list[int] | None = None, start=None, end=None,
                       degree: int | None = None) -> DataFrame:
    """The same on hours since each site's first midnight."""
    rows = select_rows(df, sites, years)
    hours = first_midnight_hours(rows, "site")
    if start is not None and end is not None:
        hours = clock_window(hours, rows.agg(F.min("ts").alias("first")), start, end)
    origin = rows.groupBy("site").agg(F.date_trunc("day", F.min("ts")).cast("timestamp_ntz").alias("_origin"))
    panel = light_at_site(hours.drop("hours"), sites, None, None, None, degree)
    out = attach(panel, origin, "site")

    def since(t):
        return (micros(t) - micros(F.col("_origin"))) / 3.6e9

    return out.withColumns({"hours": since(F.col("ts")), "cutoff_hours": since(F.col("cutoff"))}).drop("_origin")


def ts_points(df: DataFrame, salinity: str, temperature: str, pressure: str) -> DataFrame:
    """Temperature-salinity points with their derived columns, per semester."""
    rows = df.withColumn("semester", semester(F.col("ts")))
    return seawater.with_seawater(rows, c(salinity), c(temperature), c(pressure))


def ts_bounds(points: DataFrame, keys: list[str], x: str, y: str, flags: list[str],
              min_x: float = 0.30, min_y: float = 1.50, known: tuple[str, ...] = ()) -> DataFrame:
    """Robust view limits: the 0.5 to 99.5 percentile of good points (of all
    when none is good), opened to a minimum span and padded. Points need the
    columns ``known``, else both axes."""
    good = F.lit(True)
    for f in flags:
        good = good & (F.col(f) == 1)
    finite = F.lit(True)
    for name in known or (x, y):
        finite = finite & c(name).isNotNull()
    marked = attach_aggregates(points.withColumns({"_x": c(x), "_y": c(y), "_good": F.coalesce(good & finite, F.lit(False)), "_fin": finite}),
                               keys, {"_any": F.max(F.col("_good").cast("int"))})
    used = marked.where(F.when(F.col("_any") == 1, F.col("_good")).otherwise(F.col("_fin")))
    q = group_quantiles(used, keys, {"_x0": (F.col("_x"), 0.005), "_x1": (F.col("_x"), 0.995),
                                     "_y0": (F.col("_y"), 0.005), "_y1": (F.col("_y"), 0.995)})

    def opened(lo, hi, span, share):
        mid = 0.5 * (lo + hi)
        tight = hi - lo < span
        a, b = F.when(tight, mid - span / 2.0).otherwise(lo), F.when(tight, mid + span / 2.0).otherwise(hi)
        return a - share * (b - a), b + share * (b - a)

    x0, x1 = opened(F.col("_x0"), F.col("_x1"), min_x, 0.05)
    y0, y1 = opened(F.col("_y0"), F.col("_y1"), min_y, 0.10)
    return q.select(*keys, x0.alias("x_min"), x1.alias("x_max"), y0.alias("y_min"), y1.alias("y_max"))


def density_grid(bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Density contours over the view: 0.1 steps of salinity by 1 degree."""
    nx = F.greatest(F.lit(3), F.rint((F.col("x_max") - F.col("x_min")) / 0.1 + 1).cast("int"))
    ny = F.greatest(F.lit(3), F.rint((F.col("y_max") - F.col("y_min")) + 1).cast("int"))

    def spaced(i, n):
        # n evenly spaced numbers from 1 to n - 1
        return F.lit(1.0) + (n - 2) * i / (n - 1)

    g = bounds.withColumns({"_nx": nx, "_ny": ny})
    g = g.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_nx") - 1)))
    g = g.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_ny") - 1)))
    g = g.withColumns({"salinity": spaced(F.col("_i"), F.col("_nx")) * 0.1 + F.col("x_min"),
                       "temperature": spaced(F.col("_j"), F.col("_ny")) + F.col("y_min")})
    g = seawater.with_density(g, F.col("salinity"), F.col("temperature"), F.lit(0.0), "rho")
    return g.select(*keys, "salinity", "temperature", (F.col("rho") - 1000.0).alias("sigma"))


#: Axes of the temperature-salinity diagram by mode.
TS_AXES = {"conservative": ("sa", "ct"), "potential": (None, "pt")}


def ts_diagram(points: DataFrame, keys: list[str], salinity: str, flags: list[str], mode: str = "conservative") -> DataFrame:
    """Points of the diagram and the nodes of its density grid.

    ``points`` come from ``ts_points``. The conservative mode draws absolute
    salinity and conservative temperature, the potential mode practical
    salinity (the column ``salinity``) and potential temperature.
    """
    x, y = TS_AXES[mode]
    x = x or salinity
    grid = density_grid(ts_bounds(points, keys, x, y, flags, known=("sa", "ct")), keys)
    drawn = points.where(c(x).isNotNull() & c(y).isNotNull()).select(
        *keys, F.lit("point").alias("kind"), c(x).alias("x"), c(y).alias("y"), F.lit(None).cast("double").alias("sigma"))
    return drawn.union(grid.select(*keys, F.lit("node").alias("kind"), F.col("salinity").alias("x"), F.col("temperature").alias("y"), "sigma"))


def single_variable(df: DataFrame, value: str, keys: list[str], start=None, end=None) -> DataFrame:
    """One variable of each product with whole-day axis limits."""
    rows = time_window(df, start, end).where(c(value).isNotNull())
    rows = attach_aggregates(rows, keys, {"_a": F.min("ts"), "_z": F.max("ts")})
    low = F.date_trunc("day", "_a").cast("timestamp_ntz")
    floor = F.date_trunc("day", "_z").cast("timestamp_ntz")
    high = F.when(floor < F.col("_z"), floor + F.expr("INTERVAL 1 DAY")).otherwise(floor)
    return rows.withColumns({"axis_from": low, "axis_to": high}).drop("_a", "_z")
