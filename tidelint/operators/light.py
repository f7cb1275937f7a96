"""Light channel: clock phase, fouling window and daily peaks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelint.functions.flags import BAD, GOOD, MISSING, UNKNOWN, flag
from tidelint.functions.solar import clear_sky_factor, yearly_maximum_of
from tidelint.functions.timespec import micros
from tidelint.operators.ordering import Position, attach, attach_aggregates, ordered
from tidelint.operators.qc_tests import c

# Thresholds of the clock-phase verdict.
MIN_STAMPS = 50
MIN_LIT = 50
MAX_REPEATS = 0.10
WARN_OFFSET_H = 4.0
BAD_OFFSET_H = 8.0
SHIFT_H = 12


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / 60.0


def circular_hour(x: Column, y: Column) -> Column:
    """Hour of a summed (cos, sin) vector."""
    return F.pmod(F.atan2(y, x) * 24.0 / (2 * math.pi), F.lit(24.0))


def hours_from(hour: Column, reference: float) -> Column:
    """Distance on the 24-hour circle."""
    return F.abs(F.pmod(hour - reference + 12.0, F.lit(24.0)) - 12.0)


def clock_phase(df: DataFrame, keys, ts: str = "ts", light: str = "lux") -> DataFrame:
    """One verdict per series: is the clock right, shifted, or collapsed onto
    12 hours? One aggregation plus an exact distinct count of the stamps."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    t, v = F.col(ts), c(light)
    lit = t.isNotNull() & (v > 0)
    w = F.when(lit, v)
    angle = 2 * math.pi / 24.0 * hour_of_day(t)
    g = df.groupBy(*keys).agg(
        F.count(ts).alias("stamps"), F.count_distinct(t).alias("_distinct"),
        F.max(F.hour(t)).alias("_max_hour"), F.count(w).alias("lit"),
        F.sum(w * F.cos(angle)).alias("_x"), F.sum(w * F.sin(angle)).alias("_y"),
        F.sum(F.when((F.hour(t) >= 6) & (F.hour(t) < 18), w)).alias("_day"), F.sum(w).alias("_all"))
    repeats = 1 - F.col("_distinct") / F.col("stamps")
    collapsed = ((F.col("stamps") >= MIN_STAMPS) & (F.col("_max_hour") <= 12) & (repeats > MAX_REPEATS))
    evaluable = (F.col("lit") >= MIN_LIT) & ~collapsed & ~((F.col("_x") == 0) & (F.col("_y") == 0))
    g = g.select(*keys, "stamps", "lit", F.coalesce(collapsed, F.lit(False)).alias("collapsed"),
                 F.coalesce(evaluable, F.lit(False)).alias("evaluable"), "_x", "_y",
                 (F.coalesce("_day", F.lit(0.0)) / F.col("_all")).alias("_frac"))
    ok = F.col("evaluable")
    peak = F.when(ok, circular_hour(F.col("_x"), F.col("_y")))
    g = g.select(*keys, "stamps", "lit", "collapsed", "evaluable", peak.alias("peak_hour"),
                 F.when(ok, F.col("_frac")).alias("daylight_fraction"))
    offset = hours_from(F.col("peak_hour"), 12.0)
    return g.withColumns({
        "offset_h": offset,
        "shift_h": F.when(offset >= BAD_OFFSET_H, F.lit(SHIFT_H)),
        "anomalous": F.coalesce((offset >= WARN_OFFSET_H) & (offset < BAD_OFFSET_H), F.lit(False))})


def daily_peak(df: DataFrame, keys, ts: str = "ts", value: str = "lux", how: str = "max") -> DataFrame:
    """Daily maximum or mean; days without a value do not appear."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    agg = {"max": F.max, "mean": F.avg}[how]
    day = F.date_trunc("day", F.col(ts)).cast("timestamp_ntz").alias("day")
    return df.where(c(value).isNotNull()).groupBy(*keys, day).agg(agg(c(value)).alias("peak"))


def fixed_cutoff(df: DataFrame, keys, ts: str = "ts", days: int = 60) -> DataFrame:
    """Start plus ``days``; null when the series ends before that."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    g = df.groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_z"))
    cut = F.col("_a") + F.expr(f"INTERVAL {days} DAYS")
    return g.select(*keys, F.when(F.col("_z") >= cut, cut).alias("cutoff"), F.lit(True).alias("evaluable"))


def fouling_baseline(df: DataFrame, keys, ts: str = "ts", light: str = "lux", baseline_days: int = 7,
                     cutoff_fraction: float = 0.5, sustain_days: int = 3,
                     recovery_fraction: float = 0.2, latitude: float | None = None,
                     places: DataFrame | None = None) -> DataFrame:
    """Where the light of each series starts its final decline.

    The rows are reduced to one peak per day first; only days are ordered.
    ``places`` (keys, ``latitude``) gives each series its own latitude; a series
    without one takes ``latitude``, and is not corrected where that is None.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    peaks = daily_peak(df, keys, ts, light)
    sky = clear_sky_factor(F.col("day"), latitude) if latitude is not None else F.lit(1.0)
    if places is not None:
        peaks = attach(peaks, places.select(*keys, F.col("latitude").alias("_lat"), yearly_maximum_of(F.col("latitude")).alias("_top")), keys)
        sky = F.coalesce(clear_sky_factor(F.col("day"), F.col("_lat"), maximum=F.col("_top")), sky)
    work = F.col("peak") / sky
    s = ordered(peaks.withColumn("_w", work), keys, "day").scan(_rn=Position())
    rows = attach_aggregates(s.rows, keys, {
        "_days": F.count(F.lit(1)), "_base": F.max(F.when(F.col("_rn") < baseline_days, F.col("_w")))}, s.cuts)
    limit = cutoff_fraction * F.col("_base")
    below = F.col("_w") < limit
    rows = rows.withColumn("_below", below)
    rows = attach_aggregates(rows, keys, {
        "_last_ge": F.max(F.when(~F.col("_below"), F.col("_rn"))),
        "_first_lt": F.min(F.when(F.col("_below"), F.col("_rn")))}, s.cuts)
    after = F.col("_rn") >= F.col("_first_lt")
    start = F.coalesce(F.col("_last_ge") + 1, F.lit(0))
    g = rows.groupBy(*keys).agg(
        F.max("_days").alias("days"), F.max("_base").alias("_base"), F.max("_last_ge").alias("_last"),
        F.max("_first_lt").alias("_first"),
        F.min(F.when(F.col("_rn") == start, F.col("day"))).alias("_cut"),
        F.count_if(after).alias("_na"), F.count_if(after & ~F.col("_below")).alias("_nr"))
    base = F.col("_base")
    ok = F.coalesce((F.col("days") >= baseline_days + sustain_days) & (base > 0), F.lit(False))
    tail = F.col("days") - 1 - F.col("_last")
    cutoff = F.when(F.col("_first").isNull(), F.lit(None)).when(
        F.col("_last").isNull() | (tail >= sustain_days), F.col("_cut"))
    dips = F.col("_first") < F.col("_last")
    frac = F.when(ok & dips, F.col("_nr") / F.col("_na")).otherwise(F.lit(0.0))
    all_series = df.select(*keys).distinct()
    return attach(all_series, g, keys).select(
        *keys, F.coalesce(F.col("days"), F.lit(0)).alias("days"), F.coalesce(ok, F.lit(False)).alias("evaluable"),
        F.when(ok, base).alias("baseline"), F.when(ok, cutoff_fraction * base).alias("threshold"),
        F.when(ok, cutoff).alias("cutoff"), frac.alias("recovery_fraction"),
        (frac > recovery_fraction).alias("recovers"))


def light_flag(df: DataFrame, verdict: DataFrame, keys, ts: str = "ts", light: str = "lux",
               out: str = "f_light_lux") -> DataFrame:
    """Apply a light window: ``verdict`` has ``cutoff`` and ``evaluable`` per series."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    work = attach(df, verdict.select(*keys, F.col("cutoff").alias("_cut"), F.col("evaluable").alias("_ev")), keys)
    return work.select(*[c(x) for x in df.columns], F.when(c(light).isNull(), flag(MISSING))
                       .when(~F.coalesce(F.col("_ev"), F.lit(False)), flag(UNKNOWN))
                       .when(F.col(ts) >= F.col("_cut"), flag(BAD)).otherwise(flag(GOOD)).alias(out))


def threshold_curve(peaks: DataFrame, verdict: DataFrame, keys, latitude: float) -> DataFrame:
    """Daily peaks beside the threshold mapped back to raw light."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rows = attach(peaks, verdict.select(*keys, "threshold", "cutoff"), keys)
    return rows.withColumn("raw_threshold", F.col("threshold") * clear_sky_factor(F.col("day"), latitude))


def temperature_peak_hour(df: DataFrame, keys, ts: str = "ts", value: str = "temp") -> DataFrame:
    """Circular mean of the hour of each day's warmest sample; null below 20
    days of at least 8 samples."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    t = F.col(ts)
    days = df.where(c(value).isNotNull()).groupBy(*keys, F.to_date(t).alias("_day")).agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(t, F.struct(-c(value), micros(t))).alias("_at"))
    angle = 2 * math.pi / 24.0 * hour_of_day(F.col("_at"))
    g = days.where(F.col("_n") >= 8).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"), F.sum(F.cos(angle)).alias("_x"), F.sum(F.sin(angle)).alias("_y"))
    return g.select(*keys, "days", F.when(F.col("days") >= 20, circular_hour(F.col("_x"), F.col("_y"))).alias("peak_hour"))


def cutoff_start(df: DataFrame, keys, ts: str = "ts", flag_column: str = "Flag_lux") -> DataFrame:
    """First instant flagged as fouled."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.where(F.col(flag_column) == BAD).groupBy(*keys).agg(F.min(ts).alias("cutoff"))


def circular_std(values: Column) -> tuple[Column, Column]:
    """Mean cosine and sine aggregates of directions in degrees."""
    return F.avg(F.cos(F.radians(values))), F.avg(F.sin(F.radians(values)))


def spread_degrees(mean_cos: Column, mean_sin: Column) -> Column:
    """Circular standard deviation in degrees."""
    return F.degrees(F.sqrt(-2 * F.log(F.least(F.sqrt(mean_cos * mean_cos + mean_sin * mean_sin), F.lit(1.0)))))


def direction_change(now: Column, before: Column) -> Column:
    """Smallest turn between two directions, in degrees."""
    return F.abs(F.pmod(now - before + 540, F.lit(360.0)) - 180)


