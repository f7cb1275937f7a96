"""Repairing wrong clocks: swapped AM/PM, collapsed 12-hour clocks, wrong epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelint.functions.timespec import micros
from tidelint.operators.light import clock_phase, hours_from, temperature_peak_hour
from tidelint.operators.ordering import Last, Position, Prev, RunningSum, attach, attach_aggregates, kept, measured, ordered
from tidelint.operators.qc_tests import c

# Gates of the repairs.
MIN_STEP_MATCH = 0.95
MIN_WALK = 4
MAX_NOON_OFFSET_H = 3.0
TEMPERATURE_PEAK_H = 13.7
MAX_TEMPERATURE_OFFSET_H = 5.0
MIN_DAYLIGHT = 0.9
MIN_REGION_CORR = 0.50
MIN_REGION_DAYS = 60
HALF_DAY_S = 43200


def repair_swapped(df: DataFrame, keys, ts: str = "ts", light: str = "lux") -> tuple[DataFrame, DataFrame]:
    """Shift accused series by 12 h; accept only those that are clean after.

    Returns the rows (repaired where accepted) and one verdict per series.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    before = clock_phase(df, keys, ts, light).select(*keys, F.col("shift_h").alias("accused_h"), F.col("stamps").alias("_rows"))
    moved = attach(df, before, keys).withColumn(
        ts, F.when(F.col("accused_h").isNotNull(), F.col(ts) + F.expr("INTERVAL 12 HOURS")).otherwise(F.col(ts)))
    accused = moved.where(F.col("accused_h").isNotNull())
    after = clock_phase(accused, keys, ts, light)
    clean = after.select(*keys, (F.col("shift_h").isNull() & ~F.col("collapsed") & F.col("evaluable")
                                 & (F.col("daylight_fraction") >= MIN_DAYLIGHT)).alias("_clean"), F.col("stamps").alias("_rows_after"))
    verdict = attach(before, clean, keys).select(
        *keys, "accused_h", F.when(F.col("accused_h").isNull(), "sound")
        .when(F.coalesce(F.col("_clean") & (F.col("_rows") == F.col("_rows_after")), F.lit(False)), "repaired")
        .otherwise("refused").alias("verdict"))
    rows = attach(df, verdict, keys)
    fixed = F.when(F.col("verdict") == "repaired", F.col(ts) + F.expr("INTERVAL 12 HOURS")).otherwise(F.col(ts))
    return rows.withColumn(ts, fixed).select(*[c(x) for x in df.columns]), verdict


def wrong_clock_gate(products: DataFrame, verdicts: DataFrame, keys, shift: str = "shift_h") -> DataFrame:
    """Products that may be published: none of their inputs is accused."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return products.join(verdicts.where(F.col(shift).isNotNull()).select(*keys).distinct(), keys, "left_anti")


def walked_clock(df: DataFrame, keys, row: str, ts: str = "ts") -> DataFrame:
    """Two readings of a 12-hour clock without AM/PM: ``am`` starts the first
    date in the morning, ``pm`` in the afternoon.

    Rows are in recording order (``row``) and their dates are right; dates are
    days one after the other, in the order in which they first appear. Every row takes, of the two times
    its own date allows, the one after the row before it that is nearest to one
    sampling interval later (the most common step forward within a date); a
    reading fails at a row that has none (``am_ok``, ``pm_ok``). ``am_step`` and
    ``pm_step`` tell whether a row lies one interval after the one before.

    A row maps the half day of the row before to its own, so it either sets the half day, or keeps or
    changes it. The half day of a row is therefore what the last row that sets
    it says (or the first date's), turned by the number of changes since then: two
    scans, and no walk over a series.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    kept_columns = [c(x) for x in df.columns]
    within = F.pmod(F.hour(ts), F.lit(12)) * 3600 + F.minute(ts) * 60 + F.second(ts)
    day = F.date_trunc("day", F.col(ts)).cast("timestamp_ntz")
    work = df.withColumns({"_w": within.cast("long"), "_day": day})
    cuts = measured(work, keys, row)
    s = ordered(work, keys, row, cuts).scan(_i=Position(), _pw=Prev("_w"), _pd=Prev("_day"))
    rows = attach_aggregates(s.rows, [*keys, "_day"], {"_begins": F.min("_i")}, cuts if cuts.none else None)
    forward = F.col("_w") - F.col("_pw")
    steps = (s.rows.where((F.col("_day") == F.col("_pd")) & (forward > 0)).groupBy(*keys, forward.alias("_step"))
             .agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_at")))
    rows = attach(rows, steps.groupBy(*keys).agg(F.max_by("_step", F.struct("_n", -F.col("_at"))).alias("_interval")), keys)
    later = F.when(F.col("_day") == F.col("_pd"), 0).when(F.col("_begins") == F.col("_i"), 86_400) + forward

    def half_after(half: Column) -> Column:
        """Half day of a row by that of the row before; null where no time is left."""
        early = later - half * HALF_DAY_S
        late = early + HALF_DAY_S
        nearer = F.abs(early - F.col("_interval")) <= F.abs(late - F.col("_interval"))
        return F.when(F.col("_i") > 0, F.when((early > 0) & nearer, 0).when(late > 0, 1))

    rows = rows.withColumns({"_f0": half_after(F.lit(0)), "_f1": half_after(F.lit(1))})
    changes = F.coalesce((F.col("_f0") == 1) & (F.col("_f1") == 0), F.lit(False)).cast("long")
    same = F.coalesce(F.col("_f0"), F.col("_f1")) == F.coalesce(F.col("_f1"), F.col("_f0"))
    s = ordered(rows.withColumn("_change", changes), keys, row, cuts).scan(_changes=RunningSum("_change"))
    sets = F.when(same, (F.coalesce(F.col("_f0"), F.col("_f1")) + F.col("_changes")) % 2)
    s = s.with_columns(_set=sets).scan(_said=Last("_set"), _before=Last("_set", inclusive=False))

    out = []
    for name, seed in (("am", 0), ("pm", 1)):
        half = (F.coalesce("_said", F.lit(seed)) + F.col("_changes")) % 2
        before = (F.coalesce("_before", F.lit(seed)) + F.col("_changes") - F.col("_change")) % 2
        reached = F.when(before == 0, F.col("_f0")).otherwise(F.col("_f1"))
        elapsed = later + (half - before) * HALF_DAY_S
        out += [F.timestamp_add("SECOND", (F.col("_w") + half * HALF_DAY_S).cast("int"), F.col("_day")).alias(name),
                ((F.col("_i") == 0) | reached.isNotNull()).alias(f"{name}_ok"),
                F.coalesce(elapsed == F.col("_interval"), F.lit(False)).alias(f"{name}_step")]
    return s.rows.select(*kept_columns, *out)


def repair_collapsed(df: DataFrame, keys, row: str, ts: str = "ts", light: str = "lux",
                     temperature: str = "temp") -> tuple[DataFrame, DataFrame]:
    """Rebuild 24-hour stamps of collapsed clocks.

    The half day of the first date is chosen by the light (within 3 h of noon),
    else by the hour of the daily temperature maximum (within 5 h of 13.7 h);
    the result must step by its usual interval 95 % of the time. A date whose
    morning rows are missing reads as morning. The gate catches this only where
    such dates are many: a few leave the verdict ``repaired`` and their stamps
    twelve hours early.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    both = kept(walked_clock(df, keys, row, ts))             # judged twice, then rewritten
    walk = both.groupBy(*keys).agg(
        *[(F.bool_and(f"{h}_ok") & (F.count(F.lit(1)) >= MIN_WALK)).alias(f"ok_{h}") for h in ("am", "pm")],
        *[(F.count_if(f"{h}_step") / F.greatest(F.count(F.lit(1)) - 1, F.lit(1))).alias(f"m_{h}") for h in ("am", "pm")])
    # both readings are judged in one pass, as two series
    halves = F.array(*[F.struct(F.lit(h).alias("half"), F.col(h).alias("t")) for h in ("am", "pm")])
    long = both.withColumn("_h", F.explode(halves))
    long = long.select(*keys, light, temperature, F.col("_h.half").alias("half"), F.col("_h.t").alias(ts))
    two = [*keys, "half"]
    phase = clock_phase(long, two, ts, light).select(*two, F.col("offset_h").alias("l"))
    warm = temperature_peak_hour(long, two, ts, temperature).select(
        *two, hours_from(F.col("peak_hour"), TEMPERATURE_PEAK_H).alias("t"))
    judged = attach(phase, warm, two).groupBy(*keys).agg(*[
        F.max(F.when(F.col("half") == h, F.col(x))).alias(f"{x}_{h}") for h in ("am", "pm") for x in ("l", "t")])
    stats = attach(walk, judged, keys)
    # a reading that cannot be walked to its end is no candidate
    stats = stats.withColumns({f"{x}_{h}": F.when(F.col(f"ok_{h}"), F.col(f"{x}_{h}")) for h in ("am", "pm") for x in ("l", "t")})
    some = F.col("ok_am") | F.col("ok_pm")
    lit = (F.col("l_am").isNotNull() | ~F.col("ok_am")) & (F.col("l_pm").isNotNull() | ~F.col("ok_pm")) & some

    # where a witness sees no difference, the more regular reading is kept
    steadier = F.when(F.col("m_pm") > F.col("m_am"), "pm").otherwise("am")

    def closer(am: Column, pm: Column) -> Column:
        return (F.when(am.isNull(), "pm").when(pm.isNull(), "am").when(F.abs(am - pm) < 1e-6, steadier)
                .when(pm < am, "pm").otherwise("am"))

    light_ok = lit & (F.least("l_am", "l_pm") <= MAX_NOON_OFFSET_H)
    warmest = F.least("t_am", "t_pm")
    half = (F.when(F.coalesce(light_ok, F.lit(False)), closer(F.col("l_am"), F.col("l_pm")))
            .when(warmest <= MAX_TEMPERATURE_OFFSET_H, closer(F.col("t_am"), F.col("t_pm"))))
    match = F.when(half == "am", F.col("m_am")).when(half == "pm", F.col("m_pm"))
    verdict = stats.select(
        *keys, half.alias("half"), match.alias("step_match"),
        F.when(~some, "refused: no time is left for a row").when(half.isNull() & warmest.isNull(), "refused: no half can be chosen")
        .when(half.isNull(), "refused: no normal day").when(match < MIN_STEP_MATCH, "refused: irregular steps")
        .otherwise("repaired").alias("verdict"))
    rows = attach(both, verdict, keys)
    fixed = (F.when(F.col("verdict") != "repaired", F.col(ts)).when(F.col("half") == "pm", F.col("pm")).otherwise(F.col("am")))
    return rows.withColumn(ts, fixed).select(*[c(x) for x in df.columns]), verdict


def repair_epoch(df: DataFrame, archived: DataFrame, reference: DataFrame, keys, ts: str = "ts",
                 light: str = "lux", temperature: str = "temp", min_days: int = MIN_REGION_DAYS) -> DataFrame:
    """Verdict for series on a wrong epoch: the light sets the hour, the
    archived date (``archived``: keys, ``archived_day``) the day, and the
    temperature must then follow other sites (``reference``: keys, ``day``,
    ``reference``)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    phase = clock_phase(df, keys, ts, light).select(*keys, "evaluable", "peak_hour")
    start = df.groupBy(*keys).agg(F.min(ts).alias("_start"))
    hour = F.rint(12.0 - F.col("peak_hour")).cast("int")
    plan = attach(attach(start, phase, keys), archived, keys).withColumn("hour_shift", hour)
    begin = F.timestamp_add("HOUR", F.col("hour_shift"), F.col("_start"))
    plan = plan.withColumn("day_shift", F.date_diff(F.to_date("archived_day"), F.to_date(begin)))
    moved = attach(df, plan.select(*keys, "hour_shift", "day_shift"), keys).where(F.col("hour_shift").isNotNull())
    new = F.timestamp_add("HOUR", (F.col("day_shift") * 24 + F.col("hour_shift")).cast("int"), F.col(ts))
    day = F.date_trunc("day", new).cast("timestamp_ntz").alias("day")
    own = moved.groupBy(*keys, day).agg(F.avg(temperature).alias("_own")).where(F.col("_own").isNotNull())
    both = own.join(reference.where(F.col("reference").isNotNull()), [*keys, "day"])
    fit = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("days"), F.corr("_own", "reference").alias("corr"))
    out = attach(plan, fit, keys)
    return out.select(
        *keys, "hour_shift", "day_shift", F.coalesce("days", F.lit(0)).alias("days"), "corr",
        F.when(~F.col("evaluable"), "refused: no usable light").when(F.col("days").isNull(), "refused: no reference")
        .when(F.col("days") < min_days, "refused: too few days")
        .when(F.coalesce(F.nanvl("corr", F.lit(None).cast("double")), F.lit(-1.0)) < MIN_REGION_CORR, "refused: does not follow the region")
        .otherwise("accepted").alias("verdict"))


def epoch_report(df: DataFrame, keys, name: str, ts: str = "ts", light: str = "lux") -> DataFrame:
    """Dates in the file name against dates in the data, with the light peak."""
    from tidelint.functions.labels import named_dates
    keys = [keys] if isinstance(keys, str) else list(keys)
    span = df.groupBy(*keys, name).agg(F.min(ts).alias("data_from"), F.max(ts).alias("data_to"))
    phase = clock_phase(df, keys, ts, light).select(*keys, F.round("peak_hour", 1).alias("light_peak_h"))
    nd = named_dates(F.col(name))
    out = span.withColumns({"name_from": nd["first"], "name_to": nd["last"]})

    def days(a: Column, b: Column) -> Column:
        return F.floor((micros(b) - micros(a)) / 8.64e10)

    out = out.withColumns({"data_days": days(F.col("data_from"), F.col("data_to")),
                           "name_days": days(F.col("name_from"), F.col("name_to")),
                           "offset_days": days(F.col("data_from"), F.col("name_from"))})
    return attach(out, phase, keys)
