"""Sampling profile of each series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelint.functions.timespec import micros
from tidelint.operators.ordering import Cuts, Ordered, Prev, ordered
from tidelint.operators.stats import attach_medians

# A session this long, or logged this slowly, is a mooring.
MOORING_MIN_HOURS = 4.0
MOORING_MIN_STEP_S = 300.0


def time_steps(df: DataFrame, keys, by, ts: str = "ts", cuts: Cuts | None = None) -> Ordered:
    """Microseconds since the previous row, in row order (``_step``)."""
    s = ordered(df, keys, by, cuts).scan(_before=Prev(micros(F.col(ts))))
    return s.with_columns(_step=micros(F.col(ts)) - F.col("_before"))


def with_sampling(df: DataFrame, keys, by, ts: str = "ts", cuts: Cuts | None = None) -> DataFrame:
    """Give every row its series' length ``n`` and median step ``interval_s``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    kept = [F.col(f"`{x}`") for x in df.columns]
    s = time_steps(df, keys, by, ts, cuts)
    rows = attach_medians(s.rows, keys, {"_median_us": F.col("_step").cast("double")}, s.cuts, {"n": F.count(F.lit(1))})
    return rows.select(*kept, "n", (F.col("_median_us") / 1e6).alias("interval_s"))


def sampling_profile(df: DataFrame, keys, by, ts: str = "ts") -> DataFrame:
    """One row per series: span, median step in seconds and the sanity counts.

    Rows are taken in ``by`` order, so a clock that runs backwards shows up as
    negative steps. ``usable`` is false for series whose sampling step cannot
    be determined.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    by = [by] if isinstance(by, str) else list(by)
    s = time_steps(df.select(*dict.fromkeys([*keys, *by, ts])), keys, by, ts)
    steps = attach_medians(s.rows, keys, {"_m": F.col("_step").cast("double")}, s.cuts)
    counts = steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("t_start"), F.max(ts).alias("t_end"),
        F.count_if(F.col("_step") < 0).alias("backwards"),
        F.max("_step").alias("max_step_us"), F.max("_m").alias("median_us"),
        (F.count(ts) - F.count_distinct(F.col(ts))).alias("duplicates"),
        F.count_if(F.col("_step") > 3 * F.col("_m")).alias("gaps"))
    return (counts.select(*keys, "n", "t_start", "t_end",
                    (F.col("median_us") / 1e6).alias("interval_s"),
                    "backwards", "duplicates", "gaps",
                    F.when(F.col("gaps") > 0, F.col("max_step_us") / 1e6).alias("max_gap_s"),
                    ((F.col("n") >= 2) & F.coalesce(F.col("median_us") > 0, F.lit(False)))
                    .alias("usable")))


def mooring_or_profile(df: DataFrame, keys, ts: str = "ts") -> DataFrame:
    """Verdict per session from its own sorted stamps; null below two stamps."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    s = time_steps(df.where(F.col(ts).isNotNull()).select(*keys, ts), keys, (ts,), ts)
    steps = attach_medians(s.rows, keys, {"_m": F.col("_step").cast("double")}, s.cuts)
    span = steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_m").alias("_m"),
        ((F.max(micros(F.col(ts))) - F.min(micros(F.col(ts)))) / 3.6e9).alias("_h"))
    known = F.col("_n") >= 2
    hours = F.when(known, F.col("_h"))
    step = F.when(known, F.coalesce(F.col("_m"), F.lit(0.0)) / 1e6)
    return span.select(
        *keys, hours.alias("hours"), step.alias("step_s"),
        F.when(~known, F.lit(None))
        .when((hours >= MOORING_MIN_HOURS) | (step >= MOORING_MIN_STEP_S), "TSCP Mooring")
        .otherwise("TSCP Profile").alias("verdict"))
