"""Per-sample quality tests. Every test adds one flag column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelint.functions import seawater
from tidelint.functions.flags import (BAD, GOOD, MISSING, SUSPECT, UNKNOWN, flag)
from tidelint.operators.ordering import (Cuts, Last, Next, Prev, RunningSum, attach_aggregates, measured, ordered)
from tidelint.operators.stats import attach_medians

FLAT_SENTINEL = -9.0       # legacy missing-value code honoured by the flat-line test


def c(name: str) -> Column:
    return F.col(f"`{name}`")


def spike_flag(value: Column, before: Column, after: Column, sigma: Column,
               fail: float, suspect: float, zero_is_quiet: bool = False) -> Column:
    """Three-point spike against multiples of the local spread (strict >)."""
    spike = F.abs(value - (before + after) / 2)
    upper, lower = F.abs(F.lit(fail) * sigma), F.abs(F.lit(suspect) * sigma)
    out = F.when(value.isNull(), flag(MISSING))
    if zero_is_quiet:
        quiet = (value == 0) & (before == 0) & (after == 0)
        out = out.when(F.coalesce(quiet, F.lit(False)), flag(GOOD))
    return (out.when(spike.isNull() | upper.isNull(), flag(UNKNOWN))
            .when(spike > upper, flag(BAD))
            .when(spike > lower, flag(SUSPECT))
            .otherwise(flag(GOOD)))


def rate_flag(value: Column, before: Column, is_first: Column, earlier_bad: Column,
              before_bad: Column, sigma: Column, suspect: float) -> Column:
    """Rate of change; only ever suspect. ``earlier_bad`` is this variable's own
    earlier verdict, ``before_bad`` the same on the previous row (never set by
    the first row)."""
    off = (F.coalesce(is_first, F.lit(False)) | before.isNull()
           | F.coalesce(earlier_bad, F.lit(False)) | F.coalesce(before_bad, F.lit(False)))
    return (F.when(value.isNull(), flag(MISSING))
            .when(off, flag(UNKNOWN))
            .when(F.abs(value - before) >= F.lit(suspect) * sigma, flag(SUSPECT))
            .otherwise(flag(GOOD)))


def decimal_places(value: Column) -> Column:
    """Digits after the point in the plain decimal text of a double."""
    text = value.try_cast("decimal(38,18)").cast("string")
    return F.length(F.regexp_replace(F.substring_index(text, ".", -1), "0+$", ""))


def resolution(df: DataFrame, keys, columns: dict[str, Column]) -> DataFrame:
    """Smallest step each series can show."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(*[
        F.pow(F.lit(10.0), -F.max(F.coalesce(decimal_places(v), F.lit(0)))).alias(n)
        for n, v in columns.items()])


def flat_line(df: DataFrame, keys, by, columns: dict[str, Column],
              fail: int, suspect: int, cuts: Cuts | None = None) -> DataFrame:
    """Stuck-sensor test. ``columns`` is {flag column: value}.

    Runs are counted over valid values only, so stray gaps do not break them.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    cuts = cuts or measured(df, keys, by)
    rows = attach_aggregates(df, keys, {
        f"_dec_{o}": F.max(F.coalesce(decimal_places(v), F.lit(0))) for o, v in columns.items()}, cuts)
    rows = rows.withColumns({f"_eps_{o}": F.pow(F.lit(10.0), -F.col(f"_dec_{o}")) for o in columns})
    ok = {o: F.when(v.isNotNull() & (v != FLAT_SENTINEL), v) for o, v in columns.items()}
    s = ordered(rows, keys, by, cuts)
    s = s.with_columns(**{f"_ok_{o}": v for o, v in ok.items()})
    s = s.scan(**{f"_pv_{o}": Last(f"_ok_{o}", inclusive=False) for o in columns},
               **{f"_at_{o}": RunningSum(F.col(f"_ok_{o}").isNotNull().cast("long")) for o in columns})
    starts = {}
    for o in columns:
        moved = F.abs(F.col(f"_ok_{o}") - F.col(f"_pv_{o}")) > F.col(f"_eps_{o}")
        starts[f"_st_{o}"] = F.when(
            F.col(f"_ok_{o}").isNotNull() & (F.col(f"_pv_{o}").isNull() | moved), F.col(f"_at_{o}"))
    s = s.with_columns(**starts).scan(**{f"_rs_{o}": Last(f"_st_{o}") for o in columns})
    flags = []
    for o in columns:
        run = F.col(f"_at_{o}") - F.col(f"_rs_{o}") + 1
        flags.append(F.when(F.col(f"_ok_{o}").isNull(), flag(MISSING))
                     .when(run >= fail, flag(BAD))
                     .when(run >= suspect, flag(SUSPECT))
                     .when((F.col(f"_rs_{o}") == 1) & (F.col(f"_at_{o}") < fail), flag(UNKNOWN))
                     .otherwise(flag(GOOD)).alias(o))
    return s.rows.select(*[c(x) for x in df.columns], *flags)


def vertical_gradient(df: DataFrame, keys, by, depth: Column,
                      columns: dict[str, Column], fail: float = 3.0, suspect: float = 2.5,
                      min_dz: float = 0.05, cuts: Cuts | None = None) -> DataFrame:
    """Profile gradient against the cast's own typical gradient (>=)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    s = ordered(df, keys, by, cuts).with_columns(_z=depth).scan(
        _pz=Prev("_z"), **{f"_pv_{o}": Prev(v) for o, v in columns.items()})
    dz = F.col("_z") - F.col("_pz")
    grads = {f"_gr_{o}": F.when(F.abs(dz) >= min_dz, (v - F.col(f"_pv_{o}")) / dz)
             for o, v in columns.items()}
    rows = attach_medians(s.with_columns(**grads).rows, keys,
                          {f"_md_{o}": F.col(f"_gr_{o}") for o in columns}, s.cuts,
                          {**{f"_ct_{o}": F.count(f"_gr_{o}") for o in columns}, **{f"_sd_{o}": F.stddev_pop(f"_gr_{o}") for o in columns}})
    rows = rows.withColumns({f"_dv_{o}": F.abs(F.col(f"_gr_{o}") - F.col(f"_md_{o}")) for o in columns})
    done = attach_medians(rows, keys, {f"_ma_{o}": F.col(f"_dv_{o}") for o in columns}, s.cuts)
    flags = []
    for o, v in columns.items():
        robust = 1.4826 * F.col(f"_ma_{o}")
        sigma = F.when(F.col(f"_ct_{o}") >= 4,
                       F.when(robust > 0, robust).otherwise(F.col(f"_sd_{o}")))
        dev = F.col(f"_dv_{o}")
        flags.append(F.when(v.isNull(), flag(MISSING))
                     .when(dev.isNull() | sigma.isNull() | (sigma <= 0), flag(UNKNOWN))
                     .when(dev >= fail * sigma, flag(BAD))
                     .when(dev >= suspect * sigma, flag(SUSPECT))
                     .otherwise(flag(GOOD)).alias(o))
    return done.select(*[c(x) for x in df.columns], *flags)


def density_inversion(df: DataFrame, keys, tie: str, temperature: Column, salinity: Column,
                      pressure: Column, vertical: Column, out: str = "dens",
                      tolerance: float = 0.03, cuts: Cuts | None = None) -> DataFrame:
    """A point lighter than the valid point above it marks both as suspect."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    # tested on the inputs: a filter on the density itself would be pushed below
    # the polynomial and evaluate it once more per use
    dense = F.coalesce((salinity >= 0) & temperature.isNotNull() & pressure.isNotNull(), F.lit(False))
    # rows without a density or a place are a series of their own, which is not looked at
    work = df.withColumns({"_vz": vertical, "_dense": dense}).withColumn("_valid", F.col("_dense") & F.col("_vz").isNotNull())
    weighed = seawater.with_seawater(work, salinity, temperature, pressure)
    s = ordered(weighed, [*keys, "_valid"], ("_vz", tie), cuts).scan(_up=Prev("sigma0"), _dn=Next("sigma0"))
    here = F.col("sigma0")
    hit = F.coalesce((here < F.col("_up") - tolerance) | (F.col("_dn") < here - tolerance), F.lit(False))
    # without a vertical position: never visited by the walk, good when it has a density
    return s.rows.select(*[c(x) for x in df.columns],
                         F.when(F.col("_valid") & hit, flag(SUSPECT)).when(F.col("_dense"), flag(GOOD)).otherwise(flag(UNKNOWN)).alias(out))


@dataclass(frozen=True)
class CurrentLimits:
    """Default limits of the current-profiler tests."""
    max_speed: float = 300.0
    min_strength: float = -60.0
    max_stdev: float = 50.0
    tilt_suspect: float = 15.0
    tilt_bad: float = 35.0
