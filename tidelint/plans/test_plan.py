"""The ordered list of tests and the job that runs them over many series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelint.functions.flags import (BAD, DISMISSED, MISSING, SUSPECT, UNKNOWN, flag, range_flag,
                                      worst_of_columns)
from tidelint.functions.timespec import window_samples
from tidelint.operators.ordering import Next, Position, Prev, measured, ordered
from tidelint.operators.qc_tests import (c, density_inversion, flat_line, rate_flag, spike_flag,
                                         vertical_gradient)
from tidelint.operators.series import with_sampling
from tidelint.operators.sigma import MIN_SAMPLES, rolling_sigma
from tidelint.plans.criteria import Criteria

# Names of the variables in test labels and switches.
LABEL = {"T": "temperature", "S": "salinity", "C": "conductivity", "P": "pressure",
         "O2": "dissolved oxygen", "pH": "pH", "chl": "chlorophyll", "tur": "turbidity",
         "PAR": "PAR", "CO2": "dissolved CO2", "org": "dissolved organic matter"}
# The order in which variables appear inside each family of tests.
SENSOR_ORDER = ("T", "S", "C", "P", "O2", "pH", "chl", "tur", "PAR", "CO2")
ENVIRONMENT_ORDER = ("T", "S", "C", "P", "pH", "chl", "O2", "org", "tur", "PAR", "CO2")
SPIKE_ORDER = ("T", "S", "C", "P", "pH", "chl", "O2", "org", "tur", "PAR", "CO2")
MOVING_ORDER = ("T", "S", "C", "P")
GRADIENT_ORDER = ("T", "S", "C")

# Which rolled-up variables a test key speaks for.
BUCKETS = {"dens": ("T", "S")}
BASE_BUCKETS = ("T", "S", "C", "P", "pH", "chl", "O2", "org", "tur")


@dataclass(frozen=True)
class Test:
    __test__ = False       # not a test case, whatever its name suggests
    variable: str
    family: str            # sensor, environment, spike, rate, flat, gradient, density, light

    @property
    def switch(self) -> str:
        name = LABEL.get(self.variable, "")
        return {"sensor": f"{name} sensor range", "environment": f"{name} environmental range",
                "spike": f"{name} spikes", "rate": f"{name} rate of change",
                "flat": f"{name} flat line", "gradient": f"{name} vertical gradient",
                "density": "density inversion", "light": "light fouling window"}[self.family]

    @property
    def label(self) -> str:
        return self.switch[0].upper() + self.switch[1:] if self.variable != "pH" else self.switch


def mooring_plan() -> list[Test]:
    return ([Test(v, "sensor") for v in SENSOR_ORDER]
            + [Test(v, "environment") for v in ENVIRONMENT_ORDER]
            + [Test(v, "spike") for v in SPIKE_ORDER]
            + [Test(v, "rate") for v in MOVING_ORDER]
            + [Test(v, "flat") for v in MOVING_ORDER])


def profile_plan() -> list[Test]:
    return mooring_plan() + [Test(v, "gradient") for v in GRADIENT_ORDER] + [Test("dens", "density")]


def light_logger_plan() -> list[Test]:
    return [Test("T", f) for f in ("sensor", "environment", "spike", "rate", "flat")] \
        + [Test("lux", "light")]


def column_of(test: Test) -> str:
    return f"f_{test.family}_{test.variable}"


def run_plan(df: DataFrame, plan: list[Test], columns: dict[str, str], keys, by, ts: str = "ts",
             criteria: Criteria | None = None, depth: str | None = None,
             logger: bool = False) -> DataFrame:
    """Add one flag column per test, in plan order.

    ``columns`` maps variable keys to columns of ``df``; a variable that is not
    there is flagged 2, a test that is switched off 5. The light test of a
    light logger is added by ``tidelint.operators.light``.
    """
    criteria = criteria or Criteria()
    keys = [keys] if isinstance(keys, str) else list(keys)
    by = [by] if isinstance(by, str) else list(by)
    have = {t.variable for t in plan} & set(columns)
    prefix = "logger " if logger else ""
    on = {t for t in plan if (prefix + t.switch) not in criteria.off
          and (t.variable in have or t.family == "density")}
    moving = [v for v in columns if Test(v, "spike") in on or Test(v, "rate") in on]

    cuts = measured(df, keys, by)
    work = with_sampling(df, keys, by, ts, cuts).withColumnsRenamed({"n": "_n", "interval_s": "_dt"})
    s = ordered(work, keys, by, cuts).scan(
        _pos=Position(),
        **{f"_pv_{v}": Prev(c(columns[v])) for v in moving},
        **{f"_nv_{v}": Next(c(columns[v])) for v in moving if Test(v, "spike") in on})
    work = s.rows

    # spreads: one entry per (variable, family) with its own window
    spreads, windows, used = {}, {}, {}
    for v in moving:
        for family in ("spike", "rate"):
            if Test(v, family) not in on:
                continue
            factor = _factor(criteria, family, v, logger)
            n = window_samples(factor.window, F.col("_dt"), F.col("_n"))
            if family == "rate":        # too short a window means the whole series here
                n = F.when(n < MIN_SAMPLES, F.col("_n")).otherwise(n)
            value = c(columns[v])
            if family == "spike" and v == "PAR":
                value = F.when(value > 0, value)
            # tests of a variable that look through the same window share its spread
            name = f"{v}_{factor.window}"
            used[family, v] = f"_s_{name}"
            windows[f"_w_{name}"] = n
            spreads[f"_s_{name}"] = (value, f"_w_{name}")
    if spreads:
        work = rolling_sigma(work.withColumns(windows), keys, "_pos", "_n", spreads, cuts)

    flags: dict[str, Column] = {}
    for t in plan:
        if t.family in ("rate", "flat", "gradient", "density", "light"):
            continue
        flags[column_of(t)] = _simple_flag(t, on, have, columns, criteria, logger, used)
    work = work.withColumns(flags)

    rates = [t for t in plan if t.family == "rate"]
    if any(t in on for t in rates):
        live = [t for t in rates if t in on]
        bad = {f"_bad_{t.variable}": _prior_bad(plan, t) for t in live}
        work = work.withColumns(bad)
        # the first row of a series never passes its verdict on
        s = ordered(work, keys, by, cuts).scan(**{
            f"_pb_{t.variable}": Prev((F.col("_pos") > 0) & F.col(f"_bad_{t.variable}")) for t in live})
        work = s.rows.withColumns({column_of(t): rate_flag(
            c(columns[t.variable]), F.col(f"_pv_{t.variable}"), F.col("_pos") == 0,
            F.col(f"_bad_{t.variable}"), F.col(f"_pb_{t.variable}"),
            F.col(used["rate", t.variable]),
            _factor(criteria, "rate", t.variable, logger).suspect) for t in live})
    flats = [t for t in plan if t.family == "flat" and t in on]
    if flats:
        counts = ((criteria.logger_flat_fail, criteria.logger_flat_suspect) if logger
                  else (criteria.flat_fail, criteria.flat_suspect))
        work = flat_line(work, keys, by, {column_of(t): c(columns[t.variable]) for t in flats}, *counts, cuts)
    grads = [t for t in plan if t.family == "gradient" and t in on and depth]
    if grads:
        f = criteria.gradient["T"]
        work = vertical_gradient(work, keys, by, c(depth),
                                 {column_of(t): c(columns[t.variable]) for t in grads},
                                 f.fail, f.suspect, cuts=cuts)
    dens = [t for t in plan if t.family == "density" and t in on]
    if dens and {"T", "S"} <= set(columns) and (depth or "P" in columns):
        pressure = c(columns["P"]) if "P" in columns else c(depth)
        work = density_inversion(work, keys, by[-1], c(columns["T"]), c(columns["S"]), pressure,
                                 c(depth) if depth else pressure, column_of(dens[0]),
                                 criteria.density_tolerance, cuts)
    known = set(work.columns)
    rest = {column_of(t): _unrun(t, have, prefix, criteria) for t in plan
            if column_of(t) not in known and t.family != "light"}
    work = work.withColumns(rest) if rest else work
    return work.select(*[c(x) for x in df.columns],
                       *[F.col(column_of(t)) for t in plan if t.family != "light"])


def _factor(criteria: Criteria, family: str, variable: str, logger: bool):
    if logger:
        return criteria.logger_spike if family == "spike" else criteria.logger_rate
    return (criteria.spike if family == "spike" else criteria.rate)[variable]


def _unrun(t: Test, have, prefix: str, criteria: Criteria) -> Column:
    # a column that is not there counts as unknown even when its test is off
    there = t.variable in have or t.family == "density"
    return flag(DISMISSED if there and (prefix + t.switch) in criteria.off else UNKNOWN)


def _simple_flag(t: Test, on, have, columns, criteria: Criteria, logger: bool,
                 used) -> Column:
    if t.variable not in have:
        return flag(UNKNOWN)
    if t not in on:
        return flag(DISMISSED)
    v = c(columns[t.variable])
    if t.family == "sensor":
        low, high = criteria.logger_sensor_temp if logger else criteria.sensor[t.variable]
        return range_flag(v, low, high, BAD)
    if t.family == "environment":
        low, high = criteria.environment[t.variable]
        return range_flag(v, low, high, SUSPECT)
    f = _factor(criteria, "spike", t.variable, logger)
    return spike_flag(v, F.col(f"_pv_{t.variable}"), F.col(f"_nv_{t.variable}"),
                      F.col(used["spike", t.variable]), f.fail, f.suspect,
                      zero_is_quiet=t.variable == "PAR")


def _prior_bad(plan: list[Test], t: Test) -> Column:
    """Own earlier digits that make a rate undefined: 4 or 9."""
    out = F.lit(False)
    for earlier in plan[:plan.index(t)]:
        if earlier.variable == t.variable:
            out = out | F.col(column_of(earlier)).isin(BAD, MISSING)
    return out


def rollup(df: DataFrame, plan: list[Test], extra: tuple[str, ...] = ()) -> DataFrame:
    """Flag string, one worst digit per variable, and the derived flags."""
    names = [column_of(t) for t in plan]
    per: dict[str, list[str]] = {v: [] for v in BASE_BUCKETS}
    for t in plan:
        for bucket in BUCKETS.get(t.variable, (t.variable,)):
            per.setdefault(bucket, []).append(column_of(t))
    out = {"Flag": F.concat(*[F.col(n).cast("string") for n in names])}
    for bucket, cols in per.items():
        out[f"Flag_{bucket}"] = worst_of_columns(cols)
    df = df.withColumns(out)
    return df.withColumns({"Flag_dens": worst_of_columns(["Flag_T", "Flag_S"]),
                           "Flag_depth": F.col("Flag_P")})


def flags_long(df: DataFrame, plan: list[Test], keep: list[str]) -> DataFrame:
    """One row per sample and test."""
    entry = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(t.label).alias("test"),
                               F.lit(t.variable).alias("var"), F.col(column_of(t)).alias("flag"))
                      for i, t in enumerate(plan)])
    return df.select(*keep, F.explode(entry).alias("e")).select(*keep, "e.*")

