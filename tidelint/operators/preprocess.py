"""Unit, clock and value clean-up before the tests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelint.functions.flags import DISMISSED, flag
from tidelint.operators.ordering import (PIECE, Cuts, FirstAfter, Last, Next, Position, Prev, attach, attach_aggregates,
                                         kept, measured, ordered)
from tidelint.operators.peaks import turning_points
from tidelint.operators.qc_tests import c
from tidelint.operators.series import with_sampling
from tidelint.operators.stats import attach_medians

# Divisors tried for a lost decimal separator, in this order.
SCALE_FACTORS = (10.0, 100.0, 1000.0)
# Any possible water temperature.
TEMPERATURE_BOUNDS = (-5.0, 60.0)
# Share of the environmental span that still counts as zero noise.
OPTICAL_NOISE = 0.05


def to_dbar(pressure: Column, unit: Column) -> Column:
    return (F.when(F.lower(unit) == "bar", pressure * 10)
            .when(F.lower(unit) == "kpa", pressure / 10).otherwise(pressure))


def to_ms_cm(conductivity: Column, unit: Column) -> Column:
    return F.when(F.lower(unit) == "s/m", conductivity * 10).otherwise(conductivity)


def shift_hours(df: DataFrame, hours: int, ts: str = "ts") -> DataFrame:
    """Move the clock, e.g. -3 from GMT to local time."""
    return df.withColumn(ts, F.col(ts) + F.expr(f"INTERVAL {hours} HOURS"))


def drop_secondary_temperatures(df: DataFrame) -> DataFrame:
    """Only the main temperature sensor is kept."""
    extra = [n for n in df.columns if re.search("internal temperature", n, re.IGNORECASE)
             or re.search(r"\btemperature\b.*\d", n, re.IGNORECASE)]
    return df.drop(*extra)


def has_only_pressure(df: DataFrame) -> bool:
    """True when depth must be computed: no depth column and one pressure column."""
    pressure = [n for n in df.columns if re.search("pressure", n, re.IGNORECASE)]
    depth = [n for n in df.columns if re.search("depth", n, re.IGNORECASE) and n not in pressure]
    return not depth and len(pressure) == 1


def zero_rule(name: str, environment: dict[str, tuple[float, float]]) -> tuple[str, float]:
    """How values at or below zero are treated, from the column name."""
    if re.search("par|luminosity|lux", name, re.IGNORECASE):
        return "light", 0.0
    for word, key in (("chlorophyll", "chl"), ("turbidity", "tur"), ("organic matter", "org")):
        if re.search(word, name, re.IGNORECASE):
            low, high = environment[key]
            return "optical", max(OPTICAL_NOISE * (high - low), 0.0)
    return "positive", 0.0


def clean_value(value: Column, rule: tuple[str, float]) -> Column:
    kind, noise = rule
    if kind == "light":
        return F.when(value < 0, F.lit(0.0)).otherwise(value)
    if kind == "optical":
        return F.when(value < -noise, F.lit(None)).when(value < 0, F.lit(0.0)).otherwise(value)
    return F.when(value <= 0, F.lit(None)).otherwise(value)


def clamped(value: Column, rule: tuple[str, float]) -> Column:
    kind, noise = rule
    if kind == "light":
        return value < 0
    return (value < 0) & (value >= -noise) if kind == "optical" else F.lit(False)


def discarded(value: Column, rule: tuple[str, float]) -> Column:
    kind, noise = rule
    if kind == "light":
        return F.lit(False)
    return value < -noise if kind == "optical" else value <= 0


def clean_below_zero(df: DataFrame, rules: dict[str, tuple[str, float]]) -> DataFrame:
    return df.withColumns({n: clean_value(c(n), r) for n, r in rules.items()})


def below_zero_report(df: DataFrame, rules: dict[str, tuple[str, float]],
                      keys: list[str] | None = None) -> DataFrame:
    """Clamped and discarded counts per column, only where something changed."""
    keys = keys or []
    entries = F.array(*[F.struct(
        F.lit(n).alias("var"), F.coalesce(clamped(c(n), r), F.lit(False)).alias("cl"),
        F.coalesce(discarded(c(n), r), F.lit(False)).alias("di")) for n, r in rules.items()])
    long = df.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*")
    counts = long.groupBy(*keys, "var").agg(F.count_if("cl").alias("clamped"),
                                            F.count_if("di").alias("discarded"))
    return counts.where((F.col("clamped") > 0) | (F.col("discarded") > 0))


def surface_cut(df: DataFrame, depth: str, values: list[str], limit: float = 0.5) -> DataFrame:
    """Values above the limit depth become missing; the row stays."""
    shallow = F.coalesce(c(depth) < limit, F.lit(False))
    cut = {n: F.when(~shallow, c(n)) for n in values if n != depth}
    if depth in values:
        cut[depth] = F.when(~shallow, c(depth))
    return df.withColumns(cut)


def dismiss(df: DataFrame, cuts: DataFrame, keys: list[str], values: dict[str, str],
            flags: dict[str, tuple[str, ...]], remove_rows: bool = False) -> DataFrame:
    """Apply manual dismissals.

    ``cuts`` has the key columns and ``variable``; a null variable dismisses
    the whole row. ``values`` maps variables to value columns, ``flags`` maps
    each flag column to the variables it speaks for.
    """
    per_row = cuts.groupBy(*keys).agg(
        F.max(F.col("variable").isNull().cast("int")).alias("_all"),
        *[F.max((F.col("variable") == v).cast("int")).alias(f"_cut_{v}") for v in values])
    work = attach(df, per_row, keys)
    whole = F.coalesce(F.col("_all") == 1, F.lit(False))
    hit = {v: whole | F.coalesce(F.col(f"_cut_{v}") == 1, F.lit(False)) for v in values}
    out = {col: F.when(~hit[v], c(col)) for v, col in values.items()}
    for name, buckets in flags.items():
        touched = whole
        for b in buckets:
            touched = touched | hit.get(b, F.lit(False))
        out[name] = F.when(touched, flag(DISMISSED)).otherwise(F.col(name))
    if remove_rows:
        work = work.where(~whole)
    return work.withColumns(out).select(*[c(x) for x in df.columns])


def dismiss_cells(df: DataFrame, cuts: DataFrame, record: list[str], cell: str,
                  cell_values: list[str], record_values: list[str], flags: list[str],
                  remove_rows: bool = False) -> DataFrame:
    """Dismissals of a current table: a null cell cuts the record and its
    attitude, a cell cuts only its own solution."""
    records = cuts.where(F.col(cell).isNull()).select(*record).distinct().withColumn("_rec", F.lit(1))
    cells = cuts.where(F.col(cell).isNotNull()).select(*record, cell).distinct().withColumn("_cell", F.lit(1))
    work = attach(attach(df, records, record), cells, [*record, cell])
    in_record = F.col("_rec").isNotNull()
    cut = in_record | F.col("_cell").isNotNull()
    out = {n: F.when(~cut, c(n)) for n in cell_values}
    out |= {n: F.when(~in_record, c(n)) for n in record_values}
    out |= {n: F.when(cut, flag(DISMISSED)).otherwise(F.col(n)) for n in flags}
    if remove_rows:
        work = work.where(~cut)
    return work.withColumns(out).select(*[c(x) for x in df.columns])


def scale_factor(n: Column, inside: Column, fractional: Column, fits: dict[float, Column]) -> Column:
    """Divisor that undoes a lost decimal separator, or 1. Shares are of ``n``."""
    lost = (n >= 10) & (inside <= 0.02 * n) & (fractional <= 0.02 * n)
    out = F.lit(1.0)
    for f in reversed(SCALE_FACTORS):
        out = F.when(fits[f] > 0.98 * n, F.lit(f)).otherwise(out)
    return F.when(F.coalesce(lost, F.lit(False)), out).otherwise(F.lit(1.0))


def fix_scale(df: DataFrame, keys, value: str, out: str) -> DataFrame:
    """Divide whole series that lost their decimal separator.

    ``scale_note`` says what happened: rescaled, carries decimals, no factor.
    """
    v = c(value)
    low, high = TEMPERATURE_BOUNDS

    def within(x: Column) -> Column:
        return F.count_if((x >= low) & (x <= high))

    work = attach_aggregates(df, keys, {
        "_n": F.count(v), "_in": within(v), "_fr": F.count_if(v != F.rint(v)),
        **{f"_f{int(f)}": within(v / f) for f in SCALE_FACTORS}})
    factor = scale_factor(F.col("_n"), F.col("_in"), F.col("_fr"),
                          {f: F.col(f"_f{int(f)}") for f in SCALE_FACTORS})
    odd = (F.col("_n") >= 10) & (F.col("_in") <= 0.02 * F.col("_n"))
    note = (F.when(~odd, F.lit(None)).when(F.col("_fr") > 0.02 * F.col("_n"), "carries decimals")
            .when(factor > 1, "rescaled").otherwise("no factor"))
    return work.select(*[c(x) for x in df.columns], (v / factor).alias(out), note.alias("scale_note"))


def deployment_window(df: DataFrame, keys, ts: str, value: str,
                      detached: list[str], ended: list[str], events: list[str]) -> DataFrame:
    """Keep the rows between launch and readout events, when they keep at least
    half of the measurements, and drop rows that only record an event.

    Rows without a key belong to no deployment and have no window.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    cuts = measured(df, keys, ())

    def any_of(names: list[str]) -> Column:
        out = F.lit(False)
        for n in names:
            out = out | c(n).isNotNull()
        return out

    t = c(ts)
    known = F.lit(True)
    for k in keys:
        known = known & c(k).isNotNull()
    work = attach_aggregates(df, keys, {"_start": F.min(F.when(known & any_of(detached), t))}, cuts)
    after = F.col("_start").isNull() | (t > F.col("_start"))
    work = attach_aggregates(work, keys, {"_end": F.min(F.when(known & any_of(ended) & after, t))}, cuts)
    inside = ((F.col("_start").isNull() | (t >= F.col("_start")))
              & (F.col("_end").isNull() | (t < F.col("_end"))))
    valued = c(value).isNotNull()
    work = attach_aggregates(work, keys, {"_meas": F.count_if(valued),
                                          "_keep": F.count_if(inside & valued)}, cuts)
    trusted = ~((F.col("_meas") > 0) & (F.col("_keep") < 0.5 * F.col("_meas")))
    return (work.where((inside | ~trusted) & ~(any_of(events) & ~valued))
            .select(*[c(x) for x in df.columns]))


def trim_edges(df: DataFrame, keys, by, value: str, ts: str = "ts",
               tolerance: float = 1.5) -> DataFrame:
    """Drop out-of-water readings at both ends of each series.

    At most one day is trimmed per end, up to the first reading (or gap) within
    tolerance of the median of the nearest five days; nothing is trimmed from a
    series that would lose more than a tenth of its rows.
    """
    cuts = measured(df, keys, by)
    work = ordered(with_sampling(df, keys, by, ts, cuts), keys, by, cuts).scan(_pos=Position()).rows
    step = F.col("interval_s")
    day = F.when(step > 0, F.greatest((F.lit(86400.0) / step).cast("long"), F.lit(4))).otherwise(F.lit(12))
    back = F.col("n") - 1 - F.col("_pos")
    work = work.withColumns({"_day": day, "_back": back})
    v = c(value)
    work = attach_medians(work, keys, {
        "_head": F.when(F.col("_pos") < 5 * F.col("_day"), v),
        "_tail": F.when(F.col("_back") < 5 * F.col("_day"), v)}, cuts)

    def settled(at: Column, ref: Column) -> Column:
        stray = F.coalesce(F.abs(v - ref) > tolerance, F.lit(False))
        return F.when((at >= F.col("_day")) | ~stray, F.lit(1))

    s = ordered(work, keys, by, cuts).scan(
        _in=Last(settled(F.col("_pos"), F.col("_head"))),
        _out=FirstAfter(settled(F.col("_back"), F.col("_tail"))))
    work = attach_aggregates(s.rows, keys, {
        "_cut_h": F.count_if(F.col("_in").isNull()), "_cut_t": F.count_if(F.col("_out").isNull())}, cuts)
    too_much = F.col("_cut_h") + F.col("_cut_t") > 0.1 * F.col("n")
    return (work.where(too_much | (F.col("_in").isNotNull() & F.col("_out").isNotNull()))
            .select(*[c(x) for x in df.columns]))


def cast_phase(df: DataFrame, keys, pos: str, pressure: str) -> DataFrame:
    """Descending up to the turning point of a cast, ascending from it.

    The turning point is the first wide peak of the pressure (``peaks``);
    ``pos`` numbers a cast's rows from 0. In a cast without one every row is
    both, so that either choice keeps the cast whole.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    work = attach(df, turning_points(df, keys, pos, pressure).withColumnRenamed("turn", "_turn"), keys)
    return work.select(*[c(x) for x in df.columns],
                       F.coalesce(c(pos) <= F.col("_turn"), F.lit(True)).alias("descending"),
                       F.coalesce(c(pos) >= F.col("_turn"), F.lit(True)).alias("ascending"))


def drop_null_repeats(df: DataFrame, keys: list[str], ts: str, value: str, cuts: Cuts | None = None) -> DataFrame:
    """Drop null readings at instants the series has more than once.

    Rows that have their piece, in an order that begins with ``ts`` and has no null in it, are
    compared with their neighbours. They are then stored as they lie, for what
    scans them next.
    """
    if PIECE in df.columns and cuts is not None and cuts.keys == tuple(keys) and cuts.by[0] == ts:
        s = ordered(df, keys, cuts.by, cuts).scan(_prev=Prev(ts), _next=Next(ts))
        alone = F.coalesce(c("_prev") != c(ts), F.lit(True)) & F.coalesce(c("_next") != c(ts), F.lit(True))
        return kept(s.df.where(c(value).isNotNull() | alone).select(*[c(n) for n in df.columns]), laid=True)
    counted = attach_aggregates(df, [*keys, ts], {"_copies": F.count(F.lit(1))}, cuts)
    return counted.where(c(value).isNotNull() | (F.col("_copies") == 1)).drop("_copies")


def present_parameters(long: DataFrame, keys: list[str], var: str = "var", value: str = "value", cuts: Cuts | None = None) -> DataFrame:
    """Rows of the parameters that hold at least one value in their slice."""
    counted = attach_aggregates(long, [*keys, var], {"_held": F.count(value)}, cuts, light=PIECE in long.columns)
    return counted.where(F.col("_held") > 0).drop("_held")
