"""Redundant loggers: alignment, combination, and arbitration against a region."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelint.functions.flags import BAD, GOOD, MISSING, SUSPECT, flag
from tidelint.functions.rounding import round_even
from tidelint.operators.ordering import Prev, attach, attach_aggregates, kept, ordered
from tidelint.operators.series import time_steps
from tidelint.operators.stats import attach_medians
from tidelint.operators.timejoin import nearest


@dataclass(frozen=True)
class Referee:
    """Default thresholds of the arbitration."""
    temperature_tolerance: float = 0.5
    min_fraction: float = 0.20
    min_points: int = 4
    min_margin: float = 0.30
    min_reference_corr: float = 0.50
    min_secondary_corr: float = 0.70
    min_bias_shift: float = 1.00
    bias_shift_ratio: float = 2.00
    amplitude_bad: float = 2.00
    amplitude_good: float = 1.50


def stamp_conflicts(df: DataFrame, keys: list[str], signals: list[str], ts: str = "ts") -> DataFrame:
    """One row per key and instant: how many rows, and do they disagree?
    Missing counts as a value. Carries the first row's signals."""
    differs = F.lit(False)
    aggs = [F.count(F.lit(1)).alias("copies")]
    for s in signals:
        aggs += [F.min(s).alias(f"_lo_{s}"), F.max(s).alias(f"_hi_{s}"), F.count(s).alias(f"_n_{s}")]
        differs = (differs | F.coalesce(F.col(f"_lo_{s}") != F.col(f"_hi_{s}"), F.lit(False))
                   | ((F.col(f"_n_{s}") > 0) & (F.col(f"_n_{s}") < F.col("copies"))))
    g = df.groupBy(*keys, ts).agg(*aggs)
    return g.select(*keys, ts, "copies", differs.alias("conflict"), *[F.col(f"_lo_{s}").alias(s) for s in signals])


def conflict_report(df: DataFrame, keys: list[str], signals: list[str], ts: str = "ts") -> DataFrame:
    """Per replicate: collapsed identical copies and conflicting instants."""
    g = stamp_conflicts(df, keys, signals, ts)
    return g.groupBy(*keys).agg(
        F.sum(F.when(~F.col("conflict"), F.col("copies") - 1).otherwise(0)).alias("extra_copies"),
        F.count_if("conflict").alias("conflicts"),
        F.min(F.when(F.col("conflict"), F.col(ts))).alias("first_conflict"))


def _aligned(clean: DataFrame, deployment: list[str], replicate: str, ts: str, signals: list[str],
             tolerance_s: float | None) -> DataFrame:
    """Every replicate on the first replicate's stamps (nearest sample). With
    no tolerance given it is half of the first replicate's median step."""
    # a deployment has a handful of loggers, so their set fits beside each row
    known = attach_aggregates(clean, deployment, {"_first": F.min(replicate), "_members": F.collect_set(replicate)})
    grid = known.where(F.col(replicate) == F.col("_first")).select(*deployment, ts, "_members")
    if tolerance_s is None:
        s = time_steps(grid, deployment, ts, ts)
        steps = attach_medians(s.rows, deployment, {"_m": F.col("_step").cast("double")}, s.cuts)
        grid = steps.select(*deployment, ts, "_members", F.when(F.col("_m") > 0, F.col("_m") / 2e6).alias("_tol_s"))
    else:
        grid = grid.withColumn("_tol_s", F.lit(float(tolerance_s)))
    targets = grid.select(*deployment, ts, "_tol_s", F.explode("_members").alias(replicate))
    return nearest(targets, clean, [*deployment, replicate], {s: s for s in signals}, F.col("_tol_s"), ts=ts, tie=ts).drop("_tol_s")


def combine(df: DataFrame, deployment, replicate: str = "replicate", ts: str = "ts",
            temperature: str = "temp", light: str = "lux", flag_t: str = "Flag_T",
            flag_lux: str = "Flag_lux", tolerance: float = 0.5) -> DataFrame:
    """One series per deployment from its redundant loggers.

    Temperature is the mean of acceptable readings, light the brightest
    unfouled one. Deployments whose replicate has conflicting copies of an
    instant are left out; ``conflict_report`` names them.
    """
    deployment = [deployment] if isinstance(deployment, str) else list(deployment)
    signals = [temperature, light, flag_t, flag_lux]
    stamped = stamp_conflicts(df, [*deployment, replicate], signals, ts)
    judged = attach_aggregates(stamped, deployment, {"_refused": F.bool_or("conflict")})
    clean = judged.where(~F.col("_refused")).select(*deployment, replicate, ts, *signals)
    rows = _aligned(clean, deployment, replicate, ts, signals, None)
    ok_t = (F.col(flag_t) <= 2) & F.col(temperature).isNotNull()
    t = F.when(ok_t, F.col(temperature))
    clean_l = F.when((F.coalesce(F.col(flag_lux), F.lit(0)) != BAD), F.col(light))
    g = rows.groupBy(*deployment, ts).agg(
        F.count(t).alias("_nt"), F.avg(t).alias("_t"), (F.max(t) - F.min(t)).alias("_sp"),
        F.count(clean_l).alias("_nl"), F.max(clean_l).alias("_lc"), F.max(light).alias("_la"))
    spread = F.when(F.col("_nt") >= 2, F.col("_sp"))
    return g.select(
        *deployment, ts, round_even(F.col("_t"), 4).alias(temperature), round_even(spread, 4).alias("spread"),
        round_even(F.when(F.col("_nl") >= 1, F.col("_lc")).otherwise(F.col("_la")), 4).alias(light),
        F.when(F.col("_nt") == 0, flag(MISSING)).when(F.coalesce(spread > tolerance, F.lit(False)), flag(SUSPECT))
        .otherwise(flag(GOOD)).alias(flag_t),
        F.when(F.col("_nl") >= 1, flag(GOOD)).when(F.col("_la").isNotNull(), flag(BAD))
        .otherwise(flag(MISSING)).alias(flag_lux))


def keep_single(df: DataFrame, chosen: DataFrame, deployment, replicate: str = "replicate") -> DataFrame:
    """The one sound replicate of each deployment in the combined schema; its
    spread is empty, because nothing was compared. ``chosen`` has one row per
    deployment."""
    deployment = [deployment] if isinstance(deployment, str) else list(deployment)
    kept = df.join(chosen.select(*deployment, replicate), [*deployment, replicate], "left_semi")
    return kept.drop(replicate).withColumn("spread", F.lit(None).cast("double"))


def disagreement(df: DataFrame, deployment, replicate: str = "replicate", ts: str = "ts",
                 temperature: str = "temp", flag_t: str | None = "Flag_T",
                 rules: Referee | None = None) -> DataFrame:
    """Do the replicates of a deployment disagree over a sustained share of it?"""
    rules = rules or Referee()
    _aligned_rows, grid, conflicts = _compared(df, deployment, replicate, ts, temperature, flag_t, rules)
    return _disagreement(grid, conflicts, deployment, rules)


def _compared(df, deployment, replicate, ts, temperature, flag_t, rules):
    deployment = [deployment] if isinstance(deployment, str) else list(deployment)
    t = F.col(temperature)
    if flag_t is not None:
        t = F.when(F.col(flag_t) <= 2, t)
    base = df.select(*deployment, replicate, ts, t.alias("_v"))
    stamped = stamp_conflicts(base, [*deployment, replicate], ["_v"], ts)
    conflicts = stamped.where("conflict").select(*deployment).distinct().withColumn("conflicting", F.lit(True))
    # every score below reads the alignment again
    rows = kept(_aligned(stamped.select(*deployment, replicate, ts, "_v"), deployment, replicate, ts, ["_v"], 30 * 60.0))
    grid = rows.groupBy(*deployment, ts).agg(
        F.when(F.count("_v") >= 2, F.max("_v") - F.min("_v")).alias("spread"))
    grid = grid.withColumn("over", F.coalesce(F.col("spread") > rules.temperature_tolerance, F.lit(False)))
    return rows, grid, conflicts


def _disagreement(grid, conflicts, deployment, rules):
    deployment = [deployment] if isinstance(deployment, str) else list(deployment)
    g = grid.groupBy(*deployment).agg(F.avg(F.col("over").cast("double")).alias("fraction_over"),
                                      F.coalesce(F.max("spread"), F.lit(0.0)).alias("max_spread"))
    g = attach(g, conflicts, deployment)
    return g.select(*deployment, "fraction_over", "max_spread",
                    F.coalesce("conflicting", F.lit(False)).alias("conflicting"),
                    (F.col("fraction_over") >= rules.min_fraction).alias("disagrees"))


def cadence(span_days: Column) -> Column:
    """Comparison step for a deployment of this length: MS, W or D."""
    return F.when(span_days > 150, "MS").when(span_days > 30, "W").otherwise("D")


def cadence_bin(ts: Column, step: Column) -> Column:
    """Consecutive number of the bin an instant falls into; weeks end on Sunday."""
    day = F.unix_date(F.to_date(ts))
    month = F.year(ts) * 12 + F.month(ts) - 1
    return F.when(step == "MS", month).when(step == "W", F.floor((day + 3) / 7)).otherwise(day).cast("long")


def bin_label(number: Column, step: Column) -> Column:
    """First day of a month, the Sunday of a week, or the day itself."""
    month = F.make_date((number / 12).cast("int"), (number % 12 + 1).cast("int"), F.lit(1))
    week = F.date_from_unix_date((number * 7 + 3).cast("int"))
    return F.when(step == "MS", month).when(step == "W", week).otherwise(F.date_from_unix_date(number.cast("int")))


def resample(df: DataFrame, keys, ts: str, value: str) -> DataFrame:
    """Mean per bin at each series' own cadence; empty bins appear as nulls."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    span = df.groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_z"))
    days = (F.unix_micros(F.col("_z").cast("timestamp")) - F.unix_micros(F.col("_a").cast("timestamp"))) / 8.64e10
    span = span.select(*keys, cadence(days).alias("cadence"), "_a", "_z")
    rows = attach(df, span, keys).withColumn("_bin", cadence_bin(F.col(ts), F.col("cadence")))
    means = rows.groupBy(*keys, "_bin").agg(F.avg(value).alias("mean"))
    every = span.select(*keys, "cadence", F.explode(F.sequence(
        cadence_bin(F.col("_a"), F.col("cadence")), cadence_bin(F.col("_z"), F.col("cadence")))).alias("_bin"))
    full = attach(every, means, [*keys, "_bin"])
    return full.select(*keys, "cadence", bin_label(F.col("_bin"), F.col("cadence")).alias("bin"), "mean")


def regional_reference(df: DataFrame, start, end, product: str = "product", site: str = "site",
                       ts: str = "ts", value: str = "temp", flag_column: str | None = "Flag_T",
                       min_rows: int = 200) -> DataFrame:
    """Daily reference of every site from the products of all other sites.

    Per-day totals minus the site's own share: one pass however many sites and
    products there are.
    """
    rows = df.where(F.col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    if flag_column is not None:
        rows = rows.where(F.col(flag_column) <= 2)
    day = F.date_trunc("day", F.col(ts)).cast("timestamp_ntz").alias("day")
    daily = rows.groupBy(site, product, day).agg(
        F.sum(value).alias("_s"), F.count(value).alias("_c"), F.count(F.lit(1)).alias("_n"))
    enough = attach_aggregates(daily, [site, product], {"_rows": F.sum("_n")}).where(F.col("_rows") >= min_rows)
    means = enough.where(F.col("_c") > 0).select(site, "day", (F.col("_s") / F.col("_c")).alias("_m"))
    own = means.groupBy(site, "day").agg(F.sum("_m").alias("_os"), F.count("_m").alias("_oc"))
    everyone = own.groupBy("day").agg(F.sum("_os").alias("_ts"), F.sum("_oc").alias("_tc"))
    # every site gets a row for every day of the calendar the products span
    sites = rows.groupBy(site).agg(F.lit(start).cast("timestamp_ntz").alias("_from"),
                                   F.lit(end).cast("timestamp_ntz").alias("_to"))
    calendar = sites.select(site, F.explode(F.sequence(
        F.date_trunc("day", "_from").cast("timestamp_ntz"), F.col("_to"), F.expr("INTERVAL 1 DAY"))).alias("day"))
    ref = attach(calendar.join(everyone, "day"), own, [site, "day"])
    left = F.col("_tc") - F.coalesce("_oc", F.lit(0))
    return ref.where(left > 0).select(
        site, "day", ((F.col("_ts") - F.coalesce("_os", F.lit(0.0))) / left).alias("reference"),
        left.alias("products"))


def referee(df: DataFrame, reference: DataFrame, deployment, replicate: str = "replicate",
            ts: str = "ts", temperature: str = "temp", flag_t: str | None = "Flag_T",
            rules: Referee | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores per replicate and one verdict per deployment.

    ``reference`` has the deployment key, ``day`` and ``reference``.
    ``recommended`` names the sound replicate, or is null.
    """
    rules = rules or Referee()
    keys = [deployment] if isinstance(deployment, str) else list(deployment)
    rows, grid, conflicts = _compared(df, keys, replicate, ts, temperature, flag_t, rules)
    summary = _disagreement(grid, conflicts, keys, rules)

    span = grid.groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_z"))
    days = (F.unix_micros(F.col("_z").cast("timestamp")) - F.unix_micros(F.col("_a").cast("timestamp"))) / 8.64e10
    step = span.select(*keys, cadence(days).alias("_step"))

    def binned(frame: DataFrame, at: str) -> DataFrame:
        return attach(frame, step, keys).withColumn("_bin", cadence_bin(F.col(at), F.col("_step")))

    ref = binned(reference.where(F.col("reference").isNotNull()), "day") \
        .groupBy(*keys, "_bin").agg(F.avg("reference").alias("_ref"))
    ref = _changes(ref, keys, "_ref", "_dref")
    ref_stat = ref.groupBy(*keys).agg(F.count("_dref").alias("_points"), F.count("_ref").alias("_refs"),
                                      (F.max("_ref") - F.min("_ref")).alias("_ramp"))
    off = binned(grid, ts).groupBy(*keys, "_bin").agg((F.avg(F.col("over").cast("double")) > 0.5).alias("_dis"))
    own = binned(rows, ts).groupBy(*keys, replicate, "_bin").agg(F.avg("_v").alias("_m"))
    own = _changes(own.where(F.col("_m").isNotNull()), [*keys, replicate], "_m", "_d")
    amp = own.groupBy(*keys, replicate).agg((F.max("_m") - F.min("_m")).alias("amplitude"))
    both = attach(own.join(ref, [*keys, "_bin"]), off, [*keys, "_bin"])
    dev, dis = F.col("_m") - F.col("_ref"), F.coalesce("_dis", F.lit(False))
    pair = F.col("_dref").isNotNull() & F.col("_d").isNotNull()
    corr = F.corr(F.when(pair, F.col("_dref")), F.when(pair, F.col("_d")))
    sc = both.groupBy(*keys, replicate).agg(
        F.when(F.count_if(pair) >= 2, F.nanvl(corr, F.lit(None).cast("double"))).alias("change_corr"),
        F.avg(dev).alias("bias"), (F.avg(F.when(dis, dev)) - F.avg(F.when(~dis, dev))).alias("bias_shift"))
    scores = attach(attach(amp, sc, [*keys, replicate]), ref_stat, keys)
    scores = scores.withColumn("amplitude_ratio", F.when(F.col("_ramp") != 0, F.col("amplitude") / F.col("_ramp")))

    usable = F.col("change_corr").isNotNull()
    shift = F.when(usable, F.abs("bias_shift"))
    ratio = F.when(usable, F.col("amplitude_ratio"))
    swing = F.when(ratio > 0, F.greatest(ratio, 1 / ratio)).when(ratio.isNotNull(), F.lit(float("inf")))
    rep = F.col(replicate)
    g = scores.groupBy(*keys).agg(      # two to four rows per deployment
        F.count("change_corr").alias("_usable"), F.max("_points").alias("_points"),
        F.max("_refs").alias("_refs"),
        F.sort_array(F.collect_list("change_corr"), asc=False).alias("_corrs"),
        F.min_by(rep, F.when(usable, F.struct(-F.col("change_corr"), rep))).alias("_by_corr"),
        F.count(shift).alias("_ns"), F.max(shift).alias("_drift"), F.min(shift).alias("_steady"),
        F.min_by(rep, F.when(shift.isNotNull(), F.struct(shift, rep))).alias("_by_shift"),
        F.count(swing).alias("_nr"), F.max(swing).alias("_far"), F.min(swing).alias("_close"),
        F.min_by(rep, F.when(swing.isNotNull(), F.struct(swing, rep))).alias("_by_swing"))
    d = attach(summary, g, keys)
    top, second = F.try_element_at("_corrs", F.lit(1)), F.try_element_at("_corrs", F.lit(2))
    strong = top >= rules.min_secondary_corr
    by_shift = strong & (F.col("_ns") >= 2) & (F.col("_drift") >= rules.min_bias_shift) & (
        F.col("_drift") >= rules.bias_shift_ratio * F.greatest(F.col("_steady"), F.lit(1e-6)))
    by_swing = strong & (F.col("_nr") >= 2) & (F.col("_far") >= rules.amplitude_bad) & (
        F.col("_close") <= rules.amplitude_good)
    verdict = (F.when(F.col("conflicting"), "duplicate timestamps with conflicting values")
               .when(~F.col("disagrees"), "replicates agree")
               .when(F.coalesce("_refs", F.lit(0)) == 0, "disagreement, no reference to arbitrate")
               .when(F.col("_points") < rules.min_points, "disagreement, reference too short")
               .when(F.col("_usable") < 2, "disagreement, not enough comparable replicates")
               .when(top < rules.min_reference_corr, "disagreement, reference does not describe this site")
               .when(top - second >= rules.min_margin, "tracks the reference")
               .when(F.coalesce(by_shift, F.lit(False)), "offset stayed put")
               .when(F.coalesce(by_swing, F.lit(False)), "swing matches the reference")
               .otherwise("disagreement, replicates score too close to separate"))
    d = d.withColumn("verdict", verdict)
    named = (F.when(F.col("verdict") == "tracks the reference", F.col("_by_corr"))
             .when(F.col("verdict") == "offset stayed put", F.col("_by_shift"))
             .when(F.col("verdict") == "swing matches the reference", F.col("_by_swing")))
    verdicts = d.select(*keys, "fraction_over", "max_spread", "disagrees", "conflicting", "verdict",
                        named.alias("recommended"))
    return (scores.select(*keys, replicate, "change_corr", "bias", "bias_shift", "amplitude", "amplitude_ratio"),
            verdicts)


def _changes(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Change since the bin before; null after an empty bin."""
    s = ordered(df, keys, "_bin").scan(_pb=Prev("_bin"), _pv=Prev(value))
    step = F.when(F.col("_pb") == F.col("_bin") - 1, F.col(value) - F.col("_pv"))
    return s.with_columns(**{out: step}).rows.drop("_pb", "_pv")


def comparison(df: DataFrame, reference: DataFrame, keys, ts: str, value: str) -> DataFrame:
    """Daily correlation, bias and amplitude of each series against a reference."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    day = F.date_trunc("day", F.col(ts)).cast("timestamp_ntz").alias("day")
    own = df.groupBy(*keys, day).agg(F.avg(value).alias("_m"))
    on = [k for k in [*keys, "day"] if k in reference.columns]
    both = own.where(F.col("_m").isNotNull()).join(reference.where(F.col("reference").isNotNull()), on)
    return both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"), F.corr("_m", "reference").alias("corr"),
        F.avg(F.col("_m") - F.col("reference")).alias("bias"), (F.max("_m") - F.min("_m")).alias("amplitude"))
