"""Checks over every product at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelint.functions.flags import FLAG_MEANING
from tidelint.operators.ordering import Prev, ordered
from tidelint.operators.preprocess import SCALE_FACTORS
from tidelint.operators.qc_tests import c

# Variables that cannot be negative in a good row.
NON_NEGATIVE = ("pH", "tur", "chl", "PAR", "O2", "org", "CO2")
# Bounds of a plausible good row.
PLAUSIBLE = {"pH": (0.0, 14.0), "T": (-5.0, 45.0), "S": (0.0, 45.0)}


def _entries(df: DataFrame, keys: list[str], values: dict[str, str], flags: dict[str, str],
             sensor: dict[str, tuple], environment: dict[str, tuple]) -> DataFrame:
    """One row per sample and variable, with the variable's limits."""
    none = F.lit(None).cast("double")
    parts = []
    for var, col in values.items():
        s, e = sensor.get(var), environment.get(var)
        f = F.col(flags[var]).cast("int") if flags.get(var) in df.columns else F.lit(None).cast("int")
        parts.append(F.struct(
            F.lit(var).alias("var"), c(col).cast("double").alias("value"), f.alias("flag"),
            (F.lit(float(s[0])) if s else none).alias("s_lo"), (F.lit(float(s[1])) if s else none).alias("s_hi"),
            (F.lit(float(e[0])) if e else none).alias("e_lo"), (F.lit(float(e[1])) if e else none).alias("e_hi"),
            F.lit(flags.get(var) in df.columns).alias("flagged")))
    long = df.select(*keys, F.explode(F.array(*parts)).alias("_e")).select(*keys, "_e.*")
    return long.where(F.col("value").isNotNull())


def scale_defects(df: DataFrame, keys: list[str], values: dict[str, str], environment: dict[str, tuple]) -> DataFrame:
    """Products whose variable is almost never inside its envelope; a lost
    decimal separator when the values are whole and one factor fits."""
    long = _entries(df, keys, values, {}, {}, environment).where(F.col("e_lo").isNotNull())
    v = F.col("value")

    def inside(x: Column) -> Column:
        return F.avg(((x >= F.col("e_lo")) & (x <= F.col("e_hi"))).cast("double"))

    g = long.groupBy(*keys, "var").agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("vmin"), F.max(v).alias("vmax"), inside(v).alias("_in"),
        (F.avg((v == F.rint(v)).cast("double")) > 0.98).alias("integers"),
        *[inside(v / f).alias(f"_f{int(f)}") for f in SCALE_FACTORS])
    factor = F.lit(None).cast("double")
    for f in reversed(SCALE_FACTORS):
        factor = F.when(F.col(f"_f{int(f)}") > 0.98, F.lit(f)).otherwise(factor)
    g = g.where((F.col("n") >= 10) & (F.col("_in") <= 0.02)).withColumn("factor", factor)
    return g.select(*keys, "var", "n", "vmin", "vmax", "integers", "factor",
                    F.when(F.col("integers") & F.col("factor").isNotNull(), "LOST SEPARATOR")
                    .otherwise("not a scale defect").alias("verdict"))


def impossible_values(df: DataFrame, keys: list[str], values: dict[str, str], flags: dict[str, str],
                      sensor: dict[str, tuple], environment: dict[str, tuple]) -> DataFrame:
    """Values outside the instrument's limit and how many carry flag 4; a
    variable without such a limit answers to its envelope with 3 or 4."""
    limits = {v: sensor.get(v) or environment[v] for v in values}
    long = _entries(df, keys, values, flags, limits, {})
    sensor_ok = F.col("flag") == 4
    env_ok = F.col("flag").isin(3, 4)
    caught = F.when(F.col("var").isin([v for v in values if v in sensor]), sensor_ok).otherwise(env_ok)
    out = (F.col("value") < F.col("s_lo")) | (F.col("value") > F.col("s_hi"))
    g = long.groupBy(*keys, "var").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(out).alias("n_out"), F.count_if(out & caught).alias("n_caught"),
        F.max(F.when(out, F.abs("value"))).alias("worst"), F.bool_and("flagged").alias("_flagged"))
    g = g.where((F.col("_n") >= 10) & (F.col("n_out") > 0) & F.col("_flagged"))
    return g.select(*keys, "var", "n_out", "n_caught", "worst", (F.col("n_caught") < F.col("n_out")).alias("unflagged"))


def invariants(df: DataFrame, keys: list[str], by: list[str], ts: str, values: dict[str, str],
               flags: dict[str, str]) -> DataFrame:
    """Findings per product: unknown codes, negatives and implausible values in
    good rows, time running backwards, and the share of missing temperature.

    All rules are aggregated in one pass and unfolded into finding rows.
    """
    s = ordered(df, keys, by).scan(_before=Prev(ts))
    rows = s.rows
    aggs, findings = [], []

    def finding(kind: str, name: str, n: Column, low: Column, high: Column) -> Column:
        d = "double"
        return F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), n.cast(d).alias("n"),
                        low.cast(d).alias("low"), high.cast(d).alias("high"))

    none = F.lit(None).cast("double")
    for var, flag_name in flags.items():
        bad = F.col(flag_name).isNotNull() & ~F.col(flag_name).isin(list(FLAG_MEANING))
        aggs += [F.count_if(bad).alias(f"_code_{var}"), F.min(F.when(bad, F.col(flag_name))).alias(f"_cl_{var}"),
                 F.max(F.when(bad, F.col(flag_name))).alias(f"_ch_{var}")]
        findings.append(finding("invalid_flag_code", flag_name, F.col(f"_code_{var}"), F.col(f"_cl_{var}"), F.col(f"_ch_{var}")))
    for var, col in values.items():
        if var not in flags:
            continue
        good = F.col(flags[var]) == 1
        if var in NON_NEGATIVE:
            neg = good & (c(col) < 0)
            aggs += [F.count_if(neg).alias(f"_neg_{var}"), F.min(F.when(neg, c(col))).alias(f"_nm_{var}")]
            findings.append(finding("negative_in_good", var, F.col(f"_neg_{var}"), F.col(f"_nm_{var}"), none))
        if var in PLAUSIBLE:
            lo, hi = PLAUSIBLE[var]
            odd = good & ((c(col) < lo) | (c(col) > hi))
            aggs += [F.count_if(odd).alias(f"_odd_{var}"), F.min(F.when(good, c(col))).alias(f"_gl_{var}"),
                     F.max(F.when(good, c(col))).alias(f"_gh_{var}")]
            findings.append(finding("implausible_good", var, F.col(f"_odd_{var}"), F.col(f"_gl_{var}"), F.col(f"_gh_{var}")))
    aggs.append(F.count_if(F.col(ts) < F.col("_before")).alias("_back"))
    findings.append(finding("datetime_backwards", ts, F.col("_back"), none, none))
    if "T" in flags:
        aggs += [F.avg(F.when(F.col(flags["T"]) == 9, 1.0).otherwise(0.0)).alias("_miss"), F.count(F.lit(1)).alias("_rows")]
        findings.append(finding("blanked_fraction", flags["T"], F.col("_rows"), F.round("_miss", 3), none))
    g = rows.groupBy(*keys).agg(*aggs)
    return g.select(*keys, F.explode(F.array(*findings)).alias("_f")).select(*keys, "_f.*").where(F.col("n") > 0)
