"""Counts and statistics over qualified series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelint.functions.flags import FLAG_MEANING
from tidelint.functions.rounding import round_even
from tidelint.operators.qc_tests import c
from tidelint.operators.stats import group_medians

REPORT_CODES = (1, 2, 3, 4, 5, 9)


def unpivot(df: DataFrame, keys: list[str], values: list[str],
            name: str = "var", value: str = "value") -> DataFrame:
    return df.unpivot([c(k) for k in keys], [c(v) for v in values], name, value)


def statistics_table(df: DataFrame, variables: list[str], keys: list[str] | None = None) -> DataFrame:
    """Max, min, mean, median and population deviation of each variable that
    holds a value, whatever its flags; rounded half-even to 2."""
    keys = keys or []
    long = unpivot(df, keys, variables).where(F.col("value").isNotNull())
    group = [*keys, "var"]
    medians = group_medians(long, group, {"median": F.col("value")})
    base = long.groupBy(*group).agg(F.max("value").alias("max"), F.min("value").alias("min"),
                                    F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    both = base.join(medians, group)
    return both.select(*group, *[round_even(F.col(x), 2).alias(x) for x in ("max", "min", "mean", "median", "std")])


def test_report(flags: DataFrame, keys: list[str]) -> DataFrame:
    """Digits per test: one row per key, counts of each code. ``flags`` is long."""
    counts = [F.count_if(F.col("flag") == code).alias(f"n{code}") for code in REPORT_CODES]
    return flags.groupBy(*keys).agg(*counts)


def overall_report(df: DataFrame, keys: list[str], flags: list[str], valid_of: list[str]) -> DataFrame:
    """Totals, rows without bad data in ``valid_of``, and bad/suspect/missing per
    flag; those of the light channel too where ``df`` has its flag. Light does
    not count against a row."""
    flags = [*flags, *(["Flag_lux"] if "Flag_lux" in df.columns and "Flag_lux" not in flags else [])]
    any_bad = None
    for f in valid_of:
        hit = F.col(f) == 4
        any_bad = hit if any_bad is None else any_bad | hit
    aggs = [F.count(F.lit(1)).alias("total"), F.count_if(~any_bad).alias("valid")]
    for f in flags:
        short = f.removeprefix("Flag_")
        aggs += [F.count_if(F.col(f) == 4).alias(f"{short}_bad"),
                 F.count_if(F.col(f) == 3).alias(f"{short}_suspect"),
                 F.count_if(F.col(f) == 9).alias(f"{short}_missing")]
    return df.groupBy(*keys).agg(*aggs)


def flag_legend(spark: SparkSession, plan) -> DataFrame:
    """Position, test and variable of every flag digit."""
    rows = [(i + 1, t.label, t.variable) for i, t in enumerate(plan)]
    return spark.createDataFrame(rows, "flag_position int, test string, variable string")


def flag_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(FLAG_MEANING.items()), "flag_code int, meaning string")


def outside_range(df: DataFrame, keys: list[str], value: Column, low: Column, high: Column) -> DataFrame:
    """How many points a fixed scale would hide."""
    return df.groupBy(*keys).agg(
        F.count_if((value < low) | (value > high)).alias("outside"), F.count(value).alias("total"))
