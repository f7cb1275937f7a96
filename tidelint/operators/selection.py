"""Filters and axes of a selection of qualified rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelint.functions.timespec import micros
from tidelint.operators.ordering import PIECE, Cuts, attach_aggregates
from tidelint.operators.qc_tests import c


def time_window(df: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """Inclusive at both ends; no-op unless both are given."""
    if start is None or end is None:
        return df
    return df.where(F.col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def select_rows(df: DataFrame, sites: list[str] | None = None, years: list[int] | None = None,
                site: str = "site", ts: str = "ts") -> DataFrame:
    """Rows of the chosen sites and years; an empty choice selects nothing."""
    if sites is not None:
        df = df.where(F.col(site).isin(list(sites)))
    if years is not None:
        df = df.where(F.year(ts).isin(list(years)))
    return df


def depth_band(df: DataFrame, low: float | None, high: float | None, depth: str) -> DataFrame:
    if low is None or high is None:
        return df
    return df.where(c(depth).between(low, high))


def semester(ts: Column) -> Column:
    return F.when(F.month(ts) <= 6, 1).otherwise(2)


def first_midnight_hours(df: DataFrame, keys, ts: str = "ts", out: str = "hours", cuts: Cuts | None = None) -> DataFrame:
    """Hours since the midnight before the first sample of each group."""
    work = attach_aggregates(df, keys, {"_first": F.min(ts)}, cuts, light=PIECE in df.columns)
    origin = F.date_trunc("day", F.col("_first")).cast("timestamp_ntz")
    hours = (micros(F.col(ts)) - micros(origin)) / 3.6e9
    return work.select(*[c(x) for x in df.columns], hours.alias(out))


def clock_window(df: DataFrame, anchor: DataFrame, start: str, end: str, hours: str = "hours") -> DataFrame:
    """Keep the rows whose hours lie in [start, end], both taken relative to
    the first midnight of ``anchor`` (a one-row frame with column ``first``)."""
    zero = F.date_trunc("day", F.col("first")).cast("timestamp_ntz")
    bounds = anchor.select(*[((micros(F.lit(t).cast("timestamp_ntz")) - micros(zero)) / 3.6e9).alias(n)
                             for n, t in (("_lo", start), ("_hi", end))])
    # one row by construction: an ungrouped aggregate
    return (df.join(F.broadcast(bounds), F.col(hours).between(F.col("_lo"), F.col("_hi")))
            .select(*[c(x) for x in df.columns]))


def coverage(df: DataFrame, ts: str = "ts", keys: list[str] | None = None) -> DataFrame:
    """First and last instant, floored and ceiled to the minute."""
    span = df.where(F.col(ts).isNotNull()).groupBy(*(keys or [])).agg(
        F.min(ts).alias("first"), F.max(ts).alias("last"))
    low = F.date_trunc("minute", F.col("first")).cast("timestamp_ntz")
    high = F.date_trunc("minute", F.col("last")).cast("timestamp_ntz")
    return span.withColumns({"available_from": low, "available_to": F.when(
        high < F.col("last"), high + F.expr("INTERVAL 1 MINUTE")).otherwise(high)})


def valid_window(start: Column, end: Column, low: Column, high: Column) -> Column:
    """A requested window must be ordered and lie inside the coverage."""
    return F.coalesce((end > start) & (start >= low) & (end <= high), F.lit(False))


def gap_nodes(df: DataFrame, nexts: Column, ts: str, value: str) -> DataFrame:
    """Add a null point one hour after each sample that is followed by a gap of
    more than an hour. ``nexts`` is the series' next timestamp."""
    later = F.col(ts) + F.expr("INTERVAL 1 HOUR")
    here = F.struct(F.col(ts).alias("t"), c(value).alias("v"))
    hole = F.struct(later.alias("t"), F.lit(None).cast("double").alias("v"))
    points = F.when(nexts > later, F.array(here, hole)).otherwise(F.array(here))
    rest = [x for x in df.columns if x not in (ts, value)]
    out = df.select(*[c(x) for x in rest], F.explode(points).alias("_pt"))
    return out.select(*[F.col("_pt.t").alias(x) if x == ts else F.col("_pt.v").alias(x) if x == value else c(x)
                        for x in df.columns])
