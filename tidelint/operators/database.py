"""Unifying qualified products into one database per layout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelint.operators.ordering import Prev, attach_aggregates, ordered
from tidelint.operators.qc_tests import c
from tidelint.plans.layouts import layout_of

SOURCE, FILE_NO, ROW_NO = "source_file", "file_no", "row_no"


def unify(products: list[tuple[str, DataFrame]], layout: str, ts: str = "Datetime",
          site: str = "Site") -> DataFrame:
    """Stack products of one layout; missing columns become null and the
    source of every row is kept. Rows without a time are dropped.

    ``products`` pairs a source name with a frame; a frame may already hold
    many files. Layouts never mix.
    """
    frames = []
    for number, (name, df) in enumerate(products):
        missing = [x for x in (ts, site) if x not in df.columns]
        if missing:
            raise ValueError(f"{name} is not a qualified table: no {', '.join(missing)}")
        found = layout_of(df.columns)
        if found != layout:
            raise ValueError(f"{name} has the {found} layout, not {layout}; layouts never mix")
        df = df.withColumns({SOURCE: F.col(SOURCE) if SOURCE in df.columns else F.lit(name),
                             FILE_NO: F.col(FILE_NO) if FILE_NO in df.columns else F.lit(number),
                             ROW_NO: F.col(ROW_NO) if ROW_NO in df.columns else F.monotonically_increasing_id()})
        frames.append(df)
    if not frames:
        raise ValueError("nothing to unify")
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return both.where(c(ts).isNotNull())


def drop_exact_duplicates(df: DataFrame, provenance: list[str], order: list[str]) -> DataFrame:
    """One row per distinct set of values outside ``provenance``: the first in
    ``order``. A grouped minimum, so a huge group of copies shrinks before the
    shuffle."""
    values = [x for x in df.columns if x not in provenance]
    first = F.min(F.struct(*order, *[x for x in provenance if x not in order])).alias("_first")
    g = df.groupBy(*[c(x) for x in values]).agg(first)
    return g.select(*[c(x) if x in values else F.col(f"_first.{x}").alias(x) for x in df.columns])


def overlaps(df: DataFrame, key: list[str], source: str = SOURCE) -> DataFrame:
    """Keys held by several rows with different values, and who holds them.
    Expects exact duplicates to be gone."""
    known = df.dropna(subset=[k for k in key])
    per = known.groupBy(*[c(k) for k in key], source).agg(F.count(F.lit(1)).alias("rows"))
    whole = F.sum("rows").over(Window.partitionBy(*[c(k) for k in key]))     # one row per source of a key
    return per.withColumn("_all", whole).where(F.col("_all") > 1).drop("_all")


def overlap_offenders(overlapping: DataFrame, source: str = SOURCE) -> DataFrame:
    return overlapping.groupBy(source).agg(F.sum("rows").alias("rows"))


def overlap_key(columns) -> list[str]:
    """Site and instant, plus column and cell where the table is tidy."""
    return ["Site", "Datetime"] + [x for x in ("Column", "Cell") if x in columns and layout_of(columns) == "doppler"]


def sorted_database(df: DataFrame, site: str = "Site", ts: str = "Datetime", by_first_sample: bool = False,
                    tie: list[str] | None = None) -> DataFrame:
    """Site blocks, chronological inside; blocks alphabetical or by first sample."""
    tie = tie if tie is not None else [x for x in (FILE_NO, ROW_NO) if x in df.columns]
    if not by_first_sample:
        return df.orderBy(c(site), c(ts), *tie)
    ranked = attach_aggregates(df, site, {"_first": F.min(c(ts))})
    return ranked.orderBy("_first", c(site), c(ts), *tie).drop("_first")


def out_of_order(df: DataFrame, keys, by, ts: str = "ts") -> DataFrame:
    """How many rows of each series lie before the row above them."""
    s = ordered(df, keys, by).scan(_before=Prev(ts))
    return s.rows.groupBy(*([keys] if isinstance(keys, str) else keys)).agg(
        F.count_if(F.col(ts) < F.col("_before")).alias("backwards"))


def summary(df: DataFrame, site: str = "site", ts: str = "ts", source: str = SOURCE) -> DataFrame:
    """Rows, sites, period and source files of a database."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(site).alias("sites"),
                  F.min(ts).alias("first"), F.max(ts).alias("last"), F.count_distinct(source).alias("sources"))


def site_summary(df: DataFrame, site: str = "site", ts: str = "ts") -> DataFrame:
    return df.groupBy(site).agg(F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def parameter_extent(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Axis limits: the data's range plus a fifth on both sides, never below 0."""
    g = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")).where(F.col("_lo").isNotNull())
    span = 0.2 * (F.col("_hi") - F.col("_lo"))
    pad = F.when(span != 0, span).when(F.col("_hi") != 0, 0.2 * F.abs("_hi")).otherwise(F.lit(1.0))
    return g.select(*keys, F.greatest(F.col("_lo") - pad, F.lit(0.0)).alias("low"), (F.col("_hi") + pad).alias("high"))
