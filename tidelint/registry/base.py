"""How the sample tables stand in for sensor data.

``events`` is a set of irregular scalar series, ``lineitem`` a set of dense
ones; missing values, light, replicates and current cells are derived from
their columns by the same rule in Spark and in SQL. Every query reads whole
tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def scalar_series(spark: SparkSession, path: str) -> DataFrame:
    """One series per user; one value in 17 is missing."""
    e = table(spark, path, "events")
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("series_id"),
        F.concat(F.lit("S"), (F.col("user_id") % 5).cast("string")).alias("site"),
        "ts", F.col("event_id").alias("sample_no"), "event_type", "value",
        F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("v"))


EV = """ev AS (SELECT 'u' || user_id AS series_id, 'S' || (user_id % 5) AS site, ts,
  event_id AS sample_no, event_type, value,
  CASE WHEN event_id % 17 <> 0 THEN value END AS v FROM events)"""


def water_series(spark: SparkSession, path: str) -> DataFrame:
    """The same series as temperature, salinity, conductivity and pressure."""
    s = scalar_series(spark, path)
    return s.select(
        "series_id", "site", "ts", "sample_no",
        (F.col("v") / 8).alias("T"),
        F.when(F.col("sample_no") % 13 != 0, 38 - F.col("value") / 20).alias("S"),
        (F.col("value") / 4).alias("C"),
        F.when(F.col("sample_no") % 29 != 0, F.col("value") / 2).alias("P"))


WATER = EV + """,
water AS (SELECT series_id, site, ts, sample_no, v / 8 AS "T",
  CASE WHEN sample_no % 13 <> 0 THEN 38 - value / 20 END AS "S", value / 4 AS "C",
  CASE WHEN sample_no % 29 <> 0 THEN value / 2 END AS "P" FROM ev)"""


def light_series(spark: SparkSession, path: str) -> DataFrame:
    """Temperature and a light channel that is lit from 6 to 18 h and fades in
    the last third of the month for every third user."""
    s = scalar_series(spark, path)
    hour = F.hour("ts")
    day = F.dayofmonth("ts")
    fouled = (F.col("uid") % 3 == 0) & (day > 20)
    return s.withColumn("uid", F.substring("series_id", 2, 20).cast("long")).select(
        "series_id", "site", "ts", "sample_no", (F.col("v") / 10).alias("temp"),
        F.when(F.col("v").isNull(), F.lit(None))
        .when((hour >= 6) & (hour < 18),
              F.when(fouled, F.col("value")).otherwise(F.col("value") * 100))
        .otherwise(0.0).cast("double").alias("lux"))


LIGHT = EV + """,
light AS (SELECT series_id, site, ts, sample_no, v / 10 AS temp,
  CAST(CASE WHEN v IS NULL THEN NULL
       WHEN hour(ts) >= 6 AND hour(ts) < 18 THEN
         CASE WHEN CAST(substr(series_id, 2) AS BIGINT) % 3 = 0 AND day(ts) > 20
              THEN value ELSE value * 100 END
       ELSE 0.0 END AS DOUBLE) AS lux FROM ev)"""


def steps_sql(source: str, keys: str = "series_id", by: str = "ts, sample_no") -> str:
    """CTEs ``steps`` and ``prof``: row order, step and sampling profile."""
    return f"""
steps AS (SELECT *, row_number() OVER w - 1 AS pos,
    epoch_us(ts) - lag(epoch_us(ts)) OVER w AS step FROM {source}
    WINDOW w AS (PARTITION BY {keys} ORDER BY {by})),
prof AS (SELECT {keys}, count(*) AS n, min(ts) AS t_start, max(ts) AS t_end,
    median(step) / 1e6 AS interval_s FROM steps GROUP BY {keys})"""


def sigma_sql(source: str, value: str, out: str, window_s: int | None, n_src: str = "prof") -> str:
    """CTE ``out``: the rows of ``source`` (which carries pos) with a spread ``sigma``."""
    win = "p.n" if window_s is None else f"CAST(floor({window_s}.0 / p.interval_s) AS BIGINT)"
    return f"""
{out}_b AS (SELECT s.*, {value} AS x, p.n, {win} AS win FROM {source} s
    JOIN {n_src} p USING (series_id)),
{out}_m AS (SELECT *, median(x) OVER (PARTITION BY series_id) AS gm FROM {out}_b),
{out}_g AS (SELECT series_id, 1.4826 * median(abs(x - gm)) AS gmad, stddev_pop(x) AS gsd
    FROM {out}_m GROUP BY series_id),
{out}_r AS (SELECT *, CASE WHEN count(x) OVER f >= 3 THEN median(x) OVER f END AS rm,
    CASE WHEN count(x) OVER f >= 3 THEN stddev_samp(x) OVER f END AS rsd FROM {out}_m
    WINDOW f AS (PARTITION BY series_id ORDER BY pos
      ROWS BETWEEN (win - 1 - (win - 1) // 2) PRECEDING AND ((win - 1) // 2) FOLLOWING)),
{out}_d AS (SELECT *, CASE WHEN count(abs(x - rm)) OVER f >= 3
    THEN 1.4826 * median(abs(x - rm)) OVER f END AS rmad FROM {out}_r
    WINDOW f AS (PARTITION BY series_id ORDER BY pos
      ROWS BETWEEN (win - 1 - (win - 1) // 2) PRECEDING AND ((win - 1) // 2) FOLLOWING)),
{out}_l AS (SELECT *, CASE WHEN rmad > 0 THEN rmad ELSE rsd END AS ls FROM {out}_d),
{out}_f AS (SELECT *,
    first_value(ls IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY pos
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx,
    last_value(ls IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv FROM {out}_l),
{out} AS (SELECT f.*, CASE WHEN win >= n OR win < 11 THEN
      CASE WHEN gmad > 0 THEN gmad ELSE gsd END
    ELSE coalesce(nx, pv) END AS sigma FROM {out}_f f JOIN {out}_g USING (series_id))"""


def cells(spark: SparkSession, path: str) -> DataFrame:
    """Current-profiler rows: a record per order, a depth cell per line."""
    li = table(spark, path, "lineitem")
    return li.select(
        F.concat(F.lit("S"), (F.col("l_suppkey") % 4).cast("string")).alias("site"),
        F.col("l_orderkey").alias("record"), F.col("l_shipdate").alias("ts"),
        F.col("l_linenumber").alias("cell"), (F.col("l_linenumber") * 2.0).alias("depth"),
        F.when(F.col("l_partkey") % 23 != 0, F.col("l_quantity") * 7).alias("speed"),
        (F.col("l_extendedprice") % 360).alias("direction"),
        F.when(F.col("l_partkey") % 31 != 0, F.col("l_quantity") - 25).alias("east"),
        ((F.col("l_partkey") % 41) - 20).cast("double").alias("north"),
        (F.col("l_tax") * 800).alias("stdev"), (F.col("l_discount") * -800).alias("strength"),
        F.when(F.col("l_returnflag") == "R", F.col("l_suppkey") % 2).otherwise(0).cast("double").alias("state"),
        F.when(F.col("l_partkey") % 19 != 0, (F.col("l_suppkey") % 50).cast("double")).alias("tilt"),
        F.col("l_partkey").alias("part"))


CELLS = """cells AS (SELECT 'S' || (l_suppkey % 4) AS site, l_orderkey AS record, l_shipdate AS ts,
  l_linenumber AS cell, l_linenumber * 2.0::DOUBLE AS depth,
  CASE WHEN l_partkey % 23 <> 0 THEN l_quantity * 7 END AS speed, l_extendedprice % 360 AS direction,
  CASE WHEN l_partkey % 31 <> 0 THEN l_quantity - 25 END AS east,
  CAST((l_partkey % 41) - 20 AS DOUBLE) AS north, l_tax * 800 AS stdev, l_discount * -800 AS strength,
  CAST(CASE WHEN l_returnflag = 'R' THEN l_suppkey % 2 ELSE 0 END AS DOUBLE) AS state,
  CASE WHEN l_partkey % 19 <> 0 THEN CAST(l_suppkey % 50 AS DOUBLE) END AS tilt, l_partkey AS part FROM lineitem)"""
