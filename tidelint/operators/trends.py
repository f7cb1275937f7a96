"""Polynomial tendencies, solved from sums per group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelint.operators.ordering import PIECE, Cuts, Position, RunningSum, attach, attach_aggregates, ordered
from tidelint.operators.qc_tests import c


def _solve(powers: pd.Series, moments: pd.Series) -> pd.Series:
    """Coefficients (constant first) of each group's normal equations."""
    out = []
    for s, m in zip(powers, moments, strict=True):
        k = len(m)
        normal = np.array([[s[i + j] for j in range(k)] for i in range(k)], dtype=float)
        out.append(np.linalg.lstsq(normal, np.asarray(m, dtype=float), rcond=None)[0])
    return pd.Series(out)


def _polynomial(x: Column, coefficients: Column, degree: int) -> Column:
    total = coefficients[degree]
    for k in range(degree - 1, -1, -1):
        total = total * x + coefficients[k]
    return total


def fit(df: DataFrame, keys, x: Column, y: Column, degree: int, out: str = "fit",
        used: Column | None = None, cuts: Cuts | None = None, light: bool = False,
        span: tuple[Column, Column] | None = None) -> DataFrame:
    """Least-squares polynomial of y over x, per group, floored at 0.

    Every row of ``df`` is returned; rows outside ``used`` get null. x is
    scaled to [-1, 1] per group and a group is reduced to sums. A straight line
    is solved in closed form; higher degrees solve one small system per group.
    Groups with fewer points than coefficients get null. ``light`` is that of
    ``attach_aggregates``, ``span`` the least and largest x in use where they are known.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    kept = [c(n) for n in df.columns]
    on = F.coalesce(used, F.lit(False)) if used is not None else F.lit(True)
    work = df.withColumns({"_x": F.when(on, x.cast("double")), "_y": F.when(on, y.cast("double"))})
    if span is None:
        work = attach_aggregates(work, keys, {"_lo": F.min("_x"), "_hi": F.max("_x")}, cuts, light)
    else:
        work = work.withColumns({"_lo": span[0].cast("double"), "_hi": span[1].cast("double")})
    span = F.col("_hi") - F.col("_lo")
    work = work.withColumn("_u", F.when(F.col("_x").isNotNull(), F.when(
        span > 0, 2 * (F.col("_x") - F.col("_lo")) / span - 1).otherwise(F.lit(0.0))))
    u, v = F.col("_u"), F.col("_y")
    if degree == 1:
        work = attach_aggregates(work, keys, {"_n": F.count(u), "_su": F.sum(u), "_sv": F.sum(v),
                                              "_suu": F.sum(u * u), "_suv": F.sum(u * v)}, cuts, light)
        det = F.col("_n") * F.col("_suu") - F.col("_su") * F.col("_su")
        slope = F.when(det > 0, (F.col("_n") * F.col("_suv") - F.col("_su") * F.col("_sv")) / det)
        value = F.greatest((F.col("_sv") - slope * F.col("_su")) / F.col("_n") + slope * u, F.lit(0.0))
        return work.select(*kept, F.when(u.isNotNull() & slope.isNotNull(), value).alias(out))
    power = [F.lit(1.0)]
    for _ in range(2 * degree):
        power.append(power[-1] * u)
    sums = work.where(u.isNotNull()).groupBy(*keys).agg(
        F.array(*[F.sum(p) for p in power]).alias("_s"),
        F.array(*[F.sum(p * v) for p in power[:degree + 1]]).alias("_m"),
        F.count(F.lit(1)).alias("_n")).where(F.col("_n") > degree)
    coef = sums.select(*keys, F.pandas_udf(_solve, "array<double>")("_s", "_m").alias("_c"))
    value = F.greatest(_polynomial(u, F.col("_c"), degree), F.lit(0.0))
    return attach(work, coef, keys, cuts if light else None).select(*kept, F.when(u.isNotNull() & F.col("_c").isNotNull(), value).alias(out))


def series_trend(df: DataFrame, keys, by, value: str, degree: int, out: str = "fit",
                 only: Column | None = None, keep_all: bool = False, cuts: Cuts | None = None) -> DataFrame:
    """Tendency of a series over its sample index.

    The series is trimmed to its first and last reading. With at most a quarter
    missing, gaps take the mean; otherwise they are left out. ``only`` limits
    the series that are fitted; ``keep_all`` returns unfitted rows as well.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    v = c(value)
    s = ordered(df, keys, by, cuts)
    # long series in few groups are stored once, all that follows reads them and joins small tables
    light = not s.cuts.none and s.cuts.few(keys)
    s = s.scan(_stored=light, _pos=Position(), _seen=RunningSum(v.isNotNull().cast("long")))
    known = v.isNotNull()
    rows = attach_aggregates(s.rows, keys, {
        "_first": F.min(F.when(known, F.col("_pos"))), "_last": F.max(F.when(known, F.col("_pos"))),
        "_valid": F.count(v), "_mean": F.avg(v)}, s.cuts, light)
    length = F.col("_last") - F.col("_first") + 1
    sparse = length - F.col("_valid") > 0.25 * length
    used = F.col("_pos").between(F.col("_first"), F.col("_last")) & (~sparse | known)
    rows = rows.withColumns({"_idx": F.when(sparse, F.col("_seen") - 1).otherwise(F.col("_pos") - F.col("_first")),
                             "_val": F.coalesce(v, F.col("_mean")), "_used": F.coalesce(used, F.lit(False))})
    wanted = F.col("_used") if only is None else F.col("_used") & only
    # the index runs from 0 to the last row in use, so a series is not read to find its ends
    ends = (F.lit(0), F.when(sparse, F.col("_valid") - 1).otherwise(length - 1))
    fitted = fit(rows, keys, F.col("_idx"), F.col("_val"), degree, out, wanted, s.cuts, light, ends if light else None)
    if not keep_all:
        fitted = fitted.where("_used")
    return fitted.select(*[c(n) for n in df.columns if n != PIECE], out)


def profile_trend(df: DataFrame, keys, value: str, depth: str, degree: int, out: str = "fit") -> DataFrame:
    """Tendency of a parameter over depth; rows need both."""
    return fit(df.where(c(value).isNotNull() & c(depth).isNotNull()), keys, c(depth), c(value), degree, out)
