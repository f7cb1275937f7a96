"""Rounding as numeric libraries do it: scale, round half to even, scale back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(value: Column, digits: int) -> Column:
    scale = F.lit(float(10 ** digits))
    return F.rint(value * scale) / scale
