"""Tests that look at one row only, usable on a stream as it is.

There is no streaming counterpart of the ordered tests: a series is qualified
when it is finished. Range tests, value clean-up and current qualification are
plain projections, so the same functions serve ``readStream`` frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidelint.functions.flags import BAD, SUSPECT, range_flag
from tidelint.operators.preprocess import clean_below_zero, zero_rule
from tidelint.operators.qc_tests import c
from tidelint.plans.criteria import VARIABLES, Criteria


def range_flags(df: DataFrame, criteria: Criteria | None = None) -> DataFrame:
    """Clean values below zero and add both range flags of every variable present."""
    criteria = criteria or Criteria()
    have = {k: name for k, (name, _s, _e) in VARIABLES.items() if name in df.columns}
    df = clean_below_zero(df, {n: zero_rule(n, criteria.environment) for n in have.values()})
    out = {}
    for key, name in have.items():
        if key in criteria.sensor:
            out[f"f_sensor_{key}"] = range_flag(c(name), *criteria.sensor[key], BAD)
        if key in criteria.environment:
            out[f"f_environment_{key}"] = range_flag(c(name), *criteria.environment[key], SUSPECT)
    return df.withColumns(out)
