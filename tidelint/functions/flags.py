"""Flag digits and the algebra that rolls them up."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

GOOD, UNKNOWN, SUSPECT, BAD, DISMISSED, MISSING = 1, 2, 3, 4, 5, 9

# What each digit means in the flag legend.
FLAG_MEANING = {
    GOOD: "good data",
    UNKNOWN: "not evaluated",
    SUSPECT: "suspect",
    BAD: "bad data",
    DISMISSED: "dismissed (manual cut) / test switched off",
    MISSING: "missing value",
}

# Severity order, worst first.
SEVERITY = (BAD, SUSPECT, MISSING, GOOD, UNKNOWN, DISMISSED)


def flag(value: int) -> Column:
    return F.lit(value).cast("int")


def severity_rank(digit: Column) -> Column:
    """Position of a digit in SEVERITY; 0 is the worst."""
    out = F.lit(len(SEVERITY) - 1)
    for rank, code in enumerate(SEVERITY):
        out = F.when(digit == code, rank).otherwise(out)
    return out


def from_rank(rank: Column) -> Column:
    return F.element_at(F.array(*[flag(c) for c in SEVERITY]), rank + 1)


def worst_of(digits: Iterable[Column]) -> Column:
    """Worst digit of several; 5 when there is none."""
    digits = list(digits)
    if not digits:
        return flag(DISMISSED)
    ranks = [severity_rank(d) for d in digits]
    return from_rank(ranks[0] if len(ranks) == 1 else F.least(*ranks))


def worst_of_columns(names: list[str]) -> Column:
    """``worst_of`` over columns given by name, as one expression text."""
    if not names:
        return flag(DISMISSED)
    rank = " ".join(f"WHEN {code} THEN {i}" for i, code in enumerate(SEVERITY))
    ranks = ", ".join(f"CASE `{n}` {rank} ELSE {len(SEVERITY) - 1} END" for n in names)
    worst = f"least({ranks})" if len(names) > 1 else ranks
    return F.expr(f"element_at(array({', '.join(str(c) for c in SEVERITY)}), {worst} + 1)")


def worst_in_array(digits: Column) -> Column:
    """Worst digit of an array column of digits."""
    return from_rank(F.coalesce(F.array_min(F.transform(digits, severity_rank)),
                                F.lit(len(SEVERITY) - 1)))


def range_flag(value: Column, low: float, high: float, fail: int = BAD) -> Column:
    """9 when missing, ``fail`` outside [low, high], 1 inside."""
    return (F.when(value.isNull(), flag(MISSING))
            .when((value < F.lit(low)) | (value > F.lit(high)), flag(fail))
            .otherwise(flag(GOOD)))


def null_nan(value: Column) -> Column:
    """NaN is the missing value of the exports; SQL needs NULL."""
    return F.when(F.isnan(value), F.lit(None)).otherwise(value)
