"""Day/month order and clock formats of exported time stamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelint.operators.ordering import attach_aggregates
from tidelint.operators.qc_tests import c

# The forms in which exports write dates and clocks.
_DATE = r"^\s*(\d{1,2})\s*[/-]\s*(\d{1,2})\s*[/-]\s*(\d{2,4})"
_ISO = r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})"
_CLOCK = r"(\d{1,2}):(\d{1,2})(?::(\d{1,2}(?:\.\d+)?))?\s*([AaPp][Mm])?"
_WORDY_CLOCK = r"(?i)(\d{1,2})h(\d{1,2})min(\d{1,2})s"


def _int(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def normal_clock(text: Column) -> Column:
    """``04h0min0s`` becomes ``04:0:0``."""
    return F.regexp_replace(F.trim(text), _WORDY_CLOCK, r"$1:$2:$3")


_FIXED = r"^\d{2}/\d{2}/(\d{4}|\d{2}) \d{2}:\d{2}:\d{2}$"


def stamp(text: Column, day_first: Column) -> Column:
    """Timestamp of one cell given the file's field order; null if impossible.

    The usual fixed-width form is cut by position; every other one is matched.
    """
    wide = F.length(text) == 19

    def cut(at: int, size: int = 2, extra: int = 0) -> Column:
        start = F.when(wide, F.lit(at + extra)).otherwise(F.lit(at)) if extra else F.lit(at)
        return F.substring(text, start, F.lit(size)).cast("int")

    year = F.when(wide, cut(7, 4)).otherwise(F.when(cut(7) < 69, cut(7) + 2000).otherwise(cut(7) + 1900))
    quick = F.try_make_timestamp_ntz(
        year, F.when(day_first, cut(4)).otherwise(cut(1)), F.when(day_first, cut(1)).otherwise(cut(4)),
        cut(10, extra=2), cut(13, extra=2), cut(16, extra=2).cast("double"))
    return F.when(F.rlike(text, F.lit(_FIXED)), quick).otherwise(_matched_stamp(text, day_first))


def _matched_stamp(text: Column, day_first: Column) -> Column:
    t = normal_clock(text)
    first, second = _int(t, _DATE, 1), _int(t, _DATE, 2)
    year = _int(t, _DATE, 3)
    year = F.when(year < 69, year + 2000).when(year < 100, year + 1900).otherwise(year)
    iso = F.rlike(t, F.lit(_ISO))
    y = F.when(iso, _int(t, _ISO, 1)).otherwise(year)
    m = F.when(iso, _int(t, _ISO, 2)).when(day_first, second).otherwise(first)
    d = F.when(iso, _int(t, _ISO, 3)).when(day_first, first).otherwise(second)
    half = F.lower(F.regexp_extract(t, _CLOCK, 4))
    hour = F.coalesce(_int(t, _CLOCK, 1), F.lit(0))
    hour = F.when(half == "pm", hour % 12 + 12).when(half == "am", hour % 12).otherwise(hour)
    minute = F.coalesce(_int(t, _CLOCK, 2), F.lit(0))
    second_ = F.coalesce(F.regexp_extract(t, _CLOCK, 3).try_cast("double"), F.lit(0.0))
    return F.try_make_timestamp_ntz(y, m, d, hour, minute, second_)


def field_order(df: DataFrame, file_keys: list[str], text: str) -> DataFrame:
    """Per file: does its own evidence prove which field is the day?

    A first field above 12 proves day-first, else a second field above 12
    proves month-first, else nothing is proven (``order`` is null).
    """
    t = normal_clock(c(text))
    work = df.groupBy(*file_keys).agg(F.max(_int(t, _DATE, 1)).alias("first_max"),
                                      F.max(_int(t, _DATE, 2)).alias("second_max"))
    return work.withColumn("order", F.when(F.col("first_max") > 12, "day-first")
                           .when(F.col("second_max") > 12, "month-first"))


def parse_stamps(df: DataFrame, file_keys: list[str], text: str, out: str) -> DataFrame:
    """Parse a whole file's stamps in the order it proves; day-first when it
    proves none, noted in ``order_note``."""
    t = normal_clock(c(text))
    work = attach_aggregates(df, file_keys, {"_f": F.max(_int(t, _DATE, 1)),
                                             "_s": F.max(_int(t, _DATE, 2))})
    month_first = ~F.coalesce(F.col("_f") > 12, F.lit(False)) & F.coalesce(F.col("_s") > 12, F.lit(False))
    note = (F.when(month_first, "month-first").when(F.col("_f") > 12, "day-first")
            .when(F.col("_f").isNotNull(), "day-first assumed"))
    return work.select(*[c(x) for x in df.columns], stamp(c(text), ~month_first).alias(out),
                       note.alias("order_note"))
