"""Time-window strings such as ``2D``, ``3H``, ``30M``, ``45S`` or ``WHOLE``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT_SECONDS = (("d", 86400), ("h", 3600), ("m", 60), ("s", 1))


def window_seconds(text: str) -> int | None:
    """Seconds of a window string; None means the whole series."""
    if re.search("whole", text, re.IGNORECASE):
        return None
    for unit, seconds in _UNIT_SECONDS:
        if re.search(r"\d+" + unit, text, re.IGNORECASE):
            return seconds * int(re.search(r"\d+", text).group())
    return None


def window_samples(text: str, interval_seconds: Column, n: Column) -> Column:
    """Window length in samples for each series."""
    seconds = window_seconds(text)
    if seconds is None:
        return n.cast("long")
    return (F.lit(float(seconds)) / interval_seconds).cast("long")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zone-less timestamp."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds(ts: Column) -> Column:
    return micros(ts) / F.lit(1e6)
