"""Clear-sky ceiling of the daily light peak by latitude and day of year."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TRANSMITTANCE = 0.75
_MIN_SINE = 0.05           # keeps polar winters from dividing by almost zero


def _ceiling(day: float, latitude: float, transmittance: float) -> float:
    declination = math.radians(23.44) * -math.cos(2 * math.pi * (day + 10) / 365.25)
    noon = math.pi / 2 - abs(math.radians(latitude) - declination)
    sine = max(math.sin(noon), _MIN_SINE)
    return sine * transmittance ** (1.0 / sine)


def yearly_maximum(latitude: float, transmittance: float = TRANSMITTANCE) -> float:
    return max(_ceiling(float(d), latitude, transmittance) for d in range(1, 366))


def _ceiling_of(day: Column, latitude: Column, transmittance: float) -> Column:
    declination = F.lit(math.radians(23.44)) * -F.cos(F.lit(2 * math.pi) * (day + 10) / 365.25)
    noon = F.lit(math.pi / 2) - F.abs(F.radians(latitude) - declination)
    sine = F.greatest(F.sin(noon), F.lit(_MIN_SINE))
    return sine * F.pow(F.lit(transmittance), F.lit(1.0) / sine)


def yearly_maximum_of(latitude: Column, transmittance: float = TRANSMITTANCE) -> Column:
    """The same of a column; meant for one row a place."""
    days = F.transform(F.sequence(F.lit(1), F.lit(365)), lambda d: _ceiling_of(d.cast("double"), latitude, transmittance))
    return F.array_max(days)


def clear_sky_factor(day: Column, latitude: float | Column, transmittance: float = TRANSMITTANCE, maximum: Column | None = None) -> Column:
    """1.0 at the brightest time of the year. With a column of latitudes, ``maximum`` is that of their year."""
    if isinstance(latitude, Column):
        top = maximum if maximum is not None else yearly_maximum_of(latitude, transmittance)
    else:
        top, latitude = F.lit(yearly_maximum(latitude, transmittance)), F.lit(float(latitude))
    return _ceiling_of(F.dayofyear(day).cast("double"), latitude, transmittance) / top
