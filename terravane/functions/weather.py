"""Unit conversions and derived weather variables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terravane.functions import as_column

# Magnus coefficients over water, and unit factors.
MAGNUS_A = 17.625
MAGNUS_B = 243.04
KELVIN_OFFSET = 273.15


def kelvin_to_celsius(value) -> Column:
    return as_column(value) - KELVIN_OFFSET


def metres_to_mm(value) -> Column:
    return as_column(value) * 1000.0


def pascal_to_hpa(value) -> Column:
    return as_column(value) / 100.0


def ms_to_kmh(value) -> Column:
    return as_column(value) * 3.6


def clip(value, low: float | None = None, high: float | None = None) -> Column:
    """Limit to a range; null stays null."""
    value = as_column(value)
    out = value
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(value.isNotNull(), out)


def non_negative(value) -> Column:
    return clip(value, low=0.0)


def wind_speed(u, v) -> Column:
    return F.hypot(as_column(u), as_column(v))


def saturation(celsius) -> Column:
    celsius = as_column(celsius)
    return F.exp(MAGNUS_A * celsius / (MAGNUS_B + celsius))


def relative_humidity(celsius, dew_point) -> Column:
    """Percent, from temperature and dew point in degrees Celsius."""
    return clip(100.0 * saturation(dew_point) / saturation(celsius), 0.0, 100.0)
