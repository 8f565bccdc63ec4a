"""Date parts used as features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions import as_column


def season(day) -> Column:
    """1 = Dec-Feb, 2 = Mar-May, 3 = Jun-Aug, 4 = Sep-Nov."""
    return ((F.month(as_column(day)) % 12) / 3).cast("int") + 1


def calendar_columns(day) -> dict[str, Column]:
    day = as_column(day)
    return {
        "year": F.year(day),
        "month": F.month(day),
        "day": F.dayofmonth(day),
        "day_of_year": F.dayofyear(day),
        "iso_week": F.weekofyear(day),
        "quarter": F.quarter(day),
        "season": season(day),
    }


def month_cycle(day) -> tuple[Column, Column]:
    angle = F.month(as_column(day)) * (2 * math.pi / 12)
    return F.sin(angle), F.cos(angle)


def days_in_year(year) -> Column:
    year = as_column(year)
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return F.when(leap, 366).otherwise(365)


def with_calendar(frame: DataFrame, day: str) -> DataFrame:
    return frame.withColumns(calendar_columns(day))
