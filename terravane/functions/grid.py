"""Coordinate, distance and tile expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from terravane.functions import as_column

EARTH_RADIUS_KM = 6371.0088
KM_PER_DEGREE = 111.195


@dataclass(frozen=True)
class Box:
    west: float
    south: float
    east: float
    north: float


def round_half_even(value, digits: int) -> Column:
    scale = float(10**digits)
    return F.rint(as_column(value) * scale) / scale


def wrap_longitude(value) -> Column:
    """Any longitude to [-180, 180)."""
    return F.pmod(as_column(value) + 180.0, F.lit(360.0)) - 180.0


def normalise_longitude(value, digits: int = 4) -> Column:
    return round_half_even(wrap_longitude(value), digits)


def normalise_latitude(value, digits: int = 4) -> Column:
    return round_half_even(value, digits)


def snap(value, resolution: float) -> Column:
    """Nearest multiple of ``resolution``; ties go to the even multiple."""
    return F.rint(as_column(value) / resolution) * resolution


def in_box(latitude, longitude, box: Box) -> Column:
    return as_column(latitude).between(box.south, box.north) & as_column(longitude).between(
        box.west, box.east
    )


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(as_column(c)) for c in (lat1, lon1, lat2, lon2))
    half = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(
        F.sin((lon2 - lon1) / 2), 2
    )
    return 2 * EARTH_RADIUS_KM * F.asin(F.least(F.sqrt(half), F.lit(1.0)))


def flat_distance(lat1, lon1, lat2, lon2) -> Column:
    """Equirectangular distance in degrees, longitude shrunk by the cosine of ``lat1``."""
    lat1, lon1, lat2, lon2 = (as_column(c) for c in (lat1, lon1, lat2, lon2))
    return F.hypot(lat2 - lat1, (lon2 - lon1) * F.cos(F.radians(lat1)))


def tile_name(latitude, longitude, size: int = 1) -> Column:
    """South-west corner of the enclosing tile, like N27E094."""
    south = (F.floor(as_column(latitude) / size) * size).cast("int")
    west = (F.floor(as_column(longitude) / size) * size).cast("int")
    return F.concat(
        F.when(south >= 0, "N").otherwise("S"),
        F.lpad(F.abs(south).cast("string"), 2, "0"),
        F.when(west >= 0, "E").otherwise("W"),
        F.lpad(F.abs(west).cast("string"), 3, "0"),
    )
