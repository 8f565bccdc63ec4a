"""Polygon expressions.

A polygon is ``array<ring>``, a ring ``array<struct<lon,lat>>``; the first ring is
the outline, the others are holes.  A geometry is ``array<polygon>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terravane.functions import as_column

ON_EDGE = 1e-10


def edges_of(ring: Column) -> Column:
    """Ring points paired with the point before them, as x1,y1,x2,y2."""
    size = F.size(ring)
    before = F.concat(F.slice(ring, size, 1), F.slice(ring, 1, size - 1))
    return F.zip_with(
        before,
        ring,
        lambda a, b: F.struct(
            a["lon"].alias("x1"), a["lat"].alias("y1"), b["lon"].alias("x2"), b["lat"].alias("y2")
        ),
    )


def prepared(geometry) -> Column:
    """Edges of every ring of every polygon, computed once per polygon and not once per point."""
    return F.transform(as_column(geometry), lambda polygon: F.transform(polygon, edges_of))


def in_ring(lon: Column, lat: Column, edges: Column, beyond: Column | None = None) -> Column:
    """Even-odd rule; a point on an edge counts as inside.

    ``beyond`` counts crossings to the right of the point that are not among the edges.
    """
    touches = F.exists(
        edges,
        lambda e: lat.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        & lon.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & (
            F.abs((e["x2"] - e["x1"]) * (lat - e["y1"]) - (e["y2"] - e["y1"]) * (lon - e["x1"]))
            < ON_EDGE
        ),
    )
    crossings = F.size(
        F.filter(
            edges,
            lambda e: ((e["y1"] > lat) != (e["y2"] > lat))
            & (lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]),
        )
    )
    if beyond is not None:
        crossings = crossings + beyond
    return touches | (crossings % 2 == 1)


def contains(lon, lat, prepared_geometry) -> Column:
    """Inside the outline of some polygon and in none of its holes."""
    lon, lat = as_column(lon), as_column(lat)
    return F.exists(
        as_column(prepared_geometry),
        lambda rings: (F.size(rings) > 0)
        & in_ring(lon, lat, F.element_at(rings, 1))
        & ~F.exists(F.slice(rings, 2, F.greatest(F.size(rings), F.lit(1))), lambda hole: in_ring(lon, lat, hole)),
    )


def all_points(geometry) -> Column:
    return F.flatten(F.flatten(as_column(geometry)))


def bounding_box(geometry) -> Column:
    """struct<west,south,east,north>."""
    points = all_points(geometry)
    lon = F.transform(points, lambda p: p["lon"])
    lat = F.transform(points, lambda p: p["lat"])
    return F.struct(
        F.array_min(lon).alias("west"),
        F.array_min(lat).alias("south"),
        F.array_max(lon).alias("east"),
        F.array_max(lat).alias("north"),
    )


def ring_of(*corners: tuple) -> Column:
    """A ring from (lon, lat) column pairs."""
    return F.array(
        *[F.struct(as_column(x).alias("lon"), as_column(y).alias("lat")) for x, y in corners]
    )


def rounded(geometry, digits: int) -> Column:
    """Coordinates rounded for a compact payload."""
    scale = float(10**digits)

    def short(value: Column) -> Column:
        return F.rint(value * scale) / scale + 0.0

    return F.transform(
        as_column(geometry),
        lambda polygon: F.transform(
            polygon,
            lambda ring: F.transform(
                ring,
                lambda p: F.struct(short(p["lon"]).alias("lon"), short(p["lat"]).alias("lat")),
            ),
        ),
    )
