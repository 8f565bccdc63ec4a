"""Spatial joins on a tile key.

Both sides are cut into tiles, so a spatial condition becomes an equality join
plus an exact test.  Points are reduced to distinct coordinates first: a place
that holds a third of all rows is tested once, and its result is joined back.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.functions import geometry, grid, scoring
from terravane.operators import dedupe
from terravane.session import cut_lineage

POINT = ("latitude", "longitude")


def _row(latitude, size: float) -> Column:
    return F.floor(F.col(latitude) / size).cast("int")


def _columns_in(row: Column, size: float) -> Column:
    """Number of tiles in a row: about as wide as high at its narrow side, one at the poles."""
    edge = F.least(F.greatest(F.abs(row * size), F.abs((row + 1) * size)), F.lit(90.0))
    return F.greatest(F.floor(F.cos(F.radians(edge)) * 360.0 / size), F.lit(1)).cast("int")


def _column(longitude: Column, row: Column, size: float) -> Column:
    """Tile of a longitude in a row, before it is wrapped around the globe."""
    return F.floor((longitude + 180.0) * _columns_in(row, size) / 360.0).cast("int")


def distinct_points(frame: DataFrame) -> DataFrame:
    return frame.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        *POINT
    ).distinct()


def _with_reach(places: DataFrame, km: float, size: float) -> DataFrame:
    """Explode each place to every tile a point within ``km`` of it can lie in.

    Rows have columns of their own width, so a place near a pole reaches few tiles, like any other.
    """
    up = km / grid.KM_PER_DEGREE * 1.001
    top = F.least(F.abs("_place_lat") + up, F.lit(89.9))
    side = F.least(F.lit(up) / F.cos(F.radians(top)), F.lit(180.0))
    side = F.when(F.abs("_place_lat") + up >= 89.9, F.lit(180.0)).otherwise(side)
    rows = F.sequence(
        F.floor(F.greatest(F.col("_place_lat") - up, F.lit(-90.0)) / size).cast("int"),
        F.floor(F.least(F.col("_place_lat") + up, F.lit(90.0)) / size).cast("int"),
    )
    row = F.col("_tile_row")
    west, east = (_column(F.col("_place_lon") + sign * side, row, size) for sign in (-1, 1))
    around = _columns_in(row, size)
    columns = F.transform(F.sequence(west, F.least(east, west + around - 1)), lambda c: F.pmod(c, around))
    return places.withColumn("_tile_row", F.explode(rows)).withColumn("_tile_column", F.explode(columns))


def within(
    points: DataFrame, places: DataFrame, km: float, tile: float | None = None
) -> DataFrame:
    """Pairs of points (``latitude``, ``longitude``) and places no farther apart than ``km``.

    ``places`` has ``_place_lat`` and ``_place_lon``; the pair keeps all columns of
    both sides and gains ``distance_km``.
    """
    size = tile or max(km / grid.KM_PER_DEGREE, 0.05)
    row = F.col("_tile_row")
    left = points.withColumn("_tile_row", _row("latitude", size)).withColumn(
        "_tile_column", F.pmod(_column(F.col("longitude"), row, size), _columns_in(row, size))
    )
    pairs = left.join(_with_reach(places, km, size), ["_tile_row", "_tile_column"], "inner")
    distance = grid.haversine_km("latitude", "longitude", "_place_lat", "_place_lon")
    return (
        pairs.withColumn("distance_km", distance)
        .where(F.col("distance_km") <= km)
        .drop("_tile_row", "_tile_column")
    )


def _as_places(places: DataFrame, identity: str, keep: Sequence[str]) -> DataFrame:
    """One place per coordinate (the smallest identity), its columns packed in ``_place``."""
    packed = places.where(
        F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    ).select(
        F.col("latitude").alias("_place_lat"),
        F.col("longitude").alias("_place_lon"),
        F.struct(identity, *[c for c in keep if c != identity]).alias("_place"),
    )
    return packed.groupBy("_place_lat", "_place_lon").agg(F.min("_place").alias("_place"))


def nearest(
    points: DataFrame,
    places: DataFrame,
    identity: str,
    keep: Sequence[str],
    max_km: float,
    steps: int = 3,
) -> DataFrame:
    """The closest place within ``max_km`` for each point, null when there is none.

    Looks within a small radius first: a place found there is the closest one, so
    only points still without an answer go on to the next, four times wider radius.
    Dense areas are settled with few candidates and no pair is looked at twice.
    """
    candidates = _as_places(places, identity, keep)
    open_points = distinct_points(points)
    answers = None
    for step in reversed(range(steps)):
        # each ring is looked at once: its answers and what is still open are written down
        found = cut_lineage(
            within(open_points, candidates, max_km / 4**step)
            .groupBy(*POINT)
            .agg(F.min(F.struct("distance_km", "_place")).alias("_best"))
        )
        answers = found if answers is None else answers.unionByName(found)
        if step:
            open_points = open_points.join(found.select(*POINT), list(POINT), "left_anti")
    columns = [F.col(f"_best._place.{name}").alias(name) for name in dict.fromkeys([identity, *keep])]
    flat = answers.select(*POINT, *columns, F.col("_best.distance_km").alias("distance_km"))
    return points.join(flat, list(POINT), "left")


def closest_approach(
    track: DataFrame,
    places: DataFrame,
    storm: str,
    place: Sequence[str],
    max_km: float,
    order: Sequence[str],
) -> DataFrame:
    """For each storm and place the track row nearest to the place, if within ``max_km``.

    A storm's rows that reach a tile travel together, and a place lies in one tile, so a storm and a
    place meet once and their closest row is known on the spot: no pair is shuffled, sorted or kept.
    Only places with several coordinates and rows without a storm, which may be many, go by all pairs.
    """
    rest = [c for c in track.columns if c != storm]
    named = places.select(
        *place,
        F.col("latitude").alias("_place_lat"),
        F.col("longitude").alias("_place_lon"),
    )
    lone = F.count(F.lit(1)).over(Window.partitionBy(*place)) == 1
    named = named.withColumn("_lone", lone)
    once, several = named.where("_lone").drop("_lone"), named.where(~F.col("_lone")).drop("_lone")
    nameless = F.col(storm).isNull()

    pairs = within(track, several, max_km).unionByName(within(track.where(nameless), once, max_km))
    nearest_row = F.min_by(F.struct("distance_km", *rest), F.struct("distance_km", *order)).alias("_best")
    best = pairs.groupBy(storm, *place).agg(nearest_row)

    size, tile = max(max_km / grid.KM_PER_DEGREE, 0.05), ["_tile_row", "_tile_column"]
    whole = track.where(~nameless).select(
        storm,
        F.col("latitude").alias("_place_lat"),
        F.col("longitude").alias("_place_lon"),
        F.struct(*rest).alias("_row"),
    )
    reach = _with_reach(whole, max_km, size).groupBy(*tile, storm).agg(F.collect_list("_row").alias("_rows"))
    row = F.col("_tile_row")
    tiled = once.withColumn("_tile_row", _row("_place_lat", size)).withColumn(
        "_tile_column", F.pmod(_column(F.col("_place_lon"), row, size), _columns_in(row, size))
    )

    def met(point: Column) -> Column:
        km = grid.haversine_km(point["latitude"], point["longitude"], F.col("_place_lat"), F.col("_place_lon"))
        return F.struct(km.alias("distance_km"), *[point[c].alias(c) for c in order], point.alias("_row"))

    closest = F.array_min(F.transform("_rows", met)).alias("_best")
    streamed = reach.join(tiled, tile).select(storm, *place, closest).where(F.col("_best.distance_km") <= max_km)
    return streamed.select(storm, *place, "_best.distance_km", *[f"_best._row.`{c}`" for c in rest]).unionByName(
        best.select(storm, *place, "_best.*")
    )


def strongest(values: dict[str, Column]) -> tuple[Column, Column]:
    """Largest of several readings and the name of the first source that gave it."""
    largest = scoring.largest(list(values.values()))
    source = F.coalesce(*[F.when(column == largest, F.lit(name)) for name, column in values.items()])
    return largest, source


def _edges(polygons: DataFrame, size: float) -> DataFrame:
    """Every edge of every ring with the tiles its box spans."""
    rings = polygons.select("_pid", F.posexplode("geometry").alias("_part", "_rings")).select(
        "_pid", "_part", F.posexplode("_rings").alias("_ring", "_points")
    )
    edges = rings.select("_pid", "_part", "_ring", F.explode(geometry.edges_of(F.col("_points"))).alias("e"))

    def tile(pick, a: str, b: str) -> Column:
        return F.floor(pick(F.col(f"e.{a}"), F.col(f"e.{b}")) / size).cast("int")

    return edges.withColumns(
        {
            "_south": tile(F.least, "y1", "y2"),
            "_north": tile(F.greatest, "y1", "y2"),
            "_west": tile(F.least, "x1", "x2"),
            "_east": tile(F.greatest, "x1", "x2"),
        }
    )


def _tiled(polygons: DataFrame, size: float) -> DataFrame:
    """(_pid, _tile_row, _tile_column, _parts): what a tile has to know of each polygon that reaches it.

    Of each ring a tile holds the edges whose box meets it, and the crossings that any point of the
    tile has to its right with edges farther east.  Those are told by heights: an edge crosses
    the ray at ``lat`` if one of its ends is above and the other is not, so all of them together cross
    it as often, odd or even, as they have ends above it; and a height that two edges share cancels
    out.  Of a chain of any number of edges only its ends remain.  A tile that no edge meets is left
    with nothing, outside, or with one end above all of it, inside.
    """
    ring = ["_pid", "_part", "_ring"]
    edges = _edges(polygons, size)
    by_row = edges.withColumn("_tile_row", F.explode(F.sequence("_south", "_north")))
    local = (
        by_row.withColumn("_tile_column", F.explode(F.sequence("_west", "_east")))
        .groupBy(*ring, "_tile_row", "_tile_column")
        .agg(F.collect_list("e").alias("edges"))
    )
    # ends below the row are never above a point of it, ends beyond it always are
    end = F.explode(F.array("e.y1", "e.y2"))
    row = F.floor(F.col("_y") / size)
    height = F.when(row > F.col("_tile_row"), F.lit(float("inf"))).otherwise(F.col("_y"))
    ends = by_row.select(*ring, "_tile_row", "_west", end.alias("_y")).where(row >= F.col("_tile_row"))
    odd = F.count(F.lit(1)) % 2 == 1

    def uneven(frame: DataFrame, *keys: str) -> DataFrame:
        return frame.groupBy(*ring, "_tile_row", *keys, "_y").agg(odd.alias("_odd")).where("_odd").drop("_odd")

    first = edges.groupBy(*ring).agg(F.min("_west").alias("_first"))
    beyond = (
        uneven(ends.withColumn("_y", height), "_west")
        .join(first.hint("merge"), ring)
        .where("_west > _first")
        .withColumn("_tile_column", F.explode(F.sequence(F.col("_first"), F.col("_west") - 1)))
    )
    above = uneven(beyond, "_tile_column").groupBy(*ring, "_tile_row", "_tile_column").agg(
        F.collect_list("_y").alias("above")
    )
    known = F.struct("_ring", "edges", "above")
    return (
        local.join(above, [*ring, "_tile_row", "_tile_column"], "full")
        .withColumns({
                "edges": F.coalesce("edges", F.array().cast(local.schema["edges"].dataType)),
                "above": F.coalesce("above", F.array().cast("array<double>")),
            })
        .groupBy("_pid", "_part", "_tile_row", "_tile_column")
        .agg(F.collect_list(known).alias("_rings"))
        .where(F.exists("_rings", lambda r: r["_ring"] == 0))
        .groupBy("_pid", "_tile_row", "_tile_column")
        .agg(F.collect_list("_rings").alias("_parts"))
    )


def containing(points: DataFrame, polygons: DataFrame, tile: float = 1.0) -> DataFrame:
    """Pairs of distinct points and the polygons they lie in.

    ``polygons`` has ``geometry`` plus identity columns, which the pairs keep.  A point meets the edges in
    its own tile only, however many the polygon has; crowded tiles are split by the skew join.
    """
    left = distinct_points(points).withColumns(
        {
            "_tile_row": _row("latitude", tile),
            "_tile_column": F.floor(F.col("longitude") / tile).cast("int"),
        }
    )
    # numbered once and for all: equal rows are polygons of their own
    shapes = cut_lineage(polygons.withColumn("_pid", F.monotonically_increasing_id()))
    names = shapes.drop("geometry").select("_pid", F.struct("*").alias("_shape"))
    # sized by the polygons' table alone, tiles would be broadcast whole
    tiled = _tiled(shapes.select("_pid", "geometry"), tile).join(names.hint("merge"), "_pid")
    near = left.join(tiled.hint("merge"), ["_tile_row", "_tile_column"])
    return near.where(_holds(F.col("longitude"), F.col("latitude"))).select(*POINT, "_shape.*").drop("_pid")


def smallest_containing(points: DataFrame, polygons: DataFrame, identity: str, tile: float) -> DataFrame:
    """Distinct points inside any polygon, with the smallest identity of those that hold them (``_inside``).

    A polygon that covers a whole tile holds all its points, so in that tile only polygons of a
    smaller identity are tested, however many others lie over it.
    """
    spot = ["_tile_row", "_tile_column"]
    left = distinct_points(points).withColumns(
        {"_tile_row": _row("latitude", tile), "_tile_column": F.floor(F.col("longitude") / tile).cast("int")}
    )
    shapes = cut_lineage(polygons.select(F.col(identity).alias("_id"), "geometry").withColumn("_pid", F.monotonically_increasing_id()))
    tiled = cut_lineage(_tiled(shapes.select("_pid", "geometry"), tile).join(shapes.select("_pid", "_id"), "_pid").drop("_pid"))
    # no edge meets the tile: what holds of its centre holds of all its points
    plain = F.forall("_parts", lambda rings: F.forall(rings, lambda r: F.size(r["edges"]) == 0))
    centre = _holds((F.col("_tile_column") + 0.5) * tile, (F.col("_tile_row") + 0.5) * tile)
    covering = cut_lineage(tiled.where(plain & centre & F.col("_id").isNotNull()).groupBy(*spot).agg(F.min("_id").alias("_cover")))
    edged = tiled.where(~plain).join(covering, spot, "left").where("_cover IS NULL OR _id < _cover").drop("_cover")
    tested = (
        left.join(edged, spot).where(_holds(F.col("longitude"), F.col("latitude"))).groupBy(*POINT).agg(F.min("_id").alias("_tested"))
    )
    found = left.join(covering, spot, "left").join(tested, list(POINT), "left")
    return found.select(*POINT, F.least("_cover", "_tested").alias("_inside")).where("_inside IS NOT NULL")


def _holds(lon: Column, lat: Column) -> Column:
    """Whether the polygon in ``_parts``, as its tile knows it, holds a place of that tile."""

    def inside(r: Column) -> Column:
        return geometry.in_ring(lon, lat, r["edges"], F.size(F.filter(r["above"], lambda y: y > lat)))

    def holds(rings: Column) -> Column:
        return F.exists(rings, lambda r: (r["_ring"] == 0) & inside(r)) & ~F.exists(
            rings, lambda r: (r["_ring"] > 0) & inside(r)
        )

    return F.exists("_parts", holds)


def locate(
    points: DataFrame,
    polygons: DataFrame,
    places: DataFrame,
    identity: str,
    max_km: float,
    tile: float = 0.5,
) -> DataFrame:
    """Polygon that holds the point (smallest identity), else the nearest place within reach."""
    inside = smallest_containing(points, polygons, identity, tile)
    distinct = cut_lineage(distinct_points(points).join(inside, list(POINT), "left"))
    open_points = distinct.where("_inside IS NULL").select(*POINT)
    near = nearest(open_points, places, identity, [], max_km).select(
        *POINT, F.col(identity).alias("_near"), "distance_km"
    )
    answer = distinct.join(near, list(POINT), "left").select(
        *POINT,
        F.coalesce("_inside", "_near").alias(identity),
        F.when(F.col("_inside").isNotNull(), "polygon")
        .when(F.col("_near").isNotNull(), "nearest")
        .otherwise("none")
        .alias("match_method"),
        F.when(F.col("_inside").isNotNull(), F.lit(0.0)).otherwise(F.col("distance_km")).alias("distance_km"),
    )
    return points.join(answer, list(POINT), "left")


def polygon_means(
    cells: DataFrame, polygons: DataFrame, identity: str, values: Sequence[str], tile: float = 1.0
) -> DataFrame:
    """Count and mean of the grid cells inside each polygon; empty polygons stay."""
    # one row per coordinate before the spatial join: sums and counts still give the exact mean
    sums = [F.sum(v).alias(f"_{v}_sum") for v in values] + [F.count(v).alias(f"_{v}_n") for v in values]
    folded = cells.groupBy(*POINT).agg(F.count(F.lit(1)).alias("_n"), *sums)
    pairs = containing(folded, polygons.select(identity, "geometry"), tile)
    means = (
        pairs.join(folded, list(POINT))
        .groupBy(identity)
        .agg(
            F.sum("_n").alias("cells"),
            *[(F.sum(f"_{v}_sum") / F.sum(f"_{v}_n")).alias(v) for v in values],
        )
    )
    joined = polygons.select(identity).join(means, identity, "left")
    return joined.withColumns(
        {
            "cells": F.coalesce("cells", F.lit(0)),
            "status": F.when(F.col("cells") > 0, "ok").otherwise("no_cells"),
        }
    )


def affected_places(
    polygons: DataFrame, places: DataFrame, event: str, place: str, tile: float = 1.0
) -> DataFrame:
    """Every place inside the polygons of each event, once."""
    pairs = containing(places, polygons.select(event, "geometry"), tile)
    return places.join(pairs, list(POINT)).select(event, place).distinct()


def axis_nearest(places: DataFrame, cells: DataFrame, place: Sequence[str]) -> DataFrame:
    """Nearest grid row and nearest grid column of each place, chosen separately, however far.

    Lines and places are put in buckets of one degree.  The neighbours of a place are those inside
    its bucket, or else the outermost lines of the nearest filled buckets on either side; there
    are no more buckets than degrees.  Ties go to the smaller axis value.
    """

    def choose(axis: str) -> DataFrame:
        lines = cells.select(F.col(axis).alias("_line")).where(F.col("_line").isNotNull()).distinct()
        values = places.select(axis).where(F.col(axis).isNotNull()).distinct()
        both = lines.select(
            F.floor("_line").alias("_bucket"), F.col("_line").alias("_at"), "_line", F.lit(None).cast("double").alias(axis)
        ).unionByName(
            values.select(
                F.floor(axis).alias("_bucket"), F.col(axis).alias("_at"), F.lit(None).cast("double").alias("_line"), axis
            )
        )
        inside = Window.partitionBy("_bucket").orderBy("_at")
        down = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        up = inside.rangeBetween(Window.currentRow, Window.unboundedFollowing)
        near = both.select(
            "_bucket", axis, F.max("_line").over(down).alias("_below"), F.min("_line").over(up).alias("_above")
        ).where(F.col(axis).isNotNull())
        # one row per degree
        filled = both.groupBy("_bucket").agg(F.min("_line").alias("_low"), F.max("_line").alias("_high"))
        order = Window.partitionBy(F.lit(0)).orderBy("_bucket")
        outer = filled.select(
            "_bucket",
            F.max("_high").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
            F.min("_low").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
        )
        candidates = F.array(F.coalesce("_below", "_before"), F.coalesce("_above", "_after"))
        ranked = F.transform(
            F.array_compact(candidates), lambda line: F.struct(F.abs(line - F.col(axis)).alias("d"), line.alias("line"))
        )
        return near.join(outer, "_bucket").select(axis, F.array_min(ranked)["line"].alias(f"cell_{axis}"))

    return (
        places.select(*place, *POINT)
        .join(choose("latitude"), "latitude")
        .join(choose("longitude"), "longitude")
        .select(*place, "cell_latitude", "cell_longitude")
    )


#: Sides of the tiles that far places descend through, in degrees; the first holds any map in few tiles.
TILE_SIDES = (64.0, 16.0, 4.0, 1.0)


def nearest_cell(places: DataFrame, cells: DataFrame, place: Sequence[str], start: float = 1.0) -> DataFrame:
    """Closest grid cell to each place by cosine-corrected flat distance, however far.

    Looks within ``start`` degrees first: a cell found there is the closest one.  Places without one
    descend through ever smaller tiles that hold cells.  On every level a place goes on with the
    tiles that can still win: those whose nearest border is no farther than the farthest corner of
    some other.  Only the cells of the last tiles are measured, so no place meets all of them.
    """
    grid_points = distinct_points(cells).select(
        F.col("latitude").alias("cell_latitude"), F.col("longitude").alias("cell_longitude")
    )
    grid_points = cut_lineage(grid_points)
    near = cut_lineage(_closest_within(distinct_points(places), grid_points, start))
    far = cut_lineage(distinct_points(places).join(near.select(*POINT), list(POINT), "left_anti"))
    answers = near if far.isEmpty() else near.unionByName(_descended(far, grid_points))
    return places.select(*place, *POINT).join(answers, list(POINT)).drop(*POINT)


def _tile_of(size: float, latitude: str, longitude: str, suffix: str) -> dict[str, Column]:
    return {
        f"_row{suffix}": F.floor(F.col(latitude) / size).cast("int"),
        f"_column{suffix}": F.floor(F.col(longitude) / size).cast("int"),
    }


def _descended(points: DataFrame, grid_points: DataFrame) -> DataFrame:
    """Closest cell of each point, by tiles within tiles."""
    shrink = F.cos(F.radians("latitude"))

    def promising(open_tiles: DataFrame, size: float) -> DataFrame:
        """The tiles of each point that may hold its closest cell."""
        south, west = F.col("_row") * size, F.col("_column") * size
        up = F.greatest(south - F.col("latitude"), F.col("latitude") - south - size, F.lit(0.0))
        side = F.greatest(west - F.col("longitude"), F.col("longitude") - west - size, F.lit(0.0))
        far_up = F.greatest(F.abs(south - F.col("latitude")), F.abs(south + size - F.col("latitude")))
        far_side = F.greatest(F.abs(west - F.col("longitude")), F.abs(west + size - F.col("longitude")))
        bounds = open_tiles.withColumns(
            {"_least": F.hypot(up, side * shrink), "_most": F.hypot(far_up, far_side * shrink)}
        )
        best = F.min("_most").over(Window.partitionBy(*POINT))
        # rounding of the bounds must not cost a tie
        return bounds.withColumn("_best", best).where(F.col("_least") <= F.col("_best") * (1 + 1e-9)).select(
            *POINT, "_row", "_column"
        )

    top = grid_points.select(*[c.alias(n) for n, c in _tile_of(TILE_SIDES[0], "cell_latitude", "cell_longitude", "").items()])
    # a map has few tiles of the largest side, which each point is measured against in its own row
    listed = F.col("_tops")
    tops = top.distinct().agg(F.collect_list(F.struct("_row", "_column")).alias("_tops"))
    open_tiles = points.withColumn("_tops", tops.scalar()).select(*POINT, F.inline(listed))
    open_tiles = promising(open_tiles, TILE_SIDES[0])
    for larger, size in zip(TILE_SIDES, TILE_SIDES[1:]):
        inner = grid_points.select(
            *[c.alias(n) for n, c in _tile_of(larger, "cell_latitude", "cell_longitude", "").items()],
            *[c.alias(n) for n, c in _tile_of(size, "cell_latitude", "cell_longitude", "_inner").items()],
        ).distinct()
        stepped = open_tiles.join(inner, ["_row", "_column"]).select(
            *POINT, F.col("_row_inner").alias("_row"), F.col("_column_inner").alias("_column")
        )
        open_tiles = cut_lineage(promising(stepped, size))
    last = grid_points.withColumns(_tile_of(TILE_SIDES[-1], "cell_latitude", "cell_longitude", ""))
    distance = grid.flat_distance("latitude", "longitude", "cell_latitude", "cell_longitude")
    return (
        open_tiles.join(last, ["_row", "_column"])
        .withColumn("distance", distance)
        .groupBy(*POINT)
        .agg(F.min(F.struct("distance", "cell_latitude", "cell_longitude")).alias("_best"))
        .select(*POINT, "_best.*")
    )


def _closest_within(points: DataFrame, grid_points: DataFrame, reach: float) -> DataFrame:
    tiles = grid_points.withColumn(
        "_tile_row",
        F.explode(
            F.sequence(
                F.floor((F.col("cell_latitude") - reach) / reach).cast("int"),
                F.floor((F.col("cell_latitude") + reach) / reach).cast("int"),
            )
        ),
    )
    # longitude degrees shrink with latitude, so the bucket is as wide as the reach at that row
    edge = F.greatest(F.abs(F.col("_tile_row") * reach), F.abs((F.col("_tile_row") + 1) * reach))
    wide = F.lit(reach) / F.greatest(F.cos(F.radians(F.least(edge, F.lit(89.0)))), F.lit(0.0175))
    tiles = tiles.withColumn(
        "_tile_column",
        F.explode(
            F.sequence(
                (F.floor(F.col("cell_longitude") / wide) - 1).cast("int"),
                (F.floor(F.col("cell_longitude") / wide) + 1).cast("int"),
            )
        ),
    )
    looked = points.withColumn("_tile_row", _row("latitude", reach)).withColumn(
        "_tile_column", F.floor(F.col("longitude") / wide).cast("int")
    )
    distance = grid.flat_distance("latitude", "longitude", "cell_latitude", "cell_longitude")
    return (
        looked.join(tiles, ["_tile_row", "_tile_column"])
        .withColumn("distance", distance)
        .where(F.col("distance") <= reach)
        .groupBy(*POINT)
        .agg(F.min(F.struct("distance", "cell_latitude", "cell_longitude")).alias("_best"))
        .select(*POINT, "_best.*")
    )


def interior_samples(polygons: DataFrame, identity: str, side: int) -> DataFrame:
    """Points of a ``side`` by ``side`` lattice over the bounding box that fall inside."""
    box = geometry.bounding_box("geometry")

    def spread(low: str, high: str) -> Column:
        a, b = F.col(f"_box.{low}"), F.col(f"_box.{high}")
        return F.explode(
            F.transform(F.sequence(F.lit(1), F.lit(side)), lambda i: a + (b - a) * i / (side + 1))
        )

    lattice = (
        polygons.select(identity, box.alias("_box"), geometry.prepared("geometry").alias("_edges"))
        .withColumn("longitude", spread("west", "east"))
        .withColumn("latitude", spread("south", "north"))
    )
    return lattice.where(geometry.contains("longitude", "latitude", "_edges")).select(
        identity, "latitude", "longitude"
    )


def slopes(frame: DataFrame, tile: str, row: str, column: str, height: str, spacing_deg: float, latitude) -> DataFrame:
    """Slope in degrees from central differences; null at borders and beside missing heights."""
    along_row = Window.partitionBy(tile, row).orderBy(column)
    along_column = Window.partitionBy(tile, column).orderBy(row)

    def gap(window, axis: str) -> Column:
        lead, lag = F.lead(height).over(window), F.lag(height).over(window)
        adjacent = (F.lead(axis).over(window) - F.lag(axis).over(window)) == 2
        return F.when(adjacent, lead - lag)

    metres = grid.KM_PER_DEGREE * 1000 * spacing_deg
    differences = frame.withColumn("_dx", gap(along_row, column)).withColumn(
        "_dy", gap(along_column, row)
    )
    east = F.col("_dx") / (2 * metres * F.cos(F.radians(latitude)))
    north = F.col("_dy") / (2 * metres)
    return differences.withColumn("slope", F.degrees(F.atan(F.hypot(east, north)))).drop("_dx", "_dy")


def terrain_summary(frame: DataFrame, by: Sequence[str], height: str, slope: str) -> DataFrame:
    return frame.groupBy(*by).agg(
        F.avg(height).alias("height_mean"),
        F.min(height).alias("height_min"),
        F.max(height).alias("height_max"),
        (F.max(height) - F.min(height)).alias("relief"),
        F.avg(slope).alias("slope_mean"),
        F.percentile(slope, F.lit(0.95)).alias("slope_p95"),
        F.count(height).alias("samples"),
    )


def class_fractions(
    frame: DataFrame, by: str, kind: str, scores: dict[str, float]
) -> DataFrame:
    """Share of each class, the most common class and the mean class score per group."""
    counts = frame.groupBy(by, kind).agg(F.count(F.lit(1)).alias("n"))
    score = F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for kv in scores.items() for x in kv]), F.col(kind)),
        F.lit(None).cast("double"),
    )
    total = F.sum("n")
    known = F.sum(F.when(score.isNotNull(), F.col("n")))
    return counts.groupBy(by).agg(
        total.alias("samples"),
        *[
            (F.coalesce(F.sum(F.when(F.col(kind) == name, F.col("n"))), F.lit(0)) / total).alias(
                f"share_{name}"
            )
            for name in scores
        ],
        F.min_by(kind, F.struct(-F.col("n"), F.col(kind))).alias("dominant"),
        (F.sum(score * F.col("n")) / known).alias("mean_score"),
    )


def reconcile_names(
    places: DataFrame,
    polygons: DataFrame,
    similarity,
    normalise,
    fuzzy_cut: float,
    tile: float = 1.0,
) -> DataFrame:
    """Match each named place to one named polygon.

    ``places``: place_id, name, latitude, longitude.  ``polygons``: source_id, source_name,
    geometry.  A polygon of the same normalised name is taken first, and among several of that
    name the one that contains the place; without any, a polygon that contains the place.  Then the
    most similar name wins (ties: smallest source_id).  A polygon keeps only its best place; the
    others fall back to ``legacy``.
    """
    named = places.withColumn("_norm", normalise("name"))
    shapes = polygons.withColumn("_norm", normalise("source_name"))
    names = shapes.select("source_id", "source_name", "_norm")
    held = named.join(
        containing(named, shapes.select("source_id", "source_name", F.col("_norm").alias("_held_norm"), "geometry"), tile),
        list(POINT),
    ).select("place_id", "name", "source_id", "source_name", (F.col("_norm") == F.col("_held_norm")).alias("_exact"))
    exact = named.join(names, "_norm").select("place_id", "name", "source_id", "source_name")
    inside = held.where("_exact").select("place_id", "source_id", F.lit(True).alias("_inside"))
    exact = exact.join(inside, ["place_id", "source_id"], "left").select(
        "place_id", "name", "source_id", "source_name", F.lit(True).alias("_exact"), F.coalesce("_inside", F.lit(False)).alias("_inside")
    )
    other = held.where("NOT _exact").withColumn("_inside", F.lit(True))
    candidates = exact.unionByName(other).withColumn("similarity", similarity("name", "source_name"))
    best = dedupe.keep_first(
        candidates, ["place_id"], [F.desc("_exact"), F.desc("_inside"), F.desc("similarity"), F.col("source_id")]
    )
    status = (
        F.when(F.col("_exact"), "exact")
        .when(F.col("similarity") >= fuzzy_cut, "fuzzy")
        .otherwise("legacy")
    )
    graded = best.withColumn("status", status)
    usable = graded.where(F.col("status") != "legacy")
    keepers = dedupe.keep_first(
        usable,
        ["source_id"],
        [(F.col("status") != "exact"), F.desc("similarity"), F.col("place_id")],
    ).select("place_id", F.lit(True).alias("_keeper"))
    return (
        places.select("place_id", "name", "latitude", "longitude")
        .join(graded.drop("name", "_inside"), "place_id", "left")
        .join(keepers, "place_id", "left")
        .select(
            "place_id",
            "name",
            "latitude",
            "longitude",
            "source_id",
            "source_name",
            F.col("similarity"),
            F.when(F.col("status").isNull(), "unresolved")
            .when(F.col("_keeper"), F.col("status"))
            .otherwise("legacy")
            .alias("status"),
        )
    )


def apply_overrides(matches: DataFrame, overrides: DataFrame, similarity, normalise) -> DataFrame:
    """Places without a usable polygon take one from a table keyed by normalised name."""
    table = overrides.select(
        normalise("alias").alias("_norm"),
        F.col("source_id").alias("_id"),
        F.col("source_name").alias("_name"),
    )
    joined = matches.withColumn("_norm", normalise("name")).join(table, "_norm", "left")
    use = F.col("_id").isNotNull() & ~F.col("status").isin("exact", "fuzzy")
    return joined.select(
        "place_id", "name", "latitude", "longitude",
        F.when(use, F.col("_id")).otherwise(F.col("source_id")).alias("source_id"),
        F.when(use, F.col("_name")).otherwise(F.col("source_name")).alias("source_name"),
        F.when(use, similarity("name", "_name")).otherwise(F.col("similarity")).alias("similarity"),
        F.when(use, "exact_override").otherwise(F.col("status")).alias("status"),
    )


def validation_grade(status, inside, usable) -> Column:
    exact = status.isin("exact", "exact_override")
    return (
        F.when(exact & inside, "A")
        .when(exact | ((status == "fuzzy") & inside), "B")
        .when(usable, "C")
        .otherwise("D")
    )
