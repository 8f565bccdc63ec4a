"""Queries on points, places and polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravane.functions import geometry, grid, text
from terravane.operators import geo
from terravane.plans.bindings import (
    DISTRICTS_SQL,
    POINTS_SQL,
    READINGS_SQL,
    cell_days,
    districts,
    points,
    readings,
)
from terravane.plans.registry import query, tidy, tidy_sql


def polygons(t):
    """An L-shaped outline with a square hole, its south-west corner on each district."""
    x, y = F.col("longitude"), F.col("latitude")
    outline = geometry.ring_of(
        (x, y), (x + 2, y), (x + 2, y + 1), (x + 1, y + 1), (x + 1, y + 2), (x, y + 2)
    )
    hole = geometry.ring_of(
        (x + 0.25, y + 0.25), (x + 0.75, y + 0.25), (x + 0.75, y + 0.75), (x + 0.25, y + 0.75)
    )
    return districts(t).select(
        "state", "district", "district_id", F.array(F.array(outline, hole)).alias("geometry")
    )


POLYGONS_SQL = f"""{DISTRICTS_SQL}, polygons AS (
  SELECT state, district, district_id, longitude AS x0, latitude AS y0 FROM districts)"""


def inside_sql(x: str, y: str) -> str:
    """The L with its border, without the hole and the border of the hole."""
    return f"""(({x} BETWEEN x0 AND x0 + 2 AND {y} BETWEEN y0 AND y0 + 1) OR ({x} BETWEEN x0 AND x0 + 1 AND {y} BETWEEN y0 AND y0 + 2))
      AND NOT ({x} BETWEEN x0 + 0.25 AND x0 + 0.75 AND {y} BETWEEN y0 + 0.25 AND y0 + 0.75)"""


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"""2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2)
      + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"""


@query(
    "pairwise_distance",
    "F7",
    f"""WITH {POINTS_SQL}, {DISTRICTS_SQL} SELECT point_id, district_id,
      {tidy_sql(haversine_sql('p.latitude', 'p.longitude', 'd.latitude', 'd.longitude'))} AS distance_km
    FROM points p JOIN districts d ON d.district_id = p.point_id // 15""",
)
def pairwise_distance(t):
    d = districts(t).select(
        "district_id", F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2")
    )
    p = points(t).withColumn("district_id", F.floor(F.col("point_id") / 15))
    distance = grid.haversine_km("latitude", "longitude", "lat2", "lon2")
    return p.join(d, "district_id").select("point_id", "district_id", tidy(distance).alias("distance_km"))


@query(
    "nearest_district",
    "J9",
    f"""WITH {POINTS_SQL}, {DISTRICTS_SQL}, c AS (
      SELECT point_id, district_id, {haversine_sql('p.latitude', 'p.longitude', 'd.latitude', 'd.longitude')} AS km
      FROM points p, districts d WHERE abs(p.latitude - d.latitude) < 1.2)
    SELECT p.point_id, b.district_id, {tidy_sql('b.km', 4)} AS distance_km FROM points p LEFT JOIN (
      SELECT * FROM c WHERE km <= 90 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY km, district_id) = 1) b USING (point_id)""",
)
def nearest_district(t):
    found = geo.nearest(points(t), districts(t), "district_id", [], 90.0)
    return found.select("point_id", "district_id", tidy("distance_km", 4).alias("distance_km"))


@query(
    "storm_closest_approach",
    "J10",
    f"""WITH {POINTS_SQL}, {DISTRICTS_SQL}, track AS (
      SELECT point_id, point_id // 16 AS storm, latitude, longitude,
        CASE WHEN point_id % 3 <> 0 THEN amount / 80 END AS w1, CASE WHEN point_id % 4 <> 0 THEN amount / 90 + 10 END AS w2,
        CASE WHEN point_id % 5 <> 0 THEN amount / 100 + 15 END AS w3 FROM points),
    s AS (SELECT *, greatest(w1, w2, w3) AS wind FROM track), v AS (SELECT * FROM s WHERE wind >= 40),
    c AS (SELECT v.*, d.district_id, {haversine_sql('v.latitude', 'v.longitude', 'd.latitude', 'd.longitude')} AS km
      FROM v, districts d WHERE abs(v.latitude - d.latitude) < 1.2)
    SELECT storm, district_id, {tidy_sql('km', 4)} AS distance_km, {tidy_sql('wind')} AS wind,
      CASE wind WHEN w1 THEN 'first' WHEN w2 THEN 'second' ELSE 'third' END AS agency,
      CASE WHEN wind >= 100 THEN 'third level' WHEN wind >= 70 THEN 'second level' ELSE 'first level' END AS severity
    FROM c WHERE km <= 128 QUALIFY row_number() OVER (PARTITION BY storm, district_id ORDER BY km, point_id) = 1""",
)
def storm_closest_approach(t):
    track = points(t).select(
        "point_id",
        F.floor(F.col("point_id") / 16).alias("storm"),
        "latitude",
        "longitude",
        F.when(F.col("point_id") % 3 != 0, F.col("amount") / 80).alias("w1"),
        F.when(F.col("point_id") % 4 != 0, F.col("amount") / 90 + 10).alias("w2"),
        F.when(F.col("point_id") % 5 != 0, F.col("amount") / 100 + 15).alias("w3"),
    )
    wind, agency = geo.strongest({"first": F.col("w1"), "second": F.col("w2"), "third": F.col("w3")})
    strong = track.withColumns({"wind": wind, "agency": agency}).where("wind >= 40")
    best = geo.closest_approach(strong, districts(t), "storm", ["district_id"], 128.0, ["point_id"])
    severity = F.when(F.col("wind") >= 100, "third level").when(F.col("wind") >= 70, "second level").otherwise("first level")
    return best.select(
        "storm",
        "district_id",
        tidy("distance_km", 4).alias("distance_km"),
        tidy("wind").alias("wind"),
        "agency",
        severity.alias("severity"),
    )


@query(
    "nearest_cell_series",
    "J11",
    f"""WITH {READINGS_SQL}, {DISTRICTS_SQL}, g AS (SELECT DISTINCT latitude AS la, longitude AS lo FROM readings),
    b AS (SELECT district_id, la, lo, sqrt(pow(la - latitude, 2) + pow((lo - longitude) * cos(radians(latitude)), 2)) AS dist
      FROM districts, g),
    n AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY district_id ORDER BY dist, la, lo) = 1)
    SELECT district_id, la AS latitude, lo AS longitude, CAST(valid_date AS VARCHAR) AS valid_date, {tidy_sql('sum(value)')} AS precipitation
    FROM n JOIN readings r ON r.latitude = la AND r.longitude = lo GROUP BY district_id, la, lo, valid_date""",
)
def nearest_cell_series(t):
    days = cell_days(t)
    chosen = geo.nearest_cell(districts(t), days, ["district_id"]).select(
        "district_id", F.col("cell_latitude").alias("latitude"), F.col("cell_longitude").alias("longitude")
    )
    return days.join(chosen, ["latitude", "longitude"]).select(
        "district_id",
        "latitude",
        "longitude",
        F.col("valid_date").cast("string").alias("valid_date"),
        tidy("precipitation").alias("precipitation"),
    )


@query(
    "point_in_polygon",
    "J12 F9",
    f"""WITH {POINTS_SQL}, {POLYGONS_SQL} SELECT point_id, district_id FROM points p JOIN polygons ON {inside_sql('p.longitude', 'p.latitude')}""",
)
def point_in_polygon(t):
    p = points(t)
    pairs = geo.containing(p, polygons(t).select("district_id", "geometry"))
    return p.hint("merge").join(pairs, ["latitude", "longitude"]).select("point_id", "district_id")


@query(
    "polygon_bounding_boxes",
    "F9 S8",
    f"""WITH {POLYGONS_SQL} SELECT district_id, x0 AS west, y0 AS south, x0 + 2 AS east, y0 + 2 AS north FROM polygons""",
)
def polygon_bounding_boxes(t):
    box = geometry.bounding_box("geometry")
    return polygons(t).select("district_id", box.alias("b")).select("district_id", "b.*")


@query(
    "locate_points",
    "J13",
    f"""WITH {POINTS_SQL}, {POLYGONS_SQL}, i AS (
      SELECT point_id, min(district_id) AS inside FROM points p JOIN polygons ON {inside_sql('p.longitude', 'p.latitude')} GROUP BY 1),
    n AS (SELECT point_id, d.district_id AS near, {haversine_sql('p.latitude', 'p.longitude', 'd.latitude', 'd.longitude')} AS km
      FROM points p, districts d WHERE abs(p.latitude - d.latitude) < 0.6
      AND {haversine_sql('p.latitude', 'p.longitude', 'd.latitude', 'd.longitude')} <= 60
      QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY km, near) = 1)
    SELECT p.point_id, coalesce(inside, near) AS district_id,
      CASE WHEN inside IS NOT NULL THEN 'polygon' WHEN near IS NOT NULL THEN 'nearest' ELSE 'none' END AS match_method,
      CASE WHEN inside IS NOT NULL THEN 0.0 ELSE {tidy_sql('km', 4)} END AS distance_km
    FROM points p LEFT JOIN i USING (point_id) LEFT JOIN n USING (point_id)""",
)
def locate_points(t):
    out = geo.locate(points(t), polygons(t), districts(t), "district_id", 60.0)
    return out.select("point_id", "district_id", "match_method", tidy("distance_km", 4).alias("distance_km"))


@query(
    "polygon_cell_means",
    "J14",
    f"""WITH {POINTS_SQL}, {POLYGONS_SQL}, m AS (
      SELECT district_id, count(*) AS cells, avg(round_even(amount * 100, 0)) AS amount FROM points p JOIN polygons ON {inside_sql('p.longitude', 'p.latitude')} GROUP BY 1)
    SELECT district_id, coalesce(cells, 0) AS cells, CASE WHEN cells > 0 THEN 'ok' ELSE 'no_cells' END AS status, {tidy_sql('amount')} AS amount
    FROM polygons LEFT JOIN m USING (district_id)""",
)
def polygon_cell_means(t):
    out = geo.polygon_means(
        points(t).withColumn("amount", F.rint(F.col("amount") * 100)), polygons(t), "district_id", ["amount"]
    )
    return out.select("district_id", "cells", "status", tidy("amount").alias("amount"))


@query(
    "districts_hit_by_polygon_events",
    "J15",
    f"""WITH {POLYGONS_SQL}, places AS (SELECT district_id AS place_id, longitude AS x, latitude AS y FROM districts)
    SELECT DISTINCT district_id // 3 AS event_group, place_id FROM polygons, places WHERE {inside_sql('x', 'y')}""",
)
def districts_hit_by_polygon_events(t):
    events = polygons(t).select(F.floor(F.col("district_id") / 3).alias("event_group"), "geometry")
    places = districts(t).select(F.col("district_id").alias("place_id"), "latitude", "longitude")
    return geo.affected_places(events, places, "event_group", "place_id")


# three letters in ten may differ
NAME_CUT = 0.7


def named_places(t):
    d = districts(t)
    # every fifth name is misspelt, every seventh written differently but equal once normalised
    name = (
        F.when(F.col("district_id") % 5 == 0, F.regexp_replace("district", "Supplier#0", "Suplier-"))
        .when(F.col("district_id") % 7 == 0, F.concat(F.upper("district"), F.lit(" District")))
        .otherwise(F.col("district"))
    )
    return d.select(
        F.col("district_id").alias("place_id"),
        name.alias("name"),
        (F.col("latitude") + 0.125).alias("latitude"),
        (F.col("longitude") + 0.125).alias("longitude"),
    )


def reconciled(t):
    shapes = polygons(t).select(
        F.col("district_id").alias("source_id"), F.col("district").alias("source_name"), "geometry"
    )
    matches = geo.reconcile_names(
        named_places(t), shapes, text.name_similarity, text.normalise_name, fuzzy_cut=NAME_CUT
    )
    overrides = districts(t).where("district_id % 10 = 0").select(
        F.concat(F.lit("suplier"), F.lpad(F.col("district_id").cast("string"), 8, "0")).alias("alias"),
        F.col("district_id").alias("source_id"),
        F.col("district").alias("source_name"),
    )
    return geo.apply_overrides(matches, overrides, text.name_similarity, text.normalise_name)


def norm_sql(name: str) -> str:
    return f"regexp_replace(regexp_replace(lower(strip_accents({name})), '\\b(district|dist)\\b', '', 'g'), '[^a-z0-9]', '', 'g')"


def like_sql(a: str, b: str) -> str:
    return f"(1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}), 1)::DOUBLE)"


RECONCILED_SQL = f"""{POLYGONS_SQL}, named AS (
  SELECT *, {norm_sql('name')} AS pn FROM (SELECT district_id AS place_id, latitude + 0.125 AS latitude, longitude + 0.125 AS longitude,
    CASE WHEN district_id % 5 = 0 THEN replace(district, 'Supplier#0', 'Suplier-') WHEN district_id % 7 = 0 THEN upper(district) || ' District' ELSE district END AS name FROM districts)),
shapes AS (SELECT district_id AS source_id, district AS source_name, {norm_sql('district')} AS sn, x0, y0 FROM polygons),
pairs AS (SELECT place_id, name, source_id, source_name, pn = sn AS exact, {inside_sql('longitude', 'latitude')} AS held, {like_sql('pn', 'sn')} AS similarity
  FROM named JOIN shapes ON pn = sn OR ({inside_sql('longitude', 'latitude')})),
best AS (SELECT *, CASE WHEN exact THEN 'exact' WHEN similarity >= {NAME_CUT} THEN 'fuzzy' ELSE 'legacy' END AS status FROM pairs
  QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY exact DESC, held DESC, similarity DESC, source_id) = 1),
keepers AS (SELECT place_id FROM best WHERE status <> 'legacy'
  QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY status <> 'exact', similarity DESC, place_id) = 1),
matched AS (SELECT n.place_id, n.name, n.pn, n.latitude, n.longitude, b.source_id, b.source_name, b.similarity,
    CASE WHEN b.status IS NULL THEN 'unresolved' WHEN k.place_id IS NOT NULL THEN b.status ELSE 'legacy' END AS status
  FROM named n LEFT JOIN best b USING (place_id) LEFT JOIN keepers k USING (place_id)),
overrides AS (SELECT {norm_sql("'suplier' || lpad(CAST(district_id AS VARCHAR), 8, '0')")} AS pn, district_id AS oid, district AS oname FROM districts WHERE district_id % 10 = 0),
reconciled AS (SELECT place_id, name, latitude, longitude,
    CASE WHEN used THEN oid ELSE source_id END AS source_id, CASE WHEN used THEN oname ELSE source_name END AS source_name,
    CASE WHEN used THEN {like_sql('pn', norm_sql('oname'))} ELSE similarity END AS similarity, CASE WHEN used THEN 'exact_override' ELSE status END AS status
  FROM (SELECT m.*, o.oid, o.oname, o.oid IS NOT NULL AND m.status NOT IN ('exact', 'fuzzy') AS used FROM matched m LEFT JOIN overrides o USING (pn)))"""


@query(
    "name_reconciliation",
    "J16 F11",
    f"WITH {RECONCILED_SQL} SELECT place_id, name, source_id, source_name, status, {tidy_sql('similarity', 4)} AS similarity FROM reconciled",
)
def name_reconciliation(t):
    out = reconciled(t)
    return out.select("place_id", "name", "source_id", "source_name", "status", tidy("similarity", 4).alias("similarity"))


@query(
    "boundary_validation_grades",
    "F47",
    f"""WITH {RECONCILED_SQL}, j AS (SELECT r.place_id, r.status, r.status IN ('exact', 'fuzzy', 'exact_override') AS usable,
      coalesce({inside_sql('r.longitude', 'r.latitude')}, false) AS held FROM reconciled r LEFT JOIN polygons p ON p.district_id = r.source_id)
    SELECT place_id, status, held AND usable AS point_inside, CASE WHEN status IN ('exact', 'exact_override') AND held AND usable THEN 'A'
      WHEN status IN ('exact', 'exact_override') OR (status = 'fuzzy' AND held AND usable) THEN 'B' WHEN usable THEN 'C' ELSE 'D' END AS grade FROM j""",
)
def boundary_validation_grades(t):
    matched = reconciled(t)
    shapes = polygons(t).select(F.col("district_id").alias("source_id"), "geometry")
    inside = geo.containing(matched, shapes).withColumn("_inside", F.lit(True))
    joined = matched.join(inside, ["latitude", "longitude", "source_id"], "left")
    usable = F.col("status").isin("exact", "fuzzy", "exact_override")
    held = F.coalesce("_inside", F.lit(False)) & usable
    return joined.select(
        "place_id", "status", held.alias("point_inside"),
        geo.validation_grade(F.col("status"), held, usable).alias("grade"),
    )


@query(
    "nearest_axis_sampling",
    "J24",
    f"""WITH {READINGS_SQL}, {DISTRICTS_SQL}, la AS (SELECT DISTINCT latitude AS v FROM readings), lo AS (SELECT DISTINCT longitude AS v FROM readings),
    a AS (SELECT district_id, v AS cell_latitude FROM districts, la QUALIFY row_number() OVER (PARTITION BY district_id ORDER BY abs(v - latitude), v) = 1),
    b AS (SELECT district_id, v AS cell_longitude FROM districts, lo QUALIFY row_number() OVER (PARTITION BY district_id ORDER BY abs(v - longitude), v) = 1)
    SELECT district_id, CAST(valid_date AS VARCHAR) AS valid_date, {tidy_sql('sum(value)')} AS precipitation
    FROM a JOIN b USING (district_id) JOIN readings r ON r.latitude = cell_latitude AND r.longitude = cell_longitude GROUP BY district_id, valid_date""",
)
def nearest_axis_sampling(t):
    days = cell_days(t)
    chosen = geo.axis_nearest(districts(t), days, ["district_id"])
    renamed = chosen.select(
        "district_id", F.col("cell_latitude").alias("latitude"), F.col("cell_longitude").alias("longitude")
    )
    return days.join(renamed, ["latitude", "longitude"]).select(
        "district_id",
        F.col("valid_date").cast("string").alias("valid_date"),
        tidy("precipitation").alias("precipitation"),
    )


@query(
    "polygon_interior_samples",
    "F10",
    f"""WITH {POLYGONS_SQL}, l AS (SELECT district_id, x0, y0, x0 + 2.0 * i / 6 AS longitude, y0 + 2.0 * j / 6 AS latitude
      FROM polygons, range(1, 6) a(i), range(1, 6) b(j))
    SELECT district_id, {tidy_sql('latitude')} AS latitude, {tidy_sql('longitude')} AS longitude FROM l WHERE {inside_sql('longitude', 'latitude')}""",
)
def polygon_interior_samples(t):
    out = geo.interior_samples(polygons(t), "district_id", 5)
    return out.select("district_id", tidy("latitude").alias("latitude"), tidy("longitude").alias("longitude"))


def elevation(t):
    """Orders read as an elevation raster: tiles of 20 by 20 cells, some cells void."""
    key = F.col("o_orderkey")
    return t.orders.select(
        F.floor(key / 400).alias("tile"),
        (F.floor(key / 20) % 20).cast("int").alias("row"),
        (key % 20).cast("int").alias("col"),
        F.when(key % 41 != 0, F.col("o_totalprice") / 100).alias("height"),
    )


ELEVATION_SQL = """elevation AS (SELECT o_orderkey // 400 AS tile, CAST((o_orderkey // 20) % 20 AS INTEGER) AS row,
  CAST(o_orderkey % 20 AS INTEGER) AS col, CASE WHEN o_orderkey % 41 <> 0 THEN o_totalprice / 100 END AS height FROM orders),
slopes AS (SELECT *, degrees(atan(sqrt(pow((lead(height) OVER r - lag(height) OVER r) / (2 * 1111.95 * cos(radians(row * 0.01::DOUBLE + 10))), 2)
  + pow((lead(height) OVER c - lag(height) OVER c) / (2 * 1111.95), 2)))) AS slope
  FROM elevation WINDOW r AS (PARTITION BY tile, row ORDER BY col), c AS (PARTITION BY tile, col ORDER BY row))"""


def sloped(t):
    return geo.slopes(
        elevation(t), "tile", "row", "col", "height", 0.01, F.col("row") * 0.01 + 10
    )


@query(
    "terrain_slope",
    "W17",
    f"WITH {ELEVATION_SQL} SELECT tile, row, col, {tidy_sql('slope', 4)} AS slope FROM slopes",
)
def terrain_slope(t):
    return sloped(t).select("tile", "row", "col", tidy("slope", 4).alias("slope"))


@query(
    "terrain_summary",
    "A37",
    f"""WITH {ELEVATION_SQL} SELECT tile, {tidy_sql('avg(height)', 4)} AS height_mean, {tidy_sql('min(height)', 4)} AS height_min,
      {tidy_sql('max(height)', 4)} AS height_max, {tidy_sql('max(height) - min(height)', 4)} AS relief, {tidy_sql('avg(slope)', 4)} AS slope_mean,
      {tidy_sql('quantile_cont(slope, 0.95)', 4)} AS slope_p95, count(height) AS samples FROM slopes GROUP BY 1""",
)
def terrain_summary(t):
    out = geo.terrain_summary(sloped(t), ["tile"], "height", "slope")
    numbers = ["height_mean", "height_min", "height_max", "relief", "slope_mean", "slope_p95"]
    return out.select("tile", *[tidy(n, 4).alias(n) for n in numbers], "samples")


LAND_SCORES = {"BUILDING": 0.9, "MACHINERY": 0.6, "FURNITURE": 0.4, "HOUSEHOLD": 0.2}


@query(
    "land_class_fractions",
    "A36",
    f"""WITH s AS (SELECT c_nationkey AS district_id, c_mktsegment AS land, CASE c_mktsegment WHEN 'BUILDING' THEN 0.9 WHEN 'MACHINERY' THEN 0.6
      WHEN 'FURNITURE' THEN 0.4 WHEN 'HOUSEHOLD' THEN 0.2 END::DOUBLE AS score FROM customer),
    d AS (SELECT district_id, land, count(*) AS n FROM s GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY district_id ORDER BY n DESC, land) = 1)
    SELECT district_id, count(*) AS samples, """
    + ", ".join(f"{tidy_sql(f'''count(*) FILTER (s.land = '{n}') / count(*)''')} AS share_{n}" for n in LAND_SCORES)
    + f""", any_value(d.land) AS dominant, {tidy_sql('avg(score)')} AS mean_score FROM s JOIN d USING (district_id) GROUP BY 1""",
)
def land_class_fractions(t):
    samples = t.customer.select(F.col("c_nationkey").alias("district_id"), F.col("c_mktsegment").alias("land"))
    out = geo.class_fractions(samples, "district_id", "land", LAND_SCORES)
    return out.select(
        "district_id",
        "samples",
        *[tidy(f"share_{n}").alias(f"share_{n}") for n in LAND_SCORES],
        "dominant",
        tidy("mean_score").alias("mean_score"),
    )
