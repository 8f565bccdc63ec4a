import math
import random

import pytest
from pyspark.sql import functions as F

from terravane.functions import geometry, grid, text
from terravane.operators import geo, groundtruth, textmatch, web
from terravane.plans import catalogue


def square(x, y, side):
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]


def polygon_frame(rows, *polygons):
    schema = "id int, geometry array<array<array<struct<lon:double,lat:double>>>>"
    return rows(schema, *[(i, [rings]) for i, rings in enumerate(polygons)])


def test_hole_edge_and_outside(rows):
    shapes = polygon_frame(rows, [square(0.0, 0.0, 4.0), square(1.0, 1.0, 2.0)])
    points = rows(
        "name string, longitude double, latitude double",
        ("inside", 0.5, 0.5), ("hole", 2.0, 2.0), ("edge", 4.0, 2.0), ("outside", 4.5, 2.0),
    )
    got = points.join(geo.containing(points, shapes), ["latitude", "longitude"])
    assert {r.name for r in got.collect()} == {"inside", "edge"}


def ray_cast(lon, lat, polygon):
    def in_ring(ring):
        odd = False
        for (x1, y1), (x2, y2) in zip([ring[-1], *ring[:-1]], ring):
            if min(y1, y2) <= lat <= max(y1, y2) and min(x1, x2) <= lon <= max(x1, x2):
                if abs((x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1)) < geometry.ON_EDGE:
                    return True
            if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                odd = not odd
        return odd

    return in_ring(polygon[0]) and not any(map(in_ring, polygon[1:]))


def wave(edges, x, y, radius, teeth):
    """A star-like closed outline of many short edges."""
    turn = [2 * math.pi * i / edges for i in range(edges)]
    return [(x + (radius + math.sin(teeth * a)) * math.cos(a), y + (radius + math.sin(teeth * a)) * math.sin(a)) for a in turn]


@pytest.mark.parametrize("tile", [0.4, 1.0, 50.0])
def test_points_against_ray_casting_over_whole_polygons(rows, tile):
    """Holes, vertices on tile borders, tiles without edges, several parts, a copy, and points on edges."""
    rng = random.Random(8)
    shapes = [
        [wave(3000, 3.0, -2.0, 5.0, 40), square(1.0, -3.0, 2.0), wave(50, 5.0, 0.0, 1.5, 3)],
        [square(-2.0, -2.0, 4.0), square(-1.0, -1.0, 2.0)],
        [[(rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(25)]],
    ]
    schema = "id int, geometry array<array<array<struct<lon:double,lat:double>>>>"
    several = [shapes[1], [square(6.0, 6.0, 1.0)], [square(1.5, 1.5, 3.0)]]
    frame = rows(schema, *[(i, [s]) for i, s in enumerate(shapes)], (3, several), (1, [shapes[1]]), (4, []))
    points = [(rng.uniform(-10, 10), rng.uniform(-10, 10)) for _ in range(1500)]
    points += [(x / 2, y / 2) for x in range(-10, 15) for y in range(-10, 15)]
    wanted = sorted(
        (i, p) for i, parts in [*enumerate([[s] for s in shapes]), (3, several), (1, [shapes[1]])] for p in points
        if any(ray_cast(*p, part) for part in parts)
    )
    got = geo.containing(rows("longitude double, latitude double", *points, points[0]), frame, tile)
    assert sorted((r.id, (r.longitude, r.latitude)) for r in got.collect()) == wanted


def test_a_polygon_of_many_edges_gives_each_tile_its_own(rows):
    """100,000 edges and a tile that holds most points: no tile row has more than its part of the edges."""
    outline = wave(100_000, 0.0, 0.0, 20.0, 500)
    frame = rows("_pid long, geometry array<array<array<struct<lon:double,lat:double>>>>", (1, [[outline]]))
    tiles = geo._tiled(frame, 1.0).select(F.size(F.col("_parts")[0][0]["edges"]).alias("n")).collect()
    assert max(r.n for r in tiles) < 5_000 and sum(r.n == 0 for r in tiles) > 900
    rng = random.Random(2)
    points = [(rng.uniform(19.0, 20.0), rng.uniform(0.0, 1.0)) for _ in range(3000)] + [(30.0, 0.5), (0.0, 0.0)]
    got = geo.containing(rows("longitude double, latitude double", *points), frame.drop("_pid").withColumn("id", F.lit(1)))
    near = [(x, y) for x, y in outline if x > 0 and -2 < y < 3]
    local = [[(0.0, 3.0), (0.0, -2.0), *sorted(near, key=lambda p: math.atan2(p[1], p[0]))]]
    wanted = sum(ray_cast(x, y, local) for x, y in points[:200])
    inside = {(r.longitude, r.latitude) for r in got.collect()}
    assert sum(p in inside for p in points[:200]) == wanted and (0.0, 0.0) in inside and (30.0, 0.5) not in inside


def test_polygon_mean_keeps_empty_polygons(rows):
    shapes = polygon_frame(rows, [square(0.0, 0.0, 1.0)], [square(30.0, 30.0, 1.0)])
    cells = rows("longitude double, latitude double, rain double", (0.5, 0.5, 10.0), (5.0, 5.0, 90.0))
    got = {r.id: r for r in geo.polygon_means(cells, shapes, "id", ["rain"]).collect()}
    assert (got[0].cells, got[0].rain, got[0].status) == (1, 10.0, "ok")
    assert (got[1].cells, got[1].rain, got[1].status) == (0, None, "no_cells")


def km(a, b):
    la1, lo1, la2, lo2 = map(math.radians, (*a, *b))
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))


def test_nearest_against_brute_force_with_a_hot_place_and_the_date_line(rows):
    rng = random.Random(5)
    places = [(i, rng.uniform(-80, 80), rng.uniform(-180, 180)) for i in range(300)] + [(900, 10.0, 179.9)]
    points = [(i, rng.uniform(-85, 85), rng.uniform(-180, 180)) for i in range(200)]
    points += [(1000 + i, 10.0, -179.8) for i in range(100)]
    frame = geo.nearest(
        rows("pid int, latitude double, longitude double", *points),
        rows("place int, latitude double, longitude double", *places),
        "place", [], 400.0,
    )
    got = {r.pid: r.place for r in frame.collect()}
    assert len(got) == len(points)
    for pid, lat, lon in points:
        best = min((km((lat, lon), (a, b)), i) for i, a, b in places)
        assert got[pid] == (best[1] if best[0] <= 400.0 else None)
    assert got[1000] == 900


def test_places_near_the_poles(rows):
    rng = random.Random(6)
    places = [(i, sign * rng.uniform(86, 90), rng.uniform(-180, 180)) for i, sign in enumerate([1, -1] * 60)]
    places += [(500, 90.0, 0.0), (501, -90.0, 10.0)]
    points = [(i, sign * rng.uniform(85, 90), rng.uniform(-180, 180)) for i, sign in enumerate([1, -1] * 100)]
    frame = rows("place int, latitude double, longitude double", *places)
    got = geo.nearest(rows("pid int, latitude double, longitude double", *points), frame, "place", [], 120.0)
    for r in got.collect():
        best = min((km((r.latitude, r.longitude), (a, b)), i) for i, a, b in places)
        assert r.place == (best[1] if best[0] <= 120.0 else None)
    reached = geo._with_reach(geo._as_places(frame, "place", []), 120.0, 1.1).groupBy("_place_lat", "_place_lon").count()
    assert max(r["count"] for r in reached.collect()) < 60


def test_far_places_meet_few_cells(rows):
    """Clustered cells, places up to the whole map away, and ties."""
    rng = random.Random(11)
    cells = [(lat + rng.uniform(-3, 3), lon + rng.uniform(-3, 3)) for lat, lon in ((10, 10), (-60, 150), (70, -170), (0, -20)) for _ in range(150)]
    cells += [(5.0, 50.0), (5.0, 52.0), (-5.0, 50.0)]
    places = [(i, rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(300)] + [(900, 5.0, 51.0), (901, 0.0, 50.0)]
    got = geo.nearest_cell(
        rows("id int, latitude double, longitude double", *places), rows("latitude double, longitude double", *cells), ["id"]
    )
    found = {r.id: (r.cell_latitude, r.cell_longitude) for r in got.collect()}
    for i, la, lo in places:
        shrink = math.cos(math.radians(la))
        nearest = min((round(math.hypot(a - la, (o - lo) * shrink), 9), a, o) for a, o in cells)
        chosen = found[i]
        assert round(math.hypot(chosen[0] - la, (chosen[1] - lo) * shrink), 9) == nearest[0]
    assert found[900] == (5.0, 50.0) and found[901] == (-5.0, 50.0)


def test_locate_falls_back_to_nearest(rows):
    shapes = polygon_frame(rows, [square(0.0, 0.0, 1.0)])
    places = rows("id int, latitude double, longitude double", (7, 3.0, 3.0))
    points = rows("n string, latitude double, longitude double", ("in", 0.5, 0.5), ("near", 3.1, 3.0), ("far", 60.0, 60.0))
    got = {r.n: (r.id, r.match_method) for r in geo.locate(points, shapes, places, "id", 40.0).collect()}
    assert got == {"in": (0, "polygon"), "near": (7, "nearest"), "far": (None, "none")}


def test_bounding_box(rows):
    shapes = polygon_frame(rows, [square(1.0, 2.0, 3.0)])
    box = shapes.select(geometry.bounding_box("geometry").alias("b")).first().b
    assert tuple(box) == (1.0, 2.0, 4.0, 5.0)


def test_names_reconcile(rows):
    shapes = rows(
        "source_id int, source_name string, geometry array<array<array<struct<lon:double,lat:double>>>>",
        (1, "Éast Hill", [[square(0.0, 0.0, 1.0)]]), (2, "Wester", [[square(5.0, 5.0, 1.0)]]),
    )
    places = rows(
        "place_id int, name string, latitude double, longitude double",
        (1, "East Hill District", 0.5, 0.5), (2, "Western", 5.5, 5.5), (3, "Other", 5.6, 5.6), (4, "Nowhere", 50.0, 50.0),
    )
    out = geo.reconcile_names(places, shapes, text.name_similarity, text.normalise_name, 0.7)
    got = {r.place_id: (r.source_id, r.status) for r in out.collect()}
    assert got == {1: (1, "exact"), 2: (2, "fuzzy"), 3: (2, "legacy"), 4: (None, "unresolved")}


def test_places_of_one_name_take_the_polygon_around_them(rows):
    shapes = rows(
        "source_id int, source_name string, geometry array<array<array<struct<lon:double,lat:double>>>>",
        (10, "Hill Town", [[square(0.0, 0.0, 1.0)]]), (20, "Hill Town", [[square(5.0, 5.0, 1.0)]]),
    )
    places = rows(
        "place_id int, name string, latitude double, longitude double",
        (1, "hill town dist", 0.5, 0.5), (2, "Hill-Town", 5.5, 5.5),
    )
    out = geo.reconcile_names(places, shapes, text.name_similarity, text.normalise_name, 0.7)
    assert {r.place_id: (r.source_id, r.status) for r in out.collect()} == {1: (10, "exact"), 2: (20, "exact")}


def test_nearest_cells_have_no_limit(rows):
    places = rows("id int, latitude double, longitude double", (1, 10.0, 10.0), (2, 0.1, 0.1), (3, -89.0, 170.0), (4, 21.0, -3.0))
    cells = rows("latitude double, longitude double", (20.0, 20.0), (0.0, 0.0), (0.0, 0.25))
    near = {r.id: (r.cell_latitude, r.cell_longitude) for r in geo.nearest_cell(places, cells, ["id"]).collect()}
    want = {}
    for i, la, lo in ((1, 10.0, 10.0), (2, 0.1, 0.1), (3, -89.0, 170.0), (4, 21.0, -3.0)):
        shrink = math.cos(math.radians(la))
        want[i] = min((math.hypot(a - la, (o - lo) * shrink), a, o) for a, o in ((20.0, 20.0), (0.0, 0.0), (0.0, 0.25)))[1:]
    assert near == want
    axes = {r.id: (r.cell_latitude, r.cell_longitude) for r in geo.axis_nearest(places, cells, ["id"]).collect()}
    assert axes == {1: (0.0, 0.25), 2: (0.0, 0.0), 3: (0.0, 20.0), 4: (20.0, 0.0)}


@pytest.mark.parametrize("limit", [0, 8_000_000], ids=["joined", "automaton"])
def test_substring_names_against_brute_force(rows, monkeypatch, limit):
    monkeypatch.setattr(textmatch, "AUTOMATON_CHARS", limit)
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("abc ") for _ in range(60))) for i in range(40)] + [(99, "")]
    names = sorted({"".join(rng.choice("abc") for _ in range(n)) for n in (1, 2, 3, 5, 6, 7, 8, 9, 12) for _ in range(8)})
    names += [texts[0][1][10:35], texts[1][1][:17], texts[2][1][-18:]]
    got = textmatch.substring_names(
        rows("id int, body string", *texts), rows("name string", *[(n,) for n in names]), "id", "body", "name"
    )
    assert {(r.id, r.name) for r in got.collect()} == {(i, n) for i, b in texts for n in names if n in b}


@pytest.mark.parametrize("limit", [0, 8_000_000], ids=["joined", "automaton"])
def test_whole_word_names_of_any_length(rows, monkeypatch, limit):
    monkeypatch.setattr(textmatch, "AUTOMATON_CHARS", limit)
    texts = rows("id int, body string", (1, "north east hills are wet"), (2, "northeast"), (3, "hills"), (4, "in the south west wet hills of old " + "x " * 20000 + "end"))
    names = rows("name string", ("north east",), ("north east hills",), ("hills",), ("east",), ("the south west wet hills of old",), ("south west wet hills",), ("x end",))
    got = textmatch.whole_word_names(texts, names, "id", "body", "name")
    assert {(r.id, r.name) for r in got.collect()} == {
        (1, "north east"), (1, "north east hills"), (1, "hills"), (1, "east"), (3, "hills"), (4, "hills"),
        (4, "the south west wet hills of old"), (4, "south west wet hills"), (4, "x end"),
    }


@pytest.mark.parametrize("limit", [0, 8_000_000], ids=["joined", "automaton"])
def test_names_belong_to_their_state_and_may_be_one_letter(rows, monkeypatch, limit):
    monkeypatch.setattr(textmatch, "AUTOMATON_CHARS", limit)
    long = " ".join(f"w{i % 5000}" for i in range(20_000)) + " q last"
    texts = rows("id int, state string, body string", (1, "a", "q r"), (2, "b", "q r"), (3, "a", long), (4, None, "q"), (5, "a", None))
    names = rows("state string, name string, code int", ("a", "q", 1), ("b", "r", 2), ("b", "q r", 3), ("a", "w4999 w0 w1", 4), ("a", "", 5))
    whole = textmatch.whole_word_names(texts, names, "id", "body", "name", ["state"])
    assert {(r.id, r.code) for r in whole.collect()} == {(1, 1), (2, 2), (2, 3), (3, 1), (3, 4)}
    anywhere = textmatch.substring_names(texts, names, "id", "body", "name", ["state"])
    assert {(r.id, r.code) for r in anywhere.collect()} == {(1, 1), (2, 2), (2, 3), (3, 1), (3, 4)}


def test_flags_equal_plain_search(rows):
    frame = rows("body string", ("wet hill road",), ("wethill",), (None,))
    flags = text.Flags("body", ["hill", "wet hill"])
    out = flags.attach(frame).select(
        text.phrase_hits(flags, flags.phrases).alias("a"), text.phrase_hits("body", flags.phrases, bounded=True).alias("b")
    )
    assert [(r.a, r.b) for r in out.collect()] == [(2, 2), (0, 0), (0, 0)]


def test_most_hits_tie_goes_to_the_first_rule(rows):
    frame = rows("body string", ("a b",), ("none here",))
    rules = {"one": ["a"], "two": ["b"]}
    best = [r[0] for r in frame.select(text.most_hits("body", rules, bounded=True)).collect()]
    assert (best[0].name, best[0].hits) == ("one", 1) and best[1].name is None


def test_compact_dates(rows):
    frame = rows("d string", ("20150501",), ("20150501.0",), ("2015",), ("20159901",), (None,))
    got = [str(r[0]) if r[0] else None for r in frame.select(text.compact_date("d")).collect()]
    assert got == ["2015-05-01", "2015-05-01", None, None, None]


def test_accepted_and_rejected_are_the_input(rows):
    frame = rows("id int, v double, s string", (1, 5.0, "x"), (2, None, "x"), (3, 1.0, None), (4, 9.0, "y"))
    judged = groundtruth.judged(frame, {"low": F.col("v") >= 3, "name": F.col("s") == "x"})
    accepted, rejected = groundtruth.split(judged)
    assert [r.id for r in accepted.collect()] == [1]
    assert {r.id: r.review_reason for r in rejected.collect()} == {2: "low", 3: "low;name", 4: "name"}


def test_rejecting_review_removes_the_event(rows):
    events = rows("k int, verified boolean", (1, True), (2, True))
    decisions = rows(
        "k int, review_status string, event_occurred_in_district string, date_correct string",
        (1, "approved", " no ", "yes"), (2, "APPROVED", "YES", "YES"),
    )
    got = {r.k: r.verified for r in groundtruth.with_reviews(events, decisions, ["k"]).collect()}
    assert got == {1: False, 2: True}


def test_page_fields(rows):
    html = (
        "<html><head><title> A &amp; B </title><meta property='og:description' content='told'></head><body><nav>menu</nav>"
        "<article><p>short</p><p>This paragraph is long <b>enough</b> to be kept.</p></article><script>x()</script></body></html>"
    )
    row = web.page_fields(rows("html string", (html,))).first()
    assert (row.title, row.description) == ("A & B", "told")
    assert row.article_text == "This paragraph is long enough to be kept."
    assert "menu" not in row.clean_text and "x()" not in row.clean_text


def test_a_tile_tests_only_polygons_below_the_one_that_covers_it(spark):
    """Many squares over one place: all but the smallest identity and what is smaller are left out."""
    from pyspark.sql import functions as F

    from terravane.functions import geometry

    x, y = F.lit(0.0) + F.col("i") * 0.001, F.lit(0.0)
    square = geometry.ring_of((x, y), (x + 3, y), (x + 3, y + 3), (x, y + 3))
    shapes = spark.range(300).select(F.col("id").alias("i")).select("i", F.array(F.array(square)).alias("geometry"))
    points = spark.createDataFrame([(1.25, 1.25), (1.25, 0.0005), (1.25, 3.2), (9.0, 9.0), (1.25, 0.0)], "latitude double, longitude double")
    found = geo.smallest_containing(points, shapes, "i", 0.5)
    pairs = geo.containing(points, shapes).groupBy("latitude", "longitude").agg(F.min("i").alias("_inside"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, pairs.collect())) and found.count() == 4


def test_closest_approach_keeps_no_pairs(spark, rows):
    """Against all pairs, with a storm-less row, a place of two coordinates, a tie and a pole; single places meet a storm once."""
    track = [(1, 10.0, 20.0, 1), (1, 10.5, 20.0, 2), (1, 9.5, 20.0, 3), (2, 10.2, 20.3, 4), (None, 10.0, 20.1, 5), (None, 10.4, 20.0, 6)]
    track += [(3, 89.6, 170.0, 7), (3, 89.7, -60.0, 8), (4, 0.0, 179.9, 9), (5, None, 1.0, 10)]
    places = [("a", 10.0, 20.2), ("b", 10.0, 20.0), ("c", 89.9, 10.0), ("d", 0.1, -179.8), ("e", 10.3, 20.1), ("e", 9.4, 20.0), ("f", None, 3.0)]
    moves = rows("storm long, latitude double, longitude double, at long", *track)
    spots = rows("place string, latitude double, longitude double", *places)
    found = geo.closest_approach(moves, spots, "storm", ["place"], 110.0, ["at"])
    everything = moves.crossJoin(spots.toDF("place", "la", "lo")).withColumn("km", grid.haversine_km("latitude", "longitude", "la", "lo"))
    best = everything.where("km <= 110").groupBy("storm", "place").agg(F.min(F.struct("km", "at")).alias("b"))
    wanted = {(r.storm, r.place, r.b["at"], round(r.b["km"], 6)) for r in best.collect()}
    got = [(r.storm, r.place, r["at"], round(r["distance_km"], 6)) for r in found.collect()]
    assert set(got) == wanted and len(got) == len(wanted) > 10
    streamed = found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "Aggregate" not in streamed


def test_points_and_tiles_are_not_broadcast(spark, tmp_path):
    """Small files tell nothing of the size that tiles of polygons and rows of coordinates have."""
    customers = spark.range(1, 301).selectExpr("id c_custkey", "double(id) c_acctbal", "'x' c_mktsegment")
    suppliers = spark.range(1, 41).selectExpr("id s_suppkey", "id % 5 s_nationkey", "'n' || id s_name", "double(id) s_acctbal")
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    suppliers.write.parquet(f"{tmp_path}/supplier.parquet")
    found = catalogue()["point_in_polygon"](spark, str(tmp_path))
    wanted = []
    for i in range(1, 301):
        y, x = i * 7919 % 3203 * 0.015625 - 20.0, i * 104729 % 3187 * 0.015625 + 60.0
        for k in range(1, 41):
            v, u = y - (k * 37 % 800 * 0.0625 - 20.0), x - (k * 53 % 797 * 0.0625 + 60.0)
            shape = (0 <= u <= 2 and 0 <= v <= 1) or (0 <= u <= 1 and 0 <= v <= 2)
            if shape and not (0.25 <= u <= 0.75 and 0.25 <= v <= 0.75):
                wanted.append((i, k))
    assert wanted and sorted(tuple(r) for r in found.collect()) == wanted
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
