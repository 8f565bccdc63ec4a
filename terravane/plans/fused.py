"""Queries that fuse providers, attach events and build targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravane import contracts
from terravane.operators import alignment, dedupe, fusion
from terravane.plans.bindings import (
    CELL_DAYS_SQL,
    DISTRICTS_SQL,
    READINGS_SQL,
    STATION_DAYS_SQL,
    VERIFIED_EVENTS_SQL,
    cell_days,
    districts,
    readings,
    station_days,
    verified_events,
)
from terravane.plans.registry import query, tidy, tidy_sql

CELL_KEYS = ["latitude", "longitude", "valid_date"]
CELL_SQL = "latitude, longitude, CAST(valid_date AS VARCHAR) AS valid_date"


def cell():
    return ["latitude", "longitude", F.col("valid_date").cast("string").alias("valid_date")]

PROVIDERS_SQL = f"""{READINGS_SQL}, a AS (
  SELECT event_id, latitude, longitude, valid_date, value AS precipitation_a, k / 4.0 AS temperature
  FROM readings WHERE event_type IN ('view', 'click')), b AS (
  SELECT latitude, longitude, valid_date, value AS precipitation_b FROM readings WHERE event_type = 'purchase')"""


def provider_a(t):
    return readings(t).where(F.col("event_type").isin("view", "click")).select(
        "event_id",
        *CELL_KEYS,
        F.col("value").alias("precipitation_a"),
        (F.col("k") / 4.0).alias("temperature"),
    )


def provider_b(t):
    return readings(t).where(F.col("event_type") == "purchase").select(
        *CELL_KEYS, F.col("value").alias("precipitation_b")
    )


@query(
    "priority_fusion",
    "J2 J3 P2",
    f"""WITH {PROVIDERS_SQL}, p AS (
      SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY latitude, longitude, valid_date ORDER BY event_id) = 1),
    s AS (SELECT latitude, longitude, valid_date, avg(precipitation_b) AS pb FROM b GROUP BY 1, 2, 3)
    SELECT p.latitude, p.longitude, CAST(p.valid_date AS VARCHAR) AS valid_date, temperature,
      {tidy_sql('coalesce(pb, precipitation_a)')} AS precipitation,
      CASE WHEN pb IS NOT NULL THEN 'B' ELSE 'A' END AS precipitation_source
    FROM p LEFT JOIN s ON s.latitude = p.latitude AND s.longitude = p.longitude AND s.valid_date = p.valid_date""",
)
def priority_fusion(t):
    fused = fusion.priority_fusion(
        fusion.on_grid(provider_a(t), 0.25),
        fusion.on_grid(provider_b(t), 0.25),
        "precipitation_a",
        "precipitation_b",
        "precipitation",
        ("A", "B"),
        order=["event_id"],
    )
    return fused.select(*cell(), "temperature", tidy("precipitation").alias("precipitation"), "precipitation_source")


@query(
    "provider_inner_join",
    "J1 A1 U2",
    f"""WITH {PROVIDERS_SQL}, pa AS (SELECT latitude, longitude, valid_date, avg(precipitation_a) AS x, avg(temperature) AS tm FROM a GROUP BY 1, 2, 3),
    pb AS (SELECT latitude, longitude, valid_date, avg(precipitation_b) AS y FROM b GROUP BY 1, 2, 3)
    SELECT {CELL_SQL}, {tidy_sql('x')} AS precipitation_a, {tidy_sql('tm')} AS temperature, {tidy_sql('y')} AS precipitation_b
    FROM pa JOIN pb USING (latitude, longitude, valid_date)""",
)
def provider_inner_join(t):
    joined = fusion.inner_fusion(
        fusion.mean_per_cell(provider_a(t), CELL_KEYS, ["precipitation_a", "temperature"]),
        fusion.mean_per_cell(provider_b(t), CELL_KEYS, ["precipitation_b"]),
    )
    return joined.select(*cell(), *[tidy(c).alias(c) for c in ("precipitation_a", "temperature", "precipitation_b")])


@query(
    "cell_means",
    "A1",
    f"""WITH {READINGS_SQL} SELECT latitude, longitude, {tidy_sql('avg(value)')} AS value, {tidy_sql('avg(k)')} AS k
    FROM readings GROUP BY 1, 2""",
)
def cell_means(t):
    means = fusion.mean_per_cell(readings(t), ["latitude", "longitude"], ["value", "k"])
    return means.select("latitude", "longitude", tidy("value").alias("value"), tidy("k").alias("k"))


@query(
    "yearly_day_coverage",
    "A4",
    """SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(DISTINCT CAST(l_shipdate AS DATE)) AS observed_days,
      CAST(CASE WHEN (year(l_shipdate) % 4 = 0 AND year(l_shipdate) % 100 <> 0) OR year(l_shipdate) % 400 = 0 THEN 366 ELSE 365 END AS INTEGER) AS expected_days,
      CAST(count(DISTINCT CAST(l_shipdate AS DATE)) >= 0.95 *
        CASE WHEN (year(l_shipdate) % 4 = 0 AND year(l_shipdate) % 100 <> 0) OR year(l_shipdate) % 400 = 0 THEN 366 ELSE 365 END AS INTEGER) AS complete
    FROM lineitem GROUP BY year(l_shipdate)""",
)
def yearly_day_coverage(t):
    out = fusion.coverage(t.lineitem, "l_shipdate")
    return out.withColumn("complete", F.col("complete").cast("int"))


@query(
    "climate_normals",
    "A5",
    f"""WITH {STATION_DAYS_SQL}, y AS (
      SELECT station, year(valid_date) AS yr, avg(precipitation) AS m, avg(temperature) AS tm,
        quantile_cont(precipitation, 0.95) AS p FROM station_days GROUP BY 1, 2)
    SELECT station, {tidy_sql('avg(m)')} AS precipitation_mean, {tidy_sql('avg(tm)')} AS temperature_mean,
      {tidy_sql('avg(p)')} AS precipitation_p95, count(*) AS years FROM y GROUP BY 1""",
)
def climate_normals(t):
    out = fusion.normals(
        station_days(t), ["station"], "valid_date", ["precipitation", "temperature"], ["precipitation"]
    )
    return out.select(
        "station",
        *[tidy(c).alias(c) for c in ("precipitation_mean", "temperature_mean", "precipitation_p95")],
        "years",
    )


@query(
    "provider_comparison",
    "A8",
    f"""WITH {STATION_DAYS_SQL}, y AS (
      SELECT station, year(valid_date) AS yr, count(*) AS days, corr(precipitation, potential_evaporation) AS r,
        avg(abs(precipitation - potential_evaporation)) AS mae, avg(precipitation - potential_evaporation) AS bias,
        sum(precipitation) AS ta, sum(potential_evaporation) AS tb FROM station_days GROUP BY 1, 2)
    SELECT station, count(DISTINCT yr) AS years, CAST(sum(days) AS BIGINT) AS days, {tidy_sql('median(r)')} AS median_correlation,
      {tidy_sql('median(mae)')} AS median_error, {tidy_sql('median(bias)')} AS median_bias,
      {tidy_sql('sum(ta)', 3)} AS candidate_total, {tidy_sql('sum(tb)', 3)} AS reference_total
    FROM y GROUP BY 1""",
)
def provider_comparison(t):
    yearly = fusion.compare_series(
        station_days(t),
        ["station", F.year("valid_date").alias("year")],
        "precipitation",
        "potential_evaporation",
    )
    return yearly.groupBy("station").agg(
        F.countDistinct("year").alias("years"),
        F.sum("days").alias("days"),
        tidy(F.median("correlation")).alias("median_correlation"),
        tidy(F.median("mean_absolute_error")).alias("median_error"),
        tidy(F.median("bias")).alias("median_bias"),
        tidy(F.sum("candidate_total"), 3).alias("candidate_total"),
        tidy(F.sum("reference_total"), 3).alias("reference_total"),
    )


@query(
    "district_series",
    "J4",
    f"""WITH {CELL_DAYS_SQL}, {DISTRICTS_SQL}, s AS (
      SELECT state, district, round_even(latitude / 0.5, 0) * 0.5 AS la, round_even(longitude / 0.5, 0) * 0.5 AS lo FROM districts),
    c AS (SELECT round_even(latitude / 0.5, 0) * 0.5 AS la, round_even(longitude / 0.5, 0) * 0.5 AS lo, valid_date, avg(precipitation) AS p
      FROM cell_days GROUP BY 1, 2, 3)
    SELECT state, district, CAST(valid_date AS VARCHAR) AS valid_date, {tidy_sql('p')} AS precipitation
    FROM c JOIN s USING (la, lo)""",
)
def district_series(t):
    days = fusion.mean_per_cell(fusion.on_grid(cell_days(t), 0.5), CELL_KEYS, ["precipitation"])
    joined = fusion.attach_to_places(days, districts(t), 0.5, ["state", "district"])
    return joined.select(
        "state", "district", F.col("valid_date").cast("string").alias("valid_date"),
        tidy("precipitation").alias("precipitation"),
    )


@query(
    "event_window_labels",
    "J5",
    f"""WITH {VERIFIED_EVENTS_SQL}, e AS (
      SELECT *, CASE hazard_type WHEN 'flood' THEN 1 ELSE 2 END AS w FROM verified_events WHERE verified AND confidence >= 45),
    c AS (SELECT latitude, longitude, valid_date, sum(value) AS precipitation FROM readings GROUP BY 1, 2, 3),
    m AS (SELECT c.latitude, c.longitude, c.valid_date, hazard_type, arg_max(source_event_id, event_id) AS g
      FROM c JOIN e ON e.latitude = c.latitude AND e.longitude = c.longitude AND abs(c.valid_date - e.event_date) <= e.w GROUP BY 1, 2, 3, 4)
    SELECT c.latitude, c.longitude, CAST(c.valid_date AS VARCHAR) AS valid_date, {tidy_sql('precipitation')} AS precipitation,
      CAST(f.g IS NOT NULL AS INTEGER) AS flood_risk, coalesce(f.g, '') AS flood_event_group,
      CAST(y.g IS NOT NULL AS INTEGER) AS cyclone_risk, coalesce(y.g, '') AS cyclone_event_group,
      'verified' AS label_method
    FROM c LEFT JOIN m f ON f.hazard_type = 'flood' AND f.latitude = c.latitude AND f.longitude = c.longitude AND f.valid_date = c.valid_date
    LEFT JOIN m y ON y.hazard_type = 'cyclone' AND y.latitude = c.latitude AND y.longitude = c.longitude AND y.valid_date = c.valid_date""",
)
def event_window_labels(t):
    days = cell_days(t).select(*CELL_KEYS, "precipitation")
    events = (
        verified_events(t)
        .where("verified AND confidence >= 45")
        .withColumn("event_group", alignment.event_group("source_event_id", "event_id"))
    )
    labelled = alignment.label_days(
        days, events, {"flood": 1, "cyclone": 2}, ["latitude", "longitude"], "valid_date", "event_id"
    )
    return labelled.select(
        *cell(),
        tidy("precipitation").alias("precipitation"),
        "flood_risk",
        "flood_event_group",
        "cyclone_risk",
        "cyclone_event_group",
        F.lit("verified").alias("label_method"),
    )


TARGET_HORIZONS = (3, 7, 14)


def _target_sql(key_join: str, series: str) -> str:
    parts = []
    for hazard in ("flood", "cyclone"):
        for h in TARGET_HORIZONS:
            inside = f"(hazard_type = '{hazard}' AND lead <= {h})"
            parts.append(
                f"CAST(coalesce(bool_or({inside}), false) AS INTEGER) AS {hazard}_risk_{h}d, "
                f"coalesce(string_agg(DISTINCT CASE WHEN {inside} THEN source_event_id END, '|' "
                f"ORDER BY CASE WHEN {inside} THEN source_event_id END), '') AS {hazard}_group_{h}d, "
                f"CAST(min(CASE WHEN {inside} THEN lead END) AS INTEGER) AS {hazard}_lead_{h}d"
            )
    return ", ".join(parts)


@query(
    "future_event_targets",
    "J6 J7 A9",
    f"""WITH {VERIFIED_EVENTS_SQL}, c AS (SELECT DISTINCT latitude, longitude, valid_date FROM readings),
    m AS (SELECT c.*, hazard_type, source_event_id, event_date - c.valid_date AS lead
      FROM c LEFT JOIN verified_events e ON e.latitude = c.latitude AND e.longitude = c.longitude
        AND event_date - c.valid_date BETWEEN 1 AND 14)
    SELECT {CELL_SQL}, {_target_sql('', '')} FROM m GROUP BY latitude, longitude, m.valid_date""",
)
def future_event_targets(t):
    events = verified_events(t).withColumn(
        "event_group", alignment.event_group("source_event_id", "event_id")
    )
    out = alignment.future_targets(
        cell_days(t).select(*CELL_KEYS),
        events,
        ("flood", "cyclone"),
        TARGET_HORIZONS,
        ["latitude", "longitude"],
        "valid_date",
    )
    return out.withColumn("valid_date", F.col("valid_date").cast("string"))


def district_targets(t):
    """Targets keyed by district name instead of grid cell."""
    places = districts(t).select("state", "district", "district_id")
    events = (
        verified_events(t)
        .withColumn("district_id", F.col("user_id"))
        .join(places, "district_id")
        .withColumn("event_group", F.col("source_event_id"))
    )
    days = cell_days(t).select("valid_date").distinct()
    # every district on every day: the day list is the calendar, not data sized
    calendar = days.agg(F.array_sort(F.collect_set("valid_date")).alias("days"))
    series = places.select("state", "district", F.explode(calendar.scalar()).alias("valid_date"))
    return alignment.future_targets(
        series, events, ("flood", "cyclone"), TARGET_HORIZONS, ["state", "district"], "valid_date"
    )


DISTRICT_TARGETS_SQL = f"""{VERIFIED_EVENTS_SQL}, {DISTRICTS_SQL},
    c AS (SELECT state, district, valid_date FROM districts, (SELECT DISTINCT valid_date FROM readings)),
    m AS (SELECT c.*, hazard_type, source_event_id, event_date - c.valid_date AS lead
      FROM c LEFT JOIN (SELECT v.*, d.state, d.district FROM verified_events v JOIN districts d ON d.district_id = v.user_id) e
        ON e.state = c.state AND e.district = c.district AND event_date - c.valid_date BETWEEN 1 AND 14),
    targets AS (SELECT state, district, valid_date, {_target_sql('', '')} FROM m GROUP BY 1, 2, 3)"""


@query(
    "district_event_targets",
    "J8",
    f"""WITH {DISTRICT_TARGETS_SQL} SELECT * REPLACE (CAST(valid_date AS VARCHAR) AS valid_date) FROM targets""",
)
def district_event_targets(t):
    return district_targets(t).withColumn("valid_date", F.col("valid_date").cast("string"))


TARGET_NAMES = [f"{z}_risk_{h}d" for z in ("flood", "cyclone") for h in TARGET_HORIZONS]


@query(
    "target_summary",
    "A35",
    f"""WITH {DISTRICT_TARGETS_SQL} SELECT count(*) AS rows, target, CAST(sum(v) AS BIGINT) AS positive_rows
    FROM (UNPIVOT (SELECT {', '.join(f'CAST({n} AS INTEGER) AS {n}' for n in TARGET_NAMES)} FROM targets) ON {', '.join(TARGET_NAMES)} INTO NAME target VALUE v) GROUP BY target""",
)
def target_summary(t):
    return alignment.target_summary(district_targets(t), TARGET_NAMES)


@query(
    "independent_event_ids",
    "A10",
    f"""WITH {DISTRICT_TARGETS_SQL} SELECT count(DISTINCT id) AS distinct_ids
    FROM (SELECT unnest(string_split(flood_group_14d, '|')) AS id FROM targets) WHERE id <> ''""",
)
def independent_event_ids(t):
    return alignment.distinct_ids(district_targets(t), "flood_group_14d")


@query(
    "event_frequency_by_hazard",
    "A6",
    f"""WITH {VERIFIED_EVENTS_SQL}, e AS (SELECT DISTINCT latitude, longitude, hazard_type, source, source_event_id FROM verified_events)
    SELECT latitude, longitude, count(*) FILTER (hazard_type = 'flood') AS flood,
      count(*) FILTER (hazard_type = 'cyclone') AS cyclone, count(*) FILTER (hazard_type = 'drought') AS drought
    FROM e GROUP BY 1, 2""",
)
def event_frequency_by_hazard(t):
    distinct = verified_events(t).dropDuplicates(
        ["latitude", "longitude", "hazard_type", "source", "source_event_id"]
    )
    kinds = ["flood", "cyclone", "drought"]
    return (
        distinct.groupBy("latitude", "longitude")
        .pivot("hazard_type", kinds)
        .agg(F.count(F.lit(1)))
        .na.fill(0, kinds)
    )


@query(
    "yearly_events_zero_filled",
    "A17",
    """WITH y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, o_orderpriority AS p FROM orders),
    g AS (SELECT CAST(unnest(range((SELECT min(yr) FROM y), (SELECT max(yr) FROM y) + 1)) AS INTEGER) AS year)
    SELECT year, kind, count(y.yr) AS events FROM g CROSS JOIN (VALUES ('1-URGENT'), ('2-HIGH'), ('9-NONE')) k(kind)
    LEFT JOIN y ON y.yr = g.year AND y.p = kind GROUP BY 1, 2""",
)
def yearly_events_zero_filled(t):
    return fusion.zero_filled(
        t.orders, F.year("o_orderdate"), "o_orderpriority", ["1-URGENT", "2-HIGH", "9-NONE"]
    )


@query(
    "duplicate_keys",
    "U3 J3",
    """SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
)
def duplicate_keys(t):
    return contracts.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "keep_first_and_last",
    "W14",
    """SELECT l_orderkey, l_linenumber, min(k) AS first_row, max(k) AS last_row FROM (
      SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') || '/' || l_partkey || '/' || l_suppkey AS k FROM lineitem) GROUP BY 1, 2""",
)
def keep_first_and_last(t):
    keys = ["l_orderkey", "l_linenumber"]
    rows = t.lineitem.select(
        *keys,
        F.concat_ws("/", F.date_format("l_shipdate", "yyyy-MM-dd"), "l_partkey", "l_suppkey").alias("k"),
    )
    first = dedupe.keep_first(rows, keys, ["k"]).withColumnRenamed("k", "first_row")
    last = dedupe.keep_last(rows, keys, ["k"]).withColumnRenamed("k", "last_row")
    return first.join(last, keys)
