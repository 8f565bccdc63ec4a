"""The driver tables seen as weather series, places, events and candidate texts.

Each binding exists twice, as a DataFrame and as a SQL common table expression,
so a query and its SQL twin start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.operators.windows import SeriesKey
from terravane.plans.registry import Tables

CELL = SeriesKey(("latitude", "longitude"), "valid_date")
STATION = SeriesKey(("station",), "valid_date")


def cell_latitude(user):
    """Users laid out on a global quarter-degree grid, 400 rows by 1440 columns."""
    return (F.col(user) % 400) * 0.25 - 50.0


def cell_longitude(user):
    return (F.floor(F.col(user) / 400) % 1440) * 0.25 + 60.0


CELL_COLUMNS_SQL = """(user_id % 400) * 0.25::DOUBLE - 50.0::DOUBLE AS latitude,
    ((user_id // 400) % 1440) * 0.25::DOUBLE + 60.0::DOUBLE AS longitude"""


def readings(t: Tables) -> DataFrame:
    """Raw readings: one row per event, placed on its cell."""
    return t.events.select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        cell_latitude("user_id").cast("double").alias("latitude"),
        cell_longitude("user_id").cast("double").alias("longitude"),
        F.to_date("ts").alias("valid_date"),
        "ts",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


READINGS_SQL = f"""readings AS (
  SELECT event_id, user_id, event_type, value, {CELL_COLUMNS_SQL},
    CAST(ts AS DATE) AS valid_date, ts,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events)"""


def exact_sum(value: str) -> Column:
    """Sum of amounts of up to six decimals: exact, so the same in whatever order the rows come.

    A group that holds any other amount (NaN, infinite, finer or larger) is added up as doubles.
    """
    amount = F.col(value)
    written = amount.try_cast("decimal(18,6)")
    plain = F.bool_and(F.coalesce(written.cast("double") == amount, amount.isNull()))
    return F.coalesce(F.when(plain, F.try_sum(written).cast("double")), F.sum(amount))


def cell_days(t: Tables) -> DataFrame:
    """The core fact: one row per cell and day."""
    return readings(t).groupBy("latitude", "longitude", "valid_date").agg(
        exact_sum("value").alias("precipitation"),
        F.avg("value").alias("temperature"),
        F.min("value").alias("temperature_min"),
        F.max("value").alias("temperature_max"),
        F.sum("k").cast("double").alias("potential_evaporation"),
        F.max("k").cast("double").alias("wind_speed"),
    )


CELL_DAYS_SQL = f"""{READINGS_SQL}, cell_days AS (
  SELECT latitude, longitude, valid_date, sum(value) AS precipitation,
    avg(value) AS temperature, min(value) AS temperature_min, max(value) AS temperature_max,
    CAST(sum(k) AS DOUBLE) AS potential_evaporation, CAST(max(k) AS DOUBLE) AS wind_speed
  FROM readings GROUP BY 1, 2, 3)"""


def station_days(t: Tables) -> DataFrame:
    """Several years of daily rows per station, with date gaps."""
    return t.lineitem.groupBy(
        F.col("l_suppkey").alias("station"), F.to_date("l_shipdate").alias("valid_date")
    ).agg(
        F.sum("l_quantity").alias("precipitation"),
        F.avg("l_quantity").alias("temperature"),
        F.sum(F.col("l_tax") * 100).alias("potential_evaporation"),
        F.max("l_discount").alias("soil_moisture"),
    )


STATION_DAYS_SQL = """station_days AS (
  SELECT l_suppkey AS station, CAST(l_shipdate AS DATE) AS valid_date,
    sum(l_quantity) AS precipitation, avg(l_quantity) AS temperature,
    sum(l_tax * 100) AS potential_evaporation, max(l_discount) AS soil_moisture
  FROM lineitem GROUP BY 1, 2)"""


def districts(t: Tables) -> DataFrame:
    """Registry of places: the suppliers, spread over the band the customers lie in."""
    key = F.col("s_suppkey")
    return t.supplier.select(
        F.concat(F.lit("NATION_"), F.col("s_nationkey")).alias("state"),
        F.col("s_name").alias("district"),
        key.alias("district_id"),
        (((key * 37) % 800) * 0.0625 - 20.0).cast("double").alias("latitude"),
        (((key * 53) % 797) * 0.0625 + 60.0).cast("double").alias("longitude"),
        F.col("s_acctbal").alias("balance"),
    )


DISTRICTS_SQL = """districts AS (
  SELECT 'NATION_' || s_nationkey AS state, s_name AS district, s_suppkey AS district_id,
    ((s_suppkey * 37) % 800) * 0.0625::DOUBLE - 20.0::DOUBLE AS latitude,
    ((s_suppkey * 53) % 797) * 0.0625::DOUBLE + 60.0::DOUBLE AS longitude, s_acctbal AS balance
  FROM supplier)"""


def points(t: Tables) -> DataFrame:
    """Places to look up: the customers."""
    key = F.col("c_custkey")
    return t.customer.select(
        key.alias("point_id"),
        (((key * 7919) % 3203) * 0.015625 - 20.0).cast("double").alias("latitude"),
        (((key * 104729) % 3187) * 0.015625 + 60.0).cast("double").alias("longitude"),
        F.col("c_acctbal").alias("amount"),
        F.col("c_mktsegment").alias("segment"),
    )


POINTS_SQL = """points AS (
  SELECT c_custkey AS point_id,
    ((c_custkey * 7919) % 3203) * 0.015625::DOUBLE - 20.0::DOUBLE AS latitude,
    ((c_custkey * 104729) % 3187) * 0.015625::DOUBLE + 60.0::DOUBLE AS longitude,
    c_acctbal AS amount, c_mktsegment AS segment
  FROM customer)"""


def verified_events(t: Tables) -> DataFrame:
    """Event records: every reading, its hazard told by its type, several per source group."""
    return readings(t).select(
        "event_id",
        "user_id",
        F.col("valid_date").alias("event_date"),
        F.when(F.col("event_type").isin("signup", "purchase"), "cyclone").otherwise("flood").alias("hazard_type"),
        "latitude",
        "longitude",
        (F.col("k") >= 10).alias("verified"),
        F.least(F.col("value") / 3.0, F.lit(100.0)).alias("confidence"),
        F.concat(F.lit("src"), F.col("k") % 7).alias("source"),
        F.concat(F.lit("grp"), F.floor(F.col("event_id") / 60)).alias("source_event_id"),
        "k",
        "value",
    )


VERIFIED_EVENTS_SQL = f"""{READINGS_SQL}, verified_events AS (
  SELECT event_id, user_id, valid_date AS event_date,
    CASE WHEN event_type IN ('signup', 'purchase') THEN 'cyclone' ELSE 'flood' END AS hazard_type,
    latitude, longitude, k >= 10 AS verified, least(value / 3.0, 100.0) AS confidence,
    'src' || (k % 7) AS source, 'grp' || (event_id // 60) AS source_event_id, k, value
  FROM readings)"""


def scored(t: Tables) -> DataFrame:
    """Scored rows with a truth label, an event group and a day."""
    d, l = t.documents, t.labels
    return l.join(d.select("doc_id", "n_chars", "source", "lang"), "doc_id").select(
        "doc_id",
        (F.col("n_chars") / (F.col("n_chars") + 900.0)).alias("probability"),
        F.col("toxic").alias("target"),
        F.when(
            F.col("toxic") == 1, F.concat(F.lit("grp"), F.floor(F.col("doc_id") / 50))
        ).otherwise("").alias("event_group"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("date"),
        "source",
        "lang",
    )


SCORED_SQL = """scored AS (
  SELECT doc_id, n_chars / (n_chars + 900.0::DOUBLE) AS probability, toxic AS target,
    CASE WHEN toxic = 1 THEN 'grp' || (doc_id // 50) ELSE '' END AS event_group,
    DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS date, source, lang
  FROM labels JOIN documents USING (doc_id))"""
