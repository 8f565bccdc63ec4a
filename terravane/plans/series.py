"""Queries on cell-day and station-day series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terravane.functions import calendar, grid, weather
from terravane.operators import windows
from terravane.plans.bindings import (
    CELL,
    CELL_DAYS_SQL,
    READINGS_SQL,
    STATION,
    STATION_DAYS_SQL,
    cell_days,
    readings,
    station_days,
)
from terravane.plans.registry import query, tidy, tidy_columns, tidy_sql



def day_text():
    return F.col("valid_date").cast("string").alias("valid_date")


STATION_ID_SQL = "station, CAST(valid_date AS VARCHAR) AS valid_date"
CELL_ID_SQL = "latitude, longitude, CAST(valid_date AS VARCHAR) AS valid_date"


def over_station(rows: int) -> str:
    return f"OVER (PARTITION BY station ORDER BY valid_date ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


@query(
    "flagship_wettest_flagged_cells",
    "A2 W1 W4 W7 P7 K2",
    f"""WITH {CELL_DAYS_SQL}, f AS (
      SELECT *, sum(precipitation) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rain_3d,
        sum(precipitation) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rain_7d,
        temperature - avg(temperature) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS temperature_anomaly,
        row_number() OVER w - coalesce(max(CASE WHEN precipitation < 40 THEN rn END)
          OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS wet_streak
      FROM (SELECT *, row_number() OVER (PARTITION BY latitude, longitude ORDER BY valid_date) AS rn FROM cell_days)
      WINDOW w AS (PARTITION BY latitude, longitude ORDER BY valid_date))
    SELECT {CELL_ID_SQL}, {tidy_sql('rain_3d')} AS rain_3d, {tidy_sql('rain_7d')} AS rain_7d,
      {tidy_sql('temperature_anomaly')} AS temperature_anomaly, CAST(wet_streak AS INTEGER) AS wet_streak
    FROM f WHERE precipitation >= 200 OR rain_7d >= 450 OR wet_streak >= 4
    ORDER BY f.rain_7d DESC, f.valid_date, f.latitude, f.longitude LIMIT 100""",
)
def flagship_wettest_flagged_cells(t):
    days = windows.rolling_features(
        cell_days(t), CELL, sums={"precipitation": (3, 7)}, anomalies={"temperature": (30,)}
    )
    days = windows.streak(days, CELL, {"wet_streak": F.col("precipitation") >= 40})
    flagged = days.where(
        (F.col("precipitation") >= 200)
        | (F.col("precipitation_7d_sum") >= 450)
        | (F.col("wet_streak") >= 4)
    )
    top = flagged.orderBy(
        F.desc("precipitation_7d_sum"), "valid_date", "latitude", "longitude"
    ).limit(100)
    return top.select(
        "latitude",
        "longitude",
        day_text(),
        tidy("precipitation_3d_sum").alias("rain_3d"),
        tidy("precipitation_7d_sum").alias("rain_7d"),
        tidy("temperature_30d_anomaly").alias("temperature_anomaly"),
        "wet_streak",
    )


SUM_ROWS = (3, 7, 14, 30, 90, 180)


@query(
    "rolling_sums",
    "W1",
    f"WITH {STATION_DAYS_SQL} SELECT {STATION_ID_SQL}, "
    + ", ".join(f"{tidy_sql(f'sum(precipitation) {over_station(n)}')} AS sum_{n}" for n in SUM_ROWS)
    + " FROM station_days",
)
def rolling_sums(t):
    wanted = {f"sum_{n}": windows.Rolling("sum", "precipitation", n) for n in SUM_ROWS}
    rolled = windows.rolling(station_days(t), STATION, wanted)
    return rolled.select("station", day_text(), *[tidy(name).alias(name) for name in wanted])


MEAN_ROWS = (7, 30, 90, 365)


@query(
    "rolling_means_and_maxima",
    "W2 W3",
    f"WITH {STATION_DAYS_SQL} SELECT {STATION_ID_SQL}, "
    + ", ".join(f"{tidy_sql(f'avg(precipitation) {over_station(n)}')} AS mean_{n}" for n in MEAN_ROWS)
    + ", "
    + ", ".join(f"max(temperature) {over_station(n)} AS max_{n}" for n in (3, 7))
    + " FROM station_days",
)
def rolling_means_and_maxima(t):
    wanted = {f"mean_{n}": windows.Rolling("mean", "precipitation", n) for n in MEAN_ROWS}
    return windows.rolling(station_days(t), STATION, wanted).select(
        "station",
        day_text(),
        *[tidy(name).alias(name) for name in wanted],
        *[windows.rolling_max(STATION, "temperature", n).alias(f"max_{n}") for n in (3, 7)],
    )


@query(
    "trailing_anomalies",
    "W4",
    f"WITH {STATION_DAYS_SQL} SELECT {STATION_ID_SQL}, "
    + ", ".join(
        f"{tidy_sql(f'precipitation - avg(precipitation) {over_station(n)}')} AS anomaly_{n}"
        for n in (30, 365)
    )
    + " FROM station_days",
)
def trailing_anomalies(t):
    wanted = {f"anomaly_{n}": windows.Rolling("anomaly", "precipitation", n) for n in (30, 365)}
    rolled = windows.rolling(station_days(t), STATION, wanted)
    return rolled.select("station", day_text(), *[tidy(name).alias(name) for name in wanted])


@query(
    "month_of_year_anomaly",
    "W5",
    f"""WITH {STATION_DAYS_SQL} SELECT {STATION_ID_SQL},
      {tidy_sql('precipitation - avg(precipitation) OVER (PARTITION BY station, month(valid_date))')} AS anomaly
    FROM station_days""",
)
def month_of_year_anomaly(t):
    return station_days(t).select(
        "station", day_text(), tidy(windows.month_anomaly(STATION, "precipitation")).alias("anomaly")
    )


@query(
    "antecedent_wetness_index",
    "W6",
    f"""WITH RECURSIVE {STATION_DAYS_SQL}, numbered AS (
      SELECT *, row_number() OVER (PARTITION BY station ORDER BY valid_date) AS rn FROM station_days),
    walk AS (
      SELECT station, valid_date, rn, precipitation AS y FROM numbered WHERE rn = 1
      UNION ALL
      SELECT n.station, n.valid_date, n.rn, 0.15::DOUBLE * n.precipitation + 0.85::DOUBLE * w.y
      FROM walk w JOIN numbered n ON n.station = w.station AND n.rn = w.rn + 1)
    SELECT {STATION_ID_SQL}, {tidy_sql('y')} AS wetness FROM walk""",
)
def antecedent_wetness_index(t):
    series = station_days(t).select("station", "valid_date", "precipitation")
    folded = windows.decayed_index(series, STATION, "precipitation", 0.15, "wetness")
    return folded.select("station", day_text(), tidy("wetness").alias("wetness"))


@query(
    "wet_and_dry_streaks",
    "W7",
    f"""WITH {STATION_DAYS_SQL}, b AS (
      SELECT *, sum(CASE WHEN precipitation >= 30 THEN 0 ELSE 1 END) OVER w AS wet_block,
        sum(CASE WHEN precipitation <= 20 THEN 0 ELSE 1 END) OVER w AS dry_block
      FROM station_days WINDOW w AS (PARTITION BY station ORDER BY valid_date))
    SELECT {STATION_ID_SQL},
      CAST(sum(CASE WHEN precipitation >= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY station, wet_block ORDER BY valid_date) AS INTEGER) AS wet_streak,
      CAST(sum(CASE WHEN precipitation <= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY station, dry_block ORDER BY valid_date) AS INTEGER) AS dry_streak
    FROM b""",
)
def wet_and_dry_streaks(t):
    days = windows.streak(
        station_days(t),
        STATION,
        {
            "wet_streak": F.col("precipitation") >= 30,
            "dry_streak": F.col("precipitation") <= 20,
        },
    )
    return days.select("station", day_text(), "wet_streak", "dry_streak")


@query(
    "rolling_water_balance",
    "W8",
    f"""WITH {STATION_DAYS_SQL} SELECT {STATION_ID_SQL},
      {tidy_sql(f'sum(precipitation) {over_station(30)} - sum(potential_evaporation) {over_station(30)}')} AS balance_30
    FROM station_days""",
)
def rolling_water_balance(t):
    days = windows.water_balance(
        station_days(t), STATION, "precipitation", "potential_evaporation", 30, "balance_30"
    )
    return days.select("station", day_text(), tidy("balance_30").alias("balance_30"))


HORIZONS = (3, 7, 14)


@query(
    "future_window_features",
    "W9",
    f"WITH {STATION_DAYS_SQL} SELECT {STATION_ID_SQL}, "
    + ", ".join(
        f"CASE WHEN count(*) OVER f{h} = {h} THEN {tidy_sql(f'sum(precipitation) OVER f{h}')} END AS future_sum_{h}, "
        f"CASE WHEN count(*) OVER f{h} = {h} THEN max(precipitation) OVER f{h} END AS future_max_{h}, "
        f"CASE WHEN count(*) OVER f{h} = {h} THEN min(precipitation) OVER f{h} END AS future_min_{h}"
        for h in HORIZONS
    )
    + " FROM station_days WINDOW "
    + ", ".join(
        f"f{h} AS (PARTITION BY station ORDER BY valid_date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
        for h in HORIZONS
    ),
)
def future_window_features(t):
    columns = []
    for h in HORIZONS:
        columns += [
            tidy(windows.future_window(STATION, "precipitation", h, "sum")).alias(f"future_sum_{h}"),
            windows.future_window(STATION, "precipitation", h, "max").alias(f"future_max_{h}"),
            windows.future_window(STATION, "precipitation", h, "min").alias(f"future_min_{h}"),
        ]
    return station_days(t).select("station", day_text(), *columns)


@query(
    "monthly_low_quantile",
    "W10",
    f"""WITH {STATION_DAYS_SQL}, q AS (
      SELECT station, month(valid_date) AS m, quantile_cont(precipitation, 0.2) AS low
      FROM station_days GROUP BY 1, 2)
    SELECT d.station, CAST(valid_date AS VARCHAR) AS valid_date, {tidy_sql('low')} AS low,
      CAST(precipitation <= low AS INTEGER) AS is_low
    FROM station_days d JOIN q ON q.station = d.station AND q.m = month(d.valid_date)""",
)
def monthly_low_quantile(t):
    low = windows.grouped_quantile("precipitation", 0.2, ["station", F.month("valid_date")])
    return (
        station_days(t)
        .withColumn("low", low)
        .select(
            "station",
        day_text(),
            tidy("low").alias("low"),
            (F.col("precipitation") <= F.col("low")).cast("int").alias("is_low"),
        )
    )


@query(
    "dry_spell_episodes",
    "W12 A7",
    f"""WITH {STATION_DAYS_SQL}, d AS (
      SELECT *, valid_date - lag(valid_date) OVER (PARTITION BY station ORDER BY valid_date) AS gap
      FROM station_days WHERE precipitation <= 35),
    e AS (SELECT *, sum(CASE WHEN gap <= 7 THEN 0 ELSE 1 END) OVER (PARTITION BY station ORDER BY valid_date) AS episode FROM d),
    g AS (SELECT station, episode, min(valid_date) AS a, max(valid_date) AS b, count(*) AS active_days,
        min(soil_moisture) AS driest, max(precipitation) AS wettest FROM e GROUP BY 1, 2)
    SELECT station, CAST(a AS VARCHAR) AS first_day, CAST(b AS VARCHAR) AS last_day, active_days,
      CAST(b - a + 1 AS INTEGER) AS span_days, driest, wettest,
      count(*) OVER (PARTITION BY station) AS station_episodes
    FROM g WHERE b - a + 1 >= 14 AND active_days >= 14""",
)
def dry_spell_episodes(t):
    found = windows.episodes(
        station_days(t),
        STATION,
        F.col("precipitation") <= 35,
        max_gap_days=7,
        min_days=14,
        statistics={"driest": F.min("soil_moisture"), "wettest": F.max("precipitation")},
    )
    return found.select(
        "station",
        F.col("first_day").cast("string").alias("first_day"),
        F.col("last_day").cast("string").alias("last_day"),
        "active_days",
        "span_days",
        "driest",
        "wettest",
        F.count(F.lit(1)).over(Window.partitionBy("station")).alias("station_episodes"),
    )


@query(
    "first_difference",
    "W13",
    f"""WITH {STATION_DAYS_SQL} SELECT {STATION_ID_SQL},
      {tidy_sql('coalesce(temperature - lag(temperature) OVER (PARTITION BY station ORDER BY valid_date), 0.0)')} AS change
    FROM station_days""",
)
def first_difference(t):
    return station_days(t).select(
        "station", day_text(), tidy(windows.first_difference(STATION, "temperature")).alias("change")
    )


@query(
    "short_history_fallback",
    "P23",
    f"""WITH {CELL_DAYS_SQL} SELECT {CELL_ID_SQL},
      CASE WHEN n < 9 THEN {tidy_sql('precipitation')} ELSE {tidy_sql('s')} END AS rolling,
      CASE WHEN n < 9 THEN 0.0 ELSE {tidy_sql('precipitation - m')} END AS anomaly, n AS history_days
    FROM (SELECT *, count(*) OVER (PARTITION BY latitude, longitude) AS n,
      sum(precipitation) OVER w AS s, avg(precipitation) OVER w AS m FROM cell_days
      WINDOW w AS (PARTITION BY latitude, longitude ORDER BY valid_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))""",
)
def short_history_fallback(t):
    out = windows.short_history_features(cell_days(t), CELL, "precipitation", rows=7, min_days=9)
    return out.select("latitude", "longitude", day_text(), tidy("rolling").alias("rolling"), tidy("anomaly").alias("anomaly"), "history_days")


@query(
    "normalised_coordinates",
    "P1 P2 P3 P4 P5",
    f"""WITH {READINGS_SQL}, w AS (
      SELECT event_id, CAST(ts AS DATE) AS day, value,
        ((longitude * 1.37 + 180.0) % 360.0 + 360.0) % 360.0 - 180.0 AS lon, latitude * 1.01 AS lat FROM readings),
    n AS (SELECT event_id, day, value, round_even(lon * 1e4, 0) / 1e4 AS lon, round_even(lat * 1e4, 0) / 1e4 AS lat FROM w)
    SELECT event_id, CAST(day AS VARCHAR) AS valid_date, value AS rain,
      {tidy_sql('lat', 4)} AS latitude, {tidy_sql('lon', 4)} AS longitude,
      round_even(lat / 0.25, 0) * 0.25 + 0.0::DOUBLE AS grid_latitude,
      round_even(lon / 0.25, 0) * 0.25 + 0.0::DOUBLE AS grid_longitude
    FROM n WHERE lat BETWEEN -45 AND 30 AND lon BETWEEN 70 AND 179""",
)
def normalised_coordinates(t):
    placed = readings(t).select(
        "event_id",
        F.date_trunc("DAY", "ts").cast("date").cast("string").alias("valid_date"),
        F.col("value").alias("rain"),
        grid.normalise_latitude(F.col("latitude") * 1.01).alias("lat"),
        grid.normalise_longitude(F.col("longitude") * 1.37).alias("lon"),
    )
    inside = placed.where(grid.in_box("lat", "lon", grid.Box(70, -45, 179, 30)))
    return inside.select(
        "event_id",
        "valid_date",
        "rain",
        tidy("lat", 4).alias("latitude"),
        tidy("lon", 4).alias("longitude"),
        (grid.snap("lat", 0.25) + 0.0).alias("grid_latitude"),
        (grid.snap("lon", 0.25) + 0.0).alias("grid_longitude"),
    )


@query(
    "daily_resample",
    "A2 F5 F6",
    f"""WITH {READINGS_SQL} SELECT {CELL_ID_SQL},
      {tidy_sql('avg(value - 273.15)')} AS temperature_c, {tidy_sql('min(value - 273.15)')} AS temperature_min_c,
      {tidy_sql('max(value - 273.15)')} AS temperature_max_c,
      {tidy_sql('sum(greatest(value - 5, 0) * 1000)')} AS rain_mm, {tidy_sql('avg(k / 100.0)')} AS pressure_hpa,
      {tidy_sql('max(k * 3.6)')} AS wind_kmh, {tidy_sql('sum(greatest(-value, 0.0))')} AS runoff
    FROM readings GROUP BY latitude, longitude, valid_date""",
)
def daily_resample(t):
    celsius = weather.kelvin_to_celsius("value")
    return (
        readings(t)
        .groupBy("latitude", "longitude", "valid_date")
        .agg(
            tidy(F.avg(celsius)).alias("temperature_c"),
            tidy(F.min(celsius)).alias("temperature_min_c"),
            tidy(F.max(celsius)).alias("temperature_max_c"),
            tidy(F.sum(weather.metres_to_mm(weather.non_negative(F.col("value") - 5)))).alias("rain_mm"),
            tidy(F.avg(weather.pascal_to_hpa("k"))).alias("pressure_hpa"),
            tidy(F.max(weather.ms_to_kmh("k"))).alias("wind_kmh"),
            tidy(F.sum(weather.non_negative(-F.col("value")))).alias("runoff"),
        )
        .withColumn("valid_date", F.col("valid_date").cast("string"))
    )


@query(
    "calendar_features",
    "F1 F2",
    f"""WITH {STATION_DAYS_SQL} SELECT {STATION_ID_SQL}, CAST(year(d) AS INTEGER) AS year,
      CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day, CAST(dayofyear(d) AS INTEGER) AS day_of_year,
      CAST(weekofyear(d) AS INTEGER) AS iso_week, CAST(quarter(d) AS INTEGER) AS quarter,
      CAST((month(d) % 12) // 3 + 1 AS INTEGER) AS season,
      {tidy_sql('sin(month(d) * 2 * pi() / 12)')} AS month_sin, {tidy_sql('cos(month(d) * 2 * pi() / 12)')} AS month_cos
    FROM (SELECT *, valid_date AS d FROM station_days)""",
)
def calendar_features(t):
    sine, cosine = calendar.month_cycle("valid_date")
    days = station_days(t).select("station", "valid_date")
    return (
        calendar.with_calendar(days, "valid_date")
        .withColumns({"month_sin": tidy(sine), "month_cos": tidy(cosine)})
        .withColumn("valid_date", F.col("valid_date").cast("string"))
    )


@query(
    "threshold_flags",
    "P6",
    f"""WITH {CELL_DAYS_SQL} SELECT {CELL_ID_SQL},
      CAST(precipitation >= 150 AS INTEGER) AS heavy_rain, CAST(temperature_max >= 120 AS INTEGER) AS hot_day,
      CAST(temperature_min <= 10 AS INTEGER) AS cold_day FROM cell_days""",
)
def threshold_flags(t):
    return cell_days(t).select(
        "latitude",
        "longitude",
        day_text(),
        (F.col("precipitation") >= 150).cast("int").alias("heavy_rain"),
        (F.col("temperature_max") >= 120).cast("int").alias("hot_day"),
        (F.col("temperature_min") <= 10).cast("int").alias("cold_day"),
    )


@query(
    "humidity_and_wind",
    "F3 F4",
    f"""WITH {READINGS_SQL} SELECT event_id, {tidy_sql('sqrt(value * value + k * k)')} AS wind_speed,
      {tidy_sql('least(greatest(100 * exp(17.625 * (k / 4.0) / (243.04 + k / 4.0)) / exp(17.625 * (value / 10.0) / (243.04 + value / 10.0)), 0), 100)')} AS relative_humidity
    FROM readings""",
)
def humidity_and_wind(t):
    return readings(t).select(
        "event_id",
        tidy(weather.wind_speed("value", F.col("k").cast("double"))).alias("wind_speed"),
        tidy(weather.relative_humidity(F.col("value") / 10.0, F.col("k") / 4.0)).alias("relative_humidity"),
    )


@query(
    "tile_names",
    "F8",
    f"""WITH {READINGS_SQL}, c AS (SELECT DISTINCT latitude AS la, longitude AS lo FROM readings)
    SELECT la AS latitude, lo AS longitude, """
    + ", ".join(
        f"""CASE WHEN floor(la/{s})*{s} >= 0 THEN 'N' ELSE 'S' END || lpad(CAST(CAST(abs(floor(la/{s})*{s}) AS INTEGER) AS VARCHAR), 2, '0')
        || CASE WHEN floor(lo/{s})*{s} >= 0 THEN 'E' ELSE 'W' END || lpad(CAST(CAST(abs(floor(lo/{s})*{s}) AS INTEGER) AS VARCHAR), 3, '0') AS tile_{s}"""
        for s in (1, 3)
    )
    + " FROM c",
)
def tile_names(t):
    cells = readings(t).select("latitude", "longitude").distinct()
    return cells.withColumns(
        {
            "tile_1": grid.tile_name("latitude", "longitude", 1),
            "tile_3": grid.tile_name("latitude", "longitude", 3),
        }
    )
