import math
from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from terravane.functions import calendar, grid, weather
from terravane.operators import windows
from terravane.operators.windows import SeriesKey

KEY = SeriesKey(("cell",), "day")
START = date(2024, 1, 1)


def series(rows, values, offsets=None):
    offsets = offsets or range(len(values))
    return rows(
        "cell long, day date, rain double",
        *[(1, START + timedelta(days=o), v) for o, v in zip(offsets, values)],
    )


def column(frame, expression):
    return [r[0] for r in frame.select("day", expression.alias("x")).orderBy("day").select("x").collect()]


def test_rolling_sum_counts_rows_not_days(rows):
    frame = series(rows, [4.0, 0.5, 2.0, 8.5, 1.0, 6.0], offsets=[0, 3, 4, 11, 30, 31])
    assert column(frame, windows.rolling_sum(KEY, "rain", 4)) == [4.0, 4.5, 6.5, 15.0, 12.0, 17.5]


@pytest.mark.parametrize("n", [32, 90])
def test_long_frames_equal_sliding_frames(rows, n):
    values = [None if i % 7 == 3 else float((i * 37) % 11) for i in range(200)]
    frame = series(rows, values)
    wanted = {"s": windows.Rolling("sum", "rain", n), "m": windows.Rolling("mean", "rain", n)}
    rolled = windows.rolling(frame, KEY, wanted)
    got, means = column(rolled, F.col("s")), column(rolled, F.col("m"))
    assert means == pytest.approx(column(frame, windows.rolling_mean(KEY, "rain", n)))
    for i in range(200):
        window = [v for v in values[max(0, i - n + 1) : i + 1] if v is not None]
        assert got[i] == pytest.approx(sum(window))
        assert means[i] == pytest.approx(sum(window) / len(window))


@pytest.mark.parametrize("n", [5, 31, 32, 90])
def test_values_that_left_the_frame_leave_no_trace(rows, n):
    values = [1e16, 1.0, float("inf"), float("nan")] + [1.0] * 150
    frame = series(rows, values)
    got = column(windows.rolling(frame, KEY, {"s": windows.Rolling("sum", "rain", n)}), F.col("s"))
    assert got == column(frame, windows.rolling_sum(KEY, "rain", n)) or math.isinf(got[2])
    assert got[2 + n :] == [min(n, i - 3.0) for i in range(2 + n, len(values))][: len(got[2 + n :])]
    assert column(frame, windows.rolling_mean(KEY, "rain", n))[-1] == 1.0


def test_rolling_sum_of_only_nulls_is_null(rows):
    frame = series(rows, [None] * 40)
    assert column(frame, windows.rolling_sum(KEY, "rain", 35)) == [None] * 40
    assert column(windows.rolling(frame, KEY, {"s": windows.Rolling("sum", "rain", 35)}), F.col("s")) == [None] * 40


def test_all_frame_lengths_from_blocks(rows):
    """Every length around the block sizes, two columns with their own nulls, several cells."""
    lengths = [1, 2, 7, 8, 9, 15, 16, 17, 63, 64, 65, 127, 200, 511, 512, 513, 700]
    values = [(c, START + timedelta(days=2 * i), None if (i + c) % 5 == 0 else float((i * 31 + c) % 17), float(i % 9)) for c in (1, 2) for i in range(600)]
    frame = rows("cell long, day date, rain double, heat double", *values)
    wanted = {f"r{n}": windows.Rolling("sum", "rain", n) for n in lengths}
    wanted |= {f"h{n}": windows.Rolling("anomaly", "heat", n) for n in (3, 30, 365)}
    rolled = windows.rolling(frame, KEY, wanted)
    assert rolled.columns == [*frame.columns, *wanted]
    series = {c: [v for v in values if v[0] == c] for c in (1, 2)}
    place = {(v[0], v[1]): i for c in series for i, v in enumerate(series[c])}
    for r in rolled.collect():
        i, own = place[r["cell"], r["day"]], series[r["cell"]]
        for n in lengths:
            inside = [v[2] for v in own[max(0, i - n + 1) : i + 1] if v[2] is not None]
            assert r[f"r{n}"] == (sum(inside) if inside else None)
        for n in (3, 30, 365):
            inside = [v[3] for v in own[max(0, i - n + 1) : i + 1]]
            assert r[f"h{n}"] == pytest.approx(own[i][3] - sum(inside) / len(inside))
    plan = rolled._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_future_window_needs_all_rows(rows):
    frame = series(rows, [0.5, 6.0, 2.25, 1.0, 9.0])
    assert column(frame, windows.future_window(KEY, "rain", 3, "sum")) == [9.25, 12.25, None, None, None]


def test_streak_resets_and_treats_null_as_false(rows):
    frame = series(rows, [5.0, 5.0, 0.0, 5.0, None, 5.0, 5.0])
    out = windows.streak(frame, KEY, {"wet": F.col("rain") >= 1})
    got = [r.wet for r in out.orderBy("day").collect()]
    assert got == [1, 2, 0, 1, 0, 1, 2]
    assert all(run <= i + 1 for i, run in enumerate(got))


def test_decayed_index_matches_the_recursion(rows):
    values = [float((i * 17) % 23) for i in range(400)]
    frame = windows.decayed_index(series(rows, values), KEY, "rain", 0.15, "index")
    got = column(frame, F.col("index"))
    y = values[0]
    for i, v in enumerate(values):
        y = v if i == 0 else 0.15 * v + 0.85 * y
        assert got[i] == pytest.approx(y, abs=1e-9)


def test_decayed_index_weighs_by_position_and_cuts_nothing(rows):
    values = [None, 0.0, None, 2.0, float("nan"), 5.0] + [1.0 if i % 5 else None for i in range(300)]
    frame = windows.decayed_index(series(rows, values), KEY, "rain", 0.5, "index")
    got = column(frame, F.col("index"))
    assert got[0] is None and got[3] == pytest.approx(4 / 3) and got[4] == got[3]
    want = pd.Series(values, dtype=float).ewm(alpha=0.5, adjust=False).mean()
    assert got[1:] == pytest.approx(want.tolist()[1:])
    slow = windows.decayed_index(series(rows, [1e16] + [0.0] * 400), KEY, "rain", 0.01, "index")
    assert column(slow, F.col("index"))[-1] == pytest.approx(1e16 * 0.99**400)


@pytest.mark.parametrize("gap,expected", [(7, 1), (8, 2)])
def test_episode_gap(rows, gap, expected):
    offsets = list(range(10)) + [9 + gap + i for i in range(10)]
    frame = series(rows, [1.0] * 20, offsets)
    found = windows.episodes(frame, KEY, F.col("rain") > 0, 7, 10, {"top": F.max("rain")})
    assert found.count() == expected


def test_short_episode_is_dropped(rows):
    frame = series(rows, [1.0] * 13)
    assert windows.episodes(frame, KEY, F.col("rain") > 0, 7, 14, {}).count() == 0
    frame = series(rows, [1.0] * 14)
    assert windows.episodes(frame, KEY, F.col("rain") > 0, 7, 14, {}).first().span_days == 14


def test_one_exchange_and_one_sort_for_all_rolling_features(rows):
    frame = windows.rolling_features(
        series(rows, [1.0, 2.0]), KEY, sums={"rain": (3, 90)}, means={"rain": (7, 365)}, maxima={"rain": (3,)}
    ).withColumn("next", windows.future_window(KEY, "rain", 3))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert plan.count("+- Sort") == 1


def test_grid_rounding_and_wrapping(rows):
    frame = rows("x double", (0.125,), (0.375,), (-0.125,), (270.0,), (-190.0,))
    snapped = [r[0] + 0.0 for r in frame.select(grid.snap("x", 0.25)).collect()]
    assert snapped[:3] == [0.0, 0.5, 0.0]
    wrapped = [r[0] for r in frame.select(grid.wrap_longitude("x")).collect()]
    assert wrapped[3:] == [-90.0, 170.0]


def test_tile_names(rows):
    frame = rows("lat double, lon double", (27.48, 94.91), (-0.5, -0.5))
    names = frame.select(grid.tile_name("lat", "lon", 1), grid.tile_name("lat", "lon", 3)).collect()
    assert tuple(names[0]) == ("N27E094", "N27E093")
    assert names[1][0] == "S01W001"


def test_season_and_humidity(rows):
    frame = rows("d date, t double, dew double", (date(2024, 12, 5), 20.0, 20.0), (date(2024, 6, 5), 20.0, 30.0))
    got = frame.select(calendar.season("d"), weather.relative_humidity("t", "dew")).collect()
    assert [r[0] for r in got] == [1, 3]
    assert got[0][1] == pytest.approx(100.0) and got[1][1] == 100.0


def test_heavy_rain_does_not_depend_on_the_order_of_readings(rows):
    """Amounts that make 150 exactly, but not as doubles added one by one."""
    from functools import reduce
    from operator import add

    from terravane.plans.bindings import exact_sum

    amounts = [0.1] * 1500
    assert reduce(add, amounts) != 150.0
    given = [("a", v) for v in amounts] + [("b", 1e-9), ("b", None), ("c", None), ("d", float("inf")), ("d", 1.0)]
    found = rows("cell string, value double", *given).groupBy("cell").agg(exact_sum("value").alias("s"))
    assert {r["cell"]: r["s"] for r in found.collect()} == {"a": 150.0, "b": 1e-9, "c": None, "d": float("inf")}


def test_proxy_labels_sort_twice_in_small_tasks(spark, rows):
    from terravane.operators import labels

    limits = labels.ProxyThresholds(50, 100, 10, 2, 5, 2, -1, 1, 20, 30)
    frame = rows("station long, valid_date date, precipitation double, temperature double")
    plan = labels.proxy_labels(frame, SeriesKey(("station",)), limits)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 2 and plan.count("Exchange hashpartitioning") == 1
    assert f", {8 * spark.sparkContext.defaultParallelism})" in plan
