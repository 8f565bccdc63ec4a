from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from terravane import contracts
from terravane.operators import alignment, fusion

DAY = date(2024, 3, 10)


def test_priority_fusion_prefers_secondary_and_tags(rows):
    primary = rows(
        "latitude double, longitude double, valid_date date, p double, id int",
        (10.0, 20.0, DAY, 1.0, 2), (10.0, 20.0, DAY, 9.0, 1), (10.25, 20.0, DAY, 3.0, 3),
    )
    secondary = rows(
        "latitude double, longitude double, valid_date date, s double",
        (10.0, 20.0, DAY, 4.0), (10.0, 20.0, DAY, 6.0), (50.0, 50.0, DAY, 7.0),
    )
    out = fusion.priority_fusion(primary, secondary, "p", "s", "rain", ("P", "S"), ["id"])
    got = {(r.latitude, r.rain, r.rain_source) for r in out.collect()}
    assert got == {(10.0, 5.0, "S"), (10.25, 3.0, "P")}


def test_paired_series(rows):
    frame = rows("y int, a double, b double", *[(1, float(i + 2), float(i)) for i in range(3)], (2, None, 1.0))
    out = {r.y: r for r in fusion.compare_series(frame, ["y"], "a", "b").collect()}
    assert out[1].days == 3 and out[1].bias == pytest.approx(2.0) and out[1].correlation == pytest.approx(1.0)
    assert out[2].days == 0 and out[2].correlation is None and out[2].bias is None


def cells(rows, n):
    return rows(
        "latitude double, longitude double, valid_date date",
        *[(1.0, 2.0, DAY + timedelta(days=i)) for i in range(n)],
    )


EVENTS = "latitude double, longitude double, event_date date, hazard_type string, event_group string, event_id long"


def test_event_window_is_inclusive_and_last_event_names_the_group(rows):
    events = rows(
        EVENTS,
        (1.0, 2.0, DAY + timedelta(days=3), "flood", "old", 1),
        (1.0, 2.0, DAY + timedelta(days=4), "flood", "new", 2),
    )
    out = alignment.label_days(cells(rows, 8), events, {"flood": 1}, ["latitude", "longitude"], "valid_date", "event_id")
    got = [(r.flood_risk, r.flood_event_group) for r in out.orderBy("valid_date").collect()]
    assert got == [(0, ""), (0, ""), (1, "old"), (1, "new"), (1, "new"), (1, "new"), (0, ""), (0, "")]


def test_future_targets_never_touch_the_event_day(rows):
    events = rows(
        EVENTS,
        (1.0, 2.0, DAY + timedelta(days=5), "flood", "b", 1),
        (1.0, 2.0, DAY + timedelta(days=6), "flood", "a", 2),
    )
    out = alignment.future_targets(cells(rows, 9), events, ["flood"], [3, 7], ["latitude", "longitude"], "valid_date")
    got = out.orderBy("valid_date").collect()
    assert [r.flood_risk_3d for r in got] == [0, 0, 1, 1, 1, 1, 0, 0, 0]
    assert got[4].flood_group_3d == "a|b" and got[4].flood_lead_3d == 1
    assert got[6].flood_risk_7d == 0 and got[6].flood_group_7d == "" and got[6].flood_lead_7d is None
    assert all(r.flood_risk_7d == 0 for r in got if r.valid_date >= DAY + timedelta(days=6))


def test_contracts(rows):
    frame = rows("k int, v double", (1, 1.0), (1, None))
    with pytest.raises(contracts.ContractError):
        contracts.assert_unique_key(frame, ["k"])
    with pytest.raises(contracts.ContractError):
        contracts.assert_no_nulls(frame)
    with pytest.raises(contracts.ContractError):
        contracts.require_columns(frame, ["missing"])
    bad = rows("flood_prediction int, flood_probability double", (2, 1.5), (0, None))
    with pytest.raises(contracts.ContractError):
        contracts.check_probabilities(bad, ["flood"])
    good = rows("flood_prediction int, flood_probability double", (0, None))
    assert contracts.check_probabilities(good, ["flood"], optional=["flood"]) is good


def test_coverage_knows_leap_years(rows):
    frame = rows("valid_date date", *[(date(2024, 1, 1) + timedelta(days=i),) for i in range(366)])
    row = fusion.coverage(frame).first()
    assert (row.observed_days, row.expected_days, row.complete) == (366, 366, True)


def test_zero_filled_years(rows):
    frame = rows("d date, h string", (date(2020, 1, 1), "x"), (date(2022, 1, 1), "x"))
    out = fusion.zero_filled(frame, F.year("d"), "h", ["x", "y"])
    assert {(r.year, r.kind, r.events) for r in out.collect()} == {
        (2020, "x", 1), (2021, "x", 0), (2022, "x", 1), (2020, "y", 0), (2021, "y", 0), (2022, "y", 0)
    }


def test_future_targets_repeat_no_event_for_the_days_before_it(rows):
    """One aggregation by key and day and one window; extra columns, repeated rows and null keys stay."""
    series = rows("cell string, valid_date string, note int", ("a", "2024-01-01", 1), ("a", "2024-01-01", 2), (None, "2024-01-01", 3))
    events = rows(
        "cell string, event_date string, hazard_type string, event_group string",
        ("a", "2024-01-03", "flood", "x"), ("a", "2024-01-08", "flood", "y"), (None, "2024-01-02", "flood", "z"), ("a", "2024-01-02", "flood", None),
    )
    days = series.withColumn("valid_date", F.col("valid_date").cast("date"))
    out = alignment.future_targets(days, events.withColumn("event_date", F.col("event_date").cast("date")), ["flood"], [3, 7], ["cell"], "valid_date")
    assert "explode(sequence" not in out._jdf.queryExecution().toString()
    found = {r["note"]: (r["flood_risk_3d"], r["flood_group_3d"], r["flood_lead_3d"], r["flood_group_7d"]) for r in out.collect()}
    assert found == {1: (1, "x", 1, "x|y"), 2: (1, "x", 1, "x|y"), 3: (0, "", None, "")}
