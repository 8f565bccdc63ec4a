import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from terravane import contracts
from terravane.functions import scoring
from terravane.operators import audits, metrics, ranking, sampling, serving

BANDS = ((25.0, "LOW"), (50.0, "MODERATE"))


def value(rows, expression):
    return rows("x int", (1,)).select(expression.alias("v")).first().v


@pytest.mark.parametrize("score,name", [(None, "UNAVAILABLE"), (24.9, "LOW"), (25.0, "MODERATE"), (50.0, "TOP")])
def test_level_edges(rows, score, name):
    assert value(rows, scoring.level(F.lit(score).cast("double"), BANDS, "TOP")) == name


def test_null_aware_scores(rows):
    null = F.lit(None).cast("double")
    assert value(rows, scoring.mean_of_present([F.lit(1.0), null, F.lit(3.0)])) == 2.0
    assert value(rows, scoring.mean_of_present([null])) is None
    assert value(rows, scoring.probability_signal(null, F.lit(3), {3: 0.1}, 3)) is None
    assert value(rows, scoring.blend_when_present(F.lit(40.0), null, 0.5)) == 40.0
    assert value(rows, scoring.risk_points(F.lit(1), null, (0.2,))) is None


def test_dominant_ties_and_none(rows):
    pairs = [("Flood", F.lit(2)), ("Drought", F.lit(2)), ("Cyclone", F.lit(1))]
    assert value(rows, scoring.dominant(pairs)) == "Flood"
    assert value(rows, scoring.dominant([("Flood", F.lit(0))] * 2, none_when_zero="None")) == "None"


def test_horizons(rows):
    frame = rows("k int, lead int, rain double", *[(1, i, 10.0) for i in range(1, 15)])
    out = serving.horizon_aggregates(frame, ["k"], "lead", (3, 7, 14), {"rain": ("sum", "rain")})
    assert {r.horizon_days: r.rain for r in out.collect()} == {3: 30.0, 7: 70.0, 14: 140.0}


def test_longer_horizon_moves_toward_the_baseline(rows):
    frame = rows(
        "state string, district string, horizon_days int, valid_from date, f_weather_risk_score double, f_susceptibility double",
        ("s", "d", 7, date(2024, 1, 1), 90.0, 0.1), ("s", "e", 14, date(2024, 1, 1), 90.0, 0.1),
    )
    out = serving.planning_outlook(frame, ["f"], {15: 0.9, 90: 0.2}, BANDS, "TOP", (0.6, 0.4), preferred=14)
    got = {r.outlook_horizon_days: r for r in out.collect()}
    assert {r.district for r in got.values()} == {"e"}
    assert got[15].f_outlook_score == 82.0 and got[90].f_outlook_score == 26.0
    assert got[90].valid_to == date(2024, 3, 30)


def test_unequal_forecast_arrays_are_an_error(rows):
    frame = rows("p string", ('{"daily":{"time":["a","b"],"v":[1.0]}}',))
    with pytest.raises(Exception, match="differ in length"):
        serving.json_daily_rows(frame, "p", "time ARRAY<STRING>, v ARRAY<DOUBLE>", []).collect()


def test_stale_forecast(rows):
    frame = rows("t timestamp", (datetime(2024, 1, 1),))
    with pytest.raises(contracts.ContractError, match="stale"):
        serving.require_fresh(frame, "t", F.lit("2024-01-03 00:00:00"), 36)
    assert serving.require_fresh(frame, "t", F.lit("2024-01-01 12:00:00"), 36) is frame


def test_normalise_flat_missing_and_inverted(rows):
    frame = rows("flat double, v double", (3.0, 0.0), (3.0, 10.0), (3.0, None))
    out = serving.normalised(frame, {"flat": False, "v": True}, 0.0, 1.0).collect()
    assert {r.flat_score for r in out} == {0.5}
    assert {(r.v, r.v_score) for r in out} == {(0.0, 1.0), (10.0, 0.0), (None, None)}


def test_positions_with_a_hot_value(rows):
    rng = random.Random(1)
    values = [("a", float(rng.randrange(40))) for _ in range(300)] + [("a", 7.0)] * 200 + [("b", 1.0)]
    out = ranking.positions(rows("g string, v double", *values), "v", ["g"])
    for r in out.collect():
        mine = [v for g, v in values if g == r.g]
        assert (r.below, r.at_value, r.total) == (sum(v < r.v for v in mine), mine.count(r.v), len(mine))


def test_quantiles(rows):
    frame = rows("v double", *[(float(i),) for i in range(1, 5)])
    linear = {r.probability: r.quantile for r in ranking.quantiles(frame, "v", [0.0, 0.5, 1.0]).collect()}
    assert linear == {0.0: 1.0, 0.5: 2.5, 1.0: 4.0}
    assert ranking.quantiles(frame, "v", [0.5], method="higher").first().quantile == 3.0


SCORED = "p double, y int, g string, d date"
DAY = date(2024, 1, 1)


def test_event_ranking_and_alert_budget(rows):
    ranked = rows(
        SCORED, (0.9, 0, "", DAY), (0.8, 1, "a", DAY), (0.1, 0, "", DAY), (0.2, 0, "", DAY),
        (0.7, 1, "b", DAY + timedelta(days=1)), (0.1, 0, "", DAY + timedelta(days=1)),
        (0.2, 0, "", DAY + timedelta(days=1)), (0.3, 0, "", DAY + timedelta(days=1)),
    )
    out = metrics.event_ranking(metrics.event_ranks(ranked, "p", "y", "g", "d"), [0.05]).first()
    assert out.median_best_rank == 0.375 and out.detected_events == 0
    budget = rows(SCORED, *[(i / 10, int(i == 9), "a" if i == 9 else "", DAY) for i in range(10)])
    threshold = metrics.alert_threshold(budget, "p", 0.2).first().threshold
    assert threshold == 0.8
    assert metrics.alert_burden(budget, "p", "d", threshold).first().alerted_rows == 2
    assert metrics.event_metrics(budget, "p", "y", "g", "d", threshold).first().detected_events == 1
    with pytest.raises(ValueError):
        metrics.alert_threshold(budget, "p", 1.5)


def test_perfect_probabilities_and_single_class(rows):
    frame = rows("p double, y int", *[(float(i % 2), i % 2) for i in range(10)])
    row = metrics.probability_diagnostics(frame, "p", "y").first()
    assert row.brier_score == 0 and row.expected_calibration_error == 0 and row.brier_skill_score == 1
    areas = metrics.curve_areas(frame, "p", "y").first()
    assert (areas.roc_auc, areas.pr_auc) == (1.0, 1.0)
    areas = metrics.curve_areas(frame.where("y = 0"), "p", "y").first()
    assert areas.roc_auc is None and areas.pr_auc is None


def test_drift(rows):
    old = rows("a double, b double, c double", *[(float(i), 1.0, None) for i in range(100)])
    new = rows("a double, b double, c double", *[(float(i + 80), 1.0, 1.0) for i in range(100)])
    got = {r.feature: r for r in metrics.drift_report(metrics.stability_index(old, new, ["a", "b", "c"]), 0.1, 0.25).collect()}
    assert got["a"].status == "critical" and got["b"].psi == 0.0 and got["c"].psi == float("inf")


def test_findings_treat_unknown_as_broken(rows):
    measures = rows("days int, missing int", (3, None))
    rules = [
        audits.Rule("ERROR", "a", "days < 5", "{days} days"),
        audits.Rule("ERROR", "b", "days < 2", "no"),
        audits.Rule("WARNING", "c", "missing > 0", "{missing}"),
    ]
    got = {(r.check, r.message) for r in audits.findings(measures, rules).collect()}
    assert got == {("a", "3 days"), ("c", "null")}


def test_evenly_spaced(rows):
    frame = rows("k string, d date, id long", *[("x", DAY + timedelta(days=i // 40), i) for i in range(100)])
    ids = sorted(r.id for r in sampling.evenly_spaced(frame, "k", "d", "id", 15).collect())
    assert len(ids) == 15 and ids[0] == 0 and ids[-1] == 99
    assert ids == sorted({round(i * 99 / 14) for i in range(15)})
    assert sampling.evenly_spaced(frame, "k", "d", "id", 500).count() == 100


def test_group_never_spans_two_partitions(rows):
    rng = random.Random(2)
    data = [(i, DAY + timedelta(days=i % 30), f"g{rng.randrange(25)}" if i % 9 == 0 else "") for i in range(270)]
    out = sampling.split_by_group_and_date(rows("id int, d date, g string", *data), "d", "g", 0.5, 0.2)
    got = out.collect()
    assert len(got) == len(data)
    for key in ("d", "g"):
        seen = {}
        for r in got:
            if r[key]:
                seen.setdefault(r[key], set()).add(r.partition)
        assert all(len(parts) == 1 for parts in seen.values())


def test_components_of_a_chain(rows):
    chain = rows("a int, b int", *[(i, i + 1) for i in range(30)], (100, 101))
    nodes = rows("node int", *[(i,) for i in range(31)], (100,), (101,), (200,))
    got = {r.node: r.component for r in sampling.components(chain, nodes).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[101] == 100 and got[200] == 200


def test_downsampling_keeps_positives_and_the_limit(rows):
    frame = rows("g string, y int, o int", *[("a", int(i < 3), i) for i in range(100)], ("b", 0, 1))
    out = sampling.downsample_negatives(frame, ["g"], "y", "o", least=2, times_positive=4)
    got = out.collect()
    assert sum(r.y for r in got) == 3
    assert sum(r.y == 0 and r.g == "a" for r in got) == 12
    assert sum(r.g == "b" for r in got) == 1


def test_missing_and_broken_tables_are_findings(spark, rows):
    """Land and confirmation audits: absent tables, wrong sources, old confirmations, thin truth."""
    from terravane.plans.quality import CONFIRMATION_RULES, LAND_RULES

    now = F.lit("2024-01-03 00:00:00").cast("timestamp")
    none = audits.confirmation_measures(spark, None, "p", None, None, "at", now, None)
    assert {r.check for r in audits.findings(none, CONFIRMATION_RULES).collect()} == {rule.check for rule in CONFIRMATION_RULES}
    places = rows("p int, at string", *[(i, "2024-01-02 12:00:00") for i in range(60)])
    good = audits.confirmation_measures(spark, places, "p", places, places, "at", now, places)
    assert audits.findings(good, CONFIRMATION_RULES).count() == 0
    old = audits.confirmation_measures(spark, places, "p", places, places.withColumn("at", F.lit("2023-12-30")), "at", now, places)
    assert [r.check for r in audits.findings(old, CONFIRMATION_RULES).collect()] == ["confirmation.freshness"]

    kind = "p int, source string, slope double, samples int, dominant string"
    land = rows(kind, *[(i, "model SRC", 1.0, 5, "wood") for i in range(25)])
    measure = lambda terrain, cover: audits.findings(
        audits.land_measures(spark, terrain, cover, "p", "source", ("SRC", "SRC"), "slope", "samples", "dominant"), LAND_RULES
    )
    assert measure(land, land).count() == 0
    holed = land.withColumn("slope", F.when(F.col("p") > 0, F.col("slope"))).withColumn("samples", F.when(F.col("p") > 1, 5).otherwise(0))
    assert {r.check: r.message for r in measure(holed, holed).collect()} == {
        "land.terrain": "25 of 25 places, 0 rows without source, 1 without slope",
        "land.cover": "25 of 25 places, 0 rows without source, 2 without samples, 0 without class",
    }
    assert {r.check for r in measure(None, land).collect()} == {"land.terrain"}

    units = rows("unit string, schema string", ("a", "struct<unit:string,rain:double>"), ("b", "struct<rainfall:double>"), ("c", None))
    assert tuple(audits.partition_measures(units, "unit", "schema", ["rain"]).first()) == (3, 1)
    events = rows("k string, s string, g string", ("flood", "x", "1"), ("flood", "x", " 1 "), ("flood", "y", " "), ("flood", "y", None))
    found = audits.truth_findings(events, "k", {"flood": "ERROR", "storm": "WARNING"}, "s", "g", 3, 2)
    assert {(r.severity, r.check, r.message) for r in found.collect()} == {
        ("WARNING", "ground_truth.flood_diversity", "found 1 of 2"), ("WARNING", "ground_truth.storm", "found 0 of 3"),
        ("WARNING", "ground_truth.storm_diversity", "found 0 of 2"),
    }
