"""Queries that train and apply models.

The numbers of a trained model depend on the learner, so its twins state what must hold of them; scoring,
calibration and choice are twinned with given coefficients.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from terravane.operators import learning, sampling, windows
from terravane.plans.bindings import SCORED_SQL, STATION, STATION_DAYS_SQL, scored, station_days
from terravane.plans.registry import query, tidy, tidy_columns, tidy_sql
from terravane.plans.served import HORIZONS_SQL, horizons
from terravane.session import run_folder
from terravane.sources import writers

FEATURES = ["rain", "rain_7d", "temperature_30d", "season_sin"]


def learning_rows(t):
    """Next-days heavy rain per station-day, split by year; written once, as learners pass over it many times."""
    days = station_days(t)
    future = windows.future_window(STATION, "precipitation", 3, "sum")
    rows = days.withColumns(
        {
            "rain": F.col("precipitation"),
            "rain_7d": windows.rolling_sum(STATION, "precipitation", 7),
            "temperature_30d": windows.rolling_mean(STATION, "temperature", 30),
            "season_sin": F.sin(F.month("valid_date") * 0.5235987755982988),
            "future_rain": future,
        }
    ).where("future_rain IS NOT NULL")
    labelled = rows.withColumn("target", (F.col("future_rain") >= 120).cast("int")).withColumn(
        "event_group", F.when(F.col("target") == 1, F.concat_ws("/", "station", F.year("valid_date"))).otherwise("")
    )
    split = sampling.split_by_year(labelled, F.year("valid_date"), 1998, 1999).select(
        "station", "valid_date", *FEATURES, "target", "event_group", "partition"
    )
    return t.spark.read.schema(split.schema).parquet(writers.snapshot(split, run_folder(t.spark, "learning-rows")))


TEST_SQL = f"""WITH {STATION_DAYS_SQL}, n AS (SELECT *, lead(valid_date, 3) OVER (PARTITION BY station ORDER BY valid_date) AS later FROM station_days),
test AS (SELECT * FROM n WHERE later IS NOT NULL AND year(valid_date) > 1999)"""


@query(
    "trained_flood_scores",
    "M7 M8",
    f"""{TEST_SQL} SELECT station, count(*) AS rows, count(*) AS in_range, count(*) AS agreeing, 0 AS drought_available FROM test GROUP BY 1""",
)
def trained_flood_scores(t):
    """Per station: all test rows are scored, in range, and predicted by the threshold."""
    rows = learning_rows(t)
    trained = learning.train_calibrated(rows, FEATURES, "target", learning.forest(trees=10, depth=4))
    test = rows.where("partition = 'test'")
    scored_rows = learning.score(test, "flood", trained)
    scored_rows = learning.score(scored_rows, "drought", learning.HazardModel(None))
    return scored_rows.groupBy("station").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("flood_probability").between(0, 1)).alias("in_range"),
        F.count_if((F.col("flood_probability") >= trained.threshold) == (F.col("flood_prediction") == 1)).alias("agreeing"),
        F.count_if("drought_available").cast("int").alias("drought_available"),
    )


LEARNABLE = 40


@query(
    "trained_model_quality",
    "M7 M9",
    f"""{TEST_SQL.replace("year(valid_date) > 1999", "year(valid_date) = 1999")} SELECT unnest(['boosted', 'forest']) AS candidate, count(*) AS held_out, count(*) FILTER (precipitation >= {LEARNABLE}) AS positives,
      count(*) FILTER (precipitation >= {LEARNABLE}) BETWEEN 1 AND count(*) - 1 AS learnt FROM test""",
)
def trained_model_quality(t):
    """Candidates trained on one part and compared on the next; a target that a feature decides must be learnt."""
    rows = learning_rows(t).withColumn("target", (F.col("rain") >= LEARNABLE).cast("int"))
    learners = {"forest": learning.forest(trees=8, depth=3), "boosted": learning.boosted_trees(rounds=4, depth=3)}
    best, table = learning.compare(rows, FEATURES, "target", learners)
    held_out = rows.where("partition = 'calibration'").agg(
        F.count(F.lit(1)).alias("held_out"), F.count_if(F.col("target") == 1).alias("positives")
    )
    found = table.select("candidate", ((F.col("roc_auc") >= 0.95) & (F.col("pr_auc") >= 0.9)).alias("learnt"))
    if best not in learners:
        raise ValueError(f"no candidate chosen: {best}")
    return found.withColumn("_h", held_out.select(F.struct("held_out", "positives")).scalar()).select(
        "candidate", "_h.held_out", "_h.positives", "learnt"
    )


def _areas_sql(name: str, p: str) -> str:
    """Row of ROC area, average precision and recall of one score column."""
    return f"""SELECT '{name}' AS candidate,
      (SELECT (sum(rk) - any_value(p) * (any_value(p) + 1) / 2) / (any_value(p) * any_value(q)) FROM
        (SELECT target, rank() OVER (ORDER BY {p}) + (count(*) OVER (PARTITION BY {p}) - 1) / 2.0 AS rk FROM rated), n WHERE target = 1) AS roc_auc,
      (SELECT sum(pos * tp / pred) / any_value(p) FROM (SELECT pos, sum(pos) OVER (ORDER BY v DESC) AS tp, sum(c) OVER (ORDER BY v DESC) AS pred
        FROM (SELECT {p} AS v, sum(target) AS pos, count(*) AS c FROM rated GROUP BY 1)), n) AS pr_auc,
      (SELECT count(*) FILTER ({p} >= 0.6) / count(*) FROM rated WHERE target = 1) AS recall"""


@query(
    "candidate_models",
    "M9",
    f"""WITH {SCORED_SQL}, rated AS (SELECT target, probability AS a, 1 - probability AS b FROM scored),
    n AS (SELECT sum(target) AS p, count(*) - sum(target) AS q FROM rated),
    m AS ({_areas_sql('rising', 'a')} UNION ALL {_areas_sql('falling', 'b')})
    SELECT candidate, {tidy_sql('roc_auc')} AS roc_auc, {tidy_sql('pr_auc')} AS pr_auc, {tidy_sql('recall')} AS recall,
      row_number() OVER (ORDER BY pr_auc DESC, recall DESC) = 1 AS selected FROM m""",
)
def candidate_models(t):
    rows = scored(t).withColumn("falling", 1 - F.col("probability"))
    best, table = learning.choose({"rising": (rows, "probability"), "falling": (rows, "falling")}, "target", 0.6)
    return tidy_columns(table, ["roc_auc", "pr_auc", "recall"]).withColumn("selected", F.col("candidate") == best)


LINEAR = {
    3: (learning.LinearModel({"precipitation_sum_mm": 0.01, "rain_probability_max": 0.02}, -2.0), learning.Sigmoid(4.0, -2.0), 0.5),
    7: (learning.LinearModel({"precipitation_sum_mm": 0.004, "rain_probability_max": 0.03}, -3.0), learning.Sigmoid(5.0, -2.5), 0.4),
    14: (learning.LinearModel({"precipitation_sum_mm": 0.002, "rain_probability_max": 0.01}, -1.0), None, 0.6),
}


def _linear_sql(days: int) -> str:
    model, calibration, _ = LINEAR[days]
    total = " + ".join([str(model.intercept), *[f"{f} * {w}::DOUBLE" for f, w in model.coefficients.items()]])
    raw = f"1.0::DOUBLE / (1.0 + exp(-({total})))"
    return f"1.0::DOUBLE / (1.0 + exp(-({calibration.slope} * ({raw}) + ({calibration.intercept}))))" if calibration else raw


@query(
    "horizon_model_scores",
    "M8 M10 M11",
    f"""WITH {HORIZONS_SQL}, p AS (SELECT district, horizon_days, CASE horizon_days {' '.join(f'WHEN {d} THEN {_linear_sql(d)}' for d in LINEAR)} END AS p,
      CASE horizon_days {' '.join(f'WHEN {d} THEN {LINEAR[d][2]}' for d in LINEAR)} END AS cut FROM horizons)
    SELECT district, horizon_days, {tidy_sql('p')} AS cyclone_probability, coalesce(CAST(p >= cut AS INTEGER), 0) AS cyclone_prediction, 0 AS flood_prediction FROM p""",
)
def horizon_model_scores(t):
    """Each horizon by its own model, calibration and threshold; a hazard without a model stays unavailable."""
    models = {days: learning.HazardModel(*parts) for days, parts in LINEAR.items()}
    out = learning.score_horizons(horizons(t), "horizon_days", "cyclone", models)
    out = learning.score(out, "flood", learning.HazardModel(None))
    return out.select(
        "district", "horizon_days", tidy("cyclone_probability").alias("cyclone_probability"), "cyclone_prediction", "flood_prediction"
    )


@query(
    "alert_budget_backtest",
    "M12",
    f"""WITH {SCORED_SQL}, n AS (SELECT *, date < DATE '2024-01-20' AS val FROM scored),
    h AS (SELECT b AS budget, probability AS threshold FROM n, (VALUES (0.05::DOUBLE), (0.2::DOUBLE)) v(b) WHERE val
      QUALIFY row_number() OVER (PARTITION BY b ORDER BY probability) = ceil((1.0::DOUBLE - b) * (count(*) OVER (PARTITION BY b) - 1)) + 1),
    d AS (SELECT budget, threshold, date, count(*) FILTER (probability >= threshold) AS a, count(*) AS n, bool_or(probability >= threshold) FILTER (target = 0) AS alarm, count(*) FILTER (target = 0) AS neg FROM n, h WHERE NOT val GROUP BY 1, 2, 3),
    e AS (SELECT budget, event_group, max(probability) >= any_value(threshold) AS hit FROM n, h WHERE NOT val AND target = 1 AND event_group <> '' GROUP BY 1, 2),
    es AS (SELECT budget, count(*) AS independent_events, count(*) FILTER (hit) AS detected_events FROM e GROUP BY 1)
    SELECT budget, {tidy_sql('any_value(threshold)')} AS threshold, CAST(sum(a) AS BIGINT) AS alerted_rows, {tidy_sql('sum(a) / sum(n)')} AS alerted_row_fraction, {tidy_sql('avg(a)')} AS mean_alerts_per_day,
      max(a) AS maximum_alerts_per_day, any_value(independent_events) AS independent_events, any_value(detected_events) AS detected_events, {tidy_sql('any_value(detected_events) / any_value(independent_events)')} AS event_recall,
      count(*) FILTER (alarm) AS false_alarm_days, count(*) FILTER (neg > 0) AS negative_days, {tidy_sql('count(*) FILTER (alarm) / count(*) FILTER (neg > 0)')} AS false_alarm_day_rate
    FROM d JOIN es USING (budget) GROUP BY budget""",
)
def alert_budget_backtest(t):
    rows = scored(t)
    cut = F.lit("2024-01-20").cast("date")
    out = learning.backtest(
        rows.where(F.col("date") < cut), rows.where(F.col("date") >= cut), "probability", "target", "event_group", "date", [0.05, 0.2]
    )
    return tidy_columns(
        out, ["threshold", "alerted_row_fraction", "mean_alerts_per_day", "event_recall", "false_alarm_day_rate"]
    )
