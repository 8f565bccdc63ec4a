"""Queries on evaluation, drift, audits, sampling and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravane.operators import audits, metrics, sampling
from terravane.operators.audits import Rule
from terravane.plans.bindings import (
    CELL_DAYS_SQL,
    READINGS_SQL,
    SCORED_SQL,
    STATION_DAYS_SQL,
    VERIFIED_EVENTS_SQL,
    cell_days,
    readings,
    scored,
    station_days,
    verified_events,
)
from terravane.plans.registry import query, tidy, tidy_columns, tidy_sql
from terravane.plans.served import ASSESSMENT_SQL, RISK_SQL, assessment, risk_rows
from terravane.plans.texts import CANONICAL_SQL, RAW_SQL, canonical, raw_rows


@query(
    "classification_report",
    "A18",
    f"""WITH {SCORED_SQL}, c AS (SELECT count(*) FILTER (probability < 0.7 AND target = 0) AS tn, count(*) FILTER (probability >= 0.7 AND target = 0) AS fp,
      count(*) FILTER (probability < 0.7 AND target = 1) AS fn, count(*) FILTER (probability >= 0.7 AND target = 1) AS tp FROM scored)
    SELECT tn AS true_negative, fp AS false_positive, fn AS false_negative, tp AS true_positive, {tidy_sql('(tp + tn) / (tn + fp + fn + tp)')} AS accuracy,
      {tidy_sql('(tp / (tp + fn) + tn / (tn + fp)) / 2')} AS balanced_accuracy, {tidy_sql('tp / (tp + fp)')} AS precision, {tidy_sql('tp / (tp + fn)')} AS recall,
      {tidy_sql('2 * tp / (2 * tp + fp + fn)')} AS f1 FROM c""",
)
def classification_report(t):
    out = metrics.confusion(scored(t), "probability", "target", 0.7)
    return tidy_columns(out, ["accuracy", "balanced_accuracy", "precision", "recall", "f1"])


@query(
    "curve_areas",
    "A19",
    f"""WITH {SCORED_SQL}, r AS (SELECT probability, target, rank() OVER (ORDER BY probability) + (count(*) OVER (PARTITION BY probability) - 1) / 2.0 AS rk FROM scored),
    n AS (SELECT sum(target) AS p, count(*) - sum(target) AS q FROM scored),
    d AS (SELECT probability, sum(target) AS pos, count(*) AS c FROM scored GROUP BY 1),
    w AS (SELECT pos, sum(pos) OVER (ORDER BY probability DESC) AS tp, sum(c) OVER (ORDER BY probability DESC) AS pred FROM d)
    SELECT {tidy_sql('(SELECT (sum(rk) - any_value(p) * (any_value(p) + 1) / 2) / (any_value(p) * any_value(q)) FROM r, n WHERE target = 1)')} AS roc_auc,
      {tidy_sql('(SELECT sum(pos * tp / pred) / any_value(p) FROM w, n)')} AS pr_auc""",
)
def curve_areas(t):
    return tidy_columns(metrics.curve_areas(scored(t), "probability", "target"), ["roc_auc", "pr_auc"])


@query(
    "event_detection",
    "A20",
    f"""WITH {SCORED_SQL}, e AS (SELECT event_group, max(probability) AS b FROM scored WHERE target = 1 AND event_group <> '' GROUP BY 1),
    d AS (SELECT date, bool_or(probability >= 0.75) AS a FROM scored WHERE target = 0 GROUP BY 1)
    SELECT (SELECT count(*) FROM e) AS independent_events, (SELECT count(*) FROM e WHERE b >= 0.75) AS detected_events,
      {tidy_sql('(SELECT count(*) FILTER (b >= 0.75) / count(*) FROM e)')} AS event_recall, (SELECT count(*) FROM d WHERE a) AS false_alarm_days,
      (SELECT count(*) FROM d) AS negative_days, {tidy_sql('(SELECT count(*) FILTER (a) / count(*) FROM d)')} AS false_alarm_day_rate""",
)
def event_detection(t):
    out = metrics.event_metrics(scored(t), "probability", "target", "event_group", "date", 0.75)
    return tidy_columns(out, ["event_recall", "false_alarm_day_rate"])


@query(
    "daily_rank_fractions",
    "W11",
    f"""WITH {SCORED_SQL} SELECT doc_id, {tidy_sql('rank() OVER (PARTITION BY date ORDER BY probability DESC) / count(*) OVER (PARTITION BY date)')} AS rank_fraction FROM scored""",
)
def daily_rank_fractions(t):
    from terravane.operators import ranking

    out = ranking.rank_fraction(scored(t), "probability", ["date"], "rank_fraction")
    return out.select("doc_id", tidy("rank_fraction").alias("rank_fraction"))


@query(
    "event_ranking",
    "A21",
    f"""WITH {SCORED_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY probability DESC) / count(*) OVER (PARTITION BY date) AS f FROM scored),
    e AS (SELECT event_group, min(f) AS b FROM r WHERE target = 1 AND event_group <> '' GROUP BY 1)
    SELECT count(*) AS independent_events, budget::DOUBLE AS budget, count(*) FILTER (b <= budget) AS detected_events, {tidy_sql('count(*) FILTER (b <= budget) / count(*)')} AS event_recall,
      {tidy_sql('median(b)')} AS median_best_rank FROM e, (VALUES (0.05::DOUBLE), (0.2::DOUBLE), (0.5::DOUBLE)) v(budget) GROUP BY budget""",
)
def event_ranking(t):
    ranks = metrics.event_ranks(scored(t), "probability", "target", "event_group", "date")
    out = metrics.event_ranking(ranks, [0.05, 0.2, 0.5])
    return tidy_columns(out, ["event_recall", "median_best_rank"])


@query(
    "alert_burden",
    "A22",
    f"""WITH {SCORED_SQL}, h AS (SELECT probability AS threshold FROM scored QUALIFY row_number() OVER (ORDER BY probability) = ceil(0.9::DOUBLE * (count(*) OVER () - 1)) + 1),
    d AS (SELECT date, count(*) FILTER (probability >= threshold) AS a, count(*) AS n FROM scored, h GROUP BY 1)
    SELECT {tidy_sql('(SELECT threshold FROM h)')} AS threshold, CAST(sum(a) AS BIGINT) AS alerted_rows, {tidy_sql('sum(a) / sum(n)')} AS alerted_row_fraction,
      {tidy_sql('avg(a)')} AS mean_alerts_per_day, max(a) AS maximum_alerts_per_day FROM d""",
)
def alert_burden(t):
    rows = scored(t)
    threshold = metrics.alert_threshold(rows, "probability", 0.1)
    out = metrics.alert_burden(rows, "probability", "date", threshold.scalar())
    out = out.withColumn("threshold", threshold.scalar())
    return tidy_columns(out, ["threshold", "alerted_row_fraction", "mean_alerts_per_day"])


@query(
    "probability_diagnostics",
    "A23",
    f"""WITH {SCORED_SQL}, q AS (SELECT list_sort(list_distinct(quantile_cont(probability, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e FROM scored),
    b AS (SELECT probability AS p, target AS y, len(list_filter(e[2:-2], lambda x: x <= probability)) AS bin FROM scored, q),
    g AS (SELECT bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM b GROUP BY 1),
    s AS (SELECT count(*) AS n, avg(y) AS prev, avg(p) AS mp, avg(pow(p - y, 2)) AS brier, avg(pow(y - (SELECT avg(target) FROM scored), 2)) AS clim FROM b)
    SELECT s.n AS rows, {tidy_sql('prev')} AS positive_prevalence, {tidy_sql('s.mp')} AS mean_score, {tidy_sql('brier')} AS brier_score, {tidy_sql('clim')} AS climatology_brier_score,
      {tidy_sql('1 - brier / clim')} AS brier_skill_score, {tidy_sql('(SELECT sum(g.n * abs(g.mp - my)) FROM g) / s.n')} AS expected_calibration_error, (SELECT count(*) FROM g) AS populated_bins FROM s""",
)
def probability_diagnostics(t):
    out = metrics.probability_diagnostics(scored(t), "probability", "target")
    return tidy_columns(out, [c for c in out.columns if c not in ("rows", "populated_bins")])


SWEEP = [i / 100 for i in range(10, 91)]
_SWEEP_SQL = "(SELECT i / 100.0::DOUBLE AS threshold FROM range(10, 91) r(i))"


@query(
    "best_f1_threshold",
    "A24",
    f"""WITH {SCORED_SQL}, c AS (SELECT threshold, count(*) FILTER (probability >= threshold AND target = 1) AS tp, count(*) FILTER (probability >= threshold) AS pred, count(*) FILTER (target = 1) AS p
      FROM scored, {_SWEEP_SQL} GROUP BY 1)
    SELECT threshold, {tidy_sql('2 * tp / (pred + p)')} AS f1 FROM c ORDER BY round(2 * tp / (pred + p), 12) DESC, threshold LIMIT 1""",
)
def best_f1_threshold(t):
    return tidy_columns(metrics.best_f1_threshold(scored(t), "probability", "target", SWEEP), ["f1"])


@query(
    "operating_threshold",
    "A25",
    f"""WITH {SCORED_SQL}, th AS (SELECT DISTINCT unnest(list_concat([0.2::DOUBLE, 0.35::DOUBLE], quantile_cont(probability, {[i / 20 for i in range(21)]}))) AS threshold FROM scored),
    c AS (SELECT threshold, count(*) FILTER (probability >= threshold AND target = 1) AS tp, count(*) FILTER (probability >= threshold) AS pred, count(*) FILTER (target = 1) AS p FROM scored, th GROUP BY 1),
    m AS (SELECT threshold, coalesce(tp / nullif(pred, 0), 0) AS precision, tp / p AS recall FROM c),
    f AS (SELECT *, precision >= 0.12 AND recall >= 0.4 AS feasible, coalesce(5 * precision * recall / nullif(4 * precision + recall, 0), 0) AS f2 FROM m)
    SELECT {tidy_sql('threshold')} AS threshold, {tidy_sql('precision')} AS precision, {tidy_sql('recall')} AS recall, {tidy_sql('f2')} AS f2, CAST(feasible AS INTEGER) AS feasible
    FROM f ORDER BY feasible DESC, round(f2, 12) DESC, round(recall, 12) DESC, round(precision, 12) DESC, threshold LIMIT 1""",
)
def operating_threshold(t):
    out = metrics.operating_threshold(scored(t), "probability", "target", [0.2, 0.35], 20, 0.12, 0.4)
    out = tidy_columns(out, ["threshold", "precision", "recall", "f2"])
    return out.withColumn("feasible", F.col("feasible").cast("int"))


DRIFT_FEATURES = ["precipitation", "temperature", "wind_speed", "steady"]


def _psi_sql(f: str) -> str:
    return f"""(SELECT '{f}' AS feature, CASE WHEN len(e) < 3 THEN 0 ELSE (SELECT sum((nw - ol) * ln(nw / ol)) FROM (
      SELECT greatest(count(*) FILTER (side = 0) / (SELECT count(*) FROM d WHERE side = 0), 1e-6) AS ol, greatest(count(*) FILTER (side = 1) / (SELECT count(*) FROM d WHERE side = 1), 1e-6) AS nw
      FROM d GROUP BY len(list_filter(e[2:-2], lambda x: x < {f})))) END AS psi
      FROM (SELECT list_sort(list_distinct(quantile_cont({f}, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e FROM d WHERE side = 0))"""


@query(
    "feature_drift",
    "A26",
    f"""WITH {CELL_DAYS_SQL}, d AS (SELECT precipitation, temperature, wind_speed, 1.0::DOUBLE AS steady, CAST(valid_date >= DATE '2024-01-20' AS INTEGER) AS side FROM cell_days),
    p AS ({' UNION ALL '.join(_psi_sql(f) for f in DRIFT_FEATURES)})
    SELECT feature, {tidy_sql('psi')} AS psi, CASE WHEN psi >= 0.05 THEN 'critical' WHEN psi >= 0.01 THEN 'warning' ELSE 'stable' END AS status FROM p""",
)
def feature_drift(t):
    days = cell_days(t).withColumn("steady", F.lit(1.0))
    cut = F.lit("2024-01-20").cast("date")
    index = metrics.stability_index(
        days.where(F.col("valid_date") < cut), days.where(F.col("valid_date") >= cut), DRIFT_FEATURES
    )
    return tidy_columns(metrics.drift_report(index, 0.01, 0.05), ["psi"])


@query(
    "quality_gate",
    "A27",
    f"""WITH {SCORED_SQL} SELECT 'ERROR' AS severity, 'quality.' || name AS "check", {tidy_sql('value')} AS value, minimum FROM (
      SELECT 'mean' AS name, (SELECT avg(probability) FROM scored) AS value, 0.9::DOUBLE AS minimum UNION ALL SELECT 'prevalence', (SELECT avg(target) FROM scored), 0.05
      UNION ALL SELECT 'absent', NULL, 0.5) WHERE value IS NULL OR value < minimum""",
)
def quality_gate(t):
    values = scored(t).agg(F.avg("probability").alias("mean"), F.avg("target").alias("prevalence"))
    rows = values.unpivot([], ["mean", "prevalence"], "name", "value")
    return tidy_columns(metrics.quality_gate(rows, {"mean": 0.9, "prevalence": 0.05, "absent": 0.5}), ["value"])


def training_rows(t):
    days = cell_days(t)
    return days.withColumns(
        {
            "humidity": F.when(F.col("temperature") > 5, F.col("temperature")),
            "label_method": F.when(F.col("precipitation") > 40, "verified").otherwise("proxy"),
            "flood_risk": (F.col("precipitation") > 400).cast("int"),
        }
    )


LABEL_METHODS = ("proxy", "verified")
TRAINING_RULES = [
    Rule("ERROR", "training.history", "days < 40", "{days} distinct days, 40 wanted"),
    Rule("ERROR", "training.geography", "outside_rows > 0", "{outside_rows} rows outside the region"),
    Rule("ERROR", "training.completeness", "null_features > 0", "{null_features} null features"),
    Rule("WARNING", "training.labels", "methods <> 'verified'", "label methods: {methods}"),
    Rule("ERROR", "training.positives", "flood_risk_positive < 1", "{flood_risk_positive} positive rows"),
]


@query(
    "training_audit",
    "A28 M6",
    f"""WITH {CELL_DAYS_SQL}, m AS (SELECT count(DISTINCT valid_date) AS days, count(*) FILTER (NOT (latitude BETWEEN -45 AND 60)) AS outside_rows,
      count(*) FILTER (temperature <= 5) AS null_features, string_agg(DISTINCT CASE WHEN precipitation > 40 THEN 'verified' ELSE 'proxy' END, ',' ORDER BY CASE WHEN precipitation > 40 THEN 'verified' ELSE 'proxy' END) AS methods,
      count(*) FILTER (precipitation > 400) AS pos FROM cell_days)
    SELECT * FROM (SELECT 'ERROR' AS severity, 'training.history' AS "check", days || ' distinct days, 40 wanted' AS message FROM m WHERE days < 40
      UNION ALL SELECT 'ERROR', 'training.geography', outside_rows || ' rows outside the region' FROM m WHERE outside_rows > 0
      UNION ALL SELECT 'ERROR', 'training.completeness', null_features || ' null features' FROM m WHERE null_features > 0
      UNION ALL SELECT 'WARNING', 'training.labels', 'label methods: ' || methods FROM m WHERE methods <> 'verified'
      UNION ALL SELECT 'ERROR', 'training.positives', pos || ' positive rows' FROM m WHERE pos < 1)""",
)
def training_audit(t):
    rows = training_rows(t)
    measures = audits.training_measures(
        rows, "valid_date", F.col("latitude").between(-45, 60), ["precipitation", "humidity"],
        "label_method", LABEL_METHODS, ["flood_risk"]
    )
    return audits.findings(measures, TRAINING_RULES)


@query(
    "operational_audit",
    "A29 R9",
    f"""WITH {ASSESSMENT_SQL}, m AS (SELECT count(*) AS rows, count(DISTINCT district) AS places, count(*) - count(DISTINCT district_id) AS repeated_ids,
      (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(collected_at))) / 3.6e9 AS age_hours, count(rain_p95) / count(*) AS rain_p95_coverage FROM assessment)
    SELECT 'ERROR' AS severity, 'assessment.ids' AS "check", repeated_ids || ' repeated ids' AS message FROM m WHERE repeated_ids > 0
    UNION ALL SELECT 'WARNING', 'assessment.factors', 'factor coverage is low' FROM m WHERE rain_p95_coverage < 0.9
    UNION ALL SELECT 'ERROR', 'assessment.freshness', 'older than 12 hours' FROM m WHERE age_hours > 12""",
)
def operational_audit(t):
    measures = audits.operational_measures(
        assessment(t), ["district"], "horizon_days", (3, 7, 14), "district_id", "collected_at",
        F.lit("2024-02-01 00:00:00").cast("timestamp"), ["rain_p95"],
    )
    rules = [
        Rule("ERROR", "assessment.ids", "repeated_ids > 0", "{repeated_ids} repeated ids"),
        Rule("ERROR", "assessment.horizons", "horizons <> '3,7,14'", "horizons {horizons}"),
        Rule("WARNING", "assessment.factors", "rain_p95_coverage < 0.9", "factor coverage is low"),
        Rule("ERROR", "assessment.freshness", "age_hours > 12", "older than 12 hours"),
    ]
    return audits.findings(measures, rules)


@query(
    "source_diversity_audit",
    "A30",
    f"""WITH {VERIFIED_EVENTS_SQL} SELECT source, count(*) AS rows, count(DISTINCT year(event_date)) AS years, count(DISTINCT source_event_id) AS independent_events FROM verified_events GROUP BY 1""",
)
def source_diversity_audit(t):
    return audits.source_measures(verified_events(t), "source", F.year("event_date"), F.col("source_event_id"))


CONFIRMATION_RULES = [
    Rule("ERROR", "validation.rain_places", "checked_places < 60", "cross-check covers {checked_places} of 60 places"),
    Rule("ERROR", "history.episodes", "episodes < 1", "no episodes"),
    Rule("ERROR", "confirmation.freshness", "confirmation_age_hours > 24", "confirmation is too old"),
    Rule("ERROR", "history.provenance", "provenance_rows < 1", "provenance is missing"),
]


@query(
    "confirmation_findings",
    "A30",
    f"""WITH {READINGS_SQL}, m AS (SELECT (SELECT count(DISTINCT user_id) FROM readings WHERE event_type = 'error') AS places, (SELECT count(*) FROM readings WHERE value < 1) AS episodes,
      (SELECT (epoch_us(TIMESTAMP '2024-02-02') - epoch_us(max(ts))) / 3.6e9 FROM events) AS age)
    SELECT 'ERROR' AS severity, 'validation.rain_places' AS "check", 'cross-check covers ' || places || ' of 60 places' AS message FROM m WHERE places < 60
    UNION ALL SELECT 'ERROR', 'history.episodes', 'no episodes' FROM m WHERE episodes < 1
    UNION ALL SELECT 'ERROR', 'confirmation.freshness', 'confirmation is too old' FROM m WHERE age > 24
    UNION ALL SELECT 'ERROR', 'history.provenance', 'provenance is missing'""",
)
def confirmation_findings(t):
    r = readings(t)
    measures = audits.confirmation_measures(
        t.spark, r.where("event_type = 'error'"), "user_id", r.where("value < 1"), t.events, "ts",
        F.lit("2024-02-02 00:00:00").cast("timestamp"), None,
    )
    return audits.findings(measures, CONFIRMATION_RULES)


LAND_RULES = [
    Rule(
        "ERROR", "land.terrain",
        "terrain_places < 25 OR terrain_unsourced > 0 OR terrain_without_slope > 0",
        "{terrain_places} of 25 places, {terrain_unsourced} rows without source, {terrain_without_slope} without slope",
    ),
    Rule(
        "ERROR", "land.cover",
        "cover_places < 25 OR cover_unsourced > 0 OR cover_without_samples > 0 OR cover_without_class > 0",
        "{cover_places} of 25 places, {cover_unsourced} rows without source, {cover_without_samples} without samples, {cover_without_class} without class",
    ),
]


@query(
    "land_findings",
    "A30",
    """WITH m AS (SELECT (SELECT count(DISTINCT s_nationkey) FROM supplier) AS tp, (SELECT count(*) FILTER (s_name NOT LIKE '%Supplier%') FROM supplier) AS tu, (SELECT count(*) FILTER (s_acctbal IS NULL) FROM supplier) AS ts,
      (SELECT count(DISTINCT c_nationkey) FROM customer) AS cp, (SELECT count(*) FILTER (c_mktsegment NOT LIKE '%B%') FROM customer) AS cu, (SELECT count(*) FILTER (c_acctbal <= 0) FROM customer) AS cs)
    SELECT 'ERROR' AS severity, 'land.terrain' AS "check", tp || ' of 25 places, ' || tu || ' rows without source, ' || ts || ' without slope' AS message FROM m WHERE tp < 25 OR tu > 0 OR ts > 0
    UNION ALL SELECT 'ERROR', 'land.cover', cp || ' of 25 places, ' || cu || ' rows without source, ' || cs || ' without samples, 0 without class' FROM m WHERE cp < 25 OR cu > 0 OR cs > 0""",
)
def land_findings(t):
    terrain = t.supplier.select(F.col("s_nationkey").alias("place"), F.col("s_name").alias("source"), F.col("s_acctbal").alias("slope"))
    cover = t.customer.select(
        F.col("c_nationkey").alias("place"), F.col("c_mktsegment").alias("source"), F.col("c_acctbal").alias("samples"), F.col("c_name").alias("dominant")
    )
    measures = audits.land_measures(t.spark, terrain, cover, "place", "source", ("Supplier", "B"), "slope", "samples", "dominant")
    return audits.findings(measures, LAND_RULES)


@query(
    "partition_schema_findings",
    "A30",
    """WITH u AS (SELECT DISTINCT CAST(ts AS DATE) AS unit FROM events), m AS (SELECT count(*) AS n, count(*) FILTER (day(unit) % 3 <> 0) AS complete FROM u)
    SELECT 'ERROR' AS severity, 'sources.partitions' AS "check", complete || ' of ' || n || ' partitions are complete' AS message FROM m WHERE complete < n""",
)
def partition_schema_findings(t):
    """Every third day's partition was written without its soil column."""
    day = F.to_date("ts")
    shape = F.when(F.dayofmonth(day) % 3 == 0, "struct<unit:date,rain:double,soil_depth:double>").otherwise(
        "struct<unit:date,rain:double,soil:double>"
    )
    ledger = t.events.select(day.alias("unit"), shape.alias("schema"))
    rule = Rule(
        "ERROR", "sources.partitions", "complete_partitions < partitions", "{complete_partitions} of {partitions} partitions are complete"
    )
    return audits.findings(audits.partition_measures(ledger, "unit", "schema", ["rain", "soil"]), [rule])


@query(
    "ground_truth_findings",
    "A30",
    f"""WITH {VERIFIED_EVENTS_SQL}, w AS (SELECT unnest(['flood', 'drought', 'cyclone']) AS kind, unnest(['ERROR', 'WARNING', 'ERROR']) AS severity),
    c AS (SELECT hazard_type AS kind, count(*) AS n, count(DISTINCT source || '/' || source_event_id) AS g FROM verified_events GROUP BY 1), j AS (SELECT w.kind, severity, coalesce(n, 0) AS n, coalesce(g, 0) AS g FROM w LEFT JOIN c USING (kind))
    SELECT severity, 'ground_truth.' || kind AS "check", 'found ' || n || ' of 500' AS message FROM j WHERE n < 500
    UNION ALL SELECT 'WARNING', 'ground_truth.' || kind || '_diversity', 'found ' || g || ' of 2000' FROM j WHERE g < 2000""",
)
def ground_truth_findings(t):
    severities = {"flood": "ERROR", "drought": "WARNING", "cyclone": "ERROR"}
    return audits.truth_findings(verified_events(t), "hazard_type", severities, "source", "source_event_id", 500, 2000)


@query(
    "review_completeness",
    "A31",
    """SELECT count(*) AS rows, count(*) FILTER (o_orderstatus = 'P' OR o_orderkey % 17 = 0) AS incomplete,
      count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority NOT LIKE '1%' AND o_orderkey % 17 <> 0) AS approved FROM orders""",
)
def review_completeness(t):
    review = t.orders.select(
        F.when(F.col("o_orderstatus") == "P", "pending")
        .when(F.col("o_orderstatus") == "F", " approved")
        .otherwise("REJECTED")
        .alias("review_status"),
        F.when(F.col("o_orderpriority").startswith("1"), "no").otherwise("Yes").alias("event_occurred_in_district"),
        F.when(F.col("o_orderkey") % 17 != 0, "yes").alias("date_correct"),
    )
    return audits.review_measures(review)


@query(
    "served_probability_audit",
    "A32 U6",
    f"""WITH {ASSESSMENT_SQL} SELECT count(DISTINCT district) AS places, '3,7,14' AS horizons, count(*) FILTER (flood_probability NOT BETWEEN 0 AND 1 OR cyclone_probability NOT BETWEEN 0 AND 1) AS out_of_range,
      count(flood_probability) AS flood_probability_rows, count(cyclone_probability) AS cyclone_probability_rows FROM assessment""",
)
def served_probability_audit(t):
    return audits.probability_measures(
        assessment(t), ["district"], "horizon_days", (3, 7, 14), ["flood_probability", "cyclone_probability"]
    )


@query(
    "label_method_set",
    "U6",
    """SELECT count(DISTINCT o_orderpriority) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH', '9-NONE')) AS known, count(DISTINCT o_orderpriority) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '9-NONE')) AS unknown,
      3 - count(DISTINCT o_orderpriority) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH', '9-NONE')) AS missing, 0 AS same FROM orders""",
)
def label_method_set(t):
    out = audits.same_set(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH", "9-NONE"])
    return out.withColumn("same", F.col("same").cast("int"))


@query("value_counts", "A11", f"WITH {RISK_SQL} SELECT dominant_hazard AS value, count(*) AS rows FROM risk_rows GROUP BY 1")
def value_counts(t):
    return audits.value_counts(risk_rows(t), "dominant_hazard")


@query(
    "confidence_histogram",
    "A12",
    f"""WITH {CANONICAL_SQL} SELECT count(*) FILTER (confidence >= 64) AS from_64, count(*) FILTER (confidence >= 32 AND confidence < 64) AS from_32,
      count(*) FILTER (confidence >= 16 AND confidence < 32) AS from_16, count(*) FILTER (confidence < 16) AS below_16, {tidy_sql('avg(confidence)', 4)} AS mean FROM canonical""",
)
def confidence_histogram(t):
    return tidy_columns(audits.score_histogram(canonical(t), "confidence", [64, 32, 16]), ["mean"], 4)


@query(
    "basic_quality_metrics",
    "A13",
    f"""WITH {RAW_SQL} SELECT count(*) AS rows, count(*) - count(DISTINCT source_url) AS duplicate_ids, count(*) FILTER (mentions < 5) AS needs_review,
      count(*) FILTER (latitude IS NULL) AS latitude_nulls, count(*) FILTER (actor_country IS NULL) AS actor_country_nulls FROM raw_rows""",
)
def basic_quality_metrics(t):
    return audits.basic_quality(raw_rows(t), "source_url", F.col("mentions") < 5, ["latitude", "actor_country"])


@query(
    "stage_funnel",
    "A14",
    f"""WITH {RAW_SQL}, c AS (SELECT count(*) AS a, count(*) FILTER (action_country = 'HM') AS b, count(*) FILTER (action_country = 'HM' AND latitude IS NOT NULL) AS d,
      count(*) FILTER (action_country = 'HM' AND latitude IS NOT NULL AND tone < 0) AS e FROM raw_rows)
    SELECT 'country' AS stage, a AS rows_in, b AS rows_out, a - b AS lost, {tidy_sql('b * 100.0::DOUBLE / a')} AS success_percent FROM c
    UNION ALL SELECT 'located', b, d, b - d, {tidy_sql('d * 100.0::DOUBLE / b')} FROM c UNION ALL SELECT 'negative', d, e, d - e, {tidy_sql('e * 100.0::DOUBLE / d')} FROM c""",
)
def stage_funnel(t):
    stages = {
        "country": F.col("action_country") == "HM",
        "located": F.col("latitude").isNotNull(),
        "negative": F.col("tone") < 0,
    }
    return tidy_columns(audits.funnel(raw_rows(t), stages), ["success_percent"])


@query(
    "evenly_spaced_review_sample",
    "W15",
    f"""WITH {VERIFIED_EVENTS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY hazard_type ORDER BY event_date, event_id) - 1 AS pos, count(*) OVER (PARTITION BY hazard_type) AS n FROM verified_events)
    SELECT hazard_type, event_id, CAST(event_date AS VARCHAR) AS event_date FROM n WHERE pos IN (SELECT CAST(round_even(i * (n - 1) / 14.0::DOUBLE, 0) AS BIGINT) FROM range(0, 15) r(i))""",
)
def evenly_spaced_review_sample(t):
    out = sampling.evenly_spaced(verified_events(t), "hazard_type", "event_date", "event_id", 15)
    return out.select("hazard_type", "event_id", F.col("event_date").cast("string").alias("event_date"))


@query(
    "export_head_per_hazard",
    "S17",
    f"""WITH {VERIFIED_EVENTS_SQL} SELECT hazard_type, event_id FROM verified_events QUALIFY row_number() OVER (PARTITION BY hazard_type ORDER BY value DESC, event_id) <= CASE hazard_type WHEN 'flood' THEN 20 ELSE 10 END""",
)
def export_head_per_hazard(t):
    out = sampling.per_kind_head(
        verified_events(t), "hazard_type", [F.desc("value"), F.col("event_id")], {"flood": 20, "cyclone": 10}
    )
    return out.select("hazard_type", "event_id")


@query(
    "proxy_labels",
    "P7 P8 P9 P10",
    f"""WITH {STATION_DAYS_SQL}, w AS (SELECT *, sum(precipitation) OVER (s ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rain_7d, avg(precipitation) OVER (PARTITION BY station, month(valid_date)) AS mp,
      avg(temperature) OVER (PARTITION BY station, month(valid_date)) AS mt, sum(CASE WHEN precipitation >= 30 THEN 0 ELSE 1 END) OVER (s ROWS UNBOUNDED PRECEDING) AS wb, sum(CASE WHEN precipitation <= 25 THEN 0 ELSE 1 END) OVER (s ROWS UNBOUNDED PRECEDING) AS db
      FROM station_days WINDOW s AS (PARTITION BY station ORDER BY valid_date)),
    x AS (SELECT *, sum(CASE WHEN precipitation >= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY station, wb ORDER BY valid_date) AS wet, sum(CASE WHEN precipitation <= 25 THEN 1 ELSE 0 END) OVER (PARTITION BY station, db ORDER BY valid_date) AS dry FROM w)
    SELECT station, CAST(valid_date AS VARCHAR) AS valid_date, CAST(precipitation >= 95 OR rain_7d >= 330 OR wet >= 6 AS INTEGER) AS flood_risk,
      CAST(dry >= 3 AND precipitation - mp <= -3.21 AND temperature - mt <= -1.23 AS INTEGER) AS drought_risk, CAST(precipitation >= 80 AND temperature >= 35 AS INTEGER) AS cyclone_risk, 'proxy' AS label_method FROM x""",
)
def proxy_labels(t):
    from terravane.operators import labels
    from terravane.plans.bindings import STATION

    out = labels.proxy_labels(
        station_days(t),
        STATION,
        labels.ProxyThresholds(
            flood_day=95, flood_week=330, wet_day=30, flood_streak=6, dry_day=25, drought_streak=3,
            drought_rain_anomaly=-3.21, drought_temperature_anomaly=-1.23, cyclone_rain=80, cyclone_temperature=35,
        ),
        warm_is_dry=False,
    )
    return out.select("station", F.col("valid_date").cast("string").alias("valid_date"), "flood_risk", "drought_risk", "cyclone_risk", "label_method")


_ORDER = "(doc_id * 7919) % 1000003"


def ordered_rows(t):
    return scored(t).withColumn("shuffled", (F.col("doc_id") * 7919) % 1000003)


@query(
    "negative_downsampling",
    "M1",
    f"""WITH {SCORED_SQL}, p AS (SELECT lang, greatest(10, CAST(sum(target) * 2 AS BIGINT)) AS lim FROM scored GROUP BY 1)
    SELECT doc_id, s.lang, target FROM scored s JOIN p USING (lang) QUALIFY target = 1 OR row_number() OVER (PARTITION BY s.lang, target ORDER BY {_ORDER}) <= lim""",
)
def negative_downsampling(t):
    out = sampling.downsample_negatives(ordered_rows(t), ["lang"], "target", "shuffled", 10, 2)
    return out.select("doc_id", "lang", "target")


@query(
    "row_order_split",
    "M2",
    f"""WITH {SCORED_SQL}, n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM scored)
    SELECT doc_id, CASE WHEN pos < floor(n * 0.7::DOUBLE) THEN 'train' WHEN pos < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'validation' ELSE 'test' END AS partition FROM n""",
)
def row_order_split(t):
    return sampling.split_by_order(scored(t), "doc_id", 0.7, 0.15).select("doc_id", "partition")


@query(
    "date_split",
    "M3",
    f"""WITH {SCORED_SQL}, d AS (SELECT date, row_number() OVER (ORDER BY date) AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM scored))
    SELECT doc_id, CASE WHEN pos <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN pos <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'validation' ELSE 'test' END AS partition FROM scored JOIN d USING (date)""",
)
def date_split(t):
    return sampling.split_by_date(scored(t), "date", 0.7, 0.15).select("doc_id", "partition")


GROUP_DAYS_SQL = f"""{SCORED_SQL}, l AS (SELECT DISTINCT a.date AS x, b.date AS y FROM scored a JOIN scored b ON a.event_group = b.event_group AND a.event_group <> '' AND a.doc_id // 3 % 5 = 0 AND b.doc_id // 3 % 5 = 0),
reach(x, y) AS (SELECT date, date FROM scored UNION SELECT r.x, l.y FROM reach r JOIN l ON l.x = r.y),
comp AS (SELECT x AS date, min(y) AS c FROM reach GROUP BY 1)"""


def grouped_rows(t):
    rows = scored(t)
    return rows.withColumn(
        "event_group", F.when(F.floor(F.col("doc_id") / 3) % 5 == 0, F.col("event_group")).otherwise("")
    )


@query(
    "group_safe_split",
    "M4",
    f"""WITH RECURSIVE {GROUP_DAYS_SQL}, s AS (SELECT c, count(*) AS n FROM comp GROUP BY 1),
    b AS (SELECT c, coalesce(sum(n) OVER (ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, (SELECT count(*) FROM comp) AS total FROM s),
    u AS (SELECT *, min(before) FILTER (before >= greatest(1, floor(total * 0.6::DOUBLE))) OVER () AS used FROM b)
    SELECT doc_id, CASE WHEN before < greatest(1, floor(total * 0.6::DOUBLE)) THEN 'train' WHEN before - used < greatest(1, floor(total * 0.2::DOUBLE)) THEN 'validation' ELSE 'test' END AS partition
    FROM scored JOIN comp USING (date) JOIN u USING (c)""",
)
def group_safe_split(t):
    out = sampling.split_by_group_and_date(grouped_rows(t), "date", "event_group", 0.6, 0.2)
    return out.select("doc_id", "partition")


@query(
    "year_split_counts",
    "M5",
    f"""WITH {STATION_DAYS_SQL}, l AS (SELECT CASE WHEN year(valid_date) <= 1998 THEN 'train' WHEN year(valid_date) <= 2000 THEN 'calibration' ELSE 'test' END AS partition,
      CAST(precipitation >= 120 AS INTEGER) AS target, 'g' || (station // 4) AS grp FROM station_days)
    SELECT partition, count(*) AS rows, count(*) FILTER (target = 1) AS positive_rows, count(DISTINCT CASE WHEN target = 1 THEN grp END) AS independent_events, CAST(count(DISTINCT target) > 1 AS INTEGER) AS both_classes FROM l GROUP BY 1""",
)
def year_split_counts(t):
    rows = station_days(t).select(
        "valid_date",
        (F.col("precipitation") >= 120).cast("int").alias("target"),
        F.concat(F.lit("g"), F.floor(F.col("station") / 4)).alias("event_group"),
    )
    split = sampling.split_by_year(rows, F.year("valid_date"), 1998, 2000)
    out = sampling.partition_counts(split, "target", "event_group")
    return out.withColumn("both_classes", F.col("both_classes").cast("int"))


ELIGIBLE = {"train": 4, "calibration": 2, "test": 2, "roc_auc": 0.45, "calibration_error": 0.6, "skill": -8.0}


ELIGIBLE_PARTS = {
    "train": "date < DATE '2024-01-16'",
    "calibration": "date BETWEEN DATE '2024-01-16' AND DATE '2024-01-22'",
    "test": "date > DATE '2024-01-22'",
}


@query(
    "model_eligibility",
    "M13",
    f"""WITH {SCORED_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY probability) + (count(*) OVER (PARTITION BY lang, probability) - 1) / 2.0 AS rk FROM scored),
    n AS (SELECT lang, sum(target) AS p, count(*) - sum(target) AS q, count(*) AS rows, avg(target) AS prevalence, avg(pow(probability - target, 2)) AS brier,
      count(DISTINCT CASE WHEN target = 1 THEN event_group END) AS events,
      {', '.join(f"count(DISTINCT CASE WHEN target = 1 AND {test} THEN event_group END) AS {name}_events" for name, test in ELIGIBLE_PARTS.items())} FROM scored GROUP BY 1),
    a AS (SELECT r.lang, (sum(rk) - any_value(p) * (any_value(p) + 1) / 2) / nullif(any_value(p) * any_value(q), 0) AS roc_auc FROM r JOIN n USING (lang) WHERE target = 1 GROUP BY 1),
    d AS (SELECT lang, probability, sum(target) AS pos, count(*) AS c FROM scored GROUP BY 1, 2),
    w AS (SELECT lang, pos, sum(pos) OVER (PARTITION BY lang ORDER BY probability DESC) AS tp, sum(c) OVER (PARTITION BY lang ORDER BY probability DESC) AS pred FROM d),
    b AS (SELECT w.lang, sum(pos * tp / pred) / nullif(any_value(p), 0) AS pr_auc FROM w JOIN n USING (lang) GROUP BY 1),
    e AS (SELECT lang, sum(gap) / sum(c) AS calibration_error FROM (SELECT lang, abs(sum(target) - sum(probability)) AS gap, count(*) AS c FROM scored GROUP BY lang, least(floor(probability * 10), 9)) GROUP BY 1),
    m AS (SELECT n.*, roc_auc, pr_auc, calibration_error, 1 - brier / nullif(prevalence * (1 - prevalence), 0) AS skill FROM n LEFT JOIN a USING (lang) LEFT JOIN b USING (lang) LEFT JOIN e USING (lang))
    SELECT lang, rows, events, train_events, calibration_events, test_events, {', '.join(f'{tidy_sql(c)} AS {c}' for c in ('roc_auc', 'pr_auc', 'calibration_error', 'skill'))},
      CAST(coalesce(train_events >= {ELIGIBLE['train']} AND calibration_events >= {ELIGIBLE['calibration']} AND test_events >= {ELIGIBLE['test']} AND roc_auc >= {ELIGIBLE['roc_auc']} AND pr_auc >= prevalence AND calibration_error <= {ELIGIBLE['calibration_error']} AND skill >= {ELIGIBLE['skill']}, false) AS INTEGER) AS eligible FROM m""",
)
def model_eligibility(t):
    rows = scored(t)
    measures = metrics.eligibility_measures(rows, ["lang"], "probability", "target", "event_group")
    part = F.coalesce(*[F.when(F.expr(test), F.lit(name)) for name, test in ELIGIBLE_PARTS.items()])
    counts = metrics.events_by_partition(
        rows.withColumn("part", part), ["lang"], "target", "event_group", "part", list(ELIGIBLE_PARTS)
    )
    measures = measures.join(counts, "lang", "left")
    rules = [
        *[F.col(f"{name}_events") >= ELIGIBLE[name] for name in ELIGIBLE_PARTS],
        F.col("roc_auc") >= ELIGIBLE["roc_auc"],
        F.col("pr_auc") >= F.col("prevalence"),
        F.col("calibration_error") <= ELIGIBLE["calibration_error"],
        F.col("skill") >= ELIGIBLE["skill"],
    ]
    judged = measures.withColumn("eligible", metrics.eligible(rules).cast("int"))
    shown = ["roc_auc", "pr_auc", "calibration_error", "skill"]
    return tidy_columns(
        judged.select("lang", "rows", "events", *[f"{name}_events" for name in ELIGIBLE_PARTS], *shown, "eligible"), shown
    )
