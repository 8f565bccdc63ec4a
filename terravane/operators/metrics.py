"""Evaluation of scored rows: row, event, day and probability level.

Global orderings go through ``ranking.positions``, so no step sorts the table in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.operators import ranking


def ratio(top, bottom) -> Column:
    """top / bottom, 0 when there is nothing to divide by."""
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def confusion(frame: DataFrame, probability: str, target: str, threshold: float) -> DataFrame:
    """Counts at a threshold and the measures derived from them, one row."""
    alert, positive = F.col(probability) >= threshold, F.col(target) == 1
    counts = frame.agg(
        F.count_if(~alert & ~positive).alias("true_negative"),
        F.count_if(alert & ~positive).alias("false_positive"),
        F.count_if(~alert & positive).alias("false_negative"),
        F.count_if(alert & positive).alias("true_positive"),
    )
    tn, fp, fn, tp = (
        F.col(c) for c in ("true_negative", "false_positive", "false_negative", "true_positive")
    )
    recall, specificity, precision = ratio(tp, tp + fn), ratio(tn, tn + fp), ratio(tp, tp + fp)
    present = (tp + fn > 0).cast("int") + (tn + fp > 0).cast("int")
    return counts.withColumns(
        {
            "accuracy": ratio(tp + tn, tp + tn + fp + fn),
            "balanced_accuracy": (recall + specificity) / present,
            "precision": precision,
            "recall": recall,
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
        }
    )


def curve_areas(frame: DataFrame, probability: str, target: str) -> DataFrame:
    """roc_auc (ties count half) and pr_auc (average precision); null with a single class."""
    ranked = ranking.positions(frame, probability, extra={"pos": F.col(target).cast("long")})
    negatives_below = F.col("below") - F.col("pos_below")
    negatives_here = F.col("at_value") - F.col("pos")
    wins = F.sum(F.col("pos") * (negatives_below + negatives_here / 2))
    positives, negatives = F.max("pos_total"), F.max(F.col("total") - F.col("pos_total"))
    hits = F.col("pos_total") - F.col("pos_below")
    precision = hits / (F.col("total") - F.col("below"))
    both = (positives > 0) & (negatives > 0)
    return ranked.agg(
        F.when(both, wins / (positives * negatives)).alias("roc_auc"),
        F.when(both, F.sum(F.col("pos") * precision) / positives).alias("pr_auc"),
    )


def eligibility_measures(
    frame: DataFrame, by: Sequence[str], probability: str, target: str, group: str, bins: int = 10
) -> DataFrame:
    """Per group of rows: events, areas, prevalence, calibration error and skill over the prevalence."""
    by, p, y = list(by), F.col(probability), F.col(target)
    ranked = ranking.positions(frame, probability, by, extra={"pos": y.cast("long")})
    below = F.col("below") - F.col("pos_below") + (F.col("at_value") - F.col("pos")) / 2
    positives, negatives = F.max("pos_total"), F.max(F.col("total") - F.col("pos_total"))
    precision = (F.col("pos_total") - F.col("pos_below")) / (F.col("total") - F.col("below"))
    both = (positives > 0) & (negatives > 0)
    areas = ranked.groupBy(*by).agg(
        F.when(both, F.sum(F.col("pos") * below) / (positives * negatives)).alias("roc_auc"),
        F.when(positives > 0, F.sum(F.col("pos") * precision) / positives).alias("pr_auc"),
    )
    # areas of a group with one class only stay null
    binned = (
        frame.groupBy(*by, F.least(F.floor(p * bins), F.lit(bins - 1)).alias("_bin"))
        .agg(F.abs(F.sum(y) - F.sum(p)).alias("_gap"), F.count(F.lit(1)).alias("_n"))
        .groupBy(*by)
        .agg((F.sum("_gap") / F.sum("_n")).alias("calibration_error"))
    )
    whole = frame.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(F.when(y == 1, F.col(group))).alias("events"),
        F.avg(y).alias("prevalence"),
        F.avg(F.pow(p - y, F.lit(2.0))).alias("_brier"),
    )
    spread = F.col("prevalence") * (1 - F.col("prevalence"))
    skill = F.when(spread > 0, 1 - F.col("_brier") / spread)
    return whole.withColumn("skill", skill).drop("_brier").join(areas, by, "left").join(binned, by, "left")


def events_by_partition(
    frame: DataFrame, by: Sequence[str], target: str, group: str, partition: str, names: Sequence[str]
) -> DataFrame:
    """Per group of rows the independent events of each named partition, ``{name}_events``."""
    event = F.when((F.col(target) == 1) & (F.coalesce(group, F.lit("")) != ""), F.col(group))
    return frame.groupBy(*by).agg(
        *[F.countDistinct(F.when(F.col(partition) == name, event)).alias(f"{name}_events") for name in names]
    )


def event_metrics(
    frame: DataFrame, probability: str, target: str, group: str, day: str, threshold: float
) -> DataFrame:
    """Detected independent events, and days with a false alarm, one row."""
    positive = (F.col(target) == 1) & (F.coalesce(group, F.lit("")) != "")
    events = (
        frame.where(positive)
        .groupBy(group)
        .agg(F.max(probability).alias("best"))
        .agg(
            F.count(F.lit(1)).alias("independent_events"),
            F.count_if(F.col("best") >= threshold).alias("detected_events"),
        )
    )
    days = (
        frame.where(F.col(target) == 0)
        .groupBy(F.to_date(day).alias("_day"))
        .agg(F.bool_or(F.col(probability) >= threshold).alias("alarm"))
        .agg(
            F.count_if("alarm").alias("false_alarm_days"),
            F.count(F.lit(1)).alias("negative_days"),
        )
    )
    by_day = days.select(F.struct("false_alarm_days", "negative_days")).scalar()
    return events.withColumn("_d", by_day).select(
        "independent_events", "detected_events", "_d.*"
    ).withColumns(
        {
            "event_recall": ratio(F.col("detected_events"), F.col("independent_events")),
            "false_alarm_day_rate": ratio(F.col("false_alarm_days"), F.col("negative_days")),
        }
    )


def event_ranks(
    frame: DataFrame, probability: str, target: str, group: str, day: str
) -> DataFrame:
    """Best rank fraction each event reaches among all rows of a day.

    A rank falls as the score rises, so an event's best rank of a day is that of its highest score;
    only these few rows meet the ranks, whatever the number of rows.
    """
    dated = frame.withColumn("_day", F.to_date(day))
    ranks = ranking.fractions(dated, probability, ["_day"], "rank_fraction")
    positive = (F.col(target) == 1) & (F.coalesce(group, F.lit("")) != "")
    scored = positive & F.col(probability).isNotNull() & ~F.isnan(F.col(probability).cast("double"))
    highest = dated.where(positive).groupBy(group, "_day").agg(F.max(F.when(scored, F.col(probability))).alias(probability))
    return highest.join(ranks, ["_day", probability], "left").groupBy(group).agg(F.min("rank_fraction").alias("best_rank"))


def event_ranking(ranks: DataFrame, budgets: Sequence[float]) -> DataFrame:
    """Median best rank and the events within each budget, one row per budget."""
    middle = ranking.quantiles(ranks, "best_rank", [0.5]).select("quantile")
    return (
        ranks.agg(
            F.count(F.lit(1)).alias("independent_events"),
            F.array(
                *[
                    F.struct(
                        F.lit(float(b)).alias("budget"),
                        F.count_if(F.col("best_rank") <= b).alias("detected_events"),
                    )
                    for b in budgets
                ]
            ).alias("_b"),
        )
        .select("independent_events", F.inline("_b"))
        .withColumns(
            {
                "event_recall": ratio(F.col("detected_events"), F.col("independent_events")),
                "median_best_rank": middle.scalar(),
            }
        )
    )


def alert_threshold(frame: DataFrame, probability: str, budget: float) -> DataFrame:
    """Score that alerts on at most a share ``budget`` of the rows, one row."""
    if not 0 < budget < 1:
        raise ValueError("alert budget must lie between 0 and 1")
    return ranking.quantiles(frame, probability, [1.0 - budget], method="higher").select(
        F.col("quantile").alias("threshold")
    )


def alert_burden(frame: DataFrame, probability: str, day: str, threshold) -> DataFrame:
    """Alerted rows in all and per day, one row; ``threshold`` is a number or a scalar column."""
    limit = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    flagged = frame.withColumn("_alert", (F.col(probability) >= limit).cast("long"))
    daily = flagged.groupBy(F.to_date(day).alias("_day")).agg(
        F.sum("_alert").alias("alerts"), F.count(F.lit(1)).alias("rows")
    )
    return daily.agg(
        F.sum("alerts").alias("alerted_rows"),
        (F.sum("alerts") / F.sum("rows")).alias("alerted_row_fraction"),
        F.avg("alerts").alias("mean_alerts_per_day"),
        F.max("alerts").alias("maximum_alerts_per_day"),
    )


def _edges(frame: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Distinct quantile edges, ends included."""
    points = [i / bins for i in range(bins + 1)]
    return ranking.quantile_array(frame, value, points, by).select(
        *by, F.array_distinct("quantiles").alias("edges")
    )


def _interior(edges: Column) -> Column:
    return F.when(F.size(edges) >= 3, F.slice(edges, 2, F.size(edges) - 2)).otherwise(
        F.array().cast("array<double>")
    )


def probability_diagnostics(frame: DataFrame, probability: str, target: str, bins: int = 10) -> DataFrame:
    """Brier scores, skill and calibration error on quantile bins, one row.

    A value on an inner edge belongs to the bin above it.
    """
    scored = frame.select(F.col(probability).alias("p"), F.col(target).cast("double").alias("y"))
    edges = _edges(scored, "p", bins).select("edges")
    binned = scored.withColumn("_edges", edges.scalar()).withColumn(
        "bin", F.size(F.filter(_interior(F.col("_edges")), lambda e: e <= F.col("p")))
    )
    per_bin = binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("p").alias("sp"),
        F.sum("y").alias("sy"),
        F.sum(F.pow(F.col("p") - F.col("y"), 2)).alias("se"),
        F.sum(F.pow("y", F.lit(2))).alias("syy"),
    )
    n = F.sum("n")
    prevalence = F.sum("sy") / n
    climatology = F.sum("syy") / n - F.pow(prevalence, F.lit(2))
    brier = F.sum("se") / n
    return per_bin.agg(
        n.alias("rows"),
        prevalence.alias("positive_prevalence"),
        (F.sum("sp") / n).alias("mean_score"),
        brier.alias("brier_score"),
        climatology.alias("climatology_brier_score"),
        F.when(climatology <= 0, 0.0).otherwise(1.0 - brier / climatology).alias("brier_skill_score"),
        (F.sum(F.abs(F.col("sp") - F.col("sy"))) / n).alias("expected_calibration_error"),
        F.count(F.lit(1)).alias("populated_bins"),
    )


def threshold_sweep(frame: DataFrame, probability: str, target: str, thresholds: Column) -> DataFrame:
    """Precision, recall, F1 and F2 at each threshold of an ascending array column.

    Rows are first counted by how many thresholds they reach; the cumulative sum then
    runs over one row per threshold.
    """
    reached = (
        frame.select(F.col(probability).alias("p"), F.col(target).cast("long").alias("y"))
        .withColumn("_t", thresholds)
        .withColumn("reached", F.size(F.filter("_t", lambda t: t <= F.col("p"))))
        .groupBy("reached")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    )
    spark = frame.sparkSession
    steps = spark.range(1).select(F.posexplode(thresholds).alias("at", "threshold"))
    counts = steps.select((F.col("at") + 1).alias("reached"), "threshold").join(reached, "reached", "full")
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("reached"))
    everything = Window.partitionBy(F.lit(0))
    tallied = counts.withColumns(
        {
            "predicted": F.sum(F.coalesce("n", F.lit(0))).over(above),
            "hits": F.sum(F.coalesce("pos", F.lit(0))).over(above),
            "positives": F.sum(F.coalesce("pos", F.lit(0))).over(everything),
            "rows": F.sum(F.coalesce("n", F.lit(0))).over(everything),
        }
    ).where("reached > 0")
    precision = ratio(F.col("hits"), F.col("predicted"))
    recall = ratio(F.col("hits"), F.col("positives"))
    both = tallied.withColumns({"precision": precision, "recall": recall})
    p, r = F.col("precision"), F.col("recall")
    return both.select(
        "threshold",
        "precision",
        "recall",
        ratio(2 * p * r, p + r).alias("f1"),
        ratio(5 * p * r, 4 * p + r).alias("f2"),
        ((F.col("positives") > 0) & (F.col("positives") < F.col("rows"))).alias("two_classes"),
    )


def best_f1_threshold(frame: DataFrame, probability: str, target: str, thresholds: Sequence[float]) -> DataFrame:
    """First threshold with the largest F1; one half when only one class is present."""
    swept = threshold_sweep(frame, probability, target, F.array(*[F.lit(float(t)) for t in thresholds]))
    best = swept.agg(
        F.min_by(F.struct("threshold", "f1"), F.struct(-F.round("f1", 12), F.col("threshold"))).alias("b"),
        F.bool_and("two_classes").alias("ok"),
    )
    return best.select(F.when(F.col("ok"), F.col("b.threshold")).otherwise(0.5).alias("threshold"), F.col("b.f1").alias("f1"))


def operating_threshold(
    frame: DataFrame,
    probability: str,
    target: str,
    fixed: Sequence[float],
    quantile_steps: int,
    least_precision: float,
    least_recall: float,
) -> DataFrame:
    """Best F2 among thresholds that keep both minimums; among all when none does.

    Candidates are the fixed values and the quantiles of the scores.  Ties: recall, then
    precision, then the smaller threshold.
    """
    points = [i / quantile_steps for i in range(quantile_steps + 1)]
    found = ranking.quantile_array(frame.select(F.col(probability).alias("p")), "p", points)
    merged = found.select(
        F.array_sort(
            F.array_distinct(F.concat(F.array(*[F.lit(float(f)) for f in fixed]), "quantiles"))
        ).alias("t")
    )
    swept = threshold_sweep(frame, probability, target, merged.scalar())
    feasible = (F.col("precision") >= least_precision) & (F.col("recall") >= least_recall)
    best = swept.agg(
        F.max_by(
            F.struct("threshold", "precision", "recall", "f2", feasible.alias("feasible")),
            F.struct(
                feasible, F.round("f2", 12), F.round("recall", 12), F.round("precision", 12), -F.col("threshold")
            ),
        ).alias("b"),
        F.bool_and("two_classes").alias("ok"),
    )
    return best.select(
        F.when(F.col("ok"), F.col("b.threshold")).otherwise(0.5).alias("threshold"),
        F.col("b.precision").alias("precision"),
        F.col("b.recall").alias("recall"),
        F.col("b.f2").alias("f2"),
        F.col("b.feasible").alias("feasible"),
    )


def _long(frame: DataFrame, features: Sequence[str]) -> DataFrame:
    rows = F.explode(
        F.array(
            *[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]
        )
    )
    long = frame.select(rows.alias("_r")).select("_r.*")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def stability_index(
    reference: DataFrame, current: DataFrame, features: Sequence[str], bins: int = 10
) -> DataFrame:
    """Population stability index per feature, all features in one job.

    Bins come from the reference quantiles, open to both sides; a value on an inner edge
    belongs to the bin below it.  Fewer than three distinct edges give 0, an empty side
    gives infinity.
    """
    old, new = _long(reference, features), _long(current, features)
    edges = _edges(old, "value", bins, ["feature"])
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    counts = both.groupBy("feature", "value").agg(
        F.count_if(F.col("_new") == 0).alias("old"), F.count_if(F.col("_new") == 1).alias("new")
    )
    binned = (
        counts.join(edges, "feature", "left")
        .withColumn("bin", F.size(F.filter(_interior(F.col("edges")), lambda e: e < F.col("value"))))
        .groupBy("feature", "bin")
        .agg(F.sum("old").alias("old"), F.sum("new").alias("new"), F.max(F.size("edges")).alias("edges"))
    )
    # one row per bin from here on
    totals = binned.groupBy("feature").agg(
        F.sum("old").alias("all_old"), F.sum("new").alias("all_new"), F.max("edges").alias("edges"),
        F.collect_list(F.struct("old", "new")).alias("bins"),
    )
    listed = reference.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(f) for f in features])).alias("feature")
    )

    def share(part: Column, whole: str) -> Column:
        return F.greatest(part / F.col(whole), F.lit(1e-6))

    terms = F.transform(
        "bins",
        lambda b: (share(b["new"], "all_new") - share(b["old"], "all_old"))
        * F.log(share(b["new"], "all_new") / share(b["old"], "all_old")),
    )
    missing = F.coalesce(F.col("all_old"), F.lit(0)) * F.coalesce(F.col("all_new"), F.lit(0)) == 0
    index = (
        F.when(missing, float("inf"))
        .when(F.col("edges") < 3, 0.0)
        .otherwise(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b))
    )
    return listed.join(totals, "feature", "left").select("feature", index.alias("psi"))


def drift_report(index: DataFrame, warning: float, critical: float) -> DataFrame:
    status = (
        F.when(F.col("psi") >= critical, "critical").when(F.col("psi") >= warning, "warning").otherwise("stable")
    )
    return index.withColumn("status", status)


def quality_gate(metrics: DataFrame, minimums: Mapping[str, float]) -> DataFrame:
    """Metrics (name, value) below their minimum or absent, as findings."""
    wanted = metrics.sparkSession.range(1).select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(v)).alias("minimum")) for n, v in minimums.items()])
        ).alias("_m")
    ).select("_m.*")
    joined = wanted.join(metrics, "name", "left")
    return joined.where(F.col("value").isNull() | (F.col("value") < F.col("minimum"))).select(
        F.lit("ERROR").alias("severity"), F.concat(F.lit("quality."), "name").alias("check"), "value", "minimum"
    )


def eligible(rules: Sequence[Column]) -> Column:
    """All rules hold; unknown counts as not held."""
    out = F.lit(True)
    for rule in rules:
        out = out & F.coalesce(rule, F.lit(False))
    return out
