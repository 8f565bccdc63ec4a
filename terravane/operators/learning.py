"""Train, calibrate, choose and apply classifiers with Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane import contracts
from terravane.operators import metrics
from terravane.session import run_folder


def with_class_weights(frame: DataFrame, target: str) -> DataFrame:
    """Column ``weight``: each class counts for half of the table."""
    counts = frame.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(target) == 1).alias("pos")
    ).select(F.struct("n", "pos").alias("c"))
    c = F.col("_c")
    weight = F.when(F.col(target) == 1, c["n"] / (2.0 * c["pos"])).otherwise(
        c["n"] / (2.0 * (c["n"] - c["pos"]))
    )
    return frame.withColumn("_c", counts.scalar()).withColumn("weight", weight).drop("_c")


def require_both_classes(frame: DataFrame, target: str) -> DataFrame:
    seen = frame.agg(F.min(target).alias("low"), F.max(target).alias("high")).first()
    if (seen.low, seen.high) != (0, 1):
        raise contracts.ContractError(f"{target} needs both classes, has {seen.low}..{seen.high}")
    return frame


def boosted_trees(rounds: int = 20, depth: int = 4, seed: int = 7) -> GBTClassifier:
    return GBTClassifier(
        labelCol="label", featuresCol="features", weightCol="weight", maxIter=rounds, maxDepth=depth, seed=seed
    )


def forest(trees: int = 30, depth: int = 6, seed: int = 7) -> RandomForestClassifier:
    return RandomForestClassifier(
        labelCol="label", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed
    )


def fit(frame: DataFrame, features: Sequence[str], target: str, classifier: Estimator) -> PipelineModel:
    """Weighted classifier on the named features; a row without one of them is an error."""
    require_both_classes(frame, target)
    contracts.assert_no_nulls(frame, list(features))
    rows = with_class_weights(frame, target)
    labelled = rows.select(*features, "weight", F.col(target).cast("double").alias("label")).persist()
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    try:
        # the learner passes over its input many times
        model = Pipeline(stages=[assembler, classifier]).fit(labelled)
    finally:
        labelled.unpersist()
    # a fitted forest keeps a training summary that holds the session and cannot be sent to
    # tasks; read back from storage it is the plain model
    folder = run_folder(frame.sparkSession, "model")
    model.write().save(folder)
    return PipelineModel.load(folder)


@dataclass(frozen=True)
class LinearModel:
    """A logistic score with given coefficients, e.g. one taken over from another system."""

    coefficients: Mapping[str, float]
    intercept: float


def raw_score(model: PipelineModel | LinearModel, frame: DataFrame, name: str = "probability") -> DataFrame:
    """Probability of the positive class; null where a feature is missing."""
    if isinstance(model, LinearModel):
        total = F.lit(model.intercept)
        for feature, weight in model.coefficients.items():
            total = total + F.col(feature) * weight
        return frame.withColumn(name, 1.0 / (1.0 + F.exp(-total)))
    features = model.stages[0].getInputCols()
    complete = F.lit(True)
    for feature in features:
        complete = complete & F.col(feature).isNotNull()
    scored = model.transform(
        frame.withColumn("_complete", complete).na.fill(0.0, subset=list(features))
    )
    value = F.when(F.col("_complete"), vector_to_array("probability").getItem(1))
    return scored.withColumn("_score", value).select(
        *[F.col(c) for c in frame.columns if c != name], F.col("_score").alias(name)
    )


@dataclass(frozen=True)
class Sigmoid:
    """Calibration of a score: one slope, one intercept."""

    slope: float
    intercept: float

    def of(self, score: str) -> Column:
        return 1.0 / (1.0 + F.exp(-(self.slope * F.col(score) + self.intercept)))


def fit_sigmoid(frame: DataFrame, score: str, target: str) -> Sigmoid:
    """Sigmoid calibration of a score on held-out rows."""
    rows = frame.where(F.col(score).isNotNull()).select(
        array_to_vector(F.array(F.col(score).cast("double"))).alias("features"),
        F.col(target).cast("double").alias("label"),
    )
    model = LogisticRegression(maxIter=50).fit(rows)
    return Sigmoid(float(model.coefficients[0]), float(model.intercept))


@dataclass(frozen=True)
class HazardModel:
    """What is needed to score a hazard; ``model`` may be missing for an optional hazard."""

    model: PipelineModel | LinearModel | None
    calibration: Sigmoid | None = None
    threshold: float = 0.5


def train_calibrated(
    frame: DataFrame, features: Sequence[str], target: str, classifier: Estimator, partition: str = "partition"
) -> HazardModel:
    """Fit on ``train`` rows, calibrate on ``calibration`` rows."""
    model = fit(frame.where(F.col(partition) == "train"), features, target, classifier)
    held_out = require_both_classes(frame.where(F.col(partition) == "calibration"), target)
    return HazardModel(model, fit_sigmoid(raw_score(model, held_out), "probability", target))


def score(frame: DataFrame, hazard: str, trained: HazardModel) -> DataFrame:
    """Probability, prediction and availability of one hazard; a missing model gives 0 and null."""
    probability, prediction = f"{hazard}_probability", f"{hazard}_prediction"
    if trained.model is None:
        return frame.withColumns(
            {
                probability: F.lit(None).cast("double"),
                prediction: F.lit(0),
                f"{hazard}_available": F.lit(False),
            }
        )
    out = raw_score(trained.model, frame, probability)
    if trained.calibration is not None:
        out = out.withColumn(probability, trained.calibration.of(probability))
    return out.withColumns(
        {
            prediction: F.coalesce((F.col(probability) >= trained.threshold).cast("int"), F.lit(0)),
            f"{hazard}_available": F.lit(True),
        }
    )


def score_horizons(frame: DataFrame, horizon: str, hazard: str, models: Mapping[int, HazardModel]) -> DataFrame:
    """Each row by the model of its own horizon; rows of other horizons are left out.

    Linear models become a table with one row per horizon, which the rows join in a single pass.
    A fitted tree model scores the rows of its horizon on its own.
    """
    linear = {d: m for d, m in models.items() if isinstance(m.model, LinearModel)}
    parts = [score(frame.where(F.col(horizon) == d), hazard, m) for d, m in models.items() if d not in linear]
    if linear:
        parts.insert(0, _score_linear(frame, horizon, hazard, linear))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _score_linear(frame: DataFrame, horizon: str, hazard: str, models: Mapping[int, HazardModel]) -> DataFrame:
    rows = [
        (
            days, dict(m.model.coefficients), m.model.intercept,
            m.calibration and m.calibration.slope, m.calibration and m.calibration.intercept, float(m.threshold),
        )
        for days, m in models.items()
    ]
    kind = "_horizon INT, _weights MAP<STRING, DOUBLE>, _start DOUBLE, _slope DOUBLE, _offset DOUBLE, _threshold DOUBLE"
    table = frame.sparkSession.createDataFrame(rows, kind)
    total = F.col("_start")
    for feature in dict.fromkeys(f for m in models.values() for f in m.model.coefficients):
        weight = F.try_element_at("_weights", F.lit(feature))
        # a feature that this horizon's model does not have adds nothing, a missing value leaves no score
        total = total + F.when(weight.isNull(), F.lit(0.0)).otherwise(F.col(feature) * weight)
    raw = 1.0 / (1.0 + F.exp(-total))
    calibrated = 1.0 / (1.0 + F.exp(-(F.col("_slope") * F.col("_raw") + F.col("_offset"))))
    probability, prediction = F.col(f"{hazard}_probability"), (F.col(f"{hazard}_probability") >= F.col("_threshold"))
    joined = frame.join(table, frame[horizon] == table["_horizon"]).withColumn("_raw", raw)
    return joined.withColumn(
        f"{hazard}_probability", F.when(F.col("_slope").isNull(), F.col("_raw")).otherwise(calibrated)
    ).select(
        *frame.columns,
        probability,
        F.coalesce(prediction.cast("int"), F.lit(0)).alias(f"{hazard}_prediction"),
        F.lit(True).alias(f"{hazard}_available"),
    )


def compare(
    frame: DataFrame,
    features: Sequence[str],
    target: str,
    candidates: Mapping[str, Estimator],
    threshold: float = 0.5,
    partition: str = "partition",
) -> tuple[str, DataFrame]:
    """Validation measures of every candidate and the name of the best."""
    train = frame.where(F.col(partition) == "train")
    held_out = frame.where(F.col(partition) == "calibration")
    scored = {
        name: raw_score(fit(train, features, target, classifier), held_out) for name, classifier in candidates.items()
    }
    return choose({name: (rows, "probability") for name, rows in scored.items()}, target, threshold)


def choose(
    scored: Mapping[str, tuple[DataFrame, str]], target: str, threshold: float
) -> tuple[str, DataFrame]:
    """Areas and recall of scored candidates, and the best by average precision, then by recall."""
    rows = None
    for name, (frame, probability) in scored.items():
        recall = frame.agg(
            (
                F.count_if((F.col(target) == 1) & (F.col(probability) >= threshold)) / F.count_if(F.col(target) == 1)
            ).alias("recall")
        )
        measures = metrics.curve_areas(frame, probability, target).select(
            F.lit(name).alias("candidate"), "*", recall.scalar().alias("recall")
        )
        rows = measures if rows is None else rows.unionByName(measures)
    # one row per candidate
    best = rows.agg(F.max_by("candidate", F.struct("pr_auc", "recall")).alias("best")).first()["best"]
    return best, rows


def backtest(
    validation: DataFrame, test: DataFrame, probability: str, target: str, group: str, day: str, budgets: Sequence[float]
) -> DataFrame:
    """Alert budgets fixed on validation rows, their burden and event recall on test rows.

    All thresholds come from one pass over the validation rows; every test row then counts for each
    budget at once in one daily and one event aggregation.
    """
    limits = {b: metrics.alert_threshold(validation, probability, b).withColumn("budget", F.lit(float(b))) for b in budgets}
    thresholds = None
    for limit in limits.values():
        thresholds = limit if thresholds is None else thresholds.unionByName(limit)
    # one row per budget
    fixed = [(r["budget"], r["threshold"]) for r in thresholds.select("budget", "threshold").collect()]
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("budget"), F.lit(float(t)).alias("threshold")) for b, t in fixed]))
    alert = F.col("best") >= F.col("threshold")
    rows = test.select(
        F.to_date(day).alias("_day"), F.col(probability).alias("best"), F.col(target).alias("_t"), F.col(group).alias("_g"), each.alias("_b")
    ).select("_day", "best", "_t", "_g", "_b.*")
    days = (
        rows.groupBy("budget", "threshold", "_day")
        .agg(
            F.count_if(alert).alias("alerts"),
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.bool_or(F.when(F.col("_t") == 0, alert)), F.lit(False)).alias("alarm"),
            F.bool_or(F.col("_t") == 0).alias("negative"),
        )
        .groupBy("budget", "threshold")
        .agg(
            F.sum("alerts").alias("alerted_rows"),
            (F.sum("alerts") / F.sum("rows")).alias("alerted_row_fraction"),
            F.avg("alerts").alias("mean_alerts_per_day"),
            F.max("alerts").alias("maximum_alerts_per_day"),
            F.count_if("alarm").alias("false_alarm_days"),
            F.count_if("negative").alias("negative_days"),
        )
    )
    events = (
        rows.where((F.col("_t") == 1) & (F.coalesce("_g", F.lit("")) != ""))
        .groupBy("budget", "threshold", "_g")
        .agg(F.max("best").alias("best"))
        .groupBy("budget")
        .agg(F.count(F.lit(1)).alias("independent_events"), F.count_if(alert).alias("detected_events"))
    )
    return days.join(events, "budget", "left").select(
        "budget",
        "threshold",
        "alerted_rows",
        "alerted_row_fraction",
        "mean_alerts_per_day",
        "maximum_alerts_per_day",
        "independent_events",
        "detected_events",
        (F.col("detected_events") / F.col("independent_events")).alias("event_recall"),
        "false_alarm_days",
        "negative_days",
        F.when(F.col("negative_days") > 0, F.col("false_alarm_days") / F.col("negative_days")).alias("false_alarm_day_rate"),
    )
