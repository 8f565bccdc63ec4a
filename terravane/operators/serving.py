"""Tables a consumer reads: horizons, assessment, outlook, reports and top lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane import contracts
from terravane.functions import scoring
from terravane.operators import dedupe, ranking


def json_daily_rows(frame: DataFrame, payload: str, schema: str, keep: Sequence[str]) -> DataFrame:
    """Parallel arrays of a daily JSON forecast as rows with ``lead_day`` 1..n.

    ``schema`` is the DDL of the ``daily`` object.  Arrays of unequal length are an error.
    """
    daily = F.from_json(payload, f"daily STRUCT<{schema}>")["daily"]
    parsed = frame.select(*keep, daily.alias("_daily"))
    names = parsed.schema["_daily"].dataType.fieldNames()
    sizes = F.array_distinct(F.array(*[F.size(F.col("_daily")[n]) for n in names]))
    checked = parsed.withColumn(
        "_daily",
        F.when(F.size(sizes) == 1, F.col("_daily")).otherwise(
            F.raise_error(F.lit("daily arrays differ in length"))
        ),
    )
    zipped = F.arrays_zip(*[F.col("_daily")[n].alias(n) for n in names])
    rows = checked.select(*keep, F.posexplode(zipped).alias("_at", "_row"))
    return rows.select(*keep, (F.col("_at") + 1).alias("lead_day"), "_row.*")


def horizon_aggregates(
    frame: DataFrame,
    keys: Sequence[str],
    lead: str,
    horizons: Sequence[int],
    measures: Mapping[str, tuple[str, str]],
) -> DataFrame:
    """One row per key and horizon over the rows with lead up to it.

    ``measures`` maps an output name to (aggregate, column).  All horizons are computed
    in a single aggregation, without multiplying the input.
    """
    reduce = {"sum": F.sum, "max": F.max, "min": F.min, "avg": F.avg}
    parts = []
    for horizon in horizons:
        inside = F.col(lead) <= horizon
        parts.append(
            F.struct(
                F.lit(horizon).alias("horizon_days"),
                F.count_if(inside).alias("days"),
                *[
                    reduce[how](F.when(inside, F.col(column))).alias(name)
                    for name, (how, column) in measures.items()
                ],
            )
        )
    return (
        frame.groupBy(*keys)
        .agg(F.array(*parts).alias("_rows"))
        .select(*keys, F.inline("_rows"))
        .where(F.col("days") > 0)
        .drop("days")
    )


def with_optional(
    frame: DataFrame, other: DataFrame | None, keys: Sequence[str], defaults: Mapping[str, Column]
) -> DataFrame:
    """Left join a source that may be missing as a whole; neutral columns stand in then."""
    if other is None:
        return frame.withColumns(dict(defaults))
    joined = frame.join(other.select(*keys, *defaults), list(keys), "left")
    return joined.withColumns({n: F.coalesce(n, v) for n, v in defaults.items()})


def normalised(
    frame: DataFrame,
    factors: Mapping[str, bool],
    low: float = 0.05,
    high: float = 0.95,
) -> DataFrame:
    """Robust 0..1 score per factor: clip((x - q_low) / (q_high - q_low)).

    ``factors`` maps a column to whether it is inverted; the score is ``{column}_score``.
    A flat factor scores 0.5, a missing value stays null.  The quantiles of all factors
    come from one job, and reach the rows as one small map.
    """
    long = frame.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(n).alias("factor"), F.col(n).cast("double").alias("value"))
                    for n in factors
                ]
            )
        ).alias("_f")
    ).select("_f.*")
    bounds = ranking.quantiles(long, "value", [low, high], ["factor"])
    ends = bounds.groupBy("factor").agg(
        F.max(F.when(F.col("probability") == low, F.col("quantile"))).alias("low"),
        F.max(F.when(F.col("probability") == high, F.col("quantile"))).alias("high"),
    )
    table = ends.agg(
        F.map_from_entries(F.collect_list(F.struct("factor", F.struct("low", "high")))).alias("_ends")
    )
    scored = frame.withColumn("_ends", table.scalar())
    columns = {}
    for name, inverted in factors.items():
        end = F.element_at("_ends", F.lit(name))
        span = end["high"] - end["low"]
        flat = F.abs(span) <= 1e-9 * F.greatest(F.abs(end["low"]), F.abs(end["high"]))
        value = F.col(name).cast("double")
        score = F.least(F.greatest((value - end["low"]) / span, F.lit(0.0)), F.lit(1.0))
        score = F.when(flat, F.lit(0.5)).otherwise(F.when(value.isNotNull(), score))
        columns[f"{name}_score"] = 1.0 - score if inverted else score
    return scored.withColumns(columns).drop("_ends")


def longest_horizon(assessment: DataFrame, preferred: int) -> DataFrame:
    """Rows of the preferred horizon, or of the largest one when nobody has it."""
    chosen = assessment.agg(
        F.coalesce(
            F.max(F.when(F.col("horizon_days") == preferred, F.col("horizon_days"))),
            F.max("horizon_days"),
        ).alias("h")
    )
    return assessment.where(F.col("horizon_days") == chosen.scalar())


def planning_outlook(
    assessment: DataFrame,
    hazards: Sequence[str],
    weights: Mapping[int, float],
    bands: Sequence[tuple[float, str]],
    top: str,
    composite: tuple[float, float],
    preferred: int,
) -> DataFrame:
    """Blend the longest forecast with the static baseline, more baseline for longer horizons."""
    contracts.require_columns(
        assessment,
        ["state", "district", "horizon_days", "valid_from"]
        + [f"{h}_{f}" for h in hazards for f in ("weather_risk_score", "susceptibility")],
    )
    base = longest_horizon(assessment, preferred)
    horizons = F.explode(
        F.array(
            *[
                F.struct(F.lit(d).alias("days"), F.lit(float(w)).alias("weight"))
                for d, w in weights.items()
            ]
        )
    )
    spread = base.withColumn("_h", horizons).withColumns(
        {"outlook_horizon_days": F.col("_h.days"), "forecast_weight": F.col("_h.weight")}
    )
    columns = {"historical_weight": 1.0 - F.col("forecast_weight")}
    for h in hazards:
        blended = F.col("forecast_weight") * F.col(f"{h}_weather_risk_score") + (
            1.0 - F.col("forecast_weight")
        ) * 100.0 * F.col(f"{h}_susceptibility")
        limited = F.when(blended.isNotNull(), F.least(F.greatest(blended, F.lit(0.0)), F.lit(100.0)))
        columns[f"{h}_outlook_score"] = scoring.half_even(limited, 1)
    scored = spread.withColumns(columns)
    names = [F.col(f"{h}_outlook_score") for h in hazards]
    whole = composite[0] * scoring.largest(names) + composite[1] * scoring.mean_of_present(names)
    return (
        scored.withColumn("composite_risk_score", scoring.half_even(whole, 1))
        .withColumns(
            {
                "composite_risk_level": scoring.level("composite_risk_score", bands, top),
                "dominant_hazard": scoring.dominant(
                    [(h.upper(), F.col(f"{h}_outlook_score")) for h in hazards]
                ),
                "valid_to": F.date_add("valid_from", F.col("outlook_horizon_days") - 1),
                **{
                    f"{h}_outlook_level": scoring.level(f"{h}_outlook_score", bands, top)
                    for h in hazards
                },
            }
        )
        .drop("_h")
    )


def require_fresh(frame: DataFrame, collected: str, now, limit_hours: float) -> DataFrame:
    """Raise when the newest row is older than the limit."""
    age = frame.agg(scoring.age_hours(F.max(collected), now).alias("age")).first()["age"]
    if age is None or age > limit_hours:
        raise contracts.ContractError(f"stale forecast: {age} hours old, limit {limit_hours}")
    return frame


def nested_report(
    frame: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str], digits: int
) -> DataFrame:
    """One row per key with its few ordered rows as an array of structs; NaN becomes null."""

    def clean(name: str) -> Column:
        kind = frame.schema[name].dataType.typeName()
        if kind in ("double", "float"):
            value = F.when(~F.isnan(name), F.col(name))
            return (scoring.half_even(value, digits) + 0.0).alias(name)
        return F.col(name)

    row = F.struct(order, *[clean(name) for name in fields])
    return frame.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"))


def hazards_long(frame: DataFrame, keys: Sequence[str], hazards: Sequence[str]) -> DataFrame:
    """Wide score and level columns as one row per hazard."""
    rows = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(h).alias("hazard"),
                    F.col(f"{h}_weather_risk_score").alias("score"),
                    F.col(f"{h}_risk_level").alias("level"),
                )
                for h in hazards
            ]
        )
    )
    return frame.select(*keys, rows)


def top_positives(frame: DataFrame, hazard: str, rows: int, order: Sequence) -> DataFrame:
    """Most probable positive predictions of one hazard."""
    return (
        frame.where(F.col(f"{hazard}_prediction") == 1)
        .orderBy(F.desc(f"{hazard}_probability"), *order)
        .limit(rows)
    )


def top_with_fallback(
    frame: DataFrame, preferred: Column, rows: int, order: Sequence
) -> DataFrame:
    """Top rows among the preferred ones; among all rows when none is preferred."""
    any_preferred = frame.agg(F.bool_or(F.coalesce(preferred, F.lit(False))).alias("any"))
    eligible = F.coalesce(preferred, F.lit(False)) | ~F.coalesce(any_preferred.scalar(), F.lit(False))
    return frame.where(eligible).orderBy(*order).limit(rows)


def most_common(frame: DataFrame, column: str) -> DataFrame:
    """The most frequent value, the smallest one on a tie."""
    counts = frame.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(1)


def per_hazard_top(frame: DataFrame, hazard: str, rows: int, order: Sequence) -> DataFrame:
    return dedupe.top_per_group(frame, [hazard], order, rows)


def search_all(frame: DataFrame, pattern: str) -> DataFrame:
    """Rows with a case-insensitive match in any column."""
    everything = F.concat_ws("\u0001", *[F.col(name).cast("string") for name in frame.columns])
    return frame.where(everything.rlike(f"(?i){pattern}"))


def ordered_columns(frame: DataFrame, groups: Sequence[Sequence[str]]) -> DataFrame:
    """Listed columns first, in the order of the groups, then the rest as they were."""
    first = [n for group in groups for n in group if n in frame.columns]
    return frame.select(*first, *[n for n in frame.columns if n not in first])
