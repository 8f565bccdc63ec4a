"""Combine series of several providers on one grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane import contracts
from terravane.functions import calendar, grid
from terravane.operators import dedupe

KEYS = ("latitude", "longitude", "valid_date")


def on_grid(frame: DataFrame, resolution: float) -> DataFrame:
    """Coordinates snapped to the grid and time cut to the day."""
    return frame.withColumns(
        {
            "latitude": grid.snap("latitude", resolution),
            "longitude": grid.snap("longitude", resolution),
            "valid_date": F.to_date("valid_date"),
        }
    )


def mean_per_cell(frame: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    if not values:
        raise contracts.ContractError("no value column to average")
    contracts.require_columns(frame, [*keys, *values])
    return frame.groupBy(*keys).agg(*[F.avg(name).alias(name) for name in values])


def inner_fusion(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows both providers have, one per key (the first in the order of the remaining columns).

    Providers without a common key are an error, and so is a common key without a value.
    """
    joined = left.join(right, list(keys), "inner")
    rest = [name for name in joined.columns if name not in keys]
    single = dedupe.keep_first(contracts.assert_not_empty(joined, "the common part of the providers"), keys, rest)
    return single.select(*keys, *[contracts.never_null(name, "fused table") for name in rest])


def priority_fusion(
    primary: DataFrame,
    secondary: DataFrame,
    primary_value: str,
    secondary_value: str,
    value: str,
    tags: tuple[str, str],
    order: Sequence[str],
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Every primary key once; the secondary mean wins where it exists, and a tag says which.

    A fused row without a key or without a value from either side stops the job.
    """
    kept = dedupe.keep_first(primary, keys, order)
    averaged = mean_per_cell(secondary, keys, [secondary_value])
    joined = kept.join(averaged, list(keys), "left")
    chosen = F.coalesce(F.col(secondary_value), F.col(primary_value))
    tag = F.when(F.col(secondary_value).isNotNull(), tags[1]).otherwise(tags[0])
    fused = joined.withColumns({value: chosen, f"{value}_source": tag}).drop(primary_value, secondary_value)
    return fused.withColumns({name: contracts.never_null(name, "fused table") for name in (*keys, value)})


def coverage(frame: DataFrame, day: str = "valid_date", minimum: float = 0.95) -> DataFrame:
    """Distinct days observed per year against the length of that year."""
    years = frame.groupBy(F.year(day).alias("year")).agg(
        F.countDistinct(F.to_date(day)).alias("observed_days")
    )
    expected = calendar.days_in_year("year")
    return years.withColumns(
        {
            "expected_days": expected,
            "complete": F.col("observed_days") >= expected * minimum,
        }
    )


def compare_series(
    frame: DataFrame, by: Sequence, candidate: str, reference: str
) -> DataFrame:
    """Days, correlation, mean absolute error, bias and totals of two paired series."""
    a, b = F.col(candidate), F.col(reference)
    both = a.isNotNull() & b.isNotNull()
    paired = [F.when(both, c) for c in (a, b)]
    difference = paired[0] - paired[1]
    return frame.groupBy(*by).agg(
        F.count_if(both).alias("days"),
        F.corr(*paired).alias("correlation"),
        F.avg(F.abs(difference)).alias("mean_absolute_error"),
        F.avg(difference).alias("bias"),
        F.sum(paired[0]).alias("candidate_total"),
        F.sum(paired[1]).alias("reference_total"),
    )


def normals(
    frame: DataFrame, cell: Sequence[str], day: str, means: Sequence[str], p95: Sequence[str]
) -> DataFrame:
    """Yearly statistics per cell, then the plain mean of the years."""
    yearly = frame.groupBy(*cell, F.year(day).alias("_year")).agg(
        *[F.avg(name).alias(f"{name}_mean") for name in means],
        *[F.percentile(name, F.lit(0.95)).alias(f"{name}_p95") for name in p95],
    )
    names = [f"{n}_mean" for n in means] + [f"{n}_p95" for n in p95]
    return yearly.groupBy(*cell).agg(
        *[F.avg(name).alias(name) for name in names], F.count(F.lit(1)).alias("years")
    )


def attach_to_places(
    series: DataFrame, places: DataFrame, resolution: float, place: Sequence[str]
) -> DataFrame:
    """Series of the grid cell each place falls in; several places may share a cell."""
    snapped = places.select(
        *place,
        grid.snap("latitude", resolution).alias("latitude"),
        grid.snap("longitude", resolution).alias("longitude"),
    )
    return series.join(snapped, ["latitude", "longitude"], "inner")


def zero_filled(frame: DataFrame, year: Column, kind: str, kinds: Sequence[str]) -> DataFrame:
    """Counts per year and kind for every year between the first and the last."""
    counts = frame.groupBy(year.alias("year"), F.col(kind).alias("kind")).agg(
        F.count(F.lit(1)).alias("found")
    )
    span = counts.agg(F.sequence(F.min("year"), F.max("year")).alias("years"))
    grid_rows = span.select(F.explode("years").alias("year")).select(
        "year", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind")
    )
    return grid_rows.join(counts, ["year", "kind"], "left").select(
        "year", "kind", F.coalesce("found", F.lit(0)).cast("long").alias("events")
    )
