"""Checks a layer must pass before the next one reads it."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table does not have the shape its consumer needs."""


def require_columns(frame: DataFrame, names: Iterable[str]) -> DataFrame:
    missing = [name for name in names if name not in frame.columns]
    if missing:
        raise ContractError("missing columns: " + ", ".join(missing))
    return frame


def duplicate_keys(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys seen more than once, with how often."""
    return (
        frame.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
    )


def assert_unique_key(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    example = duplicate_keys(frame, keys).limit(1).take(1)
    if example:
        raise ContractError(f"key {tuple(keys)} is not unique: {example[0].asDict()}")
    return frame


def null_counts(frame: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One row: how many nulls each column holds."""
    return frame.agg(
        *[F.count_if(F.col(name).isNull()).alias(name) for name in names or frame.columns]
    )


def assert_no_nulls(frame: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    counts = null_counts(frame, names).first().asDict()
    bad = {name: n for name, n in counts.items() if n}
    if bad:
        raise ContractError(f"null values: {bad}")
    return frame


def never_null(column: str, what: str) -> Column:
    """The column itself; a row without a value stops the job that reads it."""
    message = F.lit(f"{what}: {column} is null")
    return F.when(F.col(column).isNull(), F.raise_error(message)).otherwise(F.col(column)).alias(column)


def assert_not_empty(frame: DataFrame, what: str) -> DataFrame:
    if frame.isEmpty():
        raise ContractError(f"{what} is empty")
    return frame


def probability_violations(
    frame: DataFrame, hazards: Sequence[str], optional: Sequence[str] = ()
) -> DataFrame:
    """Per hazard: predictions outside {0,1}, probabilities outside [0,1], nulls where not allowed."""
    parts = []
    for hazard in hazards:
        prediction, probability = F.col(f"{hazard}_prediction"), F.col(f"{hazard}_probability")
        allowed_null = F.lit(hazard in optional)
        parts.append(
            F.struct(
                F.lit(hazard).alias("hazard"),
                F.count_if(~F.coalesce(prediction.isin(0, 1), F.lit(False))).alias("bad_predictions"),
                F.count_if(~F.coalesce(probability.between(0.0, 1.0), F.lit(True))).alias("out_of_range"),
                F.count_if(probability.isNull() & ~allowed_null).alias("unexpected_nulls"),
            )
        )
    return frame.agg(F.array(*parts).alias("rows")).select(F.inline("rows"))


def check_probabilities(
    frame: DataFrame, hazards: Sequence[str], optional: Sequence[str] = ()
) -> DataFrame:
    bad = probability_violations(frame, hazards, optional).where(
        "bad_predictions + out_of_range + unexpected_nulls > 0"
    )
    rows = bad.take(len(hazards))
    if rows:
        raise ContractError(f"probability contract: {[row.asDict() for row in rows]}")
    return frame


def all_of(conditions: Sequence[Column]) -> Column:
    """Conjunction in which an unknown counts as not met."""
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in conditions])
