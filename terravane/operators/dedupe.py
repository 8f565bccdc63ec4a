"""Keep one row per key, find repeated keys, merge new rows by id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.contracts import duplicate_keys

__all__ = ["duplicate_keys", "keep_first", "keep_last", "top_per_group", "distinct_by"]


def top_per_group(
    frame: DataFrame, by: Sequence, order: Sequence[Column | str], rows: int
) -> DataFrame:
    """First ``rows`` rows of each group.

    Spark limits every group inside each input task before the shuffle, so a
    group holding a third of the table sends only ``rows`` rows per task.
    """
    spot = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return frame.withColumn("_spot", spot).where(F.col("_spot") <= rows).drop("_spot")


def keep_first(frame: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return top_per_group(frame, keys, order, 1)


def keep_last(frame: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return top_per_group(frame, keys, [F.col(name).desc() for name in order], 1)


def distinct_by(frame: DataFrame, *key_sets: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Drop repeats by the first key set, then among what is left by the next one."""
    for keys in key_sets:
        frame = keep_first(frame, keys, order)
    return frame
