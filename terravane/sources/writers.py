"""Writers: snapshots, yearly partitions, CSV extracts, run summaries and upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from terravane.operators import dedupe


def snapshot(frame: DataFrame, path: str, compression: str = "zstd") -> str:
    """Replace a whole table; the commit protocol makes it appear at once."""
    frame.write.mode("overwrite").option("compression", compression).parquet(path)
    return path


def yearly(frame: DataFrame, path: str, day: str) -> str:
    """One folder per year; only the years present in ``frame`` are replaced.

    Rows are gathered by year and month first, so a year is written by up to twelve
    tasks with a file each, not by every task.
    """
    dated = frame.withColumn("year", F.year(day))
    gathered = dated.repartition("year", F.month(day))
    (
        gathered.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("year")
        .parquet(path)
    )
    return path


def csv(frame: DataFrame, path: str) -> str:
    frame.write.mode("overwrite").option("header", True).csv(path)
    return path


def run_summary(frame: DataFrame, path: str, measures: Sequence[Column]) -> DataFrame:
    """Counts of a run as one JSON record; returns the record."""
    frame.agg(*measures).write.mode("overwrite").json(path)
    return frame.sparkSession.read.json(path)


def exists(frame: DataFrame, path: str) -> bool:
    """Whether a table is stored at the path, on whatever file system the path names."""
    spark = frame.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def append_new(
    frame: DataFrame, path: str, identity: str, order: Sequence, unit: str | None = None
) -> int:
    """Append rows whose id is not stored yet, one per id; returns how many were added.

    With ``unit``, the table is partitioned by that column and ids are unique within a unit, so only
    the stored ids of the batch's own units are read.
    """
    spark, keys = frame.sparkSession, [unit, identity] if unit else [identity]
    fresh = dedupe.keep_first(frame, keys, order)
    if exists(frame, path):
        stored = spark.read.schema(frame.schema).parquet(path).select(*keys)
        if unit:
            stored = stored.join(frame.select(unit).distinct(), unit, "left_semi")
        fresh = fresh.join(stored, keys, "left_anti")
    added = Observation()
    writer = fresh.observe(added, F.count(F.lit(1)).alias("rows")).write.mode("append")
    (writer.partitionBy(unit) if unit else writer).parquet(path)
    return added.get["rows"]
