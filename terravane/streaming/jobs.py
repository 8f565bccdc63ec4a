"""Structured Streaming jobs: the incremental side of the batch operators.

Every job reads a stream, writes to a folder and keeps its progress in a checkpoint folder.
Run with ``once`` it processes everything that is new and stops.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from terravane.operators import dedupe
from terravane.sources import writers


def files(spark: SparkSession, path: str, schema: StructType, per_batch: int | None = None) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(path)


def once(stream: DataFrame, path: str, checkpoint: str, settings: Mapping[str, str] | None = None) -> DataFrame:
    """Process what is new, append finished rows to ``path``, stop; returns the table.

    ``settings`` hold for this query alone.
    """
    conf, before = stream.sparkSession.conf, {}
    for name, value in (settings or {}).items():
        before[name] = conf.get(name, None)
        conf.set(name, value)
    try:
        query = (
            stream.writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def once_per_batch(
    stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> None:
    """Process what is new with a batch function, stop."""
    query = (
        stream.writeStream.foreachBatch(work)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def unique_by_id(stream: DataFrame, identity: str, time: str, delay: str) -> DataFrame:
    """First row of each id; a repeat may come up to ``delay`` later."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([identity])


def daily(stream: DataFrame, keys: Sequence[str], time: str, delay: str, measures: Sequence[Column]) -> DataFrame:
    """Calendar day totals, given out once the day can no longer change."""
    return (
        stream.withWatermark(time, delay)
        .groupBy(*keys, F.window(time, "1 day").alias("_w"))
        .agg(*measures)
        .withColumn("valid_date", F.to_date("_w.start"))
        .drop("_w")
    )


def sliding(
    stream: DataFrame, keys: Sequence[str], time: str, delay: str, days: int, measures: Sequence[Column]
) -> DataFrame:
    """Totals of the last ``days`` calendar days, one per day."""
    return (
        stream.withWatermark(time, delay)
        .groupBy(*keys, F.window(time, f"{days} days", "1 day").alias("_w"))
        .agg(*measures)
        .withColumn("last_date", F.date_sub(F.to_date("_w.end"), 1))
        .drop("_w")
    )


def spells(
    stream: DataFrame, keys: Sequence[str], time: str, delay: str, gap_days: int, measures: Sequence[Column]
) -> DataFrame:
    """Runs of rows no more than ``gap_days`` apart, given out when they are over."""
    return (
        stream.withWatermark(time, delay)
        .groupBy(*keys, F.session_window(time, f"{gap_days} days").alias("_w"))
        .agg(*measures, F.min(time).alias("first_time"), F.max(time).alias("last_time"))
        .drop("_w")
    )


#: State that a processor reads by name lives in RocksDB.
KEYED_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}


def _missing(amount: float | None) -> bool:
    return amount is None or math.isnan(amount)


def advance(past: tuple, amount: float | None, wet: float, alpha: float) -> tuple:
    """(streak, index, weight) after one more day; weights go by position, as in the batch index."""
    streak, index, weight = past
    if _missing(amount):
        return 0, index, weight * (1.0 - alpha) if index is not None else 1.0
    streak = streak + 1 if amount >= wet else 0
    if index is None:
        return streak, amount, 1.0
    weight *= 1.0 - alpha
    return streak, (weight * index + alpha * amount) / (weight + alpha), 1.0


class RunningSeries(StatefulProcessor):
    """Streak and decayed index of one cell, with all its days at hand for when a late one comes.

    In order, a batch costs three calls to the state however many days it holds.  A day at or
    before the last one is put in its place and the days from there on are given out again.
    """

    def __init__(self, day: str, value: str, wet: float, alpha: float):
        self.day, self.value, self.wet, self.alpha = day, value, wet, alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState(
            "last", "day DATE, streak INT, wetness DOUBLE, weight DOUBLE, revision INT"
        )
        self.days = handle.getListState("days", "day DATE, amount DOUBLE")

    @staticmethod
    def _merged(days: Iterable[tuple]) -> dict:
        """One amount a day, the smaller one of those that are present."""
        found: dict = {}
        for day, amount in days:
            amount = None if _missing(amount) else float(amount)
            other = found.get(day)
            found[day] = amount if other is None else other if amount is None else min(other, amount)
        return found

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = self._merged((d, a) for part in rows for d, a in zip(part[self.day], part[self.value]))
        # one call to the state: nothing is there before the first batch
        last, *past, revision = self.last.get() or (None, 0, None, 1.0, 0)
        first = min(came)
        if last is None or first > last:
            days = sorted(came.items())
            self.days.appendList(days)
            given_from = first
        else:
            # the late days take their places, and the cell is counted from its first day again
            days = sorted(self._merged([*self.days.get(), *came.items()]).items())
            self.days.put(days)
            past, given_from = (0, None, 1.0), first
        out = []
        for day, amount in days:
            past = advance(tuple(past), amount, self.wet, self.alpha)
            if day >= given_from:
                out.append((key[0], day, amount, past[0], past[1], revision + 1))
        self.last.update((days[-1][0], *past, revision + 1))
        cells, given, values, streaks, indices, revisions = zip(*out)
        # typed at once: a small frame per cell costs more to convert than to fill
        yield pd.DataFrame(
            {
                "cell": cells,
                "day": given,
                "value": np.array(values, dtype="float64"),
                "wet_streak": np.array(streaks, dtype="int32"),
                "wetness": np.array(indices, dtype="float64"),
                "revision": np.array(revisions, dtype="int32"),
            }
        )

    def close(self) -> None:
        pass


def running_series(stream: DataFrame, cell: str, day: str, value: str, wet: float, alpha: float) -> DataFrame:
    """Wet streak and decayed wetness index per cell, carried from one run to the next.

    The stream holds cells' days in any order; run it with ``KEYED_STATE``.  A missing amount (null or
    NaN) ends the streak, keeps the index and ages the history.  A day that comes late changes all
    days after it: they are given out anew with a higher ``revision``, and ``newest`` keeps the last
    word on each day.  A day given twice counts once, with its smaller value.
    """
    kind = stream.schema[cell].dataType.simpleString()
    given = stream.select(cell, F.col(day).alias("day"), F.col(value).cast("double").alias("value"))
    found = given.groupBy(cell).transformWithStateInPandas(
        RunningSeries("day", "value", wet, alpha),
        f"cell {kind}, day DATE, value DOUBLE, wet_streak INT, wetness DOUBLE, revision INT",
        "Append",
        "None",
    )
    amount, index = (F.when(~F.isnan(c), F.col(c)) for c in ("value", "wetness"))
    return found.select(
        F.col("cell").alias(cell), F.col("day").alias(day), amount.alias(value), "wet_streak", index.alias("wetness"), "revision"
    )


def newest(stored: DataFrame, cell: str, day: str) -> DataFrame:
    """The last revision of each cell's days."""
    rest = [c for c in stored.columns if c not in (cell, day, "revision")]
    last = F.max_by(F.struct(*rest), "revision").alias("_r")
    return stored.groupBy(cell, day).agg(last).select(cell, day, "_r.*")


def against_alerts(stream: DataFrame, alerts: DataFrame, keys: Sequence[str], default: Column) -> DataFrame:
    """Each arriving row with the alert state of a static snapshot."""
    return stream.join(alerts, list(keys), "left").withColumn("alert", F.coalesce("alert", default))


#: Phases of a unit's ledger entry, in order.
INTENT, COMMIT = 0, 1


def _append(frame: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    frame.write.mode("append").partitionBy(*by).parquet(path)


def ledger_state(book: DataFrame, unit: str) -> DataFrame:
    """The newest entry of each unit: sequence, phase, rows, schema, batch."""
    newest_entry = F.max(F.struct("sequence", "phase", "rows", "schema", "batch")).alias("_n")
    return book.groupBy(unit).agg(newest_entry).select(unit, "_n.*")


def ingest_units(
    unit: str, order: Sequence[str], table: str, ledger: str, expected: DataFrame | None = None
) -> Callable[[DataFrame, int], None]:
    """Batch function that adds each row of a unit once, in however many batches it arrives.

    The ledger is written in two phases: before the data an intent per unit, after it the unit's
    total row count and schema as commit.  Rows are compared with what the table holds whenever
    there is a table, whatever the ledger says, so a batch that died between any two writes, or in
    the middle of one, adds on replay what is missing and nothing twice.  The table is partitioned
    by unit, so only the units of a batch are read.  ``expected`` (unit, rows) names full units: one
    whose newest entry is a commit of that count with the batch's schema is skipped unread.
    """

    def work(batch: DataFrame, number: int) -> None:
        spark, shape = batch.sparkSession, batch.schema.simpleString()
        fresh, sequence = batch, 1
        if writers.exists(batch, ledger):
            book = spark.read.schema(f"`{unit}` {batch.schema[unit].dataType.simpleString()}, {ENTRY}").parquet(ledger)
            sequence += book.agg(F.max("sequence")).first()[0] or 0
            if expected is not None:
                full = ledger_state(book, unit).where((F.col("phase") == COMMIT) & (F.col("schema") == shape)).join(
                    expected.select(F.col(unit), F.col("rows").alias("_all")), unit
                )
                fresh = fresh.join(full.where(F.col("rows") == F.col("_all")).select(unit), unit, "left_anti")
        units = fresh.select(unit).distinct()

        def entry(rows: DataFrame, phase: int) -> DataFrame:
            return rows.select(
                unit, F.col("rows").cast("long"), F.lit(shape).alias("schema"), F.lit(number).cast("long").alias("batch"),
                F.lit(sequence).cast("long").alias("sequence"), F.lit(phase).alias("phase"),
            )

        _append(entry(units.withColumn("rows", F.lit(None)), INTENT), ledger)
        adds = dedupe.keep_first(fresh, [unit, "_row_id"], order)
        if writers.exists(batch, table):
            stored = spark.read.schema(batch.schema).parquet(table).select(unit, "_row_id")
            here = stored.join(units, unit, "left_semi")
            adds = adds.join(here, [unit, "_row_id"], "left_anti")
        _append(adds, table, [unit])
        # totals of the intended units as stored now; what is stored no longer counts as new
        intended = spark.read.schema(f"`{unit}` {batch.schema[unit].dataType.simpleString()}, {ENTRY}").parquet(ledger)
        intended = intended.where(F.col("sequence") == sequence).select(unit)
        totals = (
            spark.read.schema(batch.schema)
            .parquet(table)
            .join(intended, unit, "left_semi")
            .groupBy(unit)
            .agg(F.count(F.lit(1)).alias("rows"))
        )
        _append(entry(totals, COMMIT), ledger)

    return work


ENTRY = "rows LONG, schema STRING, batch LONG, sequence LONG, phase INT"


def prefer_final(final: DataFrame, late: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Final rows, and late rows only where no final one exists, each with its product tag."""
    missing = late.join(final.select(*keys), list(keys), "left_anti")
    return final.withColumn("product", F.lit("FINAL")).unionByName(
        missing.withColumn("product", F.lit("LATE"))
    )


def freshness(stream: DataFrame, time: str, checkpoint: str, path: str) -> DataFrame:
    """Process what is new; rows and newest event time (microseconds) of every batch, one row each.

    Every batch has a folder of its own, which a replayed batch writes again, so totals of any
    number of batches are kept and none is counted twice.
    """

    def tally(batch: DataFrame, number: int) -> None:
        totals = batch.agg(F.count(F.lit(1)).alias("rows"), F.unix_micros(F.max(time)).alias("newest_us"))
        totals.write.mode("overwrite").parquet(f"{path}/batch={number}")

    once_per_batch(stream, tally, checkpoint)
    return stream.sparkSession.read.schema("rows LONG, newest_us LONG, batch LONG").parquet(path)
