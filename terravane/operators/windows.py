"""Per-cell time series operators.

A cell holds at most one row per day, so a window partition is bounded by the
length of the calendar and never by the number of raw readings behind it.  All
functions share one partitioning and one ordering, so Spark plans a single
exchange and a single sort for any mix of them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from terravane.functions import as_column
from terravane.session import shuffle_width


@dataclass(frozen=True)
class SeriesKey:
    """What identifies a series and what orders it."""

    cell: tuple[str, ...] = ("latitude", "longitude")
    day: str = "valid_date"

    def order(self) -> WindowSpec:
        return Window.partitionBy(*self.cell).orderBy(self.day)

    def trailing(self, rows: int) -> WindowSpec:
        return self.order().rowsBetween(-(rows - 1), 0)

    def following(self, rows: int) -> WindowSpec:
        return self.order().rowsBetween(1, rows)

    def running(self) -> WindowSpec:
        return self.order().rowsBetween(Window.unboundedPreceding, 0)

    def monthly(self) -> WindowSpec:
        return Window.partitionBy(*self.cell, F.month(self.day))


def dealt(frame: DataFrame, key: SeriesKey) -> DataFrame:
    """Whole series dealt over at least eight tasks a core, each of which then sorts few rows at a time."""
    spark = frame.sparkSession
    return frame.repartition(max(shuffle_width(spark), 8 * spark.sparkContext.defaultParallelism), *key.cell)


def _not_nan(value) -> Column:
    value = as_column(value).cast("double")
    return F.when(~F.isnan(value), value)


def _windowed(key: SeriesKey, value, rows: int) -> tuple[Column, Column]:
    """Sum and count of the non-null values in the trailing frame, added up row by row.

    One expression, for short frames; ``rolling`` builds long ones from blocks.
    """
    value, frame = _not_nan(value), key.trailing(rows)
    return F.sum(value).over(frame), F.count(value).over(frame)


def rolling_sum(key: SeriesKey, value, rows: int) -> Column:
    return _windowed(key, value, rows)[0]


def rolling_mean(key: SeriesKey, value, rows: int) -> Column:
    total, count = _windowed(key, value, rows)
    return F.when(count > 0, total / count)


def rolling_max(key: SeriesKey, value, rows: int) -> Column:
    return F.max(as_column(value)).over(key.trailing(rows))


#: Rows of the smallest block; each larger block is made of as many smaller ones.
BLOCK_ROWS = 8


@dataclass(frozen=True)
class Rolling:
    """A trailing ``sum``, ``mean`` or ``anomaly`` (value less mean) of a column over ``rows`` rows."""

    kind: str
    value: str
    rows: int


def rolling(frame: DataFrame, key: SeriesKey, wanted: Mapping[str, Rolling]) -> DataFrame:
    """Adds trailing sums, means and anomalies over frames of any length.

    Every row first carries the sum of the block of ``BLOCK_ROWS`` rows that ends with it, then that
    of the block of ``BLOCK_ROWS`` such blocks, and so on.  A frame is a few whole blocks, picked at
    their distance from the row, and a ragged rest of fewer than ``BLOCK_ROWS`` rows.  So a frame of n
    rows costs about log(n) steps a row, all frames of a column share the blocks, and all of it the
    one exchange and sort of the key.  Nothing is ever subtracted: a huge or infinite value leaves no
    trace in frames it is not in.  Nulls and NaN count as missing; a frame of them alone is null.
    """
    values = list(dict.fromkeys(w.value for w in wanted.values()))
    order, longest = key.order(), {v: max(w.rows for w in wanted.values() if w.value == v) for v in values}
    parts = {
        v: (f"_v{i}", f"_k{i}") for i, v in enumerate(values)
    }  # sum and count; missing values add nothing
    first = {}
    for v, (total, count) in parts.items():
        x = _not_nan(F.col(v))
        first |= {total: F.coalesce(x, F.lit(0.0)), count: F.when(x.isNull(), 0).otherwise(1)}
    work, sizes = frame.withColumns(first), [1]

    def back(name: str, rows: int) -> Column:
        return F.coalesce(F.lag(name, rows).over(order), F.lit(0)) if rows else F.col(name)

    while sizes[-1] * BLOCK_ROWS <= max(longest.values()):
        size, below = sizes[-1] * BLOCK_ROWS, sizes[-1]
        level = {}
        for v, names in parts.items():
            if longest[v] < size:
                continue
            for name in names:
                if below == 1:
                    level[f"{name}_{size}"] = F.sum(name).over(key.trailing(size))
                else:
                    steps = [back(f"{name}_{below}", below * i) for i in range(BLOCK_ROWS)]
                    level[f"{name}_{size}"] = sum(steps[1:], steps[0])
        work = work.withColumns(level)
        sizes.append(size)

    def framed(name: str, rows: int) -> Column:
        pieces, offset = [], 0
        for size in reversed(sizes[1:]):
            while rows - offset >= size:
                pieces.append(back(f"{name}_{size}", offset))
                offset += size
        if rows > offset:
            rest = F.sum(name).over(order.rowsBetween(1 - rows, -offset))
            pieces.append(F.coalesce(rest, F.lit(0)))
        return sum(pieces[1:], pieces[0])

    out = {}
    for name, w in wanted.items():
        total, count = (framed(part, w.rows) for part in parts[w.value])
        if w.kind == "sum":
            out[name] = F.when(count > 0, total)
        else:
            mean = F.when(count > 0, total / count)
            out[name] = mean if w.kind == "mean" else F.col(w.value) - mean
    helpers = [c for c in work.columns if c not in frame.columns]
    return work.withColumns(out).drop(*helpers)


def month_anomaly(key: SeriesKey, value) -> Column:
    """Departure from the cell's own mean for that calendar month over all years."""
    return as_column(value) - F.avg(as_column(value)).over(key.monthly())


def water_balance(frame: DataFrame, key: SeriesKey, gain: str, loss: str, rows: int, name: str) -> DataFrame:
    """Adds the trailing sum of ``gain`` less that of ``loss``."""
    summed = rolling(frame, key, {"_gain": Rolling("sum", gain, rows), "_loss": Rolling("sum", loss, rows)})
    return summed.withColumn(name, F.col("_gain") - F.col("_loss")).drop("_gain", "_loss")


# days folded at a time, so that the list of a cell's results is copied once per chunk
FOLD_CHUNK = 128


def decayed_index(frame: DataFrame, key: SeriesKey, value, alpha: float, name: str) -> DataFrame:
    """Adds the exponentially weighted index of each row's whole history, seeded with the first value.

    Weights go by position: a missing value (null or NaN) keeps the index and still ages the
    history, so ``0, null, 2`` at 0.5 ends at (0.25 * 0 + 0.5 * 2) / 0.75.  Rows before the first
    value have no index.  A cell's days are folded once, in order; nothing of the history is cut.
    """
    rest = [c for c in frame.columns if c not in (*key.cell, key.day)]
    packed = F.struct(key.day, _not_nan(value).alias("_x"), *rest)
    cells = frame.groupBy(*key.cell).agg(F.array_sort(F.collect_list(packed)).alias("_days"))
    keep, start = 1.0 - alpha, F.lit(None).cast("double")

    def step(state: Column, day: Column) -> Column:
        x, past, weight = day["_x"], state["y"], state["w"] * keep
        mixed = (weight * past + alpha * x) / (weight + alpha)
        y = F.when(x.isNull(), past).when(past.isNull(), x).otherwise(mixed)
        aged = F.when(x.isNotNull(), F.lit(1.0)).when(past.isNull(), F.lit(1.0)).otherwise(weight)
        return F.struct(y.alias("y"), aged.alias("w"), F.concat(state["out"], F.array(y)).alias("out"))

    def chunk(state: Column, at: Column) -> Column:
        empty = F.struct(
            state["y"].alias("y"), state["w"].alias("w"), F.array().cast("array<double>").alias("out")
        )
        done = F.aggregate(F.slice("_days", at * FOLD_CHUNK + 1, F.lit(FOLD_CHUNK)), empty, step)
        return F.struct(
            done["y"].alias("y"), done["w"].alias("w"), F.concat(state["out"], F.array(done["out"])).alias("out")
        )

    first = F.struct(
        start.alias("y"), F.lit(1.0).alias("w"), F.array().cast("array<array<double>>").alias("out")
    )
    chunks = F.sequence(F.lit(0), F.floor((F.size("_days") - 1) / FOLD_CHUNK).cast("int"))
    folded = F.flatten(F.aggregate(chunks, first, chunk, lambda state: state["out"]))
    rows = cells.select(
        *key.cell, F.explode(F.arrays_zip(F.col("_days").alias("day"), folded.alias("index"))).alias("_row")
    )
    return rows.select(
        *key.cell, f"_row.day.{key.day}", *[F.col(f"_row.day.`{c}`") for c in rest], F.col("_row.index").alias(name)
    )


def streak(frame: DataFrame, key: SeriesKey, flags: Mapping[str, Column]) -> DataFrame:
    """Length of the current run of true rows for every named flag.

    Rows since the last false row: two running windows over the same ordering.
    """
    numbered = frame.withColumn("_row", F.row_number().over(key.order()))
    runs = {}
    for name, flag in flags.items():
        holds = F.coalesce(flag, F.lit(False))
        last_break = F.max(F.when(~holds, F.col("_row"))).over(key.running())
        runs[name] = (F.col("_row") - F.coalesce(last_break, F.lit(0))).cast("int")
    return numbered.withColumns(runs).drop("_row")


def future_window(key: SeriesKey, value, rows: int, how: str = "sum") -> Column:
    """Aggregate of the next ``rows`` rows, null unless all of them exist."""
    value = as_column(value)
    reduce = {"sum": F.sum, "max": F.max, "min": F.min, "avg": F.avg}[how]
    frame = key.following(rows)
    return F.when(F.count(value).over(frame) == rows, reduce(value).over(frame))


def first_difference(key: SeriesKey, value) -> Column:
    value = as_column(value)
    return F.coalesce(value - F.lag(value).over(key.order()), F.lit(0.0))


def grouped_quantile(value, probability: float, by: Sequence) -> Column:
    """Interpolated quantile of a calendar-bounded group attached to each row."""
    return F.percentile(as_column(value), F.lit(probability)).over(
        Window.partitionBy(*[as_column(c) for c in by])
    )


def episodes(
    frame: DataFrame,
    key: SeriesKey,
    active: Column,
    max_gap_days: int,
    min_days: int,
    statistics: Mapping[str, Column],
) -> DataFrame:
    """Join active days no more than ``max_gap_days`` apart into episodes.

    An episode is kept when both its span and its number of active days reach ``min_days``.
    """
    days = frame.where(F.coalesce(active, F.lit(False)))
    gap = F.datediff(key.day, F.lag(key.day).over(key.order()))
    marked = days.withColumn("_starts", F.when(gap <= max_gap_days, 0).otherwise(1))
    numbered = marked.withColumn("episode", F.sum("_starts").over(key.running()))
    found = numbered.groupBy(*key.cell, "episode").agg(
        F.min(key.day).alias("first_day"),
        F.max(key.day).alias("last_day"),
        F.count(F.lit(1)).alias("active_days"),
        *[column.alias(name) for name, column in statistics.items()],
    )
    span = F.datediff("last_day", "first_day") + 1
    return (
        found.withColumn("span_days", span)
        .where((F.col("span_days") >= min_days) & (F.col("active_days") >= min_days))
    )


def rolling_features(
    frame: DataFrame,
    key: SeriesKey,
    sums: Mapping[str, Sequence[int]] | None = None,
    means: Mapping[str, Sequence[int]] | None = None,
    maxima: Mapping[str, Sequence[int]] | None = None,
    anomalies: Mapping[str, Sequence[int]] | None = None,
) -> DataFrame:
    """All rolling columns of a feature table in one pass: ``{column}_{n}d_{kind}``."""
    wanted = {
        f"{column}_{rows}d_{kind}": Rolling(kind, column, rows)
        for kind, columns in (("sum", sums), ("mean", means), ("anomaly", anomalies))
        for column, spans in (columns or {}).items()
        for rows in spans
    }
    highest = {
        f"{column}_{rows}d_max": rolling_max(key, column, rows)
        for column, spans in (maxima or {}).items()
        for rows in spans
    }
    rolled = rolling(frame, key, wanted) if wanted else frame
    return rolled.withColumns(highest) if highest else rolled


def short_history_features(
    frame: DataFrame, key: SeriesKey, value: str, rows: int, min_days: int
) -> DataFrame:
    """Rolling sum and anomaly, replaced by the value and zero in cells with too few days."""
    days = F.count(F.lit(1)).over(Window.partitionBy(*key.cell))
    rolled = rolling(frame, key, {"rolling": Rolling("sum", value, rows), "anomaly": Rolling("anomaly", value, rows)})
    short = F.col("history_days") < min_days
    return rolled.withColumn("history_days", days).withColumns(
        {
            "rolling": F.when(short, as_column(value)).otherwise(F.col("rolling")),
            "anomaly": F.when(short, F.lit(0.0)).otherwise(F.col("anomaly")),
        }
    )
