"""Attach event records to daily series, on the day and ahead of it.

Every time condition is a bounded number of days, so events are exploded to
days and joined on equal keys.  Exploded rows are aggregated to one row per
series key and day before they meet the series.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_range(day, back: Column | int, ahead: Column | int) -> Column:
    back, ahead = (F.lit(v) if isinstance(v, int) else v for v in (back, ahead))
    return F.sequence(F.date_sub(F.col(day), back), F.date_add(F.col(day), ahead))


def event_group(source_id: str, event_id: str) -> Column:
    """The identifier of the source when there is one, else the own one."""
    trimmed = F.trim(F.coalesce(F.col(source_id), F.lit("")).cast("string"))
    return F.when(trimmed != "", trimmed).otherwise(
        F.trim(F.coalesce(F.col(event_id).cast("string"), F.lit("")))
    )


def label_days(
    series: DataFrame,
    events: DataFrame,
    windows: Mapping[str, int],
    cell: Sequence[str],
    day: str,
    order: str,
) -> DataFrame:
    """0/1 label and event group per hazard for days within the hazard's window of an event.

    ``events`` carries the cell columns, ``event_date``, ``hazard_type``, ``event_group``
    and a unique ``order``; where events overlap the last one names the group.
    """
    width = F.element_at(F.create_map(*[F.lit(x) for kv in windows.items() for x in kv]), F.col("hazard_type"))
    spread = (
        events.where(F.col("hazard_type").isin(*windows))
        .withColumn(day, F.explode(day_range("event_date", width, width)))
        .groupBy(*cell, day)
        .agg(
            *[
                F.max_by(
                    F.when(F.col("hazard_type") == h, F.col("event_group")),
                    F.when(F.col("hazard_type") == h, F.col(order)),
                ).alias(f"{h}_event_group")
                for h in windows
            ]
        )
    )
    joined = series.join(spread, [*cell, day], "left")
    columns = {}
    for h in windows:
        columns[f"{h}_risk"] = F.col(f"{h}_event_group").isNotNull().cast("int")
        columns[f"{h}_event_group"] = F.coalesce(f"{h}_event_group", F.lit(""))
    return joined.withColumns(columns)


def lead_keys(
    events: DataFrame, horizon: int, key: Sequence[str], day: str
) -> DataFrame:
    """Issue days before each event: one row per key, day, hazard and group, smallest lead kept."""
    return (
        events.select(
            *key, "hazard_type", "event_group", "event_date",
            F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("lead_days"),
        )
        .withColumn(day, F.date_sub("event_date", F.col("lead_days")))
        .groupBy(*key, day, "hazard_type", "event_group")
        .agg(F.min("lead_days").alias("lead_days"))
    )


def _field(name: str):
    return lambda day: day[name]


def _within(days: str, groups: str, horizon: int) -> Column:
    """Of the days ahead those within the horizon that have groups of a hazard."""
    return F.filter(days, lambda d: (d["at"] <= F.col("_now") + horizon) & (F.size(d[groups]) > 0))


def future_targets(
    series: DataFrame,
    events: DataFrame,
    hazards: Sequence[str],
    horizons: Sequence[int],
    key: Sequence[str],
    day: str,
) -> DataFrame:
    """Targets for every hazard and horizon.

    Events and series rows meet once, aggregated to one row per key and day; a window over the key's
    days, bounded by the calendar, then looks ahead, so no event is repeated for the days before it.
    """
    key, longest = list(key), max(horizons)
    rest = [c for c in series.columns if c not in (*key, day)]
    own = F.struct(F.lit(True).alias("_one"), *rest)
    kind = series.select(own.alias("_own")).schema["_own"].dataType
    happened = events.where(F.col("hazard_type").isin(*hazards)).dropna(subset=[*key, "event_date"])
    mixed = series.select(*key, day, own.alias("_own"), *[F.lit(None).cast("string").alias(f"_{h}") for h in hazards]).unionByName(
        happened.select(
            *key,
            F.to_date("event_date").cast(series.schema[day].dataType).alias(day),
            F.lit(None).cast(kind).alias("_own"),
            # an event without a group still counts as one
            *[F.when(F.col("hazard_type") == h, F.concat(F.lit("g"), F.coalesce(F.col("event_group").cast("string"), F.lit("")))).alias(f"_{h}") for h in hazards],
        )
    )
    daily = mixed.groupBy(*key, day).agg(
        F.collect_list("_own").alias("_rows"), *[F.collect_set(f"_{h}").alias(f"_{h}") for h in hazards]
    )
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    ahead = Window.partitionBy(*key).orderBy(number).rangeBetween(1, longest)
    busy = F.when(sum((F.size(f"_{h}") for h in hazards), F.lit(0)) > 0, F.struct(number.alias("at"), *[f"_{h}" for h in hazards]))
    seen = (
        daily.withColumns({"_ahead": F.collect_list(busy).over(ahead), "_now": number})
        .where(F.size("_rows") > 0)
        .select(*key, day, "_ahead", "_now", F.explode("_rows").alias("_own"))
    )
    columns = []
    for hazard in hazards:
        for horizon in horizons:
            inside = _within("_ahead", f"_{hazard}", horizon)
            groups = F.array_distinct(F.flatten(F.transform(inside, _field(f"_{hazard}"))))
            lead = F.array_min(F.transform(inside, _field("at"))) - F.col("_now")
            named = F.filter(F.transform(groups, lambda g: F.substring(g, 2, 1 << 30)), lambda g: g != "")
            columns += [
                F.array_join(F.array_sort(named), "|").alias(f"{hazard}_group_{horizon}d"),
                lead.alias(f"{hazard}_lead_{horizon}d"),
                lead.isNotNull().cast("int").alias(f"{hazard}_risk_{horizon}d"),
            ]
    return seen.select(*key, day, *[F.col(f"_own.{c}").alias(c) for c in rest], *columns)


def target_summary(targets: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows and positive rows of each 0/1 target column."""
    return targets.agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(name).alias(name) for name in names]
    ).unpivot(["rows"], list(names), "target", "positive_rows")


def distinct_ids(frame: DataFrame, column: str, separator: str = "|") -> DataFrame:
    """How many different non-empty ids a delimited text column names."""
    ids = frame.select(F.explode(F.split(column, f"[{separator}]")).alias("id")).where("id <> ''")
    return ids.agg(F.countDistinct("id").alias("distinct_ids"))
