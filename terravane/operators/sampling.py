"""Deterministic samples and leakage-safe splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.operators import ranking
from terravane.session import cut_lineage


def hash_order(key: str, seed: int) -> Column:
    """A fixed pseudo-random order of rows with a unique key."""
    return F.xxhash64(F.col(key), F.lit(seed))


def downsample_negatives(
    frame: DataFrame, by: Sequence[str], target: str, order: str, least: int, times_positive: float
) -> DataFrame:
    """All positives; of the negatives the first max(least, times_positive x positives) per group.

    ``order`` is a numeric column that is unique within a group.  The cut-off value is found
    with exact distributed positions, so a group may hold any share of the table.
    """
    limits = frame.groupBy(*by).agg(
        F.greatest(F.lit(least), (F.count_if(F.col(target) == 1) * times_positive).cast("long")).alias("_limit")
    )
    negatives = frame.where(F.col(target) == 0)
    last = (
        ranking.positions(negatives, order, list(by))
        .join(limits, list(by))
        .where(F.col("below") < F.col("_limit"))
        .groupBy(*by)
        .agg(F.max(order).alias("_last"))
    )
    kept = frame.join(last, list(by), "left").where(
        (F.col(target) == 1) | ((F.col(target) == 0) & (F.col(order) <= F.col("_last")))
    )
    return kept.drop("_last")


def split_by_order(frame: DataFrame, order: str, train: float, validation: float) -> DataFrame:
    """First rows train, next rows validation, rest test; ``order`` is numeric and unique."""
    place = ranking.positions(frame.select(order), order).select(order, "below", "total")
    first = F.floor(F.col("total") * train)
    second = first + F.floor(F.col("total") * validation)
    name = F.when(F.col("below") < first, "train").when(F.col("below") < second, "validation").otherwise("test")
    return frame.join(place, order).withColumn("partition", name).drop("below", "total")


def _calendar(frame: DataFrame, day: str) -> DataFrame:
    """Distinct days; never longer than the calendar, whatever the size of the table."""
    return frame.select(F.to_date(day).alias("_day")).where("_day IS NOT NULL").distinct()


def split_by_date(frame: DataFrame, day: str, train: float, validation: float) -> DataFrame:
    """Whole days, oldest first; at least one day in each of train and validation."""
    days = _calendar(frame, day)
    numbered = days.withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_day")))
    total = days.agg(F.count(F.lit(1)).alias("n")).scalar()
    first = F.greatest(F.lit(1), F.floor(total * train))
    second = first + F.greatest(F.lit(1), F.floor(total * validation))
    name = F.when(F.col("_n") <= first, "train").when(F.col("_n") <= second, "validation").otherwise("test")
    return (
        frame.withColumn("_day", F.to_date(day))
        .join(numbered.select("_day", name.alias("partition")), "_day")
        .drop("_day")
    )


def components(edges: DataFrame, nodes: DataFrame, most_rounds: int = 50) -> DataFrame:
    """Connected components: ``node`` and the smallest node of its component as ``component``.

    ``edges`` has ``a`` and ``b``.  Every round takes the smallest label among the
    neighbours and then the label of that label, so long chains shrink quickly.
    """
    both = cut_lineage(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = cut_lineage(nodes.select("node", F.col("node").alias("component")).distinct())
    for _ in range(most_rounds):
        near = both.join(labels, both.a == labels.node).groupBy("b").agg(F.min("component").alias("_near"))
        lower = labels.join(near, labels.node == near.b, "left").select(
            "node", F.least("component", "_near").alias("component"), F.col("component").alias("_old")
        )
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("_next"))
        jumped = cut_lineage(
            lower.join(jump, "component", "left").select(
                "node", F.coalesce("_next", "component").alias("component"), "_old"
            )
        )
        labels = jumped.select("node", "component")
        if jumped.where(F.col("component") != F.col("_old")).isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def split_by_group_and_date(
    frame: DataFrame, day: str, group: str, train: float, validation: float
) -> DataFrame:
    """Days linked by a shared event group stay together; components are dealt out oldest first."""
    dated = frame.withColumn("_day", F.to_date(day))
    days = _calendar(frame, day)
    grouped = dated.where(F.trim(F.coalesce(group, F.lit(""))) != "").select(
        F.trim(F.col(group)).alias("_g"), "_day"
    ).distinct()
    # days of a group against its first day: pairs of calendar days, however many groups there are
    first_day = grouped.groupBy("_g").agg(F.min("_day").alias("a"))
    links = grouped.join(first_day, "_g").select("a", F.col("_day").alias("b")).where("a <> b").distinct()
    found = components(links, days.select(F.col("_day").alias("node")))
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    total = days.agg(F.count(F.lit(1)).alias("n")).scalar()
    order = Window.partitionBy(F.lit(0)).orderBy("component")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted_train = F.greatest(F.lit(1), F.floor(total * train))
    wanted_validation = F.greatest(F.lit(1), F.floor(total * validation))
    placed = sizes.withColumn("_before", before).withColumn("_want", wanted_train)
    used = F.min(F.when(F.col("_before") >= F.col("_want"), F.col("_before"))).over(Window.partitionBy(F.lit(0)))
    name = (
        F.when(F.col("_before") < F.col("_want"), "train")
        .when(F.col("_before") - used < wanted_validation, "validation")
        .otherwise("test")
    )
    by_day = found.join(placed.select("component", name.alias("partition")), "component").select(
        F.col("node").alias("_day"), "partition"
    )
    return dated.join(by_day, "_day").drop("_day")


def split_by_year(frame: DataFrame, year: Column, train_end: int, calibration_end: int) -> DataFrame:
    name = F.when(year <= train_end, "train").when(year <= calibration_end, "calibration").otherwise("test")
    return frame.withColumn("partition", name)


def partition_counts(frame: DataFrame, target: str, group: str) -> DataFrame:
    """Rows, positives, independent events and whether both classes occur, per partition."""
    named = F.when((F.col(target) == 1) & (F.col(group) != ""), F.col(group))
    return frame.groupBy("partition").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(target) == 1).alias("positive_rows"),
        F.countDistinct(named).alias("independent_events"),
        (F.countDistinct(target) > 1).alias("both_classes"),
    )


def evenly_spaced(frame: DataFrame, by: str, day: str, order: str, count: int) -> DataFrame:
    """``count`` rows per group at even distances in the order of (day, order).

    ``order`` is numeric and unique within a day.  Positions are looked up through day
    totals, so only the rows of the few chosen days are ordered, each day in value buckets.
    """
    if count < 1:
        raise ValueError("the number of rows must be positive")
    days = frame.groupBy(by, day).agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(by).orderBy(day)
    placed = days.withColumns(
        {
            "_start": F.sum("_n").over(running) - F.col("_n"),
            "_total": F.sum("_n").over(Window.partitionBy(by)),
        }
    )
    spots = F.when(
        F.col("_total") <= count, F.sequence(F.lit(0).cast("long"), F.col("_total") - 1)
    ).otherwise(
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(0), F.lit(count - 1)),
                lambda i: F.rint(i * (F.col("_total") - 1) / max(count - 1, 1)).cast("long"),
            )
        )
    )
    inside_day = F.filter(
        spots, lambda s: (s >= F.col("_start")) & (s < F.col("_start") + F.col("_n"))
    )
    wanted = placed.select(
        by, day, F.transform(inside_day, lambda s: s - F.col("_start")).alias("_spots")
    ).where(F.size("_spots") > 0)
    candidates = frame.join(wanted, [by, day])
    found = (
        ranking.positions(candidates, order, [by, day])
        .join(wanted, [by, day])
        .where(F.array_contains("_spots", F.col("below")))
        .select(by, day, order)
    )
    return candidates.drop("_spots").join(found, [by, day, order])


def per_kind_head(frame: DataFrame, kind: str, order: Sequence, limits: Mapping[str, int]) -> DataFrame:
    """Up to a number of rows of each kind."""
    most = max(limits.values())
    spot = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    numbered = frame.where(F.col(kind).isin(*limits)).withColumn("_spot", spot).where(F.col("_spot") <= most)
    allowed = F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col(kind))
    return numbered.where(F.col("_spot") <= allowed).drop("_spot")
