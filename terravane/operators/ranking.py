"""Exact ranks, positions and quantiles of large groups without one-task windows.

A group may hold most of the table (one day, or the whole table).  Equal values
are first collapsed to a count, each group is then cut into value buckets at
approximate quantiles, and every bucket is ordered on its own.  The totals of
the earlier buckets are added as an offset, so results are exact while no task
sorts more than one bucket of distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.session import cut_lineage, shuffle_width


def positions(
    frame: DataFrame,
    value: str,
    by: Sequence[str] = (),
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per group and distinct value: how many rows lie below, at and in all.

    ``extra`` sums further per-row columns; each ``name`` also yields ``name_below``
    and ``name_total``, the sums over smaller values and over the whole group.
    Null values are left out.
    """
    extra = extra or {}
    by = list(by)
    keep = frame.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    sums = ["at_value", *extra]
    # counted once: edges, offsets and ranks all start from the written tallies
    tallies = cut_lineage(
        keep.groupBy(*by, value).agg(
            F.count(F.lit(1)).alias("at_value"),
            *[F.sum(column).alias(name) for name, column in extra.items()],
        )
    )
    width = shuffle_width(frame.sparkSession)
    approximate = F.percentile_approx(
        value, [i / width for i in range(1, width)] or [0.5], F.lit(20 * width)
    )
    cuts = F.array_distinct(approximate)
    if by:
        edges = tallies.groupBy(*by).agg(cuts.alias("_edges"))
        placed = tallies.join(edges, by)
    else:
        placed = tallies.withColumn("_edges", tallies.agg(cuts.alias("_edges")).scalar())
    placed = placed.withColumn(
        "_bucket",
        F.coalesce(F.size(F.filter("_edges", lambda edge: edge < F.col(value))), F.lit(0)),
    ).drop("_edges")

    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(
        Window.unboundedPreceding, -1
    )
    totals = placed.groupBy(*by, "_bucket").agg(*[F.sum(n).alias(f"_{n}") for n in sums])
    # at most one row per bucket: this window is as wide as the shuffle, never as the data
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_bucket")
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    offsets = totals.select(
        *by,
        "_bucket",
        *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}_before") for n in sums],
        *[F.sum(f"_{n}").over(whole).alias(f"_{n}_total") for n in sums],
    )
    joined = placed.withColumns(
        {f"_{n}_inside": F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in sums}
    ).join(offsets, [*by, "_bucket"])
    names = {"at_value": ("below", "total")} | {n: (f"{n}_below", f"{n}_total") for n in extra}
    return joined.select(
        *by,
        value,
        *sums,
        *[
            column
            for n, (below, total) in names.items()
            for column in (
                (F.col(f"_{n}_inside") + F.col(f"_{n}_before")).alias(below),
                F.col(f"_{n}_total").alias(total),
            )
        ],
    )


def fractions(frame: DataFrame, value: str, by: Sequence[str], name: str) -> DataFrame:
    """Descending competition rank of each distinct value divided by the group's size."""
    return positions(frame.select(*by, value), value, by).select(
        *by, value, ((F.col("total") - F.col("below") - F.col("at_value") + 1) / F.col("total")).alias(name)
    )


def rank_fraction(frame: DataFrame, value: str, by: Sequence[str], name: str) -> DataFrame:
    """The same, attached to every row."""
    return frame.join(fractions(frame, value, by, name), [*by, value], "left")


def quantiles(
    frame: DataFrame,
    value: str,
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    method: str = "linear",
) -> DataFrame:
    """Exact quantiles, one row per group and probability.

    ``linear`` interpolates between neighbours; ``higher`` takes the element at the
    next whole position.
    """
    by = list(by)
    ranked = positions(frame.select(*by, F.col(value).alias("_value")), "_value", by)
    value = "_value"
    point = F.array(*[F.lit(float(p)) for p in probabilities])
    spots = ranked.select(
        *by, value, "below", "at_value", F.col("total").alias("_n"), F.explode(point).alias("probability")
    ).withColumn("_at", F.col("probability") * (F.col("_n") - 1))
    if method == "higher":
        low = high = F.ceil(F.col("_at"))
    else:
        low, high = F.floor(F.col("_at")), F.ceil(F.col("_at"))

    def holds(position: Column) -> Column:
        return (position >= F.col("below")) & (position < F.col("below") + F.col("at_value"))

    found = (
        spots.where(holds(low) | holds(high))
        .groupBy(*by, "probability")
        .agg(
            F.max(F.when(holds(low), F.col(value))).alias("_low"),
            F.max(F.when(holds(high), F.col(value))).alias("_high"),
            F.max(F.col("_at") - F.floor("_at")).alias("_share"),
        )
    )
    if method == "higher":
        answer = F.col("_high")
    else:
        answer = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_share")
    return found.select(*by, "probability", answer.alias("quantile"))


def quantile_array(
    frame: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """The same quantiles as one ascending array per group, column ``quantiles``."""
    rows = quantiles(frame, value, probabilities, by)
    return rows.groupBy(*by).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("probability", "quantile"))),
            lambda pair: pair["quantile"],
        ).alias("quantiles")
    )
