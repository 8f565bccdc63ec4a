"""Data audits: one aggregate pass, then a rule table turned into findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A finding is raised when ``broken`` holds on the one-row measures."""

    severity: str
    check: str
    broken: str
    message: str


def findings(measures: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """severity, check, message rows; ``{name}`` in a message is replaced by the measure."""

    def text(rule: Rule) -> Column:
        parts, rest = [], rule.message
        while "{" in rest:
            before, _, tail = rest.partition("{")
            name, _, rest = tail.partition("}")
            parts += [F.lit(before), F.coalesce(F.col(name).cast("string"), F.lit("null"))]
        return F.concat(*parts, F.lit(rest)) if parts else F.lit(rest)

    rows = [
        F.when(
            F.coalesce(F.expr(rule.broken), F.lit(True)),
            F.struct(
                F.lit(rule.severity).alias("severity"),
                F.lit(rule.check).alias("check"),
                text(rule).alias("message"),
            ),
        )
        for rule in rules
    ]
    return measures.select(F.inline(F.array_compact(F.array(*rows))))


def values_seen(column: str, expected: Sequence) -> Column:
    """The expected values that occur, in order and comma-joined, and "other" if any other does.

    Bounded by the expected values, whatever the column holds.
    """
    known = [F.when(F.bool_or(F.col(column) == value), F.lit(str(value))) for value in expected]
    other = F.when(F.bool_or(~F.col(column).isin(*expected)), F.lit("other"))
    return F.concat_ws(",", *known, other)


def training_measures(
    frame: DataFrame,
    day: str,
    inside: Column,
    features: Sequence[str],
    method: str,
    methods: Sequence[str],
    targets: Sequence[str],
) -> DataFrame:
    """History length, region, completeness, label provenance and class counts in one pass."""
    nulls = sum((F.count_if(F.col(f).isNull()) for f in features), F.lit(0))
    return frame.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(F.to_date(day)).alias("days"),
        F.count_if(~F.coalesce(inside, F.lit(False))).alias("outside_rows"),
        nulls.alias("null_features"),
        values_seen(method, methods).alias("methods"),
        *[F.count_if(F.col(t) == 1).alias(f"{t}_positive") for t in targets],
        *[F.count_if(F.col(t) == 0).alias(f"{t}_negative") for t in targets],
    )


def operational_measures(
    frame: DataFrame,
    places: Sequence[str],
    horizon: str,
    horizons: Sequence[int],
    source_id: str,
    collected: str,
    now: Column,
    factors: Sequence[str],
) -> DataFrame:
    """Coverage, repeated ids, freshness and factor completeness in one pass."""
    age = (F.unix_micros(now) - F.unix_micros(F.max(F.col(collected).cast("timestamp")))) / 3.6e9
    return frame.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(*places).alias("places"),
        values_seen(horizon, horizons).alias("horizons"),
        (F.count(source_id) - F.countDistinct(source_id)).alias("repeated_ids"),
        age.alias("age_hours"),
        *[(F.count(f) / F.count(F.lit(1))).alias(f"{f}_coverage") for f in factors],
    )


def source_measures(frame: DataFrame, by: str, year: Column, group: Column) -> DataFrame:
    """Rows, years and independent events per source."""
    return frame.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(year).alias("years"),
        F.countDistinct(group).alias("independent_events"),
    )


def _one(frame: DataFrame | None, measure: Column) -> Column:
    """One measure of a table; null for a table that is missing, which breaks every rule on it."""
    return F.lit(None) if frame is None else frame.agg(measure.alias("x")).scalar()


def _without(column: str, mark: str) -> Column:
    return F.count_if(~F.coalesce(F.contains(F.col(column).cast("string"), F.lit(mark)), F.lit(False)))


def confirmation_measures(
    spark: SparkSession,
    crosscheck: DataFrame | None,
    place: str,
    episodes: DataFrame | None,
    confirmation: DataFrame | None,
    collected: str,
    now: Column,
    provenance: DataFrame | None,
) -> DataFrame:
    """Places of the rainfall cross-check, episodes, age of the confirmation, provenance rows."""
    age = (F.unix_micros(now) - F.unix_micros(F.max(F.col(collected).cast("timestamp")))) / 3.6e9
    rows = F.count(F.lit(1))
    return spark.range(1).select(
        _one(crosscheck, F.countDistinct(place)).alias("checked_places"),
        _one(episodes, rows).alias("episodes"),
        _one(confirmation, age).alias("confirmation_age_hours"),
        _one(provenance, rows).alias("provenance_rows"),
    )


def land_measures(
    spark: SparkSession,
    terrain: DataFrame | None,
    cover: DataFrame | None,
    place: str,
    source: str,
    marks: tuple[str, str],
    slope: str,
    samples: str,
    dominant: str,
) -> DataFrame:
    """Places of both land tables, and their rows without the named source, slope, samples or class."""
    missing = lambda column: F.count_if(F.col(column).isNull())
    return spark.range(1).select(
        _one(terrain, F.countDistinct(place)).alias("terrain_places"),
        _one(terrain, _without(source, marks[0])).alias("terrain_unsourced"),
        _one(terrain, missing(slope)).alias("terrain_without_slope"),
        _one(cover, F.countDistinct(place)).alias("cover_places"),
        _one(cover, _without(source, marks[1])).alias("cover_unsourced"),
        _one(cover, F.count_if(~F.coalesce(F.col(samples) > 0, F.lit(False)))).alias("cover_without_samples"),
        _one(cover, missing(dominant)).alias("cover_without_class"),
    )


def partition_measures(ledger: DataFrame, unit: str, schema: str, required: Sequence[str]) -> DataFrame:
    """Units of a partitioned table, and those whose recorded schema has all required columns.

    ``schema`` holds each unit's type as the unit ledger records it, so no file is opened.
    """
    has = [F.regexp_like(schema, F.lit(rf"[<,]{name}:")) for name in required]
    complete = F.lit(True)
    for test in has:
        complete = complete & F.coalesce(test, F.lit(False))
    return ledger.agg(
        F.countDistinct(unit).alias("partitions"), F.countDistinct(F.when(complete, F.col(unit))).alias("complete_partitions")
    )


def truth_findings(
    events: DataFrame, kind: str, hazards: Mapping[str, str], source: str, group: str, least_events: int, least_groups: int
) -> DataFrame:
    """Findings on hazards with too few events or too few independent source events.

    ``hazards`` gives the severity of too few events by hazard; a blank group names no event.
    """
    named = F.when(F.length(F.trim(F.coalesce(group, F.lit("")))) > 0, F.struct(source, F.trim(group)))
    counted = events.groupBy(F.col(kind).alias("_kind")).agg(
        F.count(F.lit(1)).alias("_rows"), F.countDistinct(named).alias("_groups")
    )
    wanted = events.sparkSession.createDataFrame(list(hazards.items()), "_kind STRING, _severity STRING")
    rows, groups = (F.coalesce(c, F.lit(0).cast("long")) for c in ("_rows", "_groups"))
    found = lambda n, least: F.concat(F.lit("found "), n.cast("string"), F.lit(f" of {least}"))
    check = F.concat(F.lit("ground_truth."), "_kind")
    few = F.when(rows < least_events, F.struct(F.col("_severity").alias("severity"), check.alias("check"), found(rows, least_events).alias("message")))
    narrow = F.when(
        groups < least_groups,
        F.struct(F.lit("WARNING").alias("severity"), F.concat(check, F.lit("_diversity")).alias("check"), found(groups, least_groups).alias("message")),
    )
    return wanted.join(counted, "_kind", "left").select(F.inline(F.array_compact(F.array(few, narrow))))


def review_measures(review: DataFrame) -> DataFrame:
    """Pending and approved reviewer rows."""

    def word(name: str) -> Column:
        return F.upper(F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))))

    status, occurred, dated = word("review_status"), word("event_occurred_in_district"), word("date_correct")
    complete = status.isin("APPROVED", "REJECTED") & occurred.isin("YES", "NO") & dated.isin("YES", "NO")
    approved = (status == "APPROVED") & (occurred == "YES") & (dated == "YES")
    return review.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~complete).alias("incomplete"),
        F.count_if(approved).alias("approved"),
    )


def probability_measures(
    frame: DataFrame, place: Sequence[str], horizon: str, horizons: Sequence[int], columns: Sequence[str]
) -> DataFrame:
    """Coverage, horizon set and range of served probabilities."""
    outside = sum(
        (F.count_if(~F.coalesce(F.col(c).between(0.0, 1.0), F.lit(True))) for c in columns), F.lit(0)
    )
    return frame.agg(
        F.countDistinct(*place).alias("places"),
        values_seen(horizon, horizons).alias("horizons"),
        outside.alias("out_of_range"),
        *[F.count(c).alias(f"{c}_rows") for c in columns],
    )


def same_set(frame: DataFrame, column: str, expected: Sequence) -> DataFrame:
    """Whether the distinct values are exactly the expected ones, and what differs.

    The values seen are compared as an aggregate of at most expected + 1 rows per task.
    """
    want = F.array(*[F.lit(v) for v in expected])
    seen = frame.groupBy(F.col(column).alias("v")).agg(F.lit(1).alias("x"))
    counts = seen.agg(
        F.count_if(F.array_contains(want, F.col("v"))).alias("known"),
        F.count_if(~F.coalesce(F.array_contains(want, F.col("v")), F.lit(False))).alias("unknown"),
    )
    return counts.withColumns(
        {
            "missing": F.lit(len(set(expected))) - F.col("known"),
            "same": (F.col("known") == len(set(expected))) & (F.col("unknown") == 0),
        }
    )


def value_counts(frame: DataFrame, column: str) -> DataFrame:
    return frame.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows")).orderBy(
        F.desc("rows"), "value"
    )


def score_histogram(frame: DataFrame, column: str, lower_ends: Sequence[int]) -> DataFrame:
    """Rows per band, bands given by their lower ends from high to low, and the mean."""
    value = F.col(column)
    columns, above = [], None
    for end in lower_ends:
        inside = value >= end if above is None else (value >= end) & (value < above)
        columns.append(F.count_if(inside).alias(f"from_{end}"))
        above = end
    columns.append(F.count_if(value < above).alias(f"below_{above}"))
    return frame.agg(*columns, F.avg(value).alias("mean"))


def basic_quality(frame: DataFrame, identity: str, review: Column, columns: Sequence[str]) -> DataFrame:
    """Rows, repeated ids, rows to review and nulls per column."""
    return frame.agg(
        F.count(F.lit(1)).alias("rows"),
        (F.count(F.lit(1)) - F.countDistinct(identity)).alias("duplicate_ids"),
        F.count_if(review).alias("needs_review"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns],
    )


def funnel(frame: DataFrame, stages: Mapping[str, Column]) -> DataFrame:
    """Rows left after each stage, rows lost to it and the share that survives it.

    All stages are counted in one pass; a stage keeps what every earlier one kept.
    """
    kept, holds = [], F.lit(True)
    for name, condition in stages.items():
        holds = holds & F.coalesce(condition, F.lit(False))
        kept.append((name, holds))
    counted = frame.agg(
        F.count(F.lit(1)).alias("_all"), *[F.count_if(c).alias(f"_{i}") for i, (_, c) in enumerate(kept)]
    )
    rows = []
    for i, (name, _) in enumerate(kept):
        before = F.col("_all") if i == 0 else F.col(f"_{i - 1}")
        after = F.col(f"_{i}")
        rows.append(
            F.struct(
                F.lit(name).alias("stage"),
                before.alias("rows_in"),
                after.alias("rows_out"),
                (before - after).alias("lost"),
                F.when(before > 0, after * 100.0 / before).otherwise(0.0).alias("success_percent"),
            )
        )
    return counted.select(F.inline(F.array(*rows)))
