"""Canonical event records: coercion, review, acceptance and validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions import text
from terravane.functions.scoring import lookup
from terravane.operators import dedupe

TRUE_WORDS = ("true", "1", "yes", "y")


def union_sources(sources: Mapping[str, DataFrame | None]) -> DataFrame:
    """All sources that exist, with their name in ``input_source`` and the union of their columns."""
    parts = [
        frame.withColumn("input_source", F.lit(name))
        for name, frame in sources.items()
        if frame is not None
    ]
    if not parts:
        raise ValueError("no source to read")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def coerced(
    frame: DataFrame,
    texts: Mapping[str, str],
    numbers: Sequence[str],
    dates: Sequence[str],
    flags: Sequence[str],
    upper: Sequence[str] = (),
    number_defaults: Mapping[str, float] | None = None,
) -> DataFrame:
    """Trimmed text with defaults, numbers and dates or null, yes-like words as booleans.

    Columns that are missing altogether appear with their default.
    """

    def source(name: str) -> Column:
        return F.col(name) if name in frame.columns else F.lit(None).cast("string")

    defaults = number_defaults or {}
    columns: dict[str, Column] = {}
    for name, default in texts.items():
        value = F.trim(F.coalesce(source(name).cast("string"), F.lit(default)))
        columns[name] = F.upper(value) if name in upper else value
    for name in numbers:
        value = source(name).cast("string").try_cast("double")
        value = F.when(~F.isnan(value), value)
        columns[name] = F.coalesce(value, F.lit(defaults[name])) if name in defaults else value
    for name in dates:
        columns[name] = F.try_to_date(F.substring(F.trim(source(name).cast("string")), 1, 10), "yyyy-MM-dd")
    for name in flags:
        columns[name] = F.coalesce(F.lower(F.trim(source(name).cast("string"))).isin(*TRUE_WORDS), F.lit(False))
    return frame.withColumns(columns)


def with_reviews(events: DataFrame, decisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A rejecting decision on the key makes the event unverified."""

    def says(name: str, word: str) -> Column:
        return F.coalesce(F.upper(F.trim(F.col(name))) == word, F.lit(False))

    rejected = (
        decisions.where(
            says("review_status", "REJECTED")
            | says("event_occurred_in_district", "NO")
            | says("date_correct", "NO")
        )
        .select(*keys)
        .distinct()
        .withColumn("_rejected", F.lit(True))
    )
    joined = events.join(rejected, list(keys), "left")
    return joined.withColumn(
        "verified", F.col("verified") & ~F.coalesce("_rejected", F.lit(False))
    ).drop("_rejected")


def judged(frame: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """``accepted`` when every rule holds; ``review_reason`` lists the broken ones in rule order.

    A rule whose outcome is unknown counts as broken.
    """
    held = {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in held.items()]))
    return frame.withColumn("_broken", broken).withColumns(
        {"accepted": F.size("_broken") == 0, "review_reason": F.array_join("_broken", ";")}
    ).drop("_broken")


def split(judged_frame: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows; together they are the input."""
    accepted = judged_frame.where("accepted").drop("accepted", "review_reason")
    return accepted, judged_frame.where(~F.col("accepted")).drop("accepted")


def unique_events(accepted: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return dedupe.keep_last(accepted, keys, order)


def retained_rejects(canonical: DataFrame, rejected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rejected keys that are still in the canonical table; must be empty."""
    return canonical.join(rejected.select(*keys).distinct(), list(keys), "left_semi")


def record_violations(
    enums: Mapping[str, Sequence[str]],
    ranges: Mapping[str, tuple[float | None, float | None]],
    required: Sequence[str],
) -> Column:
    """Names of broken record rules: unknown enum value, number out of range, empty text.

    Null passes enum and range rules; required text must not be blank.
    """
    found = []
    for name, allowed in enums.items():
        found.append(F.when(~F.col(name).isin(*allowed), F.lit(f"{name}_enum")))
    for name, (low, high) in ranges.items():
        bad = F.lit(False)
        if low is not None:
            bad = bad | (F.col(name) < low)
        if high is not None:
            bad = bad | (F.col(name) > high)
        found.append(F.when(bad, F.lit(f"{name}_range")))
    for name in required:
        found.append(
            F.when(F.trim(F.coalesce(F.col(name), F.lit(""))) == "", F.lit(f"{name}_missing"))
        )
    return F.array_compact(F.array(*found))


def news_records(articles: DataFrame, synonyms: Mapping[str, str]) -> DataFrame:
    """News rows in the canonical columns; an unknown event type makes the row invalid."""
    hazard = lookup(synonyms, F.lower(F.trim("event_type")))
    description = F.when(F.length("description") > 0, F.col("description")).otherwise(F.col("content"))
    return articles.withColumns(
        {
            "hazard_type": hazard,
            "description": description,
            "verified": F.lit(True),
            "event_date": F.to_date("date"),
            "valid": hazard.isNotNull() & F.to_date("date").isNotNull(),
        }
    )


def alert_records(
    alerts: DataFrame, first_year: int, last_year: int, severities: Mapping[str, str], lowest: str
) -> DataFrame:
    """Permanent, dated alerts of the wanted years, the first of each id, in canonical columns.

    ``alerts``: alert_id, from_date, temporary, colour, state, district, row_order.
    """
    date = F.try_to_date(F.substring("from_date", 1, 10), "yyyy-MM-dd")
    kept = alerts.withColumn("event_date", date).where(
        F.col("alert_id").isNotNull()
        & (F.lower(F.coalesce(F.col("temporary").cast("string"), F.lit("false"))) != "true")
        & F.year("event_date").between(first_year, last_year)
    )
    first = dedupe.keep_first(kept, ["alert_id"], ["row_order"])
    colour = F.upper(F.coalesce("colour", F.lit("Green")))
    identity = F.regexp_replace(F.concat_ws("_", F.lit("ALERT"), "alert_id", "state", "district"), " ", "_")
    return first.withColumns(
        {
            "alert_level": colour,
            "severity": F.coalesce(lookup(severities, colour), F.lit(lowest)),
            "event_id": identity,
        }
    )


def severity_and_confidence(
    score, needs_review, bands: Sequence[tuple[float, str]], lowest: str, discount: float
) -> dict[str, Column]:
    from terravane.functions.scoring import half_even, severity

    reduced = F.when(needs_review, F.col(score) * discount).otherwise(F.col(score) * 1.0)
    return {
        "severity": severity(score, bands, lowest),
        "confidence": half_even(F.least(reduced, F.lit(100.0)), 2),
    }


def article_analysis(
    frame: DataFrame, body: str, hazards: Mapping[str, Sequence[str]], places: Sequence[str]
) -> DataFrame:
    """Keywords found, first one in hazard order, hazard with most hits, places mentioned."""
    every = [p for phrases in hazards.values() for p in phrases]
    flags = text.Flags("_low", [*every, *places], bounded=False)
    searched = flags.attach(frame.withColumn("_low", F.lower(body)))
    columns = {
        "keywords": text.found_phrases(flags, every),
        "matched_keyword": text.first_match(flags, hazards)["phrase"],
        "article_hazard": text.most_hits(flags, hazards)["name"],
        "mentions": text.found_phrases(flags, places),
    }
    return searched.withColumns(columns).drop("_low", flags.name)
