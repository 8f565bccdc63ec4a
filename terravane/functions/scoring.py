"""Score, level and explanation expressions.

Nothing here has built-in weights or thresholds: every number comes in from the caller.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from terravane.functions import as_column
from terravane.functions.weather import clip


def half_even(value, digits: int) -> Column:
    scale = float(10**digits)
    return F.rint(as_column(value) * scale) / scale


def lookup(table: Mapping, key, default=None) -> Column:
    """Value of a small configured mapping."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.element_at(entries, as_column(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def saturating_ratio(value, threshold, floor: float) -> Column:
    """r / (1 + r) for r = max(value, 0) / max(threshold, floor)."""
    ratio = F.greatest(as_column(value), F.lit(0.0)) / F.greatest(as_column(threshold), F.lit(floor))
    ratio = F.when(as_column(value).isNotNull(), ratio)
    return ratio / (1.0 + ratio)


def horizon_threshold(
    base, horizon, reference_days: float, exponent: float, multiplier: float, floor: float, default: float
) -> Column:
    """A reference threshold scaled to the horizon; a missing or non-positive base uses the default."""
    base = as_column(base)
    usable = base.isNotNull() & ~F.isnan(base) & (base > 0) & (base < float("inf"))
    scale = F.greatest(as_column(horizon).cast("double"), F.lit(1.0)) / reference_days
    return F.greatest(
        F.when(usable, base).otherwise(default) * F.pow(scale, F.lit(exponent)) * multiplier,
        F.lit(floor),
    )


def weighted(parts: Sequence[tuple[float, Column]]) -> Column:
    """Plain weighted sum; one null makes it null."""
    return reduce(lambda a, b: a + b, [w * as_column(c) for w, c in parts])


def weighted_mean_of_present(parts: Sequence[tuple[float, Column]]) -> Column:
    """Weighted mean over the parts that are not null; null when all are."""
    parts = [(w, as_column(c)) for w, c in parts]
    total = reduce(lambda a, b: a + b, [F.coalesce(w * c, F.lit(0.0)) for w, c in parts])
    weight = reduce(
        lambda a, b: a + b, [F.when(c.isNotNull(), F.lit(float(w))).otherwise(0.0) for w, c in parts]
    )
    return F.when(weight > 0, total / weight)


def mean_of_present(columns: Sequence) -> Column:
    return weighted_mean_of_present([(1.0, c) for c in columns])


def probability_signal(probability, horizon, references: Mapping[int, float], fallback: int) -> Column:
    """1 - exp(-p / reference of the horizon), limited to [0, 1]; null stays null."""
    reference = lookup(references, horizon, references[fallback])
    return clip(1.0 - F.exp(-as_column(probability) / reference), 0.0, 1.0)


def land_score(signal, susceptibility, signal_weight: float) -> Column:
    return 100.0 * (
        signal_weight * as_column(signal) + (1.0 - signal_weight) * as_column(susceptibility)
    )


def blend_when_present(base: Column, other: Column, weight: float) -> Column:
    """Convex blend, or the base alone where ``other`` is null."""
    return F.coalesce((1.0 - weight) * base + weight * other, base)


def level(score, bands: Sequence[tuple[float, str]], top: str, missing: str = "UNAVAILABLE") -> Column:
    """Name of the first band whose upper end lies above the score."""
    score = as_column(score)
    chain = F.when(score.isNull() | F.isnan(score.cast("double")), missing)
    for upper, name in bands:
        chain = chain.when(score < upper, name)
    return chain.otherwise(top)


def text_items(items: Sequence[tuple[Column | None, Column]], fallback: str | None = None) -> Column:
    """Array of the texts whose condition holds; ``fallback`` alone when none does."""
    texts = F.array_compact(
        F.array(
            *[
                text if condition is None else F.when(F.coalesce(condition, F.lit(False)), text)
                for condition, text in items
            ]
        )
    )
    if fallback is None:
        return texts
    return F.when(F.size(texts) == 0, F.array(F.lit(fallback))).otherwise(texts)


def largest(columns: Sequence) -> Column:
    """Largest value that is not null, for one column or more."""
    columns = [as_column(c) for c in columns]
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def dominant(scores: Sequence[tuple[str, Column]], none_when_zero: str | None = None) -> Column:
    """Name of the largest score, the earlier one on a tie."""
    top = largest([c for _, c in scores])
    chain = F.when(top.isNull(), F.lit(None).cast("string"))
    if none_when_zero is not None:
        chain = chain.when(top == 0, none_when_zero)
    for name, column in scores:
        chain = chain.when(as_column(column) == top, name)
    return chain


def risk_points(prediction, probability, cuts: Sequence[float]) -> Column:
    """0 without a positive prediction, else how many cuts the probability reaches."""
    probability = as_column(probability)
    points = reduce(
        lambda a, b: a + b, [(probability >= cut).cast("int") for cut in cuts], F.lit(0)
    )
    return F.when(probability.isNull(), F.lit(None).cast("int")).when(
        as_column(prediction) == 0, 0
    ).otherwise(points)


def grade(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """First rule that holds; an unknown condition does not hold."""
    first, *rest = [(F.coalesce(c, F.lit(False)), name) for c, name in rules]
    chain = F.when(*first)
    for condition, name in rest:
        chain = chain.when(condition, name)
    return chain.otherwise(otherwise)


def compact_number(value, units: Sequence[tuple[float, str]]) -> Column:
    """A number in the largest unit it reaches, one decimal; plain with no unit."""
    value = as_column(value).cast("double")
    plain = F.format_string("%d", F.rint(value).cast("long"))
    chain = F.when(value.isNull(), F.lit(None).cast("string"))
    for size, name in units:
        chain = chain.when(
            F.abs(value) >= size,
            F.concat(F.format_string("%.1f", half_even(value / size, 1)), F.lit(" " + name)),
        )
    return chain.otherwise(plain)


def age_hours(collected, now) -> Column:
    return (
        F.unix_micros(as_column(now).cast("timestamp"))
        - F.unix_micros(as_column(collected).cast("timestamp"))
    ) / 3.6e9


def severity(score, bands: Sequence[tuple[float, str]], lowest: str) -> Column:
    """Bands from the highest down."""
    score = as_column(score)
    chain = F.when(score.isNull(), F.lit(None).cast("string"))
    for least, name in bands:
        chain = chain.when(score >= least, name)
    return chain.otherwise(lowest)
