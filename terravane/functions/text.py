"""Text, name and identifier expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions import as_column


def _letters_with_marks() -> tuple[str, str]:
    """Every Latin letter with a mark, and the plain letter it decomposes to."""
    marked = [chr(n) for n in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    plain = [unicodedata.normalize("NFKD", c)[0] for c in marked]
    pairs = [(c, p) for c, p in zip(marked, plain) if p != c and p.isascii()]
    return "".join(c for c, _ in pairs), "".join(p for _, p in pairs)


MARKED, PLAIN = _letters_with_marks()


def normalise_name(value) -> Column:
    """Lower case, no accents, without the words district and dist, letters and digits only."""
    plain = F.lower(F.translate(as_column(value), MARKED, PLAIN))
    return F.regexp_replace(F.regexp_replace(plain, r"\b(district|dist)\b", ""), "[^a-z0-9]", "")


def name_similarity(left, right) -> Column:
    """One minus the edits between two normalised names per letter of the longer one, 0 to 1."""
    a, b = normalise_name(left), normalise_name(right)
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def normalise_text(value) -> Column:
    """Lower case, no URL scheme, every run of characters outside a-z and 0-9 one space."""
    value = F.regexp_replace(F.lower(F.coalesce(as_column(value), F.lit(""))), "https?://", " ")
    return F.trim(F.regexp_replace(value, "[^a-z0-9]+", " "))


def searchable(*columns) -> Column:
    return F.concat_ws(" ", *[as_column(c) for c in columns])


class Flags:
    """Which phrases a text column has, searched once per row and kept as one array column.

    Classification, state and score rules look at the same phrases again and again; given
    the flags instead of the text they only read booleans.
    """

    def __init__(self, column: str, phrases: Iterable[str], bounded: bool = True):
        self.column, self.bounded = column, bounded
        self.phrases = list(dict.fromkeys(phrases))
        self.name = f"_{column}_flags"

    def attach(self, frame: DataFrame) -> DataFrame:
        text = F.concat(F.lit(" "), F.col(self.column), F.lit(" ")) if self.bounded else F.col(self.column)
        padded = frame.withColumn("_padded", text)
        found = [
            F.coalesce(F.contains("_padded", F.lit(f" {p} " if self.bounded else p)), F.lit(False))
            for p in self.phrases
        ]
        # a filter on what follows is not moved below a generator, which would repeat the
        # whole search for every flag the filter reads
        return padded.withColumn(self.name, F.explode(F.array(F.array(*found)))).drop("_padded")

    def has(self, phrase: str) -> Column:
        return F.col(self.name)[self.phrases.index(phrase)]


def has_phrase(value, phrase: str, bounded: bool = True) -> Column:
    """Phrase present in the text, or in the flags taken of it.

    ``bounded`` wants whole words and expects text and phrase as ``normalise_text``
    leaves them; otherwise any substring counts.
    """
    if isinstance(value, Flags):
        return value.has(phrase)
    value = as_column(value)
    if bounded:
        return F.contains(F.concat(F.lit(" "), value, F.lit(" ")), F.lit(f" {phrase} "))
    return F.contains(value, F.lit(phrase))


def has_any(value, phrases: Sequence[str], bounded: bool = True) -> Column:
    tests = [F.coalesce(has_phrase(value, p, bounded), F.lit(False)) for p in phrases]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def found_phrases(value, phrases: Sequence[str], bounded: bool = False) -> Column:
    """Sorted distinct phrases present in the text."""
    found = [F.when(has_phrase(value, p, bounded), F.lit(p)) for p in sorted(set(phrases))]
    return F.array_compact(F.array(*found))


def phrase_hits(value, phrases: Sequence[str], bounded: bool = False) -> Column:
    """How many of the phrases are present."""
    tests = [F.coalesce(has_phrase(value, p, bounded), F.lit(False)).cast("int") for p in phrases]
    return reduce(lambda a, b: a + b, tests, F.lit(0))


def most_hits(value, rules: Mapping[str, Sequence[str]], bounded: bool = False) -> Column:
    """struct<name,hits> of the rule with most phrases present; ties go to the earlier rule."""
    scored = F.array(
        *[
            F.struct(
                phrase_hits(value, phrases, bounded).alias("hits"),
                F.lit(-position).alias("place"),
                F.lit(name).alias("name"),
            )
            for position, (name, phrases) in enumerate(rules.items())
        ]
    )
    best = F.array_max(scored)
    return F.struct(
        F.when(best["hits"] > 0, best["name"]).alias("name"), best["hits"].alias("hits")
    )


def first_match(value, rules: Mapping[str, Sequence[str]], bounded: bool = False) -> Column:
    """struct<name,phrase> of the first phrase present, in the order of rules and phrases."""
    return F.coalesce(
        *[
            F.when(
                has_phrase(value, phrase, bounded),
                F.struct(F.lit(name).alias("name"), F.lit(phrase).alias("phrase")),
            )
            for name, phrases in rules.items()
            for phrase in phrases
        ]
    )


def longest_phrase_words(value, phrases: Sequence[str]) -> Column:
    """Word count of the longest whole-word phrase present, 0 when none is."""
    words = [F.when(has_phrase(value, p), len(p.split())).otherwise(0) for p in phrases]
    return F.greatest(*words, F.lit(0), F.lit(0))


def stable_id(prefix: str, *parts) -> Column:
    """Prefix and the first 16 hex digits of the SHA-256 of the joined parts; nulls are skipped."""
    joined = F.concat_ws("|", *[as_column(p).cast("string") for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, 16))


def compact_date(value) -> Column:
    """yyyymmdd given as text, integer or float; anything else is null."""
    digits = F.regexp_replace(F.trim(as_column(value).cast("string")), r"\.0+$", "")
    return F.when(digits.rlike(r"^\d{8}$"), F.try_to_date(digits, "yyyyMMdd"))


def content_hash(value) -> Column:
    return F.sha2(as_column(value), 256)
