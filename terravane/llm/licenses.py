"""License scan: base phrases by place, and notices by an exact set-similarity join.

A notice template is a set of words.  It stands in a text if some run of consecutive words, as long as
the template and a quarter more, holds at least ``CONTAINMENT`` of its words, whatever line breaks,
marks or other words stand between them.  Texts are cut into blocks that overlap so far that
every run lies whole in one of them, and the join finds all such blocks without comparing each of them
with each template:

* prefix filter: words are ordered by how few documents of the whole corpus hold them, and a match must
  share one of the template's first ``size - required + 1`` words, so blocks without such a word are never
  formed into rows and the others meet templates on it alone;
* length filter: a block with fewer template words than the template requires is out;
* positional filter: from the places of the shared word in both ordered sets, what can still be shared
  is bounded and must reach the requirement.

Survivors are verified run by run.  All of it is DataFrame functions.

Defined cases: null and empty texts have no words and no labels; a text may be one line of any length; the
template list and phrases are arguments; repeated rows are rows of their own; an empty table gives
no rows; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm.common import LOWER, UPPER, table, written
from terravane.llm.decontaminate import words_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
CONTAINMENT = 0.9
#: Notices as they stand in public files, by label.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc0": "the author has waived all copyright and related rights to this work",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "isc": "Permission to use, copy, modify, and distribute this software for any purpose is hereby granted",
    "mit": "Released under the MIT License",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}


def listed_words(text: str) -> list[str]:
    """Words of a template in order, by the same rule as for texts."""
    lowered = "".join(LOWER[UPPER.index(c)] if c in UPPER else c for c in text)
    return "".join(c if ord(c) > 127 or c.isalnum() else " " for c in lowered).split()


def template_words(text: str) -> list[str]:
    return sorted(set(listed_words(text)))


def run_length(text: str) -> int:
    """Consecutive words among which a template's words are looked for."""
    size = len(listed_words(text))
    return size + math.ceil(size / 4)


def required(size: int, containment: float = CONTAINMENT) -> int:
    return max(1, math.ceil(containment * size - 1e-9))


def _places(words: Column, phrase: Sequence[str]) -> Column:
    """Starts of all places where the phrase's words stand one after the other."""
    everywhere = F.sequence(F.lit(0), F.size(words) - len(phrase))

    def stands(at: Column) -> Column:
        here = F.get(words, at) == phrase[0]
        for step, word in enumerate(phrase[1:], 1):
            here = here & (F.get(words, at + step) == word)
        return here

    present = F.size(words) >= len(phrase)
    for word in phrase:
        present = present & F.array_contains(words, word)
    return F.when(present, F.filter(everywhere, stands)).otherwise(F.array().cast("array<int>"))


def _listing(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def scan(
    documents: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    sets = {label: template_words(text) for label, text in templates.items()}
    sets = {label: words for label, words in sets.items() if words}
    needs = {label: required(len(words), containment) for label, words in sets.items()}
    runs = {label: run_length(templates[label]) for label in sets}
    vocabulary = sorted(set().union(*sets.values())) if sets else []
    step = max(runs.values(), default=1)

    worded = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id"), words_of("text").alias("words")
    )
    # one row per template word at most: bounded by the templates, whatever the corpus holds
    own = F.array_intersect("words", F.array(*[F.lit(w) for w in vocabulary]).cast("array<string>"))
    held = {r["word"]: r["count"] for r in worded.select(F.explode(own).alias("word")).groupBy("word").count().collect()}
    order = sorted(vocabulary, key=lambda w: (held.get(w, 0), w))
    place = {word: i for i, word in enumerate(order)}
    ordered = {label: sorted(words, key=place.__getitem__) for label, words in sets.items()}
    prefix = {label: words[: len(words) - needs[label] + 1] for label, words in ordered.items()}
    leading = F.array(*[F.lit(w) for w in sorted(set().union(*prefix.values()))]).cast("array<string>")

    spots = [_places(F.col("words"), phrase.split()) for phrase, _ in phrases]
    # a run that starts in the first half of a block ends in it
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.size("words") - 1) / step), F.lit(0)).cast("int"))
    cut = F.transform(starts, lambda k: F.slice("words", k * step + 1, F.lit(2 * step)))
    none = F.array().cast("array<array<string>>")
    blocks = F.when(
        F.arrays_overlap("words", leading), F.filter(cut, lambda block: F.arrays_overlap(block, leading))
    ).otherwise(none)
    compact = worded.select(
        "row",
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.array(*spots).alias("spots"),
        blocks.alias("blocks"),
    ).select(
        "row",
        "doc_id",
        "n_words",
        F.flatten("spots").alias("all_spots"),
        F.filter(
            F.array(*[F.when(F.size(F.get("spots", F.lit(i))) > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)]),
            lambda label: label.isNotNull(),
        ).alias("base"),
        "blocks",
    )
    compact = written(compact, "license-blocks")

    entries = [
        F.struct(
            F.lit(word).alias("word"),
            F.lit(label).alias("label"),
            F.lit(i).alias("i"),
            F.lit(needs[label]).alias("needed"),
            F.lit(runs[label]).alias("run"),
            F.array(*[F.lit(w) for w in ordered[label]]).alias("template"),
        )
        for label in sets
        for i, word in enumerate(prefix[label])
    ]
    ordered_words = F.array(*[F.lit(w) for w in order]).cast("array<string>")
    tokens = (
        compact.select("row", F.explode("blocks").alias("words"))
        .withColumn("block", F.array_intersect(ordered_words, "words"))
        .select("row", "words", "block", F.posexplode("block").alias("j", "word"))
    )
    if entries:
        prefixes = documents.sparkSession.range(1).select(F.inline(F.array(*entries)))
        size_t, size_b = F.size("template"), F.size("block")
        reach = 1 + F.least(size_t - 1 - F.col("i"), size_b - 1 - F.col("j"))
        # the prefix table is made of the templates alone, which bounds it
        candidates = tokens.join(F.broadcast(prefixes), "word").where(
            (size_b >= F.col("needed")) & (reach >= F.col("needed"))
        )
        places = F.sequence(F.lit(0), F.least(F.size("words"), F.lit(step)) - 1)
        shared = F.array_max(
            F.transform(
                places, lambda at: F.size(F.array_intersect("template", F.slice("words", at + 1, F.col("run"))))
            )
        )
        found = (
            candidates.withColumn("shared", shared)
            .where("shared >= needed")
            .groupBy("row")
            .agg(F.collect_set("label").alias("found"), F.max(F.col("shared") / F.size("template")).alias("best"))
        )
    else:
        found = tokens.where("false").select(
            "row", F.array().cast("array<string>").alias("found"), F.lit(0.0).alias("best")
        )
    joined = compact.join(found, "row", "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id",
        "n_words",
        F.size("all_spots").cast("long").alias("n_base"),
        F.array_min("all_spots").cast("long").alias("first_word"),
        F.array_max("all_spots").cast("long").alias("last_word"),
        _listing(F.col("base")).alias("base_labels"),
        _listing(F.concat("base", F.coalesce("found", none))).alias("labels"),
        F.greatest(
            F.coalesce("best", F.lit(0.0)), F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
        ).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _template_rows() -> str:
    rows = []
    for label, text in TEMPLATES.items():
        words = template_words(text)
        listed = ", ".join(f"'{w}'" for w in words)
        rows.append(f"('{label}', [{listed}], {len(words)}, {required(len(words))}, {run_length(text)})")
    return ",\n  ".join(rows)


SQL = f"""
with templates(label, tokens, size, needed, run) as (values
  {_template_rows()}),
worded as (
  select row_number() over () as rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as words
  from documents),
spotted as (
  select rid, doc_id, words, len(words)::BIGINT as n_words,
         [p for p in range(0, len(words) - 1) if words[p + 1] = 'cc' and words[p + 2] = 'by'] as cc,
         [p for p in range(0, len(words) - 2)
          if words[p + 1] = 'general' and words[p + 2] = 'public' and words[p + 3] = 'license'] as gpl,
         [p for p in range(0, len(words) - 2)
          if words[p + 1] = 'all' and words[p + 2] = 'rights' and words[p + 3] = 'reserved'] as res
  from worded),
near as (
  select rid, words, label, tokens, size, needed, run from spotted, templates
  where len(list_intersect(list_distinct(words), tokens)) >= needed),
runs as (select rid, label, tokens, size, needed, words[s + 1 : s + run] as part
  from (select *, unnest(range(0, len(words))) as s from near) where list_contains(tokens, words[s + 1])),
matches as (
  select rid, label, len(list_intersect(list_distinct(part), tokens)) / size::DOUBLE as part
  from runs where len(list_intersect(list_distinct(part), tokens)) >= needed),
per_row as (select rid, list(distinct label) as found, max(part) as best from matches group by rid),
based as (
  select *, [x for x in [case when len(cc) > 0 then 'cc-by' end, case when len(gpl) > 0 then 'gpl' end,
             case when len(res) > 0 then 'reserved' end] if x is not null] as base,
         list_concat(list_concat(cc, gpl), res) as spots
  from spotted)
select doc_id, n_words, len(spots)::BIGINT as n_base, list_min(spots)::BIGINT as first_word,
       list_max(spots)::BIGINT as last_word, array_to_string(list_sort(base), ',') as base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, coalesce(found, [])))), ',') as labels,
       greatest(coalesce(best, 0.0::DOUBLE), case when len(base) > 0 then 1.0::DOUBLE else 0.0::DOUBLE end) as score
from based left join per_row using (rid)
"""
