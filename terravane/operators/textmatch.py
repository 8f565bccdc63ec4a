"""Find registry names inside texts without text-by-name loops.

A registry up to ``AUTOMATON_CHARS`` characters becomes a prefix automaton in every task, which reads
each text once and finds all names at once, of whatever lengths.  A larger registry is joined on
equality instead, by runs of words or by blocks of characters.  Both ways give the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Characters of names, with their ``by`` values, that are sent to every task; beyond, names are joined.
AUTOMATON_CHARS = 8_000_000
_BUILT: dict[str, ahocorasick.Automaton] = {}


def _registry(known: DataFrame, name: str, by: Sequence[str]) -> list | None:
    """The distinct names if they fit into a task, else None."""
    listed = known.select(name, *by).distinct()
    each = F.length(name) + sum([F.length(F.col(c).cast("string")) for c in by], F.lit(0))
    if (listed.agg(F.sum(each)).first()[0] or 0) > AUTOMATON_CHARS:
        return None
    return [tuple(r) for r in listed.collect()]


def _automaton(mark: str, registry: Broadcast) -> ahocorasick.Automaton:
    """The automaton of a registry, built once per worker: name to the ``by`` values that have it."""
    if mark not in _BUILT:
        owners: dict[str, set] = {}
        for shown, *key in registry.value:
            owners.setdefault(shown, set()).add(tuple(key))
        machine = ahocorasick.Automaton()
        for shown, keys in owners.items():
            machine.add_word(shown, (shown, frozenset(keys)))
        if owners:
            machine.make_automaton()
        _BUILT.clear()
        _BUILT[mark] = machine
    return _BUILT[mark]


def _searched(
    texts: DataFrame, registry: list, identity: str, text: Column, name: str, by: Sequence[str], strip: bool
) -> DataFrame:
    """(identity, by, name), once each, for every registry name that stands in a text."""
    shared, mark = texts.sparkSession.sparkContext.broadcast(registry), uuid.uuid4().hex
    asked = texts.select(identity, *by, text.cast("string").alias("_text"))
    kept = [identity, *by]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(mark, shared)
        for batch in batches:
            rows, names = [], []
            keys = list(zip(*(batch[c].to_pylist() for c in by))) if by else [()] * batch.num_rows
            for row, (shown, key) in enumerate(zip(batch["_text"].to_pylist(), keys)):
                if not shown or not len(machine):
                    continue
                found = {word for _, (word, owners) in machine.iter(shown) if key in owners}
                rows += [row] * len(found)
                names += found
            picked = batch.select(kept).take(pa.array(rows, pa.int64()))
            words = [n[1:-1] for n in names] if strip else names
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(words, pa.string())], names=[*kept, name])

    fields = [asked.schema[c] for c in kept] + [StructField(name, StringType())]
    return asked.mapInArrow(search, StructType(fields))


def whole_word_names(
    texts: DataFrame,
    names: DataFrame,
    identity: str,
    text: str,
    name: str,
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows (text identity, names columns) for every name that occurs as whole words.

    Both sides are normalised, with single spaces.  A name with a space at either end is searched for
    in the text with a space at either end.  In a registry too large for that, a word of the text is
    joined where it is some name's first word; runs from there are cut in the lengths that names
    with this first word have, however long, and compared whole.
    """
    known = names.where(F.col(name) != "")
    space = F.lit(" ")
    registry = _registry(known.withColumn(name, F.concat(space, F.col(name), space)), name, by)
    if registry is not None:
        spaced = F.concat(space, F.col(text), space)
        return _searched(texts, registry, identity, spaced, name, by, True).join(known, [*by, name])
    size = F.size(F.split(F.col(name), " "))
    lengths = known.groupBy(*by, F.substring_index(name, " ", 1).alias("_first")).agg(
        F.collect_set(size).alias("_lengths")
    )
    longest = known.agg(F.coalesce(F.max(size), F.lit(1)))
    words = texts.select(identity, *by, F.split(text, " ").alias("_words")).withColumn(
        "_longest", longest.scalar()
    )
    places = F.sequence(F.lit(1), F.size("_words"))
    # runs are kept as strings: distinct strings are told apart by hash, arrays pair by pair
    following = F.transform(places, lambda at: F.array_join(F.slice("_words", at, F.col("_longest")), " "))
    starts = words.select(identity, *by, F.explode(F.array_distinct(following)).alias("_run")).withColumn(
        "_first", F.substring_index("_run", " ", 1)
    )
    # a run shorter than n words stays whole, and still stands in the text
    cut = F.transform("_lengths", lambda n: F.call_function("substring_index", F.col("_run"), F.lit(" "), n))
    runs = starts.join(lengths, [*by, "_first"]).select(
        identity, *by, F.explode(F.array_distinct(cut)).alias(name)
    )
    return runs.distinct().join(known, [*by, name], "inner")


# names shorter than this have no block of their own in a text and are met by every window of their length
SHORT_NAME = 7
LONGEST_BLOCK = 8


def _block_length(name: Column) -> Column:
    return F.least(((F.length(name) + 1) / 2).cast("int"), F.lit(LONGEST_BLOCK))


def substring_names(
    texts: DataFrame,
    names: DataFrame,
    identity: str,
    text: str,
    name: str,
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows (text identity, names columns) for every name that occurs anywhere in the text.

    In a registry too large for the automaton a text is cut once into consecutive blocks of q characters.  A name of at least
    2q - 1 characters that occurs in it covers one of these blocks whole, at one of its
    first q offsets, so names are keyed by those q windows and the join is on equality.
    The blocks of a text are no longer than the text.  Short names have no such blocks; they
    meet the text's windows of their few lengths.  The full name is checked at the end.
    """
    known = names.where(F.length(name) > 0)
    registry = _registry(known, name, by)
    if registry is not None:
        return _searched(texts, registry, identity, F.col(text), name, by, False).join(known, [*by, name])
    short = F.length(name) < SHORT_NAME
    block = _block_length(F.col(name))
    windows = F.transform(
        F.sequence(F.lit(1), block), lambda i: F.substring(F.col(name), i, block)
    )
    keyed = known.where(~short).withColumn("_piece", F.explode(F.array_distinct(windows)))
    lengths = known.where(~short).agg(F.collect_set(block))
    sized = texts.withColumn("_s", lengths.scalar())
    none = F.array().cast("array<string>")
    cut = [
        F.when(
            F.array_contains("_s", n), F.regexp_extract_all(text, F.lit(f"(?s).{{{n}}}"), 0)
        ).otherwise(none)
        for n in range((SHORT_NAME + 1) // 2, LONGEST_BLOCK + 1)
    ]
    pieces = sized.select(
        identity, *by, F.explode(F.array_distinct(F.concat(*cut))).alias("_piece")
    )
    hits = pieces.join(keyed, [*by, "_piece"], "inner").drop("_piece").distinct()
    long_hits = hits.join(texts.select(identity, F.col(text).alias("_text")), identity).where(
        F.contains("_text", F.col(name))
    ).drop("_text")
    # short names: every window of a text as long as one of them, once each, joined on equality
    sizes = known.where(short).agg(F.array_sort(F.collect_set(F.length(name))))
    each = texts.withColumn("_sizes", F.coalesce(sizes.scalar(), F.array().cast("array<int>")))
    places = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    cuts = F.flatten(
        F.transform("_sizes", lambda n: F.array_distinct(F.transform(places, lambda at: F.substring(F.col(text), at, n))))
    )
    met = each.select(identity, *by, F.explode(F.array_distinct(cuts)).alias(name))
    short_hits = met.join(known.where(short), [*by, name]).distinct()
    return long_hits.unionByName(short_hits.select(*long_hits.columns))
