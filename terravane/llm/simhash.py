"""SimHash near-duplicates through anchor points of a covering code.

A fingerprint has 64 bits; two fingerprints link at 3 differing bits or fewer.  Cut into two
halves of 32 bits, linked fingerprints differ in one bit at most in one of the halves.  There
the anchors are the words of the Hamming code of length 31, whose balls of radius 1 cover every
31-bit word exactly once.  A fingerprint is at home at the one anchor within the covering
radius 1, and is replicated to every anchor within radius plus threshold, 1 + 1 = 2: at most 16
of 2^26 anchors in a half.  So each link meets at the home anchor of either end, where the 64
bits are compared.  All of it is integer arithmetic in the JVM; only the hashing of shingles
runs in Python.

Equal fingerprints are first reduced to one row with their smallest document id, so copies
never meet each other.  Links join classes, and classes come from minimum labels that jump to
their label's label, written to the shared folder in each round.

Defined cases: null and empty texts have fingerprint zero and link like any other; a document
without an id gets the component of its fingerprint; where a whole component has no id, the
component is null; repeated rows are rows of their own with one fingerprint.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from terravane.llm.common import fresh, table, written

SHINGLE_WORDS, SEED, DISTANCE = 3, 42, 3
BYTE_BITS = np.array([[(v >> b) & 1 for b in range(8)] for v in range(256)], dtype=np.int64)
# bit j of a position's number decides whether the position counts in parity j
PARITY_MASKS = tuple(sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5))


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = len(words) - SHINGLE_WORDS + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b"%b %b %b" % three, SEED) for three in zip(words, words[1:], words[2:])]
    columns = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate(
        [np.bincount(columns[:, b], minlength=256) @ BYTE_BITS for b in range(8)]
    )
    value = sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(hashes)))
    return value - (1 << 64) if value >> 63 else value


@F.pandas_udf(LongType())
def _print_of(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(text) for text in texts], dtype="int64")


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and print (signed 64 bits) of every row."""
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), _print_of(F.col("text").cast("string")).alias("print")
    )


def _half(value: Column, side: int) -> Column:
    """31 bits of one half."""
    return F.shiftrightunsigned(value, 32 * side).bitwiseAND(F.lit((1 << 31) - 1))


def _syndrome(word: Column) -> Column:
    """The position to flip to reach the code, 0 for a code word."""
    parts = [
        (F.bit_count(word.bitwiseAND(F.lit(mask))) % 2) * (1 << j) for j, mask in enumerate(PARITY_MASKS)
    ]
    return sum(parts[1:], parts[0])


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (position - 1).cast("int"))


def anchors(value: Column) -> tuple[Column, Column]:
    """Home anchors, one per half, and for each half all anchors within radius plus threshold.

    An anchor is its half's number above 31 bits of code word.
    """
    halves = [_half_anchors(value, side) for side in (0, 1)]
    return F.array(*[home for home, _ in halves]), F.concat(*[visits for _, visits in halves])


def _half_anchors(value: Column, side: int) -> tuple[Column, Column]:
    word, tag = _half(value, side), F.lit(side << 31)
    syndrome = _syndrome(word)
    home = F.when(syndrome == 0, word).otherwise(word.bitwiseXOR(_bit(syndrome))).bitwiseOR(tag)
    # two flips p and p XOR syndrome lead to a code word as well
    pairs = F.filter(
        F.sequence(F.lit(1), F.lit(31)), lambda p: (p < p.bitwiseXOR(syndrome)) & (p != syndrome)
    )
    around = F.transform(
        pairs,
        lambda p: word.bitwiseXOR(_bit(p)).bitwiseXOR(_bit(p.bitwiseXOR(syndrome))).bitwiseOR(tag),
    )
    lone = F.array(home)
    return home, F.when(syndrome == 0, lone).otherwise(F.concat(lone, around))


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints at ``distance`` differing bits or fewer."""
    if not 0 <= distance <= 3:
        raise ValueError("two halves with one anchor radius each find links of at most 3 bits")
    homes, visits = anchors(F.col("print"))
    home = prints.select(F.col("print").alias("a"), F.explode(homes).alias("anchor"))
    visit = prints.select(F.col("print").alias("b"), F.explode(visits).alias("anchor"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    # sized by the prints alone, the up to 32 visits of each would be broadcast whole
    met = home.join(
        visit.hint("merge"), (home["anchor"] == visit["anchor"]) & (F.col("a") < F.col("b")) & near
    )
    return met.select("a", "b")


def components(pairs: DataFrame) -> DataFrame:
    """(print, label): the smallest fingerprint reachable, for every fingerprint with a link."""
    both = written(
        pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    label = written(
        both.groupBy("a").agg(F.min("b").alias("least")).select(
            F.col("a").alias("print"), F.least("a", "least").alias("label")
        ),
        "labels",
    )
    while True:
        heard = (
            both.join(label.select(F.col("print").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("print"))
            .agg(F.min("label").alias("heard"))
        )
        lowered = label.join(heard, "print").select(
            "print", F.col("label").alias("old"), F.least("label", "heard").alias("label")
        )
        lowered = written(lowered, "labels")
        # jump: a label's own label is at least as small
        above = lowered.select(F.col("print").alias("label"), F.col("label").alias("higher"))
        jumped = written(
            lowered.join(above, "label", "left").select(
                "print", "old", F.least("label", "higher").alias("label")
            ),
            "labels",
        )
        label = jumped.select("print", "label")
        if jumped.where(F.col("old") != F.col("label")).isEmpty():
            return label


def classes(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(print, label, component_id) of the distinct fingerprints of (doc_id, print) rows."""
    nodes = written(prints.groupBy("print").agg(F.min("doc_id").alias("first_id")), "prints")
    label = components(links(nodes.select("print"), distance))
    marked = nodes.join(label, "print", "left").withColumn("label", F.coalesce("label", "print"))
    least = marked.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return marked.join(least, "label").select("print", "label", "component_id")


def near_duplicates(documents: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint as 16 hexadecimal digits, component_id."""
    prints = written(fingerprints(documents), "fingerprints")
    found = classes(prints, distance)
    return prints.join(found, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(documents: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One document of each component, in the columns they came with.

    The kept row is one of the component's smallest id; rows repeating that id count as copies.
    A component without any id keeps one of its rows.
    """
    tag, mark, wanted = fresh(documents, "row_tag", "row_print", "wanted")
    marked = written(
        documents.withColumns(
            {tag: F.monotonically_increasing_id(), mark: _print_of(F.col("text").cast("string"))}
        ),
        "marked",
    )
    prints = marked.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(mark).alias("print"), F.col(tag).alias("tag")
    )
    found = classes(prints, distance)
    candidate = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag")
    kind = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("p"), F.col("label").cast("string")))
    # partial minima per print and then per class: copies never meet in one task
    chosen = (
        prints.groupBy("print")
        .agg(F.min(candidate).alias("first"))
        .join(found, "print")
        .groupBy(kind.alias("kind"))
        .agg(F.min("first").alias("first"))
        .select(F.col("first.tag").alias(wanted))
    )
    return marked.join(chosen, F.col(tag) == F.col(wanted), "left_semi").drop(tag, mark)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
