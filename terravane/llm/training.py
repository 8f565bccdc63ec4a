"""Bounded samples of labelled documents to fit a model on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm.common import written

#: Rows of a sample that a written piece holds, about.
PIECE = 500


def pieces(most: Sequence[int]) -> int:
    """Files of a sample of at most ``most`` rows per label, however many shuffle partitions there are."""
    return max(1, sum(most) // PIECE)


def labelled_sample(
    documents: DataFrame, rated: DataFrame, values: Sequence[int], most: Sequence[int]
) -> tuple[DataFrame, dict[int, int]]:
    """(label, text) of at most ``most[i]`` documents with label ``values[i]``, and all labels' counts.

    ``rated`` has one row (doc_id, label) per id.  Within a label the ids of smallest hash are
    taken, so the sample does not depend on order or partitioning.  The chosen ids, at most
    ``sum(most)`` rows, are the only broadcast.  The sample is written in a few files: each file
    costs the executors processes of their own, which hundreds of almost empty ones would multiply.
    """
    counts = {r["label"]: r["count"] for r in rated.groupBy("label").count().collect() if r["label"] in values}
    parts = [
        rated.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        for value, limit in zip(values, most)
    ]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.union(part)
    chosen = written(chosen.select(F.col("doc_id").alias("chosen_id"), "label"), "chosen")
    slim = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    sample = slim.join(F.broadcast(chosen), slim["doc_id"] == chosen["chosen_id"])
    # an id given to several rows counts once
    sample = sample.groupBy("chosen_id").agg(F.first("label").alias("label"), F.min("text").alias("text"))
    return written(sample.select("label", "text").coalesce(pieces(most)), "sample"), counts
