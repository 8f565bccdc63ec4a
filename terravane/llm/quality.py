"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One shared weight vector over hashed text features gives every document a position on a line,
and ordered thresholds cut the line into grades: P(grade <= k) = logistic(threshold_k - position).
Expected grade and tail probability P(grade >= passing) follow.  The model is fitted on a bounded,
documented sample (``PER_GRADE`` documents of each grade, weighted back to the grades' shares);
scoring reads every whole text.

Features: each white-space word's share of the text, square-rooted, hashed; and the same for the
word's shape (runs of lower, upper, digit or other letters).  Besides, how much repeats: the share of
words that equal the word before them, and of word pairs that stood earlier in the text, each as a
value and as a step.

Defined cases: null and empty texts have no features and stand at position 0; documents without a
rating are scored like others; an id rated several times has its lowest grade; null ratings count
as none; without any rating no grade can be told, so grades are null and every document is kept.
"""

from __future__ import annotations

import itertools
import math
import operator
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm.common import fresh, table
from terravane.llm.training import labelled_sample

WORD_DIMENSIONS, SHAPE_DIMENSIONS = 1 << 15, 1 << 12
REPEAT_STEPS = 10
REPEAT_DIMENSIONS = 2 * (REPEAT_STEPS + 2)
DIMENSIONS = WORD_DIMENSIONS + SHAPE_DIMENSIONS + REPEAT_DIMENSIONS
GRADES, PASSING, KEEP_FROM = 3, 1, 0.5
#: Rated documents of each grade that the model is fitted on, at most.
PER_GRADE = 2_500
STEPS, RATE, RIDGE = 200, 0.4, 3e-5
REMEMBERED = 300_000
_known: dict[str, int] = {}


def _shape(word: str) -> str:
    kinds = (
        "a" if c.islower() else "A" if c.isupper() else "b" if c.isalpha() else "0" if c.isdigit() else c
        for c in word
    )
    return "".join(kind for kind, _ in itertools.groupby(kinds))


def _numbers(word: str) -> int:
    """The word's feature, and its shape's 32 bits higher."""
    coded = word.encode("utf-8", "surrogatepass")
    shape = zlib.crc32(_shape(word).encode("utf-8", "surrogatepass")) % SHAPE_DIMENSIONS
    return zlib.crc32(coded) % WORD_DIMENSIONS | (WORD_DIMENSIONS + shape) << 32


def _repeats(words: list[str]) -> tuple[list[int], list[float]]:
    pairs = len(words) - 1
    if pairs < 1:
        return [], []
    following = sum(map(operator.eq, words, itertools.islice(words, 1, None)))
    again = pairs - len(set(zip(words, itertools.islice(words, 1, None))))
    numbers, values = [], []
    for kind, share in enumerate((following / pairs, again / pairs)):
        base = WORD_DIMENSIONS + SHAPE_DIMENSIONS + kind * (REPEAT_STEPS + 2)
        numbers += [base, base + 1 + int(share * REPEAT_STEPS)]
        values += [math.sqrt(share), 0.5]
    return numbers, values


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (a number may occur again) and values of one whole text."""
    words = (text or "").split()
    counts = Counter(words)
    if not counts:
        return np.empty(0, np.int64), np.empty(0)
    if len(_known) > REMEMBERED:
        _known.clear()
    for word in counts:
        if word not in _known:
            _known[word] = _numbers(word)
    both = np.fromiter(map(_known.__getitem__, counts), np.int64, len(counts))
    share = np.fromiter(counts.values(), np.float64, len(counts))
    share /= share.sum()
    shapes = np.bincount((both >> 32) - WORD_DIMENSIONS, weights=share)
    present = np.flatnonzero(shapes)
    more, steps = _repeats(words)
    numbers = np.concatenate([both & 0xFFFFFFFF, present + WORD_DIMENSIONS, np.array(more, np.int64)])
    return numbers, np.concatenate([np.sqrt(np.concatenate([share, shapes[present]])), steps])


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class OrdinalModel:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, positions: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 ... as columns."""
        return _logistic(positions[:, None] - self.thresholds[None, :])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, importance: np.ndarray, top: int):
    """Weighted maximum likelihood with a ridge penalty, by full-batch Adam steps.

    Thresholds are the first one and the logarithms of the gaps above it, so they stay ordered.
    """
    lengths = np.array([len(n) for n, _ in rows])
    numbers = np.concatenate([n for n, _ in rows]) if len(rows) else np.empty(0, np.int64)
    values = np.concatenate([v for _, v in rows]) if len(rows) else np.empty(0)
    owner = np.repeat(np.arange(len(rows)), lengths)
    width = DIMENSIONS
    share = importance / importance.sum()
    state = np.zeros(width + top - 1)
    state[width] = -1.0
    mean, spread = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, STEPS + 1):
        weights, gaps = state[:width], np.exp(np.clip(state[width + 1 :], -8, 8))
        thresholds = state[width] + np.concatenate([[0.0], np.cumsum(gaps)])
        position = np.bincount(owner, weights=values * weights[numbers], minlength=len(rows))
        bounds = np.concatenate([[-np.inf], thresholds, [np.inf]])
        high = _logistic(bounds[grades + 1] - position)
        low = _logistic(bounds[grades] - position)
        chance = np.maximum(high - low, 1e-12)
        slope_high, slope_low = high * (1 - high) / chance, low * (1 - low) / chance
        by_position = share * (slope_high - slope_low)
        by_threshold = np.zeros(top + 2)
        np.add.at(by_threshold, grades + 1, -share * slope_high)
        np.add.at(by_threshold, grades, share * slope_low)
        by_threshold = by_threshold[1:top]
        gradient = np.empty_like(state)
        gradient[:width] = np.bincount(numbers, weights=values * by_position[owner], minlength=width)
        gradient[:width] += RIDGE * weights
        gradient[width] = by_threshold.sum()
        gradient[width + 1 :] = np.cumsum(by_threshold[::-1])[::-1][1:] * gaps
        mean += 0.1 * (gradient - mean)
        spread += 0.01 * (gradient**2 - spread)
        state -= (
            RATE * (1 - step / (STEPS + 1))
            * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-9)
        )
    gaps = np.exp(np.clip(state[width + 1 :], -8, 8))
    return OrdinalModel(state[:width], state[width] + np.concatenate([[0.0], np.cumsum(gaps)]))


def train(documents: DataFrame, ratings: DataFrame, grades: int = GRADES, per_grade: int = PER_GRADE):
    """A model from (doc_id, grade) ratings, or None where there is none."""
    rated = (
        ratings.where(F.col("doc_id").isNotNull() & F.col("grade").between(0, grades - 1))
        .groupBy("doc_id")
        .agg(F.min("grade").cast("int").alias("label"))
    )
    values = list(range(grades))
    sample, counts = labelled_sample(documents, rated, values, [per_grade] * grades)

    def extract(batches):
        for batch in batches:
            found = [features(text) for text in batch["text"]]
            yield pd.DataFrame(
                {"label": batch["label"], "numbers": [n for n, _ in found], "values": [v for _, v in found]}
            )

    # bounded by grades * per_grade documents
    taken = sample.mapInPandas(extract, "label int, numbers array<long>, values array<double>").toPandas()
    if taken.empty:
        return None
    labels = taken["label"].to_numpy()
    drawn = np.bincount(labels, minlength=grades)
    importance = np.array([counts.get(v, 0) / max(drawn[v], 1) for v in values])[labels]
    rows = [(np.asarray(n, np.int64), np.asarray(v, float)) for n, v in zip(taken["numbers"], taken["values"])]
    return fit(rows, labels, importance, grades)


def scorer(model: OrdinalModel, passing: int = PASSING):
    """Column function: text to struct of expected grade and tail probability."""

    @F.pandas_udf("expected_grade double, p_tail double")
    def score(texts: pd.Series) -> pd.DataFrame:
        positions = np.array([float(model.weights[n] @ v) for n, v in map(features, texts)], dtype=float)
        tails = model.tails(positions)
        return pd.DataFrame({"expected_grade": tails.sum(axis=1), "p_tail": tails[:, passing - 1]})

    return score


def grade(documents: DataFrame, ratings: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, expected_grade, p_tail and keep of every document."""
    model = train(documents, ratings)
    if model is None:
        return documents.select(
            "doc_id",
            F.lit(None).cast("double").alias("expected_grade"),
            F.lit(None).cast("double").alias("p_tail"),
            F.lit(True).alias("keep"),
        )
    scored = documents.select("doc_id", scorer(model)(F.col("text").cast("string")).alias("s"))
    return scored.select("doc_id", "s.*", (F.col("s.p_tail") >= keep_from).alias("keep"))


def keep_good(documents: DataFrame, ratings: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents whose tail probability reaches ``keep_from``, in the columns they came with."""
    model = train(documents, ratings)
    if model is None:
        return documents
    (mark,) = fresh(documents, "mark")
    scored = documents.withColumn(mark, scorer(model)(F.col("text").cast("string")))
    return scored.where(F.col(f"{mark}.p_tail") >= keep_from).drop(mark)


def ratings_of(labels: DataFrame) -> DataFrame:
    """Three grades of the labels table: poor, good but toxic, good."""
    quality, toxic = F.col("quality"), F.coalesce(F.col("toxic"), F.lit(0))
    grade_of = F.when(quality == 0, 0).when(quality == 1, F.when(toxic == 1, 1).otherwise(2))
    return labels.select("doc_id", grade_of.alias("grade"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade(table(spark, sf_dir, "documents"), ratings_of(table(spark, sf_dir, "labels")))
