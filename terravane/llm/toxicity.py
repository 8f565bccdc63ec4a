"""Toxicity by a weighted finite-state grammar over clauses.

A lexical transducer reads words and writes word classes: insult (with a weight learned from
labelled documents, for whole words and for word beginnings), threat, target, negation, report.
Three small transducers are composed after it: negation marks what stands in its scope, reported
speech what follows it in the clause, and target whether an insult is aimed at somebody.  The
composed machine runs over each clause, and a document's score is a logistic function of the
weights of the clauses matched, by kind of match.  A kind that no labelled document holds has a stated
share of the plain weight instead of none: threats more than plain insults, what is negated or
reported less.

The lexicon counts each group of near-copies about once: of sample documents with an equal smallest
shingle hash, by either of two hashes, one is counted.  Otherwise the words of a toxic text with many
copies would pass for insults.

Labels are read only in ``train``: a bounded, documented sample of the rows of the training folds.
Scoring reads every whole text and nothing else.

Defined cases: null and empty texts match no clause and get the score of such documents; an id
labelled several times counts as toxic if one of its labels does; null labels count as none;
without labels of both kinds nothing can be learned and every score is the share of toxic labels
(0 without labels).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from terravane.llm.common import fresh, table, written
from terravane.llm.training import labelled_sample, pieces

FOLDS, HELD_OUT, TOXIC_FROM = 3, 1, 0.7
#: Labelled documents that the lexicon and the final weights are fitted on, at most.
CLEAN_SAMPLE, TOXIC_SAMPLE = 6_000, 4_000
BEGINNINGS, LEAST_WEIGHT = (4, 5, 6, 7, 8), 3.5
#: An entry needs so many toxic documents, and so many that chance alone would leave all of them toxic
#: once in CHANCE entries.
LEAST_TOXIC, CHANCE = 3, 1_000
SHINGLE_WORDS = 5
WORD, CLAUSE_END = re.compile(r"[^\W\d_]+"), re.compile(r"[.,;:!?\n]+")
#: Function words of the grammar, by class; all are arguments.
CLASSES = {
    "threat": frozenset("kill hurt destroy beat shoot töten schlagen tuer frapper matar golpear".split()),
    "target": frozenset("you your they them he she du dich ihr sie tu vous toi il elle tú usted ustedes".split()),
    "negation": frozenset("not never no nor nicht kein keine nie pas jamais non nunca jamás".split()),
    "report": frozenset("said says called claimed wrote quoted sagte schrieb dit écrit dijo escribió".split()),
}
KINDS = ("plain", "aimed", "negated", "reported", "threat")
#: Weights, in units of the plain one, of kinds that no labelled document holds.
UNSEEN = {"aimed": 1.1, "negated": 0.5, "reported": 0.3, "threat": 1.2}


@dataclass(frozen=True)
class Transducer:
    """Arcs (state, symbol) -> (state, written symbol); other symbols follow ``rest`` unchanged."""

    start: int
    arcs: Mapping[tuple[int, str], tuple[int, str]]
    rest: Mapping[int, int] = field(default_factory=dict)

    def step(self, state, symbol: str):
        found = self.arcs.get((state, symbol))
        return found if found else (self.rest.get(state, state), symbol)


def compose(first: Transducer, second: Transducer, symbols: list[str]) -> Transducer:
    """The machine that feeds what ``first`` writes to ``second``, over the given input symbols."""
    number, arcs = {(first.start, second.start): 0}, {}
    queue = [(first.start, second.start)]
    for pair in queue:
        for symbol in symbols:
            left, between = first.step(pair[0], symbol)
            right, out = second.step(pair[1], between)
            if (left, right) not in number:
                number[(left, right)] = len(number)
                queue.append((left, right))
            arcs[(number[pair], symbol)] = (number[(left, right)], out)
    return Transducer(0, arcs)


INPUT = ["insult", "threat", "target", "negation", "report", "other"]
SCOPE = 3  # words that a negation reaches
NEGATION = Transducer(
    0,
    {(s, "negation"): (SCOPE, "negation") for s in range(SCOPE + 1)}
    | {(s, "insult"): (s - 1, "negated") for s in range(1, SCOPE + 1)}
    | {(s, "threat"): (s - 1, "other") for s in range(1, SCOPE + 1)},
    {s: s - 1 for s in range(1, SCOPE + 1)},
)
REPORT = Transducer(0, {(0, "report"): (1, "report"), (1, "insult"): (1, "reported"), (1, "threat"): (1, "other")})
TARGET = Transducer(
    0,
    {(0, "target"): (1, "target"), (1, "insult"): (1, "aimed"), (1, "threat"): (1, "threat")}
    | {(0, "insult"): (0, "plain"), (0, "threat"): (2, "other"), (2, "target"): (1, "threat")}
    | {(2, "insult"): (2, "plain")},
)
GRAMMAR = compose(compose(NEGATION, REPORT, INPUT), TARGET, INPUT)


class Lexicon:
    """The lexical transducer: words to class and weight."""

    def __init__(self, weights: Mapping[str, float], classes: Mapping[str, frozenset] = CLASSES):
        # entries are whole words, or beginnings followed by "-"
        self.words = {k: w for k, w in weights.items() if not k.endswith("-")}
        self.beginnings = {k[:-1]: w for k, w in weights.items() if k.endswith("-")}
        self.lengths = sorted({len(k) for k in self.beginnings})
        self.classes = {word: name for name, words in classes.items() for word in words}
        self.threats = classes.get("threat", frozenset())

    def read(self, word: str) -> tuple[str, float]:
        weight = self.words.get(word, 0.0)
        for n in self.lengths:
            weight = max(weight, self.beginnings.get(word[:n], 0.0))
        return ("insult", weight) if weight else (self.classes.get(word, "other"), 1.0)

    def anything_in(self, words: set[str]) -> bool:
        if not (words.isdisjoint(self.words) and words.isdisjoint(self.threats)):
            return True
        return any(not {w[:n] for w in words}.isdisjoint(self.beginnings) for n in self.lengths)


def match(text: str | None, lexicon: Lexicon) -> list[float]:
    """Logarithm of one plus the weight matched over all clauses, by kind."""
    lowered = (text or "").lower()
    if not lexicon.anything_in(set(WORD.findall(lowered))):
        return [0.0] * len(KINDS)
    sums = dict.fromkeys(KINDS, 0.0)
    for clause in CLAUSE_END.split(lowered):
        state = GRAMMAR.start
        for word in WORD.findall(clause):
            symbol, weight = lexicon.read(word)
            state, out = GRAMMAR.step(state, symbol)
            if out in sums:
                sums[out] += weight
    return [math.log1p(sums[kind]) for kind in KINDS]


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    weights: np.ndarray  # per kind, then the intercept

    def score(self, matched: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(matched @ self.weights[:-1] + self.weights[-1], -50, 50)))


def _entries(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "-" for w in words for n in BEGINNINGS if len(w) > n}


def _tallies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts = {0: Counter(), 1: Counter()}
        for label, text in zip(batch["label"], batch["text"]):
            counts[label].update(_entries(text))
        keys = list(counts[0].keys() | counts[1].keys())
        yield pd.DataFrame(
            {"entry": keys, "clean": [counts[0][k] for k in keys], "toxic": [counts[1][k] for k in keys]}
        )


def _logistic_fit(x: np.ndarray, y: np.ndarray, importance: np.ndarray, ridge: float = 1e-5) -> np.ndarray:
    """Newton steps for logistic regression; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share, weights = importance / importance.sum(), np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = ridge / 100
    for _ in range(40):
        chance = 1 / (1 + np.exp(-np.clip(x @ weights, -50, 50)))
        slope = x.T @ (share * (chance - y)) + penalty * weights
        bend = (x * (share * chance * (1 - chance))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(bend, slope)
        weights = weights - move / max(1.0, np.abs(move).max() / 4)
        if np.abs(move).max() < 1e-9:
            break
    return weights


def with_unseen(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The weights, with shares of the plain one for kinds that no row of x holds."""
    plain = max(weights[KINDS.index("plain")], 0.0)
    prior = np.array([UNSEEN.get(kind, 0.0) * plain for kind in KINDS])
    return np.append(np.where(x.any(axis=0), weights[:-1], prior), weights[-1])


def _least_shingle(text: str, seed: int) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    runs = [words[i : i + SHINGLE_WORDS] for i in range(max(1, len(words) - SHINGLE_WORDS + 1))]
    return min(xxhash.xxh64_intdigest(b" ".join(run), seed) for run in runs) >> 1


@F.pandas_udf(StructType([StructField("one", LongType()), StructField("two", LongType())]))
def _sketch(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"one": [_least_shingle(t, 1) for t in texts], "two": [_least_shingle(t, 2) for t in texts]})


def without_copies(sample: DataFrame) -> DataFrame:
    """(label, text) rows of the sample, of near-copies about one."""
    sketched = sample.select("label", "text", _sketch("text").alias("s"))
    once = sketched.groupBy("label", "s.one").agg(F.min(F.struct("s.two", "text")).alias("r"))
    return once.groupBy("label", "r.two").agg(F.min("r.text").alias("text")).select("label", "text")


def held_out(doc_id: str = "doc_id") -> Column:
    fold = F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == HELD_OUT, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, classes: Mapping[str, frozenset] = CLASSES) -> Model:
    """Lexicon and weights from the labels of the training folds."""
    rated = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("label"))
    )
    most = [CLEAN_SAMPLE, TOXIC_SAMPLE]
    drawn, counts = labelled_sample(documents, rated, [0, 1], most)
    sample = written(without_copies(drawn).coalesce(pieces(most)), "distinct-sample")
    found = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    clean, toxic = found.get(0, 0), found.get(1, 0)
    if not clean or not toxic:
        share = counts.get(1, 0) / max(1, sum(counts.values()))
        odds = math.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return Model(Lexicon({}, {}), np.array([0.0] * len(KINDS) + [odds]))
    least = max(LEAST_TOXIC, math.ceil(math.log(CHANCE) / math.log((toxic + clean) / toxic)))
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    learned = (
        sample.mapInPandas(_tallies, "entry string, clean long, toxic long")
        .groupBy("entry")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(F.col("toxic") >= least)
        .withColumn("weight", weight)
        .where(F.col("weight") >= LEAST_WEIGHT)
        .collect()  # no more entries than the bounded sample has
    )
    lexicon = Lexicon({r["entry"]: r["weight"] for r in learned}, classes)

    def matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [match(text, lexicon) for text in batch["text"]]
            yield pd.DataFrame({"label": batch["label"], "found": found})

    rows = sample.mapInPandas(matched, "label int, found array<double>").toPandas()
    y = rows["label"].to_numpy(float)
    importance = np.where(y == 1, counts[1] / toxic, counts[0] / clean)
    x = np.array(rows["found"].tolist())
    return Model(lexicon, with_unseen(_logistic_fit(x, y, importance), x))


def scorer(model: Model):
    """Column function: text to score."""

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        found = np.array([match(text, model.lexicon) for text in texts], dtype=float)
        return pd.Series(model.score(found.reshape(-1, len(KINDS))))

    return score


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train(documents, labels)
    scored = documents.select(
        "doc_id", held_out().alias("held_out"), scorer(model)(F.col("text").cast("string")).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


def keep_clean(documents: DataFrame, labels: DataFrame, toxic_from: float = TOXIC_FROM) -> DataFrame:
    """The documents below the limit, in the columns they came with."""
    (mark,) = fresh(documents, "mark")
    scored = documents.withColumn(mark, scorer(train(documents, labels))(F.col("text").cast("string")))
    return scored.where(F.col(mark) < toxic_from).drop(mark)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
