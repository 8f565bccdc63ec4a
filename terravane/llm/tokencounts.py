"""Token counts under a unigram model, by dynamic programming shared along a trie.

A pre-token's best segmentation maximises the sum of its pieces' scores.  The forward score of a
prefix depends on the prefix alone, so distinct pre-tokens, put in order, are walked like the
branches of a trie: what a pre-token shares with the one before it is already computed, and only
the rest of its letters is scored.  Each terminal stores its token count; texts add up the counts
of their pre-tokens.  Ties go to the segmentation with fewer tokens.

The vocabulary is a public piece file; its scores say only the order of pieces, so a piece's
unigram score is that of a Zipf-Mandelbrot law over its rank.  Letters outside the vocabulary
cost one byte token for each of their UTF-8 bytes.

Defined cases: null, empty and white-space texts have no pre-tokens and 0 tokens; repeated rows are
counted each; no text is cut, however long.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm.common import table

VOCABULARY, SPACE = "piece_bpe_32k.model", "▁"
RANK_SHIFT, BYTE_SCORE = 2.7, -14.0
#: Distinct pre-tokens a worker remembers before it starts afresh; bounds memory, not results.
REMEMBERED = 400_000


@functools.lru_cache(maxsize=2)
def piece_scores(vocabulary: str = VOCABULARY) -> dict[str, float]:
    """Logarithmic unigram score of every ordinary piece."""
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
    plain = [
        (model.get_score(i), i)
        for i in range(model.get_piece_size())
        if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))
    ]
    order = [model.id_to_piece(i) for _, i in sorted(plain, key=lambda p: (-p[0], p[1]))]
    raw = [-math.log(rank + RANK_SHIFT) for rank in range(len(order))]
    norm = math.log(sum(map(math.exp, raw)))
    return {piece: value - norm for piece, value in zip(order, raw)}


def terminal_counts(words: Iterable[str], scores: Mapping[str, float], longest: int) -> dict[str, int]:
    """Token count of each distinct word's best segmentation."""
    found: dict[str, int] = {}
    before = ""
    best, counts = [0.0], [0]  # forward score and tokens of each prefix on the present branch
    for word in sorted(set(words)):
        shared = 0
        for a, b in zip(before, word):
            if a != b:
                break
            shared += 1
        del best[shared + 1 :], counts[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            spent = len(word[end - 1].encode("utf-8", "surrogatepass"))
            top, least = best[end - 1] + spent * BYTE_SCORE, counts[end - 1] + spent
            for start in range(max(0, end - longest), end):
                score = scores.get(word[start:end])
                if score is not None:
                    score += best[start]
                    if score > top or (score == top and counts[start] + 1 < least):
                        top, least = score, counts[start] + 1
            best.append(top)
            counts.append(least)
        found[word] = counts[-1]
        before = word
    return found


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_pre_tokens, n_tokens of every document's whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = piece_scores(vocabulary)
        longest = max(map(len, scores))
        known: dict[str, int] = {}
        for batch in batches:
            texts = [Counter((text or "").split()) for text in batch.column("text").to_pylist()]
            distinct = set().union(*texts) if texts else set()
            if len(known) > REMEMBERED:
                known.clear()
            new = terminal_counts((SPACE + w for w in distinct.difference(known)), scores, longest)
            known.update((word[1:], n) for word, n in new.items())
            sizes = [sum(words.values()) for words in texts]
            tokens = [sum(known[w] * n for w, n in words.items()) for words in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())],
                ["doc_id", "n_pre_tokens", "n_tokens"],
            )

    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return slim.mapInArrow(count, "doc_id long, n_pre_tokens long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
