"""One document of each group of near-copies, by the exact similarity of five-word shingles.

Two texts are near-copies if the Jaccard similarity of their sets of five-word shingles is ``LEAST``
or more; groups are the components of that relation.  Words are those of the SimHash operator: A-Z in
lower case, cut at ASCII white space.  A text of fewer than five words is one shingle.

Equal sets are first reduced to one node.  Nodes meet in buckets of two kinds.  The components of the
SimHash operator, found by its fingerprints and anchors, are the first.  Its three bits miss most pairs
near 0.8, whose fingerprints differ in about ten bits, so the bands of a MinHash are the second: 48 bands
of 6 minima, in which a pair of similarity 0.8 has no band in common with a probability of
(1 - 0.8^6)^48 = 5e-7, and a more similar pair with less.  Every pair that counts is verified on the
texts, so no document goes for a hash.  To keep a large group from making all its pairs, the members of
a bucket first meet one of them.  Only in buckets that still hold several components do all members
meet, in blocks of bounded size that give nothing but the links found.

Defined cases: texts without words are copies of each other and of nothing else; repeated rows and
rows without an id are rows of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from terravane.llm.common import fresh, written
from terravane.llm.simhash import components, fingerprint, links

SHINGLE_WORDS, SEED, LEAST = 5, 42, 0.8
BANDS, MINIMA = 48, 6
#: Members of a block of a bucket.
BLOCK = 512
#: Shingles that shared ones are counted over at a time; bounds memory.
COLUMNS = 2_048
#: Shingles that minima are taken over at a time; bounds memory.
AT_ONCE = 256
_DRAWN = np.random.Generator(np.random.PCG64(SEED))
FACTORS = _DRAWN.integers(0, 1 << 63, BANDS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WEIGHTS = _DRAWN.integers(0, 1 << 63, (BANDS, MINIMA), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MARKS = (
    StructType()
    .add("key", StringType())
    .add("size", LongType())
    .add("bands", ArrayType(LongType()))
    .add("print", LongType())
)


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles of one whole text, in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE_WORDS:
        found = {digest(b" ".join(words), SEED)}
    else:
        runs = zip(words, words[1:], words[2:], words[3:], words[4:])
        found = {digest(b"%b %b %b %b %b" % run, SEED) for run in runs}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One signed number per band; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), AT_ONCE):
        np.minimum(least, np.multiply.outer(FACTORS, hashes[at : at + AT_ONCE]).min(axis=1), out=least)
    least ^= least >> np.uint64(29)
    return (least.reshape(BANDS, MINIMA) * WEIGHTS).sum(axis=1, dtype=np.uint64).view(np.int64)


@F.pandas_udf(MARKS)
def _marks_of(texts: pd.Series) -> pd.DataFrame:
    sets = [shingles(text) for text in texts]
    return pd.DataFrame(
        {
            "key": [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets],
            "size": np.array([len(s) for s in sets], dtype="int64"),
            "bands": [bands(s) for s in sets],
            "print": np.array([fingerprint(text) for text in texts], dtype="int64"),
        }
    )


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets reach the similarity; two empty ones do."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= least * (len(a) + len(b) - shared) - 1e-9


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """a, b, same of every pair (a, b), by the texts (node, text)."""

    @F.pandas_udf("boolean")
    def same(left: pd.Series, right: pd.Series) -> pd.Series:
        seen: dict[str, np.ndarray] = {}  # of one batch, in which one text often meets many
        found = []
        for pair in zip(left, right):
            for text in pair:
                if text not in seen:
                    seen[text] = shingles(text)
            found.append(similar(seen[pair[0]], seen[pair[1]], least))
        return pd.Series(found, dtype="bool")

    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", same("text_a", "text_b").alias("same"))


def block_links(sets: list[np.ndarray], labels: np.ndarray, sides: np.ndarray, least: float) -> np.ndarray:
    """Pairs of places in the lists: sets of different labels that reach the similarity.

    Where there are two sides, only pairs across them count.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, word, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    held = count[word] > 1
    owner, word = owner[held], np.unique(word[held], return_inverse=True)[1]
    order = np.argsort(word, kind="stable")
    owner, word = owner[order], word[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(word[-1]) + 1 if len(word) else 0, COLUMNS):
        part = slice(*np.searchsorted(word, [low, low + COLUMNS]))
        matrix = np.zeros((len(sets), COLUMNS), np.float32)
        matrix[owner[part], word[part] - low] = 1
        shared += matrix @ matrix.T
    near = shared >= least * (sizes[:, None] + sizes[None, :] - shared) - 1e-9
    near &= labels[:, None] != labels[None, :]
    if sides.any() and not sides.all():
        near &= sides[:, None] != sides[None, :]
    return np.argwhere(np.triu(near, 1))


def _left_over(rest: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between members (bucket, node, label, blocks) of a bucket that have different labels.

    A bucket is dealt over ``blocks`` blocks, each pair of which is one group of bounded size.
    """
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = (
        rest.join(texts, "node")
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(
            "bucket",
            F.least("mine", "other").alias("low"),
            F.greatest("mine", "other").alias("high"),
            (F.col("mine") > F.col("other")).alias("side"),
            "node",
            "label",
            "text",
        )
    )

    def meet(found: pa.Table) -> pa.Table:
        met = np.zeros((0, 2), np.int64)
        if found.num_rows > 1:
            nodes, labels = found.column("node").to_numpy(), found.column("label").to_numpy()
            sides = found.column("side").to_numpy(zero_copy_only=False).astype(bool)
            sets = [shingles(text) for text in found.column("text").to_pylist()]
            met = np.sort(nodes[block_links(sets, labels, sides, least)].reshape(-1, 2), axis=1)
        return pa.table({"a": pa.array(met[:, 0], pa.int64()), "b": pa.array(met[:, 1], pa.int64())})

    return dealt.groupBy("bucket", "low", "high").applyInArrow(meet, "a long, b long").distinct()


def thinned(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with the same components and the same nodes, in a number that follows the nodes'.

    Every node is tied to its least neighbour, and a pair then only has to tie the least neighbours of
    its ends: the many pairs of a dense group come down to a few distinct ones.
    """
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("low")), "near")
    low_b = near.select(F.col("a").alias("b"), F.col("low").alias("low_b"))
    ends = pairs.join(near, "a").join(low_b, "b").where("low != low_b")
    between = ends.select(F.least("low", "low_b").alias("a"), F.greatest("low", "low_b").alias("b"))
    tied = near.where("low != a").select(F.col("low").alias("a"), F.col("a").alias("b"))
    return written(tied.unionByName(between).distinct(), "thinned")


def _labels(linked: DataFrame) -> DataFrame:
    return components(thinned(linked)).select(F.col("print").alias("node"), "label")


def with_classes(sets: DataFrame) -> DataFrame:
    """(node, size, bands) of (node, size, bands, print): the SimHash component is one more bucket.

    Nodes alone in their component have nobody to meet there and get none.
    """
    label = components(thinned(written(links(sets.select("print").distinct()), "prints")))
    classed = sets.join(label, "print", "left").withColumn("label", F.coalesce("label", "print"))
    many = written(classed.groupBy("label").count().where("count > 1").select("label"), "classes")
    bucket = F.array(F.xxhash64(F.lit("simhash"), "label"))
    met = classed.join(many.withColumn("met", F.lit(True)), "label", "left")
    return met.select("node", "size", F.when(F.col("met"), F.concat("bands", bucket)).otherwise(F.col("bands")).alias("bands"))


def groups(sets: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """(node, label) of every node of (node, size, bands) with a near-copy."""
    spots = sets.select("node", "size", F.explode("bands").alias("bucket"))
    # the head of a bucket is any one of its members
    drawn = F.min(F.struct(F.xxhash64("node").alias("drawn"), "node", "size")).alias("head")
    many = spots.groupBy("bucket").agg(drawn, F.count("*").alias("count")).where("count > 1")
    heads = written(
        many.select("bucket", F.col("head.node").alias("head"), F.col("head.size").alias("head_size")), "heads"
    )
    shared = written(spots.join(heads, "bucket"), "shared")
    fits = F.least("size", "head_size") >= least * F.greatest("size", "head_size") - 1e-9
    pairs = (
        shared.where((F.col("node") != F.col("head")) & fits)
        .select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b"))
        .distinct()
    )
    checked = written(_verified(written(pairs, "pairs"), texts, least), "checked")
    linked = checked.where("same").select("a", "b")
    label = _labels(linked)

    labelled = written(
        shared.join(label, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label")),
        "labelled",
    )
    still = (
        labelled.groupBy("bucket")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("count"))
        # of two members, the pair has been tested
        .where("low != high and count > 2")
        .select("bucket", F.ceil(F.col("count") / BLOCK).cast("long").alias("blocks"))
    )
    rest = written(labelled.join(written(still, "open"), "bucket"), "rest")
    further = written(_left_over(rest, texts, least), "further")
    return label if further.isEmpty() else _labels(linked.unionByName(further))


def keep_one(documents: DataFrame, least: float = LEAST) -> DataFrame:
    """One document of each group of near-copies, in the columns they came with.

    The kept row is one of the group's smallest id; a group without any id keeps one of its rows.
    """
    tag, mark, wanted = fresh(documents, "row_tag", "row_mark", "wanted")
    text = F.col("text").cast("string")
    marked = written(
        documents.withColumns({tag: F.monotonically_increasing_id(), mark: _marks_of(text)}), "marked"
    )
    doc = F.col("doc_id").cast("long")
    candidate = F.struct(doc.isNull().alias("no_id"), doc.alias("doc_id"), F.col(tag).alias("tag"))
    nodes = written(
        marked.select(F.col(f"{mark}.key").alias("key"), candidate.alias("candidate"))
        .groupBy("key")
        .agg(F.min("candidate").alias("first"))
        .select(F.col("first.tag").alias("node"), "first"),
        "nodes",
    )
    sets = marked.select(
        F.col(tag).alias("node"), *[F.col(f"{mark}.{part}").alias(part) for part in ("size", "bands", "print")]
    ).join(nodes.select("node"), "node", "left_semi")
    met = written(with_classes(written(sets, "sets")), "met")
    label = groups(met, marked.select(F.col(tag).alias("node"), text.alias("text")), least)
    chosen = (
        nodes.join(label, "node", "left")
        .groupBy(F.coalesce("label", "node").alias("label"))
        .agg(F.min("first").alias("first"))
        .select(F.col("first.tag").alias(wanted))
    )
    return marked.join(chosen, F.col(tag) == F.col(wanted), "left_semi").drop(tag, mark)
