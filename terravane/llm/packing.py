"""Best-fit packing of token pieces into sequences of bounded length, with certified bin counts.

Pieces are dealt evenly over partitions, and each partition is packed by best-fit decreasing.
Dual feasible functions give a lower bound on the bins any packing of the partition needs; a
partition that meets its bound is certified and keeps its bins.  Partitions with a gap keep
their full bins and hand over the pieces of the others, and so does every partition with its
emptiest bin; what is handed over is dealt anew over partitions and packed again.  Exchanges go on
while they save bins, and end early once the bins handed over are certified as a whole.  Only
lengths travel, never token ids.

Defined cases: a null or empty text is the end id alone; a text longer than a sequence, end id
included, is cut into full pieces and a rest; repeated rows are packed each; pieces of one length
are interchangeable, so ties are broken by the order of dealing.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm.common import table, written
from terravane.llm.tokens import WORD_BPE, encoder

CAPACITY, END_ID = 2048, 0
#: Pieces of a partition in the first and in later rounds; at least SPREAD partitions where
#: each has FEWEST pieces.
ROUND_SIZES, SPREAD, FEWEST = (20_000, 60_000, 60_000), 16, 300
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = WORD_BPE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""
    end = np.array([END_ID], dtype="<u4").tobytes()
    width = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            doc_ids, rows = batch.column("doc_id").to_pylist(), []
            for doc_id, text in zip(doc_ids, batch.column("text").to_pylist()):
                ids = encode(text) + end
                for number, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append((doc_id, number, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return slim.mapInArrow(cut, PIECE_SCHEMA)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY, counts: np.ndarray | None = None) -> int:
    """Fewest bins any packing of the lengths can have, by two families of dual feasible functions.

    With ``counts``, each length stands for that many pieces.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    if counts is not None:
        count = np.zeros(capacity + 1, np.int64)
        np.add.at(count, lengths, counts)
    size = np.arange(capacity + 1)
    many, total = np.cumsum(count), np.cumsum(count * size)
    # small pieces below a limit count nothing, pieces above capacity minus the limit a whole bin
    limit = np.arange(capacity // 2 + 1)
    large = many[capacity] - many[capacity - limit]
    below = np.where(limit > 0, total[np.maximum(limit - 1, 0)], 0)
    middle = total[capacity - limit] - below
    best = int((large + -(-middle // capacity)).max())
    # sizes rounded to k-th parts of a bin; a whole number of (k+1)-th parts stays as it is
    for k in range(1, 30):
        scaled = (k + 1) * size
        exact = scaled % capacity == 0
        # in units of capacity * k
        value = np.where(exact, size * k, scaled // capacity * capacity)
        best = max(best, int(-(-int((count * value).sum()) // (capacity * k))))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every length by best-fit decreasing, and the fill of every bin."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fills: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set while some bin has room r
    for at in np.argsort(-lengths, kind="stable"):
        length = int(lengths[at])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            held = by_room[room]
            number = held.pop()
            if not held:
                rooms ^= 1 << room
        else:
            room, number = capacity, len(fills)
            fills.append(0)
        bins[at], offsets[at] = number, fills[number]
        fills[number] += length
        rest = room - length
        if rest:
            by_room.setdefault(rest, []).append(number)
            rooms |= 1 << rest
    return bins, offsets, np.array(fills, dtype=np.int64)


def _packed(pieces: DataFrame, turn: int, capacity: int) -> DataFrame:
    """One round: deal, pack each partition, and mark what it would hand over."""
    rows = pieces.count()
    size = ROUND_SIZES[min(turn, len(ROUND_SIZES) - 1)]
    width = max(-(-rows // size), min(SPREAD, rows // FEWEST), 1)
    dealt = pieces.select(
        *[c for c in pieces.columns if c not in ("part", "sequence_id", "offset", "loose")],
        F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(width)).alias("part"),
    )

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["length"].to_numpy()
        bins, offsets, fills = best_fit(lengths, capacity)
        loose = np.zeros(len(fills), bool)
        if len(fills) > lower_bound(lengths, capacity):
            loose |= fills < capacity
        if fills.min() < capacity:
            loose[fills.argmin()] = True
        base = (turn << 52) + (int(group["part"].iloc[0]) << 28)
        return group.assign(sequence_id=base + bins, offset=offsets, loose=loose[bins]).drop(columns="part")

    schema = f"row long, {PIECE_SCHEMA}, sequence_id long, offset long, loose boolean"
    return written(dealt.groupBy("part").applyInPandas(pack, schema), "packed")


def _bound(pieces: DataFrame, capacity: int) -> int:
    """The lower bound for all the pieces; only counts of the lengths, ``capacity`` at most, are fetched."""
    counts = pieces.groupBy("length").count().toPandas()
    return lower_bound(counts["length"].to_numpy(np.int64), capacity, counts["count"].to_numpy(np.int64))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset; no piece may be longer than ``capacity``."""
    numbered = written(
        pieces.select(F.monotonically_increasing_id().alias("row"), *pieces.columns), "pieces"
    )
    settled = []
    current = _packed(numbered, 0, capacity)
    for turn in itertools.count(1):
        loose = current.where("loose")
        before = loose.select("sequence_id").distinct().count()
        if before <= max(_bound(loose, capacity), 1):
            break
        again = _packed(loose, turn, capacity)
        after = again.select("sequence_id").distinct().count()
        if after >= before:
            break
        settled.append(current.where("not loose"))
        current = again
    for part in settled:
        current = current.unionByName(part)
    return current.drop("row", "loose")


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = WORD_BPE) -> DataFrame:
    return pack(token_pieces(documents, capacity, vocabulary), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
