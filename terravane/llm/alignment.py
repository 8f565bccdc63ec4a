"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often.

Both tokenizers cut the bytes of a text; where both cut, a group ends, and a token of one links to each
token of the other whose bytes it overlaps.  How many documents hold a linked pair of ids is counted
in an inverted index of bitmaps:

* documents are dealt into blocks of at most ``BLOCK`` documents and ``BLOCK_CHARS`` characters by the
  task that encodes them; per block and pair there is one row with the bitmap of its documents;
* multiplicities are bit planes: plane k holds the documents whose number of links of the pair has
  bit k set, so the pair's documents are the OR of its planes and its links their weighted popcounts;
* bitmaps are compressed by plane: few documents as 16-bit entries (document and plane), many as
  plain bits, whichever takes less room;
* popcounts of the merged and of the single planes are added up per pair over all blocks; the score of a pair (its count, and whether it is the
  highest of its first id) joins the postings, which return it to the documents of their block.

A block's postings are bounded by the block; a pair held by all documents has one row per block.

Tokenizers.  Texts are cut before single spaces that stand between two plain letters or signs; both
vocabularies start a token there, as the first splits at such a space and no piece of the second
goes past one (checked when it is loaded).  The alignments of distinct cuts are kept as numbers in
arrays; beyond ``REMEMBERED`` cuts only those met again stay.  Cuts of plain letters and signs get the first
vocabulary's ids by rank, all others from the library of its file; tests hold both against whole texts.

Defined cases: null and empty texts, and texts whose tokens do not spell them byte by byte, have no
tokens, zeros and an empty digest; rows with equal or null ids are documents of their own and count
as such; very long texts are a block of their own; an empty table gives no rows; extra columns are not
read, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terravane.llm.common import table
from terravane.llm.tokens import _byte_letters
from terravane.session import run_folder

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Documents and characters of a block; 12 bits number its documents.
BLOCK, BLOCK_CHARS = 4096, 8_000_000
#: Cuts whose alignment a worker remembers before it starts afresh, and the longest of them.
REMEMBERED, LONGEST = 300_000, 64
#: Documents whose new cuts are encoded by one call.
TOGETHER = 250
#: Characters beside which a space is a safe place to cut: printable ASCII, Latin, Greek, Cyrillic.
PLAIN = "!-~¡-ʯΑ-ωА-я"
CUT = re.compile(f" (?<=[{PLAIN}] )(?=[{PLAIN}])")
COMMON = re.compile(f"[ \n{PLAIN}]*")
#: Cuts that may stand in one text, parted by the spaces at which texts are cut.
CHAINED = re.compile(f"[{PLAIN}](?:[ \n{PLAIN}]*[{PLAIN}])?")
NOTHING = np.zeros(0, dtype=np.int64)


class Aligned(NamedTuple):
    """Tokens, groups and linked pairs of one stretch of text."""

    first: int
    second: int
    groups: int
    pairs: np.ndarray
    listing: str


class _Kept:
    """Alignments of cuts by number: tokens and groups, linked pairs one cut after the other, listings."""

    def __init__(self):
        self.firsts, self.seconds, self.groups, self.uses = (np.zeros(1024, dtype=np.int64) for _ in range(4))
        self.starts, self.pairs = np.zeros(1025, dtype=np.int64), np.zeros(4096, dtype=np.int64)
        self.listings: list[str] = []

    def __len__(self) -> int:
        return len(self.listings)

    def add(self, firsts: np.ndarray, seconds: np.ndarray, groups: np.ndarray, sizes: np.ndarray, pairs: np.ndarray, listings: list[str]) -> None:
        old, new = len(self), len(self) + len(listings)
        for name, values in (("firsts", firsts), ("seconds", seconds), ("groups", groups), ("uses", 0)):
            setattr(self, name, _with(getattr(self, name), old, new, values))
        start = int(self.starts[old])
        self.starts = _with(self.starts, old + 1, new + 1, start + np.cumsum(sizes))
        self.pairs = _with(self.pairs, start, start + len(pairs), pairs)
        self.listings += listings

    def cut(self, size: int) -> None:
        """Forget all but the first ``size``."""
        del self.listings[size:]

    def pairs_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of the cuts, one cut after the other, and how many each has."""
        starts, sizes = self.starts[numbers], self.starts[numbers + 1] - self.starts[numbers]
        ends = np.cumsum(sizes)
        return self.pairs[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes

    def only(self, numbers: np.ndarray) -> _Kept:
        """The alignments of these numbers, numbered anew."""
        found = _Kept()
        pairs, sizes = self.pairs_of(numbers)
        found.add(
            self.firsts[numbers], self.seconds[numbers], self.groups[numbers], sizes, pairs,
            [self.listings[i] for i in numbers.tolist()],
        )
        return found


def _with(array: np.ndarray, start: int, end: int, values) -> np.ndarray:
    """The array with values from start to end, longer if it must be."""
    if end > len(array):
        array = np.concatenate([array, np.zeros(max(end - len(array), len(array) // 2), dtype=array.dtype)])
    array[start:end] = values
    return array


def _texts_of(size: int, mark: str) -> np.ndarray:
    """For each id the texts ``id,`` and ``id`` with the mark that closes its side of a group."""
    return np.array([f"{i}{end}" for i in range(size) for end in (",", mark)], dtype=object)


class Aligner:
    def __init__(self, first_path: str, second_path: str):
        # Spark's tasks are the parallelism; a pool of threads per worker would not outlive its fork
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.first = Tokenizer.from_file(first_path)
        self.first.encode_special_tokens = True
        letters = _byte_letters()
        self.first_bytes = {
            number: bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
            for token, number in self.first.get_vocab(with_added_tokens=True).items()
        }
        # the same vocabulary by rank: for letters and signs that any Unicode version splits alike
        special = set(self.first.get_added_tokens_decoder())
        ranks = {part: number for number, part in self.first_bytes.items() if number not in special}
        self.ranked = tiktoken.Encoding(
            "first", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        self.second = sentencepiece.SentencePieceProcessor(model_file=second_path)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.vocab_size())]
        self.second_bytes = [
            bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.first_sizes = np.zeros(max(self.first_bytes) + 1, dtype=np.int64)
        self.first_sizes[list(self.first_bytes)] = [len(part) for part in self.first_bytes.values()]
        self.second_sizes = np.array([len(part) for part in self.second_bytes], dtype=np.int64)
        self.first_texts, self.second_texts = _texts_of(len(self.first_sizes), "|"), _texts_of(len(pieces), ";")
        self.first_widths, self.second_widths = (
            np.array([len(t) for t in texts], dtype=np.int64) for texts in (self.first_texts, self.second_texts)
        )
        self.separable = not any("▁" in p.lstrip("▁") for p in pieces)
        # numbers of the kept alignments by cut; below 0 where the bytes do not come back
        self.known: dict[str, int] = {}
        self.kept = _Kept()

    def _first_ids(self, chained: list[str], others: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the first vocabulary, cut after cut, and how many each cut has."""
        found, counts = NOTHING, NOTHING
        if chained:
            found = np.array(self.ranked(" " + " ".join(chained)), dtype=np.int64)
            ends, close = np.cumsum(self.first_sizes[found]), _closes(chained)[1]
            through = np.searchsorted(ends, close, "right")
            counts = np.diff(through, prepend=0)
            if not counts.all() or (ends[through - 1] != close).any():
                # some token goes past a cut's end
                found, counts = _flat([self.ranked(" " + t) for t in chained])
        far = [t for t in others if not COMMON.fullmatch(t)]
        ids = {t: e.ids for t, e in zip(far, self.first.encode_batch_fast([" " + t for t in far], add_special_tokens=False))}
        rest, sizes = _flat([ids[t] if t in ids else self.ranked(" " + t) for t in others])
        return np.concatenate([found, rest]), np.concatenate([counts, sizes])

    def _aligned(self, cuts: list[str]) -> tuple[list[str], np.ndarray, tuple]:
        """The cuts in an order of their own, which of them are spelled, and what ``_Kept.add`` takes of those."""
        chained, others = [], []
        for cut in cuts:
            (chained if CHAINED.fullmatch(cut) else others).append(cut)
        cuts = chained + others
        a, n_a = self._first_ids(chained, others)
        b, n_b = _flat(self.second.encode(cuts, num_threads=1))
        text, close = _closes(cuts)
        right = _spelling(text, close, a, n_a, self.first_sizes, self.first_bytes)
        right &= _spelling(text, close, b, n_b, self.second_sizes, self.second_bytes)
        if not right.all():
            a, b = a[np.repeat(right, n_a)], b[np.repeat(right, n_b)]
            n_a, n_b, close = n_a[right], n_b[right], np.cumsum(np.diff(close, prepend=0)[right])
        return cuts, right, self._weave(close, a, n_a, b, n_b)

    def _weave(self, close: np.ndarray, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> tuple:
        """Alignments of spelled cuts, all at once: their bytes stand one after the other up to ``close``."""
        a_ends, b_ends = np.cumsum(self.first_sizes[a]), np.cumsum(self.second_sizes[b])
        # every stretch between two ends of either side lies in one token of each: a link
        ends = np.concatenate([a_ends, b_ends])
        ends.sort(kind="stable")
        twice = ends[1:] == ends[:-1]
        both, ends = ends[1:][twice], ends[np.concatenate([np.ones(min(1, len(ends)), dtype=bool), ~twice])]
        pairs = a[np.searchsorted(a_ends, ends)] << 32 | b[np.searchsorted(b_ends, ends)]
        # tokens in the order of the listing: of each group the first side's, then the second's
        a_group, b_group = np.searchsorted(both, a_ends), np.searchsorted(both, b_ends)
        a_place = np.arange(len(a)) + np.searchsorted(b_group, a_group)
        b_place = np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")
        a_text, b_text = 2 * a + (both[a_group] == a_ends), 2 * b + (both[b_group] == b_ends)
        listing, widths = np.empty(len(a) + len(b), dtype=object), np.empty(len(a) + len(b), dtype=np.int64)
        listing[a_place], widths[a_place] = self.first_texts[a_text], self.first_widths[a_text]
        listing[b_place], widths[b_place] = self.second_texts[b_text], self.second_widths[b_text]
        shown, stops = "".join(listing.tolist()), np.cumsum(widths)[np.cumsum(n_a + n_b) - 1].tolist()
        sizes, groups = (np.diff(np.searchsorted(x, close, "right"), prepend=0) for x in (ends, both))
        # without the mark that closes the last group
        listings = [shown[start : stop - 1] for start, stop in zip([0, *stops], stops)]
        return n_a, n_b, groups, sizes, pairs, listings

    def _learn(self, cuts: list[str]) -> None:
        if cuts:
            cuts, right, found = self._aligned(cuts)
            numbers = np.where(right, len(self.kept) + np.cumsum(right) - 1, -1)
            self.kept.add(*found)
            self.known.update(zip(cuts, numbers.tolist()))

    def _forget(self) -> None:
        """Keep the cuts that were met again, the most frequent ones if those are many."""
        uses = self.kept.uses[: len(self.kept)]
        least = max(2, int(np.partition(uses, -REMEMBERED // 2)[-REMEMBERED // 2]) + 1)
        stay = np.flatnonzero(uses >= least)
        number = np.full(len(uses), -1)
        number[stay] = np.arange(len(stay))
        numbers = number.tolist()
        self.known = {cut: numbers[i] for cut, i in self.known.items() if i >= 0 and numbers[i] >= 0}
        self.kept = self.kept.only(stay)

    def align(self, texts: Sequence[str | None]) -> list[Aligned | None]:
        """The alignment of each text; None where it has no tokens."""
        cuts = [(CUT.split(t) if self.separable else [t]) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            if len(self.kept) > REMEMBERED:
                self._forget()
            else:
                self.known, self.kept = {}, _Kept()
        every = list(itertools.chain.from_iterable(cuts))
        new = set(every).difference(self.known)
        long = [cut for cut in new if len(cut) > LONGEST]
        self._learn([cut for cut in new if len(cut) <= LONGEST] if long else list(new))
        brief = len(self.kept)
        self._learn(long)
        numbers = list(map(self.known.__getitem__, every))
        found = self._joined(numbers, np.fromiter(map(len, cuts), dtype=np.int64, count=len(cuts)))
        for cut in long:
            del self.known[cut]
        self.kept.cut(brief)
        for i, parts in enumerate(cuts):
            if found[i] is None and len(parts) > 1:
                # some cut did not spell its text: the whole text decides
                _, right, whole = self._aligned([texts[i]])
                if right[0]:
                    n_a, n_b, groups, _, pairs, (listing,) = whole
                    found[i] = Aligned(int(n_a[0]), int(n_b[0]), int(groups[0]), pairs, listing)
        return found

    def _joined(self, numbers: list[int], sizes: np.ndarray) -> list[Aligned | None]:
        """Alignments of texts of so many cuts each, of the cuts' numbers; None with a cut that is not spelled."""
        kept, at = self.kept, np.array(numbers, dtype=np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        spelled = at >= 0
        ok = (sizes > 0) & (np.diff(_summed(~spelled)[bounds]) == 0)
        kept.uses += np.bincount(at[spelled], minlength=len(kept.uses))
        at[~spelled] = 0
        if not ok.any():
            return [None] * len(sizes)
        firsts, seconds, groups = (np.diff(_summed(x[at])[bounds]).tolist() for x in (kept.firsts, kept.seconds, kept.groups))
        pairs, links = kept.pairs_of(at)
        stops, bounds = _summed(links)[bounds].tolist(), bounds.tolist()
        listings = kept.listings
        return [
            Aligned(
                firsts[i], seconds[i], groups[i], pairs[stops[i] : stops[i + 1]],
                ";".join([listings[n] for n in numbers[bounds[i] : bounds[i + 1]]]),
            )
            if good
            else None
            for i, good in enumerate(ok.tolist())
        ]


def _summed(values: np.ndarray) -> np.ndarray:
    """Sums of all values before each place and after the last."""
    return np.concatenate([[0], np.cumsum(values)])


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The members of all lists, and the lists' sizes."""
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), dtype=np.int64, count=int(sizes.sum())), sizes


def _closes(cuts: list[str]) -> tuple[bytes, np.ndarray]:
    """The bytes of the cuts, a space before each, and where each cut's bytes end."""
    text = (" " + " ".join(cuts)).encode()
    close = np.cumsum(np.fromiter(map(len, cuts), dtype=np.int64, count=len(cuts)) + 1)
    if close[-1] < len(text):
        begins = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) & 0xC0 != 0x80)
        close = np.append(begins, len(text))[close]
    return text, close


def _spelling(text: bytes, close: np.ndarray, ids: np.ndarray, counts: np.ndarray, sizes: np.ndarray, parts) -> np.ndarray:
    """Which cuts of the text, by their ends, the tokens of a side spell byte by byte."""
    spelled = b"".join([parts[i] for i in ids.tolist()])
    if spelled == text:
        return np.diff(close, prepend=0) == np.diff(_summed(sizes[ids])[np.cumsum(counts)], prepend=0)
    ends = _summed(sizes[ids])[np.cumsum(counts)]
    right = np.diff(close, prepend=0) == np.diff(ends, prepend=0)
    spans = zip([0, *close.tolist()], close.tolist(), [0, *ends.tolist()], ends.tolist())
    return right & np.array([text[i:j] == spelled[k:m] for i, j, k, m in spans], dtype=bool)


@functools.lru_cache(maxsize=2)
def aligner(first: str = FIRST, second: str = SECOND) -> Aligner:
    return Aligner(public_tokenizers.path(first), public_tokenizers.path(second))


# --- bitmaps ----------------------------------------------------------------------------------


def planes(pair: np.ndarray, doc: np.ndarray, count: np.ndarray) -> list[tuple]:
    """(pair, base, docs, links, sparse, dense planes, dense) of a block's postings.

    Sparse entries are document + BLOCK x plane; planes above 15 go to a further row with base 16 and so on.
    """
    later = np.diff(pair)
    if ((later < 0) | (later == 0) & (np.diff(doc) < 0)).any():
        order = np.lexsort((doc, pair))
        pair, doc, count = pair[order], doc[order], count[order]
    starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else NOTHING
    which = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(pair)]))
    keys, entries = [], []
    for plane in range(int(count.max()).bit_length() if len(count) else 0):
        here = (count >> plane & 1).astype(bool)
        keys.append(which[here] * 64 + plane)
        entries.append(doc[here])
    if not keys:
        return []
    key, entry = np.concatenate(keys), np.concatenate(entries)
    order = np.argsort(key, kind="stable")
    key, entry = key[order], entry[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[first[1:], len(key)]
    packed = (entry + (key % 16) * BLOCK).astype("<u2")
    row_of = key[first] // 16  # pair's number x 4 + base / 16
    rows, at = [], 0
    heads = np.flatnonzero(np.r_[True, row_of[1:] != row_of[:-1]])
    tails = np.r_[heads[1:], len(first)]
    sizes = ends - first
    # documents: popcount of a pair's planes merged by OR; links: popcounts of the planes by weight
    merged = np.sort(key // 64 * BLOCK + entry)
    merged = merged[np.r_[True, merged[1:] != merged[:-1]]]
    docs = np.bincount(merged // BLOCK, minlength=len(starts))
    by_pair = np.flatnonzero(np.r_[True, np.diff(key[first] // 64) > 0])
    links = np.add.reduceat(sizes << key[first] % 64, by_pair)
    crowded = sizes > BLOCK // 16  # 16-bit entries would take more room than BLOCK bits
    any_crowded = np.logical_or.reduceat(crowded, heads)
    raw, cut = packed.tobytes(), (first * 2).tolist() + [len(packed) * 2]
    numbers, row_of = pair[starts].tolist(), row_of.tolist()
    docs, links = docs.tolist(), links.tolist()
    for head, tail, mixed in zip(heads.tolist(), tails.tolist(), any_crowded.tolist()):
        number, base = divmod(row_of[head], 4)
        # a pair's documents and links are told once, by its first row
        told = at != number + 1
        at = number + 1
        sparse, marks, dense = raw[cut[head] : cut[tail]], 0, b""
        if mixed:
            sparse = b""
            for i in range(head, tail):
                if crowded[i]:
                    bits = np.zeros(BLOCK, dtype=np.uint8)
                    bits[entry[first[i] : ends[i]]] = 1
                    marks |= 1 << int(key[first[i]]) % 16
                    dense += np.packbits(bits).tobytes()
                else:
                    sparse += raw[cut[i] : cut[i + 1]]
        rows.append(
            (numbers[number], base * 16, docs[number] if told else 0, links[number] if told else 0, sparse, marks, dense)
        )
    return rows


def tallied(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, doc, count), in this order, of the pairs of a block's documents by place."""
    pairs = np.concatenate(found) if found else NOTHING
    if not len(pairs):
        return NOTHING, NOTHING, NOTHING
    first, second = pairs >> 32, pairs & (1 << 32) - 1
    low, place = int(second.max()).bit_length(), BLOCK.bit_length() - 1
    if int(first.max()).bit_length() + low + place > 63:
        raise ValueError("the vocabularies have too many ids")
    key = (first << low | second) << place | np.repeat(np.arange(len(found)), [len(f) for f in found])
    key.sort()
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count, key = np.diff(starts, append=len(key)), key[starts]
    number = key >> place
    return number >> low << 32 | number & (1 << low) - 1, key & BLOCK - 1, count


def returned(size: int, base, count, best, sparse, marks, dense) -> tuple[np.ndarray, np.ndarray]:
    """Sums over a block's postings, per document: count x links, and links of the best pairs."""
    sums, tops = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    lengths = np.array([len(s) // 2 for s in sparse], dtype=np.int64)
    entries = np.frombuffer(b"".join(sparse), dtype="<u2").astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    weight = np.int64(1) << (base[row] + entries // BLOCK)
    np.add.at(sums, entries % BLOCK, weight * count[row])
    np.add.at(tops, entries % BLOCK, weight * best[row])
    for i in np.flatnonzero(marks).tolist():
        bits = np.unpackbits(np.frombuffer(dense[i], dtype=np.uint8).reshape(-1, BLOCK // 8), axis=1)[:, :size]
        held = [p for p in range(16) if marks[i] >> p & 1]
        total = sum(bits[k].astype(np.int64) << int(base[i] + p) for k, p in enumerate(held))
        sums += total * count[i]
        tops += total * best[i]
    return sums, tops


# --- jobs -------------------------------------------------------------------------------------

KINDS = {
    "kind": pa.int32(), "block": pa.int64(), "place": pa.int32(), "doc_id": pa.int64(), "n_a": pa.int64(),
    "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(),
    "pair": pa.int64(), "base": pa.int32(), "docs": pa.int64(), "links": pa.int64(), "sparse": pa.binary(),
    "marks": pa.int32(), "dense": pa.binary(),
}
ROWS = (
    "kind int, block long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
    "groups_sha256 string, pair long, base int, docs long, links long, sparse binary, marks int, dense binary"
)
DOCUMENT, POSTING = 0, 1
#: Rows of a batch sent back to Spark.
BATCH = 20_000


def _batches(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(rows), BATCH):
        some = rows[start : start + BATCH]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r.get(name) for r in some], kind) for name, kind in KINDS.items()], names=list(KINDS)
        )


class _Block:
    """The documents and postings of the block that is being filled."""

    def __init__(self, number: int):
        self.number, self.rows, self.chars = number, [], 0
        self.pairs: list[np.ndarray] = []

    def add(self, doc_id: int | None, text: str | None, found: Aligned | None) -> None:
        place = len(self.rows)
        row = dict(kind=DOCUMENT, block=self.number, place=place, doc_id=doc_id, n_a=0, n_b=0, n_groups=0, n_links=0, groups_sha256="")
        if found is not None:
            row |= dict(
                n_a=found.first, n_b=found.second, n_groups=found.groups, n_links=len(found.pairs),
                groups_sha256=hashlib.sha256(found.listing.encode()).hexdigest(),
            )
        self.pairs.append(NOTHING if found is None else found.pairs)
        self.rows.append(row)
        self.chars += len(text or "")

    def full(self) -> bool:
        return len(self.rows) >= BLOCK or self.chars >= BLOCK_CHARS

    def close(self) -> Iterator[pa.RecordBatch]:
        yield from _batches(self.rows)
        names = ("pair", "base", "docs", "links", "sparse", "marks", "dense")
        made = planes(*tallied(self.pairs))
        for start in range(0, len(made), BATCH):
            yield from _batches(
                [dict(zip(names, r), kind=POSTING, block=self.number) for r in made[start : start + BATCH]]
            )


def _encode(first: str, second: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, task = aligner(first, second), TaskContext.get().partitionId()
        block = _Block(task << 32)
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(start, TOGETHER)
                texts = some["text"].to_pylist()
                for doc_id, text, found in zip(some["doc_id"].to_pylist(), texts, tool.align(texts)):
                    block.add(doc_id, text, found)
                    if block.full():
                        yield from block.close()
                        block = _Block(block.number + 1)
        yield from block.close()

    return encode


def indexed(documents: DataFrame, first: str = FIRST, second: str = SECOND) -> tuple[DataFrame, DataFrame]:
    """The documents by block and place, and the postings (block, pair, base, docs, links, bitmaps)."""
    spark = documents.sparkSession
    made = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(_encode(first, second), ROWS)
    place = run_folder(spark, "alignment")
    made.write.partitionBy("kind").parquet(place)
    stored = spark.read.schema(ROWS).parquet(place)
    return (
        stored.where(F.col("kind") == DOCUMENT).select(
            "block", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"
        ),
        stored.where(F.col("kind") == POSTING).select(
            "block", "pair", "base", "docs", "links", "sparse", "marks", "dense"
        ),
    )


def pair_counts(postings: DataFrame) -> DataFrame:
    """a, b, docs (documents holding the pair linked), links, best (no pair of ``a`` has more docs)."""
    total = postings.groupBy("pair").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"))
    total = total.withColumn("a", F.shiftright("pair", 32))
    highest = total.groupBy("a").agg(F.max("docs").alias("highest"))
    return total.join(highest, "a").select(
        "pair", "a", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "docs", "links",
        (F.col("docs") == F.col("highest")).alias("best"),
    )


def _returns(block: pa.Table) -> pa.Table:
    columns = [block[c].to_numpy() for c in ("base", "total", "best", "marks")]
    base, count, best, marks = (c.astype(np.int64) for c in columns)
    sums, tops = returned(BLOCK, base, count, best, block["sparse"].to_pylist(), marks, block["dense"].to_pylist())
    places = np.flatnonzero(sums)
    return pa.table(
        {
            "block": pa.array([block["block"][0].as_py()] * len(places), pa.int64()),
            "place": pa.array(places, pa.int32()),
            "n_best": pa.array(tops[places], pa.int64()),
            "count_sum": pa.array(sums[places], pa.int64()),
        }
    )


def align(documents: DataFrame, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    docs, postings = indexed(documents, first, second)
    scores = pair_counts(postings).select("pair", F.col("docs").alias("total"), "best")
    scored = postings.select("block", "pair", "base", "sparse", "marks", "dense").join(scores, "pair")
    sums = scored.drop("pair").groupBy("block").applyInArrow(
        _returns, "block long, place int, n_best long, count_sum long"
    )
    return docs.join(sums, ["block", "place"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0).cast("long")).alias("n_best"),
        F.coalesce("count_sum", F.lit(0).cast("long")).alias("count_sum"),
        "groups_sha256",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
