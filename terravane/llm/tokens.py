"""Token ids of whole texts by a word-end BPE vocabulary file, with each distinct word encoded once.

The vocabulary's own pipeline is: NFC, white space to one space, lower case, a split pattern,
byte letters, merges, where the last letter of a pre-token carries an end mark.  White space is
never inside a pre-token, so a text's ids are those of its white-space pieces in order, and a
worker keeps the ids of pieces it has met.  Texts for which that reasoning does not hold
(special-token strings, control characters that count as space on one side only, code points that
this Python's Unicode tables do not assign and the tokenizer's may) go through the tokenizer as they
are; so do all texts if the file's merges are not numbered in merge order.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

WORD_BPE = "word_bpe_49k.json"
#: Distinct words a worker remembers before it starts afresh; bounds memory, not results.
REMEMBERED = 300_000
ODD = regex.compile(r"<\||[\x1c-\x1f]")
END, END_BYTE = "</w>", b"\xff"  # 0xFF occurs in no UTF-8 text


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class WordEncoder:
    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        vocabulary, merges = parts["model"]["vocab"], parts["model"]["merges"]
        letters = _byte_letters()
        ranks = {}
        for token, number in vocabulary.items():
            core = token.removesuffix(END)
            if all(c in letters for c in core):
                ranks[bytes(letters[c] for c in core) + (END_BYTE if core != token else b"")] = number
        in_order = all(vocabulary.get("".join(pair)) == 512 + i for i, pair in enumerate(merges))
        split = next(
            p["pattern"]["Regex"] for p in parts["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"
        )
        self.words = regex.compile(split)
        self.known: dict[str, bytes] = {}
        self.merge = None
        if in_order and len(ranks) >= 512:
            core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
            self.merge = core._core_bpe.encode_single_piece

    def _piece(self, piece: str) -> bytes:
        ids = [i for word in self.words.findall(piece) for i in self.merge(word.encode() + END_BYTE)]
        return np.array(ids, dtype="<u4").tobytes()

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers; nothing for null and empty texts."""
        if not text:
            return b""
        if self.merge is None or ODD.search(text):
            return self._whole(text)
        if not text.isascii():
            if any(unicodedata.category(c) == "Cn" for c in set(text)):
                return self._whole(text)
            # per character, as the vocabulary's pipeline does it: no final sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        pieces = text.lower().split()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for piece in set(pieces).difference(known):
            known[piece] = self._piece(piece)
        return b"".join(map(known.__getitem__, pieces))


@functools.lru_cache(maxsize=2)
def encoder(name: str = WORD_BPE) -> WordEncoder:
    return WordEncoder(public_tokenizers.path(name))
