import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from helpers import clashing, documents, hard_documents, rows_of
from tokenizers import Tokenizer

from terravane.llm import alignment
from terravane.llm.tokens import _byte_letters


@pytest.fixture(scope="module")
def tools():
    first = Tokenizer.from_file(public_tokenizers.path(alignment.FIRST))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.SECOND))


def tokens(tools, text):
    """Whole-text encodings as (id, bytes); nothing where they do not spell the text."""
    first, second = tools
    letters, wanted = _byte_letters(), (" " + (text or "")).encode()
    if not text:
        return [], []
    a = [(i, bytes(letters.get(c, 0) for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in second.encode(text):
        piece = second.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()))
    if b"".join(p for _, p in a) != wanted or b"".join(p for _, p in b) != wanted:
        return [], []
    return a, b


def spans(parts):
    at, found = 0, []
    for number, part in parts:
        found.append((number, at, at + len(part)))
        at += len(part)
    return found


def brute(tools, rows):
    linked, shown = [], []
    for doc, text in rows:
        a, b = (spans(side) for side in tokens(tools, text))
        links = [(x, y) for x, s, e in a for y, s2, e2 in b if s < e2 and s2 < e]
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(x) for x, s, e in side if s >= start and e <= end) for side in (a, b)))
            start = end
        linked.append(links)
        shown.append((doc, len(a), len(b), len(ends), ";".join(groups)))
    docs = Counter(pair for links in linked for pair in set(links))
    best = {}
    for (x, _), n in docs.items():
        best[x] = max(best.get(x, 0), n)
    return sorted(
        (
            (doc, a, b, g, len(links), sum(docs[p] == best[p[0]] for p in links), sum(docs[p] for p in links),
             hashlib.sha256(text.encode()).hexdigest() if a else "")
            for (doc, a, b, g, text), links in zip(shown, linked)
        ),
        key=repr,
    )


ODD = [
    "  two  spaces ", "tab\tand\nnewline \n x", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ under ▁score", "été  naïve Σas",
    "数据 清洗 ok", "a b c　d", "don't we'll I'm", "x" * 300, "1234567 89 0.5", "\x00 \x1c \x1f b", "👩‍👩‍👧 ok", "á ́b", "  x ᠎ y",
    " ", "!", "It's 'll 's", "퟿ � \U0010ee22 q", "ﬁ ① Ａ",
]


def test_against_brute_force(spark, tools):
    rng, letters = random.Random(4), "ab é\n 1.,'sZ▁ Я"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    texts += [" ".join(rng.choice(["the", "Tokenizer,", "naïve", "x1"]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    docs = clashing(documents(spark, texts), "block", "place", "pair", "docs", "kind", "n_best")
    assert rows_of(alignment.align(docs)) == brute(tools, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_hard_rows(spark, tools):
    docs = hard_documents(spark).where("length(text) < 100000 or text is null")
    assert rows_of(alignment.align(docs)) == brute(tools, [(r["doc_id"], r["text"]) for r in docs.collect()])
    whole = alignment.align(hard_documents(spark)).where("doc_id = 4").first()
    assert whole["n_links"] == whole["n_a"] + whole["n_b"] - whole["n_groups"] > 100_000
    assert alignment.align(documents(spark, [])).count() == 0


def test_cut_texts_have_the_ids_of_whole_texts(tools):
    rng, tool = random.Random(9), alignment.aligner()
    assert tool.separable
    signs = [chr(c) for c in (*range(32, 127), *range(160, 700), *range(0x370, 0x530))] + [" "] * 300
    for _ in range(1500):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(1, 60)))
        a, b = tokens(tools, text)
        found = tool.align([text])[0]
        assert (found.first, found.second) == (len(a), len(b)) if a else found is None
        if a:
            sides = [part.split("|") for part in found.listing.split(";")]
            assert [x for s in sides for x in s[0].split(",")] == [str(i) for i, _ in a]
            assert [x for s in sides for x in s[1].split(",")] == [str(i) for i, _ in b]


def test_cuts_met_again_are_encoded_once(tools, monkeypatch):
    """Many cuts that are met once do not push out those that every text holds."""
    monkeypatch.setattr(alignment, "REMEMBERED", 100)
    tool = alignment.Aligner(*map(public_tokenizers.path, (alignment.FIRST, alignment.SECOND)))
    asked, second = Counter(), tool.second

    class Noted:
        def encode(self, cuts, **settings):
            asked.update(cut.strip() for cut in cuts)
            return second.encode(cuts, **settings)

    monkeypatch.setattr(tool, "second", Noted())
    for n in range(12):
        texts = [f"common words and w{n}x{i} naïve" for i in range(40)]
        for text, found in zip(texts, tool.align(texts)):
            a, b = tokens(tools, text)
            assert (found.first, found.second) == (len(a), len(b))
            sides = [part.split("|") for part in found.listing.split(";")]
            assert [x for s in sides for x in s[0].split(",")] == [str(i) for i, _ in a]
    assert len(asked) == 4 + 12 * 40 and set(asked.values()) == {1}


def test_bitmaps_return_what_was_put_in():
    """Sparse and dense planes, and links beyond 2**16 in one document."""
    rng = np.random.default_rng(2)
    wanted = {}
    for pair in range(40):
        for doc in rng.choice(alignment.BLOCK, rng.choice([1, 5, 400, 4000]), replace=False).tolist():
            wanted[pair << 32 | 7, doc] = int(rng.choice([1, 2, 3, 70_000, 1 << 33]))
    pair, doc = (np.array(x, dtype=np.int64) for x in zip(*wanted))
    rows = alignment.planes(pair, doc, np.array(list(wanted.values()), dtype=np.int64))
    names = ("pair", "base", "docs", "links", "sparse", "marks", "dense")
    column = {n: list(c) for n, c in zip(names, zip(*rows))}
    told, links = Counter(), Counter()
    for p, d, n in zip(column["pair"], column["docs"], column["links"]):
        told[p] += d
        links[p] += n
    assert told == Counter(p for p, _ in wanted) and all(links[p] == sum(n for (q, _), n in wanted.items() if q == p) for p in told)
    count = np.array([p >> 32 for p in column["pair"]], dtype=np.int64)
    best = count % 2
    sums, tops = alignment.returned(
        alignment.BLOCK, np.array(column["base"]), count, best, column["sparse"], np.array(column["marks"]), column["dense"]
    )
    expected, top = np.zeros_like(sums), np.zeros_like(tops)
    for (p, d), n in wanted.items():
        expected[d] += n * (p >> 32)
        top[d] += n * ((p >> 32) % 2)
    assert (sums == expected).all() and (tops == top).all()
    assert any(column["marks"]) and any(column["sparse"]) and len(set(column["base"])) > 1


def test_pairs_and_blocks(spark, tools, monkeypatch):
    docs = documents(spark, ["the cat", "the cat the", "a dog"] * 30).repartition(3)
    _, postings = alignment.indexed(docs)
    top = alignment.pair_counts(postings).orderBy("docs", "links", ascending=False).first()
    assert (top["docs"], top["links"], top["best"]) == (60, 90, True)
