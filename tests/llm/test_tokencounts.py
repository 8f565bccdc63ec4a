import random

from helpers import clashing, documents, hard_documents, rows_of

from terravane.llm import tokencounts


def slow_count(word, scores):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        spent = len(word[end - 1].encode())
        options = [(best[end - 1][0] + spent * tokencounts.BYTE_SCORE, -(best[end - 1][1] + spent))]
        for start in range(end):
            if word[start:end] in scores:
                options.append((best[start][0] + scores[word[start:end]], -(best[start][1] + 1)))
        score, tokens = max(options)
        best.append((score, -tokens))
    return best[-1][1]


def test_shared_prefixes_change_nothing():
    scores, rng = tokencounts.piece_scores(), random.Random(6)
    words = {"▁" + "".join(rng.choice("theinga数é") for _ in range(rng.randint(1, 14))) for _ in range(400)}
    words |= {w + "s" for w in list(words)[:100]} | {"▁"}
    found = tokencounts.terminal_counts(words, scores, max(map(len, scores)))
    assert found == {w: slow_count(w, scores) for w in words}


def test_ties_take_fewer_tokens():
    scores = {"a": -1.0, "b": -1.0, "ab": -2.0}
    assert tokencounts.terminal_counts(["ab"], scores, 2) == {"ab": 1}


def test_hard_rows(spark):
    scores = tokencounts.piece_scores()
    frame = clashing(hard_documents(spark), "n_tokens", "count")
    wanted, known = [], {}
    for row in frame.collect():
        words = (row["text"] or "").split()
        for word in set(words) - known.keys():
            known[word] = slow_count("▁" + word, scores)
        wanted.append((row["doc_id"], len(words), sum(known[w] for w in words)))
    assert rows_of(tokencounts.count_tokens(frame)) == sorted(wanted, key=repr)
    assert tokencounts.count_tokens(documents(spark, [])).count() == 0
