import hashlib
import random
import re

import pytest
from helpers import clashing, documents, hard_documents, rows_of
from pyspark.sql import functions as F

from terravane.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, span=10):
    held = []
    for item, text in items:
        parts = words(text)
        size = min(span, len(parts))
        held += [(item, parts[s : s + size]) for s in range(len(parts) - size + 1) if size]
    found = []
    for doc, text in docs:
        parts, hit, ids = words(text), set(), set()
        for item, window in held:
            for s in range(len(parts) - len(window) + 1):
                if parts[s : s + len(window)] == window:
                    hit |= set(range(s, s + len(window)))
                    ids |= {str(item)} - {"None"}
        found.append((doc, len(parts), len(hit), len(ids), sorted(ids), bool(hit)))
    return sorted(found, key=repr)


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("span, gram, chunk", [(10, 5, 256), (4, 2, 3), (4, 4, 5), (10, 1, 7)])
def test_against_brute_force(spark, span, gram, chunk):
    rng = random.Random(span * 100 + chunk)
    vocabulary = ["red", "Blue", "x1", "É", "und", "数据"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, line(rng.randint(0, 14))) for i in range(12)]
    items += [(3, line(11)), (None, line(12)), (50, None), (51, ""), (52, "x1"), (53, items[0][1])]
    texts = [line(rng.randint(0, 30)) for _ in range(60)]
    texts += [f"{line(3)}, {rng.choice(items)[1]}. {line(2)}\n{rng.choice(items)[1]}" for _ in range(60)]
    docs = clashing(documents(spark, texts), "row", "chunk", "words", "print", "span", "class", "items", "start")
    found = decontaminate.contamination(
        docs, clashing(benchmark(spark, items), "doc_id", "window", "words", "items"), span, gram, chunk
    )
    assert rows_of(found) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], items, span)


def test_hard_rows_and_shared_passages(spark):
    """Nulls, repeated rows, one passage in most documents and items, and a text of many chunks."""
    passage = "it is the one passage that stands in every single item and in most documents here"
    items = [(i, f"q{i} {passage} a{i}") for i in range(40)] + [(None, None)]
    docs = hard_documents(spark).union(documents(spark, [f"n{i % 7} {passage}" for i in range(200)]))
    docs = docs.union(documents(spark, [" ".join(f"w{i}" for i in range(20_000)) + " " + passage]))
    found = decontaminate.contamination(docs, benchmark(spark, items))
    assert rows_of(found) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], items)


def test_empty_tables(spark):
    some, none = documents(spark, ["a b c"]), benchmark(spark, [])
    assert rows_of(decontaminate.contamination(some, none)) == [(0, 3, 0, 0, [], False)]
    assert decontaminate.contamination(some.limit(0), benchmark(spark, [(1, "a b c")])).count() == 0


def test_refused_settings(spark):
    with pytest.raises(ValueError):
        decontaminate.contamination(documents(spark, ["a"]), benchmark(spark, []), span=3, gram=4)


def test_query_columns_and_plan(spark):
    frame = decontaminate.query(spark, "/root/testdata/sf0.001")
    assert not re.search("Python|Pandas|Arrow", frame._jdf.queryExecution().executedPlan().toString())
    assert frame.dtypes == [
        ("doc_id", "bigint"), ("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"),
        ("items_sha256", "string"), ("contaminated", "boolean"),
    ]
    clean = frame.where("not contaminated").first()
    assert clean["items_sha256"] == hashlib.sha256(b"").hexdigest() and clean["n_hit"] == 0
    assert frame.where(F.col("contaminated")).count() > 0
