import random
import re

import xxhash
from helpers import classes_of, clashing, documents, hard_documents, rows_of
from pyspark.sql import functions as F

from terravane.llm import simhash


def slow_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def unsigned(value):
    return value & (1 << 64) - 1


def test_fingerprint_equals_the_slow_one():
    rng = random.Random(3)
    texts = [None, "", " \n", "one", "One two", "a b c", "a b c d", "É é Σ\x1cx\xa0y z", "\x0b a\x0cb"]
    texts += [" ".join(rng.choice(["aa", "B", "cé", "d."]) for _ in range(n)) for n in (5, 40, 900)]
    for text in texts:
        assert unsigned(simhash.fingerprint(text)) == slow_fingerprint(text)


def test_hash_is_the_engines_own(spark):
    row = spark.sql("select xxhash64('one two three') h").first()
    assert unsigned(row["h"]) == xxhash.xxh64_intdigest(b"one two three", seed=42)


def near_prints(rng, centres, around):
    found = {0}
    for _ in range(centres):
        centre = rng.getrandbits(64)
        found.add(centre)
        for _ in range(around):
            value = centre
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                value ^= 1 << bit
            found.add(value)
    return sorted(v - (1 << 64) if v >> 63 else v for v in found)


def test_links_lose_and_add_nothing(spark):
    prints = near_prints(random.Random(5), 40, 12)
    frame = spark.createDataFrame([(p,) for p in prints], "print long")
    wanted = {
        (a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (unsigned(a) ^ unsigned(b)).bit_count() <= 3
    }
    assert len(wanted) > 100
    assert {tuple(r) for r in simhash.links(frame).collect()} == wanted


def test_visits_are_not_broadcast(spark):
    """Their size is estimated before they are replicated, so a small table of prints tells nothing of it."""
    found = simhash.links(spark.range(0, 3000, 1000).select(F.col("id").alias("print")))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_every_split_of_three_bits_meets(spark):
    """Differences of every weight in either half, bits 31 and 63 included."""
    rng, pairs = random.Random(8), []
    for low in range(4):
        for high in range(4 - low):
            for edge in (False, True):
                value = rng.getrandbits(64)
                bits = rng.sample(range(31), low) + [32 + b for b in rng.sample(range(31), high)]
                if edge and bits:
                    bits[0] = 31 if bits[0] < 32 else 63
                other = value
                for bit in bits:
                    other ^= 1 << bit
                if other != value:
                    pairs.append(tuple(sorted(v - (1 << 64) if v >> 63 else v for v in (value, other))))
    frame = spark.createDataFrame([(p,) for pair in pairs for p in pair], "print long").distinct()
    found = {tuple(r) for r in simhash.links(frame).collect()}
    assert set(pairs) <= found


def test_long_chains_are_one_component(spark):
    chain, value, rng = [], 0, random.Random(2)
    for bit in rng.sample(range(64), 60):
        chain.append(value)
        value ^= 1 << bit
    signed = [v - (1 << 64) if v >> 63 else v for v in chain]
    frame = spark.createDataFrame([(i + 10, p) for i, p in enumerate(signed)], "doc_id long, print long")
    found = {r["print"]: r["component_id"] for r in simhash.classes(frame).collect()}
    assert len(found) == 60 and set(found.values()) == {10}


def brute(rows):
    prints = {p for _, p in rows}
    label = classes_of(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for doc, p in rows:
        if doc is not None:
            least[label[p]] = min(least.get(label[p], doc), doc)
    return sorted(((doc, f"{p:016x}", least.get(label[p])) for doc, p in rows), key=repr)


def test_documents_against_brute_force(spark):
    rng = random.Random(11)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta".split()) for _ in range(200)) for _ in range(25)]
    texts = base + [t + " more" for t in base] + base[:7] + [t.replace("alpha", "omega", 1) for t in base]
    frame = documents(spark, texts).union(hard_documents(spark))
    wanted = brute([(r["doc_id"], slow_fingerprint(r["text"])) for r in frame.collect()])
    assert rows_of(simhash.near_duplicates(clashing(frame, "print", "component_id", "label"))) == wanted


def test_keep_one(spark):
    frame = clashing(hard_documents(spark), "row_tag", "print", "wanted")
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    found = {r["fingerprint"]: r["component_id"] for r in simhash.near_duplicates(frame).collect()}
    classes = {v for v in found.values() if v is not None} | {k for k, v in found.items() if v is None}
    assert kept.count() == len(classes)
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(0) == 1 and set(i for i in ids if i is not None) == {v for v in found.values() if v is not None}


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.keep_one(documents(spark, [])).count() == 0
