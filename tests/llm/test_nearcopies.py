import random

from helpers import classes_of, clashing, documents, hard_documents

import corpus_pipeline
from terravane.llm import nearcopies, simhash


def slow_shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    """Kept ids: the smallest of each component; None for components without an id."""
    sets = [slow_shingles(r["text"]) for r in rows]
    label = classes_of(range(len(rows)), lambda i, j: jaccard(sets[i], sets[j]) >= 0.8)
    least = {}
    for i, r in enumerate(rows):
        ids = [d for d in (least.get(label[i]), r["doc_id"]) if d is not None]
        least[label[i]] = min(ids) if ids else None
    return sorted(least.values(), key=lambda d: (d is None, d))


def kept(frame):
    return sorted((r["doc_id"] for r in frame.collect()), key=lambda d: (d is None, d))


def edited(rng, text, edits):
    words = text.split()
    for place in rng.sample(range(len(words)), edits):
        words[place] = f"edit{rng.random()}"
    return " ".join(words)


def varied(rng):
    """Texts with copies of 0 to 10 edited words, a chain, and a passage that many texts share."""
    word = lambda: f"w{rng.randrange(3000)}"
    texts = [" ".join(word() for _ in range(200)) for _ in range(12)]
    texts += [edited(rng, t, n) for t in texts[:12] for n in range(0, 11, 2)]
    chain = texts[0]
    for _ in range(12):
        chain = edited(rng, chain, 3)
        texts.append(chain)
    passage = " ".join(word() for _ in range(120))
    texts += [f"{passage} " + " ".join(word() for _ in range(rng.choice([15, 20, 25, 40, 100]))) for _ in range(60)]
    texts += ["a b c", "A  b C", "a b c d", "a b c d e", "a b c d e f"]
    rng.shuffle(texts)
    return texts


def test_stage_keeps_one_of_near_copies(spark):
    """Copies with a few edited words: too far apart for three bits, but of similarity 0.8 and more."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(300)) for _ in range(20)]
    texts += [edited(rng, t, 5) for t in texts]
    frame = documents(spark, texts)
    assert simhash.keep_one(frame).count() > 20
    assert kept(corpus_pipeline.near_duplicates(spark, frame, "")) == list(range(20))


def test_against_brute_force(spark):
    frame = documents(spark, varied(random.Random(9))).union(hard_documents(spark))
    wanted = brute(frame.collect())
    found = nearcopies.keep_one(clashing(frame, "row_tag", "node", "wanted", "label"))
    assert found.columns == [*frame.columns, "row_tag", "node", "wanted", "label"]
    assert kept(found) == wanted and 20 < len(wanted) < frame.count() - 50


def test_no_document_goes_for_a_hash(spark):
    """All in one bucket, whatever their words: only what the texts show is linked."""
    texts = [" ".join(f"t{i}x{j}" for j in range(30)) for i in range(8)]
    texts += [texts[3] + " more", texts[5] + " other", "more " + texts[3]]
    rows = [(i, t, len(slow_shingles(t)), [7]) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "node long, text string, size long, bands array<long>")
    found = nearcopies.groups(frame.select("node", "size", "bands"), frame.select("node", "text"))
    assert {tuple(r) for r in found.collect()} == {(3, 3), (8, 3), (10, 3), (5, 5), (9, 5)}


def test_large_buckets_are_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "BLOCK", 7)
    texts = varied(random.Random(6))
    rows = [(i, t, len(slow_shingles(t)), [7]) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "node long, text string, size long, bands array<long>")
    found = nearcopies.groups(frame.select("node", "size", "bands"), frame.select("node", "text"))
    sets = [slow_shingles(t) for t in texts]
    wanted = classes_of(range(len(texts)), lambda i, j: jaccard(sets[i], sets[j]) >= 0.8)
    alone = {n for n in wanted if list(wanted.values()).count(wanted[n]) == 1}
    assert {tuple(r) for r in found.collect()} == {(n, c) for n, c in wanted.items() if n not in alone}


def test_simhash_components_are_buckets(spark):
    """Without any band, near-copies within three bits of each other still meet, and are verified on the texts."""
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(400)) for _ in range(6)]
    texts += [f"{t} end" for t in texts[:4]]
    prints = [simhash.fingerprint(t) for t in texts]
    within = {(i, i + 6) for i in range(4) if ((prints[i] ^ prints[i + 6]) & (2**64 - 1)).bit_count() <= 3}
    assert within
    # a component of two texts that have nothing in common but a fingerprint
    prints[5] = prints[4]
    rows = [(i, t, len(slow_shingles(t)), [], p) for i, (t, p) in enumerate(zip(texts, prints))]
    frame = spark.createDataFrame(rows, "node long, text string, size long, bands array<long>, print long")
    met = nearcopies.with_classes(frame.select("node", "size", "bands", "print"))
    buckets = {r["node"]: r["bands"] for r in met.collect()}
    assert len(buckets[4]) == 1 and buckets[4] == buckets[5]
    assert all(buckets[a] == buckets[b] != [] for a, b in within)
    found = nearcopies.groups(met, frame.select("node", "text"))
    assert {tuple(r) for r in found.collect()} == {(n, a) for a, b in within for n in (a, b)}


def test_thinned_pairs_keep_components(spark):
    """A dense group comes down to one pair a node; chains and stars keep their components."""
    dense = [(i, j) for i in range(60) for j in range(i + 1, 60)]
    chain = [(100 + i, 101 + i) for i in range(40)]
    star = [(300, 200 + i) for i in range(40)]
    rng = random.Random(2)
    loose = [tuple(rng.sample(range(400, 500), 2)) for _ in range(70)]
    pairs = spark.createDataFrame(dense + chain + star + loose, "a long, b long")
    nodes = {n for r in pairs.collect() for n in r}
    links = {frozenset(r) for r in pairs.collect()}
    thin = nearcopies.thinned(pairs)
    assert thin.where("a < 60").count() == 59 and thin.count() <= 2 * len(nodes)
    wanted = classes_of(nodes, lambda a, b: frozenset((a, b)) in links)
    assert {tuple(r) for r in nearcopies._labels(pairs).collect()} == set(wanted.items())


def test_marks_hold_the_fingerprint(spark):
    frame = documents(spark, ["One two three four five six", "", None, "one two"])
    found = frame.select("text", nearcopies._marks_of("text").alias("m")).collect()
    assert [r["m"]["print"] for r in found] == [simhash.fingerprint(r["text"]) for r in found]


def test_empty_table(spark):
    assert nearcopies.keep_one(documents(spark, [])).count() == 0
