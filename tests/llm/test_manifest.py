import hashlib
import random
import zlib

import duckdb
import pytest
from helpers import clashing, documents, hard_documents, rows_of
from pyspark.sql import functions as F

from terravane.llm import manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    return sha("".join(map(field, (row["doc_id"], row["source"], row["lang"], row["n_chars"], text))))


def tree(nodes, fan):
    """Levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + fan])) for i in range(0, len(last), fan)])
    return levels


def climb(levels, place, told, fan):
    proof = []
    for nodes in levels[:-1]:
        first = place // fan * fan
        run = nodes[first : first + fan]
        proof += run[: place - first] + run[place - first + 1 :]
        told = sha("".join(run[: place - first] + [told] + run[place - first + 1 :]))
        place //= fan
    return proof, told


def brute(rows, fan=16):
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    of = {s: sorted((r for r in rows if r["source"] == s), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]))) for s in sources}
    trees = {s: tree([leaf(r, r["text"]) for r in of[s]], fan) for s in sources}
    top = tree([trees[s][-1][0] for s in sources], fan)
    found = []
    for at, s in enumerate(sources):
        for place, r in enumerate(of[s]):
            own, told = leaf(r, r["text"]), leaf(r, r["text"])
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None:
                told = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]))
            low, told = climb(trees[s], place, told, fan)
            high, told = climb(top, at, told, fan)
            root = top[-1][0]
            found.append((r["doc_id"], own, trees[s][-1][0], root, sha("".join(low + high)), told, told == root))
    return sorted(found, key=repr)


def proofs(spark, docs, fan=16, levels=3):
    made = manifest.Manifest(docs, fan, levels)
    found = manifest.multiproofs(made)
    return found.select("doc_id", "leaf", "subroot", F.lit(made.root), "proof_sha256", "folded_root", "verified")


def some(spark, sizes, seed=1):
    rng, texts, sources = random.Random(seed), [], []
    for name, size in sizes.items():
        texts += [rng.choice(["Some Text", "plain", "É A", ""]) + str(rng.randint(0, 9)) for _ in range(size)]
        sources += [name] * size
    order = rng.sample(range(len(texts)), len(texts))
    return documents(spark, [texts[i] for i in order], [sources[i] for i in order])


@pytest.mark.parametrize("fan, levels", [(16, 3), (2, 1), (3, 2)])
def test_against_brute_force(spark, fan, levels):
    """Full runs, runs of one, lone leaves, and more trees than one run of the upper tree holds."""
    sizes = {"a": 257, "b": 16, "c": 17, "d": 1, None: 33} | {f"s{i}": 1 + i % 3 for i in range(30)}
    docs = clashing(some(spark, sizes), "tree", "place", "leaf", "row", "size", "told")
    assert rows_of(proofs(spark, docs, fan, levels)) == brute(docs.collect(), fan)


def test_hard_rows(spark):
    docs = hard_documents(spark)
    docs = docs.union(docs).union(documents(spark, ["same"] * 40).withColumn("doc_id", F.lit(5).cast("long")))
    found = rows_of(proofs(spark, docs))
    assert found == brute(docs.collect())
    assert {r[-1] for r in found} == {True, False}


def test_part_of_the_rows_is_proved_from_fetched_nodes(spark):
    made = manifest.Manifest(some(spark, {"a": 300, "b": 40}), fan=4, levels=2)
    whole = {r["row"]: r.asDict() for r in manifest.multiproofs(made).collect()}
    part = manifest.multiproofs(made, made.leaves.where("place % 7 = 3")).collect()
    assert len(part) > 40 and all(whole[r["row"]] == r.asDict() for r in part)
    for r in part:
        assert sha(r["proof"]) == r["proof_sha256"] and len(r["proof"]) % 64 == 0


def test_missing_is_minimal():
    """Nothing asked for can be derived, and all that is not asked for can."""
    for size, known in ((1, [0]), (17, [16]), (300, [0, 5, 255]), (256, range(256)), (4097, [4096, 1])):
        asked = set(manifest.missing(list(known), size))
        widths, have = manifest.heights(size), {(0, i) for i in known}
        assert not asked & have
        for level, width in enumerate(widths[:-1]):
            runs = {i // 16 for at, i in have if at == level}
            members = {(level, i) for run in runs for i in range(run * 16, min(run * 16 + 16, width))}
            assert {c for c in asked if c[0] == level} == members - have
            have |= {(level + 1, run) for run in runs}
        assert (len(widths) - 1, 0) in have


def test_empty_and_single(spark):
    assert proofs(spark, documents(spark, [])).count() == 0
    row = proofs(spark, documents(spark, ["one"])).first()
    assert row["leaf"] == row["subroot"] == row["folded_root"] and row["proof_sha256"] == sha("")


def test_twin_on_hard_rows(spark, tmp_path):
    docs = hard_documents(spark).union(some(spark, {"a": 300, None: 20} | {f"s{i}": 1 for i in range(20)}))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = duck.execute("select doc_id, leaf, subroot, root, proof_sha256, folded_root, verified from (" + manifest.SQL + ")")
    assert sorted(found.fetchall(), key=repr) == rows_of(manifest.query(spark, str(tmp_path)))
