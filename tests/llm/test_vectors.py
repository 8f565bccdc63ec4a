import math

import numpy as np
import pytest
from helpers import clashing

from terravane.llm import nearest, topk

SCHEMA = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")
HARD = [
    (0, [0.5, -0.25, 1.0], 1),
    (50, [0.5, -0.25, 1.0], 1),
    (100, [0.1, 0.2, 0.3], None),
    (100, [0.1, 0.2, 0.3], None),
    (3, None, 1),
    (4, [None, 1.0, 2.0], 1),
    (5, [NAN, 1.0, 2.0], 1),
    (6, [INF, 1.0, 2.0], 1),
    (150, [0.0, 0.0, 0.0], 1),
    (7, [1.0, 1.0], 1),
    (None, [1.0, 1.0, 1.0], 1),
    (8, [0.5, -0.25, 1.0], 2),
    (9, [], 2),
    (-50, [-0.5, 0.7, 0.001], 2),
]


def brute_top(rows, every, best):
    good = [
        (i, [math.floor(256 * x) for x in v])
        for i, v, _ in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    found = []
    for i, v in good:
        if i % every == 0:
            others = [(-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i and len(w) == len(v)]
            found += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(others)[:best], 1)]
    return sorted(found)


def as_float(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows]


def test_top_hard_rows(spark):
    frame = clashing(spark.createDataFrame(HARD, SCHEMA), "row", "rank", "score", "v")
    assert sorted(map(tuple, topk.top_inner_products(frame).collect())) == brute_top(as_float(HARD), 50, 5)


@pytest.mark.parametrize("seed", range(3))
def test_block_bounds_settle_on_the_exact_answer(seed):
    rng = np.random.default_rng(seed)
    values = rng.integers(-9, 10, (700, 6)) if seed else np.vstack([rng.integers(-3, 4, (650, 6)), rng.integers(90, 99, (50, 6))])
    queries = rng.integers(-9, 10, (20, 6))
    ids, query_ids = rng.permutation(700), np.arange(20)
    found = {}
    for q, c, s in topk.block_top(query_ids, queries, ids, values, 5):
        found.setdefault(q, []).append((-s, int(ids[c])))
    for q in range(20):
        exact = sorted((-int(queries[q] @ v), int(i)) for v, i in zip(values, ids) if i != q)[:5]
        assert sorted(found[q]) == exact


@pytest.mark.parametrize("clustered", [False, True])
def test_a_carried_bar_settles_most_queries_by_bounds(spark, clustered):
    """With the bar of one block, reading another stops before the ends of its lists."""
    rng = np.random.default_rng(3)
    rows = np.array([r[0] for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding").collect()])
    if clustered:
        rows = rows[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 64)) * 0.02
    rows = np.floor(256 * rows).astype(np.int64)
    half, ids = len(rows) // 2, np.arange(len(rows))
    queries, query_ids, settled, found = rows[::50], ids[::50], [], {}
    for block in (slice(0, half), slice(half, None)):
        bars = np.array([sorted(found[q])[4][0] * -1.0 for q in range(len(queries))]) if found else None
        for q, c, s in topk.block_top(query_ids, queries, ids[block], rows[block], 5, bars, settled if found else None):
            found.setdefault(q, []).append((-s, int(ids[block][c])))
    for q, own in enumerate(query_ids):
        exact = sorted((-int(queries[q] @ v), int(i)) for v, i in zip(rows, ids) if i != own)[:5]
        assert sorted(found[q])[:5] == exact
    assert len(set(settled)) == len(settled) >= 0.9 * len(queries)


def test_top_beyond_exact_doubles(spark):
    rows = [(50 * i, [3.0e5 * (i + 1), 2.5e5 + i, -1.0e5], 0) for i in range(12)] + [(1, [2.0e6, 1.0, 1.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception):
        topk.top_inner_products(spark.createDataFrame([(0, [1e17], 0), (1, [1e17], 0)], "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(map(tuple, topk.top_inner_products(frame).collect())) == brute_top(rows, 50, 5)


def test_top_many_rows_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 150)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=8) / 3)], 0) for i in range(4000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set(coalesce, "false")
    try:
        found = sorted(map(tuple, topk.top_inner_products(frame).collect()))
    finally:
        spark.conf.set(coalesce, "true")
    assert found == brute_top(rows, 50, 5)


def test_top_empty(spark):
    assert topk.top_inner_products(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_near(rows, every, best):
    good = [(i, np.array(v)) for i, v, _ in rows if i is not None and v and len(v) == 3 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    found = []
    for i, v in good:
        if i % every == 0:
            others = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in good if j != i)
            found += [(i, r, j, d) for r, (d, j) in enumerate(others[:best], 1)]
    return sorted(found)


def test_nearest_hard_rows(spark):
    frame = clashing(spark.createDataFrame(HARD, SCHEMA), "row", "rank", "list", "block")
    assert sorted(map(tuple, nearest.nearest(frame, every=50).collect())) == brute_near(as_float(HARD), 50, 10)
    assert nearest.nearest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_nearest_recall_and_exact_distances(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = frame.select("vec_id", "embedding").collect()
    ids, values = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    found = {}
    for r in nearest.nearest(frame).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    at = {int(i): k for k, i in enumerate(ids)}
    for k in np.flatnonzero(ids % 100 == 0):
        away = np.sqrt(((values - values[k]) ** 2).sum(1))
        away[k] = np.inf
        truth = set(ids[np.lexsort((ids, away))[:10]].tolist())
        mine = sorted(found[int(ids[k])])
        assert [m[0] for m in mine] == list(range(1, 11))
        assert [(m[2], m[1]) for m in mine] == sorted((m[2], m[1]) for m in mine)
        assert all(m[2] == pytest.approx(away[at[m[1]]], rel=1e-15) for m in mine)
        hits += len(truth & {m[1] for m in mine})
        total += 10
    assert hits / total >= 0.9


def test_graph_finds_nearly_what_brute_force_finds():
    rng = np.random.default_rng(0)
    sample = rng.normal(size=(6000, 16))
    index = nearest.fit(sample, 400)
    numbers, _ = index.search(sample[:300], 64)
    truth = np.argsort(nearest._distances(sample[:300], index.centroids), axis=1)[:, :10]
    hits = sum(len(set(n[:10]) & set(t)) for n, t in zip(numbers, truth))
    assert hits >= 0.95 * truth.size
    sizes = np.bincount(nearest._distances(sample, index.centroids).argmin(1), minlength=len(index.centroids))
    assert sizes.max() <= 6 * sizes.mean()


def test_lonely_and_copied_queries_are_answered(spark):
    """A query far from all rows, and one among many equal rows, still get their ten."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=3)], 0) for i in range(1, 1500)]
    rows += [(0, [900.0, 1.0, 1.0], 0)] + [(i, [0.5, 0.5, 0.5], 0) for i in range(2000, 3600)]
    found = {}
    for r in nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {len(v) for v in found.values()} == {10} and len(found) == 31
    assert [v for _, v, _ in sorted(found[2000])] == list(range(2001, 2011))
    want = sorted((math.dist(v, rows[1499][1]), i) for i, v, _ in rows if i != 0)[:10]
    assert [v for _, v, _ in sorted(found[0])] == [i for _, i in want]


def brute_lengths(rows, every, best):
    good = [(i, np.array(v)) for i, v, _ in rows]
    found = []
    for i, v in good:
        if i % every == 0:
            others = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in good if j != i and len(w) == len(v))
            found += [(i, r, j, d) for r, (d, j) in enumerate(others[:best], 1)]
    return sorted(found)


def test_vectors_of_rarer_lengths_and_copied_ids_are_searched(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 16)
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(-2, 3, 2 + (i % 5 == 0) + (i % 25 == 0)).astype(float).tolist(), 0) for i in range(600)]
    rows += [(100, [1.0, 1.0, 1.0], 0)] * 25 + [(7, [1.0, 1.0, 1.0], 0)] * 15
    rows = [r for r in rows if any(r[1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(nearest, "LIST_ROWS", 10_000)
    assert sorted(map(tuple, nearest.nearest(frame, every=50).collect())) == brute_lengths(rows, 50, 10)


def clustered(many, rng):
    centres = rng.normal(size=(many // 100, 32))
    return centres[rng.integers(0, len(centres), many)] + 0.35 * rng.normal(size=(many, 32))


def test_long_lists_are_divided_level_by_level(spark, monkeypatch):
    """With few lists a level, the number of lists still grows with the table."""
    monkeypatch.setattr(nearest, "MOST_LISTS", 4)
    monkeypatch.setattr(nearest, "SPLIT", 400)
    monkeypatch.setattr(nearest, "SPLIT_SAMPLE", 64)
    monkeypatch.setattr(nearest, "BLOCK", 128)
    kept, real = [], nearest.answers
    monkeypatch.setattr(nearest, "answers", lambda a, h, b: kept.append(h) or real(a, h, b))
    values = clustered(6000, np.random.default_rng(4))
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(values)], "vec_id long, embedding array<double>, label int")
    found = {}
    for r in nearest.nearest(frame).collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = 0
    for q in range(0, 6000, 100):
        away = ((values - values[q]) ** 2).sum(1)
        away[q] = np.inf
        assert len(found[q]) == 10
        hits += len(set(np.argsort(away)[:10].tolist()) & set(found[q]))
    assert hits >= 0.9 * 600
    sizes = kept[0].groupBy("list").count().collect()
    assert len(sizes) > 16 and any(r["list"].count("/") > 1 for r in sizes)


def test_share_of_entries_read_on_clustered_vectors():
    values = clustered(50_000, np.random.default_rng(6))
    sample, queries = values[::3][:16_000], values[::500]
    index = nearest.fit(sample, 500)
    homes = index.homes(values)
    size = np.bincount(np.concatenate(homes), minlength=len(index.centroids))
    probes = index.probes(queries)
    assert np.mean([size[p].sum() for p in probes]) < 0.3 * len(values)
    hits = 0
    for query, read in zip(queries, probes):
        truth = np.argsort(((values - query) ** 2).sum(1))[1:11]
        hits += sum(not set(read).isdisjoint(homes[t]) for t in truth)
    assert hits >= 0.95 * 10 * len(queries)
