from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from test_nearcopies import brute as brute_near_copies
from check_oracle import canonical
from terravane.llm import catalogue, mixing, packing, quality, toxicity

FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "conversations", "labels", "benchmark")


@pytest.mark.parametrize("name", list(catalogue.SQL))
def test_query_equals_its_sql_twin(spark, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    frame = catalogue.QUERIES[name](spark, FOLDER)
    answer = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == sorted(frame.columns)
    assert canonical(frame.columns, [tuple(r) for r in frame.collect()]) == canonical(names, answer.fetchall())


def test_all_are_registered():
    names = entry_point.queries()
    assert set(catalogue.QUERIES) <= set(names) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in catalogue.QUERIES) == list(range(1, 14))


def test_pipeline_stages_hold_what_they_promise(spark):
    """Each stage against its operator's own verdicts on what the stage was given."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    columns, seen = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], FOLDER).cache())
    assert all(frame.columns == columns for frame in seen[:-1])
    ids = [Counter(r["doc_id"] for r in frame.collect()) for frame in seen]

    kept = {r["doc_id"] for r in quality.grade(seen[0], quality.ratings_of(labels)).collect() if r["keep"]}
    assert set(ids[1]) == kept
    clean = {r["doc_id"] for r in toxicity.score(seen[1], labels).collect() if r["score"] < toxicity.TOXIC_FROM}
    assert set(ids[2]) == clean
    assert sorted(ids[3].elements()) == brute_near_copies(seen[2].collect())
    wanted = {r["doc_id"]: r["repeats"] for r in mixing.mix_report(seen[3]).collect() if r["repeats"]}
    assert ids[4] == wanted
    pieces = Counter(tuple(r) for r in packing.token_pieces(seen[4]).collect())
    assert Counter(tuple(r)[:5] for r in seen[5].collect()) == pieces
    again = corpus_pipeline.run(spark, FOLDER)
    shown = lambda frame: sorted(tuple(r)[:5] for r in frame.collect())
    assert shown(again) == shown(seen[5])


def test_pipeline_on_hard_rows(spark, tmp_path):
    from helpers import hard_documents

    hard_documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and {r["doc_id"] for r in rows} <= {0, 1, 2, 3, 4, 5, 6, 7, None}
    hard_documents(spark).limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
