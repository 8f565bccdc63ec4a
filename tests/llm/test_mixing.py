import re
from collections import Counter

import pytest
from helpers import clashing, documents, hard_documents, rows_of
from pyspark.sql import functions as F

from terravane.llm import mixing


def level(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by resharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, full = share * sum(sizes.values()), set()
    while True:
        rest = budget - sum(most * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / open_weight for s in order}
        above = {s for s in order if s not in full and target[s] >= most * sizes[s]}
        if not above:
            return target
        full |= above


@pytest.mark.parametrize("words", [[3, 50, 7, 200, 40], [0, 0, 5], [9], [1, 1, 1, 1000], [10, 20, 30, 40, 50, 60, 70]])
def test_targets_equal_repeated_resharing(spark, words):
    names = [None, "é", "Z", "a", "b", "aa", "c"][: len(words)]
    frame = documents(spark, [" ".join(["w"] * n) for n in words], names)
    found = {r["source"]: r["target"] for r in mixing.mix_report(frame).collect()}
    assert found == pytest.approx(level(dict(zip(names, words))))


def test_hard_rows(spark):
    frame = hard_documents(spark)
    report = mixing.mix_report(frame).collect()
    assert len(report) == frame.count()
    sizes = Counter()
    for row, (doc, text, _, source, _) in zip(
        sorted(report, key=lambda r: repr((r["doc_id"], r["source"], r["size"]))),
        sorted(frame.collect(), key=lambda r: repr((r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))))),
    ):
        assert row["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        assert row["taken"] in (0, row["size"], 2 * row["size"])
        sizes[source] += row["size"]
    assert {r["source"]: r["source_size"] for r in report} == dict(sizes)


def test_mix_emits_what_the_report_says_and_keeps_columns(spark):
    frame = clashing(hard_documents(spark), "size", "target", "repeats", "turn", "weight")
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns
    wanted = Counter()
    for row in mixing.mix_report(frame).collect():
        wanted[row["doc_id"]] += row["repeats"]
    assert Counter(r["doc_id"] for r in mixed.collect()) == +wanted
    assert rows_of(mixed) == rows_of(mixing.mix(frame.repartition(3)))


def test_many_documents_come_near_their_target(spark):
    frame = documents(spark, ["w " * (1 + i % 9) for i in range(4000)], [f"s{i % 4}" for i in range(4000)])
    taken, targets = Counter(), {}
    for row in mixing.mix_report(frame).collect():
        taken[row["source"]] += row["taken"]
        targets[row["source"]] = row["target"]
    for source, target in targets.items():
        assert taken[source] == pytest.approx(target, rel=0.08)


def test_empty_table(spark):
    assert mixing.mix_report(documents(spark, [])).count() == 0
    assert mixing.mix(documents(spark, [])).count() == 0


def test_mix_and_report_agree_on_rows_without_an_id(spark):
    rows = [(None if i % 2 else i, "ab"[i % 3 == 0], f"word{i} " * (i % 7 + 1)) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    taken = {}
    for r in mixing.mix(frame).collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].split())
    told = {r["source"]: r["n"] for r in mixing.mix_report(frame).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    assert taken == told
