import random

import numpy as np
from helpers import clashing, documents, hard_documents

from terravane.llm import quality

RATINGS = "doc_id long, grade int"


def test_thresholds_stay_ordered_and_grades_are_told_apart():
    rng = random.Random(2)
    rows, grades = [], []
    for i in range(600):
        grade = i % 3
        text = " ".join(["poor fair good".split()[grade]] * 6 + [rng.choice("abcdefgh") for _ in range(20)])
        rows.append(quality.features(text))
        grades.append(grade)
    model = quality.fit(rows, np.array(grades), np.ones(600), 3)
    assert model.thresholds[0] < model.thresholds[1]
    positions = np.array([model.weights[n] @ v for n, v in rows])
    tails = model.tails(positions)
    assert (np.diff(tails, axis=1) <= 0).all()
    assert ((tails > 0.5).sum(axis=1) == np.array(grades)).mean() > 0.99


def test_gradient_leads_to_a_minimum():
    """Moving any threshold or weight a little from the fitted state does not lower the loss."""
    rng = np.random.default_rng(0)
    rows = [(np.array([1, 2 + i % 3]), np.array([1.0, rng.normal()])) for i in range(90)]
    grades = rng.integers(0, 3, 90)
    model = quality.fit(rows, grades, np.ones(90), 3)

    def loss(weights, thresholds):
        bounds = np.concatenate([[-np.inf], thresholds, [np.inf]])
        at = np.array([weights[n] @ v for n, v in rows])
        chance = quality._logistic(bounds[grades + 1] - at) - quality._logistic(bounds[grades] - at)
        return -np.log(chance).mean() + quality.RIDGE / 2 * (weights**2).sum()

    base = loss(model.weights, model.thresholds)
    for place in (1, 2, 3, 4):
        for step in (-0.3, 0.3):
            moved = model.weights.copy()
            moved[place] += step
            assert loss(moved, model.thresholds) > base - 1e-4
    for place in (0, 1):
        for step in (-0.2, 0.2):
            moved = model.thresholds.copy()
            moved[place] += step
            assert loss(model.weights, moved) > base - 1e-4


def test_features_cover_the_whole_text():
    head = "plain words " * 40_000
    n1, v1 = quality.features(head)
    n2, v2 = quality.features(head + "last###")
    assert len(n2) == len(n1) + 2 and abs((v2[:-4] ** 2).sum() - 2) < 1e-9
    assert v2[-4:].tolist() == [0.0, 0.5, (79_997 / 80_000) ** 0.5, 0.5]
    assert len(quality.features(None)[0]) == len(quality.features(" ")[0]) == 0


def test_hard_rows_and_missing_ratings(spark):
    frame = clashing(hard_documents(spark), "mark", "label", "keep", "grade")
    none = spark.createDataFrame([], RATINGS)
    rows = quality.grade(frame, none).collect()
    assert len(rows) == frame.count() and all(r["keep"] and r["p_tail"] is None for r in rows)
    assert quality.keep_good(frame, none).count() == frame.count()
    ratings = spark.createDataFrame([(0, 2), (0, 0), (4, 1), (5, 2), (None, 1), (2, None), (7, 9)], RATINGS)
    rows = quality.grade(frame, ratings).collect()
    assert len(rows) == frame.count() and all(0 <= r["p_tail"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in rows)
    assert quality.keep_good(frame, ratings).columns == frame.columns
    assert quality.grade(documents(spark, []), ratings).count() == 0


def test_held_out_accuracy_on_the_tables(spark):
    folder = "/root/testdata/sf0.1"
    frame, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    seen = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    held = {r["doc_id"] for r in labels.subtract(seen).collect()}
    rows = [r for r in quality.grade(frame, quality.ratings_of(seen)).collect() if r["doc_id"] in held]
    good = [r["keep"] for r in rows if truth[r["doc_id"]] == 1]
    poor = [r["keep"] for r in rows if truth[r["doc_id"]] == 0]
    assert len(poor) > 100 and sum(good) >= 0.99 * len(good) and sum(poor) <= 0.05 * len(poor)
