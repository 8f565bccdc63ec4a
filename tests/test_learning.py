import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane import contracts
from terravane.operators import learning


def labelled(rows, n=200):
    values = [("train" if i % 3 else "calibration", float(i % 40), float((i * 7) % 11), int(i % 40 >= 25)) for i in range(n)]
    return rows("partition string, a double, b double, target int", *values)


def test_trained_and_calibrated_scores_follow_the_signal(rows):
    frame = labelled(rows)
    trained = learning.train_calibrated(frame, ["a", "b"], "target", learning.forest(trees=5, depth=3))
    out = learning.score(frame, "flood", trained).collect()
    assert all(0 <= r.flood_probability <= 1 and r.flood_available for r in out)
    assert sum(r.flood_prediction == r.target for r in out) > 190
    missing = learning.score(frame, "storm", learning.HazardModel(None)).first()
    assert missing.storm_probability is None and missing.storm_prediction == 0 and not missing.storm_available


def test_a_missing_feature_or_class_is_an_error(rows):
    holed = labelled(rows).withColumn("a", F.when(F.col("a") != 3, F.col("a")))
    with pytest.raises(contracts.ContractError, match="null"):
        learning.fit(holed, ["a", "b"], "target", learning.forest(trees=2, depth=2))
    with pytest.raises(contracts.ContractError, match="classes"):
        learning.fit(labelled(rows).where("target = 1"), ["a"], "target", learning.forest(trees=2, depth=2))


def test_given_coefficients(rows):
    frame = rows("a double, b double", (1.0, 2.0), (None, 1.0))
    model = learning.HazardModel(learning.LinearModel({"a": 2.0, "b": -1.0}, 0.0), learning.Sigmoid(4.0, -2.0), 0.4)
    got = [r.x_probability for r in learning.score(frame, "x", model).collect()]
    assert got[0] == pytest.approx(0.5) and got[1] is None


def test_equal_precision_is_decided_by_recall(rows):
    frame = rows("target int, low double, high double", *[(int(i > 5), i / 20, i / 10) for i in range(10)])
    best, table = learning.choose({"low": (frame, "low"), "high": (frame, "high")}, "target", 0.5)
    assert best == "high"
    assert {r.candidate: r.recall for r in table.collect()} == {"low": 0.0, "high": 1.0}


def test_horizons_in_one_pass(spark, rows):
    """Linear models by horizon: one scan of the rows, features of other horizons count nothing."""
    frame = rows("h int, a double, b double", (3, 1.0, 2.0), (7, 1.0, None), (3, None, 1.0), (9, 1.0, 1.0))
    models = {
        3: learning.HazardModel(learning.LinearModel({"a": 2.0, "b": -1.0}, 0.5), learning.Sigmoid(4.0, -2.0), 0.4),
        7: learning.HazardModel(learning.LinearModel({"a": 1.0}, -1.0), None, 0.6),
    }
    out = learning.score_horizons(frame, "h", "x", models)
    for days, model in models.items():
        alone = learning.score(frame.where(F.col("h") == days), "x", model).select("h", "a", "x_probability", "x_prediction")
        assert sorted(map(tuple, alone.collect()), key=repr) == sorted(map(tuple, out.where(F.col("h") == days).select("h", "a", "x_probability", "x_prediction").collect()), key=repr)
    assert out.count() == 3
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Union" not in plan


def test_sigmoid_equals_an_independent_fit(rows):
    """Slope and intercept against Newton's method on the same rows."""
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, 400)
    y = (rng.uniform(0, 1, 400) < 1 / (1 + np.exp(-(5 * x - 2)))).astype(int)
    fitted = learning.fit_sigmoid(rows("s double, t int", *zip(x.tolist(), y.tolist())), "s", "t")
    design, weights = np.c_[x, np.ones(400)], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ weights))
        weights += np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]), design.T @ (y - p))
    assert (fitted.slope, fitted.intercept) == pytest.approx(tuple(weights), rel=1e-3)


def test_comparison_trains_and_picks_the_candidate_that_learns(rows):
    frame = labelled(rows)
    best, table = learning.compare(
        frame, ["a", "b"], "target", {"stump": learning.forest(trees=1, depth=1), "trees": learning.boosted_trees(rounds=5, depth=3)}
    )
    measures = {r.candidate: r.pr_auc for r in table.collect()}
    assert best in measures and measures[best] == max(measures.values()) > 0.95


def test_learning_rows_are_written_once(spark):
    """Learners and measures read stored rows and do not repeat the series' windows."""
    from terravane.plans import learned
    from terravane.plans.registry import Tables

    plan = learned.learning_rows(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().toString()
    assert "Window" not in plan and "Aggregate" not in plan
