"""Training, scoring, storing and evaluating on a small generated matrix."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks import models
from loanloom.plans import model
from loanloom.plans.decisions import score_all
from loanloom.session import fresh_path

NAMES = ["a", "b", "c"]
QUICK = model.Training(trees=4, depth=3)


@pytest.fixture(scope="module")
def matrix(spark):
    random.seed(5)
    data = []
    for i in range(400):
        a, b = random.random(), random.random()
        data.append((f"u{i}", a, b if i % 7 else None, random.random(), int(a + 0.2 * random.random() > 0.6)))
    return spark.createDataFrame(data, "user_id string, a double, b double, c double, target int")


@pytest.fixture(scope="module")
def fitted(matrix):
    return model.train_and_evaluate(matrix, NAMES, QUICK)


def test_report_covers_all_slices(fitted):
    report = {r.slice: r for r in fitted[1].collect()}
    assert set(report) == {"test", "train", "all"}
    counts = {s: r.tn + r.fp + r.fn + r.tp for s, r in report.items()}
    assert counts["all"] == 400 == counts["test"] + counts["train"] and 78 <= counts["test"] <= 80
    assert report["test"].roc_auc > 0.8


def test_same_seed_same_probabilities_after_storing(spark, matrix, fitted):
    path = fresh_path(spark, "model")
    model.save(fitted[0], path)
    stored = model.load_if_there(spark, path)
    assert model.feature_names(stored) == NAMES
    before = {r.user_id: r.probability for r in model.predict(matrix, fitted[0]).collect()}
    after = {r.user_id: r.probability for r in model.predict(matrix, stored).collect()}
    assert before == after and all(0 <= p <= 1 for p in before.values())


def test_importance_table(spark, fitted):
    scores = {r.feature: r.importance for r in model.importances(spark, fitted[0]).collect()}
    assert set(scores) == set(NAMES) and sum(scores.values()) == pytest.approx(1.0) and max(scores, key=scores.get) == "a"


def test_no_model_leaves_the_decision_to_the_rules(spark, matrix):
    assert model.load_if_there(spark, fresh_path(spark, "nothing")) is None
    assert model.probabilities(matrix, None) is None
    assert model.predict(matrix, None).where("probability IS NOT NULL").count() == 0


def test_scored_features_need_no_join(matrix, fitted):
    wide = model.predict(matrix, fitted[0]).withColumns({"age": F.lit(30.0), "akb_score": F.lit(500.0), "akb_grade": F.lit("D")})
    extra = ["loans_paid_count", "total_loans", "successful_payments", "failed_payments", "payment_success_rate", "total_overdue_interest"]
    scored = score_all(wide.withColumns({c: F.lit(1.0) for c in extra}), None, "2024-01-31 00:00:00")
    assert "Join" not in scored._jdf.queryExecution().optimizedPlan().toString()
    assert scored.count() == 400 and scored.where("ml_probability IS NULL").count() == 0


def test_registered_queries_train_with_the_default_settings(spark, monkeypatch):
    used = []
    monkeypatch.setattr(models, "_FITTED", {})
    monkeypatch.setattr(model, "train", lambda rows, features=None, settings=model.TRAINING_V3: used.append((settings.trees, settings.depth)))
    monkeypatch.setattr(model, "evaluate", lambda split, fitted: spark.range(1))
    entry.queries()["m9_evaluation_without_target_inputs"](spark, "/root/testdata/sf0.001")
    assert used == [(300, 5), (300, 5)]
