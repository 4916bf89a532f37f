"""Checks of feature tables and of the model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from checks.decide import DECIDED
from checks.parts import PARTS, r6
from checks.registry import check
from checks.relational import CELLS, SCORES, _auc
from checks.scalar import COUNTED, MEASURED
from loanloom.fixtures import AS_OF
from loanloom.operators import metrics, ranking
from loanloom.plans import boosting, decisions, features, model
from loanloom.session import fresh_path, materialise

_FITTED: dict = {}


def _sql(names, source: str = "feat", target: str = "target") -> str:
    return f"SELECT user_id, {', '.join(r6(n) for n in names)}, akb_grade, {target} AS target FROM {source}"


@check(_sql(features.FEATURES_V3))
def m1_features_v3(t):
    return features.build_features(t.credit, AS_OF)


GOOD = "coalesce(loans_paid, 0) > 0 AND coalesce(loans_overdue, 0) = 0"


@check(_sql(features.FEATURES_V2, target=f"CASE WHEN {GOOD} AND coalesce(failed_payments_30plus, 0) = 0 THEN 1 ELSE 0 END"))
def m2_features_v2(t):
    return features.build_features(t.credit, AS_OF, version=2)


@check(_sql(features.FEATURES_V1, target=f"CASE WHEN {GOOD} THEN 1 ELSE 0 END"))
def m2_features_v1(t):
    return features.build_features(t.credit, AS_OF, version=1)


@check(f"""SELECT user_id, age, {', '.join(COUNTED)}, {', '.join(r6(m) for m in MEASURED)}, akb_grade,
           CASE WHEN coalesce(loans_overdue, 0) > 0 THEN 'bad' WHEN coalesce(loans_paid, 0) > 0 THEN 'good' ELSE 'unknown' END
           AS borrower_label, TIMESTAMP '2024-01-31 00:00:00' AS created_at FROM feat""")
def m3_customer_features(t):
    return features.customer_features(t.credit, AS_OF)


@check(f"SELECT user_id, {', '.join(r6(f) for f in features.FEATURES_V3)} FROM feat_online")
def m4_online_features(t):
    return features.online_features(t.credit, AS_OF).select("user_id", *features.FEATURES_V3)


def _fitted(t):
    """Features, split and the model of one sample folder with the default settings, built once per session."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _FITTED:
        rows = materialise(features.build_features(t.credit, AS_OF))
        split = ranking.stratified_split(rows, "target", "user_id")
        _FITTED[key] = rows, split, model.train(split.where(F.col("slice") == "train"))
    return _FITTED[key]


@check()
def m5_training(t):
    rows, split, fitted = _fitted(t)
    trained = split.where(F.col("slice") == "train").agg(F.count("*").alias("customers"))
    return trained.withColumns({
        "trees": F.lit(fitted.stages[1].getNumTrees), "features": F.lit(len(model.feature_names(fitted)))})


@check()
def m6_prediction(t):
    rows, _, fitted = _fitted(t)
    return model.predict(rows, fitted).select("user_id", "probability", "prediction")


@check()
def m7_importances(t):
    return model.importances(t.spark, _fitted(t)[2])


@check("SELECT count(*) AS customers, count(*) AS same FROM users")
def m8_save_and_load(t):
    rows, _, fitted = _fitted(t)
    path = fresh_path(t.spark, "model")
    model.save(fitted, path)
    before = model.predict(rows, fitted).select("user_id", F.col("probability").alias("before"))
    after = model.predict(rows, model.load_if_there(t.spark, path)).select("user_id", "probability")
    both = before.join(after, "user_id")
    return both.agg(F.count("*").alias("customers"), F.count_if(F.col("before") == F.col("probability")).alias("same"))


@check()
def m9_evaluation(t):
    _, split, fitted = _fitted(t)
    return model.evaluate(split, fitted)


@check()
def m9_evaluation_without_target_inputs(t):
    _, split, _ = _fitted(t)
    kept = [f for f in features.FEATURES_V3 if f not in model.TARGET_INPUTS]
    fitted = model.train(split.where(F.col("slice") == "train"), kept)
    return model.evaluate(split, fitted)


def _tree(*nodes: tuple | float) -> boosting.Tree:
    """A tree of depth 2 from its 7 nodes: (feature, threshold, missing_left) or a leaf's value."""
    tree = boosting.Tree.empty(2)
    for i, node in enumerate(nodes):
        if isinstance(node, tuple):
            tree.feature[i], tree.threshold[i], tree.missing_left[i] = node
            tree.gain[i] = 10.0 / (i + 1)
        else:
            tree.value[i] = node
    return tree


#: A small ensemble in the form that training gives, so that scoring has an exact answer in SQL.
ENSEMBLE = boosting.Ensemble(
    ["total_loans", "akb_score", "payment_success_rate", "monthly_income", "loans_overdue"],
    [_tree((0, 3.0, True), (1, 500.0, False), (2, 0.5, True), -0.8, 0.35, -0.1, 0.9),
     _tree((4, 1.0, False), (3, 2500.0, True), (1, 350.0, True), 0.4, 0.75, -0.6, -0.25),
     _tree((2, 0.75, False), 0.2, (0, 8.0, True), 0.0, 0.0, -0.3, 0.15)])
PARTS["ensemble_margins"] = f"SELECT user_id, target, {ENSEMBLE.as_sql()} FROM feat"
PARTS["ensemble_predictions"] = """SELECT user_id, target, 1 / (1 + exp(-margin)) AS probability,
    CASE WHEN 1 / (1 + exp(-margin)) > 0.5 THEN 1 ELSE 0 END AS prediction FROM ensemble_margins"""
PARTS["ensemble_split"] = PARTS["split"].replace("FROM predictions", "FROM ensemble_predictions")
PARTS["ensemble_sliced"] = PARTS["sliced"].replace("FROM split", "FROM ensemble_split")


def _stored_ensemble(t):
    """The ensemble after a round through the model store."""
    path = fresh_path(t.spark, "ensemble")
    boosting.save(t.spark, ENSEMBLE, path)
    return boosting.load(t.spark, path)


@check(f"SELECT user_id, {r6('probability')}, prediction FROM ensemble_predictions")
def m6_ensemble_prediction(t):
    rows = boosting.predict(features.build_features(t.credit, AS_OF), _stored_ensemble(t))
    return rows.select("user_id", "probability", "prediction")


@check(f"""SELECT c.slice, tn, fp, fn, tp, {SCORES}, {r6('auc', 'roc_auc')}
           FROM (SELECT slice, {CELLS} FROM ensemble_sliced GROUP BY slice) c
           JOIN ({_auc('ensemble_sliced', 'slice')}) a ON a.slice = c.slice""")
def m9_ensemble_evaluation(t):
    rows = boosting.predict(features.build_features(t.credit, AS_OF), _stored_ensemble(t))
    return metrics.evaluation(ranking.stratified_split(rows, "target", "user_id"))


CUTS = [0.0, 1.0, 10.0, 100.0, 1000.0]
_FILLED = ", ".join(f"coalesce(CAST({f} AS DOUBLE), -1e300) AS {f}" for f in features.FEATURES_V3)


@check(f"""SELECT feature, CAST(CASE WHEN v = -1e300 THEN {len(CUTS) + 1} ELSE {' + '.join(f'(v >= {c})::INT' for c in CUTS)} END AS INT) AS bin,
             {r6('sum(0.5 - target)', 'g')}, {r6('sum(0.25)', 'h')}
           FROM (SELECT * FROM (SELECT target, {_FILLED} FROM feat) UNPIVOT (v FOR feature IN ({', '.join(features.FEATURES_V3)}))) u
           GROUP BY 1, 2""")
def m5_root_sums(t):
    """Gradient and Hessian of the first level of boosting for every feature and bin, missing values in a bin of their own."""
    edges = [np.array(CUTS)] * len(features.FEATURES_V3)
    return boosting.root_sums(features.build_features(t.credit, AS_OF), features.FEATURES_V3, edges)


WITHOUT = DECIDED.replace("FROM predictions", "FROM (SELECT user_id, CAST(NULL AS DOUBLE) AS probability FROM predictions) n")


@check(WITHOUT)
def m10_rules_without_model(t):
    absent = model.load_if_there(t.spark, fresh_path(t.spark, "no-model"))
    scored = model.probabilities(features.online_features(t.credit, AS_OF), absent)
    return decisions.decide_all(t.users, t.questionnaires, t.akb_scores, scored, AS_OF)
