"""Rules, scorecard, offers, reasons, features and decisions on edge values."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from loanloom import fixtures
from loanloom.plans import decisions, features, jobs, labels, model, offers, rules
from loanloom.plans.reasons import reason_list
from loanloom.session import fresh_path

NOW = "2024-01-31 00:00:00"
EDGES = [None, 0.0, 299.99, 300.0, 399.99, 400.0, 499.99, 500.0, 599.99, 600.0, 749.99, 750.0]


def out(df):
    return [r.out for r in df.collect()]


def test_hard_rules_in_order(make):
    df = make("birth date, age int, score double", (None, None, None), (date(2010, 1, 1), 14, None), (date(1990, 1, 1), 34, None),
              (date(1990, 1, 1), 34, 299.99), (date(1990, 1, 1), 34, 300.0), (date(2006, 1, 31), 18, 300.0))
    got = out(df.select(rules.hard_rules(F.col("birth"), F.col("age"), F.col("score")).alias("out")))
    assert got == [rules.NO_BIRTH_DATE, rules.TOO_YOUNG, rules.NO_SCORE, rules.LOW_SCORE, rules.PASSED, rules.PASSED]
    batch = out(df.select(rules.hard_rules_batch(F.col("age"), F.col("score")).alias("out")))
    assert batch == [rules.LOW_SCORE, rules.TOO_YOUNG, rules.LOW_SCORE, rules.LOW_SCORE, None, None]
    stored = out(df.select(rules.hard_rules_feature_table(F.col("score")).alias("out")))
    assert stored == [None, None, None, rules.LOW_SCORE, None, None]


def points(age, score, income, expenses, debt, overdue, has_overdue):
    score, income, expenses, debt, overdue = (x or 0 for x in (score, income, expenses, debt, overdue))
    total = 50.0 + next((p for low, p in ((750, 30), (600, 20), (400, 10), (300, 5)) if score >= low), 0)
    total += next((p for low, p in ((2000, 20), (1000, 14), (500, 8), (0, 3)) if income - expenses > low), -10)
    if income > 0:
        dti = debt / income
        total += 10 if dti == 0 else 5 if dti < 0.3 else 0 if dti < 0.5 else -10 if dti < 1 else -20
    if has_overdue:
        total -= 35 if overdue > 1000 else 25
    if age and 25 <= age <= 45:
        total += 5
    elif age and age > 55:
        total -= 5
    return max(5.0, min(95.0, total))


def test_scorecard_at_every_limit(make):
    cases = []
    for score in EDGES:
        cases.append((30, score, 1000.0, 500.0, 100.0, 0.0, False))
    for net in (-1.0, 0.0, 0.01, 500.0, 500.01, 1000.0, 1000.01, 2000.0, 2000.01):
        cases.append((50, 400.0, 3000.0, 3000.0 - net, 0.0, 0.0, None))
    for ratio in (0.0, 0.29, 0.3, 0.49, 0.5, 0.99, 1.0, -0.5):
        cases.append((56, 400.0, 1000.0, None, ratio * 1000, 1000.01, True))
    cases += [(24, 300.0, 0.0, 10.0, 500.0, 1000.0, True), (None, None, None, None, None, None, None), (45, 800.0, 9000.0, 0.0, 0.0, 0.0, False)]
    df = make("k int, age int, score double, income double, expenses double, debt double, overdue double, has_overdue boolean",
              *[(k, *case) for k, case in enumerate(cases)])
    columns = [F.col(c) for c in ("age", "score", "income", "expenses", "debt", "overdue", "has_overdue")]
    got = {r.k: r.out for r in df.select("k", rules.scorecard(*columns).alias("out")).collect()}
    assert got == {k: points(*case) for k, case in enumerate(cases)}


OFFERS = {90: (13000, 11000, 10000, 8000), 80: (9100, 7700, 7000, 5600), 70: (6500, 5500, 5000, 4000),
          60: (3900, 3300, 3000, 2400), 50: (2000, 1700, 1500, 1200)}


@pytest.mark.parametrize("ml", OFFERS)
def test_offer_amounts(make, ml):
    df = make("k int, ml double, score double", *[(k, float(ml), s) for k, s in enumerate((750.0, 600.0, 400.0, 399.99))])
    got = df.orderBy("k").select(offers.loan_offer(F.col("ml"), F.col("score")).alias("out")).collect()
    assert tuple(r.out.max_amount for r in got) == OFFERS[ml]
    assert {r.out.interest_rate for r in got} == {12 if ml >= 80 else 18 if ml >= 65 else 24}
    assert [r.out.term_months for r in got] == [12 if a <= 3000 else 24 for a in OFFERS[ml]]


def test_offer_limits_and_income_cap(make):
    df = make("k int, ml double, score double, income double", (0, None, 500.0, None), (1, 49.9, 500.0, None), (2, 80.0, None, 100.0),
              (3, 80.0, 500.0, 1000.0), (4, 80.0, 500.0, 0.0), (5, 80.0, 500.0, -5.0), (6, 59.9, 500.0, 333.33))
    got = [r.out for r in df.orderBy("k").select(offers.loan_offer(F.col("ml"), F.col("score"), F.col("income")).alias("out")).collect()]
    assert got[:3] == [None, None, None]
    assert (got[3].max_amount, got[3].monthly_payment, got[3].term_months) == (3000, 266.55, 12)
    assert [g.max_amount for g in got[4:]] == [7000, 7000, 999]


def test_reasons_in_order(make):
    df = make("age int, score double, ml double, loans_paid_count double, loans_overdue double, payment_success_rate double, "
              "total_overdue_interest double, loans_written_off double",
              (17, 450.0, 79.9, 0.0, 0.0, 0.5, 0.0, 0.0), (30, None, 80.0, 2.0, 1.0, 0.857, 12.345, 3.0),
              (None, 299.0, None, None, None, None, None, None))
    listed = df.select(reason_list(F.col("age"), F.col("score"), F.col("ml"), F.col).alias("out"))
    first, second, third = [[(x.type, x.text) for x in r] for r in out(listed)]
    assert first == [
        ("red", "Age 17 is below the minimum requirement of 18"), ("yellow", "AKB score 450.0 is acceptable but low"),
        ("yellow", "No loans paid back yet"), ("yellow", "Payment success rate: 50.0%"),
        ("yellow", "ML model confidence: 79.9% — moderate risk")]
    assert second == [
        ("green", "Age 30 meets the minimum requirement"), ("red", "No AKB credit score found"),
        ("green", "2 loan(s) fully paid back"), ("red", "1 overdue loan(s) on record"),
        ("green", "Payment success rate: 85.7%"), ("red", f"Total overdue interest: {round(12.345, 2)} AZN"),
        ("red", "3 loan(s) written off"), ("green", "ML model confidence: 80.0% — very low risk")]
    assert third == [("red", "AKB score 299.0 is below the minimum of 300")]


def test_labels(make):
    df = make("loans_paid int, loans_overdue int, failed_payments_30plus int, loans_written_off int",
              (1, 0, 0, 0), (1, None, None, None), (0, 0, 0, 0), (1, 1, 0, 0), (1, 0, 1, 0), (1, 0, 0, 1), (None, None, None, None))
    got = df.select(labels.target(1).alias("v1"), labels.target(2).alias("v2"), labels.target(3).alias("v3"), labels.borrower_label().alias("label")).collect()
    assert [tuple(r) for r in got] == [
        (1, 1, 1, "good"), (1, 1, 1, "good"), (0, 0, 0, "unknown"), (0, 0, 0, "bad"), (1, 0, 0, "good"), (1, 1, 0, "good"), (0, 0, 0, "unknown")]


def test_feature_lists():
    assert [len(features.FEATURES[v]) for v in (1, 2, 3)] == [31, 51, 70]
    assert (len(features.COMPACT_22), len(features.COMPACT_25), len(decisions.BATCH_COLUMNS)) == (22, 25, 14)
    assert len(set(features.FEATURES_V3)) == 70


@pytest.fixture(scope="module")
def credit(spark):
    return features.CreditTables(**fixtures.views(spark, "/root/testdata/sf0.001", *features.CreditTables.__dataclass_fields__))


def by_user(df):
    return {r.user_id: r.asDict() for r in df.collect()}


def test_policies_agree_where_nothing_is_missing(credit):
    batch = by_user(features.build_features(credit, NOW))
    online = by_user(features.build_features(credit, NOW, null_policy="online"))
    divided = {"debt_to_income": "income_total", "loan_amount_to_income": "income_total", "approval_rate": "times_in_review"}
    compared = 0
    for user, row in batch.items():
        for f in features.FEATURES_V3:
            if row[f] is not None and (f not in divided or (row[divided[f]] or 0) >= 1):
                assert online[user][f] == row[f], (user, f)
                compared += 1
    assert set(batch) == set(online) and compared > 50 * len(batch)


def test_one_row_per_user_online_even_with_several_questionnaires(spark, credit):
    twice = credit.questionnaires.unionByName(credit.questionnaires.withColumn("id", F.col("id") + 1_000_000))
    doubled = features.CreditTables(**{**credit.__dict__, "questionnaires": twice})
    users = credit.users.count()
    assert features.online_features(doubled, NOW).count() == users
    answered = credit.users.join(credit.questionnaires.select(F.col("user_id").alias("id")), "id", "left_semi").count()
    assert features.build_features(doubled, NOW).count() == users + answered


def test_features_of_some_users_equal_those_of_all(credit):
    some = credit.users.select(F.col("id").alias("user_id")).where("user_id IN ('3', '7', '12')")
    few, every = by_user(features.online_features(credit, NOW, some)), by_user(features.online_features(credit, NOW))
    assert few == {u: every[u] for u in ("3", "7", "12")}


def test_missing_table_rows_by_policy(make, credit):
    nobody = {name: getattr(credit, name).where("false") for name in features.CreditTables.__dataclass_fields__ if name != "users"}
    empty = features.CreditTables(users=credit.users, **nobody)
    batch = features.model_matrix(features.build_features(empty, NOW)).first()
    assert batch.total_loans == batch.payment_success_rate == batch.age == -999.0
    assert (batch.marital_status, batch.net_income, batch.debt_to_income, batch.is_pep) == (-1.0, 0.0, 0.0, 0.0)
    online = features.model_matrix(features.online_features(empty, NOW)).first()
    assert (online.total_loans, online.total_cards, online.overdue_interest_to_debt, online.delayed_payment_rate) == (0, 0, 0, 0)
    assert online.payment_success_rate == online.avg_loan_term == online.liab_count == -999.0


def test_duplicate_application_gets_no_decision(make):
    t = datetime(2024, 1, 30)
    schema = ("name string, surname string, date_of_birth string, residency string, akb_score double, akb_letter_grade string, "
              "user_id string, monthly_income double, monthly_expenses double, outstanding_debt double, overdue_amount double, "
              "has_overdue boolean, submitted_at timestamp_ntz")
    new = lambda name: (name, "Lee", "15/03/1990", "", 700.0, "C", None, 1000.0, 0.0, 0.0, 0.0, False, t)
    stored = make("id int, name string, surname string, date_of_birth string, akb_score double, submitted_at timestamp_ntz",
                  (4, "ann", "lee", "15/03/1990", 500.0, t - timedelta(hours=1)))
    got = {r.name: r for r in decisions.decide_applications(make(schema, new("ANN"), new("Bob")), stored, NOW).collect()}
    ann, bob = got["ANN"], got["Bob"]
    assert (ann.already_exists, ann.existing_user_id, ann.decision, ann.ml_score, ann.reasons, ann.fraud_flags) == (True, "4", None, None, None, None)
    assert (bob.already_exists, bob.decision, bob.decision_type, bob.ml_score) == (
        False, "APPROVED", rules.BY_MODEL, points(33, 700.0, 1000.0, 0.0, 0.0, 0.0, False))
    assert bob.loan_recommendation.max_amount == 11000
    checked = {r.name: r for r in decisions.precheck(make(schema, new("ANN"), new("Bob")), NOW, stored).collect()}
    assert (checked["ANN"].existing_user_id, checked["ANN"].decision) == ("4", None)
    assert (checked["Bob"].hard_rejected, checked["Bob"].decision) == (False, rules.PASSED)
    free = decisions.decide_applications(make(schema, new("Bob")), stored, NOW, apply_income_cap=True).first()
    assert free.loan_recommendation.max_amount == 3000  # capped at three incomes
    record = decisions.submission_record(decisions.decide_stateless(make(schema, new("Bob")), NOW)).first()
    assert record.residency == "N/A" and record.submitted_at == "2024-01-30 00:00:00" and len(record.user_id) == 32


def test_submissions_are_routed_and_stored_once(spark, make, credit):
    t = datetime(2024, 1, 30)
    schema = ("application_id int, customer_type string, name string, surname string, date_of_birth string, residency string, "
              "akb_score double, akb_letter_grade string, user_id string, monthly_income double, monthly_expenses double, "
              "outstanding_debt double, overdue_amount double, has_overdue boolean, submitted_at timestamp_ntz")

    def sent(i, kind, name, surname="Lee", user=None):
        return (i, kind, name, surname, "15/03/1990", "", 700.0, "C", user, 1000.0, 0.0, 0.0, 0.0, False, t + timedelta(minutes=i))

    batch = make(schema, sent(1, "new", "Bob"), sent(2, "new", "BOB"), sent(3, "new", "Ann"), sent(4, "new", "Eve", None),
                 sent(5, "new", "Eve", None), sent(6, "existing", "Bob", user="3"), sent(7, "existing", "Bob"))
    stored = make("id int, name string, surname string, date_of_birth string, akb_score double, submitted_at timestamp_ntz",
                  (4, "ann", "lee", "15/03/1990", 500.0, t - timedelta(hours=1)))
    path = fresh_path(spark, "submit")
    answers = jobs.submit(batch, credit, stored, None, NOW, f"{path}/report", f"{path}/stored")
    got = {r.application_id: r for r in answers.collect()}
    assert {i: r.existing_user_id for i, r in got.items() if r.already_exists} == {2: "1", 3: "4"}
    assert got[2].decision is None and got[1].recent_count == 1 and got[4].decision == got[5].decision == "APPROVED"
    # Customer 3 has loans, so the type names the model, as in the source, though there is none here.
    assert (got[6].decision, got[6].decision_type) == (rules.APPROVED, rules.BY_MODEL) and got[7].decision_error.startswith("User ID is required")
    names = lambda folder: sorted(r.name for r in spark.read.parquet(f"{path}/{folder}").collect())
    assert names("stored") == ["Bob", "Eve", "Eve"] and names("report") == ["Bob", "Bob", "Eve", "Eve"]


def test_a_customer_without_a_prediction_is_left_to_the_rules(make):
    """One customer at a time: approved by the rules, though the model knows others. In batch scoring: no decision."""
    users = make("id string", ("a",), ("b",))
    answers = make("user_id string, birth_date date", ("a", date(1990, 1, 1)), ("b", date(1990, 1, 1)))
    scores = make("id string, user_id string, timestamp timestamp_ntz, is_successful boolean, response_borrower_status string, "
                  "response_score_calculated smallint, response_score_point decimal(8,2), response_score_response string, "
                  "response_score_exclusion smallint, response_borrower_participant_of_patriotic_war smallint",
                  *[(u, u, datetime(2024, 1, 1), True, "active", 1, Decimal(700), "C", None, None) for u in "ab"])
    known = make("user_id string, probability double, prediction int", ("a", 0.2, 0))
    got = {r.user_id: (r.decision, r.decision_type) for r in decisions.decide_all(users, answers, scores, known, NOW).collect()}
    assert got == {"a": (rules.HIGH_RISK, rules.BY_MODEL), "b": (rules.APPROVED, rules.BY_RULES)}
    stored = make("user_id string, age double, akb_score double, akb_grade string, loans_paid_count long, total_loans long, successful_payments long, "
                  "failed_payments long, payment_success_rate double, total_overdue_interest double, probability double, prediction int",
                  ("b", 34.0, 700.0, "C", 1, 1, 1, 0, 1.0, 0.0, None, None))
    assert [r.decision for r in decisions.score_all(stored, known.where("false"), NOW).collect()] != [rules.APPROVED]


def test_older_pass_label(make):
    df = make("date_of_birth string, akb_score double", ("15/03/1990", 700.0))
    assert decisions.apply_hard_rules(df, NOW, passed="APPROVED").first().hard_decision == "APPROVED"


def test_jobs_end_to_end(spark, credit):
    quick = model.Training(trees=2, depth=2)
    path = fresh_path(spark, "jobs")
    customers = credit.users.count()
    fitted, report = jobs.train_model(credit, NOW, f"{path}/model", quick)
    assert {r.slice for r in report.collect()} == {"test", "train", "all"}
    assert jobs.build_customer_features(credit, NOW, f"{path}/features").first().rows == customers
    scored = jobs.score_customers(credit, fitted, NOW, f"{path}/decisions").first()
    assert scored.total == customers == scored.approved + scored.rejected
    exported = jobs.export_all(credit, fitted, NOW, f"{path}/export").first()
    assert exported.total == customers == spark.read.parquet(f"{path}/export").count()
    stored = spark.read.parquet(f"{path}/features")
    assert stored.columns == features.COMPACT_22
    shown = jobs.analytics(fixtures.view(spark, "/root/testdata/sf0.001", "customer_submissions"), NOW)
    assert set(shown) == {"daily", "rejection_reasons", "akb_distribution", "stats"}
