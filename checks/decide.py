"""Checks of rules, scorecard, decisions, flags, offers and reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from checks.parts import PARTS, age_sql, flags_sql, offer_sql, py_round, r6, reasons_sql
from checks.registry import check
from checks.relational import batch_decisions
from loanloom.fixtures import AS_OF
from loanloom.operators import joins, latest, velocity
from loanloom.plans import decisions, features, labels, offers, rules


def reasons_text(column: str = "reasons"):
    return F.array_join(F.transform(column, lambda r: F.concat(r["type"], F.lit(": "), r["text"])), " | ")


def offer_columns(column: str = "loan_recommendation"):
    return [F.col(f"{column}.{c}").alias(c) for c in ("max_amount", "interest_rate", "term_months", "monthly_payment")]


OFFER = f"max_amount, interest_rate, term_months, {r6('monthly_payment')}"


@check(f"SELECT user_id, age, {r6('akb_score')}, hard_decision FROM ruled")
def d1_hard_rules(t):
    known = joins.score_lookup(t.users.select(F.col("id").alias("user_id")), t.akb_scores)
    people = joins.fan_out_left_join(known, t.questionnaires.select("user_id", "birth_date"), "user_id")
    return decisions.apply_hard_rules(people, AS_OF).select("user_id", "age", "akb_score", "hard_decision")


def _rows(t) -> DataFrame:
    return features.with_derived(features.assembled_reduced(t.credit), AS_OF)


@check("""SELECT user_id, CASE WHEN age < 18 THEN 'REJECTED — Age is below 18'
          WHEN akb_score IS NULL OR akb_score < 300 THEN 'REJECTED — AKB Score too low' END AS decision FROM feat""")
def d2_batch_rules(t):
    return _rows(t).select("user_id", rules.hard_rules_batch(F.col("age"), F.col("akb_score")).alias("decision"))


@check(f"""SELECT f.user_id, CASE WHEN akb_score < 300 THEN 'REJECTED — AKB Score too low'
             WHEN prediction = 1 THEN 'APPROVED' ELSE 'REJECTED — High credit risk' END AS decision,
             {r6('CASE WHEN akb_score < 300 THEN NULL ELSE round_even(probability * 100, 1) END', 'ml_probability')},
             CASE WHEN coalesce(loans_overdue, 0) > 0 THEN 'bad' WHEN coalesce(loans_paid, 0) > 0 THEN 'good'
               ELSE 'unknown' END AS borrower_label, CAST(NULL AS DOUBLE) AS age
           FROM feat f JOIN predictions p ON p.user_id = f.user_id""")
def d3_feature_table_rules(t):
    stored = features.customer_features(t.credit, AS_OF)
    scored = decisions.score_all(stored, t.predictions, AS_OF, variant="feature_table")
    return scored.select("user_id", "decision", "ml_probability", "borrower_label", "age")


GOOD = "coalesce(loans_paid, 0) > 0 AND coalesce(loans_overdue, 0) = 0"


@check(f"SELECT user_id, CASE WHEN {GOOD} THEN 1 ELSE 0 END AS target FROM feat")
def d4_target_v1(t):
    return _rows(t).select("user_id", labels.target(1).alias("target"))


@check(f"""SELECT user_id, CASE WHEN {GOOD} AND coalesce(failed_payments_30plus, 0) = 0 THEN 1 ELSE 0 END AS target_v2,
           target AS target_v3 FROM feat""")
def d5_target_v2_v3(t):
    return _rows(t).select("user_id", labels.target(2).alias("target_v2"), labels.target(3).alias("target_v3"))


@check("""SELECT user_id, CASE WHEN coalesce(loans_overdue, 0) > 0 THEN 'bad' WHEN coalesce(loans_paid, 0) > 0
          THEN 'good' ELSE 'unknown' END AS borrower_label FROM feat""")
def d6_borrower_label(t):
    return _rows(t).select("user_id", labels.borrower_label().alias("borrower_label"))


def _by_scorecard(key: str, table: str) -> str:
    return f"""SELECT {key}, years AS age, {r6('ml_score')}, CASE WHEN hard_decision <> 'PASSED' THEN hard_decision
        WHEN ml_score >= 50 THEN 'APPROVED' ELSE 'REJECTED — High credit risk' END AS decision,
        CASE WHEN hard_decision <> 'PASSED' THEN 'Hard Rules' ELSE 'XGBoost ML Model' END AS decision_type FROM {table}"""


@check(_by_scorecard("id", "scored_submissions"))
def d7_scorecard(t):
    scored = decisions.scorecard_decisions(t.customer_submissions.drop("age", "decision", "decision_type"), AS_OF)
    return scored.select("id", "age", "ml_score", "decision", "decision_type")


@check(f"""SELECT user_id, {r6(py_round('probability * 100', 1), 'ml_score')},
           CASE WHEN probability >= 0.5 THEN 'APPROVED' ELSE 'REJECTED — High credit risk' END AS decision,
           CASE WHEN prediction = 1 THEN 'APPROVED' ELSE 'REJECTED — High credit risk' END AS class_decision
           FROM predictions""")
def d8_model_decision(t):
    p = F.col("probability")
    return t.predictions.select(
        "user_id", rules.model_percent(p).alias("ml_score"), rules.model_decision(p).alias("decision"),
        rules.class_decision(F.col("prediction")).alias("class_decision"))


PARTS["existing_checked"] = f"""
    SELECT *, CASE WHEN birth IS NULL THEN 'REJECTED — No birth date found' WHEN years < 18 THEN 'REJECTED — Age is below 18'
        WHEN app_score IS NULL THEN 'REJECTED — AKB Score is empty' WHEN app_score < 300 THEN 'REJECTED — AKB Score too low'
        ELSE 'PASSED' END AS hard_decision
    FROM (SELECT *, {age_sql('birth')} AS years FROM (
        SELECT a.application_id, a.akb_score AS app_score, a.user_id AS applicant, p.probability, f.*,
          coalesce(b.stored_birth_date, CAST(try_strptime(a.date_of_birth, '%d/%m/%Y') AS DATE)) AS birth,
          CASE WHEN a.user_id IS NULL THEN 'User ID is required for existing customers'
            WHEN coalesce(b.stored_birth_date, CAST(try_strptime(a.date_of_birth, '%d/%m/%Y') AS DATE)) IS NULL
            THEN 'Date of birth required — user not found in database' END AS decision_error
        FROM applications a LEFT JOIN birth_dates b ON b.user_id = a.user_id
        LEFT JOIN feat_online f ON f.user_id = a.user_id LEFT JOIN predictions p ON p.user_id = a.user_id
        WHERE a.customer_type = 'existing') x) y"""
PARTS["existing_decided"] = f"""
    SELECT *, CASE WHEN use_model THEN {py_round('probability * 100', 1)} END AS ml_score,
      CASE WHEN hard_decision <> 'PASSED' THEN hard_decision WHEN use_model AND probability < 0.5
        THEN 'REJECTED — High credit risk' ELSE 'APPROVED' END AS decision,
      CASE WHEN use_model THEN 'XGBoost ML Model' ELSE 'Hard Rules' END AS decision_type
    FROM (SELECT *, hard_decision = 'PASSED' AND coalesce(total_loans, 0) > 0 AS use_model FROM existing_checked) z"""
PARTS["existing_offers"] = offer_sql(
    """(SELECT *, CASE WHEN decision_error IS NULL AND decision = 'APPROVED'
        THEN coalesce(nullif(ml_score, 0), 55) END AS offered_score FROM existing_decided) e""",
    "offered_score", "app_score", "monthly_income", "application_id AS offer_id")


@check(f"""SELECT application_id, decision_error, CASE WHEN decision_error IS NULL THEN years END AS age,
             CASE WHEN decision_error IS NULL THEN decision END AS decision,
             CASE WHEN decision_error IS NULL THEN decision_type END AS decision_type,
             {r6('CASE WHEN decision_error IS NULL THEN ml_score END', 'ml_score')},
             CASE WHEN decision_error IS NULL THEN {reasons_sql('years', 'app_score', 'ml_score', features=True)} END AS reasons,
             {OFFER}
           FROM existing_decided JOIN existing_offers ON offer_id = application_id""")
def d9_existing_customers(t):
    existing = t.applications.where(F.col("customer_type") == "existing")
    asked = existing.where("user_id IS NOT NULL").select("user_id").distinct()
    known = features.online_features(t.credit, AS_OF, user_ids=asked)
    decided = decisions.decide_existing(existing, t.users, t.questionnaires, known, t.predictions, AS_OF)
    return decided.select(
        "application_id", "decision_error", "age", "decision", "decision_type", "ml_score",
        reasons_text().alias("reasons"), *offer_columns())


DECIDED = f"""SELECT user_id, CAST(birth_date AS VARCHAR) AS date_of_birth, age, {r6('akb_score')}, akb_grade,
    CASE WHEN hard_decision <> 'PASSED' THEN hard_decision WHEN probability < 0.5 THEN 'REJECTED — High credit risk'
      ELSE 'APPROVED' END AS decision,
    CASE WHEN hard_decision = 'PASSED' AND probability IS NOT NULL THEN 'XGBoost ML Model' ELSE 'Hard Rules' END AS decision_type,
    {r6(f"CASE WHEN hard_decision = 'PASSED' THEN {py_round('probability * 100', 1)} END", 'ml_score')}
    FROM ruled LEFT JOIN (SELECT user_id, probability FROM predictions) USING (user_id)"""


@check(DECIDED + " WHERE user_id IN (SELECT user_id FROM payments WHERE is_successful = FALSE)")
def d10_check_customers(t):
    wanted = t.payments.where(~F.col("is_successful")).select("user_id").distinct()
    users = t.users.join(wanted.withColumnRenamed("user_id", "id"), "id", "left_semi")
    scores = t.akb_scores.join(wanted, "user_id", "left_semi")
    return decisions.decide_all(users, t.questionnaires, scores, t.predictions, AS_OF)


@check(f"""SELECT user_id, age, {r6('akb_score')}, akb_grade, loans_paid_count, total_loans, successful_payments,
           failed_payments, {r6('payment_success_rate')}, {r6('total_overdue_interest')}, {r6('ml_probability')},
           decision, decision_type, TIMESTAMP '2024-01-31 00:00:00' AS created_at FROM batch_decisions""")
def d11_batch_decisions(t):
    return batch_decisions(t)


def _named(t) -> DataFrame:
    # Applicants give part of a login as their name, in capitals.
    name = F.when(F.col("application_id") % 2 == 0, F.concat(F.lit("CUSTOMER#0000"), F.lpad(F.col("application_id").cast("string"), 5, "0")))
    login = name.otherwise(F.concat(F.lit("MER#"), F.lpad((F.col("application_id") / 10).cast("bigint").cast("string"), 8, "0")))
    return t.applications.withColumn("name", login)


PARTS["named_applications"] = """
    SELECT * REPLACE (CASE WHEN application_id % 2 = 0 THEN concat('CUSTOMER#0000', lpad(CAST(application_id AS VARCHAR), 5, '0'))
      ELSE concat('MER#', lpad(CAST(application_id // 10 AS VARCHAR), 8, '0')) END AS name) FROM applications"""
PARTS["named_matched"] = f"""
    SELECT a.*, m.matched, {age_sql('a.birth')} AS years, p.probability
    FROM (SELECT *, CAST(try_strptime(date_of_birth, '%d/%m/%Y') AS DATE) AS birth FROM named_applications) a
    LEFT JOIN (SELECT n.application_id, min(u.id) AS matched FROM named_applications n
               JOIN users u ON contains(u.login, lower(n.name)) GROUP BY 1) m ON m.application_id = a.application_id
    LEFT JOIN predictions p ON p.user_id = m.matched"""


@check(f"""SELECT application_id, matched AS user_id, decision,
             CASE WHEN decision IN ('APPROVED', 'REJECTED — High credit risk') AND probability IS NOT NULL
               THEN 'XGBoost ML Model' ELSE 'Hard Rules' END AS decision_type,
             {r6(f"CASE WHEN decision IN ('APPROVED', 'REJECTED — High credit risk') THEN {py_round('probability * 100', 1)} END", 'ml_score')}
           FROM (SELECT *, CASE WHEN birth IS NULL THEN 'REJECTED — No birth date found'
               WHEN years < 18 THEN 'REJECTED — Age is below 18' WHEN akb_score IS NULL THEN 'REJECTED — AKB Score is empty'
               WHEN akb_score < 300 THEN 'REJECTED — AKB Score too low' WHEN probability < 0.5
               THEN 'REJECTED — High credit risk' ELSE 'APPROVED' END AS decision FROM named_matched) d""")
def d12_decision_by_name(t):
    stored = t.users.select(F.col("id").alias("user_id"))
    decided = decisions.decide_by_name(_named(t), t.users, stored, t.predictions, AS_OF)
    return decided.select("application_id", "user_id", "decision", "decision_type", "ml_score")


@check(f"""SELECT application_id, hard_decision <> 'PASSED' AS hard_rejected, hard_decision AS decision, years AS age,
           CASE WHEN hard_decision <> 'PASSED' THEN 'Hard Rules' END AS decision_type,
           CASE WHEN hard_decision <> 'PASSED' THEN {reasons_sql('years', 'akb_score', None)} END AS reasons
           FROM scored_applications""")
def d13_precheck(t):
    return decisions.precheck(t.applications, AS_OF).select(
        "application_id", "hard_rejected", "decision", "age", "decision_type", reasons_text().alias("reasons"))


@check(f"""SELECT s.id, recent_count, {flags_sql('s.akb_score')} AS fraud_flags
           FROM customer_submissions s JOIN recent_submissions_24h r ON r.id = s.id""")
def d14_fraud_flags(t):
    flagged = velocity.fraud_flags(t.customer_submissions, t.customer_submissions)
    return flagged.select("id", "recent_count", F.array_join("fraud_flags", " | ").alias("fraud_flags"))


PARTS["offer_inputs"] = f"""SELECT p.user_id, {py_round('p.probability * 100', 1)} AS ml, k.akb_score AS score,
    q.monthly_income AS income FROM predictions p LEFT JOIN newest_score k ON k.user_id = p.user_id
    LEFT JOIN people q ON q.user_id = p.user_id"""
PARTS["capped_offers"] = offer_sql("offer_inputs", "ml", "score", "income", "user_id")
PARTS["free_offers"] = offer_sql("offer_inputs", "ml", "score", None, "user_id")


@check(f"""SELECT c.user_id, c.max_amount, c.interest_rate, c.term_months, round(c.monthly_payment, 6) AS monthly_payment,
           f.max_amount AS uncapped FROM capped_offers c JOIN free_offers f ON f.user_id = c.user_id""")
def d15_loan_offers(t):
    scores = latest.latest_score(t.akb_scores, ["akb_score"], with_count=False)
    incomes = t.questionnaires.select("user_id", "monthly_income")
    rows = joins.assemble(t.predictions, scores, incomes).withColumn("ml", rules.model_percent(F.col("probability")))
    ml, score = F.col("ml"), F.col("akb_score").cast("double")
    offered = rows.select(
        "user_id", offers.loan_offer(ml, score, F.col("monthly_income")).alias("loan_recommendation"),
        offers.loan_offer(ml, score)["max_amount"].alias("uncapped"))
    return offered.select("user_id", "uncapped", *offer_columns())


@check(f"""SELECT f.user_id, {reasons_sql('age', 'akb_score', 'ml', features=True)} AS reasons
           FROM (SELECT *, {py_round('probability * 100', 1)} AS ml FROM feat_online JOIN (SELECT user_id, probability FROM predictions)
             USING (user_id)) f""")
def d16_reasons(t):
    from loanloom.plans.reasons import reason_list

    rows = features.online_features(t.credit, AS_OF).join(t.predictions.drop("target"), "user_id")
    listed = reason_list(F.col("age").cast("int"), F.col("akb_score"), rules.model_percent(F.col("probability")), F.col)
    return rows.select("user_id", listed.alias("reasons")).select("user_id", reasons_text().alias("reasons"))


PARTS["new_decided"] = f"""
    SELECT m.*, m.existing_id IS NOT NULL AS already_exists, s.age AS years, s.ml_score, s.decision, s.decision_type, s.reasons
    FROM matched_applications m JOIN (SELECT application_id, years AS age, ml_score,
        CASE WHEN hard_decision <> 'PASSED' THEN hard_decision WHEN ml_score >= 50 THEN 'APPROVED'
          ELSE 'REJECTED — High credit risk' END AS decision,
        CASE WHEN hard_decision <> 'PASSED' THEN 'Hard Rules' ELSE 'XGBoost ML Model' END AS decision_type,
        {reasons_sql('years', 'akb_score', 'ml_score')} AS reasons FROM scored_applications) s
      ON s.application_id = m.application_id"""
NEW_ID = "coalesce(user_id, md5(concat(coalesce(name, ''), '|', coalesce(surname, ''), '|', coalesce(date_of_birth, ''))))"


@check(f"""SELECT application_id, coalesce(nullif(name, ''), 'N/A') AS name, coalesce(surname, 'N/A') AS surname,
           coalesce(date_of_birth, 'N/A') AS date_of_birth, residency, years AS age, {r6('akb_score')}, akb_letter_grade,
           decision, decision_type, {r6('ml_score')}, {NEW_ID} AS user_id,
           strftime(submitted_at, '%Y-%m-%d %H:%M:%S') AS submitted_at FROM new_decided""")
def d17_submission_record(t):
    decided = decisions.decide_stateless(t.applications, AS_OF)
    record = decisions.submission_record(decided)
    # The record itself has no application id: names here are unique, so they give it back.
    return record.withColumn("application_id", F.regexp_extract("name", r"NAME(\d+)", 1).cast("bigint"))


@check(DECIDED)
def d18_decide_all(t):
    return decisions.decide_all(t.users, t.questionnaires, t.akb_scores, t.predictions, AS_OF)


PARTS["new_offers"] = offer_sql(
    "(SELECT *, CASE WHEN NOT already_exists AND decision = 'APPROVED' THEN coalesce(nullif(ml_score, 0), 55) END AS offered FROM new_decided) e",
    "offered", "akb_score", None, "application_id AS offer_id")


def _fresh(column: str) -> str:
    return f"CASE WHEN NOT already_exists THEN {column} END"


@check(f"""SELECT n.application_id, already_exists, CAST(existing_id AS VARCHAR) AS existing_user_id, {_fresh('years')} AS age,
             {_fresh('decision')} AS decision, {r6(_fresh('ml_score'), 'ml_score')}, {_fresh('reasons')} AS reasons,
             {_fresh(flags_sql('n.akb_score'))} AS fraud_flags, {OFFER}
           FROM new_decided n JOIN new_offers ON offer_id = n.application_id
           JOIN recent_for_applications r ON r.application_id = n.application_id""")
def d19_decide_applications(t):
    decided = decisions.decide_applications(t.applications, t.customer_submissions, AS_OF)
    return decided.select(
        "application_id", "already_exists", "existing_user_id", "age", "decision", "ml_score",
        reasons_text().alias("reasons"), F.array_join("fraud_flags", " | ").alias("fraud_flags"), *offer_columns())


PARTS["new_answers"] = f"""
    SELECT n.application_id, 'new' AS customer_type, already_exists, CAST(existing_id AS VARCHAR) AS existing_user_id,
      CAST(NULL AS VARCHAR) AS decision_error, {_fresh('years')} AS age, {_fresh('decision')} AS decision,
      {_fresh('decision_type')} AS decision_type, {r6(_fresh('ml_score'), 'ml_score')}, {_fresh('reasons')} AS reasons, {OFFER},
      CASE WHEN NOT already_exists THEN '' END AS fraud_flags,
      name IS NOT NULL AND surname IS NOT NULL AND date_of_birth IS NOT NULL AS identified
    FROM new_decided n JOIN new_offers ON offer_id = n.application_id WHERE n.customer_type = 'new'"""
PARTS["existing_answers"] = f"""
    SELECT application_id, 'existing' AS customer_type, FALSE AS already_exists, CAST(NULL AS VARCHAR) AS existing_user_id,
      decision_error, CASE WHEN decision_error IS NULL THEN years END AS age,
      CASE WHEN decision_error IS NULL THEN decision END AS decision,
      CASE WHEN decision_error IS NULL THEN decision_type END AS decision_type,
      {r6('CASE WHEN decision_error IS NULL THEN ml_score END', 'ml_score')},
      CASE WHEN decision_error IS NULL THEN {reasons_sql('years', 'app_score', 'ml_score', features=True)} END AS reasons,
      {OFFER}, '' AS fraud_flags, FALSE AS identified
    FROM existing_decided JOIN existing_offers ON offer_id = application_id"""
PARTS["answers"] = "SELECT * FROM new_answers UNION ALL SELECT * FROM existing_answers"
BLANKED = "age decision decision_type ml_score reasons max_amount interest_rate term_months monthly_payment fraud_flags".split()
SENT_AGAIN = 10_000_000


# Every tenth application comes twice: the second of a new applicant whose identity is known is a duplicate.
@check(f"""SELECT * EXCLUDE (identified) FROM answers UNION ALL
           SELECT * EXCLUDE (identified) REPLACE (application_id + {SENT_AGAIN} AS application_id, already_exists OR identified AS already_exists,
             CASE WHEN identified THEN coalesce(existing_user_id, CAST(application_id AS VARCHAR)) END AS existing_user_id,
             {', '.join(f'CASE WHEN NOT identified THEN {c} END AS {c}' for c in BLANKED)})
           FROM answers WHERE application_id % 10 = 0""")
def submit_decided_by_type(t):
    again = t.applications.where("application_id % 10 = 0").withColumns({
        "application_id": F.col("application_id") + SENT_AGAIN, "submitted_at": F.expr("submitted_at + INTERVAL 1 MINUTE")})
    sent = t.applications.unionByName(again)
    asked = sent.where("customer_type = 'existing' AND user_id IS NOT NULL").select("user_id").distinct()
    known = features.online_features(t.credit, AS_OF, user_ids=asked)
    decided = decisions.decide_submissions(
        sent, t.customer_submissions, t.users, t.questionnaires, known, t.predictions, AS_OF)
    return decided.select(
        "application_id", "customer_type", "already_exists", "existing_user_id", "decision_error", "age", "decision",
        "decision_type", "ml_score", reasons_text().alias("reasons"), F.array_join("fraud_flags", " | ").alias("fraud_flags"),
        *offer_columns())
