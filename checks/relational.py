"""Checks of joins, aggregates, latest records, top lists and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from checks.parts import AS_OF as NOW, PARTS, r6
from checks.registry import check
from loanloom.fixtures import AS_OF
from loanloom.operators import aggregates, joins, latest, metrics, ranking, reports, velocity
from loanloom.plans import decisions, features
from loanloom.session import materialise

GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def columns_of(names: str, rounded: str = "") -> str:
    return ", ".join(names.split() + [r6(c) for c in rounded.split()])


# --- joins -----------------------------------------------------------------------------------

PROFILE = "user_id loans_paid locale sex birth_date marital_status citizenship registration_region is_pep is_beneficial_owner is_related_to_pep"
INCOMES = "monthly_income monthly_expenses additional_income"
LOANS = "total_loans total_amount_borrowed max_loan_amount min_loan_amount loans_paid_count loans_overdue loans_active loans_written_off"
LOANS_R = "avg_loan_amount avg_loan_term days_between_first_last_loan"
ACTIONS = "times_approved times_in_review times_paid_action times_written_off times_active"
STATES = "delayed_payments failed_payments_30plus max_delay_days"
STATES_R = "avg_delay_days total_overdue_interest total_debt_accumulated"
PAYMENTS = "total_payments successful_payments failed_payments num_cards_used"
PAYMENTS_R = "total_paid avg_payment_amount max_payment_amount"
CARDS = "total_cards verified_cards has_main_card has_disbursement_card deleted_cards"
SCORE = "akb_grade akb_calculated akb_exclusion borrower_status akb_check_count"
HISTORY = "liab_count max_days_overdue total_days_overdue"
HISTORY_R = "total_outstanding_debt total_outstanding_interest history_score credit_balance"
DOCS = "total_docs_uploaded loans_with_docs last_doc_uploaded"


def as_bigint(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


@check(f"SELECT {columns_of(PROFILE, INCOMES)} FROM people")
def j1_profile(t):
    wanted = PROFILE.split() + INCOMES.split()
    df = joins.profile(t.users, t.questionnaires, ["loans_paid", "locale"], features.QUESTIONNAIRE_COLUMNS)
    return df.select(*wanted)


@check("SELECT ls.id, ls.loan_id, l.user_id, ls.transaction_type FROM loan_states ls JOIN loans l ON l.id = ls.loan_id")
def j2_states_to_loans(t):
    return joins.states_to_loans(t.loan_states, t.loans).select("id", "loan_id", "user_id", "transaction_type")


WIDE = " ".join([PROFILE, LOANS, ACTIONS, STATES, PAYMENTS, CARDS, SCORE, HISTORY, DOCS])
WIDE_R = " ".join([INCOMES, LOANS_R, STATES_R, PAYMENTS_R, HISTORY_R, "akb_score"])


@check(f"SELECT {columns_of(WIDE, WIDE_R)} FROM wide")
def j3_full_assembly(t):
    return as_bigint(features.assembled(t.credit), "max_delay_days").select(*WIDE.split(), *WIDE_R.split())


REDUCED = " ".join([PROFILE, LOANS, STATES, PAYMENTS, SCORE, HISTORY])


@check(f"SELECT {columns_of(REDUCED, WIDE_R)} FROM wide")
def j4_reduced_assembly(t):
    return as_bigint(features.assembled_reduced(t.credit), "max_delay_days").select(*REDUCED.split(), *WIDE_R.split())


@check("""SELECT u.id AS user_id, u.loans_paid, l.loans_paid_count AS loans_paid_loan, l.total_loans
          FROM users u LEFT JOIN loan_totals l ON l.user_id = u.id""")
def j5_colliding_names(t):
    people = t.users.select(F.col("id").alias("user_id"), "loans_paid")
    loans = aggregates.loans_per_user(t.loans).select(
        "user_id", F.col("loans_paid_count").alias("loans_paid"), "total_loans")
    return joins.left_join_renaming(people, loans, "user_id", "_loan")


@check(f"""SELECT u.id AS user_id, {r6('akb_score')}, akb_grade FROM users u
           LEFT JOIN newest_score k ON k.user_id = u.id""")
def j6_score_lookup(t):
    return joins.score_lookup(t.users.select(F.col("id").alias("user_id")), t.akb_scores)


# A key set that comes from the data: customers with a failed payment.
FAILED = "SELECT DISTINCT user_id FROM payments WHERE is_successful = FALSE"


def failed_payers(t):
    return t.payments.where(~F.col("is_successful")).select("user_id").distinct()


@check(f"SELECT user_id, birth_date, {r6('akb_score')}, akb_grade FROM ruled WHERE user_id IN ({FAILED})")
def j7_customer_record(t):
    return joins.customer_record(t.users, t.questionnaires, t.akb_scores, failed_payers(t))


@check("SELECT application_id, existing_id FROM matched_applications")
def j8_duplicate_match(t):
    return joins.existing_applicants(t.applications, t.customer_submissions).select("application_id", "existing_id")


@check(f"SELECT application_id, recent_count, {r6('recent_low')}, {r6('recent_high')} FROM recent_for_applications")
def j9_identity_range(t):
    recent = velocity.trailing_activity(t.applications, t.customer_submissions)
    return recent.select("application_id", "recent_count", "recent_low", "recent_high")


PAIRED = """a.submitted_at >= b.submitted_at AND b.submitted_at > a.submitted_at - INTERVAL '24 hours'
    AND lower(b.surname) = coalesce(lower(a.surname), '') AND b.date_of_birth = coalesce(a.date_of_birth, '')"""


@check(f"""SELECT a.id, b.id AS matched_id, b.submitted_at AS matched_at, {r6('b.akb_score', 'matched_score')}
           FROM customer_submissions a JOIN customer_submissions b ON lower(b.name) = coalesce(lower(a.name), '') AND {PAIRED}""")
def j9_submission_pairs(t):
    return velocity.application_pairs(t.customer_submissions, t.customer_submissions, key="id", part_rows=50)


@check(f"""SELECT a.application_id, b.id AS matched_id, b.submitted_at AS matched_at, {r6('b.akb_score', 'matched_score')}
           FROM applications a JOIN customer_submissions b ON lower(b.name) = coalesce(lower(a.name), '') AND {PAIRED}""")
def j9_application_pairs(t):
    return velocity.application_pairs(t.applications, t.customer_submissions)


@check("""SELECT n.application_id, m.matched_user_id FROM (SELECT application_id, CASE WHEN application_id % 7 = 0 THEN substr(login, 5, 2)
              WHEN application_id % 7 = 1 THEN upper(substr(login, 3, 9)) WHEN application_id % 7 = 2 THEN 'nobody#' ELSE upper(login) END AS name
            FROM applications a JOIN users u ON CAST(u.id AS BIGINT) = a.application_id) n
          LEFT JOIN (SELECT application_id, min(id) AS matched_user_id FROM (
              SELECT application_id, CASE WHEN application_id % 7 = 0 THEN substr(login, 5, 2) WHEN application_id % 7 = 1 THEN substr(login, 3, 9)
                WHEN application_id % 7 = 2 THEN 'nobody#' ELSE login END AS part
              FROM applications a JOIN users u ON CAST(u.id AS BIGINT) = a.application_id) p
            JOIN users u ON contains(u.login, p.part) GROUP BY application_id) m ON m.application_id = n.application_id""")
def p6_login_index(t):
    """Parts of logins, short and long, some of nobody's, looked up in a stored index."""
    asked = t.applications.join(t.users, F.col("id").cast("bigint") == F.col("application_id")).select(
        "application_id", F.expr("CASE WHEN application_id % 7 = 0 THEN substr(login, 5, 2) WHEN application_id % 7 = 1 THEN upper(substr(login, 3, 9)) "
                                 "WHEN application_id % 7 = 2 THEN 'nobody#' ELSE upper(login) END").alias("name"))
    found = joins.users_by_index(materialise(joins.login_postings(t.users)), asked)
    return found.select("application_id", "matched_user_id")


@check("""SELECT application_id,
            coalesce(stored_birth_date, CAST(try_strptime(date_of_birth, '%d/%m/%Y') AS DATE)) AS birth_date,
            CASE WHEN a.user_id IS NULL THEN 'User ID is required for existing customers'
              WHEN coalesce(stored_birth_date, CAST(try_strptime(date_of_birth, '%d/%m/%Y') AS DATE)) IS NULL
              THEN 'Date of birth required — user not found in database' END AS decision_error
          FROM applications a LEFT JOIN birth_dates b ON b.user_id = a.user_id""")
def j10_birth_date_fallback(t):
    dated = joins.with_birth_date(t.applications, t.users, t.questionnaires)
    return dated.select("application_id", "birth_date", "decision_error")


# --- aggregates ------------------------------------------------------------------------------


@check(f"SELECT {columns_of('user_id ' + LOANS, LOANS_R)} FROM loan_totals")
def a1_loans_per_user(t):
    return aggregates.loans_per_user(t.loans)


@check(f"SELECT {columns_of('user_id ' + ACTIONS)} FROM action_totals")
def a2_actions_per_user(t):
    return aggregates.actions_per_user(t.loan_actions)


@check(f"SELECT {columns_of('user_id ' + STATES, STATES_R)} FROM state_totals")
def a3_states_per_user(t):
    return as_bigint(aggregates.states_per_user(t.loan_states, t.loans), "max_delay_days")


@check(f"SELECT {columns_of('user_id ' + PAYMENTS, PAYMENTS_R)} FROM payment_totals")
def a4_payments_per_user(t):
    return aggregates.payments_per_user(t.payments)


@check(f"SELECT {columns_of('user_id ' + CARDS)} FROM card_totals")
def a5_cards_per_user(t):
    return aggregates.cards_per_user(t.cards)


@check(f"SELECT {columns_of('user_id ' + DOCS)} FROM document_totals")
def a6_documents_per_user(t):
    return aggregates.documents_per_user(t.doc_front_all)


@check(f"""
    SELECT u.id AS user_id,
      (SELECT count(*) FROM loans x WHERE x.user_id = u.id) AS total_loans,
      (SELECT count(*) FROM payments x WHERE x.user_id = u.id) AS total_payments,
      (SELECT count(*) FILTER (WHERE is_successful) FROM payments x WHERE x.user_id = u.id HAVING count(*) > 0)
        AS successful_payments,
      (SELECT count(*) FROM cards x WHERE x.user_id = u.id) AS total_cards,
      (SELECT count(*) FROM doc_front_all x WHERE x.user_id = u.id) AS total_docs_uploaded,
      (SELECT count(DISTINCT loan_id) FROM doc_front_all x WHERE x.user_id = u.id) AS loans_with_docs,
      round((SELECT CAST(sum(amount) AS DOUBLE) FROM loans x WHERE x.user_id = u.id), 6) AS total_amount_borrowed
    FROM users u""")
def a7_totals_without_group(t):
    people = t.users.select(F.col("id").alias("user_id"))
    df = aggregates.totals_for_customers(people, t.loans, t.payments, t.cards, t.doc_front_all)
    return df.select("user_id", "total_loans", "total_payments", "successful_payments", "total_cards",
                     "total_docs_uploaded", "loans_with_docs", F.col("total_amount_borrowed").cast("double").alias("total_amount_borrowed"))


OUTCOMES = """count(*) AS total, count(*) FILTER (WHERE decision = 'APPROVED') AS approved,
    count(*) FILTER (WHERE decision <> 'APPROVED') AS rejected"""


@check(f"""SELECT CAST(submitted_at AS DATE) AS day, {OUTCOMES} FROM customer_submissions
           WHERE submitted_at > {NOW} - INTERVAL '14 days' GROUP BY 1""")
def a8_daily_submissions(t):
    return reports.daily_submissions(t.customer_submissions, AS_OF)


@check("""SELECT decision, count(*) AS cnt FROM customer_submissions WHERE decision <> 'APPROVED' GROUP BY decision""")
def a9_rejection_reasons(t):
    return reports.rejection_reasons(t.customer_submissions)


BANDS = """CASE WHEN akb_score < 200 THEN 'E (0-199)' WHEN akb_score < 600 THEN 'D (200-599)'
    WHEN akb_score < 750 THEN 'C (600-749)' WHEN akb_score < 825 THEN 'B (750-824)' ELSE 'A (825+)' END"""


@check(f"""SELECT {BANDS} AS grade_range, count(*) AS cnt FROM customer_submissions
           WHERE akb_score IS NOT NULL GROUP BY 1""")
def a10_score_distribution(t):
    return reports.score_distribution(t.customer_submissions)


@check(f"SELECT {OUTCOMES}, round(avg(akb_score), 1) AS avg_akb, round(avg(age), 1) AS avg_age FROM customer_submissions")
def a11_overall_stats(t):
    return reports.overall_stats(t.customer_submissions)


@check("SELECT target, count(*) AS rows FROM feat GROUP BY target")
def a12_target_distribution(t):
    return reports.label_distribution(features.build_features(t.credit, AS_OF))


DECIDED_ALL = """
    SELECT user_id, CASE WHEN hard_decision <> 'PASSED' THEN hard_decision WHEN probability >= 0.5 THEN 'APPROVED'
      WHEN probability IS NOT NULL THEN 'REJECTED — High credit risk' ELSE 'APPROVED' END AS decision
    FROM ruled r LEFT JOIN predictions p USING (user_id)"""


@check(f"SELECT {OUTCOMES} FROM ({DECIDED_ALL}) d")
def a13_run_summary(t):
    return reports.run_summary(decisions.decide_all(t.users, t.questionnaires, t.akb_scores, t.predictions, AS_OF))


@check(" UNION ALL ".join(f"SELECT '{g}' AS table_name, count(*) AS rows FROM {g}" for g in GIVEN))
def a14_row_counts(t):
    parts = [aggregates.row_count(t.sample(g)).select(F.lit(g).alias("table_name"), "rows") for g in GIVEN]
    return reduce(DataFrame.unionByName, parts)


CELLS = """count(*) FILTER (WHERE target = 0 AND prediction = 0) AS tn, count(*) FILTER (WHERE target = 0 AND prediction = 1) AS fp,
    count(*) FILTER (WHERE target = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE target = 1 AND prediction = 1) AS tp"""
SCORES = f"""{r6('(tp + tn) / (tp + tn + fp + fn)', 'accuracy')}, {r6('tp / (tp + fp)', 'precision')},
    {r6('tp / (tp + fn)', 'recall')}, {r6('2 * tp / (2 * tp + fp + fn)', 'f1')}"""


@check(f"SELECT {CELLS} FROM predictions")
def a15_confusion_matrix(t):
    return metrics.confusion_matrix(t.predictions)


@check(f"SELECT {SCORES} FROM (SELECT {CELLS} FROM predictions) c")
def a16_class_scores(t):
    return metrics.class_scores(t.predictions)


def _report_sql() -> str:
    p0, r0, f0 = "tn / (tn + fn)", "tn / (tn + fp)", "2 * tn / (2 * tn + fp + fn)"
    p1, r1, f1 = "tp / (tp + fp)", "tp / (tp + fn)", "2 * tp / (2 * tp + fp + fn)"
    n0, n1, n = "(tn + fp)", "(tp + fn)", "(tn + fp + fn + tp)"

    def row(label, p, r, f, support):
        return f"SELECT '{label}' AS label, {r6(p, 'precision')}, {r6(r, 'recall')}, {r6(f, 'f1')}, {support} AS support FROM cells"

    accuracy = f"(tp + tn) / {n}"
    macro = [f"(({a}) + ({b})) / 2" for a, b in ((p0, p1), (r0, r1), (f0, f1))]
    weighted = [f"(({a}) * {n0} + ({b}) * {n1}) / {n}" for a, b in ((p0, p1), (r0, r1), (f0, f1))]
    return " UNION ALL ".join([
        row("Bad Borrower", p0, r0, f0, n0), row("Good Borrower", p1, r1, f1, n1),
        row("accuracy", accuracy, accuracy, accuracy, n), row("macro avg", *macro, n), row("weighted avg", *weighted, n),
    ])


PARTS["cells"] = f"SELECT {CELLS} FROM predictions"


@check(_report_sql())
def a17_classification_report(t):
    return metrics.classification_report(t.predictions)


AUC = """SELECT {by} (sum(CASE WHEN target = 1 THEN r END) - {p} * ({p} + 1) / 2.0) / (CAST({p} AS DOUBLE) * {n}) AS auc
    FROM (SELECT *, rank() OVER ({over} ORDER BY probability)
            + (count(*) OVER ({tied} probability) - 1) / 2.0 AS r FROM {table}) ranked {group}"""


def _auc(table: str, by: str = "") -> str:
    p, n = "count(*) FILTER (WHERE target = 1)", "count(*) FILTER (WHERE target = 0)"
    return AUC.format(
        by=f"{by}," if by else "", p=p, n=n, table=table, group=f"GROUP BY {by}" if by else "",
        over=f"PARTITION BY {by}" if by else "", tied=f"PARTITION BY {by}," if by else "PARTITION BY")


@check(f"SELECT {r6('auc', 'roc_auc')} FROM ({_auc('predictions')}) a")
def a18_roc_auc(t):
    return metrics.roc_auc(t.predictions)


@check(f"""SELECT c.slice, tn, fp, fn, tp, {SCORES}, {r6('auc', 'roc_auc')}
           FROM (SELECT slice, {CELLS} FROM sliced GROUP BY slice) c JOIN ({_auc('sliced', 'slice')}) a ON a.slice = c.slice""")
def a19_report_on_slices(t):
    return metrics.evaluation(ranking.stratified_split(t.predictions, "target", "user_id"))


# A stand-in for a model's importances: the share of customers for whom a feature is filled and not 0.
PARTS["filled"] = "SELECT * FROM (SELECT {} FROM feat) UNPIVOT (n FOR feature IN ({}))".format(
    ", ".join(f"count(*) FILTER (WHERE {f} <> 0) AS {f}" for f in features.FEATURES_V3), ", ".join(features.FEATURES_V3))
PARTS["importances"] = "SELECT feature, CAST(n AS DOUBLE) / (SELECT CAST(sum(n) AS DOUBLE) FROM filled) AS importance FROM filled"


def stand_in_importances(t) -> DataFrame:
    df = features.build_features(t.credit, AS_OF)
    counts = df.agg(*[F.count_if(F.col(f) != 0).alias(f) for f in features.FEATURES_V3])
    rows = counts.unpivot([], features.FEATURES_V3, "feature", "n")
    # One row per feature reaches the window.
    total = F.sum("n").over(Window.partitionBy())
    return rows.select("feature", (F.col("n").cast("double") / total.cast("double")).alias("importance"))


def _groups(groups: dict[str, str]) -> str:
    cases = " ".join(
        "WHEN feature IN ({}) THEN '{}'".format(", ".join(f"'{m}'" for m in members.split()), name)
        for name, members in groups.items())
    return f"""SELECT feature_group, {r6('sum(importance)', 'share')}
        FROM (SELECT CASE {cases} END AS feature_group, importance FROM importances) g
        WHERE feature_group IS NOT NULL GROUP BY feature_group"""


@check(_groups(metrics.GROUPS_V3))
def a20_importance_by_group(t):
    return metrics.importance_by_group(stand_in_importances(t))


@check(_groups(metrics.GROUPS_V2))
def a20_importance_by_group_v2(t):
    return metrics.importance_by_group(stand_in_importances(t), metrics.GROUPS_V2)


# --- windows ---------------------------------------------------------------------------------


@check(f"SELECT user_id, {r6('akb_score')}, akb_grade, akb_calculated, akb_exclusion, borrower_status FROM newest_score")
def w1_latest_score(t):
    return latest.latest_score(t.akb_scores, with_count=False)


@check(f"SELECT user_id, {r6('akb_score')}, akb_check_count FROM newest_score")
def w2_score_with_check_count(t):
    return latest.latest_score(t.akb_scores, ["akb_score"])


@check("SELECT id, user_id, count(*) OVER (PARTITION BY user_id) AS checks FROM akb_scores WHERE is_successful")
def w3_count_on_every_row(t):
    successful = t.akb_scores.where("is_successful").select("id", "user_id")
    return latest.with_key_count(successful, "user_id", "checks")


@check(f"SELECT {columns_of('user_id ' + HISTORY, HISTORY_R)} FROM newest_history")
def w4_latest_history(t):
    return latest.latest_history(t.akb_history_summary)


@check(f"SELECT id, recent_count, {r6('recent_low')}, {r6('recent_high')} FROM recent_submissions_24h")
def w5_velocity(t):
    subs = t.customer_submissions
    return velocity.trailing_activity(subs, subs).select("id", "recent_count", "recent_low", "recent_high")


@check("SELECT user_id, target, slice FROM split")
def w6_stratified_split(t):
    return ranking.stratified_split(t.predictions, "target", "user_id").select("user_id", "target", "slice")


@check(f"""SELECT feature, {r6('importance')}, CAST(rank AS INT) AS rank, rank <= 5 AS highlight
           FROM (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM importances) i WHERE rank <= 20""")
def w7_importance_ranking(t):
    return ranking.ranked_importance(stand_in_importances(t))


# --- sorts and limits ------------------------------------------------------------------------


@check(f"""SELECT name, surname, date_of_birth, age, {r6('akb_score')}, akb_letter_grade, decision, decision_type, user_id, submitted_at
           FROM (SELECT * FROM customer_submissions ORDER BY submitted_at DESC, id DESC LIMIT 200) s""")
def t1_recent_submissions(t):
    return reports.recent_submissions(t.customer_submissions)


@check(f"""SELECT {r6('akb_score')}, age, decision, trim(concat(name, ' ', surname)) AS name
           FROM (SELECT * FROM customer_submissions WHERE akb_score IS NOT NULL AND age IS NOT NULL
                 ORDER BY submitted_at DESC, id DESC LIMIT 500) s""")
def t2_risk_points(t):
    return reports.risk_points(t.customer_submissions)


@check(f"""SELECT grade_range, cnt, CAST(row_number() OVER (ORDER BY lowest) AS INT) AS position
           FROM (SELECT {BANDS} AS grade_range, count(*) AS cnt, min(akb_score) AS lowest FROM customer_submissions
                 WHERE akb_score IS NOT NULL GROUP BY 1) g""")
def t3_order_by_aggregate(t):
    # One row per band, five at most, reaches the window.
    position = F.row_number().over(Window.orderBy("lowest")).alias("position")
    return reports.banded_scores(t.customer_submissions).select("grade_range", "cnt", position)


BATCH = """SELECT f.user_id, {columns} FROM feat f LEFT JOIN predictions p ON p.user_id = f.user_id"""
PARTS["batch_decisions"] = BATCH.format(columns="""age, akb_score, akb_grade, loans_paid_count, total_loans,
    successful_payments, failed_payments, payment_success_rate, total_overdue_interest,
    CASE WHEN age < 18 OR akb_score IS NULL OR akb_score < 300 THEN NULL
      ELSE round_even(probability * 100, 1) END AS ml_probability,
    CASE WHEN age < 18 THEN 'REJECTED — Age is below 18'
      WHEN akb_score IS NULL OR akb_score < 300 THEN 'REJECTED — AKB Score too low'
      WHEN prediction = 1 THEN 'APPROVED' ELSE 'REJECTED — High credit risk' END AS decision,
    CASE WHEN age < 18 OR akb_score IS NULL OR akb_score < 300 THEN 'Hard Rules' ELSE 'XGBoost ML Model' END AS decision_type""")


def batch_decisions(t) -> DataFrame:
    rows = features.with_derived(features.assembled_reduced(t.credit), AS_OF)
    return decisions.score_all(rows, t.predictions, AS_OF)


@check(f"""SELECT user_id, decision, {r6('ml_probability')} FROM batch_decisions
           ORDER BY batch_decisions.ml_probability DESC NULLS FIRST, user_id LIMIT 50""")
def t4_top_decisions(t):
    return reports.top_decisions(batch_decisions(t)).select("user_id", "decision", "ml_probability")


@check(f"SELECT user_id, {r6('ml_probability')} FROM batch_decisions WHERE decision = 'APPROVED'")
def t4_approved_by_probability(t):
    return reports.approved_by_probability(batch_decisions(t)).select("user_id", "ml_probability")


@check(f"SELECT user_id, {r6('ml_probability')} FROM batch_decisions WHERE decision <> 'APPROVED'")
def t4_rejected_by_probability(t):
    return reports.rejected_by_probability(batch_decisions(t)).select("user_id", "ml_probability")


@check(f"""SELECT id, user_id, {r6('response_score_point')} FROM akb_scores WHERE user_id = '7' AND is_successful
           ORDER BY timestamp DESC, id DESC LIMIT 1""")
def t5_latest_for_one_key(t):
    newest = latest.latest_for(t.akb_scores.where("is_successful"), "user_id", "7", "timestamp", "id")
    return newest.select("id", "user_id", "response_score_point")


@check(f"""SELECT name, surname, {r6('akb_score')}, decision, residency FROM
           (SELECT name, surname, akb_score, decision, NULL AS residency FROM customer_submissions
            UNION ALL SELECT name, surname, akb_score, NULL, residency FROM applications) u""")
def u1_append_by_name(t):
    stored = t.customer_submissions.select("name", "surname", "akb_score", "decision")
    new = t.applications.select("residency", "akb_score", "surname", "name")
    return reports.append_rows(stored, new).select("name", "surname", "akb_score", "decision", "residency")
