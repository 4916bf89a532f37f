"""SQL building blocks the checks share: aggregates, latest records, joins and features."""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def r6(expression: str, name: str | None = None) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6) AS {name or expression}"


def age_sql(birth: str) -> str:
    return (
        f"CAST(date_part('year', {AS_OF}) - date_part('year', {birth}) - CASE WHEN 131 < date_part('month', {birth}) * 100 "
        f"+ date_part('day', {birth}) THEN 1 ELSE 0 END AS INT)"
    )


def py_round(expression: str, digits: int) -> str:
    """Rounds the binary value half to even, as Python does: the formatted text, read back."""
    return f"CAST(format('{{:.{digits}f}}', CAST({expression} AS DOUBLE)) AS DOUBLE)"


LATE = "extract(DAY FROM (ls.created - ls.target_date))"

PARTS: dict[str, str] = {
    "loan_totals": """
        SELECT user_id, count(*) AS total_loans, CAST(sum(amount) AS BIGINT) AS total_amount_borrowed,
          avg(amount) AS avg_loan_amount, avg(term) AS avg_loan_term, max(amount) AS max_loan_amount,
          min(amount) AS min_loan_amount, count(*) FILTER (WHERE tag = 'paid') AS loans_paid_count,
          count(*) FILTER (WHERE tag = 'overdue') AS loans_overdue,
          count(*) FILTER (WHERE tag = 'active') AS loans_active,
          count(*) FILTER (WHERE tag = 'written_off') AS loans_written_off,
          extract(EPOCH FROM (max(created) - min(created))) / 86400 AS days_between_first_last_loan
        FROM loans GROUP BY user_id""",
    "action_totals": """
        SELECT user_id, count(*) FILTER (WHERE tag = 'approved') AS times_approved,
          count(*) FILTER (WHERE tag = 'in_review') AS times_in_review,
          count(*) FILTER (WHERE tag = 'paid') AS times_paid_action,
          count(*) FILTER (WHERE tag = 'written_off') AS times_written_off,
          count(*) FILTER (WHERE tag = 'active') AS times_active
        FROM loan_actions GROUP BY user_id""",
    "state_totals": f"""
        SELECT l.user_id,
          count(*) FILTER (WHERE ls.transaction_type = 'payment' AND {LATE} BETWEEN 1 AND 30) AS delayed_payments,
          count(*) FILTER (WHERE ls.transaction_type = 'payment' AND {LATE} > 30) AS failed_payments_30plus,
          avg(CASE WHEN ls.transaction_type = 'payment' AND ls.created > ls.target_date THEN {LATE} ELSE 0 END)
            AS avg_delay_days,
          max(CASE WHEN ls.transaction_type = 'payment' AND ls.created > ls.target_date THEN {LATE} ELSE 0 END)
            AS max_delay_days,
          CAST(sum(ls.overdue_interest) AS DOUBLE) AS total_overdue_interest,
          CAST(sum(ls.debt) AS DOUBLE) AS total_debt_accumulated
        FROM loan_states ls JOIN loans l ON l.id = ls.loan_id GROUP BY l.user_id""",
    "payment_totals": """
        SELECT user_id, count(*) AS total_payments, CAST(sum(amount) AS DOUBLE) AS total_paid,
          count(*) FILTER (WHERE is_successful = TRUE) AS successful_payments,
          count(*) FILTER (WHERE is_successful = FALSE) AS failed_payments,
          CAST(sum(amount) AS DOUBLE) / count(amount) AS avg_payment_amount,
          CAST(max(amount) AS DOUBLE) AS max_payment_amount, count(DISTINCT card_id) AS num_cards_used
        FROM payments GROUP BY user_id""",
    "card_totals": """
        SELECT user_id, count(*) AS total_cards, count(*) FILTER (WHERE is_verified) AS verified_cards,
          count(*) FILTER (WHERE is_main) AS has_main_card,
          count(*) FILTER (WHERE is_for_disbursement) AS has_disbursement_card,
          count(*) FILTER (WHERE deleted IS NOT NULL) AS deleted_cards
        FROM cards GROUP BY user_id""",
    "document_totals": """
        SELECT user_id, count(*) AS total_docs_uploaded, count(DISTINCT loan_id) AS loans_with_docs,
          max(created) AS last_doc_uploaded
        FROM doc_front_all GROUP BY user_id""",
    "newest_score": """
        SELECT user_id, akb_score, akb_grade, akb_calculated, akb_exclusion, borrower_status, akb_check_count
        FROM (SELECT user_id, CAST(response_score_point AS DOUBLE) AS akb_score, response_score_response AS akb_grade,
                response_score_calculated AS akb_calculated, response_score_exclusion AS akb_exclusion,
                response_borrower_status AS borrower_status,
                count(*) OVER (PARTITION BY user_id) AS akb_check_count,
                row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, id DESC) AS rn
              FROM akb_scores WHERE is_successful) s WHERE rn = 1""",
    "newest_history": """
        SELECT user_id, liab_count, total_outstanding_debt, total_outstanding_interest, max_days_overdue,
          total_days_overdue, history_score, credit_balance
        FROM (SELECT user_id, liab_count, CAST(liab_outstanding_debt_main_sum AS DOUBLE) AS total_outstanding_debt,
                CAST(liab_outstanding_debt_interest_sum AS DOUBLE) AS total_outstanding_interest,
                liab_days_main_overdue_max AS max_days_overdue, liab_days_main_overdue_sum AS total_days_overdue,
                CAST(response_score_point AS DOUBLE) AS history_score,
                CAST(response_balance AS DOUBLE) AS credit_balance,
                row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, id DESC) AS rn
              FROM akb_history_summary) h WHERE rn = 1""",
    "people": """
        SELECT u.id AS user_id, u.loans_paid, u.locale, u.questionnaire_completion, q.sex, q.birth_date,
          CAST(q.monthly_income AS DOUBLE) AS monthly_income, CAST(q.monthly_expenses AS DOUBLE) AS monthly_expenses,
          CAST(q.additional_income AS DOUBLE) AS additional_income, q.marital_status, q.citizenship,
          q.registration_region, q.is_pep, q.is_beneficial_owner, q.is_related_to_pep
        FROM users u LEFT JOIN questionnaires q ON q.user_id = u.id""",
    "wide": """
        SELECT p.*, l.* EXCLUDE (user_id), a.* EXCLUDE (user_id), s.* EXCLUDE (user_id), y.* EXCLUDE (user_id),
          c.* EXCLUDE (user_id), k.* EXCLUDE (user_id), h.* EXCLUDE (user_id), d.* EXCLUDE (user_id)
        FROM people p LEFT JOIN loan_totals l ON l.user_id = p.user_id
        LEFT JOIN action_totals a ON a.user_id = p.user_id LEFT JOIN state_totals s ON s.user_id = p.user_id
        LEFT JOIN payment_totals y ON y.user_id = p.user_id LEFT JOIN card_totals c ON c.user_id = p.user_id
        LEFT JOIN newest_score k ON k.user_id = p.user_id LEFT JOIN newest_history h ON h.user_id = p.user_id
        LEFT JOIN document_totals d ON d.user_id = p.user_id""",
}


def _features(divide, income_total: str, value) -> str:
    """Feature definitions over `wide`; `divide` and `value` carry the policy for missing values."""
    v = value
    rows = {
        "age": age_sql("birth_date"),
        "sex_encoded": "CASE sex WHEN 'male' THEN 1 WHEN 'female' THEN 0 END",
        "marital_status": "coalesce(marital_status, -1)",
        "net_income": "coalesce(monthly_income, 0) - coalesce(monthly_expenses, 0)",
        "income_total": income_total,
        "has_akb_score": "CASE WHEN akb_score IS NOT NULL THEN 1 ELSE 0 END",
        "approval_rate": divide(f"coalesce({v('times_approved')}, 0)", v("times_in_review")),
        "payment_success_rate": divide("successful_payments", v("total_payments")),
        "delayed_payment_rate": divide("coalesce(delayed_payments, 0)", v("total_payments")),
        "failed_payment_30plus_rate": divide("coalesce(failed_payments_30plus, 0)", v("total_payments")),
        "debt_to_income": divide("coalesce(total_outstanding_debt, 0)", income_total),
        "loan_amount_to_income": divide("coalesce(avg_loan_amount, 0)", income_total),
        "overdue_interest_to_debt": divide("coalesce(total_overdue_interest, 0)", v("total_debt_accumulated")),
        "is_repeat_borrower": "CASE WHEN coalesce(total_loans, 0) > 1 THEN 1 ELSE 0 END",
        "has_overdue_history": "CASE WHEN coalesce(max_days_overdue, 0) > 0 THEN 1 ELSE 0 END",
        "has_written_off": "CASE WHEN coalesce(loans_written_off, 0) > 0 THEN 1 ELSE 0 END",
        "card_verified_rate": divide("coalesce(verified_cards, 0)", v("total_cards")),
        "has_uploaded_docs": "CASE WHEN coalesce(total_docs_uploaded, 0) > 0 THEN 1 ELSE 0 END",
        "is_pep": "CASE WHEN is_pep THEN 1 ELSE 0 END",
        "is_beneficial_owner": "CASE WHEN is_beneficial_owner THEN 1 ELSE 0 END",
        "is_related_to_pep": "CASE WHEN is_related_to_pep THEN 1 ELSE 0 END",
    }
    plain = """monthly_income monthly_expenses additional_income akb_score akb_calculated akb_exclusion akb_check_count
        history_score total_loans total_amount_borrowed avg_loan_amount avg_loan_term max_loan_amount min_loan_amount
        loans_paid_count loans_overdue loans_active loans_written_off days_between_first_last_loan times_approved
        times_in_review times_paid_action times_written_off times_active total_payments successful_payments
        failed_payments avg_payment_amount max_payment_amount num_cards_used delayed_payments failed_payments_30plus
        avg_delay_days max_delay_days total_overdue_interest total_debt_accumulated liab_count total_outstanding_debt
        total_outstanding_interest max_days_overdue total_days_overdue credit_balance total_cards verified_cards
        has_main_card has_disbursement_card deleted_cards total_docs_uploaded loans_with_docs""".split()
    rows.update({name: v(name) for name in plain})
    good = "coalesce(loans_paid, 0) > 0 AND coalesce(loans_overdue, 0) = 0"
    third = good + " AND coalesce(failed_payments_30plus, 0) = 0 AND coalesce(loans_written_off, 0) = 0"
    columns = ", ".join(f"{sql} AS {name}" for name, sql in rows.items())
    return (
        f"SELECT user_id, loans_paid, questionnaire_completion, birth_date, akb_grade, {columns}, "
        f"CASE WHEN {third} THEN 1 ELSE 0 END AS target FROM wide"
    )


INCOME = "(coalesce(monthly_income, 0) + coalesce(additional_income, 0))"
ONLINE_ZERO = """delayed_payments failed_payments_30plus total_outstanding_debt avg_loan_amount total_overdue_interest
    total_debt_accumulated times_in_review times_approved max_days_overdue total_cards verified_cards
    total_docs_uploaded loans_written_off total_loans total_payments num_cards_used loans_with_docs""".split()

PARTS["feat"] = _features(
    lambda n, d: f"CAST({n} AS DOUBLE) / CASE WHEN {d} = 0 THEN 1 ELSE CAST({d} AS DOUBLE) END", INCOME, lambda c: c)
PARTS["feat_online"] = _features(
    lambda n, d: f"CAST({n} AS DOUBLE) / CASE WHEN {d} < 1 THEN 1 ELSE CAST({d} AS DOUBLE) END", INCOME,
    lambda c: f"coalesce({c}, 0)" if c in ONLINE_ZERO else c)

# Hard rules per customer, from the stored birth date and the newest score.
PARTS["ruled"] = f"""
    SELECT user_id, birth_date, age, akb_score, akb_grade, CASE WHEN birth_date IS NULL THEN 'REJECTED — No birth date found'
        WHEN age < 18 THEN 'REJECTED — Age is below 18' WHEN akb_score IS NULL THEN 'REJECTED — AKB Score is empty'
        WHEN akb_score < 300 THEN 'REJECTED — AKB Score too low' ELSE 'PASSED' END AS hard_decision
    FROM (SELECT p.user_id, p.birth_date, {age_sql("p.birth_date")} AS age, k.akb_score, k.akb_grade
          FROM people p LEFT JOIN newest_score k ON k.user_id = p.user_id) x"""

# Hard rules and scorecard for the applications and for the stored submissions.
_BIRTH = "CAST(try_strptime(date_of_birth, '%d/%m/%Y') AS DATE)"


def _scored(table: str, key: str) -> str:
    return f"""
    SELECT *, CASE WHEN hard_decision = 'PASSED' THEN {py_round('greatest(5.0, least(95.0, points))', 1)} END AS ml_score
    FROM (SELECT *, CAST(50.0 + CASE WHEN score >= 750 THEN 30 WHEN score >= 600 THEN 20 WHEN score >= 400 THEN 10
          WHEN score >= 300 THEN 5 ELSE 0 END
        + CASE WHEN income - expenses > 2000 THEN 20 WHEN income - expenses > 1000 THEN 14
          WHEN income - expenses > 500 THEN 8 WHEN income - expenses > 0 THEN 3 ELSE -10 END
        + CASE WHEN income > 0 THEN CASE WHEN debt / income = 0 THEN 10 WHEN debt / income < 0.3 THEN 5
          WHEN debt / income < 0.5 THEN 0 WHEN debt / income < 1.0 THEN -10 ELSE -20 END ELSE 0 END
        + CASE WHEN has_overdue THEN -25 + CASE WHEN overdue > 1000 THEN -10 ELSE 0 END ELSE 0 END
        + CASE WHEN years BETWEEN 25 AND 45 THEN 5 WHEN years > 55 THEN -5 ELSE 0 END AS DOUBLE) AS points,
        CASE WHEN birth IS NULL THEN 'REJECTED — No birth date found'
          WHEN years < 18 THEN 'REJECTED — Age is below 18' WHEN akb_score IS NULL THEN 'REJECTED — AKB Score is empty'
          WHEN akb_score < 300 THEN 'REJECTED — AKB Score too low' ELSE 'PASSED' END AS hard_decision
      FROM (SELECT *, {age_sql("birth")} AS years, coalesce(akb_score, 0) AS score,
          CAST(coalesce(monthly_income, 0) AS DOUBLE) AS income, CAST(coalesce(monthly_expenses, 0) AS DOUBLE) AS expenses,
          CAST(coalesce(outstanding_debt, 0) AS DOUBLE) AS debt, CAST(coalesce(overdue_amount, 0) AS DOUBLE) AS overdue
        FROM (SELECT *, {_BIRTH} AS birth FROM {table}) b) n) m"""


PARTS["scored_applications"] = _scored("applications", "application_id")
PARTS["scored_submissions"] = _scored("customer_submissions", "id")

# Existing customers: features of the online policy, the fixed predictions and the birth date.
PARTS["birth_dates"] = """
    SELECT u.id AS user_id, min_by(q.birth_date, q.id) AS stored_birth_date
    FROM users u LEFT JOIN questionnaires q ON q.user_id = u.id GROUP BY u.id"""


def number_text(x: str) -> str:
    return f"regexp_replace(format('{{:.2f}}', CAST({x} AS DOUBLE)), '(\\.\\d+?)0+$', '\\1')"


def reasons_sql(age: str, score: str, ml: str | None, features: bool = False, prefix: str = "") -> str:
    """The reasons as one text `type: text | ...`."""
    p = prefix
    items = [
        f"CASE WHEN {age} < 18 THEN concat('red: Age ', {age}, ' is below the minimum requirement of 18') "
        f"WHEN {age} >= 18 THEN concat('green: Age ', {age}, ' meets the minimum requirement') END",
        f"CASE WHEN {score} IS NULL THEN 'red: No AKB credit score found' "
        f"WHEN {score} < 300 THEN concat('red: AKB score ', {number_text(score)}, ' is below the minimum of 300') "
        f"WHEN {score} < 500 THEN concat('yellow: AKB score ', {number_text(score)}, ' is acceptable but low') "
        f"ELSE concat('green: AKB score ', {number_text(score)}, ' is good') END",
    ]
    if features:
        pct = py_round(f"{p}payment_success_rate * 100", 1)
        items += [
            f"CASE WHEN {p}loans_paid_count > 0 THEN concat('green: ', {p}loans_paid_count, ' loan(s) fully paid back') "
            f"WHEN {p}loans_paid_count = 0 THEN 'yellow: No loans paid back yet' END",
            f"CASE WHEN {p}loans_overdue > 0 THEN concat('red: ', {p}loans_overdue, ' overdue loan(s) on record') END",
            f"CASE WHEN {p}payment_success_rate > 0 THEN concat(CASE WHEN {pct} >= 80 THEN 'green' WHEN {pct} >= 50 "
            f"THEN 'yellow' ELSE 'red' END, ': Payment success rate: ', {number_text(pct)}, '%') END",
            f"CASE WHEN {p}total_overdue_interest > 0 THEN concat('red: Total overdue interest: ', "
            f"{number_text(p + 'total_overdue_interest')}, ' AZN') END",
            f"CASE WHEN {p}loans_written_off > 0 THEN concat('red: ', {p}loans_written_off, ' loan(s) written off') END",
        ]
    if ml is not None:
        items.append(
            f"CASE WHEN {ml} >= 80 THEN concat('green: ML model confidence: ', {number_text(ml)}, '% — very low risk') "
            f"WHEN {ml} >= 50 THEN concat('yellow: ML model confidence: ', {number_text(ml)}, '% — moderate risk') "
            f"WHEN {ml} IS NOT NULL THEN concat('red: ML model confidence: ', {number_text(ml)}, '% — high risk') END"
        )
    return f"concat_ws(' | ', {', '.join(items)})"


def offer_sql(table: str, ml: str, score: str, income: str | None, keep: str) -> str:
    """Rows of `table` with the four offer columns."""
    base = (f"CASE WHEN {score} IS NULL THEN NULL WHEN {ml} >= 90 THEN 10000 WHEN {ml} >= 80 THEN 7000 "
            f"WHEN {ml} >= 70 THEN 5000 WHEN {ml} >= 60 THEN 3000 WHEN {ml} >= 50 THEN 1500 END::DOUBLE")
    factor = f"CASE WHEN {score} >= 750 THEN 1.3 WHEN {score} >= 600 THEN 1.1 WHEN {score} >= 400 THEN 1.0 ELSE 0.8 END::DOUBLE"
    cap = f"CASE WHEN {income} > 0 AND {income} * 3 < uncapped THEN {income} * 3 ELSE uncapped END" if income else "uncapped"
    payment = "amount * (rate / 100.0 / 12.0) / (1 - pow(1 + rate / 100.0 / 12.0, -term))"
    return f"""
    SELECT {keep}, CAST(floor(amount) AS BIGINT) AS max_amount, rate AS interest_rate, term AS term_months,
      {py_round(payment, 2)} AS monthly_payment
    FROM (SELECT *, CASE WHEN amount IS NULL THEN NULL WHEN amount <= 3000 THEN 12 ELSE 24 END AS term,
        CASE WHEN amount IS NULL THEN NULL WHEN {ml} >= 80 THEN 12 WHEN {ml} >= 65 THEN 18 ELSE 24 END AS rate
      FROM (SELECT *, CAST({cap} AS DOUBLE) AS amount
        FROM (SELECT *, {py_round(f"({base}) * ({factor}) / 100", 0)} * 100 AS uncapped
          FROM {table}) o1) o2) o3"""


# Velocity by a self-join, and by a join of applications to the stored submissions.
PARTS["recent_submissions_24h"] = """
    SELECT a.id, count(b.id) AS recent_count, min(b.akb_score) AS recent_low, max(b.akb_score) AS recent_high
    FROM customer_submissions a LEFT JOIN customer_submissions b ON lower(b.name) = lower(a.name)
      AND lower(b.surname) = lower(a.surname) AND b.date_of_birth = a.date_of_birth
      AND b.submitted_at > a.submitted_at - INTERVAL '24 hours' AND b.submitted_at <= a.submitted_at
    GROUP BY a.id"""
PARTS["recent_for_applications"] = """
    SELECT a.application_id, count(b.id) AS recent_count, min(b.akb_score) AS recent_low, max(b.akb_score) AS recent_high
    FROM applications a LEFT JOIN customer_submissions b ON lower(b.name) = coalesce(lower(a.name), '')
      AND lower(b.surname) = coalesce(lower(a.surname), '') AND b.date_of_birth = coalesce(a.date_of_birth, '')
      AND b.submitted_at > a.submitted_at - INTERVAL '24 hours' AND b.submitted_at <= a.submitted_at
    GROUP BY a.application_id"""


def flags_sql(score: str) -> str:
    return (
        "concat_ws(' | ', CASE WHEN recent_count >= 3 THEN 'Multiple submissions in 24 hours' END, "
        f"CASE WHEN {score} <> 0 AND (recent_high - {score} > 100 OR {score} - recent_low > 100) "
        "THEN 'AKB score varies significantly across submissions' END)"
    )


PARTS["first_submission"] = """
    SELECT lower(name) AS lname, lower(surname) AS lsurname, date_of_birth AS birth, id AS existing_id
    FROM (SELECT *, row_number() OVER (PARTITION BY lower(name), lower(surname), date_of_birth
            ORDER BY submitted_at, id) AS rn FROM customer_submissions) f WHERE rn = 1"""
PARTS["matched_applications"] = """
    SELECT a.*, f.existing_id FROM applications a LEFT JOIN first_submission f
      ON f.lname = lower(a.name) AND f.lsurname = lower(a.surname) AND f.birth = a.date_of_birth"""

# The seeded split: rank of the token inside its class.
PARTS["split"] = """
    SELECT p.*, CASE WHEN row_number() OVER (PARTITION BY target ORDER BY md5(concat('42:', user_id)), user_id)
        <= floor(count(*) OVER (PARTITION BY target) * 0.2) THEN 'test' ELSE 'train' END AS slice
    FROM predictions p"""
PARTS["sliced"] = "SELECT * FROM split UNION ALL SELECT * REPLACE ('all' AS slice) FROM split"
