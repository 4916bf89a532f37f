"""Checks of scalar functions and of projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.parts import AS_OF as NOW, age_sql, number_text, py_round, r6
from checks.registry import check
from checks.relational import FAILED, batch_decisions, failed_payers, stand_in_importances
from loanloom.fixtures import AS_OF
from loanloom.functions import scalars as fn
from loanloom.operators import joins, metrics, reports
from loanloom.plans import features

# --- scalar functions ------------------------------------------------------------------------


@check(f"SELECT id, {age_sql('birth_date')} AS age FROM questionnaires")
def f1_completed_years(t):
    return t.questionnaires.select("id", fn.completed_years(F.col("birth_date"), AS_OF).alias("age"))


@check("SELECT application_id, CAST(try_strptime(date_of_birth, '%d/%m/%Y') AS DATE) AS birth_date FROM applications")
def f2_birth_date_text(t):
    return t.applications.select("application_id", fn.parse_birth_date(F.col("date_of_birth")).alias("birth_date"))


@check(f"""SELECT id, {r6('coalesce(monthly_income, 0) - coalesce(monthly_expenses, 0)', 'net_income')},
           {r6('coalesce(monthly_income, 0) + coalesce(additional_income, 0)', 'income_total')} FROM questionnaires""")
def f3_incomes(t):
    c = F.col
    return t.questionnaires.select(
        "id", fn.net_income(c("monthly_income"), c("monthly_expenses")).alias("net_income"),
        fn.total_income(c("monthly_income"), c("additional_income")).alias("income_total"))


@check("""SELECT id, round(CAST(outstanding_debt AS DOUBLE) / CASE WHEN monthly_income = 0 THEN 1 ELSE monthly_income::DOUBLE END, 6) AS ratio,
          round(CAST(outstanding_debt AS DOUBLE) / CASE WHEN monthly_income < 1 THEN 1 ELSE monthly_income::DOUBLE END, 6) AS ratio_floor
          FROM customer_submissions""")
def f4_zero_safe_ratio(t):
    # greatest skips NULL, so the online form divides by 1 where the income is unknown.
    c = F.col
    known = F.when(c("monthly_income").isNotNull(), fn.ratio_at_least_one(c("outstanding_debt"), c("monthly_income")))
    return t.customer_submissions.select(
        "id", fn.ratio(c("outstanding_debt"), c("monthly_income")).alias("ratio"), known.alias("ratio_floor"))


def _feature_columns(t, *names):
    return features.build_features(t.credit, AS_OF).select("user_id", *names)


def _feature_sql(*names: str) -> str:
    return f"SELECT user_id, {', '.join(r6(n) for n in names)} FROM feat"


PAYMENT_RATES = ("payment_success_rate", "delayed_payment_rate", "failed_payment_30plus_rate")
DEBT_RATES = ("debt_to_income", "loan_amount_to_income", "overdue_interest_to_debt", "approval_rate", "card_verified_rate")
FLAGS = ("is_repeat_borrower", "has_akb_score", "has_overdue_history", "has_written_off", "has_uploaded_docs")


@check(_feature_sql(*PAYMENT_RATES))
def f5_payment_rates(t):
    return _feature_columns(t, *PAYMENT_RATES)


@check(_feature_sql(*DEBT_RATES))
def f6_debt_rates(t):
    return _feature_columns(t, *DEBT_RATES)


@check(_feature_sql(*FLAGS))
def f7_flags(t):
    return _feature_columns(t, *FLAGS)


@check("SELECT id, CASE sex WHEN 'male' THEN 1 WHEN 'female' THEN 0 END AS sex_encoded FROM questionnaires")
def f8_encode_sex(t):
    return t.questionnaires.select("id", fn.encode_sex(F.col("sex")).alias("sex_encoded"))


@check("""SELECT id, CASE WHEN is_pep THEN 1 ELSE 0 END AS is_pep, CASE WHEN is_beneficial_owner THEN 1 ELSE 0 END
          AS is_beneficial_owner FROM questionnaires""")
def f9_boolean_flags(t):
    return t.questionnaires.select("id", *[fn.flag(F.col(c)).alias(c) for c in ("is_pep", "is_beneficial_owner")])


@check("SELECT id, CAST(coalesce(marital_status, -1) AS INT) AS marital_status FROM questionnaires")
def f10_marital_status(t):
    return t.questionnaires.select("id", fn.marital_code(F.col("marital_status")).alias("marital_status"))


@check(f"SELECT user_id, {', '.join(r6(f'coalesce({f}, -999)', f) for f in features.FEATURES_V3)} FROM feat")
def f11_sentinel_fill(t):
    df = features.build_features(t.credit, AS_OF).select("user_id", *features.FEATURES_V3)
    return fn.fill_for_model(df, features.FEATURES_V3)


@check("SELECT id, extract(DAY FROM (created - target_date)) AS days_late FROM loan_states")
def f12_whole_days(t):
    late = fn.whole_days(F.col("created"), F.col("target_date")).cast("bigint")
    return t.loan_states.select("id", late.alias("days_late"))


@check("SELECT id, round(extract(EPOCH FROM (submitted_at - TIMESTAMP '2024-01-01 00:00:00')) / 86400, 6) AS days FROM customer_submissions")
def f13_fractional_days(t):
    start = fn.as_timestamp("2024-01-01 00:00:00")
    return t.customer_submissions.select("id", fn.fractional_days(F.col("submitted_at"), start).alias("days"))


@check(f"""SELECT id, {py_round('monthly_income::DOUBLE / 8', 1)} AS half_even, {py_round('monthly_income::DOUBLE / 200', 2)} AS cents,
          round_even(monthly_income::DOUBLE / 8, 1) AS scaled_half_even, round(monthly_income::DOUBLE / 8, 1) AS half_up
          FROM customer_submissions""")
def f14_rounding(t):
    eighth = F.col("monthly_income").cast("double") / 8
    return t.customer_submissions.select(
        "id", fn.half_even(eighth, 1).alias("half_even"),
        fn.half_even(F.col("monthly_income").cast("double") / 200, 2).alias("cents"),
        fn.scaled_half_even(eighth, 1).alias("scaled_half_even"), fn.half_up(eighth, 1).alias("half_up"))


@check("SELECT id, greatest(5.0::DOUBLE, least(95.0::DOUBLE, akb_score)) AS clamped FROM customer_submissions WHERE akb_score IS NOT NULL")
def f15_clamp(t):
    return t.customer_submissions.dropna(subset=["akb_score"]).select(
        "id", fn.clamp(F.col("akb_score"), 5.0, 95.0).alias("clamped"))


@check(f"""SELECT application_id, coalesce(nullif(surname, ''), 'N/A') AS surname, {r6('coalesce(monthly_income, 0)', 'income')}
           FROM applications""")
def f16_defaults(t):
    return t.applications.select(
        "application_id", fn.text_or_na(F.col("surname")).alias("surname"),
        fn.zero_if_null(F.col("monthly_income")).alias("income"))


@check("""SELECT application_id, lower(name) AS folded, trim(concat(coalesce(name, ''), ' ', coalesce(surname, ''))) AS full_name
          FROM applications""")
def f17_names(t):
    return t.applications.select(
        "application_id", fn.folded(F.col("name")).alias("folded"),
        fn.full_name(F.col("name"), F.col("surname")).alias("full_name"))


@check("SELECT id, contains(decision, 'APPROVED') AS approved FROM customer_submissions")
def f18_mentions_approval(t):
    return t.customer_submissions.select("id", fn.mentions_approval(F.col("decision")).alias("approved"))


@check("""SELECT id, CAST(submitted_at AS DATE) AS day, strftime(submitted_at, '%Y-%m-%d %H:%M:%S') AS text,
          date_trunc('second', submitted_at) AS parsed FROM customer_submissions""")
def f19_days_and_text(t):
    text = fn.format_timestamp(F.col("submitted_at"))
    return t.customer_submissions.select(
        "id", fn.calendar_day(F.col("submitted_at")).alias("day"), text.alias("text"),
        fn.parse_timestamp(text).alias("parsed"))


@check("""SELECT id, CASE WHEN akb_score < 200 THEN 'E (0-199)' WHEN akb_score < 600 THEN 'D (200-599)'
          WHEN akb_score < 750 THEN 'C (600-749)' WHEN akb_score < 825 THEN 'B (750-824)' ELSE 'A (825+)' END AS band
          FROM customer_submissions""")
def f20_score_band(t):
    return t.customer_submissions.select("id", fn.score_band(F.col("akb_score")).alias("band"))


@check(f"""SELECT id, {py_round('amount * (18.0 / 100.0 / 12.0) / (1 - pow(1 + 18.0 / 100.0 / 12.0, -term))', 2)} AS payment FROM loans""")
def f21_annuity(t):
    payment = fn.annuity(F.col("amount").cast("double"), F.lit(18.0), F.col("term"))
    return t.loans.select("id", payment.alias("payment"))


@check("""SELECT application_id, coalesce(user_id, md5(concat(coalesce(name, ''), '|', coalesce(surname, ''), '|',
          coalesce(date_of_birth, '')))) AS generated_user_id FROM applications""")
def f22_generated_id(t):
    identity = [F.col(c) for c in ("name", "surname", "date_of_birth")]
    return t.applications.select(
        "application_id", fn.applicant_id(F.col("user_id"), *identity).alias("generated_user_id"))


@check(f"SELECT id, {number_text('akb_score')} AS score, {number_text('CAST(monthly_expenses AS DOUBLE) / 7')} AS share FROM customer_submissions")
def f23_number_text(t):
    return t.customer_submissions.select(
        "id", fn.number_text(F.col("akb_score")).alias("score"),
        fn.number_text(F.col("monthly_expenses").cast("double") / 7).alias("share"))


# --- projections and filters -----------------------------------------------------------------


@check(f"SELECT user_id, sex, birth_date, {r6('monthly_income')} FROM people")
def p1_projection(t):
    df = joins.profile(t.users, t.questionnaires, [], ["sex", "birth_date", "monthly_income"])
    return df.select("user_id", "sex", "birth_date", "monthly_income")


COUNTED = "loans_paid_count successful_payments total_loans total_payments total_amount_borrowed akb_check_count liab_count failed_payments".split()
MEASURED = """total_overdue_interest overdue_interest_to_debt payment_success_rate avg_payment_amount
    total_debt_accumulated avg_loan_term total_outstanding_debt akb_score credit_balance""".split()
COMPACT_SQL = f"""SELECT user_id, age, {', '.join(COUNTED)}, {', '.join(r6(m) for m in MEASURED)}, akb_grade,
    is_pep, is_beneficial_owner, is_related_to_pep,
    CASE WHEN coalesce(loans_overdue, 0) > 0 THEN 'bad' WHEN coalesce(loans_paid, 0) > 0 THEN 'good' ELSE 'unknown' END
    AS borrower_label, {NOW} AS created_at FROM feat"""


@check(COMPACT_SQL)
def p2_keep_list(t):
    return features.customer_features(t.credit, AS_OF, features.COMPACT_25)


@check(f"SELECT user_id, {', '.join(r6(f'coalesce({f}, -999)', f) for f in features.FEATURES_V2)} FROM feat")
def p3_model_matrix(t):
    matrix = features.model_matrix(features.build_features(t.credit, AS_OF, version=2), version=2)
    return matrix.select("user_id", *features.FEATURES_V2)


@check(f"SELECT id, user_id, amount, tag FROM loans WHERE user_id IN ({FAILED})")
def p4_key_filter(t):
    return t.loans.join(failed_payers(t), "user_id", "left_semi").select("id", "user_id", "amount", "tag")


@check("SELECT id, user_id FROM akb_scores WHERE is_successful = TRUE")
def p5_boolean_filter(t):
    return t.akb_scores.where("is_successful").select("id", "user_id")


@check("SELECT min(id) AS user_id FROM users WHERE contains(login, lower('Customer#0000001'))")
def p6_login_search(t):
    return joins.first_login_match(t.users, "Customer#0000001")


@check(f"SELECT id, {r6('akb_score')}, age FROM customer_submissions WHERE akb_score IS NOT NULL AND age IS NOT NULL")
def p7_not_null(t):
    return reports.scored_points(t.customer_submissions).select("id", "akb_score", "age")


@check("SELECT id, decision FROM customer_submissions WHERE decision <> 'APPROVED'")
def p8_not_approved(t):
    return t.customer_submissions.where(reports.NOT_APPROVED).select("id", "decision")


@check(f"SELECT id, submitted_at FROM customer_submissions WHERE submitted_at > {NOW} - INTERVAL '14 days'")
def p9_recent_rows(t):
    return reports.recent_rows(t.customer_submissions, "submitted_at", AS_OF).select("id", "submitted_at")


@check("""SELECT id, CASE WHEN tag = 'paid' THEN 1 ELSE 0 END AS paid, CASE WHEN tag = 'overdue' THEN 1 ELSE 0 END AS overdue
          FROM loans""")
def p10_conditional_value(t):
    return t.loans.select("id", *[F.when(F.col("tag") == k, 1).otherwise(0).alias(k) for k in ("paid", "overdue")])


@check("SELECT id FROM loan_states WHERE extract(DAY FROM (created - target_date)) BETWEEN 1 AND 30")
def p11_inclusive_range(t):
    late = fn.whole_days(F.col("created"), F.col("target_date"))
    return t.loan_states.where(late.between(1, 30)).select("id")


@check("""SELECT user_id, decision, CASE WHEN decision = 'APPROVED' THEN 'approved' ELSE 'rejected' END AS part
          FROM batch_decisions""")
def p12_split_by_decision(t):
    decided = batch_decisions(t).select("user_id", "decision")
    approved = decided.where(reports.APPROVED).withColumn("part", F.lit("approved"))
    return approved.unionByName(decided.where(reports.NOT_APPROVED).withColumn("part", F.lit("rejected")))


@check("SELECT user_id, target FROM feat WHERE target IS NOT NULL")
def p13_drop_missing_target(t):
    return features.model_matrix(features.build_features(t.credit, AS_OF)).select("user_id", "target")


@check(f"""SELECT feature, {r6('importance')} FROM importances WHERE feature IN ('total_cards', 'verified_cards', 'card_verified_rate')""")
def p14_membership(t):
    members = metrics.GROUPS_V3["Cards"].split()
    return stand_in_importances(t).where(F.col("feature").isin(members))
