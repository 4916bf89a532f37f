"""The wide feature row per customer.

Two policies say what a missing table row means: `batch` (as the model was trained: NULL, later the
sentinel) and `online` (as one customer is looked up: counts are 0, some sums are 0).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from loanloom.functions import scalars as fn
from loanloom.operators import aggregates as agg
from loanloom.operators.joins import assemble, fan_out_left_join, left_join_renaming
from loanloom.operators.latest import latest_history, latest_score
from loanloom.plans.labels import borrower_label, target

# The features in model order, by version.
FEATURES_V3 = """
age sex_encoded marital_status monthly_income monthly_expenses additional_income net_income income_total
akb_score akb_calculated akb_exclusion akb_check_count has_akb_score history_score
total_loans total_amount_borrowed avg_loan_amount avg_loan_term max_loan_amount min_loan_amount
loans_paid_count loans_overdue loans_active loans_written_off days_between_first_last_loan
times_approved times_in_review times_paid_action times_written_off times_active approval_rate
total_payments successful_payments failed_payments avg_payment_amount max_payment_amount num_cards_used
payment_success_rate delayed_payments delayed_payment_rate failed_payments_30plus failed_payment_30plus_rate
avg_delay_days max_delay_days total_overdue_interest total_debt_accumulated
liab_count total_outstanding_debt total_outstanding_interest max_days_overdue total_days_overdue credit_balance
debt_to_income loan_amount_to_income overdue_interest_to_debt
is_repeat_borrower has_overdue_history has_written_off
total_cards verified_cards has_main_card has_disbursement_card deleted_cards card_verified_rate
total_docs_uploaded loans_with_docs has_uploaded_docs is_pep is_beneficial_owner is_related_to_pep
""".split()

NOT_IN_V2 = """
min_loan_amount loans_written_off times_approved times_in_review times_paid_action times_written_off times_active
approval_rate max_payment_amount has_written_off total_cards verified_cards has_main_card has_disbursement_card
deleted_cards card_verified_rate total_docs_uploaded loans_with_docs has_uploaded_docs
""".split()
FEATURES_V2 = [f for f in FEATURES_V3 if f not in NOT_IN_V2]

FEATURES_V1 = """
age akb_score akb_calculated history_score monthly_income monthly_expenses net_income income_total debt_to_income
total_loans total_amount_borrowed avg_loan_amount avg_loan_term loans_paid loans_overdue
total_payments successful_payments failed_payments payment_success_rate
liab_count total_outstanding_debt total_outstanding_interest max_days_overdue total_days_overdue credit_balance
questionnaire_completion sex_encoded marital_status is_pep is_beneficial_owner is_related_to_pep
""".split()

FEATURES = {1: FEATURES_V1, 2: FEATURES_V2, 3: FEATURES_V3}

# What an online lookup puts for a missing value where that is 0, not the sentinel.
ONLINE_ZERO = """
delayed_payments failed_payments_30plus total_outstanding_debt avg_loan_amount total_overdue_interest
total_debt_accumulated times_in_review times_approved max_days_overdue total_cards verified_cards
total_docs_uploaded loans_written_off total_loans total_payments num_cards_used loans_with_docs
""".split()

# The stored feature table, in column order.
COMPACT_22 = """
user_id age loans_paid_count successful_payments total_overdue_interest total_loans overdue_interest_to_debt
total_payments total_amount_borrowed payment_success_rate avg_payment_amount akb_check_count
total_debt_accumulated avg_loan_term total_outstanding_debt liab_count failed_payments akb_score akb_grade
credit_balance borrower_label created_at
""".split()
COMPACT_25 = COMPACT_22[:20] + ["is_pep", "is_beneficial_owner", "is_related_to_pep"] + COMPACT_22[20:]

USER_COLUMNS = ("loans_paid", "locale", "questionnaire_completion")
QUESTIONNAIRE_COLUMNS = (
    "sex", "birth_date", "monthly_income", "monthly_expenses", "additional_income", "marital_status",
    "citizenship", "registration_region", "is_pep", "is_beneficial_owner", "is_related_to_pep",
)


@dataclass(frozen=True)
class CreditTables:
    """The source tables the features are built from."""

    users: DataFrame
    questionnaires: DataFrame
    loans: DataFrame
    loan_actions: DataFrame
    loan_states: DataFrame
    payments: DataFrame
    cards: DataFrame
    akb_scores: DataFrame
    akb_history_summary: DataFrame
    doc_front_all: DataFrame


def _people(tables: CreditTables) -> DataFrame:
    return tables.users.select(F.col("id").alias("user_id"), *USER_COLUMNS)


def _with_questionnaire(per_user: DataFrame, tables: CreditTables) -> DataFrame:
    """Joined last: it is the only join that can repeat a user, and nothing is joined by user after it.

    Only the ids meet the questionnaires in the fan-out join, which reads its left side twice; the parts
    follow in one inner join, of which adaptive execution can split either side.
    """
    answers = tables.questionnaires.select("user_id", *QUESTIONNAIRE_COLUMNS)
    repeated = fan_out_left_join(_people(tables).select("user_id"), answers, "user_id")
    return repeated.join(per_user, "user_id").select(*per_user.columns, *QUESTIONNAIRE_COLUMNS)


def _one_questionnaire(tables: CreditTables) -> DataFrame:
    """The questionnaire with the smallest id per user: a lookup of one customer reads one row."""
    answers = F.struct(*QUESTIONNAIRE_COLUMNS)
    first = tables.questionnaires.groupBy("user_id").agg(F.min_by(answers, "id").alias("answers"))
    return first.select("user_id", "answers.*")


def assembled(tables: CreditTables, one_row_per_user: bool = False) -> DataFrame:
    """All eight per-user parts and the questionnaire (for features v3)."""
    per_user = assemble(
        _people(tables),
        agg.loans_per_user(tables.loans),
        agg.actions_per_user(tables.loan_actions),
        agg.states_per_user(tables.loan_states, tables.loans),
        agg.payments_per_user(tables.payments),
        agg.cards_per_user(tables.cards),
        latest_score(tables.akb_scores),
        latest_history(tables.akb_history_summary),
        agg.documents_per_user(tables.doc_front_all),
    )
    if one_row_per_user:
        return assemble(per_user, _one_questionnaire(tables))
    return _with_questionnaire(per_user, tables)


def assembled_reduced(tables: CreditTables) -> DataFrame:
    """The five parts of features v2, batch scoring and the stored feature table."""
    per_user = assemble(
        _people(tables),
        agg.loans_per_user(tables.loans),
        agg.states_per_user(tables.loan_states, tables.loans),
        agg.payments_per_user(tables.payments),
        latest_score(tables.akb_scores),
        latest_history(tables.akb_history_summary),
    )
    return _with_questionnaire(per_user, tables)


def assembled_v1(tables: CreditTables) -> DataFrame:
    """Features v1: no loan states; the user's own `loans_paid` keeps its name beside the counted one."""
    loans = agg.loans_per_user(tables.loans).withColumnRenamed("loans_paid_count", "loans_paid")
    per_user = assemble(
        left_join_renaming(_people(tables), loans, "user_id", "_loan"),
        agg.payments_per_user(tables.payments),
        latest_score(tables.akb_scores),
        latest_history(tables.akb_history_summary),
    )
    return _with_questionnaire(per_user, tables)


def _derived(columns: set[str], as_of, divide) -> dict[str, Column]:
    """Definitions of the derived features whose inputs are among `columns`."""
    c = F.col
    income = fn.total_income(c("monthly_income"), c("additional_income"))
    or_zero = lambda name: F.coalesce(c(name), F.lit(0))
    definitions = {
        "age": (("birth_date",), lambda: fn.completed_years(c("birth_date"), as_of)),
        "net_income": (("monthly_income", "monthly_expenses"),
                       lambda: fn.net_income(c("monthly_income"), c("monthly_expenses"))),
        "income_total": (("monthly_income", "additional_income"), lambda: income),
        "payment_success_rate": (("successful_payments", "total_payments"),
                                 lambda: divide(c("successful_payments"), c("total_payments"))),
        "delayed_payment_rate": (("delayed_payments", "total_payments"),
                                 lambda: divide(or_zero("delayed_payments"), c("total_payments"))),
        "failed_payment_30plus_rate": (("failed_payments_30plus", "total_payments"),
                                       lambda: divide(or_zero("failed_payments_30plus"), c("total_payments"))),
        "debt_to_income": (("total_outstanding_debt",), lambda: divide(or_zero("total_outstanding_debt"), income)),
        "loan_amount_to_income": (("avg_loan_amount",), lambda: divide(or_zero("avg_loan_amount"), income)),
        "overdue_interest_to_debt": (("total_overdue_interest", "total_debt_accumulated"),
                                     lambda: divide(or_zero("total_overdue_interest"), c("total_debt_accumulated"))),
        "approval_rate": (("times_approved", "times_in_review"),
                          lambda: divide(or_zero("times_approved"), c("times_in_review"))),
        "card_verified_rate": (("verified_cards", "total_cards"),
                               lambda: divide(or_zero("verified_cards"), c("total_cards"))),
        "is_repeat_borrower": (("total_loans",), lambda: fn.above(c("total_loans"), 1)),
        "has_akb_score": (("akb_score",), lambda: fn.present(c("akb_score"))),
        "has_overdue_history": (("max_days_overdue",), lambda: fn.above(c("max_days_overdue"), 0)),
        "has_written_off": (("loans_written_off",), lambda: fn.above(c("loans_written_off"), 0)),
        "has_uploaded_docs": (("total_docs_uploaded",), lambda: fn.above(c("total_docs_uploaded"), 0)),
        "sex_encoded": (("sex",), lambda: fn.encode_sex(c("sex"))),
        "is_pep": (("is_pep",), lambda: fn.flag(c("is_pep"))),
        "is_beneficial_owner": (("is_beneficial_owner",), lambda: fn.flag(c("is_beneficial_owner"))),
        "is_related_to_pep": (("is_related_to_pep",), lambda: fn.flag(c("is_related_to_pep"))),
        "marital_status": (("marital_status",), lambda: fn.marital_code(c("marital_status"))),
    }
    return {name: make() for name, (inputs, make) in definitions.items() if set(inputs) <= columns}


def with_derived(df: DataFrame, as_of, null_policy: str = "batch") -> DataFrame:
    """Adds the derived features to an assembled row, under the batch or the online policy."""
    if null_policy == "online":
        zeros = [c for c in ONLINE_ZERO if c in df.columns]
        df = df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zeros})
        divide = fn.ratio_at_least_one
    elif null_policy == "batch":
        divide = fn.ratio
    else:
        raise ValueError(f"unknown null policy {null_policy!r}")
    return df.withColumns(_derived(set(df.columns), as_of, divide))


def build_features(tables: CreditTables, as_of, version: int = 3, null_policy: str = "batch") -> DataFrame:
    """One row per customer: user_id, the version's features, grade and target. Missing values stay NULL.

    A customer with several questionnaires has a row for each under the batch policy, one online.
    """
    if null_policy == "online" and version == 3:
        source = assembled(tables, one_row_per_user=True)
    else:
        source = {1: assembled_v1, 2: assembled_reduced, 3: assembled}[version](tables)
    df = with_derived(source, as_of, null_policy).withColumn("target", target(version))
    features = FEATURES[version]
    return df.selectExpr("user_id", *[f"CAST({f} AS DOUBLE) AS {f}" for f in features], "akb_grade", "target")


def model_matrix(df: DataFrame, version: int = 3, keep=("user_id", "target")) -> DataFrame:
    """The ordered feature columns with the sentinel for NULL; rows without a target are dropped."""
    kept = [c for c in keep if c in df.columns]
    rows = df.dropna(subset=["target"]) if "target" in kept else df
    return fn.fill_for_model(rows.select(*kept, *FEATURES[version]), FEATURES[version])


def customer_features(tables: CreditTables, as_of, columns=None) -> DataFrame:
    """The stored feature table: 22 columns, 25 with `COMPACT_25`, or every column with `columns="all"`."""
    df = with_derived(assembled_reduced(tables), as_of).withColumns(
        {"borrower_label": borrower_label(), "created_at": fn.as_timestamp(as_of)}
    )
    if columns == "all":
        return df
    return df.select(*(columns or COMPACT_22))


def online_features(tables: CreditTables, as_of, user_ids: DataFrame | None = None) -> DataFrame:
    """Features under the online policy, for all customers or those in `user_ids`."""
    if user_ids is not None:
        keys = user_ids.select("user_id").distinct()
        wanted_loans = tables.loans.join(keys, "user_id", "left_semi")
        states = tables.loan_states.join(wanted_loans.select(F.col("id").alias("loan_id")), "loan_id", "left_semi")
        by_user = {
            name: getattr(tables, name).join(keys, "user_id", "left_semi")
            for name in ("questionnaires", "loan_actions", "payments", "cards", "akb_scores",
                         "akb_history_summary", "doc_front_all")
        }
        users = tables.users.join(keys.withColumnRenamed("user_id", "id"), "id", "left_semi")
        tables = CreditTables(users=users, loans=wanted_loans, loan_states=states, **by_user)
    return build_features(tables, as_of, version=3, null_policy="online")
