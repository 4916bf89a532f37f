"""Decisions for whole tables: new applications, existing customers, every customer, batch scoring.

A model enters as a table (user_id, probability[, prediction]) with one row per user, or None when
there is no model; then rules decide alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loanloom.functions import scalars as fn
from loanloom.operators.joins import (
    earlier_in_batch,
    existing_applicants,
    fan_out_left_join,
    left_join_sparse,
    login_postings,
    score_lookup,
    users_by_index,
    with_birth_date,
)
from loanloom.operators.velocity import fraud_flags
from loanloom.plans import rules
from loanloom.plans.offers import loan_offer
from loanloom.plans.reasons import reason_list
from loanloom.session import materialise

# Output columns in order.
BATCH_COLUMNS = """
user_id age akb_score akb_grade loans_paid_count total_loans successful_payments failed_payments
payment_success_rate total_overdue_interest ml_probability decision decision_type created_at
""".split()
EXPORT_COLUMNS = "user_id date_of_birth age akb_score akb_grade decision decision_type ml_score".split()
ALREADY_EXISTS = "You already have an account! Your User ID is below."
SCORE_WITHOUT_MODEL = 55


def _with_probability(df: DataFrame, probabilities: DataFrame | None, sparse: bool = False) -> DataFrame:
    """Rows with probability and prediction: joined by user, already there, or NULL without a model.

    `sparse` says that many rows have no user; where users are known, their partitioning is kept.
    """
    if probabilities is None and {"probability", "prediction"} <= set(df.columns):
        return df
    if probabilities is None:
        return df.withColumns({"probability": F.lit(None).cast("double"), "prediction": F.lit(None).cast("int")})
    if "prediction" not in probabilities.columns:
        predicted = (F.col("probability") >= 0.5).cast("int")
        probabilities = probabilities.withColumn("prediction", predicted)
    scores = probabilities.select("user_id", "probability", "prediction")
    # Figures of an earlier model give way to those given.
    df = df.drop("probability", "prediction")
    return left_join_sparse(df, scores, "user_id") if sparse else df.join(scores, "user_id", "left")


# --- new applications ------------------------------------------------------------------------


def apply_hard_rules(applications: DataFrame, as_of, passed: str = rules.PASSED) -> DataFrame:
    """Adds birth_date (unless there), age and hard_decision. The age is NULL without a birth date."""
    if "birth_date" not in applications.columns:
        applications = applications.withColumn("birth_date", fn.parse_birth_date(F.col("date_of_birth")))
    aged = applications.withColumn("age", fn.completed_years(F.col("birth_date"), as_of))
    decision = rules.hard_rules(F.col("birth_date"), F.col("age"), F.col("akb_score"), passed)
    return aged.withColumn("hard_decision", decision)


def precheck(applications: DataFrame, as_of, submissions: DataFrame | None = None) -> DataFrame:
    """Step 1 of a new application: the rules' result, with reasons where rejected. Nothing is stored.

    With the stored submissions, an applicant who is already there gets that id and no result.
    """
    marked = applications if submissions is None else mark_duplicates(applications, submissions)
    checked = apply_hard_rules(marked, as_of)
    rejected = F.col("hard_decision") != rules.PASSED
    result = checked.select(
        "*",
        rejected.alias("hard_rejected"),
        F.col("hard_decision").alias("decision"),
        F.when(rejected, rules.BY_RULES).alias("decision_type"),
        F.when(rejected, reason_list(F.col("age"), F.col("akb_score"))).alias("reasons"),
    ).drop("hard_decision")
    return result if submissions is None else _blank_duplicates(result, marked.columns)


def scorecard_decisions(applications: DataFrame, as_of) -> DataFrame:
    """Step 2 of a new application: hard rules, then the scorecard for those who pass."""
    checked = apply_hard_rules(applications, as_of)
    points = rules.scorecard(*[F.col(c) for c in (
        "age", "akb_score", "monthly_income", "monthly_expenses", "outstanding_debt", "overdue_amount", "has_overdue",
    )])
    scored = checked.withColumn("ml_score", F.when(F.col("hard_decision") == rules.PASSED, points))
    by_score = rules.pass_or_risk(F.col("ml_score"))
    return scored.select(
        "*",
        F.coalesce(by_score, "hard_decision").alias("decision"),
        F.when(F.col("ml_score").isNull(), rules.BY_RULES).otherwise(rules.BY_MODEL).alias("decision_type"),
    ).drop("hard_decision")


def offer_for(decision: Column, ml_score: Column, akb_score: Column, income: Column | None) -> Column:
    """Offer for an approved customer; one approved without a score is treated as scored 55."""
    score = F.coalesce(F.nullif(ml_score, F.lit(0.0)), F.lit(float(SCORE_WITHOUT_MODEL)))
    return F.when(decision == rules.APPROVED, loan_offer(score, akb_score, income))


def mark_duplicates(applications: DataFrame, submissions: DataFrame, key: str | None = None) -> DataFrame:
    """Adds already_exists, existing_user_id and message; a duplicate gets no decision.

    With `key`, the unique id of an application, one that follows another of the same person in this batch
    is a duplicate too and gets the id of the first, unless a stored submission came before both.
    """
    matched = existing_applicants(applications, submissions)
    known = F.col("existing_id").cast("string")
    if key is not None:
        matched = earlier_in_batch(matched, key)
        known = F.coalesce(known, F.col("earlier_application").cast("string"))
    return matched.select(
        "*",
        known.isNotNull().alias("already_exists"),
        known.alias("existing_user_id"),
        F.when(known.isNotNull(), ALREADY_EXISTS).alias("message"),
    ).drop("existing_id", "earlier_application")


def _blank_duplicates(decided: DataFrame, given: list[str]) -> DataFrame:
    added = [c for c in decided.columns if c not in given]
    return decided.withColumns({c: F.when(~F.col("already_exists"), F.col(c)) for c in added})


def decide_stateless(applications: DataFrame, as_of, apply_income_cap: bool = False) -> DataFrame:
    """Rules, scorecard, reasons and offer: needs no other table, so it also runs on a stream."""
    decided = scorecard_decisions(applications, as_of)
    income = F.col("monthly_income") if apply_income_cap else None
    score, bureau = F.col("ml_score"), F.col("akb_score")
    return decided.withColumns({
        "generated_user_id": fn.applicant_id(F.col("user_id"), *[F.col(c) for c in ("name", "surname", "date_of_birth")]),
        "reasons": reason_list(F.col("age"), bureau, score),
        "loan_recommendation": offer_for(F.col("decision"), score, bureau, income),
    })


def decide_applications(
    applications: DataFrame, submissions: DataFrame, as_of, apply_income_cap: bool = False, key: str | None = None
) -> DataFrame:
    """New applications end to end. Duplicates of an earlier submission carry its id and no decision.

    All rows take one pass; what was decided is blanked for duplicates. `key` finds duplicates in the batch
    itself. Flags count an application along with the stored ones, as if it had just been stored.
    """
    marked = mark_duplicates(applications, submissions, key)
    counted = "name surname date_of_birth akb_score submitted_at".split()
    history = submissions.select(*counted).unionByName(marked.where(~F.col("already_exists")).select(*counted))
    decided = fraud_flags(decide_stateless(marked, as_of, apply_income_cap), history)
    return _blank_duplicates(decided, marked.columns)


def decide_submissions(
    applications: DataFrame,
    submissions: DataFrame,
    users: DataFrame,
    questionnaires: DataFrame,
    features: DataFrame,
    probabilities: DataFrame | None,
    as_of,
    key: str = "application_id",
) -> DataFrame:
    """Every application by its customer_type: new ones by scorecard, all others as existing customers.

    Only new applicants are searched for duplicates and flagged. A row without a decision (a duplicate, or one
    with a decision_error) was not answered with one and is not to be stored.
    """
    is_new = F.coalesce(F.col("customer_type") == "new", F.lit(False))
    fresh = decide_applications(applications.where(is_new), submissions, as_of, key=key)
    known = decide_existing(applications.where(~is_new), users, questionnaires, features, probabilities, as_of)
    unflagged = F.array().cast("array<string>")
    return fresh.unionByName(
        known.withColumns({"already_exists": F.lit(False), "fraud_flags": unflagged}), allowMissingColumns=True)


def submission_record(decided: DataFrame) -> DataFrame:
    """The 12 columns stored for a decided application."""
    owner = F.col("generated_user_id") if "generated_user_id" in decided.columns else F.lit(None).cast("string")
    return decided.select(
        *[fn.text_or_na(F.col(c)).alias(c) for c in ("name", "surname", "date_of_birth", "residency")],
        "age", "akb_score", "akb_letter_grade", "decision", "decision_type", "ml_score",
        F.coalesce(owner, F.col("user_id")).alias("user_id"),
        fn.format_timestamp(F.col("submitted_at")).alias("submitted_at"),
    )


# --- existing customers ----------------------------------------------------------------------


def combine_decisions(df: DataFrame, need_loans: bool) -> DataFrame:
    """Hard rule, else the model (optionally only with at least one loan), else approved by the rules."""
    passed = F.col("hard_decision") == rules.PASSED
    use_model = passed & (F.coalesce(F.col("total_loans"), F.lit(0)) > 0) if need_loans else passed
    probability = F.when(use_model, F.col("probability"))
    by_model = rules.model_decision(probability)
    typed_by_model = use_model if need_loans else by_model.isNotNull()
    return df.withColumns({
        "ml_score": rules.model_percent(probability),
        "decision": F.when(~passed, F.col("hard_decision")).otherwise(F.coalesce(by_model, F.lit(rules.APPROVED))),
        "decision_type": F.when(typed_by_model, rules.BY_MODEL).otherwise(rules.BY_RULES),
    })


def decide_existing(
    applications: DataFrame,
    users: DataFrame,
    questionnaires: DataFrame,
    features: DataFrame,
    probabilities: DataFrame | None,
    as_of,
) -> DataFrame:
    """Applications of existing customers, with reasons and offer from their online features (one row per user)."""
    shown = "total_loans loans_paid_count loans_overdue payment_success_rate total_overdue_interest loans_written_off".split()
    known = features.select("user_id", *shown, F.col("monthly_income").alias("known_income"))
    dated = with_birth_date(applications, users, questionnaires)
    checked = left_join_sparse(apply_hard_rules(dated, as_of), known, "user_id")
    decided = combine_decisions(_with_probability(checked, probabilities, sparse=True), need_loans=True)
    failed = F.col("decision_error").isNotNull()
    reasons = reason_list(F.col("age"), F.col("akb_score"), F.col("ml_score"), F.col)
    offer = offer_for(F.col("decision"), F.col("ml_score"), F.col("akb_score"), F.col("known_income"))
    blank = {c: F.when(~failed, F.col(c)) for c in ("decision", "decision_type", "ml_score", "age")}
    return (
        decided.withColumns({"reasons": F.when(~failed, reasons), "loan_recommendation": F.when(~failed, offer)})
        .withColumns(blank)
        .drop("hard_decision", "probability", "prediction", "known_income", *shown)
    )


def decide_by_name(
    applications: DataFrame, users: DataFrame, stored_features: DataFrame, probabilities: DataFrame | None, as_of
) -> DataFrame:
    """Decision by the stored features of the user whose login contains the applicant's name.

    The index of logins is written to the shared folder first, as three parts of the lookup read it.
    """
    matched = users_by_index(materialise(login_postings(users)), apply_hard_rules(applications, as_of))
    stored = stored_features.select("user_id").distinct().withColumn("has_features", F.lit(True))
    # The applicant's own user_id plays no part here: the matched one does.
    found = left_join_sparse(matched.drop("user_id").withColumnRenamed("matched_user_id", "user_id"), stored, "user_id")
    scored = _with_probability(found, probabilities, sparse=True)
    usable = F.when(F.col("has_features"), F.col("probability"))
    decided = combine_decisions(scored.withColumn("probability", usable), need_loans=False)
    return decided.drop("hard_decision", "probability", "prediction", "has_features")


def decide_all(
    users: DataFrame,
    questionnaires: DataFrame,
    scores: DataFrame,
    probabilities: DataFrame | None,
    as_of,
) -> DataFrame:
    """Every customer with age, score, decision and type: 8 columns."""
    known = score_lookup(users.select(F.col("id").alias("user_id")), scores)
    known = _with_probability(known, probabilities)
    people = fan_out_left_join(known, questionnaires.select("user_id", "birth_date"), "user_id")
    decided = combine_decisions(apply_hard_rules(people, as_of), need_loans=False)
    return decided.withColumn("date_of_birth", F.col("birth_date").cast("string")).select(*EXPORT_COLUMNS)


# --- batch scoring ---------------------------------------------------------------------------


def score_all(features: DataFrame, probabilities: DataFrame | None, as_of, variant: str = "batch") -> DataFrame:
    """The decision table: 14 columns, or 15 with the label for the `feature_table` variant.

    `batch` takes freshly built features; `feature_table` the stored table, where no age is known
    and a missing bureau score goes on to the model. Features that went through `model.predict`
    already hold the probability and need no join: pass None. With a model, a customer that no rule
    rejects and that has no prediction gets no decision (NULL, type NOT_SCORED); without any model such
    a customer is approved by the rules.
    """
    modelled = probabilities is not None or "prediction" in features.columns
    scored = _with_probability(features, probabilities)
    score = F.col("akb_score")
    if variant == "batch":
        by_rule = rules.hard_rules_batch(F.col("age"), score)
        columns = BATCH_COLUMNS
    elif variant == "feature_table":
        by_rule = rules.hard_rules_feature_table(score)
        scored = scored.withColumn("age", F.lit(None).cast("double"))
        columns = BATCH_COLUMNS[:10] + ["borrower_label"] + BATCH_COLUMNS[10:]
    else:
        raise ValueError(f"unknown variant {variant!r}")
    return scored.withColumns({
        "ml_probability": F.when(by_rule.isNull(), fn.scaled_half_even(F.col("probability") * 100, 1)),
        "decision": F.coalesce(
            by_rule, rules.class_decision(F.col("prediction")), F.lit(None if modelled else rules.APPROVED)),
        "decision_type": F.when(by_rule.isNull() & F.col("prediction").isNotNull(), rules.BY_MODEL)
        .when(by_rule.isNull() & F.lit(modelled), rules.NOT_SCORED).otherwise(rules.BY_RULES),
        "created_at": fn.as_timestamp(as_of),
    }).select(*columns)
