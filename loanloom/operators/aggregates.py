"""One row per user from each fact table.

Every function reduces its fact table before anything is joined. Sums and counts combine on the map
side, so a user holding a large share of a table adds one row per task to the shuffle. Distinct
counts are two group-bys: the first spreads a heavy user over the values it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loanloom.functions.scalars import average, count_if, fractional_days, whole_days


def _tagged(tag: str) -> Column:
    return count_if(F.col("tag") == tag)


def loans_per_user(loans: DataFrame) -> DataFrame:
    return (
        loans.groupBy("user_id")
        .agg(
            F.count("*").alias("total_loans"),
            F.sum("amount").alias("total_amount_borrowed"),
            F.sum("term").alias("term_sum"),
            F.count("amount").alias("amounts"),
            F.count("term").alias("terms"),
            F.max("amount").alias("max_loan_amount"),
            F.min("amount").alias("min_loan_amount"),
            _tagged("paid").alias("loans_paid_count"),
            _tagged("overdue").alias("loans_overdue"),
            _tagged("active").alias("loans_active"),
            _tagged("written_off").alias("loans_written_off"),
            F.max("created").alias("last_created"),
            F.min("created").alias("first_created"),
        )
        .select(
            "user_id", "total_loans", "total_amount_borrowed",
            average(F.col("total_amount_borrowed"), F.col("amounts")).alias("avg_loan_amount"),
            average(F.col("term_sum"), F.col("terms")).alias("avg_loan_term"),
            "max_loan_amount", "min_loan_amount",
            "loans_paid_count", "loans_overdue", "loans_active", "loans_written_off",
            fractional_days(F.col("last_created"), F.col("first_created")).alias("days_between_first_last_loan"),
        )
    )


def actions_per_user(actions: DataFrame) -> DataFrame:
    return actions.groupBy("user_id").agg(
        _tagged("approved").alias("times_approved"),
        _tagged("in_review").alias("times_in_review"),
        _tagged("paid").alias("times_paid_action"),
        _tagged("written_off").alias("times_written_off"),
        _tagged("active").alias("times_active"),
    )


def states_per_user(states: DataFrame, loans: DataFrame) -> DataFrame:
    """Payment delays and debt per user.

    States are reduced to one row per loan before the join, so neither the join nor the second
    group-by sees the row count of the state table. Rows that are no payment, or on time, count as
    a delay of 0 in the average. States that are stored with their `user_id` need no join.
    """
    owned = ["user_id"] if "user_id" in states.columns else []
    late = F.greatest(whole_days(F.col("created"), F.col("target_date")), F.lit(0))
    delay = F.when(F.col("transaction_type") == "payment", late).otherwise(0)
    delayed = states.select(*owned, "loan_id", "overdue_interest", "debt", delay.alias("delay"))
    per_loan = delayed.groupBy(*owned, "loan_id").agg(
        F.count("*").alias("states"),
        count_if(F.col("delay").between(1, 30)).alias("delayed"),
        count_if(F.col("delay") > 30).alias("failed"),
        F.sum("delay").alias("delay_sum"),
        F.max("delay").alias("delay_max"),
        F.sum("overdue_interest").alias("interest"),
        F.sum("debt").alias("debt"),
    )
    if not owned:
        per_loan = per_loan.join(loans.select(F.col("id").alias("loan_id"), "user_id"), "loan_id")
    return (
        per_loan.groupBy("user_id")
        .agg(
            F.sum("delayed").alias("delayed_payments"),
            F.sum("failed").alias("failed_payments_30plus"),
            average(F.sum("delay_sum"), F.sum("states")).alias("avg_delay_days"),
            F.max("delay_max").alias("max_delay_days"),
            F.sum("interest").alias("total_overdue_interest"),
            F.sum("debt").alias("total_debt_accumulated"),
        )
    )


def payments_per_user(payments: DataFrame) -> DataFrame:
    """`is_successful` NULL is neither a success nor a failure; a NULL card is no card."""
    per_card = payments.groupBy("user_id", "card_id").agg(
        F.count("*").alias("payments"),
        F.count("amount").alias("amounts"),
        F.sum("amount").alias("paid"),
        F.max("amount").alias("largest"),
        count_if(F.col("is_successful")).alias("succeeded"),
        count_if(~F.col("is_successful")).alias("failed"),
    )
    return per_card.groupBy("user_id").agg(
        F.sum("payments").alias("total_payments"),
        F.sum("paid").alias("total_paid"),
        F.sum("succeeded").alias("successful_payments"),
        F.sum("failed").alias("failed_payments"),
        average(F.sum("paid"), F.sum("amounts")).alias("avg_payment_amount"),
        F.max("largest").alias("max_payment_amount"),
        F.count("card_id").alias("num_cards_used"),
    )


def cards_per_user(cards: DataFrame) -> DataFrame:
    return cards.groupBy("user_id").agg(
        F.count("*").alias("total_cards"),
        count_if(F.col("is_verified")).alias("verified_cards"),
        count_if(F.col("is_main")).alias("has_main_card"),
        count_if(F.col("is_for_disbursement")).alias("has_disbursement_card"),
        count_if(F.col("deleted").isNotNull()).alias("deleted_cards"),
    )


def documents_per_user(documents: DataFrame) -> DataFrame:
    per_loan = documents.groupBy("user_id", "loan_id").agg(
        F.count("*").alias("documents"), F.max("created").alias("last_created")
    )
    return per_loan.groupBy("user_id").agg(
        F.sum("documents").alias("total_docs_uploaded"),
        F.count("loan_id").alias("loans_with_docs"),
        F.max("last_created").alias("last_doc_uploaded"),
    )


def totals_for_customers(
    customers: DataFrame,
    loans: DataFrame,
    payments: DataFrame,
    cards: DataFrame,
    documents: DataFrame,
) -> DataFrame:
    """Aggregates as a query without GROUP BY gives them for one customer at a time.

    Every customer has exactly one row: counts of rows are 0 and all sums NULL where it has none.
    """
    counted = ["total_loans", "total_payments", "num_cards_used", "total_cards", "total_docs_uploaded", "loans_with_docs"]
    joined = (
        customers.select("user_id")
        .join(loans_per_user(loans), "user_id", "left")
        .join(payments_per_user(payments).drop("total_paid"), "user_id", "left")
        .join(cards_per_user(cards), "user_id", "left")
        .join(documents_per_user(documents).drop("last_doc_uploaded"), "user_id", "left")
    )
    return joined.fillna(0, subset=counted)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"))
