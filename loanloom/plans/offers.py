"""Loan offer from a score, the bureau score and the income."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loanloom.functions.scalars import annuity, bind, half_even

# Fixed values: (lower limit of the model score, base amount), (lower limit of the bureau score, multiplier),
# (lower limit of the model score, yearly rate in percent).
BASE_AMOUNTS = ((90, 10000.0), (80, 7000.0), (70, 5000.0), (60, 3000.0), (50, 1500.0))
MULTIPLIERS = ((750, 1.3), (600, 1.1), (400, 1.0))
LOWEST_MULTIPLIER = 0.8
RATES = ((80, 12), (65, 18))
HIGHEST_RATE = 24
SHORT_TERM, LONG_TERM, SHORT_TERM_LIMIT = 12, 24, 3000
INCOME_MULTIPLE = 3


def _by_limit(value: Column, steps) -> Column:
    result = None
    for limit, outcome in steps:
        result = F.when(value >= limit, F.lit(outcome)) if result is None else result.when(value >= limit, F.lit(outcome))
    return result


def loan_offer(ml_score: Column, akb_score: Column, monthly_income: Column | None = None) -> Column:
    """Struct (max_amount, interest_rate, term_months, monthly_payment), NULL without a score of 50 or more.

    With an income above 0 the amount is capped at three times that income.
    """
    base = _by_limit(ml_score, BASE_AMOUNTS)
    multiplier = _by_limit(akb_score, MULTIPLIERS).otherwise(F.lit(LOWEST_MULTIPLIER))
    amount = half_even(base * multiplier / 100) * 100
    if monthly_income is not None:
        income = monthly_income.cast("double")
        amount = F.least(amount, F.when(income > 0, income * INCOME_MULTIPLE))
    rate = _by_limit(ml_score, RATES).otherwise(F.lit(HIGHEST_RATE))

    def offer(lent: Column) -> Column:
        term = F.when(lent <= SHORT_TERM_LIMIT, SHORT_TERM).otherwise(LONG_TERM)
        return F.struct(
            lent.cast("bigint").alias("max_amount"),
            rate.alias("interest_rate"),
            term.alias("term_months"),
            annuity(lent, rate.cast("double"), term).alias("monthly_payment"),
        )

    return F.when(base.isNotNull() & akb_score.isNotNull(), bind(amount, offer))
