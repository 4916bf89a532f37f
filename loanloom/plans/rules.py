"""Hard rules, the scorecard for new applicants, and the model's decision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loanloom.functions.scalars import clamp, half_even

# Decision and decision-type texts, and the limits of the hard rules.
PASSED = "PASSED"
APPROVED = "APPROVED"
NO_BIRTH_DATE = "REJECTED — No birth date found"
TOO_YOUNG = "REJECTED — Age is below 18"
NO_SCORE = "REJECTED — AKB Score is empty"
LOW_SCORE = "REJECTED — AKB Score too low"
HIGH_RISK = "REJECTED — High credit risk"
BY_RULES = "Hard Rules"
NOT_SCORED = "No prediction"
BY_MODEL = "XGBoost ML Model"
MIN_AGE = 18
MIN_SCORE = 300

# Scorecard points as (lower limit, points), first match wins.
SCORE_POINTS = ((750, 30), (600, 20), (400, 10), (300, 5))
NET_INCOME_POINTS = ((2000, 20), (1000, 14), (500, 8), (0, 3))
NET_INCOME_ELSE = -10
DEBT_RATIO_POINTS = ((0.3, 5), (0.5, 0), (1.0, -10))
DEBT_FREE, DEBT_ELSE = 10, -20
OVERDUE_POINTS, LARGE_OVERDUE_POINTS, LARGE_OVERDUE = -25, -10, 1000
PRIME_AGE, PRIME_AGE_POINTS = (25, 45), 5
SENIOR_AGE, SENIOR_AGE_POINTS = 55, -5
BASE_POINTS = 50.0
PASS_MARK = 50


def _ladder(steps, otherwise) -> Column:
    result = None
    for condition, value in steps:
        result = F.when(condition, value) if result is None else result.when(condition, value)
    return result.otherwise(otherwise)


def hard_rules(birth: Column, age: Column, score: Column, passed: str = PASSED) -> Column:
    """First matching rule, else `passed`."""
    return (
        F.when(birth.isNull(), NO_BIRTH_DATE)
        .when(age < MIN_AGE, TOO_YOUNG)
        .when(score.isNull(), NO_SCORE)
        .when(score < MIN_SCORE, LOW_SCORE)
        .otherwise(passed)
    )


def hard_rules_batch(age: Column, score: Column) -> Column:
    """Batch form: an unknown age passes, a missing score counts as too low. NULL where no rule applies."""
    return F.when(age < MIN_AGE, TOO_YOUNG).when(score.isNull() | (score < MIN_SCORE), LOW_SCORE)


def hard_rules_feature_table(score: Column) -> Column:
    """Form for the stored feature table, which has no birth date: a missing score goes on to the model."""
    return F.when(score < MIN_SCORE, LOW_SCORE)


def scorecard(
    age: Column, score: Column, income: Column, expenses: Column, debt: Column, overdue: Column, has_overdue: Column
) -> Column:
    """Points of a new applicant, clamped to 5..95."""
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    score, income, expenses, debt, overdue = map(number, (score, income, expenses, debt, overdue))
    bureau = _ladder([(score >= low, points) for low, points in SCORE_POINTS], 0)
    net = income - expenses
    earnings = _ladder([(net > low, points) for low, points in NET_INCOME_POINTS], NET_INCOME_ELSE)
    ratio = debt / F.nullif(income, F.lit(0.0))
    steps = [(ratio == 0, DEBT_FREE)] + [(ratio < limit, points) for limit, points in DEBT_RATIO_POINTS]
    burden = F.when(income > 0, _ladder(steps, DEBT_ELSE)).otherwise(0)
    late = F.when(has_overdue, OVERDUE_POINTS + F.when(overdue > LARGE_OVERDUE, LARGE_OVERDUE_POINTS).otherwise(0))
    years = F.when(age.between(*PRIME_AGE), PRIME_AGE_POINTS).when(age > SENIOR_AGE, SENIOR_AGE_POINTS).otherwise(0)
    points = F.lit(BASE_POINTS) + bureau + earnings + burden + late.otherwise(0) + years
    return half_even(clamp(points, 5.0, 95.0), 1)


def pass_or_risk(score: Column) -> Column:
    return F.when(score >= PASS_MARK, APPROVED).when(score.isNotNull(), HIGH_RISK)


def model_percent(probability: Column) -> Column:
    return half_even(probability * 100, 1)


def model_decision(probability: Column) -> Column:
    """NULL probability (no model) gives no decision."""
    return F.when(probability >= 0.5, APPROVED).when(probability.isNotNull(), HIGH_RISK)


def class_decision(prediction: Column) -> Column:
    return F.when(prediction == 1, APPROVED).when(prediction.isNotNull(), HIGH_RISK)
