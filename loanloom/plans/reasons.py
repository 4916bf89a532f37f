"""The coloured reasons shown with a decision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from loanloom.functions.scalars import half_even, number_text

GREEN, YELLOW, RED = "green", "yellow", "red"

Feature = Callable[[str], Column]


def _say(colour, *parts) -> Column:
    colour = colour if isinstance(colour, Column) else F.lit(colour)
    words = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.struct(colour.alias("type"), F.concat(*words).alias("text"))


def _whole(value: Column) -> Column:
    return value.cast("bigint").cast("string")


def application_reasons(age: Column, akb_score: Column) -> list[Column]:
    score = akb_score.cast("double")
    shown = score.cast("string")
    years = age.cast("string")
    return [
        F.when(age < 18, _say(RED, "Age ", years, " is below the minimum requirement of 18"))
        .when(age >= 18, _say(GREEN, "Age ", years, " meets the minimum requirement")),
        F.when(score.isNull(), _say(RED, "No AKB credit score found"))
        .when(score < 300, _say(RED, "AKB score ", shown, " is below the minimum of 300"))
        .when(score < 500, _say(YELLOW, "AKB score ", shown, " is acceptable but low"))
        .otherwise(_say(GREEN, "AKB score ", shown, " is good")),
    ]


def history_reasons(feature: Feature) -> list[Column]:
    """Reasons from the features of an existing customer; a NULL feature says nothing."""
    paid, overdue = feature("loans_paid_count"), feature("loans_overdue")
    percent = half_even(feature("payment_success_rate") * 100, 1)
    colour = F.when(percent >= 80, GREEN).when(percent >= 50, YELLOW).otherwise(RED)
    interest, written_off = feature("total_overdue_interest"), feature("loans_written_off")
    return [
        F.when(paid > 0, _say(GREEN, _whole(paid), " loan(s) fully paid back"))
        .when(paid == 0, _say(YELLOW, "No loans paid back yet")),
        F.when(overdue > 0, _say(RED, _whole(overdue), " overdue loan(s) on record")),
        F.when(feature("payment_success_rate") > 0,
               _say(colour, "Payment success rate: ", number_text(percent), "%")),
        F.when(interest > 0, _say(RED, "Total overdue interest: ", number_text(interest), " AZN")),
        F.when(written_off > 0, _say(RED, _whole(written_off), " loan(s) written off")),
    ]


def model_reason(ml_score: Column) -> Column:
    shown = number_text(ml_score)
    return (
        F.when(ml_score >= 80, _say(GREEN, "ML model confidence: ", shown, "% — very low risk"))
        .when(ml_score >= 50, _say(YELLOW, "ML model confidence: ", shown, "% — moderate risk"))
        .when(ml_score.isNotNull(), _say(RED, "ML model confidence: ", shown, "% — high risk"))
    )


def reason_list(
    age: Column, akb_score: Column, ml_score: Column | None = None, feature: Feature | None = None
) -> Column:
    """Ordered `array<struct<type, text>>` of the reasons that apply."""
    reasons = application_reasons(age, akb_score)
    if feature is not None:
        reasons += history_reasons(feature)
    if ml_score is not None:
        reasons.append(model_reason(ml_score))
    return F.array_compact(F.array(*reasons))
