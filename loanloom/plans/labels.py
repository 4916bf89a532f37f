"""Training targets and the borrower label."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _none(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)) == 0


def target(version: int = 3) -> Column:
    """1 for a good borrower. Each version adds a condition to the one before."""
    good = (F.coalesce("loans_paid", F.lit(0)) > 0) & _none("loans_overdue")
    if version >= 2:
        good = good & _none("failed_payments_30plus")
    if version >= 3:
        good = good & _none("loans_written_off")
    return good.cast("int")


def borrower_label() -> Column:
    """An overdue loan makes 'bad' whatever was paid; nothing paid and nothing overdue is 'unknown'."""
    return (
        F.when(F.coalesce("loans_overdue", F.lit(0)) > 0, "bad")
        .when(F.coalesce("loans_paid", F.lit(0)) > 0, "good")
        .otherwise("unknown")
    )
