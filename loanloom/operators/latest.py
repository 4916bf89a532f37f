"""Latest record per key, as an aggregate rather than a window.

`max_by` combines on the map side: each task sends one row per key, so a key holding a large share
of the table is never sorted or buffered in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def newest_first_key(ts: str, tie: str) -> Column:
    """Orders like `ts DESC` with NULL first, ties broken by the larger `tie`."""
    return F.struct(F.col(ts).isNull(), F.col(ts), F.col(tie))


def latest_per_key(
    df: DataFrame,
    key: str,
    ts: str,
    tie: str,
    columns: dict[str, str],
    count_as: str | None = None,
) -> DataFrame:
    """The newest row of each key, `columns` renamed {source: output}; optionally the rows per key."""
    record = F.struct(*[F.col(source).alias(name) for source, name in columns.items()])
    picked = [F.max_by(record, newest_first_key(ts, tie)).alias("record")]
    if count_as:
        picked.append(F.count("*").alias(count_as))
    outputs = [f"record.{name}" for name in columns.values()]
    return df.groupBy(key).agg(*picked).select(key, *outputs, *([count_as] if count_as else []))


# The record columns and the names the features use.
SCORE_COLUMNS = {
    "response_score_point": "akb_score",
    "response_score_response": "akb_grade",
    "response_score_calculated": "akb_calculated",
    "response_score_exclusion": "akb_exclusion",
    "response_borrower_status": "borrower_status",
}
HISTORY_COLUMNS = {
    "liab_count": "liab_count",
    "liab_outstanding_debt_main_sum": "total_outstanding_debt",
    "liab_outstanding_debt_interest_sum": "total_outstanding_interest",
    "liab_days_main_overdue_max": "max_days_overdue",
    "liab_days_main_overdue_sum": "total_days_overdue",
    "response_score_point": "history_score",
    "response_balance": "credit_balance",
}


def latest_score(scores: DataFrame, columns: Sequence[str] | None = None, with_count: bool = True) -> DataFrame:
    """Latest successful bureau score per user, with the number of successful checks."""
    wanted = {s: n for s, n in SCORE_COLUMNS.items() if columns is None or n in columns}
    return latest_per_key(
        scores.where("is_successful"), "user_id", "timestamp", "id", wanted,
        count_as="akb_check_count" if with_count else None,
    )


def latest_history(history: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Latest bureau history row per user, successful or not."""
    wanted = {s: n for s, n in HISTORY_COLUMNS.items() if columns is None or n in columns}
    return latest_per_key(history, "user_id", "timestamp", "id", wanted)


def latest_for(df: DataFrame, key: str, value, ts: str, tie: str) -> DataFrame:
    """The newest row of one key: a filter and a top-1, no shuffle of the table."""
    newest = [F.col(ts).desc_nulls_first(), F.col(tie).desc()]
    return df.where(F.col(key) == value).orderBy(*newest).limit(1)


def with_key_count(df: DataFrame, key: str, name: str) -> DataFrame:
    """Every row with the number of rows of its key, by joining the counts back."""
    counts = df.groupBy(key).agg(F.count("*").alias(name))
    return df.join(counts, key)
