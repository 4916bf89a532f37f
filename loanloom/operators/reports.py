"""Dashboard aggregates, run summaries and top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loanloom.functions.scalars import as_timestamp, calendar_day, count_if, full_name, half_up, score_band

APPROVED = "decision = 'APPROVED'"
NOT_APPROVED = "decision <> 'APPROVED'"


def _outcomes():
    return (
        F.count("*").alias("total"),
        count_if(F.expr(APPROVED)).alias("approved"),
        count_if(F.expr(NOT_APPROVED)).alias("rejected"),
    )


def recent_rows(df: DataFrame, ts: str, as_of, days: int = 14) -> DataFrame:
    """Rows strictly newer than `days` before `as_of`."""
    start = as_timestamp(as_of) - F.make_dt_interval(F.lit(days))
    return df.where(F.col(ts) > start)


def daily_submissions(submissions: DataFrame, as_of, days: int = 14) -> DataFrame:
    recent = recent_rows(submissions, "submitted_at", as_of, days)
    return recent.groupBy(calendar_day(F.col("submitted_at")).alias("day")).agg(*_outcomes()).orderBy("day")


def rejection_reasons(submissions: DataFrame) -> DataFrame:
    counts = submissions.where(NOT_APPROVED).groupBy("decision").agg(F.count("*").alias("cnt"))
    return counts.orderBy(F.col("cnt").desc(), "decision")


def score_distribution(submissions: DataFrame) -> DataFrame:
    """Rows per score band, ordered by the lowest score in the band."""
    return banded_scores(submissions).orderBy("lowest").select("grade_range", "cnt")


def banded_scores(submissions: DataFrame) -> DataFrame:
    banded = submissions.where("akb_score IS NOT NULL").groupBy(score_band(F.col("akb_score")).alias("grade_range"))
    return banded.agg(F.count("*").alias("cnt"), F.min("akb_score").alias("lowest"))


def overall_stats(submissions: DataFrame) -> DataFrame:
    def mean(name: str):
        exact = F.sum(F.col(name).cast("decimal(18,6)")) / F.nullif(F.count(name), F.lit(0))
        return half_up(exact, 1).cast("double")

    return submissions.agg(*_outcomes(), mean("akb_score").alias("avg_akb"), mean("age").alias("avg_age"))


def label_distribution(df: DataFrame, label: str = "target") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("rows"))


def run_summary(decisions: DataFrame) -> DataFrame:
    return decisions.agg(*_outcomes())


def recent_submissions(submissions: DataFrame, limit: int = 200) -> DataFrame:
    """The newest submissions. Order and limit become one top-k per task, merged at the end."""
    newest = submissions.orderBy(F.col("submitted_at").desc_nulls_first(), F.col("id").desc()).limit(limit)
    return newest.select(
        "name", "surname", "date_of_birth", "age", "akb_score", "akb_letter_grade", "decision", "decision_type",
        "user_id", "submitted_at",
    )


def scored_points(submissions: DataFrame) -> DataFrame:
    return submissions.dropna(subset=["akb_score", "age"])


def risk_points(submissions: DataFrame, limit: int = 500) -> DataFrame:
    newest = scored_points(submissions).orderBy(F.col("submitted_at").desc_nulls_first(), F.col("id").desc())
    named = full_name(F.col("name"), F.col("surname")).alias("name")
    return newest.limit(limit).select("akb_score", "age", "decision", named)


def top_decisions(decisions: DataFrame, limit: int = 50) -> DataFrame:
    """Highest probability first; NULL counts as highest, as in a descending SQL sort with NULLS FIRST."""
    return decisions.orderBy(F.col("ml_probability").desc_nulls_first(), "user_id").limit(limit)


def approved_by_probability(decisions: DataFrame) -> DataFrame:
    return decisions.where(APPROVED).orderBy(F.col("ml_probability").desc_nulls_first(), "user_id")


def rejected_by_probability(decisions: DataFrame) -> DataFrame:
    return decisions.where(NOT_APPROVED).orderBy(F.col("ml_probability").asc_nulls_last(), "user_id")


def append_rows(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both, columns aligned by name, NULL where one side lacks a column."""
    return existing.unionByName(new, allowMissingColumns=True)
