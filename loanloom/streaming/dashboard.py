"""Dashboard figures that follow the stream: small mergeable sums in place of a scan of all submissions.

A batch shrinks to a few sums per minute, decision and score band. These are added to the sums so far and written as
the next version of a versioned table (`sinks.replace_versioned`), so readers see the state before or after a batch,
never between. A version's name ends with the batch it includes: a batch that comes again changes nothing. The cost of
a batch is that of its rows and of the state, which has a row per minute with submissions, decision text and band.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loanloom.functions.scalars import as_timestamp, calendar_day, count_if, half_up, score_band
from loanloom.operators.reports import APPROVED, NOT_APPROVED
from loanloom.sources.sinks import current_version, read_current, replace_versioned

SUMS = {"total": F.sum, "approved": F.sum, "rejected": F.sum, "akb_sum": F.sum, "akb_count": F.sum, "age_sum": F.sum,
        "age_count": F.sum, "lowest": F.min}
MONEY = "decimal(38,6)"


def partial_sums(submissions: DataFrame) -> DataFrame:
    """kind, day, minute, label and the sums of one batch. Four small aggregates of the same rows."""
    def exact(name: str) -> Column:
        return F.col(name).cast("decimal(18,6)")

    # A minute is open on the left, as "newer than" is, so that reports may begin at any whole minute.
    minute = F.date_trunc("minute", F.col("submitted_at") - F.expr("INTERVAL 1 MICROSECOND")).cast("timestamp_ntz")
    banded = F.when(F.col("akb_score").isNotNull(), score_band(F.col("akb_score")))
    kinds = F.array(*[
        F.struct(F.lit(kind).alias("kind"), day.cast("date").alias("day"), at.cast("timestamp_ntz").alias("minute"), label.cast("string").alias("label"))
        for kind, day, at, label in (
            ("minute", calendar_day(F.col("submitted_at")), minute, F.lit(None)),
            ("decision", F.lit(None), F.lit(None), F.col("decision")),
            ("band", F.lit(None), F.lit(None), banded),
            ("all", F.lit(None), F.lit(None), F.lit(None)))])
    rows = submissions.select(F.explode(kinds).alias("cell"), "decision", "akb_score", "age")
    return rows.groupBy("cell.kind", "cell.day", "cell.minute", "cell.label").agg(
        F.count("*").alias("total"), count_if(F.expr(APPROVED)).alias("approved"), count_if(F.expr(NOT_APPROVED)).alias("rejected"),
        F.sum(exact("akb_score")).cast(MONEY).alias("akb_sum"), F.count("akb_score").alias("akb_count"),
        F.sum(exact("age")).cast(MONEY).alias("age_sum"), F.count("age").alias("age_count"), F.min("akb_score").alias("lowest"))


def merged(*parts: DataFrame) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    sums = whole.groupBy("kind", "day", "minute", "label").agg(*[how(name).alias(name) for name, how in SUMS.items()])
    return sums.withColumns({name: F.col(name).cast(MONEY) for name in ("akb_sum", "age_sum")})


def last_batch(spark: SparkSession, path: str) -> int:
    """The last batch that the state includes, -1 before the first."""
    version = current_version(spark, path)
    return -1 if version is None else int(version.rsplit("-", 1)[1])


def dashboard_writer(path: str) -> Callable[[DataFrame, int], None]:
    """A batch function for `each_batch` that keeps the state below `path`."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = last_batch(spark, path)
        if batch_id > done:
            parts = [partial_sums(batch)] + ([read_current(spark, path)] if done >= 0 else [])
            # Coalesced: the state is small, and every version is read whole by the next batch.
            replace_versioned(merged(*parts).coalesce(1), path, version=f"batch-{batch_id}")

    return write


def daily_submissions(state: DataFrame, as_of, days: int = 14) -> DataFrame:
    """As `reports.daily_submissions`, for an `as_of` on a whole minute."""
    start = as_timestamp(as_of) - F.make_dt_interval(F.lit(days))
    recent = state.where((F.col("kind") == "minute") & (F.col("minute") >= start))
    return recent.groupBy("day").agg(*[F.sum(c).alias(c) for c in ("total", "approved", "rejected")]).orderBy("day")


def rejection_reasons(state: DataFrame) -> DataFrame:
    found = state.where((F.col("kind") == "decision") & (F.col("rejected") > 0))
    return found.select(F.col("label").alias("decision"), F.col("rejected").alias("cnt")).orderBy(F.col("cnt").desc(), "decision")


def score_distribution(state: DataFrame) -> DataFrame:
    found = state.where("kind = 'band' AND label IS NOT NULL").orderBy("lowest")
    return found.select(F.col("label").alias("grade_range"), F.col("total").alias("cnt"))


def overall_stats(state: DataFrame) -> DataFrame:
    def mean(name: str) -> Column:
        return half_up(F.col(f"{name}_sum") / F.nullif(F.col(f"{name}_count"), F.lit(0)), 1).cast("double")

    return state.where("kind = 'all'").select("total", "approved", "rejected", mean("akb").alias("avg_akb"), mean("age").alias("avg_age"))


def run_summary(state: DataFrame) -> DataFrame:
    """As `reports.run_summary`: the outcomes of everything decided so far."""
    return state.where("kind = 'all'").select("total", "approved", "rejected")
