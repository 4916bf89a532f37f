"""The jobs a user runs: feature table, training, batch scoring, export and dashboard."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from loanloom.operators import reports
from loanloom.plans import decisions, features, model
from loanloom.plans.features import CreditTables
from loanloom.session import materialise
from loanloom.sources.sinks import append_rows_to, replace_table, write_split


def build_customer_features(tables: CreditTables, as_of, path: str, columns=None) -> DataFrame:
    """Rewrites the stored feature table; returns its row count."""
    return replace_table(features.customer_features(tables, as_of, columns), path)


def train_model(
    tables: CreditTables, as_of, path: str, settings: model.Training = model.TRAINING_V3, version: int = 3
) -> tuple[PipelineModel, DataFrame]:
    """Builds the features, fits, stores the model; returns it with its report on test, train and all rows."""
    matrix = features.build_features(tables, as_of, version)
    fitted, report = model.train_and_evaluate(matrix, features.FEATURES[version], settings)
    model.save(fitted, path)
    return fitted, report


def score_customers(tables: CreditTables, fitted: PipelineModel | None, as_of, path: str) -> DataFrame:
    """Scores every customer from the source tables and rewrites the decision table; returns the totals.

    Features, model and rules are one plan: nothing is joined back and no row leaves the cluster.
    """
    scored = model.predict(features.build_features(tables, as_of), fitted)
    decided = decisions.score_all(scored, None, as_of)
    decided.write.mode("overwrite").parquet(path)
    return reports.run_summary(decided.sparkSession.read.parquet(path))


def score_stored_features(stored: DataFrame, fitted: PipelineModel | None, as_of, path: str) -> DataFrame:
    """Scores the stored feature table with a model fitted on its columns."""
    decided = decisions.score_all(model.predict(stored, fitted), None, as_of, variant="feature_table")
    decided.write.mode("overwrite").parquet(path)
    return reports.run_summary(decided.sparkSession.read.parquet(path))


def export_all(tables: CreditTables, fitted: PipelineModel | None, as_of, path: str) -> DataFrame:
    """Decides every customer with online features, written split by outcome; returns the totals."""
    scores = model.probabilities(features.online_features(tables, as_of), fitted) if fitted is not None else None
    decided = decisions.decide_all(tables.users, tables.questionnaires, tables.akb_scores, scores, as_of)
    write_split(decided, path)
    return reports.run_summary(decided.sparkSession.read.parquet(path))


def submit(
    applications: DataFrame, tables: CreditTables, submissions: DataFrame, fitted: PipelineModel | None, as_of,
    report_path: str, submissions_path: str, key: str = "application_id",
) -> DataFrame:
    """Decides a batch of applications, appends the answered ones to the split report and the new ones to the
    stored submissions; returns the answers, decided once and written to the shared folder.
    """
    asked = applications.where("user_id IS NOT NULL AND NOT customer_type <=> 'new'").select("user_id").distinct()
    known = features.online_features(tables, as_of, user_ids=asked)
    scores = model.probabilities(known, fitted) if fitted is not None else None
    answers = materialise(decisions.decide_submissions(
        applications, submissions, tables.users, tables.questionnaires, known, scores, as_of, key))
    answered = answers.where("decision IS NOT NULL")
    write_split(decisions.submission_record(answered), report_path, mode="append")
    append_rows_to(decisions.submission_record(answered.where(F.col("customer_type") == "new")), submissions_path)
    return answers


def analytics(submissions: DataFrame, as_of) -> dict[str, DataFrame]:
    """The dashboard's four reports."""
    return {
        "daily": reports.daily_submissions(submissions, as_of),
        "rejection_reasons": reports.rejection_reasons(submissions),
        "akb_distribution": reports.score_distribution(submissions),
        "stats": reports.overall_stats(submissions),
    }
