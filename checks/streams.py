"""Checks of the streaming jobs: each runs to the end of its input and is read back from files."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.decide import offer_columns, reasons_text
from checks.parts import PARTS, flags_sql, r6
from checks.registry import check
from checks.relational import BANDS, NOW, OUTCOMES
from loanloom import fixtures
from loanloom.fixtures import AS_OF
from loanloom.operators import aggregates
from loanloom.plans import features
from loanloom.session import fresh_path, materialise
from loanloom.streaming import applications as streams, dashboard, stateful


def _open(spark, folder, table):
    schema = fixtures.sample(spark, folder, table).schema
    return streams.read_stream(spark, folder, schema, pattern=f"{table}.parquet")


def _stream(t, name):
    return fixtures.view(t.spark, t.folder, name, read=_open)


def _to_files(t, stream, name):
    path = fresh_path(t.spark, name)
    streams.write_files(stream, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{path}/rows")


@check(f"""SELECT application_id, a.years AS age, {r6('ml_score')}, CASE WHEN hard_decision <> 'PASSED' THEN hard_decision
             WHEN ml_score >= 50 THEN 'APPROVED' ELSE 'REJECTED — High credit risk' END AS decision, l.total_loans
           FROM scored_applications a LEFT JOIN loan_totals l ON l.user_id = a.user_id""")
def r1_decision_stream(t):
    """The scorecard for every application, as its SQL says; r1_decisions_by_type has the answers by customer_type."""
    known = aggregates.loans_per_user(t.loans).select("user_id", "total_loans")
    decided = streams.decisions(_stream(t, "applications"), known, AS_OF)
    rows = _to_files(t, decided, "decisions")
    return rows.select("application_id", "age", "ml_score", "decision", "total_loans")


@check("SELECT * EXCLUDE (identified) FROM answers")
def r1_decisions_by_type(t):
    asked = t.applications.where("customer_type = 'existing' AND user_id IS NOT NULL").select("user_id").distinct()
    known = materialise(features.online_features(t.credit, AS_OF, user_ids=asked))
    decided = streams.decisions_by_type(
        _stream(t, "applications"), lambda: t.customer_submissions, t.users, t.questionnaires, known, t.predictions, AS_OF)
    return _to_files(t, decided, "answers").select(
        "application_id", "customer_type", "already_exists", "existing_user_id", "decision_error", "age", "decision",
        "decision_type", "ml_score", reasons_text().alias("reasons"), F.array_join("fraud_flags", " | ").alias("fraud_flags"),
        *offer_columns())


@check("SELECT DISTINCT lower(name) AS name, lower(surname) AS surname, date_of_birth FROM customer_submissions")
def r2_first_applications(t):
    rows = _to_files(t, streams.first_applications(_stream(t, "customer_submissions")), "first")
    return rows.select(F.lower("name").alias("name"), F.lower("surname").alias("surname"), "date_of_birth").distinct()


PARTS["timed_submissions"] = """
    SELECT *, concat_ws('|', lower(name), lower(surname), date_of_birth) AS who FROM customer_submissions"""
PARTS["next_submissions"] = """
    SELECT DISTINCT who, submitted_at, min(submitted_at) OVER (PARTITION BY who ORDER BY submitted_at
      RANGE BETWEEN INTERVAL '24 hours' FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM timed_submissions"""


@check("""SELECT who, submitted_at FROM (
            WITH RECURSIVE kept AS (
              SELECT who, min(submitted_at) AS submitted_at FROM timed_submissions GROUP BY who
              UNION ALL SELECT k.who, n.following FROM kept k JOIN next_submissions n ON n.who = k.who AND n.submitted_at = k.submitted_at
                WHERE n.following IS NOT NULL)
            SELECT * FROM kept) x""")
def r2_kept_applications(t):
    """Every kept application, where r2_first_applications compares the identities only."""
    rows = _to_files(t, streams.first_applications(_stream(t, "customer_submissions")), "kept")
    who = F.concat_ws("|", F.lower("name"), F.lower("surname"), "date_of_birth")
    return rows.select(who.alias("who"), "submitted_at")


PARTS["hour_windows"] = """
    SELECT lower(name) AS name, lower(surname) AS surname, date_of_birth, start, count(*) AS n, min(akb_score) AS low, max(akb_score) AS high
    FROM (SELECT *, date_trunc('hour', submitted_at) - INTERVAL '1 hour' * h AS start
          FROM (SELECT *, unnest(range(0, 24)) AS h FROM customer_submissions) x) y
    WHERE start + INTERVAL '24 hours' <= (SELECT max(submitted_at) FROM customer_submissions) - INTERVAL '1 hour' GROUP BY 1, 2, 3, 4"""


@check(f"""SELECT name, count(*) AS windows, max(n) AS busiest, {r6('max(high - low)', 'widest')},
           min(start) AS first_start, max(start) AS last_start FROM hour_windows GROUP BY name""")
def r3_hourly_velocity(t):
    rows = _to_files(t, streams.hourly_velocity(_stream(t, "customer_submissions")), "velocity")
    return rows.groupBy("name").agg(
        F.count("*").alias("windows"), F.max("recent_count").alias("busiest"),
        F.max(F.col("recent_high") - F.col("recent_low")).alias("widest"),
        F.min("window.start").alias("first_start"), F.max("window.start").alias("last_start"))


@check(f"""SELECT name, surname, date_of_birth, start, n AS recent_count, concat_ws(' | ',
             CASE WHEN n >= 3 THEN 'Multiple submissions in 24 hours' END,
             CASE WHEN high - low > 100 THEN 'AKB score varies significantly across submissions' END) AS fraud_flags
           FROM hour_windows""")
def r3_hourly_flags(t):
    rows = _to_files(t, streams.hourly_velocity(_stream(t, "customer_submissions")), "hourly-flags")
    return rows.select(
        "name", "surname", "date_of_birth", F.col("window.start").alias("start"), "recent_count",
        F.array_join("fraud_flags", " | ").alias("fraud_flags"))


@check(f"""SELECT s.id, recent_count, {flags_sql('s.akb_score')} AS fraud_flags
           FROM customer_submissions s JOIN recent_submissions_24h r ON r.id = s.id""")
def r3_exact_velocity(t):
    path = fresh_path(t.spark, "exact-velocity")
    write = streams.velocity_writer(f"{path}/rows", lambda: t.customer_submissions)
    streams.each_batch(_stream(t, "customer_submissions"), write, f"{path}/checkpoint").awaitTermination()
    rows = t.spark.read.parquet(f"{path}/rows")
    return rows.select("id", "recent_count", F.array_join("fraud_flags", " | ").alias("fraud_flags"))


@check(f"""SELECT s.id, recent_count, {r6('recent_low')}, {r6('recent_high')}, {flags_sql('s.akb_score')} AS fraud_flags
           FROM customer_submissions s JOIN recent_submissions_24h r ON r.id = s.id
           WHERE name IS NOT NULL AND surname IS NOT NULL AND date_of_birth IS NOT NULL
             AND time_bucket(INTERVAL '10 minutes', s.submitted_at) + INTERVAL '10 minutes'
               <= (SELECT max(submitted_at) FROM customer_submissions) - INTERVAL '1 hour'""")
def r3_stateful_velocity(t):
    """All rows that the watermark has passed when the stream ends; operator state in place of the stored table."""
    stateful.use_rocksdb(t.spark)
    rows = _to_files(t, stateful.exact_velocity(_stream(t, "customer_submissions")), "stateful-velocity")
    return rows.select(F.col("id").cast(t.customer_submissions.schema["id"].dataType).alias("id"), "recent_count", "recent_low",
                       "recent_high", F.array_join("fraud_flags", " | ").alias("fraud_flags"))


@check("""SELECT CAST(submitted_at AS DATE) AS day, count(*) AS total, count(*) FILTER (WHERE decision = 'APPROVED') AS approved,
            count(*) FILTER (WHERE decision <> 'APPROVED') AS rejected
          FROM customer_submissions WHERE CAST(submitted_at AS DATE) + INTERVAL '1 day'
            <= (SELECT max(submitted_at) FROM customer_submissions) - INTERVAL '1 hour' GROUP BY 1""")
def r4_daily_totals(t):
    return _to_files(t, streams.daily_totals(_stream(t, "customer_submissions")), "daily")


@check("""SELECT id, decision, CASE WHEN contains(decision, 'APPROVED') THEN 'Approved' ELSE 'Rejected' END AS outcome
          FROM customer_submissions""")
def r5_split_decisions(t):
    path = fresh_path(t.spark, "split-stream")
    stream = _stream(t, "customer_submissions").select("id", "decision")
    streams.each_batch(stream, streams.split_writer(f"{path}/rows"), f"{path}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{path}/rows").select("id", "decision", "outcome")


def _dashboard(t):
    """The dashboard's state after the stream of all submissions."""
    path = fresh_path(t.spark, "dashboard")
    streams.each_batch(_stream(t, "customer_submissions"), dashboard.dashboard_writer(f"{path}/state"), f"{path}/checkpoint").awaitTermination()
    return dashboard.read_current(t.spark, f"{path}/state")


@check(f"""SELECT CAST(submitted_at AS DATE) AS day, {OUTCOMES} FROM customer_submissions
           WHERE submitted_at > {NOW} - INTERVAL '14 days' GROUP BY 1""")
def a8_daily_by_batch(t):
    return dashboard.daily_submissions(_dashboard(t), AS_OF)


@check("SELECT decision, count(*) AS cnt FROM customer_submissions WHERE decision <> 'APPROVED' GROUP BY decision")
def a9_reasons_by_batch(t):
    return dashboard.rejection_reasons(_dashboard(t))


@check(f"SELECT {BANDS} AS grade_range, count(*) AS cnt FROM customer_submissions WHERE akb_score IS NOT NULL GROUP BY 1")
def a10_scores_by_batch(t):
    return dashboard.score_distribution(_dashboard(t))


@check(f"SELECT {OUTCOMES}, round(avg(akb_score), 1) AS avg_akb, round(avg(age), 1) AS avg_age FROM customer_submissions")
def a11_stats_by_batch(t):
    return dashboard.overall_stats(_dashboard(t))


@check(f"SELECT {OUTCOMES} FROM customer_submissions")
def a13_summary_by_batch(t):
    return dashboard.run_summary(_dashboard(t))
