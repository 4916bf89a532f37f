"""Checks of sources, ingestion and sinks. Written tables go to the session's shared folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from checks.parts import r6
from checks.registry import check
from checks.models import _sql
from checks.relational import batch_decisions
from loanloom.fixtures import AS_OF, SHEET_SOURCES, source_name
from loanloom.operators.aggregates import row_count
from loanloom.plans import decisions, features
from loanloom.session import fresh_path
from loanloom.sources import bucketed, ingest, readers, schemas, sinks


@check("""SELECT 'users' AS table_name, count(*) AS rows, count("Disabled") AS filled FROM raw_users
          UNION ALL SELECT 'questionnaires', count(*), count("BirthDate") FROM raw_questionnaires""")
def s1_workbook_scan(t):
    folder = fresh_path(t.spark, "workbook")
    sheets = {"User": t.raw_users, "Questionnaire": t.raw_questionnaires}
    for sheet, df in sheets.items():
        df.write.option("header", True).csv(f"{folder}/01_users-db/{sheet}.csv")
    tables = readers.read_workbook(t.spark, folder, "01_users-db")

    def counted(name: str, column: str):
        return tables[name].agg(F.count("*").alias("rows"), F.count(column).alias("filled")).select(
            F.lit(name).alias("table_name"), "rows", "filled")

    return counted("users", "Disabled").unionByName(counted("questionnaires", "BirthDate"))


@check("SELECT l_orderkey, l_shipdate FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25")
def s2_table_scan(t):
    df = readers.read_table(t.spark, f"{t.folder}/lineitem.parquet")
    return df.where("l_returnflag = 'R' AND l_quantity > 25").select("l_orderkey", "l_shipdate")


@check(f"SELECT user_id, age, total_loans, {r6('payment_success_rate')}, akb_grade FROM feat")
def s3_stored_features(t):
    path = fresh_path(t.spark, "customer_features")
    sinks.replace_table(features.customer_features(t.credit, AS_OF), path)
    stored = readers.read_features(t.spark, path)
    return stored.select("user_id", "age", "total_loans", "payment_success_rate", "akb_grade")


@check(f"""SELECT id, "@timestamp" AS timestamp, "userId" AS user_id, "isSuccessful" AS is_successful,
           {r6('"response.reportId"', 'response_report_id')}, {r6('"response.score.point"', 'response_score_point')},
           "response.score.scoreExclusion" AS response_score_exclusion FROM raw_akb_scores""")
def s4_canonical_names(t):
    return ingest.with_canonical_names(t.raw_akb_scores)


@check("""SELECT 'users' AS source, "Id" AS id, try_cast("Disabled" AS TIMESTAMP) AS parsed FROM raw_users
          UNION ALL SELECT 'questionnaires', CAST("Id" AS VARCHAR), CAST(try_cast("BirthDate" AS DATE) AS TIMESTAMP) FROM raw_questionnaires
          UNION ALL SELECT 'akb_scores', id, try_cast("@timestamp" AS TIMESTAMP) FROM raw_akb_scores""")
def s5_lenient_dates(t):
    def parsed(table: str, df, column):
        return ingest.typed(df, table).select(
            F.lit(table).alias("source"), F.col("id").cast("string").alias("id"),
            F.col(column).cast("timestamp_ntz").alias("parsed"))

    return (
        parsed("users", t.raw_users, "disabled")
        .unionByName(parsed("questionnaires", t.raw_questionnaires, "birth_date"))
        .unionByName(parsed("akb_scores", t.raw_akb_scores, "timestamp"))
    )


@check(f"""SELECT "Id" AS id, {r6('try_cast("MonthlyIncome" AS DECIMAL(15,2))', 'monthly_income')} FROM raw_questionnaires""")
def s6_lenient_numbers(t):
    return ingest.typed(t.raw_questionnaires, "questionnaires").select("id", "monthly_income")


@check("""SELECT "Id" AS id, CASE WHEN "IsPEP" = 0 THEN FALSE WHEN "IsPEP" = 1 THEN TRUE END AS is_pep FROM raw_questionnaires""")
def s7_tri_state(t):
    return ingest.typed(t.raw_questionnaires, "questionnaires").select("id", "is_pep")


@check("""SELECT "Id" AS id, coalesce("EmailConfirmed" <> 0, TRUE) AS email_confirmed FROM raw_users""")
def s8_truthy(t):
    return ingest.typed(t.raw_users, "users").select("id", "email_confirmed")


@check("""SELECT "Id" AS id, CAST("LoansPaid" AS BIGINT) AS loans_paid, CAST("QuestionnaireCompletion" AS BIGINT) AS questionnaire_completion
          FROM raw_users""")
def s9_nullable_integers(t):
    return ingest.typed(t.raw_users, "users").select("id", "loans_paid", "questionnaire_completion")


PRESENT = "id login email_confirmed locale disabled loans_paid questionnaire_completion".split()


@check("""SELECT "Id" AS id, CAST(coalesce("LoansPaid", 0) AS INT) AS loans_paid, coalesce("EmailConfirmed" <> 0, FALSE) AS email_confirmed,
          concat_ws(', ', CASE WHEN "Locale" IS NULL THEN 'locale: missing' END,
            CASE WHEN "Disabled" = 'never' THEN 'disabled: not a timestamp_ntz' END) AS violations FROM raw_users""")
def s10_conformance(t):
    declared = [c for c in schemas.columns("users") if c.name in PRESENT]
    checked = ingest.conformed(ingest.with_canonical_names(t.raw_users), "users", declared)
    return checked.select("id", "loans_paid", "email_confirmed", F.array_join("violations", ", ").alias("violations"))


@check("SELECT id, loan_id, user_id, tag, created FROM loan_actions UNION ALL SELECT id, loan_id, user_id, tag, created FROM loan_actions")
def s11_append_load(t):
    folder = fresh_path(t.spark, "append")
    for _ in range(2):
        ingest.ingest(t.loan_actions, "loan_actions", folder)
    return readers.read_stored(t.spark, folder, "loan_actions")


@check("""SELECT 'loan_actions' AS table_name, count(*) AS source_rows, count(*) AS loaded_rows, 'OK' AS status FROM loan_actions
          UNION ALL SELECT 'doc_front_last_per_user', count(*), count(*), 'OK' FROM doc_front_all
          UNION ALL SELECT 'users', count(*), 0, 'MISMATCH' FROM raw_users""")
def s12_reconciliation(t):
    # The raw users lack required columns, so every row is rejected and the counts differ.
    documents = t.doc_front_all.select("user_id", "file_name", "created")
    sources = {"loan_actions": t.loan_actions, "doc_front_last_per_user": documents, "users": t.raw_users}
    return ingest.ingest_all(sources, fresh_path(t.spark, "ingest"))


@check("SELECT count(*) AS rows FROM users")
def s13_replace_and_count(t):
    path = fresh_path(t.spark, "customer_decisions")
    decided = decisions.decide_all(t.users, t.questionnaires, t.akb_scores, t.predictions, AS_OF)
    sinks.replace_table(decided, path)
    return sinks.replace_table(decided, path)


@check("SELECT count(*) AS rows FROM users")
def s13_versioned_replace(t):
    path = fresh_path(t.spark, "customer_decisions")
    decided = decisions.decide_all(t.users, t.questionnaires, t.akb_scores, t.predictions, AS_OF)
    for _ in range(2):
        sinks.replace_versioned(decided, path)
    return row_count(sinks.read_current(t.spark, path))


@check(_sql(features.FEATURES_V3))
def s3_bucketed_features(t):
    """The features of m1_features_v3 from tables stored in buckets of their customer."""
    folder = fresh_path(t.spark, "bucketed")
    stored = bucketed.write_bucketed(t.credit, folder, f"bucketed_{folder[-12:]}", buckets=16)
    return features.build_features(stored, AS_OF)


SPLIT = "CASE WHEN contains(decision, 'APPROVED') THEN 'Approved' ELSE 'Rejected' END AS outcome"


@check(f"SELECT user_id, decision, {SPLIT} FROM batch_decisions")
def s14_split_sink(t):
    path = fresh_path(t.spark, "split")
    sinks.write_split(batch_decisions(t), path)
    return t.spark.read.parquet(path).select("user_id", "decision", "outcome")


@check(f"""SELECT name, decision, outcome FROM (
             SELECT name, decision, {SPLIT} FROM customer_submissions UNION ALL
             SELECT name, decision, {SPLIT} FROM (SELECT application_id, name, CASE WHEN hard_decision <> 'PASSED' THEN hard_decision
               WHEN ml_score >= 50 THEN 'APPROVED' ELSE 'REJECTED — High credit risk' END AS decision FROM scored_applications) s) u""")
def s15_append_to_split(t):
    path = fresh_path(t.spark, "report")
    sinks.write_split(t.customer_submissions.select("name", "decision"), path)
    sinks.write_split(decisions.scorecard_decisions(t.applications, AS_OF).select("name", "decision"), path, mode="append")
    return t.spark.read.parquet(path).select("name", "decision", "outcome")


@check("""SELECT name, surname, submitted_at FROM customer_submissions
          UNION ALL SELECT name, surname, submitted_at FROM applications WHERE customer_type = 'new'""")
def s16_append_submissions(t):
    path = fresh_path(t.spark, "submissions")
    sinks.append_rows_to(t.customer_submissions, path)
    columns = ["name", "surname", "submitted_at", "customer_type"]
    sinks.append_submissions(t.applications.select(*columns), path)
    return t.spark.read.parquet(path).select("name", "surname", "submitted_at")


# All 15 source sheets. Their SQL is put together from the declared columns.
DUCK_TYPES = {"string": "VARCHAR", "timestamp_ntz": "TIMESTAMP"}
LENIENT = [
    (schemas.LENIENT_TIMESTAMPS, "try_cast({0} AS TIMESTAMP)"), (schemas.LENIENT_DATES, "try_cast({0} AS DATE)"),
    (schemas.LENIENT_NUMBERS, "try_cast({0} AS DECIMAL(15,2))"),
    (schemas.TRI_STATE, "CASE {0} WHEN '1.0' THEN TRUE WHEN '0.0' THEN FALSE END"), (schemas.TRUTHY, "coalesce({0} <> '0.0', TRUE)"),
    (schemas.NULLABLE_INTEGERS, "CASE WHEN try_cast({0} AS DOUBLE) = floor(try_cast({0} AS DOUBLE)) THEN CAST(try_cast({0} AS DOUBLE) AS BIGINT) END"),
]


def _problems(table: str) -> list[tuple[str, str]]:
    """(violation, condition in SQL) of every rule of a table, in the order of its columns."""
    out = []
    for c in schemas.columns(table):
        raw = f'"{source_name(table, c.name)}"'
        parse = next((sql for by_table, sql in LENIENT if c.name in by_table.get(table, ())), None)
        source = parse.format(raw) if parse else raw
        if not parse:
            out.append((f"{c.name}: not a {c.type}", f"{raw} IS NOT NULL AND try_cast({raw} AS {DUCK_TYPES.get(c.type, c.type)}) IS NULL"))
        if c.length:
            out.append((f"{c.name}: longer than {c.length}", f"length({raw}) > {c.length}"))
        if c.required and c.default is None:
            out.append((f"{c.name}: missing", f"({source}) IS NULL"))
    return out


def _sheets(t) -> dict:
    return {table: getattr(t, f"sheet_{table}") for table in SHEET_SOURCES}


def _per_table(sql) -> str:
    return " UNION ALL ".join(f"({sql(table)})" for table in SHEET_SOURCES)


def _union(parts):
    return reduce(DataFrame.unionByName, parts)


def _names_sql(table: str, names: dict[str, str]) -> str:
    counts = ", ".join(f'count("{source}") AS "{name}"' for name, source in names.items())
    listed = ", ".join(f'"{name}"' for name in names)
    return f"SELECT '{table}' AS table_name, column_name, filled FROM (SELECT {counts} FROM sheet_{table}) UNPIVOT (filled FOR column_name IN ({listed}))"


def _filled(table: str, df):
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return counts.unpivot([], [f"`{c}`" for c in df.columns], "column_name", "filled").select(F.lit(table).alias("table_name"), "column_name", "filled")


@check(_per_table(lambda table: _names_sql(table, {n: n for n in [source_name(table, c.name) for c in schemas.columns(table)]})))
def s1_all_sheets(t):
    """Values per column of all 15 sheets, read back from CSV workbooks.

    As plain text the sheets take some 30 times the room of the sample tables. A compressed file is read by one task,
    so files end at a number of rows.
    """
    folder = fresh_path(t.spark, "workbooks")
    stored = {"header": True, "compression": "gzip", "maxRecordsPerFile": 500_000}
    for workbook, sheets in schemas.SHEETS.items():
        for sheet, table in sheets.items():
            getattr(t, f"sheet_{table}").write.options(**stored).csv(f"{folder}/{workbook}/{sheet}.csv")
    books = [readers.read_workbook(t.spark, folder, workbook) for workbook in schemas.SHEETS]
    return _union(_filled(table, df) for book in books for table, df in book.items())


@check(_per_table(lambda table: _names_sql(table, {c.name: source_name(table, c.name) for c in schemas.columns(table)})))
def s4_all_names(t):
    """Values per canonical column of all 15 sheets."""
    return _union(_filled(table, ingest.with_canonical_names(df)) for table, df in _sheets(t).items())


def _violations_sql(table: str) -> str:
    listed = ", ".join(f"CASE WHEN {condition} THEN '{text}' END" for text, condition in _problems(table))
    return f"SELECT '{table}' AS table_name, unnest(list_filter([{listed}], lambda v: v IS NOT NULL)) AS violation FROM sheet_{table}"


@check(f"SELECT table_name, violation, count(*) AS rows FROM ({_per_table(_violations_sql)}) v GROUP BY table_name, violation")
def s10_all_tables(t):
    """Rows per violation of every column of all 15 tables."""
    checked = {table: ingest.conformed(ingest.typed(df, table), table) for table, df in _sheets(t).items()}
    # From an inner explode, Spark infers a filter that would go through all rules a second time.
    found = _union(df.select(F.lit(table).alias("table_name"), F.explode_outer("violations").alias("violation")) for table, df in checked.items())
    return found.where("violation IS NOT NULL").groupBy("table_name", "violation").agg(F.count("*").alias("rows"))


def _reconciled_sql(table: str) -> str:
    bad = " OR ".join(f"coalesce({condition}, FALSE)" for _, condition in _problems(table))
    return f"""SELECT '{table}' AS table_name, count(*) AS source_rows, count(*) FILTER (NOT ({bad})) AS loaded_rows,
               CASE WHEN bool_or({bad}) THEN 'MISMATCH' ELSE 'OK' END AS status FROM sheet_{table}"""


@check(_per_table(_reconciled_sql))
def s12_all_tables(t):
    """All 15 sheets ingested and reconciled; rejected rows are the difference."""
    return ingest.ingest_all(_sheets(t), fresh_path(t.spark, "ingest-all"))
