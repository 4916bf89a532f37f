"""Credit tables derived from the sample tables, for checks and the benchmark.

Each view is a projection over one sample table (or one join), kept as text that Spark and DuckDB
read alike, so operators run on the same input in both. No view drops a row: records that should
not belong to a known customer go to a `guest-` id instead, which makes left joins meet NULLs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from loanloom.sources import schemas
from loanloom.sources.ingest import RENAMED

AS_OF = "2024-01-31 00:00:00"


@dataclass(frozen=True)
class View:
    source: str
    columns: tuple[str, ...]
    repeat: str | None = None  # rows 0..repeat per source row, numbered `n`
    join: tuple[str, str, str] | None = None  # (other source, left key, right key)
    prepare: tuple[str, ...] = ()  # extra columns the final projection refers to


def _customer_or_guest(key: str, every: int) -> str:
    return (
        f"CASE WHEN {key} % {every} = 0 THEN concat('guest-', CAST({key} AS STRING)) "
        f"ELSE CAST({key} AS STRING) END AS user_id"
    )


VIEWS: dict[str, View] = {
    "users": View("customer", (
        "CAST(c_custkey AS STRING) AS id",
        "lower(c_name) AS login",
        "'az' AS locale",
        "CAST(c_custkey % 101 AS BIGINT) AS questionnaire_completion",
        "CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE CAST(c_custkey % 5 AS INT) END AS loans_paid",
    )),
    "questionnaires": View("customer", (
        "c_custkey AS id",
        _customer_or_guest("c_custkey", 23),
        "CASE WHEN c_custkey % 2 = 0 THEN 'male' WHEN c_custkey % 7 = 0 THEN NULL ELSE 'female' END AS sex",
        "CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE "
        "CAST(DATE '1960-02-29' + CAST(((c_custkey * 7919) % 18500) AS INT) AS DATE) END AS birth_date",
        "CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(c_acctbal AS DECIMAL(15,2)) END AS monthly_income",
        "CAST((c_custkey * 37) % 4000 AS DECIMAL(15,2)) AS monthly_expenses",
        "CASE WHEN c_custkey % 4 = 0 THEN CAST(c_nationkey * 10 AS DECIMAL(15,2)) END AS additional_income",
        "CASE WHEN c_custkey % 9 = 0 THEN 'OTHER' ELSE 'AZ' END AS citizenship",
        "concat('region-', CAST(c_nationkey AS STRING)) AS registration_region",
        "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(c_custkey % 4 AS SMALLINT) END AS marital_status",
        "CASE WHEN c_custkey % 50 = 1 THEN TRUE WHEN c_custkey % 5 = 2 THEN NULL ELSE FALSE END AS is_pep",
        "c_custkey % 70 = 3 AS is_beneficial_owner",
        "c_custkey % 90 = 4 AS is_related_to_pep",
    )),
    "loans": View("orders", (
        "CAST(o_orderkey AS STRING) AS id",
        _customer_or_guest("o_custkey", 10),
        "CAST(floor(o_totalprice) AS BIGINT) AS amount",
        "6 * CAST(substr(o_orderpriority, 1, 1) AS INT) AS term",
        "CASE WHEN o_orderstatus = 'F' THEN 'paid' WHEN o_orderstatus = 'O' THEN 'active' "
        "WHEN o_orderkey % 20 = 0 THEN 'written_off' WHEN o_orderkey % 4 = 0 THEN 'overdue' "
        "ELSE 'approved' END AS tag",
        "o_orderdate AS created",
    )),
    "loan_states": View("lineitem", (
        "l_orderkey * 10 + l_linenumber AS id",
        "CAST(l_orderkey AS STRING) AS loan_id",
        "l_shipdate AS created",
        "l_shipdate - INTERVAL '1' DAY * CAST(CASE WHEN l_orderkey % 211 = 0 THEN 45 "
        "ELSE (l_orderkey * 7 + l_linenumber * 13) % 60 - 35 END AS INT) AS target_date",
        "CAST(l_extendedprice * l_tax AS DECIMAL(15,4)) AS overdue_interest",
        "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(15,4)) AS debt",
        "CASE WHEN l_returnflag = 'R' THEN 'payment' WHEN l_returnflag = 'A' THEN 'accrual' "
        "ELSE 'disbursement' END AS transaction_type",
    )),
    "loan_actions": View("orders", (
        "o_orderkey * 4 + n AS id",
        "CAST(o_orderkey AS STRING) AS loan_id",
        _customer_or_guest("o_custkey", 10),
        "CASE n WHEN 0 THEN 'in_review' WHEN 1 THEN 'approved' WHEN 2 THEN 'active' "
        "ELSE CASE WHEN o_orderkey % 20 = 0 THEN 'written_off' ELSE 'paid' END END AS tag",
        "o_orderdate + INTERVAL '1' DAY * CAST(n AS INT) AS created",
    ), repeat="o_orderkey % 4"),
    "payments": View("events", (
        "CAST(event_id AS STRING) AS id",
        "CAST(user_id AS STRING) AS user_id",
        "CAST(value AS DECIMAL(15,2)) AS amount",
        "CASE event_type WHEN 'error' THEN FALSE WHEN 'view' THEN NULL ELSE TRUE END AS is_successful",
        "ts AS created",
        "CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(event_id % 3 AS STRING) END AS card_id",
    )),
    "cards": View("customer", (
        "concat(CAST(c_custkey AS STRING), '-', CAST(n AS STRING)) AS id",
        _customer_or_guest("c_custkey", 8),
        "n = 0 AS is_main",
        "(c_custkey + n) % 3 = 0 AS is_for_disbursement",
        "(c_custkey + n) % 4 <> 0 AS is_verified",
        "CASE WHEN (c_custkey + n) % 5 = 0 THEN CAST('2024-01-15 00:00:00' AS {ntz}) END AS deleted",
    ), repeat="c_custkey % 3"),
    "akb_scores": View("orders", (
        "CAST(o_orderkey AS STRING) AS id",
        "o_orderdate AS timestamp",
        _customer_or_guest("o_custkey", 9),
        "o_orderpriority <> '5-LOW' AS is_successful",
        "CASE WHEN o_orderkey % 19 = 0 THEN 'inactive' ELSE 'active' END AS response_borrower_status",
        "CAST(o_orderkey % 2 AS SMALLINT) AS response_score_calculated",
        "CASE WHEN o_orderkey % 13 = 0 THEN NULL "
        "ELSE CAST((o_orderkey * 37) % 900 AS DECIMAL(8,2)) END AS response_score_point",
        "CASE WHEN (o_orderkey * 37) % 900 >= 825 THEN 'A' WHEN (o_orderkey * 37) % 900 >= 750 THEN 'B' "
        "WHEN (o_orderkey * 37) % 900 >= 600 THEN 'C' WHEN (o_orderkey * 37) % 900 >= 200 THEN 'D' "
        "ELSE 'E' END AS response_score_response",
        "CASE WHEN o_orderkey % 17 = 0 THEN CAST(1 AS SMALLINT) END AS response_score_exclusion",
    )),
    "akb_history_summary": View("orders", (
        "CAST(o_orderkey AS STRING) AS id",
        "o_orderdate AS timestamp",
        _customer_or_guest("o_custkey", 11),
        "o_orderkey % 6 <> 0 AS is_successful",
        "CAST((o_orderkey * 53) % 900 AS DECIMAL(8,2)) AS response_score_point",
        "CASE WHEN o_orderkey % 3 = 0 THEN NULL "
        "ELSE CAST(o_orderkey % 5000 AS DECIMAL(15,2)) END AS response_balance",
        "CAST(o_orderkey % 7 AS INT) AS liab_count",
        "CAST(floor(o_totalprice / 100) AS DECIMAL(15,2)) AS liab_outstanding_debt_main_sum",
        "CAST(o_orderkey % 300 AS DECIMAL(15,2)) AS liab_outstanding_debt_interest_sum",
        "CAST(CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 90 ELSE 0 END AS INT) AS liab_days_main_overdue_max",
        "CAST(CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 180 ELSE 0 END AS INT) AS liab_days_main_overdue_sum",
    )),
    "doc_front_all": View("lineitem", (
        _customer_or_guest("o_custkey", 5),
        "concat('doc-', CAST(l_linenumber AS STRING)) AS file_name",
        "l_shipdate AS created",
        "CAST(l_orderkey AS STRING) AS loan_id",
    ), join=("orders", "l_orderkey", "o_orderkey")),
    "customer_submissions": View("events", (
        "event_id AS id",
        "concat('Name', CAST(user_id AS STRING)) AS name",
        "CASE WHEN event_id % 2 = 0 THEN 'SURNAME' ELSE 'surname' END AS surname",
        "dob AS date_of_birth",
        "age",
        "score AS akb_score",
        "CASE WHEN score >= 825 THEN 'A' WHEN score >= 750 THEN 'B' WHEN score >= 600 THEN 'C' "
        "WHEN score >= 200 THEN 'D' WHEN score >= 0 THEN 'E' END AS akb_letter_grade",
        "CAST(user_id AS STRING) AS user_id",
        "ts AS submitted_at",
        "CASE WHEN age < 18 THEN 'REJECTED — Age is below 18' "
        "WHEN score IS NULL THEN 'REJECTED — AKB Score is empty' "
        "WHEN score < 300 THEN 'REJECTED — AKB Score too low' "
        "WHEN event_type = 'click' THEN 'REJECTED — High credit risk' ELSE 'APPROVED' END AS decision",
        "CASE WHEN age < 18 OR score IS NULL OR score < 300 THEN 'Hard Rules' "
        "ELSE 'XGBoost ML Model' END AS decision_type",
        "CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(user_id * 31 % 4000 AS DECIMAL(15,2)) END AS monthly_income",
        "CAST(event_id * 17 % 2500 AS DECIMAL(15,2)) AS monthly_expenses",
        "CAST(event_id * 13 % 3000 AS DECIMAL(15,2)) AS outstanding_debt",
        "CAST(event_id * 7 % 2000 AS DECIMAL(15,2)) AS overdue_amount",
        "event_type = 'error' AS has_overdue",
    ), prepare=(
        "CASE WHEN user_id % 29 = 0 THEN '01/06/2010' "
        "ELSE concat('15/03/', CAST(1960 + user_id % 40 AS STRING)) END AS dob",
        "CASE WHEN user_id % 29 = 0 THEN 13 ELSE CAST(2023 - (1960 + user_id % 40) AS INT) END AS age",
        "CASE WHEN event_type = 'view' THEN NULL ELSE CAST(floor(value * 20) % 900 AS DOUBLE) END AS score",
    )),
    # Applications to decide: every customer applies once, a third of them as existing customers.
    # Names match earlier submissions up to case; some birth dates are missing or unreadable.
    "applications": View("customer", (
        "c_custkey AS application_id",
        "CASE WHEN c_custkey % 3 = 0 THEN 'existing' ELSE 'new' END AS customer_type",
        "concat('NAME', CAST(c_custkey AS STRING)) AS name",
        "CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 'Surname' END AS surname",
        "CASE WHEN c_custkey % 37 = 0 THEN NULL WHEN c_custkey % 43 = 0 THEN '1990-01-01' "
        "WHEN c_custkey % 29 = 0 THEN '01/06/2010' "
        "ELSE concat('15/03/', CAST(1960 + c_custkey % 40 AS STRING)) END AS date_of_birth",
        "c_mktsegment AS residency",
        "CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 21 = 0 "
        "THEN concat('guest-', CAST(c_custkey AS STRING)) ELSE CAST(c_custkey AS STRING) END END AS user_id",
        "CASE WHEN c_custkey % 14 = 0 THEN NULL ELSE CAST((c_custkey * 53) % 900 AS DOUBLE) END AS akb_score",
        "CASE WHEN c_custkey % 14 = 0 THEN NULL WHEN (c_custkey * 53) % 900 >= 600 THEN 'C' "
        "ELSE 'D' END AS akb_letter_grade",
        "CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(floor(c_acctbal) AS DOUBLE) END AS monthly_income",
        "CAST((c_custkey * 37) % 4000 AS DOUBLE) AS monthly_expenses",
        "CAST((c_custkey * 91) % 5000 AS DOUBLE) AS outstanding_debt",
        "CAST((c_custkey * 7) % 2000 AS DOUBLE) AS overdue_amount",
        "c_custkey % 5 = 1 AS has_overdue",
        "CAST('2024-01-30 00:00:00' AS {ntz}) + INTERVAL '1' MINUTE * CAST(c_custkey % 1440 AS INT) AS submitted_at",
    )),
    # A fixed prediction table: stands in for a fitted model where a check must be exact.
    "predictions": View("customer", (
        "CAST(c_custkey AS STRING) AS user_id",
        "CAST((c_custkey * 7919) % 1000 AS DOUBLE) / 1000 AS probability",
        "CASE WHEN (c_custkey * 7919) % 1000 >= 500 THEN 1 ELSE 0 END AS prediction",
        "CASE WHEN (c_custkey * 7919 + c_nationkey * 31) % 1000 >= 450 THEN 1 ELSE 0 END AS target",
    )),
    # Source sheets as they arrive: original column names, every value as text or a float code.
    "raw_users": View("customer", (
        'CAST(c_custkey AS STRING) AS {q}Id{q}',
        'lower(c_name) AS {q}Login{q}',
        'CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE CAST(c_custkey % 2 AS DOUBLE) END AS {q}EmailConfirmed{q}',
        "CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE 'az' END AS {q}Locale{q}",
        "CASE WHEN c_custkey % 4 = 0 THEN '2023-05-06 07:08:09' WHEN c_custkey % 4 = 1 THEN 'never' END AS {q}Disabled{q}",
        "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(c_custkey % 5 AS DOUBLE) END AS {q}LoansPaid{q}",
        "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(c_custkey % 101 AS DOUBLE) END AS {q}QuestionnaireCompletion{q}",
    )),
    "raw_questionnaires": View("customer", (
        'c_custkey AS {q}Id{q}',
        'CAST(c_custkey AS STRING) AS {q}UserId{q}',
        "CASE WHEN c_custkey % 8 = 0 THEN 'unknown' WHEN c_custkey % 8 = 1 THEN NULL "
        "WHEN c_custkey % 8 = 2 THEN concat('19', CAST(60 + c_custkey % 40 AS STRING), '-02-30') "
        "ELSE concat('19', CAST(60 + c_custkey % 40 AS STRING), '-03-15') END AS {q}BirthDate{q}",
        "CASE WHEN c_custkey % 6 = 0 THEN 'n/a' ELSE CAST(c_custkey % 4000 AS STRING) END AS {q}MonthlyIncome{q}",
        'CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE CAST(c_custkey % 4 AS DOUBLE) END AS {q}IsPEP{q}',
        'CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(c_custkey % 4 AS DOUBLE) END AS {q}MaritalStatus{q}',
    )),
    "raw_akb_scores": View("orders", (
        'CAST(o_orderkey AS STRING) AS {q}id{q}',
        "CASE WHEN o_orderkey % 25 = 0 THEN 'bad' ELSE concat('2024-01-', "
        "CASE WHEN o_orderkey % 28 < 9 THEN '0' ELSE '' END, CAST(o_orderkey % 28 + 1 AS STRING), ' 10:20:30') END "
        "AS {q}@timestamp{q}",
        'CAST(o_custkey AS STRING) AS {q}userId{q}',
        "o_orderpriority <> '5-LOW' AS {q}isSuccessful{q}",
        'CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey AS DOUBLE) END AS {q}response.reportId{q}',
        'CAST((o_orderkey * 37) % 900 AS DECIMAL(8,2)) AS {q}response.score.point{q}',
        'CASE WHEN o_orderkey % 17 = 0 THEN CAST(1 AS SMALLINT) END AS {q}response.score.scoreExclusion{q}',
    )),
}


#: The sample table and the number each row of a source sheet is derived from.
SHEET_SOURCES = {
    "users": ("customer", "c_custkey"), "questionnaires": ("customer", "c_custkey"), "loans": ("orders", "o_orderkey"),
    "loan_states": ("lineitem", "l_orderkey * 10 + l_linenumber"), "loan_conditions": ("orders", "o_orderkey"),
    "credit_products": ("part", "p_partkey"), "credit_intervals": ("part", "p_partkey"), "loan_actions": ("orders", "o_orderkey"),
    "payments": ("events", "event_id"), "cards": ("customer", "c_custkey"), "akb_scores": ("orders", "o_orderkey"),
    "akb_history_summary": ("orders", "o_orderkey"), "akb_liabilities": ("lineitem", "l_orderkey * 10 + l_linenumber"),
    "doc_front_all": ("lineitem", "l_orderkey * 10 + l_linenumber"), "doc_front_last_per_user": ("customer", "c_custkey"),
}


def source_name(table: str, column: str) -> str:
    """A column's name in its source sheet: `UserId`, `IsPEP`, `@timestamp`, `response.reportId`."""
    if table.startswith("akb_"):
        renamed = {name: source for source, name in RENAMED.items()}
        if column in renamed:
            return renamed[column]
        head, _, rest = column.partition("_")
        if column == "timestamp":
            return "@timestamp"
        return f"{head}.{_camel(rest)}" if head in ("request", "response") and rest else _camel(column)
    return "".join(part.upper() if part in ("pin", "pep") else part.capitalize() for part in column.split("_"))


def _camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(part.capitalize() for part in rest)


def _sheet(table: str) -> View:
    """A source sheet with every declared column as text; 1 value in 103 is missing, 1 in 101 does not fit its column."""
    source, key = SHEET_SOURCES[table]
    columns = []
    for place, column in enumerate(schemas.columns(table)):
        good, bad = _cell(table, column, f"({key})")
        odd = f"WHEN ({key} + {place}) % 101 = 0 THEN {bad} " if bad else ""
        columns.append(f"CASE WHEN ({key} + {place}) % 103 = 0 THEN NULL {odd}ELSE {good} END AS {{q}}{source_name(table, column.name)}{{q}}")
    return View(source, tuple(columns))


def _cell(table: str, column: schemas.SourceColumn, key: str) -> tuple[str, str | None]:
    """SQL of a fitting and of an unfitting text of a column."""
    def some(n: int) -> str:
        return f"CAST({key} % {n} AS STRING)"

    def listed(by_table: dict) -> bool:
        return column.name in by_table.get(table, ())

    if listed(schemas.TRI_STATE) or listed(schemas.TRUTHY):
        return f"concat({some(2)}, '.0')", "'perhaps'"
    if listed(schemas.NULLABLE_INTEGERS):
        return f"concat({some(5)}, '.0')", "'n/a'"
    if column.type == "boolean":
        return f"CASE WHEN {key} % 3 = 0 THEN 'true' ELSE 'false' END", "'perhaps'"
    if column.type == "timestamp_ntz":
        return f"concat('2023-05-1', {some(10)}, ' 07:08:09')", "'never'"
    if column.type == "date":
        return f"concat('199', {some(10)}, '-02-03')", "'unknown'"
    if column.type.startswith("decimal"):
        return f"concat({some(900)}, '.25')", "'n/a'"
    if column.type in ("bigint", "int", "smallint"):
        return some(1000), "'n/a'"
    if column.length:
        return f"concat('v', {some(90)})", f"repeat('x', {column.length + 1})"
    return f"concat('{column.name} ', {some(50)})", None


VIEWS.update({f"sheet_{table}": _sheet(table) for table in SHEET_SOURCES})

_SCHEMAS: dict[str, StructType] = {}


def sample(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A given table. Its schema is read from the file once, not at every use."""
    path = f"{folder}/{table}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def view(spark: SparkSession, folder: str, name: str, read=sample) -> DataFrame:
    """One derived table as a lazy DataFrame; `read` may open the sample table as a stream instead."""
    spec = VIEWS[name]
    df = read(spark, folder, spec.source)
    if spec.join:
        other, left, right = spec.join
        df = df.join(read(spark, folder, other), F.col(left) == F.col(right))
    if spec.repeat:
        df = df.selectExpr("*", f"explode(sequence(0, CAST({spec.repeat} AS INT))) AS n")
    if spec.prepare:
        df = df.selectExpr("*", *spec.prepare)
    columns = [F.expr(c.format(q="`", ntz="TIMESTAMP_NTZ")) for c in spec.columns]
    if len(columns) > ONE_METHOD:
        columns[-1] = _out_of_line(columns[-1], df.select(columns[-1]).columns[0])
    return df.select(*columns)


#: Columns of this number are still one generated method that the JVM compiles.
ONE_METHOD = 16


def _out_of_line(column: Column, name: str) -> Column:
    """The same value by an expression that keeps its projection out of whole-stage code.

    There all columns become one method, which beyond 8,000 bytes the JVM interprets for good: four times the time for
    32 columns. Outside of it Spark splits the projection into methods.
    """
    return F.element_at(F.transform(F.array(column), lambda value: value), 1).alias(name)


def views(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: view(spark, folder, name) for name in names}
