"""Schemas, ingestion, sinks and readers."""

import pytest
from pyspark.sql import functions as F

from loanloom.session import fresh_path
from loanloom.sources import ingest, readers, schemas, sinks


def test_declared_tables():
    assert len(schemas.TABLE_TEXT) == 15
    assert sorted(t for sheets in schemas.SHEETS.values() for t in sheets.values()) == sorted(schemas.TABLE_TEXT)
    users = schemas.struct_type("users")
    assert users["loans_paid"].dataType.simpleString() == "int" and not users["id"].nullable and users["pin"].nullable
    assert schemas.struct_type("loan_states")["debt"].dataType.simpleString() == "decimal(15,4)"
    login, locale = schemas.columns("users")[1], schemas.columns("users")[6]
    assert (login.length, locale.length, schemas.columns("users")[12].default) == (None, 10, "0")


@pytest.mark.parametrize("source, name", [
    ("Id", "id"), ("PIN", "pin"), ("IsRelatedToPEP", "is_related_to_pep"), ("RelatedPEPFullName", "related_pep_full_name"),
    ("@timestamp", "timestamp"), ("response.borrower.dateOfBirth", "response_borrower_date_of_birth"), ("orgIDType", "org_id_type"),
    ("response.score.scoreExclusion", "response_score_exclusion"), ("liab_daysMainOverdue_max", "liab_days_main_overdue_max"),
])
def test_canonical_names(source, name):
    assert ingest.canonical_name(source) == name


def test_lenient_values(make):
    df = make("k int, v string", (0, "1"), (1, "0.0"), (2, "2"), (3, "True"), (4, None), (5, "x"), (6, ""))
    got = df.orderBy("k").select(ingest.tri_state(F.col("v")).alias("b"), ingest.truthy(F.col("v")).alias("t"),
                                 ingest.nullable_integer(F.col("v")).alias("i")).collect()
    assert [r.b for r in got] == [True, False, None, True, None, None, None]
    assert [r.t for r in got] == [True, False, True, True, True, True, False]
    assert [r.i for r in got] == [1, 0, 2, None, None, None, None]


def test_violations_are_named(make):
    df = make("id string, loan_id string, user_id string, tag string, created string",
              ("1", "L", "u", "paid", "2024-01-01 00:00:00"), ("x", "L", None, "t" * 51, "never"))
    good, bad = ingest.conformed(df, "loan_actions").orderBy(F.size("violations")).collect()
    assert good.violations == [] and good.id == 1
    assert bad.violations == ["id: not a bigint", "user_id: missing", "tag: longer than 50", "created: not a timestamp_ntz"]


def test_ingestion_round_trip(spark, make):
    df = make("Id string, LoanId string, UserId string, Tag string, Created string",
              ("1", "L", "u", "paid", "2024-01-01 00:00:00"), ("2", "L", None, "paid", "2024-01-01 00:00:00"))
    folder = fresh_path(spark, "round-trip")
    report = ingest.ingest_all({"loan_actions": df}, folder).first()
    assert (report.source_rows, report.loaded_rows, report.status) == (2, 1, "MISMATCH")
    assert readers.read_stored(spark, folder, "loan_actions").dtypes[0] == ("id", "bigint")
    assert readers.read_rejected(spark, folder, "loan_actions").first().violations == ["user_id: missing"]
    ingest.ingest(df, "loan_actions", folder)
    assert readers.read_stored(spark, folder, "loan_actions").count() == 2


def test_split_sink_appends(spark, make):
    path = fresh_path(spark, "split")
    sinks.write_split(make("k int, decision string", (1, "APPROVED"), (2, "REJECTED — x")), path)
    sinks.write_split(make("k int, decision string", (3, "REJECTED — y")), path, mode="append")
    got = {r.k: r.outcome for r in spark.read.parquet(path).collect()}
    assert got == {1: "Approved", 2: "Rejected", 3: "Rejected"}


def test_replace_counts_back_and_key_filter_reaches_the_scan(spark, make):
    path = fresh_path(spark, "features")
    sinks.replace_table(make("user_id string, v int", ("a", 1)), path)
    assert sinks.replace_table(make("user_id string, v int", ("a", 1), ("b", 2)), path).first().rows == 2
    one = readers.read_features(spark, path, "b")
    assert one.first().v == 2
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,b)]" in one._jdf.queryExecution().executedPlan().toString()


def test_only_new_customers_are_stored(spark, make):
    path = fresh_path(spark, "submissions")
    sinks.append_submissions(make("k int, customer_type string", (1, "new"), (2, "existing")), path)
    assert [r.k for r in spark.read.parquet(path).collect()] == [1]


def test_workbooks_of_all_sheets_are_stored_compressed(spark):
    import glob

    from checks import all_checks
    from loanloom.session import shared_folder

    def written():
        return set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/workbooks-*/*/*/part-*"))

    before = written()
    assert all_checks()[0]["s1_all_sheets"](spark, "/root/testdata/sf0.001").count() == 249
    new = written() - before
    assert len(new) >= 15 and all(name.endswith(".csv.gz") for name in new)


def test_rules_and_wide_sheets_run_as_compiled_code(spark, make):
    """A lambda has all rules interpreted; one method of 32 columns is too long for the JVM to compile."""
    from loanloom import fixtures
    from loanloom.sources import ingest, schemas

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    sheet = fixtures.view(spark, "/root/testdata/sf0.001", "sheet_akb_liabilities")
    assert "Project" in plan(sheet) and "*(1) Project" not in plan(sheet)
    assert "*(1) Project" in plan(fixtures.view(spark, "/root/testdata/sf0.001", "sheet_loan_states"))
    declared = [c for c in schemas.columns("loan_actions") if c.name in ("id", "loan_id", "tag")]
    rows = make("id string, loan_id string, tag string", ("1", "a", "b"), ("x", None, "t" * 51), (None, "a", None))
    checked = ingest.conformed(rows, "loan_actions", declared)
    assert "lambda" not in plan(checked)
    assert [r.violations for r in checked.collect()] == [
        [], ["id: not a bigint", "loan_id: missing", "tag: longer than 50"], ["id: missing", "tag: missing"]]
