"""Every registered query against its SQL on the smallest sample."""

import os

import pytest

import __spark_entry__ as entry
from checks import all_checks
from checks.run import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = all_checks()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables not there")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(name, spark, duck):
    outcome, rows = compare(spark, duck, FOLDER, QUERIES[name], SQL.get(name))
    assert outcome in ("ok", "rows only")
    assert rows > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_only_fitted_models_lack_sql():
    assert {n for n in QUERIES if n not in SQL} == {
        "m5_training", "m6_prediction", "m7_importances", "m9_evaluation", "m9_evaluation_without_target_inputs"}


def test_entry_decides_every_customer(spark):
    decided = entry.entry(spark)
    assert decided.columns == "user_id date_of_birth age akb_score akb_grade decision decision_type ml_score".split()
    assert decided.count() == spark.read.parquet(f"{FOLDER}/customer.parquet").count()
