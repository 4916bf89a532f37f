"""What the physical plans must look like: pruned and filtered scans, no repeated shuffle, no window per user."""

import re

import pytest

from loanloom import fixtures
from loanloom.operators import aggregates, latest, reports
from loanloom.plans import features
from loanloom.session import fresh_path

FOLDER = "/root/testdata/sf0.001"
NOW = "2024-01-31 00:00:00"


@pytest.fixture(scope="module")
def stored(spark):
    """The derived tables written as parquet, as ingestion leaves them."""
    folder = fresh_path(spark, "stored")
    names = [*features.CreditTables.__dataclass_fields__, "customer_submissions"]
    for name in names:
        fixtures.view(spark, FOLDER, name).write.parquet(f"{folder}/{name}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


@pytest.fixture
def sort_merge(spark):
    """Plans as for tables too large to broadcast, before run-time changes."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_score_scan_reads_needed_columns_and_pushes_the_filter(stored):
    text = plan(latest.latest_score(stored["akb_scores"], ["akb_score"]))
    assert "EqualTo(is_successful,true)" in text
    read = re.search(r"FileScan parquet \[([^\]]*)\]", text).group(1)
    assert {c.split("#")[0] for c in read.split(",")} == {
        "id", "timestamp", "user_id", "is_successful", "response_score_point"}


def test_latest_record_needs_no_window(stored):
    text = plan(latest.latest_history(stored["akb_history_summary"]))
    assert "Window" not in text and "partial_max_by" in text


def test_states_shrink_before_the_join(stored, sort_merge):
    lines = plan(aggregates.states_per_user(stored["loan_states"], stored["loans"])).splitlines()
    depth = lambda line: re.search(r"[A-Z]", line.replace("*", "").lstrip("(0123456789) :+-")) and len(line) - len(line.lstrip(" :+-"))
    join = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
    below = [line for line in lines[join + 1:] if "HashAggregate(keys=[loan_id" in line]
    assert len(below) == 2 and all(depth(line) > depth(lines[join]) for line in below)


def test_feature_assembly_shuffles_each_part_once(stored, sort_merge):
    tables = features.CreditTables(**{n: stored[n] for n in features.CreditTables.__dataclass_fields__})
    text = plan(features.assembled(tables))
    # loans, actions, states, cards, score, history; payments and documents twice; the users with all columns
    # and twice as ids alone, the questionnaires and their distinct keys, and both halves of the fan-out together
    moved = [line for line in text.splitlines() if "Exchange hashpartitioning(user_id" in line and "Reused" not in line]
    print(len(moved), text.count("SortMergeJoin"))
    assert len(moved) <= 16
    assert text.count("SortMergeJoin") == 12 and "Window" not in text and "Broadcast" not in text


def test_recent_rows_reach_the_scan_and_top_lists_sort_no_table(stored):
    assert "GreaterThan(submitted_at" in plan(reports.daily_submissions(stored["customer_submissions"], NOW))
    assert "TakeOrderedAndProject" in plan(reports.recent_submissions(stored["customer_submissions"]))


def test_batch_aggregates_stay_in_generated_code(stored, sort_merge):
    text = plan(aggregates.loans_per_user(stored["loans"]))
    assert text.count("*(") >= 3 and "SortAggregate" not in text
