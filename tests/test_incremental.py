"""Versioned tables, dashboards by batch, bucketed storage, pairs of applications and the login index."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from checks.registry import Tables
from loanloom.operators import joins, reports, velocity
from loanloom.plans import features
from loanloom.session import fresh_path
from loanloom.sources import bucketed, sinks
from loanloom.streaming import applications as streams, dashboard

FOLDER, NOW = "/root/testdata/sf0.001", "2024-01-31 00:00:00"
T0 = datetime(2024, 1, 17)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------------------------------------------ versioned tables

def test_readers_follow_the_pointer(spark, make):
    path = fresh_path(spark, "versions")
    assert sinks.current_version(spark, path) is None
    sinks.replace_versioned(make("k int", (1,), (2,)), path)
    before = sinks.read_current(spark, path)
    sinks.replace_versioned(make("k int", (3,)), path)
    # A reader that has begun keeps its version, a new one gets the next.
    assert sorted(r.k for r in before.collect()) == [1, 2]
    assert [r.k for r in sinks.read_current(spark, path).collect()] == [3]


def test_a_job_that_dies_leaves_the_old_table(spark, make):
    path = fresh_path(spark, "versions")
    sinks.replace_versioned(make("k int", (1,)), path)
    version = sinks.current_version(spark, path)
    broken = make("k int", (1,), (2,)).repartition(2).withColumn("k", F.when(F.col("k") == 2, F.raise_error("dies")).otherwise(F.col("k")).cast("int"))
    with pytest.raises(Exception, match="dies"):
        sinks.replace_versioned(broken, path)
    assert sinks.current_version(spark, path) == version
    assert [r.k for r in sinks.read_current(spark, path).collect()] == [1]


def test_old_versions_are_dropped(spark, make):
    path = fresh_path(spark, "versions")
    names = [sinks.replace_versioned(make("k int", (i,)), path) for i in range(5)]
    kept = os.listdir(path.removeprefix("file://") + "/versions")
    assert sorted(kept) == sorted(names[-2:]) and sinks.current_version(spark, path) == names[-1]
    assert not [f for f in os.listdir(path.removeprefix("file://")) if f.startswith(".current-") and not f.endswith(".crc")]


# ------------------------------------------------------------------------------------------------------ dashboards

SCHEMA = "id int, decision string, akb_score double, age int, submitted_at timestamp_ntz"


def submissions(seed, n):
    rng = random.Random(seed)
    edge = [T0, T0 + timedelta(microseconds=1), T0 - timedelta(microseconds=1), datetime(2024, 1, 30), None]
    return [(i, rng.choice(["APPROVED", "REJECTED — a", "REJECTED — b", None]), rng.choice([None, rng.randrange(9000) / 10]),
             rng.choice([None, rng.randrange(18, 80)]),
             rng.choice(edge) if i % 5 == 0 else T0 + timedelta(hours=rng.random() * 300)) for i in range(n)]


def same_reports(state, data):
    pairs = [(dashboard.daily_submissions(state, NOW), reports.daily_submissions(data, NOW)),
             (dashboard.rejection_reasons(state), reports.rejection_reasons(data)),
             (dashboard.score_distribution(state), reports.score_distribution(data)),
             (dashboard.overall_stats(state), reports.overall_stats(data))]
    return all(a.collect() == b.collect() for a, b in pairs)


@pytest.mark.parametrize("cuts", [[], [1], [10, 11, 100], [50, 50, 120]])
def test_any_split_into_batches(spark, make, cuts):
    rows = submissions(len(cuts), 150)
    path = fresh_path(spark, "dashboard")
    write = dashboard.dashboard_writer(path)
    for batch, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, 150])):
        for _ in range(1 + batch % 2):
            write(make(SCHEMA, *rows[lo:hi]), batch)
    assert same_reports(sinks.read_current(spark, path), make(SCHEMA, *rows))
    assert dashboard.last_batch(spark, path) == len(cuts)


def test_a_batch_that_comes_again_changes_nothing(spark, make):
    rows = submissions(9, 60)
    path = fresh_path(spark, "dashboard")
    write = dashboard.dashboard_writer(path)
    for batch_id, part in ((0, rows[:30]), (1, rows[30:]), (1, rows[30:]), (0, rows[:30])):
        write(make(SCHEMA, *part), batch_id)
    assert same_reports(sinks.read_current(spark, path), make(SCHEMA, *rows))


def test_a_batch_reads_its_rows_and_the_state_only(spark, make):
    rows = submissions(3, 2000)
    folder, path = fresh_path(spark, "in"), fresh_path(spark, "dashboard")
    for at in range(0, 2000, 500):
        make(SCHEMA, *rows[at:at + 500]).coalesce(1).write.mode("append").parquet(folder)
    stream = streams.read_stream(spark, folder, SCHEMA, files_per_batch=1)
    query = streams.each_batch(stream, dashboard.dashboard_writer(f"{path}/state"), f"{path}/checkpoint")
    query.awaitTermination()
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [500] * 4
    assert same_reports(sinks.read_current(spark, f"{path}/state"), make(SCHEMA, *rows))


# ------------------------------------------------------------------------------------------------ bucketed storage

@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, FOLDER).credit


@pytest.fixture(scope="module")
def buckets(spark, tables):
    folder = fresh_path(spark, "bucketed")
    return folder, bucketed.write_bucketed(tables, folder, "test_written", 6)


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


def test_features_need_no_exchange(tables, buckets, sort_merge):
    for policy in ("batch", "online"):
        text = plan(features.build_features(buckets[1], NOW, null_policy=policy))
        assert "Exchange" not in text and text.count("FileScan") >= 10
    assert plan(features.build_features(tables, NOW)).count("Exchange hashpartitioning(user_id") > 8


def test_same_features_as_from_the_plain_tables(tables, buckets):
    for policy in ("batch", "online"):
        got, want = (features.build_features(t, NOW, null_policy=policy).collect() for t in (buckets[1], tables))
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_one_customer_reads_one_bucket_after_attaching(spark, tables, buckets, sort_merge):
    attached = bucketed.attach_bucketed(spark, buckets[0], "test_attached", 6)
    one = features.build_features(bucketed.of_customer(attached, "7"), NOW)
    text = plan(one)
    assert text.count("SelectedBucketsCount: 1 out of 6") == text.count("FileScan") >= 10 and "Exchange" not in text
    whole = features.build_features(tables, NOW).where("user_id = '7'")
    assert sorted(map(str, one.collect())) == sorted(map(str, whole.collect())) and one.count() > 0


# ------------------------------------------------------------------------------------------- pairs of applications

PEOPLE = "id int, name string, surname string, date_of_birth string, akb_score double, submitted_at timestamp_ntz"


@pytest.mark.parametrize("part_rows", [3, 10_000])
def test_pairs_equal_the_plain_search(make, part_rows):
    rng = random.Random(1)
    rows = [(i, rng.choice(["Ann", "ANN", "bob", None, ""]), rng.choice(["S", None]), "1/1/1990", float(i),
             rng.choice([None, T0, T0 + timedelta(hours=24), T0 + timedelta(minutes=rng.randrange(6000))])) for i in range(160)]
    df = make(PEOPLE, *rows)
    got = sorted((r.id, r.matched_id) for r in velocity.application_pairs(df, df, key="id", part_rows=part_rows).collect())
    want = []
    for a in rows:
        for b in rows:
            known = None not in (b[1], b[2], b[5], a[5])
            if known and (a[1] or "").lower() == b[1].lower() and (a[2] or "").lower() == b[2].lower() and timedelta(0) <= a[5] - b[5] < timedelta(hours=24):
                want.append((a[0], b[0]))
    assert got == sorted(want) and len(got) > 200
    counts = velocity.trailing_activity(df, df).where("recent_count > 0").select("id", "recent_count").collect()
    assert sum(r.recent_count for r in counts) == len(got)


def test_pairs_are_joined_by_identity_and_cell(make):
    df = make(PEOPLE, (1, "A", "S", "x", 1.0, T0))
    text = plan(velocity.application_pairs(df, df, key="id"))
    assert "Cartesian" not in text and "NestedLoop" not in text and "_part" in text


# ----------------------------------------------------------------------------------------------------- login index

def test_index_finds_what_a_search_finds(make):
    rng = random.Random(2)
    logins = ["".join(rng.choice("abcÄ#1") for _ in range(rng.randrange(0, 9))) for _ in range(80)] + [None, "a", "ABCABC"]
    users = make("id string, login string", *[(f"u{i:03d}", login) for i, login in enumerate(logins)])
    names = ["", None, "a", "AB", "abc", "abca", "zz", "zzzz", "Ä", "c#1a"] + [x[1:6].upper() for x in logins if x and len(x) > 6]
    asked = make("k int, name string", *enumerate(names))
    for length in (1, 2, 3):
        postings = joins.login_postings(users, length)
        got = {r.k: r.matched_user_id for r in joins.users_by_index(postings, asked, length).collect()}
        plain = {r.k: r.matched_user_id for r in joins.users_by_name(users, asked).collect()}
        assert got == plain and len(got) == len(names)
        assert any(v for v in got.values()) and any(v is None for v in got.values())


def test_index_grows_with_the_letters(make):
    users = make("id string, login string", ("a", "".join(chr(0x4E00 + i) for i in range(1000))))
    assert joins.login_postings(users).count() == 1000 + 999 + 998
