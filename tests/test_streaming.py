"""Streams over several files: what is finished equals the batch result; retries write nothing twice."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from checks.registry import Tables
from loanloom.fixtures import AS_OF
from loanloom.operators import velocity
from loanloom.plans import decisions, features
from loanloom.session import fresh_path
from loanloom.streaming import applications as streams

T0 = datetime(2024, 1, 1)
SCHEMA = "id int, name string, surname string, date_of_birth string, akb_score double, submitted_at timestamp_ntz, decision string"


@pytest.fixture
def arrivals(spark, make):
    """Three files of 40 submissions each, in event-time order."""
    data = [(i, f"N{i % 5}" if i % 2 else f"n{i % 5}", "S", "1/1/1990", float(i * 37 % 300), T0 + timedelta(hours=i),
             "APPROVED" if i % 3 else "REJECTED — x") for i in range(120)]
    folder = fresh_path(spark, "arrivals")
    for start in range(0, 120, 40):
        make(SCHEMA, *data[start:start + 40]).coalesce(1).write.mode("append").parquet(folder)
    return folder, make(SCHEMA, *data)


def run(spark, stream):
    path = fresh_path(spark, "out")
    streams.write_files(stream, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/rows")


def open_stream(spark, folder):
    return streams.read_stream(spark, folder, SCHEMA, files_per_batch=1)


def test_closed_days_equal_the_batch(spark, arrivals):
    folder, data = arrivals
    got = run(spark, streams.daily_totals(open_stream(spark, folder)))
    want = data.groupBy(F.to_date("submitted_at").alias("day")).agg(
        F.count("*").alias("total"), F.count_if(F.col("decision") == "APPROVED").alias("approved"),
        F.count_if(F.col("decision") != "APPROVED").alias("rejected")).where("day < DATE '2024-01-05'")
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 4


@pytest.mark.parametrize("most_parts", [1, 48])
def test_hourly_windows_keep_one_row_per_hour(spark, arrivals, monkeypatch, most_parts):
    """Windows that have closed, with one late row that counts and one too late; no state of 24 rows per submission."""
    folder, data = arrivals
    monkeypatch.setattr(streams, "MOST_PARTS", most_parts)
    late = [(200, "n0", "S", "1/1/1990", 999.0, T0 + timedelta(hours=h), "APPROVED") for h in (79, 20)]
    spark.createDataFrame(late, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    path = fresh_path(spark, "hourly")
    query = streams.write_files(streams.hourly_velocity(open_stream(spark, folder)), f"{path}/rows", f"{path}/checkpoint")
    query.awaitTermination()
    got = {(r.window.start, r.name): (r.recent_count, r.recent_low, r.recent_high, r.fraud_flags) for r in spark.read.parquet(f"{path}/rows").collect()}
    # Batches end at 39, 79 and 119 hours; the third closes windows up to 78 hours, so the last takes rows from there on.
    rows = [(r.name.lower(), r.submitted_at, r.akb_score) for r in data.collect()] + [("n0", late[0][5], 999.0)]
    want = {}
    for start in (T0 + timedelta(hours=h) for h in range(-23, 119 - 1 - 24 + 1)):
        for name in {n for n, *_ in rows}:
            scores = [s for n, at, s in rows if n == name and start <= at < start + timedelta(hours=24)
                      and (s < 999 or start + timedelta(hours=24) > T0 + timedelta(hours=78))]
            if scores:
                flags = [velocity.MANY_TEXT] * (len(scores) >= 3) + [velocity.GAP_TEXT] * (max(scores) - min(scores) > 100)
                want[start, name] = len(scores), min(scores), max(scores), flags
    assert got == want
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert 0 < max(states) <= 120


def test_first_application_per_identity_and_horizon(spark, arrivals):
    got = run(spark, streams.first_applications(open_stream(spark, arrivals[0]), "1000 hours"))
    assert got.count() == 5 and got.select("name").distinct().count() == 5


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_exact_velocity_equals_batch(spark, arrivals, zone):
    folder, data = arrivals
    spark.conf.set("spark.sql.session.timeZone", zone)
    path = fresh_path(spark, "velocity")
    query = streams.each_batch(open_stream(spark, folder), streams.velocity_writer(f"{path}/rows", lambda: data), f"{path}/checkpoint")
    query.awaitTermination()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    got = spark.read.parquet(f"{path}/rows").select("id", "recent_count", "fraud_flags")
    assert sorted(got.collect()) == sorted(velocity.fraud_flags(data, data).select("id", "recent_count", "fraud_flags").collect())


def test_a_retried_batch_is_written_once(spark, arrivals, make):
    path = fresh_path(spark, "split")
    write = streams.split_writer(path)
    batch = make("k int, decision string", (1, "APPROVED"), (2, "REJECTED — x"))
    write(batch, 0)
    write(batch, 0)
    write(make("k int, decision string", (3, "APPROVED")), 1)
    assert sorted((r.k, r.outcome) for r in spark.read.parquet(path).collect()) == [(1, "Approved"), (2, "Rejected"), (3, "Approved")]


@pytest.mark.parametrize("files_per_batch", [1, 1000])
def test_first_applications_hang_on_the_horizon_not_on_the_batches(spark, make, files_per_batch):
    hours = [("Ann", 0), ("ANN", 23), ("Ann", 24), ("ann", 40), ("Ann", 47), ("Ann", 48), ("Ann", 48 + 19 * 24), ("Bob", 30), ("Bob", 30 + 19 * 24)]
    data = [(i, n, "S", "1/1/1990", 1.0, T0 + timedelta(hours=h), "APPROVED") for i, (n, h) in enumerate(hours)]
    data += [(100, "Ann", None, "1/1/1990", 1.0, T0, "APPROVED")] * 3 + [(101, "Ann", "S", "1/1/1990", 1.0, None, "APPROVED")] * 2
    data.sort(key=lambda r: r[5] or T0)
    folder = fresh_path(spark, "horizon-in")
    for row in data:
        make(SCHEMA, row).coalesce(1).write.mode("append").parquet(folder)
    got = run(spark, streams.first_applications(streams.read_stream(spark, folder, SCHEMA, files_per_batch=files_per_batch)))
    assert sorted(r.id for r in got.collect()) == [0, 2, 5, 6, 7, 8, 100, 100, 100, 101, 101]


@pytest.mark.parametrize("files_per_batch", [1, 1000])
def test_decisions_by_type_equal_the_batch(spark, files_per_batch):
    t = Tables(spark, "/root/testdata/sf0.001")
    again = t.applications.where("application_id % 5 = 0").withColumns({
        "application_id": F.col("application_id") + 1000, "submitted_at": F.expr("submitted_at + INTERVAL 2 DAYS")})
    folder = fresh_path(spark, "applications-in")
    for sent in (t.applications, again):
        sent.coalesce(1).write.mode("append").parquet(folder)
    known = features.online_features(t.credit, AS_OF).cache()
    tables = t.users, t.questionnaires, known, t.predictions, AS_OF
    stream = streams.read_stream(spark, folder, t.applications.schema, files_per_batch=files_per_batch)
    got = run(spark, streams.decisions_by_type(stream, lambda: t.customer_submissions, *tables))
    want = decisions.decide_submissions(t.applications.unionByName(again), t.customer_submissions, *tables)
    answer = ["application_id", "already_exists", "existing_user_id", "decision_error", "decision", "decision_type", "ml_score",
              "reasons", "loan_recommendation", "fraud_flags"]
    rows = {r.application_id: r for r in got.select(answer).collect()}
    assert rows == {r.application_id: r for r in want.select(answer).collect()} and len(rows) == got.count()
    assert any(r.already_exists and r.application_id > 1000 for r in rows.values())
    assert any(r.ml_score is not None and i % 3 == 0 and i < 1000 for i, r in rows.items())
    known.unpersist()


@pytest.mark.parametrize("seed", [1, 2])
def test_kept_rows_equal_the_greedy_choice(spark, make, seed):
    """Dense and sparse identities over many days, in one batch and in three, against a plain pass in order of time."""
    import random

    rng = random.Random(seed)
    times = sorted({round(rng.random() * 400 * 3600) for _ in range(300)} | {3600 * h for h in range(0, 200, 8)})
    data = [(i, rng.choice(["Ann", "ann", "Bob", f"n{i % 40}"]), "S", "1/1/1990", 1.0, T0 + timedelta(seconds=s), "APPROVED") for i, s in enumerate(times)]
    want, last = [], {}
    for row in data:
        who = row[1].lower()
        if who not in last or row[5] - last[who] >= timedelta(hours=24):
            want.append(row[0])
            last[who] = row[5]
    for cuts in ([0, 400], [0, 100, 180, 400]):
        folder = fresh_path(spark, "greedy")
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            make(SCHEMA, *data[lo:hi]).coalesce(1).write.mode("append").parquet(folder)
        got = run(spark, streams.first_applications(open_stream(spark, folder)))
        assert sorted(r.id for r in got.collect()) == want
