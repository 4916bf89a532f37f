"""Velocity in operator state: equal to the batch whatever the files, dropped after the horizon, kept over a restart."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from loanloom.operators import velocity
from loanloom.session import fresh_path
from loanloom.streaming import applications as streams, stateful

T0 = datetime(2024, 1, 1)
SCHEMA = "id int, name string, surname string, date_of_birth string, akb_score double, submitted_at timestamp_ntz"


def rows(seed, n, hours, late=0.0):
    """Submissions of a few people; some arrive up to `late` hours after their time. In order of arrival."""
    rng = random.Random(seed)
    sent = []
    for i in range(n):
        at = rng.random() * hours
        person = rng.choice(["Ann", "ANN", "bob", None])
        moment = T0 + timedelta(hours=at) if i % 9 else T0 + timedelta(hours=int(at))
        sent.append((at + rng.random() * late, (i, person, "S", "1/1/1990", rng.choice([None, 0.0, float(rng.randrange(300))]), moment)))
    return [r for _, r in sorted(sent, key=lambda s: s[0])]


def arrive(make, folder, data, files):
    step = -(-len(data) // files)
    for at in range(0, len(data), step):
        make(SCHEMA, *data[at:at + step]).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, path, files_per_batch=1):
    stateful.use_rocksdb(spark)
    stream = streams.read_stream(spark, folder, SCHEMA, files_per_batch=files_per_batch)
    query = streams.write_files(stateful.exact_velocity(stream), f"{path}/rows", f"{path}/checkpoint")
    query.awaitTermination()
    return query


def results(df):
    return {int(r.id): (r.recent_count, r.recent_low, r.recent_high, r.fraud_flags, r.submitted_at) for r in df.collect()}


def expected(make, data):
    """The batch's answers for all rows whose ten minutes the watermark has passed."""
    known = make(SCHEMA, *[r for r in data if r[1] is not None])
    end = max(r[5] for r in data if r[1] is not None) - timedelta(hours=1)
    grain = timedelta(minutes=10)
    closed = {r[0] for r in data if r[1] is not None and T0 + ((r[5] - T0) // grain + 1) * grain <= end}
    return {i: v for i, v in results(velocity.fraud_flags(known, known)).items() if i in closed}


@pytest.mark.parametrize("files, per_batch", [(1, 1), (5, 1), (5, 2)])
def test_equals_the_batch_with_late_rows(spark, make, files, per_batch):
    data = rows(files, 150, 90, late=0.9)
    folder, path = fresh_path(spark, "in"), fresh_path(spark, "out")
    arrive(make, folder, data, files)
    run(spark, folder, path, per_batch)
    got = results(spark.read.parquet(f"{path}/rows"))
    assert got == expected(make, data) and len(got) > 90
    assert any(v[3] for v in got.values()) and any(v[0] > 5 for v in got.values())


def test_goes_on_after_a_restart(spark, make):
    data = rows(7, 120, 60)
    folder, path = fresh_path(spark, "in"), fresh_path(spark, "out")
    arrive(make, folder, data[:70], 2)
    run(spark, folder, path)
    first = results(spark.read.parquet(f"{path}/rows"))
    arrive(make, folder, data[70:], 1)
    run(spark, folder, path)
    got = results(spark.read.parquet(f"{path}/rows"))
    assert got == expected(make, data) and 0 < len(first) < len(got) and first.items() <= got.items()
    assert spark.read.parquet(f"{path}/rows").count() == len(got)


def test_state_shrinks_after_the_horizon(spark, make):
    data = [(i, f"p{i}", "S", "1/1/1990", 1.0, T0 + timedelta(minutes=i)) for i in range(60)]
    data += [(100, "last", "S", "1/1/1990", 1.0, T0 + timedelta(hours=40)), (101, "last", "S", "1/1/1990", 1.0, T0 + timedelta(hours=80))]
    folder, path = fresh_path(spark, "in"), fresh_path(spark, "out")
    for part in (data[:60], data[60:61], data[61:]):
        make(SCHEMA, *part).coalesce(1).write.mode("append").parquet(folder)
    query = run(spark, folder, path)
    kept = [p["stateOperators"][0]["customMetrics"] for p in query.recentProgress if p["stateOperators"]]
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(totals) >= 60 and totals[-1] < 10 and kept
    assert {r.id for r in spark.read.parquet(f"{path}/rows").collect()} == {str(i) for i in [*range(60), 100]}


@pytest.mark.parametrize("zone", ["America/New_York"])
def test_session_zone_changes_nothing(spark, make, zone):
    data = rows(3, 60, 40)
    folder, path = fresh_path(spark, "in"), fresh_path(spark, "out")
    arrive(make, folder, data, 1)
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        run(spark, folder, path)
        got = results(spark.read.parquet(f"{path}/rows"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == expected(make, data)


def test_one_timer_answers_all_grains_that_are_due(spark, make):
    """A timer per grain took minutes on 100,000 rows: each is a round trip to the state store for itself."""
    data = [(i, f"p{i % 3}", "S", "1/1/1990", float(i), T0 + timedelta(minutes=11 * i)) for i in range(300)]
    folder, path = fresh_path(spark, "in"), fresh_path(spark, "out")
    arrive(make, folder, data, 1)
    query = run(spark, folder, path)
    metrics = [p["stateOperators"][0]["customMetrics"] for p in query.recentProgress if p["stateOperators"]]
    assert 0 < sum(m["numRegisteredTimers"] for m in metrics) <= 2 * 3
    assert results(spark.read.parquet(f"{path}/rows")) == expected(make, data)


@pytest.mark.parametrize("pick", [min, max])
def test_ranges_of_any_length(pick):
    rng = random.Random(4)
    values = np.array([np.nan if rng.random() < 0.3 else float(rng.randrange(100)) for _ in range(70)])
    begins = np.array([i for i in range(70) for _ in range(i, 70)])
    ends = np.array([j + 1 for i in range(70) for j in range(i, 70)])
    got = stateful._over_ranges(np.fmin if pick is min else np.fmax, values, begins, ends)
    for b, e, v in zip(begins, ends, got):
        known = [x for x in values[b:e].tolist() if x == x]
        assert v == pick(known) if known else np.isnan(v)


def test_grains_must_fit():
    with pytest.raises(ValueError):
        stateful.Velocity(24, 7000)
