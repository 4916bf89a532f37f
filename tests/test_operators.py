"""Operators against plain Python on small tables, with heavy keys and ties."""

import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loanloom.operators import aggregates, joins, latest, metrics, ranking, reports, velocity

T0 = datetime(2024, 1, 1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- aggregates ------------------------------------------------------------------------------


def test_delay_edges(make):
    due = datetime(2024, 1, 10)
    delays = [timedelta(days=-1), timedelta(0), timedelta(hours=23), timedelta(days=1), timedelta(days=30),
              timedelta(days=30, hours=23), timedelta(days=31)]
    states = [("L", due, due + d, 1.0, 2.0, "payment") for d in delays] + [("L", due, due + timedelta(days=90), 1.0, 2.0, "accrual")]
    df = make("loan_id string, target_date timestamp_ntz, created timestamp_ntz, overdue_interest double, debt double, transaction_type string", *states)
    df = df.withColumns({c: F.col(c).cast("decimal(15,4)") for c in ("overdue_interest", "debt")})
    row = aggregates.states_per_user(df, make("id string, user_id string", ("L", "u"))).first()
    assert (row.delayed_payments, row.failed_payments_30plus, row.max_delay_days) == (3, 1, 31)
    assert row.avg_delay_days == (1 + 30 + 30 + 31) / 8
    assert (float(row.total_overdue_interest), float(row.total_debt_accumulated)) == (8.0, 16.0)


def test_payments_of_a_heavy_user(make):
    random.seed(1)
    data = [("hot" if random.random() < 0.6 else f"u{random.randrange(5)}", random.choice([None, "a", "b", "c"]),
             random.randrange(100), random.choice([True, False, None])) for _ in range(2000)]
    df = make("user_id string, card_id string, amount int, is_successful boolean", *data)
    df = df.withColumn("amount", F.col("amount").cast("decimal(15,2)"))
    got = {r.user_id: r for r in aggregates.payments_per_user(df).collect()}
    for user in {d[0] for d in data}:
        mine = [d for d in data if d[0] == user]
        assert got[user].total_payments == len(mine)
        assert got[user].num_cards_used == len({d[1] for d in mine} - {None})
        assert got[user].successful_payments == sum(d[3] is True for d in mine)
        assert got[user].failed_payments == sum(d[3] is False for d in mine)
        assert got[user].avg_payment_amount == pytest.approx(sum(d[2] for d in mine) / len(mine))


def test_totals_of_a_customer_without_rows(make):
    people = make("user_id string", ("a",))
    loans = make("user_id string, id string, amount bigint, term int, tag string, created timestamp_ntz")
    payments = make("user_id string, card_id string, amount decimal(15,2), is_successful boolean")
    cards = make("user_id string, is_verified boolean, is_main boolean, is_for_disbursement boolean, deleted timestamp_ntz")
    documents = make("user_id string, loan_id string, created timestamp_ntz")
    row = aggregates.totals_for_customers(people, loans, payments, cards, documents).first()
    assert (row.total_loans, row.total_payments, row.total_cards, row.loans_with_docs) == (0, 0, 0, 0)
    assert row.total_amount_borrowed is None and row.successful_payments is None


# --- latest records --------------------------------------------------------------------------


def test_latest_breaks_ties_by_id_and_puts_missing_times_first(make):
    df = make("user_id string, timestamp timestamp_ntz, id string, v int",
              ("a", T0, "1", 10), ("a", T0, "2", 20), ("a", T0 - timedelta(days=1), "9", 30),
              ("b", T0, "1", 1), ("b", None, "0", 2))
    assert rows(latest.latest_per_key(df, "user_id", "timestamp", "id", {"v": "v"}, "n")) == [("a", 20, 3), ("b", 2, 2)]
    assert latest.latest_for(df, "user_id", "b", "timestamp", "id").first().v == 2


# --- joins -----------------------------------------------------------------------------------


def test_fan_out_join_is_exact_with_a_heavy_key(make):
    left = make("user_id string, x int", *[(f"u{i}", i) for i in range(20)])
    copies = [("u3", 7)] * 45 + [("u5", 1), ("u5", 1), ("u6", None)]
    right = make("user_id string, q int", *[("u3", i) for i in range(137)], *copies, ("other", 2), (None, 3))
    got = rows(joins.fan_out_left_join(left, right, "user_id").select("user_id", "x", F.coalesce("q", F.lit(-1))))
    assert got == rows(left.join(right, "user_id", "left").select("user_id", "x", F.coalesce("q", F.lit(-1))))


def test_sparse_join_equals_left_join(make):
    left = make("id int, user_id string", *[(i, None if i % 3 else f"u{i % 5}") for i in range(60)])
    right = make("user_id string, v int", *[(f"u{i}", i) for i in range(4)], (None, 99))
    plain = left.join(right, "user_id", "left").select("id", "user_id", F.coalesce("v", F.lit(-1)))
    joined = joins.left_join_sparse(left, right, "user_id").select("id", "user_id", F.coalesce("v", F.lit(-1)))
    assert sorted(map(str, rows_of(joined))) == sorted(map(str, rows_of(plain)))


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_names_match_logins_by_substring(make):
    logins = ["anna.smith", "joanna", "bob", "Bobby_S", "an"]
    users = make("id string, login string", *[(str(i), login) for i, login in enumerate(logins)])
    names = ["ANN", "bob", "s", "zzz", "anna.smith", "a", "", None, "ann"]
    asked = make("k int, name string", *enumerate(names))
    got = {r.k: r.matched_user_id for r in joins.users_by_name(users, asked).collect()}
    for k, name in enumerate(names):
        hits = [str(i) for i, login in enumerate(logins) if name and name.lower() in login.lower()]
        assert got[k] == (min(hits) if hits else None)


def test_duplicate_gets_the_earliest_id(make):
    apps = make("name string, surname string, date_of_birth string", ("ANN", "Lee", "1/1/1990"), ("ANN", None, "1/1/1990"))
    subs = make("id int, name string, surname string, date_of_birth string, submitted_at timestamp_ntz",
                (5, "ann", "LEE", "1/1/1990", T0), (6, "Ann", "lee", "1/1/1990", T0 - timedelta(1)), (7, "Ann", None, "1/1/1990", T0))
    assert [r.existing_id for r in joins.existing_applicants(apps, subs).orderBy(F.col("surname").desc()).collect()] == [6, None]


# --- velocity --------------------------------------------------------------------------------

SUBMISSION = "id int, name string, surname string, date_of_birth string, akb_score double, submitted_at timestamp_ntz"


def brute_force(probes, history):
    out = {}
    for p in probes:
        key = tuple((p[i] or "").lower() for i in (1, 2)) + (p[3] or "",)
        near = [h for h in history if None not in h[1:4] and (h[1].lower(), h[2].lower(), h[3]) == key
                and p[5] - timedelta(hours=24) < h[5] <= p[5]]
        scores = [h[4] for h in near if h[4] is not None]
        out[p[0]] = (len(near), min(scores, default=None), max(scores, default=None))
    return out


@pytest.mark.parametrize("grain", [60, 3600, 86400])
def test_velocity_equals_brute_force_with_a_heavy_identity(make, grain):
    random.seed(grain)
    def row(i):
        name = "Hot" if random.random() < 0.5 else f"n{random.randrange(6)}"
        step = random.choice([0, 0, 60, 3600, 86400, 86400 * 2, random.randrange(86400 * 3)])
        return (i, random.choice([name, name.upper()]), random.choice(["S", "s", None]), "1/1/1990",
                random.choice([None, 0.0, 100.0, 200.0, 200.01, 450.0]),
                T0 + timedelta(seconds=step, microseconds=random.choice([0, 0, 1, 999999])))
    history, probes = [row(i) for i in range(400)], [row(i) for i in range(200)]
    for asked in (history, probes):
        got = velocity.trailing_activity(make(SUBMISSION, *asked), make(SUBMISSION, *history), grain_seconds=grain)
        got = {r.id: (r.recent_count, r.recent_low, r.recent_high) for r in got.collect()}
        assert got == brute_force(asked, history)


def test_flags_at_their_limits(make):
    def at(i, hours, score, name="Ann"):
        return (i, name, "Lee", "1/1/1990", score, T0 + timedelta(hours=hours))
    df = make(SUBMISSION, at(1, 0, 300.0), at(2, 1, 400.0), at(3, 23.9, 400.01, "ANN"), at(4, 24, 400.0),
              at(5, 100, 0.0), at(6, 100.5, 500.0), at(7, 101, None))
    got = {r.id: (r.recent_count, r.fraud_flags) for r in velocity.fraud_flags(df, df).collect()}
    assert got[1] == (1, []) and got[2] == (2, [])
    assert got[3] == (3, [velocity.MANY_TEXT, velocity.GAP_TEXT])
    assert got[4] == (3, [velocity.MANY_TEXT])  # the row exactly 24 hours old is out
    assert got[5] == (1, []) and got[6] == (2, [velocity.GAP_TEXT]) and got[7] == (3, [velocity.MANY_TEXT])


def test_velocity_plan_forms_no_pairs(make):
    df = make(SUBMISSION, (1, "a", "b", "c", 1.0, T0))
    plan = velocity.trailing_activity(df, df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Cross" not in plan and "submitted_at >" not in plan


# --- split and metrics -----------------------------------------------------------------------


@pytest.mark.parametrize("size", [1, 4, 5, 7, 1003])
def test_split_takes_the_smallest_tokens_of_each_class(make, size):
    random.seed(size)
    data = [(f"k{i}", int(random.random() < 0.2)) for i in range(size)]
    got = {r.k: r.slice for r in ranking.stratified_split(make("k string, target int", *data), "target", "k").collect()}
    for label in (0, 1):
        ordered = sorted((hashlib.md5(f"42:{k}".encode()).hexdigest(), k) for k, t in data if t == label)
        quota = int(len(ordered) * 0.2)
        assert {k for _, k in ordered[:quota]} == {k for k, t in data if t == label and got[k] == "test"}


def auc_by_pairs(data):
    good = [p for t, p in data if t == 1]
    bad = [p for t, p in data if t == 0]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


def test_auc_with_a_third_of_rows_on_one_score(make):
    random.seed(3)
    data = []
    for _ in range(900):
        score = random.choice([0.5, random.random(), random.choice([0.0, 1.0, 0.1000001, 0.1000002])])
        data.append((int(random.random() < score), score))
    df = make("target int, probability double", *data)
    assert metrics.roc_auc(df).first().roc_auc == pytest.approx(auc_by_pairs(data), abs=1e-12)


def test_auc_of_one_class_is_unknown(make):
    assert metrics.roc_auc(make("target int, probability double", (1, 0.2), (1, 0.4))).first().roc_auc is None


def test_scores_without_positive_predictions(make):
    df = make("target int, prediction int", (1, 0), (0, 0), (0, 0))
    row = metrics.class_scores(df).first()
    assert (row.precision, row.recall, row.f1) == (0.0, 0.0, 0.0) and row.accuracy == pytest.approx(2 / 3)


def test_importance_groups_leave_features_out(make):
    df = make("feature string, importance double", ("total_cards", 0.25), ("verified_cards", 0.25), ("age", 0.5))
    assert rows(metrics.importance_by_group(df)) == [("Cards", 0.5)]


# --- reports ---------------------------------------------------------------------------------


def test_reports_are_ordered(make):
    df = make("id int, decision string, akb_score double, age int, submitted_at timestamp_ntz, ml_probability double, user_id string",
              (1, "APPROVED", 830.0, 30, T0, 50.0, "a"), (2, "REJECTED — x", 10.0, 20, T0 + timedelta(1), None, "b"),
              (3, "REJECTED — y", 700.0, 40, T0 + timedelta(2), 40.0, "c"), (4, "REJECTED — y", None, None, T0 + timedelta(3), 45.0, "d"))
    assert [r.grade_range[0] for r in reports.score_distribution(df).collect()] == ["E", "C", "A"]
    assert [r.decision[-1] for r in reports.rejection_reasons(df).collect()] == ["y", "x"]
    assert [r.user_id for r in reports.top_decisions(df).collect()] == ["b", "a", "d", "c"]
    assert [r.user_id for r in reports.rejected_by_probability(df).collect()] == ["c", "d", "b"]
    assert [r.total for r in reports.daily_submissions(df, "2024-01-15 00:00:00").collect()] == [1, 1, 1]
    stats = reports.overall_stats(df).first()
    assert (stats.total, stats.approved, stats.rejected, stats.avg_akb, stats.avg_age) == (4, 1, 3, 513.3, 30.0)


# --- findings of the review ------------------------------------------------------------------


def test_fan_out_join_starts_no_job_and_splits_a_heavy_key(spark):
    left = spark.range(2000).selectExpr("concat('u', id) AS user_id", "id AS x")
    heavy = spark.range(4000).selectExpr("IF(id % 2 = 0, 'u7', concat('u', id)) AS user_id", "id AS q")
    tracker, group = spark.sparkContext.statusTracker(), "fan-out-plan"
    spark.sparkContext.setJobGroup(group, "building only")
    joined = joins.fan_out_left_join(left, heavy, "user_id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert tracker.getJobIdsForGroup(group) == [] or len(tracker.getJobIdsForGroup(group)) == 0
    spark.sparkContext.setJobGroup("", "")
    assert "LeftOuter" not in plan and "LeftAnti" in plan
    assert joined.count() == left.join(heavy, "user_id", "left").count()


def test_auc_leaves_out_unknown_probabilities_and_keeps_ties(make):
    from loanloom.operators import metrics

    scored = [(0.9995 + i * 1e-7, i % 3 == 0) for i in range(300)] + [(0.99951, True), (0.99951, False), (0.0, False), (1.0, True)]
    rows_ = [(p, int(t)) for p, t in scored] + [(None, 1), (None, 0), (0.5, None)]
    got = metrics.roc_auc(make("probability double, target int", *rows_)).first().roc_auc
    wins = [(a > b) + (a == b) / 2 for a, x in scored if x for b, y in scored if not y]
    assert got == pytest.approx(sum(wins) / len(wins))
    few = make("probability double, target int", (0.9, 1), (0.1, 0), (None, 1), (None, 0))
    assert metrics.roc_auc(few).first().roc_auc == 1.0
