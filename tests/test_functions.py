"""Scalar functions on edge values."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from loanloom.functions import scalars as fn


def values(df, name="out"):
    return [row[name] for row in df.select(name).collect()]


def test_age_counts_completed_years(make):
    df = make("birth date", (date(2004, 2, 29),), (date(2005, 2, 28),), (date(2005, 3, 1),), (date(1990, 1, 1),), (None,))
    assert values(df.select(fn.completed_years(F.col("birth"), "2023-02-28 00:00:00").alias("out"))) == [18, 18, 17, 33, None]


def test_birth_date_text(make):
    df = make("text string", ("1/1/1990",), ("29/02/2004",), ("1990-01-01",), ("31/02/1990",), (None,))
    assert values(df.select(fn.parse_birth_date(F.col("text")).alias("out"))) == [
        date(1990, 1, 1), date(2004, 2, 29), None, None, None]


def test_whole_days_truncate_toward_zero(make):
    late = [datetime(2024, 1, 10), datetime(2024, 1, 10, 23), datetime(2024, 1, 11), datetime(2024, 1, 9, 1), datetime(2024, 1, 8)]
    df = make("created timestamp_ntz, due timestamp_ntz", *[(x, datetime(2024, 1, 10)) for x in late])
    assert values(df.select(fn.whole_days(F.col("created"), F.col("due")).alias("out"))) == [0, 0, 1, 0, -2]


def test_ratios_by_policy(make):
    df = make("n double, d double", (3.0, 0.0), (3.0, 0.5), (3.0, -10.0), (3.0, None), (None, 2.0))
    assert values(df.select(fn.ratio(F.col("n"), F.col("d")).alias("out"))) == [3.0, 6.0, -0.3, None, None]
    assert values(df.select(fn.ratio_at_least_one(F.col("n"), F.col("d")).alias("out")))[:3] == [3.0, 3.0, 3.0]


@pytest.mark.parametrize("digits", [0, 1, 2, 3])
def test_half_even_rounds_as_python(make, digits):
    random.seed(digits)
    numbers = [random.uniform(-1e6, 1e6) for _ in range(300)]
    numbers += [random.randrange(-10**7, 10**7) / 1000 for _ in range(2000)]
    numbers += [random.randrange(10**9) / 2**k for k in range(1, 12) for _ in range(30)]
    numbers += [2.675, 0.125, 0.375, -0.125, 0.005, 5e-324, 0.0, 1e13 + 0.25, 0.15, 2.5, 3.5, -2.5, 0.5]
    df = make("v double", *[(n,) for n in numbers])
    got = [(r.v, r.out) for r in df.select("v", fn.half_even(F.col("v"), digits).alias("out")).collect()]
    assert [out for _, out in got] == [round(v, digits) + 0.0 for v, _ in got]


def test_number_text_has_no_exponent(make):
    df = make("v double", (450.0,), (1234.5,), (12345678.9,), (0.0,), (33.33,), (None,))
    assert values(df.select(fn.number_text(F.col("v")).alias("out"))) == ["450.0", "1234.5", "12345678.9", "0.0", "33.33", None]


def test_score_bands_at_their_limits(make):
    df = make("v double", (0.0,), (199.99,), (200.0,), (599.99,), (600.0,), (749.99,), (750.0,), (824.99,), (825.0,))
    assert [b[0] for b in values(df.select(fn.score_band(F.col("v")).alias("out")))] == list("EEDDCCBBA")


def test_event_time_is_independent_of_the_session_zone(spark, make):
    df = make("ts timestamp_ntz", (datetime(2024, 3, 31, 2, 30, 0, 123456),), (datetime(1969, 12, 31, 23, 59, 59),))
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        back = values(df.select(fn.wall_clock(fn.event_time(F.col("ts"))).alias("out")))
        micros = values(df.select(fn.epoch_micros(F.col("ts")).alias("out")))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert back == [datetime(2024, 3, 31, 2, 30, 0, 123456), datetime(1969, 12, 31, 23, 59, 59)]
    assert micros == [1711852200123456, -1000000]


def test_generated_id_is_stable(make):
    df = make("id string, a string, b string", ("7", "x", "y"), (None, "x", "y"), (None, "x", None))
    first, second, third = values(df.select(fn.applicant_id(F.col("id"), F.col("a"), F.col("b")).alias("out")))
    assert first == "7" and second != third and len(second) == 32


def test_dates_in_several_forms(make):
    from loanloom.sources.ingest import lenient_date

    texts = ["1990-03-15", "15/03/1990", "15.03.1990", "Mar 15 1990", "15 March 1990", "3/15/1990", "1990/3/15", "soon", None]
    got = [r[0] and r[0].isoformat() for r in make("v string", *[(t,) for t in texts]).select(lenient_date(F.col("v"))).collect()]
    assert got == ["1990-03-15"] * 7 + [None, None]


def test_more_decimals_than_fit_are_refused():
    with pytest.raises(ValueError):
        fn.half_even(F.lit(1.0), 4)
