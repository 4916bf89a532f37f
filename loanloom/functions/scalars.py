"""Column expressions: ages, ratios, flags, rounding, text and time. No Python runs per row."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, functions as F

# The sentinel the model sees for a missing number, and the one for marital status.
MISSING = -999.0
MARITAL_UNKNOWN = -1

# Score bands, lowest first, as (exclusive upper limit, label); the last has no limit.
SCORE_BANDS = (
    (200, "E (0-199)"),
    (600, "D (200-599)"),
    (750, "C (600-749)"),
    (825, "B (750-824)"),
    (None, "A (825+)"),
)


def as_timestamp(moment) -> Column:
    """A `Column`, `date`, `datetime` or ISO text as a zone-less timestamp column."""
    if isinstance(moment, Column):
        return moment.cast("timestamp_ntz")
    if isinstance(moment, datetime):
        moment = moment.isoformat(sep=" ")
    elif isinstance(moment, date):
        moment = f"{moment.isoformat()} 00:00:00"
    return F.lit(moment).cast("timestamp_ntz")


def count_if(condition: Column) -> Column:
    """Number of rows where the condition is true; NULL is not counted."""
    return F.count_if(condition)


# --- dates and times -------------------------------------------------------------------------


def completed_years(birth: Column, as_of) -> Column:
    """Age in completed years. Unlike months_between/12 it is right for 29 February."""
    today = as_timestamp(as_of)
    before_birthday = F.month(today) * 100 + F.dayofmonth(today) < F.month(birth) * 100 + F.dayofmonth(birth)
    return F.year(today) - F.year(birth) - before_birthday.cast("int")


def parse_birth_date(text: Column) -> Column:
    """`day/month/year` text as a date; anything else is NULL."""
    return F.try_to_date(text, "d/M/yyyy")


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole days between two timestamps, truncated toward zero."""
    return F.extract(F.lit("DAY"), later - earlier)


def seconds_between(later: Column, earlier: Column) -> Column:
    """Exact seconds between two zone-less timestamps, independent of the session time zone."""
    return (later - earlier).cast("decimal(20,6)")


def fractional_days(later: Column, earlier: Column) -> Column:
    return seconds_between(later, earlier).cast("double") / F.lit(86400.0)


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a wall-clock timestamp."""
    return (seconds_between(ts.cast("timestamp_ntz"), as_timestamp("1970-01-01 00:00:00")) * 1000000).cast("bigint")


def event_time(ts: Column) -> Column:
    """A wall-clock timestamp as the instant with that time in UTC, whatever the session zone."""
    return F.timestamp_micros(epoch_micros(ts))


def wall_clock(instant: Column) -> Column:
    """The UTC time of an instant, without a zone: the inverse of `event_time`."""
    seconds = F.unix_micros(instant).cast("decimal(24,6)") / 1000000
    return as_timestamp("1970-01-01 00:00:00") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def calendar_day(ts: Column) -> Column:
    return F.to_date(ts)


def parse_timestamp(text: Column) -> Column:
    """ISO text as a timestamp; a bad value is NULL."""
    return text.try_cast("timestamp_ntz")


def format_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


# --- numbers ---------------------------------------------------------------------------------


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def net_income(income: Column, expenses: Column) -> Column:
    return zero_if_null(income.cast("double")) - zero_if_null(expenses.cast("double"))


def total_income(income: Column, additional: Column) -> Column:
    return zero_if_null(income.cast("double")) + zero_if_null(additional.cast("double"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Batch ratio: a zero denominator counts as 1, a NULL one gives NULL."""
    below = denominator.cast("double")
    return numerator.cast("double") / F.when(below == 0, 1.0).otherwise(below)


def ratio_at_least_one(numerator: Column, denominator: Column) -> Column:
    """Online ratio: the denominator is never below 1."""
    return numerator.cast("double") / F.greatest(denominator.cast("double"), F.lit(1.0))


def average(total: Column, rows: Column) -> Column:
    """Mean from an exact sum and a count."""
    return total.cast("double") / F.nullif(rows, F.lit(0)).cast("double")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body refers to it."""
    return F.transform(F.array(value), body)[0]


def half_even(value: Column, digits: int = 0) -> Column:
    """Nearest number with `digits` (at most 3) decimals, as Python's round gives it.

    A tie goes to the even neighbour, and only a tie of the stored binary value is one: 2.675 is a
    little below its text and gives 2.67. `bround` rounds the text and gives 2.68. So the fraction
    is taken as a whole number of 2**-52 and rounded in integers.
    """
    if not 0 <= digits <= 3:
        raise ValueError("more than 3 decimals do not fit the integer arithmetic")
    scale = 10**digits

    def rounded(x: Column) -> Column:
        whole = F.floor(F.abs(x))
        parts = (F.abs(x) - whole) * float(2**52)
        finer = (parts - F.floor(parts)) * scale  # below 2**-52: only where |x| < 1
        scaled = F.floor(parts) * scale + F.floor(finer)
        kept = whole * scale + F.shiftright(scaled, 52)
        rest = scaled.bitwiseAND(F.lit(2**52 - 1))
        half = F.lit(2**51)
        up = (rest > half) | ((rest == half) & ((finer > F.floor(finer)) | (kept % 2 == 1)))
        size = (kept + up.cast("int")).cast("double") / scale
        return F.when(x < 0, -size).otherwise(size)

    return bind(value.cast("double"), rounded)


def scaled_half_even(value: Column, digits: int = 0) -> Column:
    """Rounding as numpy does it: scale, round half to even, scale back."""
    scale = float(10**digits)
    return F.rint(value.cast("double") * scale) / scale


def half_up(value: Column, digits: int = 0) -> Column:
    return F.round(value, digits)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def annuity(amount: Column, yearly_rate: Column, months: Column) -> Column:
    """Monthly payment of a loan at a yearly rate in percent, rounded half-even to cents."""
    monthly = yearly_rate / 100.0 / 12.0
    return half_even(amount * monthly / (1 - F.pow(1 + monthly, -months)), 2)


# --- flags and codes -------------------------------------------------------------------------


def above(value: Column, limit) -> Column:
    """1 where the value (NULL counts as 0) exceeds the limit, else 0."""
    return (F.coalesce(value, F.lit(0)) > limit).cast("int")


def present(value: Column) -> Column:
    return value.isNotNull().cast("int")


def flag(value: Column) -> Column:
    """Boolean to 0/1 with NULL as 0."""
    return F.coalesce(value, F.lit(False)).cast("int")


def encode_sex(sex: Column) -> Column:
    return F.when(sex == "male", 1).when(sex == "female", 0)


def marital_code(status: Column) -> Column:
    return F.coalesce(status.cast("int"), F.lit(MARITAL_UNKNOWN))


def fill_for_model(df: DataFrame, features) -> DataFrame:
    """Every feature as a double, NULL replaced by the model's sentinel."""
    wanted = set(features)
    rest = [f"`{c}`" for c in df.columns if c not in wanted]
    return df.selectExpr(*rest, *[f"coalesce(CAST({c} AS DOUBLE), {MISSING}D) AS {c}" for c in features])


def score_band(score: Column) -> Column:
    bands = None
    for limit, label in SCORE_BANDS:
        if limit is None:
            return bands.otherwise(label)
        bands = F.when(score < limit, label) if bands is None else bands.when(score < limit, label)


# --- text ------------------------------------------------------------------------------------


def text_or_na(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("N/A"))


def folded(text: Column) -> Column:
    return F.lower(text)


def full_name(name: Column, surname: Column) -> Column:
    return F.trim(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(surname, F.lit(""))))


def mentions_approval(decision: Column) -> Column:
    return decision.contains("APPROVED")


def applicant_id(supplied: Column, *identity: Column) -> Column:
    """The supplied id, else one derived from the identity, so that a retried task gives the same id."""
    parts = [F.coalesce(c, F.lit("")) for c in identity]
    return F.coalesce(supplied, F.md5(F.concat_ws("|", *parts)))


def number_text(value: Column, digits: int = 2) -> Column:
    """A number as Python prints a float rounded to `digits`: no exponent, at least one decimal."""
    rounded = half_even(value.cast("double"), digits).cast(f"decimal(30,{digits})").cast("string")
    return F.regexp_replace(rounded, r"(\.\d+?)0+$", "$1")
