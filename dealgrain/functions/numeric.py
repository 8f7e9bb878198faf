"""Numeric helpers: safe ratios, unit prices, ages and order-preserving buckets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Square metres in one pyeong as used for unit prices, mean year length in days,
# won in one 만원 and one 억.
PYEONG_SQM = 3.3
YEAR_DAYS = 365.2425
MANWON = 10_000
EOK = 100_000_000


def number(c: Column) -> Column:
    """Text or number to double, null when it is not a plain finite number.

    Beyond what a cast refuses, suffixes (``1d``), words (``NaN``), surrounding control characters and hexadecimal digits are no number.
    """
    text = F.trim(c.cast("string"))
    digit = [str(d) for d in range(10)]
    plain = F.substring(text, 1, 1).isin("+", "-", ".", *digit) & F.right(text, F.lit(1)).isin(".", *digit) & (F.instr(F.lower(text), "x") == 0)
    value = text.try_cast("double")
    return F.when(plain & (F.abs(value) < float("inf")), value)


def amount_krw(c: Column) -> Column:
    """An amount written in 만원, with thousands separators or units, in won."""
    return F.regexp_replace(c.cast("string"), r"[^0-9.-]", "").try_cast("double") * MANWON


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, null when ``b`` is zero or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def price_per_sqm(amount: Column, area: Column) -> Column:
    return ratio(amount, area)


def age_at_deal(deal_date: Column, build_year: Column) -> Column:
    return F.year(deal_date) - build_year


def age_floor_years(approval: Column, as_of: Column) -> Column:
    """Completed mean years between two dates."""
    return F.floor(F.datediff(as_of, approval) / YEAR_DAYS).cast("int")


def age_anniversary(approval: Column, as_of: Column) -> Column:
    """Age that changes exactly on the anniversary day (29 February counts as later than 28)."""
    before = (F.month(approval) > F.month(as_of)) | (
        (F.month(approval) == F.month(as_of)) & (F.dayofmonth(approval) > F.dayofmonth(as_of))
    )
    return F.year(as_of) - F.year(approval) - F.when(before, 1).otherwise(0)


def parking_total(given: Column, ground: Column, underground: Column) -> Column:
    """The stated total, else ground plus underground; null only when all are unknown."""
    known = ground.isNotNull() | underground.isNotNull()
    return F.coalesce(given, F.when(known, F.coalesce(ground, F.lit(0.0)) + F.coalesce(underground, F.lit(0.0))))


def round_half_even(c: Column, scale: int = 0) -> Column:
    return F.bround(c, scale)


def value_bucket(c: Column, per_octave: int = 256) -> Column:
    """A coarse bucket that never reverses the order of two values.

    Buckets are equal steps of log2(1 + |v|), so a group's values spread over thousands of
    buckets whatever its size, and the number of buckets is bounded by the number range.
    """
    v = c.cast("double")
    limit = F.lit(float(2**53))  # infinities lie beyond every finite bucket
    return F.floor(F.greatest(F.least(F.signum(v) * F.log2(F.abs(v) + 1) * per_octave, limit), -limit)).cast("long")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
