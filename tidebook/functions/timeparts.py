"""Time columns. Canonical time is microseconds since the epoch, in a BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Microseconds per day; last valid microsecond (2100-01-01); first valid day (2000-01-01);
# number of years after the as-of year at which validity ends (exclusive).
US_PER_DAY = 86_400_000_000
LAST_VALID_US = 4_102_444_800_000_000
FIRST_VALID_DAY = 10_957
YEARS_AHEAD = 5


def ms_to_us(ms: Column) -> Column:
    """Milliseconds to microseconds; NULL instead of an overflow error."""
    return F.try_multiply(ms, F.lit(1000).cast("bigint"))


def seconds_to_us(seconds: Column, micros: Column) -> Column:
    return seconds.cast("bigint") * F.lit(1_000_000).cast("bigint") + micros.cast("bigint")


def _whole_days(us: Column) -> Column:
    day = F.lit(US_PER_DAY).cast("bigint")
    return F.call_function("div", us - F.pmod(us, day), day)


def day_number(us: Column) -> Column:
    """Days since the epoch, or -1 for zero, negative and out-of-range times."""
    usable = (us > 0) & (us <= F.lit(LAST_VALID_US))
    return F.when(usable, _whole_days(us).cast("int")).otherwise(F.lit(-1))


def civil_day_number(year: Column, month: Column, day: Column) -> Column:
    return F.unix_date(F.make_date(year, month, day))


def last_valid_day(as_of_year: int) -> Column:
    """A literal expression, so Catalyst folds it into the filter."""
    return F.unix_date(F.make_date(F.lit(as_of_year + YEARS_AHEAD), F.lit(1), F.lit(1))) - 1


def is_valid_day(day: Column, as_of_year: int) -> Column:
    return day.between(F.lit(FIRST_VALID_DAY), last_valid_day(as_of_year))


def is_valid_us(us: Column, as_of_year: int) -> Column:
    return F.coalesce(is_valid_day(day_number(us), as_of_year), F.lit(False))


def trade_date(us: Column) -> Column:
    return F.date_from_unix_date(_whole_days(us).cast("int"))


def date_text(us: Column) -> Column:
    """``YYYY-MM-DD`` in UTC whatever the session zone is."""
    return F.date_format(trade_date(us), "yyyy-MM-dd")
