"""Calendar arithmetic around 2001-01-01 as Spark columns.

Dates are days since 2001-01-01 in the proleptic Gregorian calendar; times of day are
counts of a unit since midnight; a date and time together are counts since 2001-01-01.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "2001-01-01"
PER_SECOND = {"s": 1, "ms": 1_000, "us": 1_000_000, "ns": 1_000_000_000}


def is_leap_year(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def days_from_ymd(year: Column, month: Column, day: Column) -> Column:
    return days_from_date(F.make_date(year, month, day))


def days_from_date(date: Column) -> Column:
    return F.datediff(date, F.lit(EPOCH).cast("date"))


def date_from_days(days: Column) -> Column:
    return F.date_add(F.lit(EPOCH).cast("date"), days.cast("int"))


def ymd_from_days(days: Column) -> tuple[Column, Column, Column]:
    date = date_from_days(days)
    return F.year(date), F.month(date), F.dayofmonth(date)


def time_from_hms(hour: Column, minute: Column, second: Column, fraction: Column | int = 0, unit: str = "s") -> Column:
    """A time of day in the unit; parts out of their range are added up as they are."""
    seconds = (hour.cast("bigint") * 3600 + minute.cast("bigint") * 60 + second.cast("bigint")) * PER_SECOND[unit]
    return seconds if unit == "s" else seconds + (fraction if isinstance(fraction, Column) else F.lit(fraction))


def hms_from_time(time: Column, unit: str = "s") -> tuple[Column, Column, Column, Column]:
    """Hours, minutes, seconds and the rest in the unit, by Euclidean division."""
    per = PER_SECOND[unit]
    seconds = F.floor(time / per) if per == 1 else F.expr("0") + F.floor((time - F.pmod(time, F.lit(per))) / per)
    return F.floor(seconds / 3600), F.pmod(F.floor(seconds / 60), F.lit(60)), F.pmod(seconds, F.lit(60)), F.pmod(time, F.lit(per))


def datetime_from(days: Column, time: Column, unit: str = "s") -> Column:
    return days.cast("bigint") * (86_400 * PER_SECOND[unit]) + time.cast("bigint")


def timestamp_from(days: Column, time_us: Column) -> Column:
    """The timestamp (without zone) of a date and a time of day in microseconds."""
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.datediff(date_from_days(days), F.lit("1970-01-01").cast("date")), F.lit(0), F.lit(0), (time_us / 1_000_000).cast("decimal(18,6)"))
