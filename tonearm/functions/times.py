"""Time zones, buckets and formats. Instants are TIMESTAMP_NTZ in UTC throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local(ts: Column, tz: str) -> Column:
    """The wall clock of an instant in a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts)


def local_day(ts: Column, tz: str) -> Column:
    return local(ts, tz).cast("date")


def local_month(ts: Column, tz: str) -> Column:
    """First day of the local month."""
    return F.trunc(local(ts, tz).cast("date"), "month")


def local_year(ts: Column, tz: str) -> Column:
    return F.year(local(ts, tz))


def weekday(ts: Column, tz: str) -> Column:
    """1 is Monday."""
    return (F.weekday(local(ts, tz)) + 1).cast("int")


def hour(ts: Column, tz: str) -> Column:
    return F.hour(local(ts, tz))


def iso(ts: Column) -> Column:
    """An instant as text, whatever the session's zone."""
    text = ts.cast("string")
    return F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), F.lit("Z"))


def day_text(day: Column) -> Column:
    return day.cast("string")


def month_text(day: Column) -> Column:
    return F.substring(day.cast("string"), 1, 7)


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a TIMESTAMP_NTZ, cut and not rounded."""
    day = F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return day * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60 + F.second(ts)


def months(low: Column, high: Column) -> Column:
    """First days of all months from the one to the other, both first days themselves."""
    return F.sequence(low, high, F.expr("interval 1 month"))


def days(low: Column, high: Column) -> Column:
    return F.sequence(low, high, F.expr("interval 1 day"))


def ragged_date(text: Column) -> Column:
    """A date from text of which only the year may be given.

    Year, month and day are read by place. A month or day out of range counts as 1, a day that its month
    lacks gives the month's first, text that doesn't start with a year from 1 to 9999 gives null.
    """
    year = F.when(text.rlike(r"^\d{4}"), F.substring(text, 1, 4))

    def part(at: int, least: int, high: int) -> Column:
        found = F.when((F.length(text) >= least) & F.substring(text, at, 2).rlike(r"^\d{2}$"), F.substring(text, at, 2)).otherwise("01")
        return F.when(found.between("01", str(high)), found).otherwise("01")

    month, day = part(6, 7, 12), part(9, 10, 31)
    whole = F.concat_ws("-", year, month, day).try_cast("date")
    first = F.concat_ws("-", year, month, F.lit("01")).try_cast("date")
    return F.when(year.between("0001", "9999"), F.coalesce(whole, first))
