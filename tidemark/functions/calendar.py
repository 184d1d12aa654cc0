"""Calendar of the bar tables. Timestamps are naive (TIMESTAMP_NTZ) and in UTC; zones are applied by expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEW_YORK, LONDON, TOKYO = "America/New_York", "Europe/London", "Asia/Tokyo"
DAY = 1440
#: The trading day rolls at this minute of the New York day.
ROLL = 17 * 60


def local(ts: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def to_utc(ts: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def iso_weekday(ts: Column) -> Column:
    return F.weekday(ts) + 1


def iso_year(ts: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), ts).cast("int")


def iso_week(ts: Column) -> Column:
    return F.extract(F.lit("WEEK"), ts).cast("int")


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a naive timestamp; the session zone has no part in it."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def bucket(ts: Column, minutes: int) -> Column:
    """Start of the epoch-aligned bucket."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MINUTE", (F.timestamp_diff("MINUTE", start, ts) - F.pmod(F.timestamp_diff("MINUTE", start, ts), F.lit(minutes))).cast("int"), start)


def plus_minutes(ts: Column, minutes: int | Column) -> Column:
    return F.timestamp_add("MINUTE", F.lit(minutes) if isinstance(minutes, int) else minutes, ts)


def minutes_between(a: Column, b: Column) -> Column:
    """Whole minutes from a to b."""
    return F.timestamp_diff("MINUTE", a, b)


def trading_day(ts: Column) -> Column:
    """The date on which the trading day ends: New York time plus seven hours."""
    return plus_minutes(local(ts, NEW_YORK), DAY - ROLL).cast("date")


def minutes_since(ts: Column, zone: str, opens: int) -> Column:
    return F.pmod(minute_of_day(local(ts, zone)) - opens, F.lit(DAY))


def minutes_to_roll(ts: Column) -> Column:
    return F.pmod(F.lit(ROLL) - minute_of_day(local(ts, NEW_YORK)), F.lit(DAY))


def in_hours(ts: Column, zone: str, opens: int, closes: int) -> Column:
    m = minute_of_day(local(ts, zone))
    return (m >= opens) & (m < closes)


#: Session hours, minutes of the local day.
SESSIONS = {"tokyo": (TOKYO, 540, 1080), "london": (LONDON, 480, 1020), "new_york": (NEW_YORK, 480, 1020)}


def session_label(ts: Column) -> Column:
    is_in = {k: in_hours(ts, *v) for k, v in SESSIONS.items()}
    return (
        F.when(is_in["london"] & is_in["new_york"], "overlap").when(is_in["london"], "london")
        .when(is_in["new_york"], "new_york").when(is_in["tokyo"], "asian").otherwise("off")
    )


def in_rollover(ts: Column) -> Column:
    """From 16:45 to 18:30 New York."""
    return in_hours(ts, NEW_YORK, 1005, 1110)


def late_friday(ts: Column, opens: int = 1005, closes: int = 1020) -> Column:
    return (iso_weekday(local(ts, NEW_YORK)) == 5) & in_hours(ts, NEW_YORK, opens, closes)
