"""New York market time. Stored timestamps are UTC instants; the session time zone must be UTC."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKET_ZONE = "America/New_York"
OPEN_SECOND, CLOSE_SECOND = 34_200, 57_600  # 09:30 and 16:00


def market_time(instant: Column) -> Column:
    """The wall clock in New York, as a timestamp without zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(MARKET_ZONE), instant.cast("timestamp_ntz"))


def market_date(instant: Column) -> Column:
    return market_time(instant).cast("date")


def second_of_day(local: Column) -> Column:
    return F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)


def in_regular_session(local: Column) -> Column:
    """From 09:30 up to, not including, 16:00. No calendar of holidays or half days is applied."""
    second = second_of_day(local)
    return (second >= OPEN_SECOND) & (second < CLOSE_SECOND)


def day_bounds(start: date, end: date) -> tuple[datetime, datetime]:
    """The instants at which New York's day `start` begins and the day after `end` begins."""
    zone = ZoneInfo(MARKET_ZONE)
    return datetime.combine(start, time.min, tzinfo=zone), datetime.combine(end + timedelta(days=1), time.min, tzinfo=zone)


def as_date(value: str | date | None, label: str) -> date | None:
    if value is None or isinstance(value, date):
        return value
    try:
        return date.fromisoformat(str(value))
    except ValueError as error:
        raise ValueError(f"{label} must use YYYY-MM-DD format") from error
