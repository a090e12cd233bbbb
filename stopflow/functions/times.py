"""Time expressions. Zone-dependent parts take the zone as an argument, so that results
do not depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_DAY = 86_400_000_000
_HOUR = 3_600_000_000


def seconds_between(later: Column, earlier: Column) -> Column:
    """Fractional seconds; NULL if either end is NULL."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def micros_to_seconds(micros: Column) -> Column:
    return micros / F.lit(1e6)


def visit_start(planned: bool = False) -> Column:
    """Microseconds at which the way to the next visit starts: on arrival, or on departure
    where no arrival is known."""
    kind = ("aimedArrivalTime", "aimedDepartureTime") if planned else ("arrivalTime", "departureTime")
    return F.unix_micros(F.coalesce(*kind))


def visit_delay() -> Column:
    """Seconds a visit is late: on arrival, or on departure where no arrival is known."""
    return F.coalesce(
        seconds_between(F.col("arrivalTime"), F.col("aimedArrivalTime")),
        seconds_between(F.col("departureTime"), F.col("aimedDepartureTime")),
    )


def _local_micros(ts: Column, tz: str) -> Column:
    return F.unix_micros(ts if tz == "UTC" else F.from_utc_timestamp(ts, tz))


def _local_day(ts: Column, tz: str) -> Column:
    micros = _local_micros(ts, tz)
    return ((micros - F.pmod(micros, F.lit(_DAY))) / F.lit(_DAY)).cast("int")


def local_hour(ts: Column, tz: str = "UTC") -> Column:
    return F.floor(F.pmod(_local_micros(ts, tz), F.lit(_DAY)) / F.lit(_HOUR)).cast("int")


def local_weekday(ts: Column, tz: str = "UTC") -> Column:
    """0 = Sunday ... 6 = Saturday (day 0 of the epoch was a Thursday)."""
    return F.pmod(_local_day(ts, tz) + F.lit(4), F.lit(7))


def local_year(ts: Column, tz: str = "UTC") -> Column:
    return F.year(F.date_from_unix_date(_local_day(ts, tz)))


def local_month(ts: Column, tz: str = "UTC") -> Column:
    return F.month(F.date_from_unix_date(_local_day(ts, tz)))


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")
