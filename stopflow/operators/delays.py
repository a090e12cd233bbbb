"""Delays and volumes at stops, straight from the arrivals."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import (
    local_hour,
    local_month,
    local_year,
    mean_band,
    seconds_between,
    within,
)
from .skew import HotGroups, with_neighbours


def arrival_delay() -> Column:
    return seconds_between(F.col("arrivalTime"), F.col("aimedArrivalTime"))


def count_by(df: DataFrame, key: Column | str, name: str | None = None) -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    return df.groupBy(key.alias(name) if name else key).agg(F.count(F.lit(1)).alias("count"))


def source_volume(arrivals: DataFrame, since: date | None = None) -> DataFrame:
    """Rows per source and name on days after ``since``, largest first."""
    if since is not None:
        arrivals = arrivals.where(F.col("operatingDate") > F.lit(since))
    return (
        arrivals.groupBy("dataSource", "dataSourceName")
        .agg(F.count(F.lit(1)).alias("volume"))
        .orderBy(F.desc("volume"), "dataSource", "dataSourceName")
    )


def vehicle_counts(arrivals: DataFrame) -> DataFrame:
    return count_by(arrivals, F.coalesce("vehicleMode", F.lit("Unknown")), "vehicle")


def busiest_stops(arrivals: DataFrame, k: int = 10) -> DataFrame:
    return (
        count_by(arrivals, "stopPointName").orderBy(F.desc("count"), "stopPointName").limit(k)
    )


def journey_trace(arrivals: DataFrame, journey: str) -> DataFrame:
    return (
        arrivals.where(F.col("datedServiceJourneyId") == journey)
        .select("stopPointName", "sequenceNr", "aimedArrivalTime", "arrivalTime",
                "aimedDepartureTime", "departureTime")
        .orderBy("sequenceNr", "arrivalTime", "stopPointName")
    )


def delay_by_time(
    arrivals: DataFrame, stop: str, max_delay: float | None = None, tz: str = "UTC"
) -> DataFrame:
    """Mean delay at a stop by year, month and hour of arrival."""
    rows = arrivals.where(F.col("stopPointName") == stop)
    if max_delay is not None:
        rows = rows.where(within(arrival_delay(), max_delay))
    when = F.col("arrivalTime")
    return rows.groupBy(
        local_year(when, tz).cast("string").alias("year"),
        local_hour(when, tz).alias("hour"),
        local_month(when, tz).alias("month"),
    ).agg(F.avg(arrival_delay()).alias("delay_seconds"))


def delay_outliers(arrivals: DataFrame, stop: str, k: int = 30) -> DataFrame:
    """The ``k`` visits of a stop furthest from plan."""
    return (
        arrivals.where(F.col("stopPointName") == stop)
        .select("lineRef", "arrivalTime", "aimedArrivalTime", arrival_delay().alias("delay_seconds"))
        .orderBy(F.desc_nulls_last(F.abs("delay_seconds")), "lineRef", "arrivalTime", "aimedArrivalTime")
        .limit(k)
    )


def delay_by_line(
    arrivals: DataFrame, stop: str, k: int = 30, max_delay: float = 1800
) -> DataFrame:
    return (
        arrivals.where((F.col("stopPointName") == stop) & within(arrival_delay(), max_delay))
        .groupBy("lineRef")
        .agg(F.count(F.lit(1)).alias("count"), F.avg(arrival_delay()).alias("mean_delay_seconds"))
        .orderBy(F.desc("count"), "lineRef")
        .limit(k)
    )


def delay_samples(
    arrivals: DataFrame, stop: str, lines: Sequence[str], max_delay: float = 1200
) -> DataFrame:
    return arrivals.where(
        (F.col("stopPointName") == stop)
        & within(arrival_delay(), max_delay)
        & F.col("lineRef").isin(*lines)
    ).select("lineRef", "directionRef", arrival_delay().alias("delay_seconds"))


def histogram(df: DataFrame, col: str, facets: Sequence[str], bins: int = 30) -> DataFrame:
    """Counts in ``bins`` equal-width bins over the range of ``col``; bin 0 starts at the
    minimum and the last bin includes the maximum. The range is a scalar subquery and the
    counting combines map-side."""
    x = F.col(col).cast("double")
    span = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    ranged = df.where(x.isNotNull()).select(*facets, x.alias("_x"), lo.alias("_lo"), hi.alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    place = F.floor(F.try_divide(F.col("_x") - F.col("_lo"), width))
    number = F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int")
    return (
        ranged.groupBy(*facets, number.alias("bin"), (F.col("_lo") + number * width).alias("bin_start"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def delay_histogram(
    arrivals: DataFrame, stop: str, lines: Sequence[str], bins: int = 30, max_delay: float = 1200
) -> DataFrame:
    """Distribution of delays at a stop per line and direction."""
    samples = delay_samples(arrivals, stop, lines, max_delay)
    return histogram(samples, "delay_seconds", ["lineRef", "directionRef"], bins)


def stop_delay_by_sequence(
    arrivals: DataFrame,
    line: str,
    direction: str,
    first: int,
    last: int,
    year: int,
    by_route: bool = False,
    tz: str = "UTC",
) -> DataFrame:
    """Mean delay per stop on part of a line in one year, optionally per named route."""
    keys = [F.concat("originName", F.lit(" - "), "destinationName").alias("route")] if by_route else []
    return (
        arrivals.where(
            (F.col("lineRef") == line)
            & F.col("sequenceNr").between(first, last)
            & (F.col("directionRef") == direction)
            & (local_year(F.col("arrivalTime"), tz) == year)
        )
        .groupBy(*keys, "stopPointName", "sequenceNr")
        .agg(F.avg(arrival_delay()).alias("delay_seconds"))
        .orderBy("sequenceNr", "delay_seconds", "stopPointName")
    )


def delay_by_sequence(
    arrivals: DataFrame,
    line: str,
    facet: str = "year",
    since: date | None = None,
    max_delay: float = 1800,
    tz: str = "UTC",
) -> DataFrame:
    """Mean delay with its 95 % band along a line, per direction and year or named route."""
    rows = arrivals.where((F.col("lineRef") == line) & within(arrival_delay(), max_delay))
    if since is not None:
        rows = rows.where(F.col("operatingDate") >= F.lit(since))
    if facet == "year":
        hue = local_year(F.col("arrivalTime"), tz).cast("string").alias("year")
    else:
        hue = F.concat(
            "lineRef", F.lit(":"), "originName", F.lit(" - "), "destinationName"
        ).alias("route")
    return rows.groupBy("directionRef", hue, "sequenceNr").agg(*mean_band(arrival_delay()))


def missing_endpoints(arrivals: DataFrame) -> DataFrame:
    """Share of rows without a named origin / destination, in whole percent."""
    share = lambda c: F.rint(
        F.lit(100.0) * F.avg(F.col(c).isNull().cast("double"))
    ).cast("int")
    return arrivals.agg(
        share("originName").alias("missing_origin"),
        share("destinationName").alias("missing_destination"),
    )


def lead_gap_stats(arrivals: DataFrame, hot: HotGroups | None = None) -> DataFrame:
    """Extremes and ``sum / rows`` of the time from one stop to the next."""
    gaps = with_neighbours(
        arrivals.select("datedServiceJourneyId", "sequenceNr", "stopPointRef", "arrivalTime"),
        ["datedServiceJourneyId"], ["sequenceNr", "stopPointRef", "arrivalTime"],
        next=["arrivalTime"], hot=hot,
    ).select(seconds_between(F.col("next_arrivalTime"), F.col("arrivalTime")).alias("gap"))
    return gaps.agg(
        F.max("gap").alias("max_gap"),
        F.min("gap").alias("min_gap"),
        (F.sum("gap") / F.count(F.lit(1))).alias("sum_over_rows"),
    )


def since_time(column: str, since: date | datetime, strict: bool = False) -> Column:
    """``column >= since`` (``>`` with ``strict``) with ``since`` read as UTC, whatever the session's zone."""
    at = datetime(since.year, since.month, since.day) if not isinstance(since, datetime) else since
    seconds = int((at.replace(tzinfo=None) - datetime(1970, 1, 1)).total_seconds())
    at = F.timestamp_seconds(F.lit(seconds))
    return F.col(column) > at if strict else F.col(column) >= at
