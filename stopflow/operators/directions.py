"""What a direction means over time, asked of the legs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import month_start, quantile_disc
from ..schemas import JOURNEY

LINE_DAY = ["operatingDate", "lineRef", "directionRef"]


def _grain(grain: str) -> list[Column]:
    """Grouping by time: ``total``, ``month`` or ``day``."""
    day = F.col("operatingDate")
    return {"total": [], "month": [month_start(day).alias("month")], "day": [day]}[grain]


def _between(legs: DataFrame, start: date | None, end: date | None) -> DataFrame:
    if start is not None:
        legs = legs.where(F.col("operatingDate").between(F.lit(start), F.lit(end)))
    return legs


def direction_counts(
    legs: DataFrame,
    line: str,
    grain: str = "total",
    from_stop: str | None = None,
    to_stop: str | None = None,
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """Legs of a line (between two stops) per direction in total, per month or per day."""
    rows = _between(legs.where(F.col("lineRef") == line), start, end)
    if from_stop is not None:
        rows = rows.where((F.col("from_stop") == from_stop) & (F.col("to_stop") == to_stop))
    return rows.groupBy("directionRef", *_grain(grain)).agg(F.count(F.lit(1)).alias("count"))


def pick_journey(legs: DataFrame, line: str, day: date) -> DataFrame:
    """One journey of a line on a day: the first by id."""
    return (
        legs.where((F.col("lineRef") == line) & (F.col("operatingDate") == F.lit(day)))
        .groupBy(*JOURNEY).agg(F.count(F.lit(1)).alias("n")).drop("n")
        .orderBy(*JOURNEY)
        .limit(1)
    )


def trace_journey(legs: DataFrame, choice: DataFrame) -> DataFrame:
    """Legs of the chosen journey (``choice`` is a single row)."""
    return (
        legs.join(F.broadcast(choice), JOURNEY)
        .select(*JOURNEY, "directionRef", "sequenceNr", "start_time", "from_stop", "to_stop")
        .orderBy("sequenceNr", "from_stop", "to_stop")
    )


def journey_endpoints(trace: DataFrame) -> DataFrame:
    """Origin and destination of the journey on each of its rows. For a trace of chosen
    journeys, hence windows no larger than those."""
    w = Window.partitionBy(*JOURNEY)
    return trace.select(
        "*",
        F.min_by("from_stop", F.struct("sequenceNr", "from_stop")).over(w).alias("origin"),
        F.max_by("to_stop", F.struct("sequenceNr", "to_stop")).over(w).alias("destination"),
    )


def route_name_ranked(legs: DataFrame) -> DataFrame:
    """Most common (origin, destination) by journeys per day, line and direction, ties kept,
    with the direction under which the route was first seen.

    Journeys are counted per pair before the windows, which then hold at most one row per
    distinct pair and day.
    """
    ends = legs.groupBy(*LINE_DAY, "serviceJourneyId").agg(
        F.min_by("from_stop", F.struct("sequenceNr", "from_stop")).alias("origin"),
        F.max_by("to_stop", F.struct("sequenceNr", "to_stop")).alias("destination"),
    )
    counts = ends.groupBy(*LINE_DAY, "origin", "destination").agg(F.count(F.lit(1)).alias("count"))
    seen = F.struct("operatingDate", "directionRef")
    route = Window.partitionBy("lineRef", "origin", "destination")
    day = Window.partitionBy(*LINE_DAY)
    return (
        counts.withColumn("canonical_direction", F.min_by("directionRef", seen).over(route))
        .withColumn("_most", F.max("count").over(day))
        .where(F.col("count") == F.col("_most"))
        .drop("_most")
    )


def route_counts(
    legs: DataFrame,
    names: DataFrame,
    line: str,
    stop_a: str,
    stop_b: str,
    grain: str = "month",
    canonical: bool = False,
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """Legs between two stops, either way, per named route and raw or canonical direction.

    Legs are counted per day and direction before the names are joined, so the join works
    on daily counts and not on single legs.
    """
    pair = ((F.col("from_stop") == stop_a) & (F.col("to_stop") == stop_b)) | (
        (F.col("from_stop") == stop_b) & (F.col("to_stop") == stop_a)
    )
    daily = (
        _between(legs.where((F.col("lineRef") == line) & pair), start, end)
        .groupBy(*LINE_DAY).agg(F.count(F.lit(1)).alias("n"))
    )
    direction = "canonical_direction" if canonical else "directionRef"
    named = daily.join(names.select(*LINE_DAY, "origin", "destination", "canonical_direction"), LINE_DAY)
    return named.groupBy(
        direction, *_grain(grain),
        F.concat("origin", F.lit(" to "), "destination").alias("route_name"),
    ).agg(F.sum("n").alias("count"))


def direction_effect(
    legs: DataFrame, names: DataFrame, line: str, start: date, end: date
) -> DataFrame:
    """Upper quartile of the delay at the last stop per day, by raw and by canonical
    direction."""
    last = F.max_by("delay", F.struct("sequenceNr", "delay"))
    final = (
        _between(legs.where(F.col("lineRef") == line), start, end)
        .groupBy(*LINE_DAY, "serviceJourneyId").agg(last.alias("delay"))
    )
    figure = quantile_disc("delay", 0.75, "int").alias("delay")
    regular = final.groupBy("operatingDate", "directionRef").agg(figure)
    renamed = final.join(names.select(*LINE_DAY, "canonical_direction"), LINE_DAY)
    canonical = renamed.groupBy(
        "operatingDate", F.col("canonical_direction").alias("directionRef")
    ).agg(figure)
    return regular.withColumn("kind", F.lit("directionRef")).unionByName(
        canonical.withColumn("kind", F.lit("canonical"))
    )
