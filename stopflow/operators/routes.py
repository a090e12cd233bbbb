"""Names of routes and directions that stay stable over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..schemas import JOURNEY
from .skew import NO_HOT, HotGroups, first_rows, split_hot

ROUTE = ["operatingDate", "dataSource", "lineRef", "directionRef"]


def route_names(clean: DataFrame, hot: HotGroups = NO_HOT) -> DataFrame:
    """Most common (destination, origin) per day, source, line and direction.

    Ties go to the alphabetically first pair, and the pair stays together. The ends of a journey are the first and
    last known stop of a window that rides on the partitioning by journey; one row of it is counted.
    Journeys too large for one task (``hot``) find theirs by an aggregate, combined before the shuffle.
    """
    known = F.col("sequenceNr").isNotNull() & F.col("stop").isNotNull()
    journey = ["serviceJourneyId", *ROUTE]
    cold, big = split_hot(clean.select(*journey, "sequenceNr", "quay_id", "stop"), JOURNEY, hot)
    along = Window.partitionBy(*journey).orderBy("sequenceNr", "quay_id")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stop = F.when(known, F.col("stop"))
    ends = (
        cold.select(
            *ROUTE, F.last(stop, ignorenulls=True).over(whole).alias("destination"),
            F.first(stop, ignorenulls=True).over(whole).alias("origin"), F.row_number().over(along).alias("_n"),
        )
        .where("_n = 1").drop("_n")
    )
    if big is not None:
        place = F.when(known, F.struct("sequenceNr", "quay_id"))
        ends = ends.unionByName(
            big.groupBy(*journey)
            .agg(F.max_by("stop", place).alias("destination"), F.min_by("stop", place).alias("origin"))
            .drop("serviceJourneyId")
        )
    counted = ends.groupBy(*ROUTE, "destination", "origin").agg(F.count(F.lit(1)).alias("n"))
    best = first_rows(counted, ROUTE, [F.desc("n"), F.asc("destination"), F.asc("origin")])
    return best.select(*ROUTE, "destination", "origin")


def canonical_direction(
    names: DataFrame,
    route: Sequence[str] = ("dataSource", "lineRef", "origin", "destination"),
    out: str = "direction",
) -> DataFrame:
    """Add the direction under which the route was first seen (ties: the smaller name).

    ``names`` has one row per day, line and direction, so a window group holds at most
    days x directions rows.
    """
    seen = F.struct("operatingDate", "directionRef")
    w = Window.partitionBy(*route)
    return names.withColumn(out, F.min_by("directionRef", seen).over(w))
