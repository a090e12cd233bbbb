"""Travel between consecutive stops of a journey."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import (
    geodesic_meters,
    micros_to_seconds,
    round_to,
    speed_kmh,
    visit_delay,
    visit_start,
)
from ..schemas import JOURNEY, LEGS
from .routes import ROUTE
from .skew import HOT_ROWS, HotGroups, bounded_broadcast, with_neighbours
from .visits import VISIT_ORDER

#: Columns of the cleaned visits that route names and legs are made from.
LEG_INPUT = list(dict.fromkeys([*ROUTE, "serviceJourneyId", *VISIT_ORDER, "stop", "lat", "lon"]))


def candidate_legs(
    clean: DataFrame,
    hot: HotGroups | None = None,
    max_delay: int = 7200,
    max_planned: int = 7200,
    max_deviation: int = 7200,
    max_speed: float = 250,
    chunk_rows: int = HOT_ROWS,
) -> DataFrame:
    """Legs without their canonical direction.

    A visit with a NULL route key has no direction and takes no part. The windows have the
    journey partitioning that cleaning already produced, hence no further shuffle.
    """
    known = clean.where(" AND ".join(f"{c} IS NOT NULL" for c in ROUTE)).select(
        *LEG_INPUT,
        F.unix_micros("arrivalTime").alias("arrived"),
        F.unix_micros("aimedArrivalTime").alias("due"),
        visit_start().alias("left_at"),
        visit_start(planned=True).alias("due_to_leave"),
        round_to(visit_delay()).alias("delay"),
    )
    pairs = with_neighbours(
        known, JOURNEY, VISIT_ORDER, hot=hot, chunk_rows=chunk_rows,
        prev=["sequenceNr", "left_at", "due_to_leave", "stop", "lat", "lon"],
    )
    whole_seconds = lambda end, start: round_to(
        micros_to_seconds(F.col(end) - F.col(start))
    )
    # The one-element explode binds the durations once for the tests and the result.
    bound = pairs.withColumn("t", F.explode(F.array(F.struct(
        whole_seconds("arrived", "prev_left_at").alias("actual"),
        whole_seconds("due", "prev_due_to_leave").alias("planned"),
    ))))
    timed = bound.select(
        *ROUTE, "serviceJourneyId",
        F.col("prev_sequenceNr").alias("sequenceNr"),
        F.timestamp_micros("prev_left_at").alias("start_time"),
        F.col("t.actual").alias("actual_duration"),
        F.col("t.planned").alias("planned_duration"),
        "delay",
        F.col("stop").alias("to_stop"),
        F.col("prev_stop").alias("from_stop"),
        F.col("lat").alias("to_lat"),
        F.col("lon").alias("to_lon"),
        F.col("prev_lat").alias("from_lat"),
        F.col("prev_lon").alias("from_lon"),
    ).withColumn("deviation", F.col("actual_duration") - F.col("planned_duration"))
    plausible = timed.where(
        (F.abs("delay") < max_delay)
        & F.col("from_stop").isNotNull()
        & F.col("start_time").isNotNull()
        & F.col("planned_duration").between(0, max_planned)
        & (F.abs("deviation") < max_deviation)
        & (F.col("actual_duration") > 1)
    )
    km = F.col("air_distance_meters") / F.lit(1000.0)
    return geodesic_meters(plausible).where(
        (F.col("air_distance_meters") > 0) & (speed_kmh(km, F.col("actual_duration")) < max_speed)
    )


def with_direction(candidates: DataFrame, canonical: DataFrame) -> DataFrame:
    named = canonical.select(*ROUTE, "direction")
    return candidates.join(named, ROUTE).select(*LEGS.fieldNames())


def legs(
    clean: DataFrame, canonical: DataFrame, hot: HotGroups | None = None, **limits
) -> DataFrame:
    """Legs of all journeys in ``clean``. ``canonical`` is :func:`canonical_direction` of
    route names that cover the same visits, so it has one row for each route key in them. It is
    broadcast if small, so the legs keep the partitioning by journey."""
    return with_direction(candidate_legs(clean, hot, **limits), bounded_broadcast(canonical))


def with_speed(
    df: DataFrame, km: str = "air_distance_km", out: str = "speed_kmh_upper_bound"
) -> DataFrame:
    """Add the speed that a leg's distance and duration imply (NULL for zero seconds)."""
    return df.withColumn(out, speed_kmh(F.col(km), F.col("actual_duration")))
