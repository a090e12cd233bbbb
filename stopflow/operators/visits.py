"""From raw stop visits to cleaned ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import micros_to_seconds, visit_delay, visit_start
from ..schemas import FLAGS, JOURNEY
from .skew import (
    HOT_ROWS,
    NO_HOT,
    HotGroups,
    bounded_broadcast,
    broadcast_left_join,
    chunk_neighbours,
    hot_groups,
    nulls_last,
    order_key,
    ordered_chunks,
    partitioned_by,
    split_hot,
)

# The order of visits in a journey. A stop id stands for every quay of the stop, so several
# rows may share a sequence number; the columns after it make the order total (up to rows
# that are equal in all that cleaning and legs carry on).
VISIT_ORDER = [
    "sequenceNr", "quay_id", "arrivalTime", "departureTime", "aimedArrivalTime",
    "aimedDepartureTime", "lineRef", "directionRef", "dataSource",
]
STARTS = ["left_at", "due_to_leave"]

CLEAN_COLUMNS = [
    "lineRef", "directionRef", "operatingDate", "serviceJourneyId", "operatorRef",
    "extraJourney", "stop", "lat", "lon", "sequenceNr", "originName", "destinationName",
    "aimedArrivalTime", "arrivalTime", "aimedDepartureTime", "departureTime", "dataSource",
    "dataSourceName",
]


def stop_dimension(stops: DataFrame, quays: DataFrame) -> DataFrame:
    """One row per quay with its stop; the stop's name and position win over the quay's."""
    s, q = stops.alias("s"), quays.alias("q")
    pick = lambda c: F.coalesce(f"s.{c}", f"q.{c}")
    return s.join(q, F.col("s.id") == F.col("q.stopPlaceRef")).select(
        F.col("q.id").alias("quay_id"),
        F.col("s.id").alias("stop_id"),
        pick("location_latitude").alias("lat"),
        pick("location_longitude").alias("lon"),
        pick("name").alias("name"),
    )


def stop_lookup(stopdata: DataFrame) -> DataFrame:
    """Geometry by either the quay id or the stop id.

    Both kinds of id go into one lookup, so the fact is read and joined once: a join with
    the union of two lookups is the union of the two joins.
    """
    place = ["quay_id", "stop_id", "lat", "lon", F.col("name").alias("stop")]
    return stopdata.select(F.col("quay_id").alias("stopPointRef"), *place).unionByName(
        stopdata.select(F.col("stop_id").alias("stopPointRef"), *place)
    )


def place_visits(arrivals: DataFrame, stopdata: DataFrame, hot: HotGroups = NO_HOT) -> DataFrame:
    """Attach geometry; rows come out partitioned by journey.

    If the lookup is small enough to broadcast, the visits are shuffled before they are
    widened (and multiplied by stop ids), otherwise after the join.
    """
    lookup = stop_lookup(stopdata)
    checked = bounded_broadcast(lookup)
    if checked is lookup:
        placed = arrivals.join(lookup, "stopPointRef")
        return partitioned_by(placed, JOURNEY, hot) if hot.total else placed.repartition(*JOURNEY)
    dealt = partitioned_by(arrivals, JOURNEY, hot) if hot.total else arrivals.repartition(*JOURNEY)
    return dealt.join(checked, "stopPointRef")


def _number() -> Column:
    """Sequence number of a visit; an unknown one comes last."""
    return F.coalesce("sequenceNr", F.lit(2**63 - 1))


def _flag_starts() -> dict[str, Column]:
    """Aggregates over a journey: the first number at which any flag is set, and for each
    flag the first number at which it is known. A running "was any flag set so far" is true
    from the former on and NULL before the latter."""
    flagged = F.lit(False)
    for c in FLAGS:
        flagged = flagged | F.coalesce(c, F.lit(False))
    return {
        "bad_from": F.min(F.when(flagged, _number())),
        **{f"known_{c}": F.min(F.when(F.col(c).isNotNull(), _number())) for c in FLAGS},
    }


def _judged_by_window(visits: DataFrame) -> DataFrame:
    """Every window rides on the one shuffle by journey that placing made.

    ``first_visit`` ends the journey order, so Catalyst must compute it first. The journey
    order is then sorted once and still holds for the windows that build legs from the
    result.
    """
    at_quay = Window.partitionBy(*JOURNEY, "stop_id", "quay_id").orderBy(*nulls_last(VISIT_ORDER))
    along = Window.partitionBy(*JOURNEY).orderBy(*nulls_last([*VISIT_ORDER, "first_visit"]))
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        visits.withColumn("first_visit", F.row_number().over(at_quay) == 1)
        .select(
            "*",
            *[F.lag(c).over(along).alias(f"prev_{c}") for c in STARTS],
            *[agg.over(whole).alias(name) for name, agg in _flag_starts().items()],
        )
    )


def _judged_by_chunks(visits: DataFrame, hot: HotGroups, chunk_rows: int) -> DataFrame:
    """The same columns for journeys too large for one task: the minima per journey are
    combined map-side, and the first visit per quay is a minimum per (journey, quay) that
    is joined back on the unique row number."""
    chunks = ordered_chunks(visits, JOURNEY, VISIT_ORDER, hot.rows, chunk_rows)
    out = chunk_neighbours(chunks, JOURNEY, VISIT_ORDER, prev=STARTS)

    starts = chunks.groupBy(*JOURNEY).agg(*[a.alias(n) for n, a in _flag_starts().items()])
    # one row per hot journey, whose number the sketch bounds
    out = broadcast_left_join(out, starts, JOURNEY)
    firsts = (
        chunks.groupBy(*JOURNEY, "stop_id", "quay_id")
        .agg(F.min_by("_uid", order_key([*VISIT_ORDER, "_uid"])).alias("_uid"))
        .select("_uid", F.lit(True).alias("first_visit"))
    )
    return (
        out.join(firsts, "_uid", "left")
        .withColumn("first_visit", F.coalesce("first_visit", F.lit(False)))
        .drop("_uid", "_chunk")
    )


def clean_arrivals(
    arrivals: DataFrame,
    stopdata: DataFrame,
    max_jump: float = 7200,
    max_delay: float = 7200,
    hot: HotGroups | None = None,
    chunk_rows: int = HOT_ROWS,
) -> DataFrame:
    """Visits fit for analysis, with stop name and position.

    Dropped are repeated visits of a quay within a journey, everything from the first
    cancelled / extra / estimated visit of a journey on (also while a flag is unknown),
    jumps (actual minus planned time since the previous visit) above ``max_jump`` and
    delays of ``max_delay`` or more. All tests see the rows before any is dropped.
    ``quay_id`` stays on as the last column because it orders visits with equal numbers.
    """
    if hot is None:
        hot = hot_groups(arrivals, JOURNEY)
    started = arrivals.select(
        "*", visit_start().alias("left_at"), visit_start(planned=True).alias("due_to_leave")
    )
    cold, big = split_hot(started, JOURNEY, hot)
    judged = _judged_by_window(place_visits(cold, stopdata, hot))
    if big is not None:
        placed = big.join(bounded_broadcast(stop_lookup(stopdata)), "stopPointRef")
        judged = judged.unionByName(_judged_by_chunks(placed, hot, chunk_rows))

    since = lambda now, start: F.coalesce(
        micros_to_seconds(F.unix_micros(now) - F.col(start)), F.lit(0.0)
    )
    jump = since("arrivalTime", "prev_left_at") - since("aimedArrivalTime", "prev_due_to_leave")
    number, delay = _number(), visit_delay()
    good = F.col("bad_from").isNull() | (number < F.col("bad_from"))
    for c in FLAGS:
        good = good & (number >= F.col(f"known_{c}"))
    return judged.where(
        F.col("first_visit")
        & good
        & (F.abs(jump) <= max_jump)
        & (delay.isNull() | (F.abs(delay) < max_delay))
    ).select(*CLEAN_COLUMNS, "quay_id")
