"""Whole journeys: their quality, their stop order and the delays along them."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions import local_hour, seconds_between
from ..functions.stats import DECILES
from ..schemas import FLAGS, JOURNEY
from .histograms import disc, rows_behind, value_counts, with_shares
from .leg_stats import weekdays
from .skew import HOT_ROWS, NO_HOT, HotGroups, hot_groups, order_key, partitioned_by, split_hot, with_neighbours, with_positions

LINE = ["lineRef", "directionRef"]
QUANTILES = ["first_decile", "first_quartile", "median", "last_quartile", "last_decile"]


def _any_flag(over: WindowSpec | None = None) -> Column:
    """Whether any flag was set in the group or window (NULL while unknown and none is known set)."""
    each = [F.bool_or(c) if over is None else F.bool_or(c).over(over) for c in FLAGS]
    return functools.reduce(lambda a, b: a | b, each)


def selected_journeys(arrivals: DataFrame) -> DataFrame:
    """Journeys without any cancelled, extra or estimated visit."""
    return arrivals.groupBy(*JOURNEY).agg(_any_flag().alias("_bad")).where(~F.col("_bad")).drop("_bad")


def rejected_journey_count(arrivals: DataFrame) -> DataFrame:
    bad = arrivals.groupBy(*JOURNEY).agg(_any_flag().alias("_bad")).where("_bad")
    return bad.agg(F.count(F.lit(1)).alias("rejected"))


def journey_count(arrivals: DataFrame) -> DataFrame:
    return arrivals.select(*JOURNEY).distinct().agg(F.count(F.lit(1)).alias("journeys"))


def rejection_reasons(arrivals: DataFrame) -> DataFrame:
    """Number of journeys per flag."""
    per_journey = arrivals.groupBy(*JOURNEY).agg(*[F.bool_or(c).alias(c) for c in FLAGS])
    return per_journey.agg(*[F.sum(F.col(c).cast("int")).alias(c) for c in FLAGS])


def cancelled_visits(arrivals: DataFrame, flag: str = "journeyCancellation", k: int | None = 10):
    rows = arrivals.where(F.col(flag)).orderBy("serviceJourneyId", "operatingDate", "sequenceNr")
    return rows if k is None else rows.limit(k)


def after_cancellation(arrivals: DataFrame) -> DataFrame:
    """Every visit that follows a cancelled one in its journey, next to the first such one.

    The cancelled side is reduced to one row per journey first, so the join with its
    ``later than`` condition returns each visit at most once and never all pairs.
    """
    first = (
        arrivals.where("journeyCancellation")
        .groupBy(*JOURNEY)
        .agg(F.min(F.struct("sequenceNr", "arrivalTime")).alias("_first"))
    )
    return (
        arrivals.join(first, JOURNEY)
        .where(F.col("sequenceNr") > F.col("_first.sequenceNr"))
        .select(
            "lineRef", *JOURNEY,
            F.col("_first.arrivalTime").alias("cancelled_time"), "arrivalTime",
            F.col("_first.sequenceNr").alias("cancelled_nr"), "sequenceNr", "estimated",
        )
    )


def cancellation_context(
    arrivals: DataFrame, k: int | None = 20, hot: HotGroups | None = None
) -> DataFrame:
    """Cancelled stops next to the cancelled stops around them in the journey."""
    rows = arrivals.where("stopCancellation AND NOT estimated").select(
        *JOURNEY, "journeyCancellation", "sequenceNr", "arrivalTime", "stopCancellation", "stopPointRef"
    )
    near = with_neighbours(
        rows, JOURNEY, ["sequenceNr", "stopPointRef", "arrivalTime"], hot=hot,
        prev=["sequenceNr", "arrivalTime", "stopCancellation"],
        next=["sequenceNr", "arrivalTime", "stopCancellation"],
    )
    out = (
        near.where("prev_sequenceNr IS NOT NULL OR next_sequenceNr IS NOT NULL")
        .select(
            *JOURNEY, "journeyCancellation", "sequenceNr",
            F.col("prev_sequenceNr").alias("last_seen"),
            F.col("next_sequenceNr").alias("next_seen"),
            "arrivalTime",
            F.col("prev_arrivalTime").alias("last_seen_time"),
            F.col("next_arrivalTime").alias("next_seen_time"),
            F.col("prev_stopCancellation").alias("last_canceled"),
            F.col("next_stopCancellation").alias("next_canceled"),
        )
        .orderBy(*JOURNEY, "sequenceNr")
    )
    return out if k is None else out.limit(k)


def of_selected(
    arrivals: DataFrame, selected: DataFrame | None = None, hot: HotGroups | None = None
) -> DataFrame:
    """Visits of :func:`selected_journeys`, partitioned by journey.

    The flags are carried to every visit of a journey by a window, so the visits are read and shuffled once.
    Journeys too large for one task are judged by an aggregate instead, one row each. ``selected`` uses a
    list that is there already.
    """
    if selected is not None:
        return arrivals.join(selected, JOURNEY, "left_semi")
    if hot is None:
        hot = hot_groups(arrivals, JOURNEY)
    cold, big = split_hot(arrivals, JOURNEY, hot)
    kept = (
        partitioned_by(cold.where(" AND ".join(f"{c} IS NOT NULL" for c in JOURNEY)), JOURNEY, hot)
        .withColumn("_bad", _any_flag(Window.partitionBy(*JOURNEY))).where(~F.col("_bad")).drop("_bad")
    )
    if big is None:
        return kept
    # one row for each hot journey, whose number the sketch bounds
    return kept.unionByName(big.join(F.broadcast(selected_journeys(big)), JOURNEY, "left_semi"))


def route_endpoints(
    arrivals: DataFrame, selected: DataFrame | None = None, hot: HotGroups | None = None
) -> DataFrame:
    """Distinct (origin, destination) per line and direction over the good journeys."""
    at = F.when(F.col("stopPointRef").isNotNull(), F.struct("sequenceNr", "stopPointRef"))
    ends = of_selected(arrivals, selected, hot).groupBy(*LINE, *JOURNEY).agg(
        F.min_by("stopPointRef", at).alias("origin"), F.max_by("stopPointRef", at).alias("destination")
    )
    return ends.select(*LINE, "origin", "destination").distinct()


SEQUENCE = ["sequenceNr", "stopPointRef"]


def stop_order(
    arrivals: DataFrame,
    selected: DataFrame | None = None,
    weekdays_only: bool = False,
    line: str | None = None,
    hot: HotGroups | None = None,
    chunk_rows: int = HOT_ROWS,
) -> DataFrame:
    """Distinct stop sequences per line and direction, by (number, stop), unknown ones last.

    A sequence is one array value. Ordinary journeys are shuffled once and make theirs where they lie; those too large
    for one task go through :func:`_long_sequences`.
    """
    if weekdays_only:
        arrivals = weekdays(arrivals, F.col("operatingDate"))
    if line is not None:
        arrivals = arrivals.where(F.col("lineRef") == line)
    if hot is None:
        hot = hot_groups(arrivals, JOURNEY) if selected is None else NO_HOT
    rows = of_selected(arrivals, selected, hot).select(*LINE, *JOURNEY, *SEQUENCE)
    cold, big = split_hot(rows, JOURNEY, hot)
    visits = F.array_sort(F.collect_list(order_key(SEQUENCE)))
    orders = (
        cold.groupBy(*LINE, *JOURNEY).agg(F.transform(visits, lambda v: v["v1"]).alias("stops"))
        .select(*LINE, "stops").distinct()
    )
    if big is None:
        return orders
    return orders.unionByName(_long_sequences(big, hot, chunk_rows)).distinct()


def _long_sequences(rows: DataFrame, hot: HotGroups, chunk_rows: int) -> DataFrame:
    """Distinct sequences of very long journeys.

    Positions come from the ordered chunks of ``skew``. Two hashes of (position, stop), combined by exclusive or
    map-side in any order, name a journey's sequence; one journey of each name stands for all. Only those
    journeys' chunks become arrays, and only these, in their order, the sequence.
    """
    group = [*LINE, *JOURNEY]
    placed = with_positions(rows, group, SEQUENCE, hot_groups(rows, group, 1), chunk_rows).withColumn(
        "_chunk", F.floor((F.col("position") - 1) / F.lit(chunk_rows))
    )
    seeded = lambda k: F.bit_xor(F.xxhash64(F.lit(k), "position", "stopPointRef"))
    names = placed.groupBy(*group).agg(
        seeded(1).alias("h1"), seeded(2).alias("h2"), F.count(F.lit(1)).alias("size")
    )
    one = Window.partitionBy(*LINE, "h1", "h2", "size").orderBy(*JOURNEY)
    # one row for each variant of a hot journey, whose number the sketch bounds
    chosen = F.broadcast(names.withColumn("_n", F.row_number().over(one)).where("_n = 1").select(*group))
    same = F.lit(True)
    for c in group:
        same = same & F.col(f"p.{c}").eqNullSafe(F.col(f"c.{c}"))
    parts = (
        placed.alias("p").join(chosen.alias("c"), same, "left_semi")
        .groupBy(*group, "_chunk").agg(F.array_sort(F.collect_list(F.struct("position", "stopPointRef"))).alias("part"))
    )
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_chunk", "part"))), lambda c: c["part"]))
    return parts.groupBy(*group).agg(F.transform(whole, lambda v: v["stopPointRef"]).alias("stops")).select(*LINE, "stops")


def variant_lengths(orders: DataFrame) -> DataFrame:
    return orders.select(*LINE, F.size("stops").alias("len"))


def ambiguous(variants: DataFrame, keys: Sequence[str] = LINE) -> DataFrame:
    """Keys that occur more than once."""
    return variants.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).where("count > 1")


def line_direction_count(arrivals: DataFrame) -> DataFrame:
    return arrivals.select(*LINE).distinct().agg(F.count(F.lit(1)).alias("count"))


def canonical_ordering(
    arrivals: DataFrame, selected: DataFrame | None = None, hot: HotGroups | None = None
) -> DataFrame:
    """Place of each stop on a line and direction: its highest sequence number."""
    return (
        of_selected(arrivals, selected, hot)
        .groupBy(*LINE, "stopPointRef")
        .agg(F.max("sequenceNr").alias("scheduleNr"))
    )


def ordering_conflicts(ordering: DataFrame) -> DataFrame:
    """Number of (line, direction) in which two stops have the same place."""
    clashes = ambiguous(ordering, [*LINE, "scheduleNr"]).select(*LINE).distinct()
    return clashes.agg(F.count(F.lit(1)).alias("conflicts"))


def delay_quantiles(
    arrivals: DataFrame,
    by_place: bool = False,
    weekdays_only: bool = False,
    selected: DataFrame | None = None,
    tz: str = "UTC",
    hot: HotGroups | None = None,
) -> DataFrame:
    """Delay deciles and quartiles per line, direction, stop and hour.

    Stops are told apart by reference and raw number, or ``by_place`` of :func:`canonical_ordering`. Visits are read and
    counted once, by stop, hour and delay; places, too, come from those counts (of all days, hence the days that do not
    take part are counted as well).
    """
    seen = F.coalesce("arrivalTime", "departureTime")
    used = F.lit(True) if not weekdays_only else ~F.dayofweek("operatingDate").isin(1, 7)
    stop = [*LINE, "stopPointRef"]
    rows = of_selected(arrivals, selected, hot).select(
        *stop, "sequenceNr", local_hour(seen, tz).alias("hour"), used.alias("used"),
        seconds_between(seen, F.coalesce("aimedArrivalTime", "aimedDepartureTime")).alias("delay_seconds"),
    )
    if not by_place:
        rows = rows.where("used")
    counts = value_counts(rows, [*stop, "sequenceNr", "hour", "used"], ["delay_seconds"], kind="double")
    counts = counts.repartition(*stop)
    group = [*stop, "sequenceNr", "hour"]
    if by_place:
        group = [*LINE, "scheduleNr", "hour"]
        placed = counts.withColumn("scheduleNr", F.max("sequenceNr").over(Window.partitionBy(*stop)))
        counts = placed.where("used AND stopPointRef IS NOT NULL").where(" AND ".join(f"{c} IS NOT NULL" for c in LINE))
        counts = counts.groupBy(*group, "measure", "value").agg(F.sum("n").alias("n"))
    return with_shares(counts, group).groupBy(*group).agg(
        *[disc("delay_seconds", p).alias(n) for n, p in zip(QUANTILES, DECILES)],
        rows_behind("delay_seconds").alias("count"),
    )


def quantiles_long(quantiles: DataFrame, keep: Sequence[str], values: Sequence[str] = QUANTILES):
    """One row per quantile instead of one column."""
    typed = quantiles.select(*keep, *[F.col(v).cast("double").alias(v) for v in values])
    return typed.unpivot(list(keep), list(values), "quantity", "delay")
