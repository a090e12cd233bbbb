"""The first formulation of legs (by successor join) and the questions asked of it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import (
    describe_columns,
    haversine_km,
    local_hour,
    local_month,
    local_year,
    map_point,
    mean_band,
    percent,
    quantile_disc,
    seconds_between,
    stats_struct,
    within,
)
from .delays import since_time
from .legs import with_speed
from .skew import HotGroups, bounded_broadcast, hot_groups, partitioned_by, split_hot

NAMED_PAIR = ["previous_stop_name", "stop_name"]
#: A journey of so many visits is no journey.
HOT_JOURNEY_ROWS = 200_000
#: Legs of an hour from which on its distribution is shown.
STRUCT_COUNT = 28


def legs_by_selfjoin(
    arrivals: DataFrame,
    max_deviation: float = 1800,
    max_delay: float = 3600,
    hot: HotGroups | None = None,
    salts: int | None = None,
) -> DataFrame:
    """Pair each visit with the one whose number is lower by one in the same journey.

    Visits are shuffled once, by journey; a window over the numbers then holds exactly the visits with the number
    before (several where a number is repeated: every pair is a leg). Numbers with gaps give no leg. Cancelled and
    extra visits are left out. Journeys too large for one task (``hot``; say, a placeholder for a third of all
    visits) are joined by (journey, number) instead, the earlier side copied to ``salts`` parts of the later one.
    """
    key = "datedServiceJourneyId"
    if hot is None:
        hot = hot_groups(arrivals, [key], HOT_JOURNEY_ROWS)
    timed = arrivals.where(
        F.col("arrivalTime").isNotNull() & F.col("aimedArrivalTime").isNotNull()
        & F.col(key).isNotNull() & F.col("sequenceNr").isNotNull()
    ).select(
        key, "sequenceNr", "lineRef", F.col("stopPointName").alias("stop_name"), F.col("stopPointRef").alias("stop"),
        "arrivalTime", "aimedArrivalTime",
        F.coalesce(~(F.col("journeyCancellation") | F.col("stopCancellation") | F.col("extraCall")), F.lit(False))
        .alias("_served"),
    )
    before = {"stop_name": "previous_stop_name", "stop": "previous_stop", "arrivalTime": "_arrival", "aimedArrivalTime": "_aimed"}
    cold, big = split_hot(timed, [key], hot)
    number_before = Window.partitionBy(key).orderBy("sequenceNr").rangeBetween(-1, -1)
    paired = (
        partitioned_by(cold, [key], hot).withColumn("_before", F.collect_list(F.struct(*[F.col(c).alias(n) for c, n in before.items()])).over(number_before))
        .where("_served").select(*timed.columns, F.inline("_before"))
    )
    if big is not None:
        salts = salts or int(arrivals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
        earlier = big.select(key, (F.col("sequenceNr") + 1).alias("sequenceNr"), *[F.col(c).alias(n) for c, n in before.items()])
        part = F.pmod(F.xxhash64("arrivalTime", "aimedArrivalTime", "stop", "lineRef", F.monotonically_increasing_id()), F.lit(salts))
        paired = paired.unionByName(
            big.where("_served").withColumn("_part", part.cast("int"))
            .join(earlier.withColumn("_part", every), [key, "sequenceNr", "_part"]).drop("_part")
        )
    out = paired.select(
        "lineRef", "previous_stop_name", "previous_stop", "stop_name", "stop", key,
        F.col("arrivalTime").alias("time"),
        F.col("aimedArrivalTime").alias("planned_time"),
        seconds_between(F.col("aimedArrivalTime"), F.col("_aimed")).alias("planned_duration"),
        seconds_between(F.col("arrivalTime"), F.col("_arrival")).alias("actual_duration"),
    )
    out = out.withColumn("deviation", F.col("actual_duration") - F.col("planned_duration"))
    out = out.withColumn("delay", seconds_between(F.col("time"), F.col("planned_time")))
    return out.where(within(F.col("deviation"), max_deviation) & within(F.col("delay"), max_delay))


def legs_at_stop(legs: DataFrame, stop: str, since: date, k: int = 10) -> DataFrame:
    """Sample of legs into a stop without their ids, the newest first."""
    return (
        legs.where((F.col("stop_name") == stop) & since_time("time", since, strict=True))
        .orderBy(F.desc("time"), "datedServiceJourneyId", "previous_stop", "stop")
        .drop("previous_stop", "stop", "datedServiceJourneyId")
        .limit(k)
    )


def zero_planned_pct(legs: DataFrame) -> DataFrame:
    """Share of legs whose stops are planned at the same time, in one pass."""
    zero = F.count_if(F.col("planned_duration") == 0)
    return legs.agg(F.try_divide(F.lit(100.0) * zero, F.count(F.lit(1))).alias("percent"))


def deviation_summary(legs: DataFrame, where: Column | None = None) -> DataFrame:
    rows = legs if where is None else legs.where(where)
    return rows.agg(
        F.avg("deviation").alias("mean_deviation"),
        F.median("deviation").alias("median_deviation"),
        quantile_disc("deviation", 0.95).alias("pct_95"),
    )


def worst_legs(
    legs: DataFrame, min_count: int = 10, since: date | None = None, k: int = 10
) -> DataFrame:
    """Stop pairs with the highest median deviation among those with enough legs."""
    if since is not None:
        legs = legs.where(since_time("time", since))
    return (
        legs.groupBy(*NAMED_PAIR)
        .agg(
            F.median("deviation").alias("deviation"),
            quantile_disc("deviation", 0.95).alias("pct_95"),
            F.count(F.lit(1)).alias("travels"),
        )
        .where(F.col("travels") > min_count)
        .orderBy(F.desc_nulls_last("deviation"), *NAMED_PAIR)
        .limit(k)
    )


def worst_legs_via(
    legs: DataFrame, arrivals: DataFrame, stop: str, min_count: int = 5000, k: int = 20
) -> DataFrame:
    """The same among journeys that visit ``stop``."""
    journeys = arrivals.where(F.col("stopPointName") == stop).select("datedServiceJourneyId").distinct()
    return worst_legs(legs.join(journeys, "datedServiceJourneyId", "left_semi"), min_count, None, k)


def leg_profile(
    legs: DataFrame, stop: str, since: date | None = None, h0: int = 6, h1: int = 18, tz: str = "UTC"
) -> DataFrame:
    """Mean duration with its band per hour for the legs that begin or end at ``stop``."""
    rows = legs.where((F.col("stop_name") == stop) | (F.col("previous_stop_name") == stop))
    if since is not None:
        rows = rows.where(since_time("time", since))
    return (
        rows.select(
            F.concat("previous_stop_name", F.lit(" - "), "stop_name").alias("from_to"),
            local_hour(F.col("time"), tz).alias("hour"),
            F.col("actual_duration").alias("seconds"),
        )
        .where(F.col("hour").between(h0, h1))
        .groupBy("from_to", "hour")
        .agg(*mean_band(F.col("seconds")))
    )


def pair_count(legs: DataFrame, since: date | None = None, min_count: int | None = None) -> DataFrame:
    """Exact number of stop pairs, optionally of those with more than ``min_count`` legs."""
    if since is not None:
        legs = legs.where(since_time("time", since))
    pairs = legs.groupBy("previous_stop", "stop").agg(F.count(F.lit(1)).alias("n"))
    if min_count is not None:
        pairs = pairs.where(F.col("n") > min_count)
    return pairs.agg(F.count(F.lit(1)).alias("combinations"))


def missing_geometry_count(arrivals: DataFrame, quays: DataFrame) -> DataFrame:
    seen = arrivals.select("stopPointRef").distinct()
    missing = seen.join(quays, seen["stopPointRef"] == quays["id"], "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("missing"))


def missing_geometry(arrivals: DataFrame, quays: DataFrame, k: int = 10) -> DataFrame:
    """Stops without a quay, the most recently seen first."""
    seen = arrivals.groupBy("stopPointRef", "stopPointName").agg(
        F.max("operatingDate").alias("last_seen")
    )
    return (
        seen.join(quays, seen["stopPointRef"] == quays["id"], "left_anti")
        .orderBy(F.desc("last_seen"), "stopPointRef", "stopPointName")
        .limit(k)
    )


def missing_geometry_pct(
    arrivals: DataFrame, quays: DataFrame, since: date | None = None
) -> DataFrame:
    """Share of visits whose stop has no quay. Visits are first counted per stop reference,
    so the join sees one row per reference and a busy stop is no hot key."""
    if since is not None:
        arrivals = arrivals.where(F.col("operatingDate") >= F.lit(since))
    per_stop = arrivals.groupBy("stopPointRef").agg(F.count(F.lit(1)).alias("n"))
    known = quays.groupBy(F.col("id").alias("stopPointRef")).agg(F.count(F.lit(1)).alias("copies"))
    joined = per_stop.join(known, "stopPointRef", "left")
    rows = F.col("n") * F.coalesce("copies", F.lit(1))
    missing = F.when(F.col("copies").isNull(), F.col("n")).otherwise(F.lit(0))
    return joined.agg(F.try_divide(F.lit(100.0) * F.sum(missing), F.sum(rows)).alias("pct_missing"))


def pair_distances(legs: DataFrame, quays: DataFrame) -> DataFrame:
    """Great-circle distance of each distinct stop pair with known positions."""
    pairs = legs.select("previous_stop", "stop").distinct()

    def place(prefix: str, key: str) -> DataFrame:
        return bounded_broadcast(quays.select(
            F.col("id").alias(key),
            F.col("location_longitude").alias(f"{prefix}_lon"),
            F.col("location_latitude").alias(f"{prefix}_lat"),
        ))

    joined = pairs.join(place("prev", "previous_stop"), "previous_stop").join(
        place("now", "stop"), "stop"
    )
    c = F.col
    return joined.select(
        "previous_stop", "prev_lon", "prev_lat", "stop", "now_lon", "now_lat",
        haversine_km(c("prev_lat"), c("prev_lon"), c("now_lat"), c("now_lon")).alias("air_distance_km"),
    )


def distance_summary(distances: DataFrame) -> DataFrame:
    return distances.agg(*describe_columns("air_distance_km"))


def zero_distance_pairs(distances: DataFrame) -> DataFrame:
    """Different stops at the same place."""
    return distances.where((F.col("air_distance_km") == 0) & (F.col("previous_stop") != F.col("stop")))


def self_leg_count(legs: DataFrame) -> DataFrame:
    return legs.where(F.col("previous_stop") == F.col("stop")).agg(F.count(F.lit(1)).alias("count"))


def legs_with_distance(
    legs: DataFrame, distances: DataFrame, since: date | None = None
) -> DataFrame:
    """Legs between different stops with their distance and the speed it implies.

    The distances are one row per pair. Their number is checked, so that the legs are not
    shuffled by pair (a busy pair would be a hot key) if they can be broadcast; otherwise the
    skew join splits busy pairs.
    """
    moved = legs.where(F.col("previous_stop") != F.col("stop"))
    if since is not None:
        moved = moved.where(since_time("time", since))
    return with_speed(moved.join(bounded_broadcast(distances), ["previous_stop", "stop"]))


def fastest_legs(legs_distance: DataFrame, k: int = 30) -> DataFrame:
    return (
        legs_distance.where(F.col("actual_duration") > 0)
        .select(
            *NAMED_PAIR, "time", F.col("actual_duration").alias("duration_seconds"),
            F.col("speed_kmh_upper_bound").alias("speed_km_h_upper_bound"), "air_distance_km",
            "datedServiceJourneyId",
        )
        .orderBy(F.desc_nulls_last("speed_km_h_upper_bound"), "time", "datedServiceJourneyId",
                 *NAMED_PAIR)
        .limit(k)
        .drop("datedServiceJourneyId")
    )


def speeding_pct(legs_distance: DataFrame, limit_kmh: float = 250) -> DataFrame:
    return legs_distance.agg(
        percent(F.col("speed_kmh_upper_bound") > limit_kmh).alias("bullet_bus_pct")
    )


def _plausible(legs_distance: DataFrame, tz: str) -> DataFrame:
    when = F.col("time")
    return legs_distance.where(
        (F.col("actual_duration") > 0) & (F.col("speed_kmh_upper_bound") < 250)
    ).select(
        *NAMED_PAIR,
        local_year(when, tz).alias("year"),
        local_month(when, tz).alias("month"),
        local_hour(when, tz).alias("hour"),
        "air_distance_km", "planned_duration", "actual_duration", "delay", "deviation",
        "now_lon", "now_lat", "prev_lon", "prev_lat",
    )


def leg_stats_struct(legs_distance: DataFrame, min_count: int = STRUCT_COUNT, tz: str = "UTC") -> DataFrame:
    """Distribution of duration, delay and deviation per stop pair, year, month and hour."""
    lowest = lambda c: F.min(c)  # noqa: E731  any position of the pair; the lowest is stable
    return (
        _plausible(legs_distance, tz)
        .groupBy(
            F.col("stop_name").alias("stop"), F.col("previous_stop_name").alias("previous_stop"),
            "year", "month", "hour",
        )
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.round(F.avg("air_distance_km"), 2).alias("air_distance_km"),
            F.median("planned_duration").alias("planned_duration"),
            lowest("now_lon").alias("stop_lon"),
            lowest("now_lat").alias("stop_lat"),
            lowest("prev_lon").alias("prev_lon"),
            lowest("prev_lat").alias("prev_lat"),
            map_point(F.min("prev_lon"), F.min("now_lon"), 0.01).alias("map_lon"),
            map_point(F.min("prev_lat"), F.min("now_lat"), 0.01).alias("map_lat"),
            *[stats_struct(c) for c in ("actual_duration", "delay", "deviation")],
        )
        .where(F.col("count") >= min_count)
    )


def stop_stats(legs_distance: DataFrame, min_count: int = 28, tz: str = "UTC") -> DataFrame:
    """Distribution of delay and deviation per stop, year, month and hour."""
    return (
        _plausible(legs_distance, tz)
        .groupBy(F.col("stop_name").alias("stop"), "year", "month", "hour")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.min("now_lon").alias("map_lon"),
            F.min("now_lat").alias("map_lat"),
            *[stats_struct(c) for c in ("delay", "deviation")],
        )
        .where(F.col("count") >= min_count)
    )


def rush_factor(
    legs_distance: DataFrame,
    min_count: int = 200,
    min_month: float = 60,
    tz: str = "UTC",
) -> DataFrame:
    """Upper quartile of an hour over the median of the month, largest first, with the distribution of the deviation
    in that hour (of hours with STRUCT_COUNT legs at least, as in :func:`leg_stats_struct`). One aggregation an hour,
    one a month."""
    rows = _plausible(legs_distance, tz).where(" AND ".join(f"{c} IS NOT NULL" for c in NAMED_PAIR))
    by_hour = (
        rows.groupBy(*NAMED_PAIR, "year", "month", "hour")
        .agg(quantile_disc("actual_duration", 0.75).alias("actual_duration_hour"), stats_struct("deviation"),
             F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= max(min_count, STRUCT_COUNT))
        .drop("n")
    )
    by_month = (
        rows.groupBy(*NAMED_PAIR, "year", "month")
        .agg(F.median("actual_duration").alias("actual_duration_month"))
        .where(F.col("actual_duration_month") >= min_month)
    )
    return (
        by_hour.join(by_month, [*NAMED_PAIR, "year", "month"])
        .select(
            F.round(F.try_divide("actual_duration_hour", "actual_duration_month"), 2)
            .alias("rush_factor"),
            "actual_duration_hour", "actual_duration_month", *NAMED_PAIR, "year", "month", "hour",
            "deviation_stats",
        )
        .orderBy(F.desc("rush_factor"), *NAMED_PAIR, "year", "month", "hour")
    )
