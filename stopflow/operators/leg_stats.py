"""Monthly and hourly statistics of legs, and the small lookup tables next to them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import local_hour, local_weekday, month_start, round_to
from ..schemas import LEG_STATS
from .histograms import disc, mean, middle, rolled_up, rows_behind, value_counts, with_shares

PAIR = ["dataSource", "from_stop", "to_stop"]
MEASURES = ["actual_duration", "delay", "deviation"]
PLACES = ["air_distance_meters", "from_lat", "from_lon", "to_lat", "to_lon"]
FIGURES = ["quartile", "duration", "delay", "deviation", "mean", "count"]


def weekdays(df: DataFrame, when, tz: str | None = None) -> DataFrame:
    """Monday to Friday. ``when`` is a timestamp column if ``tz`` is given, else a date."""
    if tz is None:
        return df.where(~F.dayofweek(when).isin(1, 7))
    return df.where(~local_weekday(when, tz).isin(0, 6))


def leg_stats(
    legs: DataFrame,
    month: date | None = None,
    min_hourly_count: int = 20,
    min_distance: int = 50,
    tz: str = "UTC",
) -> DataFrame:
    """Hourly figures per stop pair next to those of the whole month, weekdays only.

    Kept are hours with more than ``min_hourly_count`` legs and pairs more than
    ``min_distance`` metres apart. Hour and weekday are taken in ``tz``. The legs are read and counted once; both
    grains come from the counts, which are partitioned by pair and month from then on.
    """
    start = F.col("start_time")
    used = weekdays(legs, start, tz).select(
        *PAIR, month_start(F.col("operatingDate")).alias("month"),
        local_hour(start, tz).alias("hour"), *MEASURES, *PLACES,
    )
    if month is not None:
        used = used.where(F.col("month") == F.lit(month.replace(day=1)))
    least = [F.min(c).alias(c) for c in PLACES]
    keys = [*PAIR, "month", "hour"]
    counts = value_counts(used, keys, MEASURES, least).repartition(*PAIR, "month")
    shares = with_shares(rolled_up(counts, keys, "hour", least), [*keys, "coarse"])
    short = lambda x, name: round_to(x, "smallint").alias(name)
    figures = shares.groupBy(*keys, "coarse").agg(
        disc("actual_duration", 0.75).cast("int").alias("quartile"),
        *[short(middle(m), name) for m, name in zip(MEASURES, ("duration", "delay", "deviation"))],
        short(mean("actual_duration"), "mean"),
        rows_behind("actual_duration").alias("count"),
        *least,
    )
    whole = Window.partitionBy(*PAIR, "month")
    of_month = F.max(F.when(F.col("coarse"), F.struct(*FIGURES, *PLACES))).over(whole)
    names = {"mean": "mean_{}_duration"} | {c: f"{{}}_{c}" for c in FIGURES if c != "mean"}
    return (
        figures.withColumn("m", of_month)
        .where(~F.col("coarse") & (F.col("count") > min_hourly_count) & (F.col("m.air_distance_meters") > min_distance))
        .select(
            *PAIR, "month", "hour",
            *[F.col(c).alias(n.format("hourly")) for c, n in names.items()],
            *[F.col(f"m.{c}").alias(n.format("monthly")) for c, n in names.items()],
            *[F.col(f"m.{c}").alias(c) for c in PLACES],
        )
        .select(*LEG_STATS.fieldNames())
    )


def datasources(arrivals: DataFrame) -> DataFrame:
    """Latest name of each source (on the same day: the last in alphabetical order)."""
    latest = F.struct("operatingDate", "dataSourceName")
    return arrivals.groupBy("dataSource").agg(
        F.max_by("dataSourceName", F.when(F.col("dataSourceName").isNotNull(), latest))
        .alias("dataSourceName")
    )


def datasource_lines(legs: DataFrame) -> DataFrame:
    return legs.select("dataSource", "lineRef").distinct()


def stop_lines(legs: DataFrame) -> DataFrame:
    return legs.select("lineRef", "dataSource", "from_stop", "to_stop").distinct()


def arrivals_stats(arrivals: DataFrame) -> DataFrame:
    return arrivals.agg(
        F.min("operatingDate").alias("min_date"),
        F.max("operatingDate").alias("max_date"),
        F.count(F.lit(1)).alias("total_arrivals"),
    )


def sources_by_day(arrivals: DataFrame) -> DataFrame:
    """Rows and last name in alphabetical order of each source on each day."""
    return arrivals.groupBy("operatingDate", "dataSource").agg(
        F.max("dataSourceName").alias("dataSourceName"), F.count(F.lit(1)).alias("arrivals")
    )


def lines_by_day(legs: DataFrame) -> DataFrame:
    return legs.select("operatingDate", "lineRef", "dataSource", "from_stop", "to_stop").distinct()


def arrivals_stats_by_day(source_day: DataFrame) -> DataFrame:
    """:func:`arrivals_stats` from the counts by day."""
    return source_day.agg(
        F.min("operatingDate").alias("min_date"),
        F.max("operatingDate").alias("max_date"),
        F.coalesce(F.sum("arrivals"), F.lit(0)).alias("total_arrivals"),
    )


def served_datasources(datasources: DataFrame, leg_stats: DataFrame) -> DataFrame:
    """Sources that occur in the statistics."""
    return datasources.join(leg_stats, "dataSource", "left_semi").distinct()
