"""Questions answered from the small tables that the batch publishes."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import label_number, last_segment, line_number, map_point, round_to
from .skew import first_rows

PAIR = ["from_stop", "to_stop", "dataSource"]
MEASURES = [  # fixed values: the measures shown for a leg, in order
    "hourly_quartile", "hourly_duration", "monthly_duration", "monthly_delay", "hourly_delay",
    "monthly_deviation", "hourly_deviation", "mean_hourly_duration", "mean_monthly_duration",
    "monthly_count", "hourly_count",
]


def _month(month: date) -> Column:
    return F.lit(month.replace(day=1))


def datasources_by_name(datasources: DataFrame, exclude: Sequence[str] = ("SOF",)) -> DataFrame:
    return (
        datasources.where(~F.col("dataSource").isin(*exclude))
        .select("dataSourceName", "dataSource")
        .orderBy("dataSourceName", "dataSource")
    )


def lines_for_datasource(datasource_line: DataFrame, source: str) -> DataFrame:
    """Lines of a source with their label, ordered by the number that ends the reference.
    References without one come last instead of failing."""
    return (
        datasource_line.where(F.col("dataSource") == source)
        .select(last_segment(F.col("lineRef")).alias("label"), "lineRef")
        .orderBy(line_number(F.col("lineRef")).asc_nulls_last(), "lineRef")
    )


def natural_order(lines: DataFrame, label: str = "label") -> DataFrame:
    """Order labels by their trailing number, then by text; labels without one are last."""
    return lines.orderBy(label_number(F.col(label)).asc_nulls_last(), label)


def months(leg_stats: DataFrame, as_of: date | None = None, min_age_days: int = 7) -> DataFrame:
    """Months with statistics; given ``as_of``, without those that began too recently."""
    found = leg_stats.select(F.col("month").cast("date").alias("month")).distinct()
    if as_of is not None:
        found = found.where(F.col("month") <= F.date_sub(F.lit(as_of), min_age_days))
    return found.orderBy("month")


def _leg_card(stats: DataFrame) -> DataFrame:
    """What is shown for one leg in one hour, with its rush intensity."""
    return stats.select(
        F.concat("from_stop", F.lit(" to "), "to_stop").alias("name"),
        "from_stop", "to_stop", "air_distance_meters", "from_lat", "from_lon", "to_lat", "to_lon",
        map_point(F.col("from_lat"), F.col("to_lat")).alias("lat"),
        map_point(F.col("from_lon"), F.col("to_lon")).alias("lon"),
        F.round(F.try_divide("hourly_quartile", "monthly_duration"), 1).alias("rush_intensity"),
        *MEASURES,
        F.col("dataSource").alias("data_source"),
    )


def _one_per_pair(stats: DataFrame) -> DataFrame:
    return first_rows(stats, PAIR, [F.desc("hourly_count"), F.desc("monthly_count")])


CARD_ORDER = ["from_stop", "to_stop", "data_source"]


def _on_line(stats: DataFrame, stop_line: DataFrame, line: str | None) -> DataFrame:
    """Keep legs that occur on a line (any line if ``None``). The lines add no columns."""
    if line is not None:
        stop_line = stop_line.where(F.col("lineRef") == line)
    return stats.join(stop_line, PAIR, "left_semi")


def leg_view(
    leg_stats: DataFrame,
    stop_line: DataFrame,
    month: date,
    hour: int,
    source: str,
    line: str | None = None,
) -> DataFrame:
    """Legs of a source in one hour of a month, the least busy first."""
    chosen = leg_stats.where(
        (F.col("month") == _month(month)) & (F.col("hour") == hour) & (F.col("dataSource") == source)
    )
    return _leg_card(_one_per_pair(_on_line(chosen, stop_line, line))).orderBy(
        "rush_intensity", *CARD_ORDER
    )


def hot_spots(leg_stats: DataFrame, month: date, hour: int, limit: int = 1000) -> DataFrame:
    """The ``limit`` legs with the highest rush intensity, the highest last."""
    chosen = leg_stats.where((F.col("month") == _month(month)) & (F.col("hour") == hour))
    cards = _leg_card(_one_per_pair(chosen))
    top = cards.orderBy(F.desc_nulls_last("rush_intensity"), *CARD_ORDER).limit(limit)
    return top.orderBy("rush_intensity", *CARD_ORDER)


def comparisons(
    leg_stats: DataFrame,
    stop_line: DataFrame,
    prev_month: date,
    cur_month: date,
    hour: int,
    limit: int = 2000,
    source: str | None = None,
    line: str | None = None,
) -> DataFrame:
    """Change of the mean duration between two months at one hour, smallest change first.

    ``limit`` keeps the largest changes and applies only when no source is chosen. A month
    compared with itself has no rows.
    """
    at_hour = leg_stats.where(F.col("hour") == hour)
    if source is not None:
        at_hour = at_hour.where(F.col("dataSource") == source)
    now = _on_line(at_hour.where(F.col("month") == _month(cur_month)), stop_line, line)
    prev = _one_per_pair(at_hour.where(F.col("month") == _month(prev_month))).alias("p")
    cur = _one_per_pair(now).alias("c")
    if prev_month.replace(day=1) == cur_month.replace(day=1):
        cur = cur.where(F.lit(False))
    same_pair = [F.col(f"p.{c}") == F.col(f"c.{c}") for c in PAIR]

    mean_now = F.col("c.mean_hourly_duration").cast("int")
    mean_then = F.col("p.mean_hourly_duration").cast("int")
    share = lambda base: round_to(F.try_divide(F.lit(100) * (mean_now - mean_then), base))
    both = [
        F.col(f"{side}.{m}").alias(f"{name}_{m}")
        for m in ("hourly_quartile", "hourly_duration", "hourly_delay", "hourly_deviation",
                  "mean_hourly_duration")
        for side, name in (("c", "cur"), ("p", "prev"))
    ]
    out = prev.join(cur, same_pair).select(
        F.concat("c.from_stop", F.lit(" to "), "c.to_stop").alias("name"),
        (mean_now - mean_then).alias("net_change_seconds"),
        share(mean_now + mean_then).alias("net_change_proportion"),
        share(mean_then).alias("net_change_pct"),
        "c.from_stop", "c.to_stop", "c.air_distance_meters",
        "c.from_lat", "c.from_lon", "c.to_lat", "c.to_lon",
        map_point(F.col("c.from_lat"), F.col("c.to_lat")).alias("lat"),
        map_point(F.col("c.from_lon"), F.col("c.to_lon")).alias("lon"),
        *both,
        F.col("c.monthly_count").alias("cur_month_count"),
        F.col("p.monthly_count").alias("prev_monthly_count"),
        F.col("c.hourly_count").alias("cur_hourly_count"),
        F.col("p.hourly_count").alias("prev_hourly_count"),
        F.col("c.dataSource").alias("data_source"),
    ).withColumn("abs_net_change_proportion", F.abs("net_change_proportion"))
    if source is None:
        out = out.orderBy(F.desc_nulls_last("abs_net_change_proportion"), *CARD_ORDER).limit(limit)
    return out.orderBy("abs_net_change_proportion", *CARD_ORDER)


def total_transports(leg_stats: DataFrame) -> DataFrame:
    return leg_stats.agg(F.sum("hourly_count").alias("transports"))


def leg_stat_count(leg_stats: DataFrame) -> DataFrame:
    return leg_stats.agg(F.count(F.lit(1)).alias("leg_stat_count"))


def total_arrivals(arrivals_stats: DataFrame) -> DataFrame:
    return arrivals_stats.select("total_arrivals")


def min_max_date(arrivals_stats: DataFrame) -> DataFrame:
    return arrivals_stats.select("min_date", "max_date")


def totals(leg_stats: DataFrame, arrivals_stats: DataFrame) -> DataFrame:
    """All totals in one row."""
    return arrivals_stats.select(
        leg_stats.agg(F.sum("hourly_count").alias("n")).scalar().alias("leg_count"),
        F.col("total_arrivals").alias("arrivals_count"),
        F.col("min_date").alias("start"),
        F.col("max_date").alias("end"),
        leg_stats.agg(F.count(F.lit(1)).alias("n")).scalar().alias("aggregated_count"),
    )


def freshness(arrivals_stats: DataFrame, as_of: date, max_age_days: int = 3) -> DataFrame:
    return arrivals_stats.select(
        F.lit("up").alias("status"),
        F.col("max_date").alias("data_date"),
        (F.col("max_date") < F.date_sub(F.lit(as_of), max_age_days)).alias("stale"),
    )
