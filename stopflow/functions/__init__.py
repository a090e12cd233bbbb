"""Column expressions. All of them are built-in Spark expressions; none is a Python UDF."""

from .geo import geodesic_meters, haversine_km, map_point, speed_kmh, with_geodesic
from .numbers import percent, round_to, within
from .stats import describe_columns, mean_band, quantile_disc, quantiles_disc, stats_struct
from .text import label_number, last_segment, line_number
from .times import (
    local_hour,
    local_month,
    local_weekday,
    local_year,
    micros_to_seconds,
    month_start,
    seconds_between,
    visit_delay,
    visit_start,
)

__all__ = [
    "describe_columns", "geodesic_meters", "haversine_km", "label_number",
    "last_segment", "line_number", "local_hour", "local_month", "local_weekday", "local_year",
    "map_point", "mean_band", "micros_to_seconds", "month_start", "percent", "quantile_disc", "quantiles_disc",
    "round_to", "seconds_between", "speed_kmh", "stats_struct", "visit_delay", "visit_start",
    "with_geodesic", "within",
]
