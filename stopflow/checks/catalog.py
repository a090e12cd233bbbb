"""Every query: how Spark runs it, its SQL twin and the column contract of both."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import label_number, line_number
from ..operators import delays, directions, journeys, leg_stats as ls, leg_study, legs as leg_ops, serving
from ..operators.ranking import file_ranges, may_hold, stored_positions, with_position
from ..operators.skew import hot_groups
from ..operators.visits import clean_arrivals
from ..plans import etl
from ..schemas import JOURNEY, LEG_STATS
from ..sources import ingest, tables
from ..sources.shared import shared_folder
from ..sources.testdata import Projected
from . import contract
from .base_sql import with_base

JAN, FEB = date(2024, 1, 1), date(2024, 2, 1)
LINE, STOP = "AAA:Line:2_1", "Stop 1"


@dataclass(frozen=True)
class Query:
    base: str
    contract: str
    run: Callable[[Projected], DataFrame]
    body: str

    def dataframe(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return contract.apply(self.run(projected(spark, sf_dir)), self.contract)

    def sql(self) -> str:
        return with_base(self.base, contract.sql(self.body, self.contract))


_open: dict[tuple[str, str], Projected] = {}


def projected(spark: SparkSession, sf_dir: str) -> Projected:
    """One set of lazy tables per application and folder, so queries share the cleaned
    visits that are persisted for them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _open:
        _open[key] = Projected(spark, sf_dir)
    return _open[key]


def scratch(spark: SparkSession) -> str:
    """A new folder for tables a query writes."""
    return shared_folder(spark, "tables")


QUERIES: dict[str, Query] = {}


def add(name: str, base: str, columns: str, run, body: str) -> None:
    QUERIES[name] = Query(base, columns, run, body)


# ---- from visits to statistics -------------------------------------------------------

add("stop_dimension", "stopdata", "quay_id:s stop_id:s lat:c lon:c name:s",
    lambda p: p.stopdata, "SELECT * FROM stopdata")

add("arrivals_projection", "arrivals",
    "lineRef:s directionRef:s operatingDate:d serviceJourneyId:s stopPointRef:s sequenceNr:i "
    "extraCall:b stopCancellation:b journeyCancellation:b estimated:b aimedArrivalTime:t? "
    "arrivalTime:t? aimedDepartureTime:t? departureTime:t? recordedAtTime:t originName:s? "
    "destinationName:s? operatorRef:s extraJourney:b dataSource:s dataSourceName:s vehicleMode:s? stopPointName:s datedServiceJourneyId:s",
    lambda p: p.arrivals, "SELECT * FROM arrivals")

add("clean_arrivals", "clean",
    "lineRef:s directionRef:s operatingDate:d serviceJourneyId:s stop:s lat:c lon:c sequenceNr:i "
    "originName:s? destinationName:s? aimedArrivalTime:t? arrivalTime:t? aimedDepartureTime:t? "
    "departureTime:t? dataSource:s dataSourceName:s quay_id:s operatorRef:s extraJourney:b",
    lambda p: p.clean, "SELECT * FROM clean")

_NAMES = "operatingDate:d dataSource:s lineRef:s directionRef:s destination:s origin:s"
add("route_names", "routes", _NAMES, lambda p: p.route_names, "SELECT * FROM route_name")
add("canonical_direction", "routes", _NAMES + " direction:s",
    lambda p: p.canonical, "SELECT * FROM canonical")

add("legs", "legs",
    "operatingDate:d lineRef:s dataSource:s directionRef:s direction:s serviceJourneyId:s "
    "sequenceNr:i start_time:t actual_duration:i planned_duration:i delay:i deviation:i to_stop:s "
    "from_stop:s to_lat:c to_lon:c from_lat:c from_lon:c air_distance_meters:i",
    lambda p: p.legs, "SELECT * FROM legs")

_LEG_STATS = (
    "dataSource:s from_stop:s to_stop:s month:d hour:i hourly_quartile:i hourly_duration:i "
    "hourly_delay:i hourly_deviation:i mean_hourly_duration:i hourly_count:i monthly_duration:i "
    "monthly_quartile:i monthly_delay:i monthly_deviation:i mean_monthly_duration:i "
    "monthly_count:i air_distance_meters:i from_lat:c from_lon:c to_lat:c to_lon:c"
)
add("leg_stats", "stats", _LEG_STATS, lambda p: p.leg_stats, "SELECT * FROM leg_stats")
add("leg_stats_month", "stats", _LEG_STATS, lambda p: ls.leg_stats(p.legs, FEB),
    "SELECT * FROM leg_stats WHERE month = DATE '2024-02-01'")

add("datasources", "arrivals", "dataSource:s dataSourceName:s",
    lambda p: ls.datasources(p.arrivals),
    "SELECT dataSource, arg_max(dataSourceName, operatingDate) AS dataSourceName "
    "FROM arrivals GROUP BY 1")
add("datasource_lines", "legs", "dataSource:s lineRef:s",
    lambda p: ls.datasource_lines(p.legs), "SELECT dataSource, lineRef FROM legs GROUP BY 1, 2")
add("stop_lines", "stats", "lineRef:s dataSource:s from_stop:s to_stop:s",
    lambda p: p.stop_line, "SELECT * FROM stop_line")
add("arrivals_stats", "arrivals", "min_date:d max_date:d total_arrivals:i",
    lambda p: ls.arrivals_stats(p.arrivals),
    "SELECT min(operatingDate) AS min_date, max(operatingDate) AS max_date, "
    "count(*) AS total_arrivals FROM arrivals")
add("served_datasources", "stats", "dataSource:s dataSourceName:s",
    lambda p: ls.served_datasources(ls.datasources(p.arrivals), p.leg_stats),
    "SELECT DISTINCT dataSource, dataSourceName FROM arrivals "
    "WHERE dataSource IN (SELECT dataSource FROM leg_stats)")

# ---- serving -------------------------------------------------------------------------

add("datasources_by_name", "arrivals", "dataSourceName:s dataSource:s",
    lambda p: serving.datasources_by_name(ls.datasources(p.arrivals)),
    "SELECT DISTINCT dataSourceName, dataSource FROM arrivals WHERE dataSource <> 'SOF'")
_LINES = (
    "SELECT split_part(lineRef, ':', 3) AS label, lineRef, "
    "try_cast(regexp_extract(lineRef, '[0-9]+$') AS BIGINT) AS number "
    "FROM (SELECT DISTINCT lineRef FROM legs WHERE dataSource = 'AAA')"
)


def _in_order(sql: str, order: str) -> str:
    """The rows of a query and the place of each in an order."""
    return f"SELECT *, row_number() OVER (ORDER BY {order}) AS position FROM ({sql})"


# The order is part of these results: ``position`` is the place at which a row was delivered.
add("lines_for_datasource", "legs", "label:s lineRef:s number:i? position:i",
    lambda p: with_position(serving.lines_for_datasource(ls.datasource_lines(p.legs), "AAA")).withColumn(
        "number", line_number(F.col("lineRef"))), _in_order(_LINES, "number NULLS LAST, lineRef"))
add("lines_natural_order", "legs", "label:s lineRef:s number:i? position:i",
    lambda p: with_position(serving.natural_order(
        serving.lines_for_datasource(ls.datasource_lines(p.legs), "AAA"))).withColumn(
        "number", label_number(F.col("label"))), _in_order(_LINES, "number NULLS LAST, label"))
add("months", "stats", "month:d", lambda p: serving.months(p.leg_stats),
    "SELECT DISTINCT month FROM leg_stats")
add("months_old_enough", "stats", "month:d",
    lambda p: serving.months(p.leg_stats, date(2024, 2, 5)),
    "SELECT month FROM leg_stats WHERE month + 7 <= DATE '2024-02-05' GROUP BY 1")

_CARD = (
    "name:s from_stop:s to_stop:s air_distance_meters:i from_lat:c from_lon:c to_lat:c to_lon:c "
    "lat:c lon:c rush_intensity:f hourly_quartile:i hourly_duration:i monthly_duration:i "
    "monthly_delay:i hourly_delay:i monthly_deviation:i hourly_deviation:i "
    "mean_hourly_duration:i mean_monthly_duration:i monthly_count:i hourly_count:i data_source:s"
)
_CARD_SQL = (
    "SELECT *, from_stop || ' to ' || to_stop AS name, 0.985 * from_lat + 0.015 * to_lat AS lat, "
    "0.985 * from_lon + 0.015 * to_lon AS lon, dataSource AS data_source, "
    "round(CAST(hourly_quartile AS DOUBLE) / monthly_duration, 1) AS rush_intensity FROM leg_stats "
)
_PLACED = "position:i "
_RUSH = "rush_intensity NULLS FIRST, from_stop, to_stop, data_source"
add("leg_view", "stats", _PLACED + _CARD,
    lambda p: with_position(serving.leg_view(p.leg_stats, p.stop_line, FEB, 7, "AAA")),
    _in_order(_CARD_SQL + "WHERE month = DATE '2024-02-01' AND hour = 7 AND dataSource = 'AAA'", _RUSH))
add("leg_view_line", "stats", _CARD,
    lambda p: serving.leg_view(p.leg_stats, p.stop_line, JAN, 8, "AAA", LINE),
    _CARD_SQL + "WHERE month = DATE '2024-01-01' AND hour = 8 AND (dataSource, from_stop, to_stop) "
    f"IN (SELECT (dataSource, from_stop, to_stop) FROM stop_line WHERE lineRef = '{LINE}') "
    "AND dataSource = 'AAA'")
add("hot_spots", "stats", _PLACED + _CARD,
    lambda p: with_position(serving.hot_spots(p.leg_stats, FEB, 7, 10)),
    _in_order(_CARD_SQL + "WHERE month = DATE '2024-02-01' AND hour = 7 "
              "ORDER BY rush_intensity DESC, from_stop, to_stop, dataSource LIMIT 10", _RUSH))

_CHANGE = (
    "name:s net_change_seconds:i net_change_proportion:i net_change_pct:i from_stop:s to_stop:s "
    "air_distance_meters:i from_lat:c from_lon:c to_lat:c to_lon:c lat:c lon:c cur_hourly_quartile:i "
    "prev_hourly_quartile:i cur_hourly_duration:i prev_hourly_duration:i cur_hourly_delay:i "
    "prev_hourly_delay:i cur_hourly_deviation:i prev_hourly_deviation:i "
    "cur_mean_hourly_duration:i prev_mean_hourly_duration:i cur_month_count:i "
    "prev_monthly_count:i cur_hourly_count:i prev_hourly_count:i data_source:s "
    "abs_net_change_proportion:i"
)
_SIDE = ", ".join(
    f"{a}.{m} AS {n}_{m}"
    for m in ("hourly_quartile", "hourly_duration", "hourly_delay", "hourly_deviation",
              "mean_hourly_duration", "hourly_count")
    for a, n in (("c", "cur"), ("p", "prev"))
)
_CHANGE_SQL = (
    f"SELECT {_SIDE}, c.monthly_count AS cur_month_count, p.monthly_count AS prev_monthly_count, "
    "c.from_stop || ' to ' || c.to_stop AS name, c.from_stop, c.to_stop, c.dataSource AS data_source, "
    "c.air_distance_meters, c.from_lat, c.from_lon, c.to_lat, c.to_lon, 0.985 * c.from_lat + 0.015 * c.to_lat AS lat, "
    "0.985 * c.from_lon + 0.015 * c.to_lon AS lon, "
    "c.mean_hourly_duration - p.mean_hourly_duration AS net_change_seconds, "
    "CAST(100.0::DOUBLE * net_change_seconds / (c.mean_hourly_duration + p.mean_hourly_duration) AS INT) "
    "AS net_change_proportion, "
    "CAST(100.0::DOUBLE * net_change_seconds / p.mean_hourly_duration AS INT) AS net_change_pct, "
    "abs(net_change_proportion) AS abs_net_change_proportion "
    "FROM leg_stats AS p JOIN leg_stats AS c ON p.from_stop = c.from_stop AND p.to_stop = c.to_stop "
    "AND p.dataSource = c.dataSource AND p.hour = c.hour "
    "WHERE p.month = DATE '2024-01-01' AND c.month = DATE '2024-02-01' AND c.hour = 7 "
)
add("comparisons", "stats", _PLACED + _CHANGE,
    lambda p: with_position(serving.comparisons(p.leg_stats, p.stop_line, JAN, FEB, 7, limit=12)),
    _in_order(_CHANGE_SQL + "ORDER BY abs_net_change_proportion DESC, c.from_stop, c.to_stop, c.dataSource LIMIT 12",
              "abs_net_change_proportion NULLS FIRST, from_stop, to_stop, data_source"))
add("comparisons_line", "stats", _CHANGE,
    lambda p: serving.comparisons(
        p.leg_stats, p.stop_line, JAN, FEB, 7, limit=3, source="AAA", line=LINE),
    _CHANGE_SQL + "AND c.dataSource = 'AAA' AND EXISTS (SELECT 1 FROM stop_line AS s WHERE "
    f"s.lineRef = '{LINE}' AND s.from_stop = c.from_stop AND s.to_stop = c.to_stop "
    "AND s.dataSource = c.dataSource)")
add("comparison_same_month", "stats", _CHANGE,
    lambda p: serving.comparisons(p.leg_stats, p.stop_line, FEB, FEB, 7),
    _CHANGE_SQL + "AND p.month = c.month")

add("total_transports", "stats", "transports:i", lambda p: serving.total_transports(p.leg_stats),
    "SELECT sum(hourly_count) AS transports FROM leg_stats")
add("leg_stat_count", "stats", "leg_stat_count:i", lambda p: serving.leg_stat_count(p.leg_stats),
    "SELECT count(*) AS leg_stat_count FROM leg_stats")
add("total_arrivals", "arrivals", "total_arrivals:i",
    lambda p: serving.total_arrivals(ls.arrivals_stats(p.arrivals)),
    "SELECT count(*) AS total_arrivals FROM arrivals")
add("min_max_date", "arrivals", "min_date:d max_date:d",
    lambda p: serving.min_max_date(ls.arrivals_stats(p.arrivals)),
    "SELECT min(operatingDate) AS min_date, max(operatingDate) AS max_date FROM arrivals")
add("totals", "stats", "leg_count:i arrivals_count:i start:d end:d aggregated_count:i",
    lambda p: serving.totals(p.leg_stats, ls.arrivals_stats(p.arrivals)),
    'SELECT (SELECT sum(hourly_count) FROM leg_stats) AS leg_count, count(*) AS arrivals_count, '
    'min(operatingDate) AS "start", max(operatingDate) AS "end", '
    '(SELECT count(*) FROM leg_stats) AS aggregated_count FROM arrivals')
add("freshness", "arrivals", "status:s data_date:d stale:b",
    lambda p: serving.freshness(ls.arrivals_stats(p.arrivals), date(2024, 3, 3)),
    "SELECT 'up' AS status, max(operatingDate) AS data_date, "
    "max(operatingDate) + 3 < DATE '2024-03-03' AS stale FROM arrivals")

# ---- delays at stops -----------------------------------------------------------------

_LATE = "(epoch(arrivalTime) - epoch(aimedArrivalTime))"
add("source_volume", "arrivals", "dataSource:s dataSourceName:s volume:i",
    lambda p: delays.source_volume(p.arrivals, date(2024, 1, 15)),
    "SELECT dataSource, dataSourceName, count(*) AS volume FROM arrivals "
    "WHERE operatingDate >= DATE '2024-01-16' GROUP BY 1, 2")
add("vehicle_counts", "arrivals", "vehicle:s count:i", lambda p: delays.vehicle_counts(p.arrivals),
    "SELECT ifnull(vehicleMode, 'Unknown') AS vehicle, count(*) AS count FROM arrivals GROUP BY 1")
add("busiest_stops", "arrivals", "stopPointName:s count:i",
    lambda p: delays.busiest_stops(p.arrivals, 3),
    "SELECT stopPointName, count(*) AS count FROM arrivals GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
add("journey_trace", "arrivals",
    "stopPointName:s sequenceNr:i aimedArrivalTime:t? arrivalTime:t? aimedDepartureTime:t? departureTime:t?",
    lambda p: delays.journey_trace(p.arrivals, "2024-01-02:AAA:ServiceJourney:1"),
    "SELECT * FROM arrivals WHERE serviceJourneyId = 'AAA:ServiceJourney:1' AND operatingDate = '2024-01-02'")
_BY_TIME = (
    "SELECT year(arrivalTime) AS year, hour(arrivalTime) AS hour, month(arrivalTime) AS month, "
    f"avg({_LATE}) AS delay_seconds FROM arrivals WHERE stopPointName = '{STOP}' {{cut}} GROUP BY ALL"
)
add("delay_by_time", "arrivals", "year:s? hour:i? month:i? delay_seconds:f?",
    lambda p: delays.delay_by_time(p.arrivals, STOP), _BY_TIME.format(cut=""))
add("delay_by_time_cut", "arrivals", "year:s hour:i month:i delay_seconds:f",
    lambda p: delays.delay_by_time(p.arrivals, STOP, 1800),
    _BY_TIME.format(cut=f"AND {_LATE} BETWEEN -1799 AND 1799"))
add("delay_outliers", "arrivals", "lineRef:s arrivalTime:t aimedArrivalTime:t delay_seconds:f",
    lambda p: delays.delay_outliers(p.arrivals, STOP, 15),
    f"SELECT lineRef, arrivalTime, aimedArrivalTime, {_LATE} AS delay_seconds FROM arrivals "
    f"WHERE stopPointName = '{STOP}' ORDER BY abs(delay_seconds) DESC NULLS LAST, lineRef, arrivalTime, "
    "aimedArrivalTime LIMIT 15")
add("delay_by_line", "arrivals", "lineRef:s count:i mean_delay_seconds:f",
    lambda p: delays.delay_by_line(p.arrivals, STOP, 8),
    f"SELECT lineRef, count(*) AS count, sum({_LATE}) / count(*) AS mean_delay_seconds FROM arrivals "
    f"WHERE stopPointName = '{STOP}' AND abs({_LATE}) < 1800 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
_THREE = ["AAA:Line:2_1", "AAA:Line:2_3", "AAA:Line:Express"]
_SAMPLES = (
    f"SELECT lineRef, directionRef, {_LATE} AS delay_seconds FROM arrivals WHERE stopPointName = '{STOP}' "
    f"AND abs({_LATE}) < 1200 AND lineRef IN ('AAA:Line:2_1', 'AAA:Line:2_3', 'AAA:Line:Express')"
)
add("delay_samples", "arrivals", "lineRef:s directionRef:s delay_seconds:f",
    lambda p: delays.delay_samples(p.arrivals, STOP, _THREE), _SAMPLES)
add("delay_histogram", "arrivals", "lineRef:s directionRef:s bin:i bin_start:f count:i",
    lambda p: delays.delay_histogram(p.arrivals, STOP, _THREE, bins=30),
    "SELECT lineRef, directionRef, bin, lo + bin * ((hi - lo) / 30) AS bin_start, count(*) AS count FROM ("
    "SELECT *, least(floor((delay_seconds - lo) / ((hi - lo) / 30)), 29) AS bin FROM ("
    "SELECT *, min(delay_seconds) OVER () AS lo, max(delay_seconds) OVER () AS hi "
    f"FROM ({_SAMPLES}))) GROUP BY ALL")
_BAND = (
    "avg(v) AS mean, avg(v) - 1.96 * stddev_samp(v) / sqrt(count(v)) AS low, "
    "avg(v) + 1.96 * stddev_samp(v) / sqrt(count(v)) AS high, count(v) AS n"
)
add("delay_by_sequence_year", "arrivals",
    "directionRef:s year:s sequenceNr:i mean:f low:f? high:f? n:i",
    lambda p: delays.delay_by_sequence(p.arrivals, LINE),
    f"SELECT directionRef, year, sequenceNr, {_BAND} FROM (SELECT *, {_LATE} AS v, year(arrivalTime) AS year "
    f"FROM arrivals WHERE lineRef = '{LINE}') WHERE abs(v) < 1800 GROUP BY ALL")
add("delay_by_sequence_route", "arrivals",
    "directionRef:s route:s? sequenceNr:i mean:f low:f? high:f? n:i",
    lambda p: delays.delay_by_sequence(p.arrivals, LINE, "route", FEB),
    f"SELECT directionRef, route, sequenceNr, {_BAND} FROM (SELECT *, {_LATE} AS v, "
    "lineRef || ':' || originName || ' - ' || destinationName AS route FROM arrivals "
    f"WHERE lineRef = '{LINE}' AND month(operatingDate) = 2) WHERE abs(v) < 1800 GROUP BY ALL")
_ON_LINE = (
    f"FROM arrivals WHERE lineRef = '{LINE}' AND directionRef = 'Outbound' AND sequenceNr >= 2 "
    "AND sequenceNr <= 5 AND year(arrivalTime) = 2024 GROUP BY ALL"
)
add("stop_delay_by_sequence", "arrivals", "stopPointName:s sequenceNr:i delay_seconds:f",
    lambda p: delays.stop_delay_by_sequence(p.arrivals, LINE, "Outbound", 2, 5, 2024),
    f"SELECT stopPointName, sequenceNr, avg({_LATE}) AS delay_seconds {_ON_LINE}")
add("stop_delay_by_route", "arrivals", "route:s? stopPointName:s sequenceNr:i delay_seconds:f",
    lambda p: delays.stop_delay_by_sequence(p.arrivals, LINE, "Outbound", 2, 5, 2024, by_route=True),
    f"SELECT originName || ' - ' || destinationName AS route, stopPointName, sequenceNr, "
    f"avg({_LATE}) AS delay_seconds {_ON_LINE}")
add("missing_endpoints", "arrivals", "missing_origin:i missing_destination:i",
    lambda p: delays.missing_endpoints(p.arrivals),
    "SELECT CAST(100.0::DOUBLE * (count(*) - count(originName)) / count(*) AS INT) AS missing_origin, "
    "CAST(100.0::DOUBLE * (count(*) - count(destinationName)) / count(*) AS INT) AS missing_destination "
    "FROM arrivals")
add("count_by_source", "arrivals", "dataSource:s count:i",
    lambda p: delays.count_by(p.arrivals, "dataSource"),
    "SELECT dataSource, count(*) AS count FROM arrivals GROUP BY 1")
add("count_by_hour", "arrivals", "hour:i count:i",
    lambda p: delays.count_by(p.arrivals, delays.local_hour(F.col("recordedAtTime")), "hour"),
    "SELECT hour(recordedAtTime) AS hour, count(*) AS count FROM arrivals GROUP BY 1")
add("lead_gap_stats", "arrivals", "max_gap:f min_gap:f sum_over_rows:f",
    lambda p: delays.lead_gap_stats(p.arrivals, p.hot),
    "SELECT max(gap) AS max_gap, min(gap) AS min_gap, sum(gap) / count(*) AS sum_over_rows FROM ("
    "SELECT epoch(lead(arrivalTime) OVER (PARTITION BY datedServiceJourneyId ORDER BY sequenceNr)) "
    "- epoch(arrivalTime) AS gap FROM arrivals)")

# ---- legs by successor join ----------------------------------------------------------

add("legs_by_selfjoin", "study",
    "lineRef:s previous_stop_name:s previous_stop:s stop_name:s stop:s datedServiceJourneyId:s "
    "time:t planned_time:t planned_duration:f actual_duration:f deviation:f delay:f",
    lambda p: p.study, "SELECT * FROM study")
add("legs_at_stop", "study",
    "lineRef:s previous_stop_name:s stop_name:s time:t planned_time:t planned_duration:f "
    "actual_duration:f deviation:f delay:f",
    lambda p: leg_study.legs_at_stop(p.study, STOP, FEB, 10),
    f"SELECT * FROM study WHERE stop_name = '{STOP}' AND time > DATE '2024-02-01' "
    "ORDER BY time DESC, datedServiceJourneyId, previous_stop, stop LIMIT 10")
add("zero_planned_pct", "study", "percent:f", lambda p: leg_study.zero_planned_pct(p.study),
    "SELECT 100.0::DOUBLE * avg(CASE WHEN planned_duration = 0 THEN 1 ELSE 0 END) AS percent FROM study")
_DEVIATION = "mean_deviation:f median_deviation:f pct_95:f"
_DEVIATION_SQL = (
    "SELECT avg(deviation) AS mean_deviation, median(deviation) AS median_deviation, "
    "quantile_disc(deviation, 0.95) AS pct_95 FROM study WHERE "
)
add("deviation_summary_planned", "study", _DEVIATION,
    lambda p: leg_study.deviation_summary(p.study, F.col("planned_duration") != 0),
    _DEVIATION_SQL + "planned_duration <> 0")
add("deviation_summary_unplanned", "study", "mean_deviation:f? median_deviation:f? pct_95:f?",
    lambda p: leg_study.deviation_summary(p.study, F.col("planned_duration") == 0),
    _DEVIATION_SQL + "planned_duration = 0")
add("deviation_summary_other_sources", "study", _DEVIATION,
    lambda p: leg_study.deviation_summary(p.study, ~F.col("lineRef").like("AAA:%")),
    _DEVIATION_SQL + "NOT starts_with(lineRef, 'AAA:')")
_WORST = "deviation:f pct_95:f travels:i previous_stop_name:s stop_name:s"
_WORST_SQL = (
    "SELECT previous_stop_name, stop_name, median(deviation) AS deviation, count(*) AS travels, "
    "quantile_disc(deviation, 0.95) AS pct_95 FROM study {where} GROUP BY 1, 2 "
    "HAVING count(*) > {floor} ORDER BY deviation DESC, 1, 2 LIMIT {k}"
)
add("worst_legs", "study", _WORST, lambda p: leg_study.worst_legs(p.study, 10),
    _WORST_SQL.format(where="", floor=10, k=10))
add("worst_legs_since", "study", _WORST, lambda p: leg_study.worst_legs(p.study, 50, FEB),
    _WORST_SQL.format(where="WHERE time >= DATE '2024-02-01'", floor=50, k=10))
add("worst_legs_via", "study", _WORST,
    lambda p: leg_study.worst_legs_via(p.study, p.arrivals, STOP, 20),
    _WORST_SQL.format(
        where="WHERE EXISTS (SELECT 1 FROM arrivals AS v WHERE v.datedServiceJourneyId = "
        f"study.datedServiceJourneyId AND v.stopPointName = '{STOP}')", floor=20, k=20))
add("leg_profile", "study", "from_to:s hour:i mean:f low:f? high:f? n:i",
    lambda p: leg_study.leg_profile(p.study, STOP, date(2024, 1, 10), 7, 8),
    f"SELECT from_to, hour, {_BAND} FROM (SELECT previous_stop_name || ' - ' || stop_name AS from_to, "
    "hour(time) AS hour, actual_duration AS v, * FROM study) WHERE hour IN (7, 8) "
    f"AND '{STOP}' IN (stop_name, previous_stop_name) AND time >= DATE '2024-01-10' GROUP BY ALL")
add("pair_count", "study", "combinations:i", lambda p: leg_study.pair_count(p.study),
    "SELECT count(DISTINCT (previous_stop, stop)) AS combinations FROM study")
add("pair_count_since", "study", "combinations:i", lambda p: leg_study.pair_count(p.study, FEB),
    "SELECT count(DISTINCT (previous_stop, stop)) AS combinations FROM study WHERE month(time) = 2")
add("pair_count_busy", "study", "combinations:i",
    lambda p: leg_study.pair_count(p.study, FEB, 100),
    "SELECT count(*) AS combinations FROM (SELECT 1 FROM study WHERE month(time) = 2 "
    "GROUP BY previous_stop, stop HAVING count(*) > 100)")
_BASE_MISSING = "FROM arrivals WHERE stopPointRef NOT IN (SELECT id FROM quays)"
add("missing_geometry_count", "study", "missing:i",
    lambda p: leg_study.missing_geometry_count(p.arrivals, p.quays),
    f"SELECT count(DISTINCT stopPointRef) AS missing {_BASE_MISSING}")
add("missing_geometry", "study", "stopPointRef:s stopPointName:s last_seen:d",
    lambda p: leg_study.missing_geometry(p.arrivals, p.quays, 10),
    f"SELECT stopPointRef, stopPointName, max(operatingDate) AS last_seen {_BASE_MISSING} "
    "GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10")
add("missing_geometry_pct", "study", "pct_missing:f",
    lambda p: leg_study.missing_geometry_pct(p.arrivals, p.quays, FEB),
    "SELECT 100.0::DOUBLE * avg(CASE WHEN stopPointRef IN (SELECT id FROM quays) THEN 0 ELSE 1 END) "
    "AS pct_missing FROM arrivals WHERE operatingDate >= DATE '2024-02-01'")
add("pair_distances", "study",
    "previous_stop:s prev_lon:c prev_lat:c stop:s now_lon:c now_lat:c air_distance_km:f",
    lambda p: p.distances, "SELECT * FROM distances")
add("distance_summary", "study", "count:i mean:f std:f min:f q25:f q50:f q75:f max:f",
    lambda p: leg_study.distance_summary(p.distances),
    "SELECT count(*) AS count, avg(d) AS mean, stddev_samp(d) AS std, min(d) AS min, "
    "quantile_cont(d, 0.25) AS q25, quantile_cont(d, 0.5) AS q50, quantile_cont(d, 0.75) AS q75, "
    "max(d) AS max FROM (SELECT air_distance_km AS d FROM distances)")
add("zero_distance_pairs", "study", "previous_stop:s stop:s air_distance_km:f",
    lambda p: leg_study.zero_distance_pairs(p.distances),
    "SELECT * FROM distances WHERE stop <> previous_stop AND air_distance_km = 0")
add("self_leg_count", "study", "count:i", lambda p: leg_study.self_leg_count(p.study),
    "SELECT count(*) AS count FROM study WHERE stop = previous_stop")
add("legs_with_distance", "study",
    "lineRef:s previous_stop:s stop:s datedServiceJourneyId:s time:t planned_time:t actual_duration:f "
    "previous_stop_name:s stop_name:s planned_duration:f deviation:f delay:f prev_lat:c prev_lon:c "
    "now_lat:c now_lon:c air_distance_km:f speed_kmh_upper_bound:f?",
    lambda p: leg_study.legs_with_distance(p.study, p.distances, FEB),
    "SELECT * FROM far_study WHERE time >= DATE '2024-02-01'")
add("fastest_legs", "study",
    "previous_stop_name:s stop_name:s time:t duration_seconds:f speed_km_h_upper_bound:f air_distance_km:f",
    lambda p: leg_study.fastest_legs(p.far_study, 20),
    "SELECT *, actual_duration AS duration_seconds, speed_kmh_upper_bound AS speed_km_h_upper_bound "
    "FROM far_study WHERE actual_duration > 0 ORDER BY speed_kmh_upper_bound DESC, time, "
    "datedServiceJourneyId, previous_stop_name, stop_name LIMIT 20")
add("speeding_pct", "study", "bullet_bus_pct:f", lambda p: leg_study.speeding_pct(p.far_study),
    "SELECT 100.0::DOUBLE * count(*) FILTER (WHERE speed_kmh_upper_bound > 250) "
    "/ count(speed_kmh_upper_bound) AS bullet_bus_pct FROM far_study")


def _flat(df: DataFrame, columns: list[str]) -> DataFrame:
    """Statistics structs as plain columns."""
    out = [c for c in df.columns if not c.endswith("_stats")]
    for c in columns:
        s = f"{c}_stats"
        out += [F.col(f"{s}.{f}").alias(f"{c}_{f}") for f in ("min", "max", "median", "mean", "stddev")]
        out += [F.col(f"{s}.percentiles")[i].alias(f"{c}_p{i}") for i in range(5)]
    return df.select(*out)


def _flat_contract(columns: list[str]) -> str:
    return " ".join(
        f"{c}_{f}:f" for c in columns
        for f in ("min", "max", "median", "mean", "stddev", "p0", "p1", "p2", "p3", "p4")
    )


def _flat_sql(columns: list[str]) -> str:
    out = []
    for c in columns:
        out += [f"min({c}) AS {c}_min", f"max({c}) AS {c}_max", f"median({c}) AS {c}_median",
                f"round(avg({c})) AS {c}_mean", f"round(stddev_samp({c})) AS {c}_stddev"]
        out += [f"quantile_disc({c}, {q}) AS {c}_p{i}" for i, q in enumerate((0.1, 0.25, 0.5, 0.75, 0.9))]
    return ", ".join(out)


_ALL3 = ["actual_duration", "delay", "deviation"]
_HOURLY_LEG = (
    "SELECT stop_name AS stop, previous_stop_name AS previous_stop, year, month, hour, count(*) AS count, "
    "round(avg(air_distance_km), 2) AS air_distance_km, median(planned_duration) AS planned_duration, "
    "min(now_lat) AS stop_lat, min(prev_lon) AS prev_lon, "
    "0.01 * min(now_lat) + 0.99 * min(prev_lat) AS map_lat, "
    "0.01 * min(now_lon) + 0.99 * min(prev_lon) AS map_lon, "
    f"{_flat_sql(_ALL3)} FROM timed GROUP BY ALL HAVING count(*) >= 28"
)
add("leg_stats_struct", "study",
    "stop:s previous_stop:s year:i month:i hour:i count:i air_distance_km:f planned_duration:f "
    "stop_lat:c prev_lon:c map_lat:c map_lon:c " + _flat_contract(_ALL3),
    lambda p: _flat(leg_study.leg_stats_struct(p.far_study), _ALL3), _HOURLY_LEG)
add("stop_stats", "study",
    "stop:s year:i month:i hour:i count:i map_lat:c map_lon:c " + _flat_contract(_ALL3[1:]),
    lambda p: _flat(leg_study.stop_stats(p.far_study), _ALL3[1:]),
    "SELECT stop_name AS stop, year, month, hour, count(*) AS count, min(now_lat) AS map_lat, "
    f"min(now_lon) AS map_lon, {_flat_sql(_ALL3[1:])} FROM timed GROUP BY ALL HAVING count(*) >= 28")
add("rush_factor", "study",
    "rush_factor:f actual_duration_hour:f actual_duration_month:f previous_stop_name:s stop_name:s "
    f"year:i month:i hour:i position:i {_flat_contract(['deviation'])}",
    lambda p: _flat(with_position(leg_study.rush_factor(p.far_study, min_count=40)), ["deviation"]),
    "SELECT *, row_number() OVER (ORDER BY rush_factor DESC, previous_stop_name, stop_name, year, month, hour) AS position FROM ("
    "SELECT round(hourly / monthly, 2) AS rush_factor, hourly AS actual_duration_hour, "
    "monthly AS actual_duration_month, * FROM (SELECT previous_stop_name, stop_name, year, month, hour, "
    f"quantile_disc(actual_duration, 0.75) AS hourly, {_flat_sql(['deviation'])} FROM timed GROUP BY 1, 2, 3, 4, 5 "
    "HAVING count(*) >= 40) JOIN (SELECT previous_stop_name, stop_name, year, month, median(actual_duration) AS monthly "
    "FROM timed GROUP BY 1, 2, 3, 4) USING (previous_stop_name, stop_name, year, month) WHERE monthly >= 60)")

# ---- journeys ------------------------------------------------------------------------

_J = "serviceJourneyId:s operatingDate:d"
add("cancelled_visits", "arrivals", f"{_J} sequenceNr:i lineRef:s stopPointRef:s",
    lambda p: journeys.cancelled_visits(p.arrivals, k=10),
    "SELECT * FROM arrivals WHERE journeyCancellation ORDER BY serviceJourneyId, operatingDate, "
    "sequenceNr LIMIT 10")
add("extra_calls", "arrivals", f"{_J} sequenceNr:i lineRef:s stopPointRef:s",
    lambda p: journeys.cancelled_visits(p.arrivals, "extraCall", k=None),
    "SELECT * FROM arrivals WHERE extraCall")
add("after_cancellation", "arrivals",
    f"lineRef:s {_J} cancelled_time:t? arrivalTime:t? cancelled_nr:i sequenceNr:i estimated:b",
    lambda p: journeys.after_cancellation(p.arrivals),
    "SELECT a.*, c.sequenceNr AS cancelled_nr, c.arrivalTime AS cancelled_time FROM arrivals AS a JOIN "
    "(SELECT * FROM arrivals WHERE journeyCancellation QUALIFY row_number() OVER (PARTITION BY "
    "serviceJourneyId, operatingDate ORDER BY sequenceNr) = 1) AS c USING (serviceJourneyId, operatingDate) "
    "WHERE c.sequenceNr < a.sequenceNr")
# In the test data a journey has at most one cancelled stop, so the flag of the journey
# stands in for it: its visits come in runs.
add("cancellation_context", "arrivals",
    f"{_J} journeyCancellation:b sequenceNr:i last_seen:i? next_seen:i? arrivalTime:t? last_seen_time:t? "
    "next_seen_time:t? last_canceled:b next_canceled:b",
    lambda p: journeys.cancellation_context(p.arrivals, None, p.hot),
    "SELECT * FROM (SELECT *, lag(sequenceNr) OVER w AS last_seen, lead(sequenceNr) OVER w AS next_seen, "
    "lag(stopCancellation) OVER w AS last_canceled, lead(stopCancellation) OVER w AS next_canceled, "
    "lag(arrivalTime) OVER w AS last_seen_time, lead(arrivalTime) OVER w AS next_seen_time FROM arrivals "
    "WHERE stopCancellation AND NOT estimated WINDOW w AS (PARTITION BY serviceJourneyId, operatingDate "
    "ORDER BY sequenceNr)) WHERE coalesce(last_seen, next_seen) IS NOT NULL")
add("selected_journeys", "good", _J, lambda p: p.selected,
    "SELECT DISTINCT serviceJourneyId, operatingDate FROM good")
add("journey_count", "arrivals", "journeys:i", lambda p: journeys.journey_count(p.arrivals),
    "SELECT count(DISTINCT (serviceJourneyId, operatingDate)) AS journeys FROM arrivals")
_BAD = "extraCall OR estimated OR journeyCancellation OR stopCancellation"
add("rejected_journey_count", "arrivals", "rejected:i",
    lambda p: journeys.rejected_journey_count(p.arrivals),
    f"SELECT count(DISTINCT (serviceJourneyId, operatingDate)) AS rejected FROM arrivals WHERE {_BAD}")
add("rejection_reasons", "arrivals",
    "extraCall:i estimated:i journeyCancellation:i stopCancellation:i",
    lambda p: journeys.rejection_reasons(p.arrivals),
    "SELECT " + ", ".join(
        f"count(DISTINCT serviceJourneyId) FILTER (WHERE {c}) AS {c}"
        for c in ("extraCall", "estimated", "journeyCancellation", "stopCancellation")
    ) + " FROM arrivals")
_ENDS = (
    "SELECT DISTINCT lineRef, directionRef, arg_min(stopPointRef, sequenceNr) AS origin, "
    "arg_max(stopPointRef, sequenceNr) AS destination FROM good "
    "GROUP BY lineRef, directionRef, serviceJourneyId, operatingDate"
)
_LD = "lineRef:s directionRef:s"
add("route_endpoints", "good", f"{_LD} origin:s destination:s",
    lambda p: journeys.route_endpoints(p.arrivals), _ENDS)
add("ambiguous_endpoints", "good", f"{_LD} count:i",
    lambda p: journeys.ambiguous(journeys.route_endpoints(p.arrivals)),
    f"SELECT lineRef, directionRef, count(*) AS count FROM ({_ENDS}) GROUP BY 1, 2 HAVING count(*) > 1")
_ORDER = (
    "SELECT DISTINCT lineRef, directionRef, string_agg(stopPointRef, '|' ORDER BY sequenceNr) AS stops, "
    "count(*) AS len FROM good {where} GROUP BY lineRef, directionRef, serviceJourneyId, operatingDate"
)
add("stop_order", "good", f"{_LD} stops:s",
    lambda p: journeys.stop_order(p.arrivals).withColumn("stops", F.array_join("stops", "|")),
    _ORDER.format(where=""))
_WEEKDAY_LINE = f"WHERE dayofweek(operatingDate) NOT IN (0, 6) AND lineRef = '{LINE}'"
add("stop_order_weekday_lengths", "good", f"{_LD} len:i",
    lambda p: journeys.variant_lengths(journeys.stop_order(p.arrivals, None, True, LINE)),
    _ORDER.format(where=_WEEKDAY_LINE))
add("ambiguous_stop_order", "good", f"{_LD} count:i",
    lambda p: journeys.ambiguous(journeys.stop_order(p.arrivals)),
    "SELECT lineRef, directionRef, count(DISTINCT stops) AS count FROM "
    f"({_ORDER.format(where='')}) GROUP BY 1, 2 HAVING count(DISTINCT stops) > 1")
add("canonical_ordering", "good", f"{_LD} stopPointRef:s scheduleNr:i",
    lambda p: journeys.canonical_ordering(p.arrivals),
    "SELECT lineRef, directionRef, stopPointRef, max(sequenceNr) AS scheduleNr FROM good GROUP BY 1, 2, 3")
_PLACES = "SELECT lineRef, directionRef, stopPointRef, max(sequenceNr) AS scheduleNr FROM good GROUP BY ALL"
add("ordering_conflicts", "good", "conflicts:i",
    lambda p: journeys.ordering_conflicts(journeys.canonical_ordering(p.arrivals)),
    "SELECT count(DISTINCT (lineRef, directionRef)) AS conflicts FROM (SELECT lineRef, directionRef "
    f"FROM ({_PLACES}) GROUP BY lineRef, directionRef, scheduleNr HAVING count(*) >= 2)")
add("line_direction_count", "arrivals", "count:i",
    lambda p: journeys.line_direction_count(p.arrivals),
    "SELECT count(DISTINCT (lineRef, directionRef)) AS count FROM arrivals")
_FIVE = "first_decile:f? first_quartile:f? median:f? last_quartile:f? last_decile:f? count:i"
_WAIT = (
    "SELECT *, hour(coalesce(arrivalTime, departureTime)) AS hour, "
    "epoch(coalesce(arrivalTime, departureTime)) - epoch(coalesce(aimedArrivalTime, aimedDepartureTime)) AS v "
    "FROM good"
)
_FIVE_SQL = ", ".join(
    f"quantile_disc(v, {q}) AS {n}" for q, n in zip((0.1, 0.25, 0.5, 0.75, 0.9), journeys.QUANTILES)
) + ", count(*) AS count"
add("delay_quantiles", "good", f"{_LD} stopPointRef:s sequenceNr:i hour:i {_FIVE}",
    lambda p: journeys.delay_quantiles(p.arrivals),
    f"SELECT lineRef, directionRef, stopPointRef, sequenceNr, hour, {_FIVE_SQL} FROM ({_WAIT}) GROUP BY ALL")


def _by_place(p: Projected) -> DataFrame:
    return journeys.delay_quantiles(p.arrivals, by_place=True, weekdays_only=True)


_BY_PLACE = (
    f"SELECT lineRef, directionRef, scheduleNr, hour, {_FIVE_SQL} FROM ({_WAIT} WHERE "
    f"isodow(operatingDate) < 6) JOIN ({_PLACES}) USING (lineRef, directionRef, stopPointRef) GROUP BY ALL"
)
add("delay_quantiles_canonical", "good", f"{_LD} scheduleNr:i hour:i {_FIVE}", _by_place, _BY_PLACE)
add("quantiles_long", "good", "directionRef:s scheduleNr:i hour:i quantity:s delay:f?",
    lambda p: journeys.quantiles_long(
        _by_place(p).where(F.col("lineRef") == LINE), ["directionRef", "scheduleNr", "hour"]),
    f"FROM (SELECT directionRef, scheduleNr, hour, {', '.join(f'{n}::DOUBLE AS {n}' for n in journeys.QUANTILES)} "
    f"FROM ({_BY_PLACE}) WHERE lineRef = '{LINE}') "
    f"UNPIVOT INCLUDE NULLS (delay FOR quantity IN ({', '.join(journeys.QUANTILES)}))")

# ---- directions ----------------------------------------------------------------------

A, B = "Stop 0", "Stop 1"
add("direction_counts_total", "legs", "directionRef:s count:i",
    lambda p: directions.direction_counts(p.legs, LINE),
    f"SELECT directionRef, count(*) AS count FROM legs WHERE lineRef = '{LINE}' GROUP BY 1")
_PAIR_WHERE = f"lineRef = '{LINE}' AND from_stop = '{A}' AND to_stop = '{B}'"
add("direction_counts_month", "legs", "directionRef:s month:d count:i",
    lambda p: directions.direction_counts(p.legs, LINE, "month", A, B),
    "SELECT directionRef, date_trunc('month', operatingDate) AS month, count(*) AS count FROM legs "
    f"WHERE {_PAIR_WHERE} GROUP BY 1, 2")
add("direction_counts_day", "legs", "directionRef:s operatingDate:d count:i",
    lambda p: directions.direction_counts(
        p.legs, LINE, "day", A, B, date(2024, 1, 26), date(2024, 2, 6)),
    "SELECT directionRef, operatingDate, count(*) AS count FROM legs WHERE operatingDate >= '2024-01-26' "
    f"AND operatingDate <= '2024-02-06' AND {_PAIR_WHERE} GROUP BY 1, 2")
_ONE = (
    "SELECT * FROM legs WHERE serviceJourneyId = (SELECT min(serviceJourneyId) FROM legs WHERE "
    f"lineRef = '{LINE}' AND operatingDate = '2024-01-02') AND operatingDate = '2024-01-02'"
)


def _trace(p: Projected) -> DataFrame:
    return directions.trace_journey(p.legs, directions.pick_journey(p.legs, LINE, date(2024, 1, 2)))


_TRACE = "directionRef:s sequenceNr:i start_time:t from_stop:s to_stop:s"
add("journey_legs", "legs", _TRACE, _trace, _ONE)
add("journey_endpoints", "legs", _TRACE + " origin:s destination:s",
    lambda p: directions.journey_endpoints(_trace(p)),
    "SELECT *, first_value(from_stop) OVER (ORDER BY sequenceNr, from_stop) AS origin, "
    f"first_value(to_stop) OVER (ORDER BY sequenceNr DESC, to_stop DESC) AS destination FROM ({_ONE})")
_RANKED = (
    "SELECT * EXCLUDE (r) FROM (SELECT *, first_value(directionRef) OVER (PARTITION BY lineRef, origin, "
    "destination ORDER BY operatingDate, directionRef) AS canonical_direction, rank() OVER (PARTITION BY "
    "operatingDate, lineRef, directionRef ORDER BY count DESC) AS r FROM (SELECT operatingDate, lineRef, "
    "directionRef, origin, destination, count(*) AS count FROM (SELECT operatingDate, lineRef, directionRef, "
    "arg_min(from_stop, sequenceNr) AS origin, arg_max(to_stop, sequenceNr) AS destination FROM legs "
    "GROUP BY operatingDate, lineRef, directionRef, serviceJourneyId) GROUP BY ALL)) WHERE r = 1"
)
add("route_name_ranked", "legs",
    "operatingDate:d lineRef:s directionRef:s origin:s destination:s count:i canonical_direction:s",
    lambda p: p.ranked, _RANKED)


def _route_counts(direction: str, time: str, where: str = "") -> str:
    return (
        f"SELECT {direction}, {time} origin || ' to ' || destination AS route_name, count(*) AS count "
        f"FROM legs JOIN ({_RANKED}) AS n USING (operatingDate, lineRef, directionRef) WHERE "
        f"lineRef = '{LINE}' AND (from_stop, to_stop) IN (('{A}', '{B}'), ('{B}', '{A}')) {where} GROUP BY ALL"
    )


_MONTH_SQL = "date_trunc('month', operatingDate) AS month,"
add("route_counts_day", "legs", "directionRef:s operatingDate:d route_name:s count:i",
    lambda p: directions.route_counts(
        p.legs, p.ranked, LINE, A, B, "day", start=date(2024, 1, 28), end=date(2024, 2, 4)),
    _route_counts("directionRef", "operatingDate,",
                  "AND operatingDate BETWEEN '2024-01-28' AND '2024-02-04'"))
add("route_counts_month", "legs", "directionRef:s month:d route_name:s count:i",
    lambda p: directions.route_counts(p.legs, p.ranked, LINE, A, B, "month"),
    _route_counts("directionRef", _MONTH_SQL))
add("route_counts_canonical", "legs", "canonical_direction:s month:d route_name:s count:i",
    lambda p: directions.route_counts(p.legs, p.ranked, LINE, A, B, "month", canonical=True),
    _route_counts("canonical_direction", _MONTH_SQL))
_FINAL = (
    "SELECT operatingDate, lineRef, directionRef, serviceJourneyId, arg_max(delay, sequenceNr) AS late "
    f"FROM legs WHERE lineRef = '{LINE}' AND operatingDate BETWEEN '2024-01-15' AND '2024-02-15' GROUP BY ALL"
)
add("direction_effect", "legs", "operatingDate:d directionRef:s delay:i kind:s",
    lambda p: directions.direction_effect(
        p.legs, p.ranked, LINE, date(2024, 1, 15), date(2024, 2, 15)),
    "SELECT operatingDate, directionRef, quantile_disc(late, 0.75) AS delay, 'directionRef' AS kind FROM "
    f"({_FINAL}) GROUP BY 1, 2 UNION ALL SELECT operatingDate, n.canonical_direction, quantile_disc(late, 0.75), "
    f"'canonical' FROM ({_FINAL}) JOIN ({_RANKED}) AS n USING (operatingDate, lineRef, directionRef) GROUP BY 1, 2")

# ---- sources, sinks and the incremental batch ----------------------------------------


def _ingested(p: Projected, start: date, end: date) -> str:
    root = scratch(p.spark)
    ingest.ingest_days(p.arrivals, root, start, end)
    return root


def _missing(p: Projected) -> DataFrame:
    root = _ingested(p, date(2024, 1, 10), date(2024, 1, 20))
    return ingest.missing_days(p.spark, root, "arrivals", date(2024, 1, 5), date(2024, 1, 25))


add("missing_days", "arrivals", "day:d", _missing,
    "SELECT DATE '2024-01-05' + CAST(i AS INT) AS day FROM range(20) AS r(i) WHERE day NOT IN (SELECT "
    "operatingDate FROM arrivals WHERE operatingDate BETWEEN '2024-01-10' AND '2024-01-19')")
add("page_ranges", "arrivals", "start:d end:d", lambda p: ingest.page_ranges(p.arrivals, 14),
    'SELECT lo + CAST(14 * i AS INT) AS "start", lo + CAST(14 * i + 14 AS INT) AS "end" FROM (SELECT '
    "min(operatingDate) AS lo, max(operatingDate) AS hi FROM arrivals), range(1000) AS r(i) WHERE lo + CAST(14 * i AS INT) <= hi")


def _paged(p: Projected) -> DataFrame:
    root = scratch(p.spark)
    ingest.ingest_paged(p.arrivals, root, 30)
    return delays.count_by(tables.read_table(p.spark, root, "arrivals"), "operatingDate")


add("ingest_paged", "arrivals", "operatingDate:d count:i", _paged,
    "SELECT operatingDate, count(*) AS count FROM arrivals GROUP BY 1")


def _months(p: Projected) -> DataFrame:
    root = scratch(p.spark)
    tables.save_partitions(p.legs, root, "legs")
    return etl.plan_months(p.spark, root)


add("plan_months", "legs", "month:d", _months,
    "SELECT DISTINCT date_trunc('month', operatingDate) AS month FROM legs")


def _csv(p: Projected) -> DataFrame:
    path = f"{scratch(p.spark)}/csv"
    rows = p.route_names
    tables.write_csv(rows, path)
    return p.spark.read.csv(path, header=True, sep=";", schema=rows.schema)


add("csv_round_trip", "routes", _NAMES, _csv, "SELECT * FROM route_name")


def _appended(p: Projected) -> DataFrame:
    path = f"{scratch(p.spark)}/lines"
    lines = p.arrivals.select("dataSource", "lineRef").distinct()
    first = tables.ensure_table(p.spark, path, lambda: lines.where("dataSource = 'AAA'"))
    again = tables.ensure_table(p.spark, path, lambda: first.limit(0))  # exists: not built
    assert again.columns == first.columns
    tables.append_by_position(lines.where("dataSource = 'BBB'"), p.spark, path)
    tables.append_by_name(
        lines.where("dataSource = 'SOF'").select("lineRef", "dataSource"), p.spark, path)
    return p.spark.read.parquet(path)


add("append_by_name_and_position", "arrivals", "dataSource:s lineRef:s", _appended,
    "SELECT DISTINCT dataSource, lineRef FROM arrivals")


def _sorted(p: Projected) -> DataFrame:
    path = f"{scratch(p.spark)}/sorted"
    tables.write_sorted(
        p.route_names, path, ["origin", "destination", "operatingDate", "dataSource", "lineRef", "directionRef"])
    return stored_positions(p.spark, path)


add("sorted_export", "routes", _NAMES + " position:i", _sorted,
    _in_order("SELECT * FROM route_name", "origin, destination, operatingDate, dataSource, lineRef, directionRef"))


def _layout(p: Projected) -> DataFrame:
    """What the clustering of the published statistics is worth: files that overlap, and files that one month, hour
    and source may lie in, both against the number of files."""
    path, cols = f"{scratch(p.spark)}/stats", ["month", "hour", "dataSource"]
    tables.write_clustered(p.leg_stats, path, cols, ["from_stop", "to_stop"], files=6)
    ranges = file_ranges(p.spark, path, cols)
    one = may_hold(month=F.lit(FEB), hour=F.lit(7), dataSource=F.lit("BBB"))
    return ranges.agg(
        F.sum("rows").alias("rows"), (F.count(F.lit(1)) > 1).alias("several_files"),
        (F.count_if("overlaps") == 0).alias("no_overlaps"), (F.count_if(one) <= 2).alias("few_files_read"),
    )


add("serving_layout", "stats", "rows:i several_files:b no_overlaps:b few_files_read:b", _layout,
    "SELECT count(*) AS rows, count(*) > 1 AS several_files, true AS no_overlaps, true AS few_files_read FROM leg_stats")
add("describe_legs", "legs", "col_name:s data_type:s filled:i", lambda p: tables.describe(p.legs),
    "SELECT name AS col_name, filled, CASE name WHEN 'operatingDate' THEN 'date' WHEN 'sequenceNr' THEN 'bigint' "
    "WHEN 'start_time' THEN 'timestamp' WHEN 'to_lat' THEN 'double' WHEN 'to_lon' THEN 'double' "
    "WHEN 'from_lat' THEN 'double' WHEN 'from_lon' THEN 'double' WHEN 'actual_duration' THEN 'int' "
    "WHEN 'planned_duration' THEN 'int' WHEN 'delay' THEN 'int' WHEN 'deviation' THEN 'int' "
    "WHEN 'air_distance_meters' THEN 'int' ELSE 'string' END AS data_type "
    "FROM (UNPIVOT (SELECT count(COLUMNS('(.*)')) AS '\\1' FROM legs) ON COLUMNS(*) INTO NAME name VALUE filled)")


def _incremental(p: Projected) -> DataFrame:
    """The whole batch in two steps over growing data, read back from the serving tables."""
    root = _ingested(p, date(2024, 1, 1), date(2024, 2, 10))
    ingest.ingest_dim(p.stops, root, "stops")
    ingest.ingest_dim(p.quays, root, "quays")
    etl.run(p.spark, root)
    ingest.ingest_days(p.arrivals, root, date(2024, 2, 1), date(2024, 3, 1))
    etl.run(p.spark, root)
    return p.spark.read.schema(LEG_STATS).parquet(f"{etl.serving_root(p.spark, root)}/leg_stats")


add("etl_incremental_leg_stats", "stats", _LEG_STATS, _incremental, "SELECT * FROM leg_stats")


def _late_days(p: Projected) -> DataFrame:
    """Two weeks of January come after February has been done; the statistics must follow."""
    root = _ingested(p, date(2024, 1, 1), date(2024, 1, 15))
    ingest.ingest_dim(p.stops, root, "stops")
    ingest.ingest_dim(p.quays, root, "quays")
    ingest.ingest_days(p.arrivals, root, date(2024, 1, 29), date(2024, 3, 1))
    etl.run(p.spark, root)
    ingest.ingest_days(p.arrivals, root, date(2024, 1, 1), date(2024, 3, 1))
    etl.run(p.spark, root)
    return p.spark.read.schema(LEG_STATS).parquet(f"{etl.serving_root(p.spark, root)}/leg_stats")


add("etl_late_days_leg_stats", "stats", _LEG_STATS, _late_days, "SELECT * FROM leg_stats")


def _late_direction(p: Projected) -> DataFrame:
    """January comes after February has been done, and turns the directions of February's routes."""
    root = _ingested(p, date(2024, 2, 1), date(2024, 3, 1))
    ingest.ingest_dim(p.stops, root, "stops")
    ingest.ingest_dim(p.quays, root, "quays")
    etl.run(p.spark, root)
    ingest.ingest_days(p.arrivals, root, date(2024, 1, 1), date(2024, 3, 1))
    etl.run(p.spark, root)
    return tables.read_table(p.spark, root, "legs")


add("etl_late_direction", "legs", QUERIES["legs"].contract, _late_direction, "SELECT * FROM legs")


def _zoneless(p: Projected) -> DataFrame:
    """Visits whose times carry no zone, meant in UTC, taken in and counted by hour of recording."""
    zone = p.spark.conf.get("spark.sql.session.timeZone")
    rows = p.arrivals.withColumns({
        f.name: F.to_utc_timestamp(f.name, zone).cast("timestamp_ntz")
        for f in p.arrivals.schema if f.dataType.simpleString() == "timestamp"
    })
    root = scratch(p.spark)
    ingest.ingest_days(rows, root, date(2024, 1, 1), date(2024, 3, 1))
    return tables.read_table(p.spark, root, "arrivals")


add("ingest_zoneless", "arrivals",
    "operatingDate:d serviceJourneyId:s sequenceNr:i recordedAtTime:t arrivalTime:t? aimedArrivalTime:t? "
    "departureTime:t? aimedDepartureTime:t?", _zoneless, "SELECT * FROM arrivals")


# ---- the same with a low threshold, so that many journeys are split as hot groups -------

SPLIT_FROM = 7  # rows


def _split(p: Projected):
    return hot_groups(p.arrivals, JOURNEY, min_rows=SPLIT_FROM)


def _clean_split(p: Projected) -> DataFrame:
    return clean_arrivals(p.arrivals, p.stopdata, hot=_split(p), chunk_rows=2000)


add("clean_arrivals_split", "clean", QUERIES["clean_arrivals"].contract, _clean_split, "SELECT * FROM clean")
add("legs_split", "legs", QUERIES["legs"].contract,
    lambda p: leg_ops.legs(p.visits, p.canonical, hot=_split(p), chunk_rows=2000), "SELECT * FROM legs")
add("lead_gap_stats_split", "arrivals", QUERIES["lead_gap_stats"].contract,
    lambda p: delays.lead_gap_stats(
        p.arrivals, hot_groups(p.arrivals, ["datedServiceJourneyId"], min_rows=SPLIT_FROM)),
    QUERIES["lead_gap_stats"].body)
