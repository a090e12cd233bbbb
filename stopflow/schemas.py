"""Column lists and Spark types of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "boolean": T.BooleanType(), "date": T.DateType(),
    "timestamp": T.TimestampType(), "double": T.DoubleType(), "bigint": T.LongType(),
    "int": T.IntegerType(), "smallint": T.ShortType(),
}


def _schema(columns: str) -> T.StructType:
    """``name type, ...`` as a struct type (``fromDDL`` would need a running session)."""
    fields = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


# The column names and types of the published data model.
ARRIVALS = _schema(
    "recordedAtTime timestamp, lineRef string, directionRef string, operatingDate date, "
    "serviceJourneyId string, operatorRef string, extraJourney boolean, "
    "journeyCancellation boolean, stopPointRef string, sequenceNr bigint, originName string, "
    "destinationName string, extraCall boolean, stopCancellation boolean, "
    "aimedArrivalTime timestamp, arrivalTime timestamp, aimedDepartureTime timestamp, "
    "departureTime timestamp, dataSource string, dataSourceName string, estimated boolean"
)
ARRIVALS_EXTRA = _schema(
    "vehicleMode string, stopPointName string, datedServiceJourneyId string"
)
QUAYS = _schema(
    "id string, version string, publicCode string, name string, shortName string, "
    "description string, location_longitude double, location_latitude double, "
    "stopPlaceRef string"
)
STOPS = _schema(
    "id string, version string, publicCode string, transportMode string, name string, "
    "shortName string, description string, location_longitude double, "
    "location_latitude double, topographicPlaceRef string, alternativeNames string, "
    "tariffZoneRefs string, fareZoneRefs string, validBetween string, parentRef string"
)
ROUTE_NAME = _schema(
    "operatingDate date, dataSource string, lineRef string, directionRef string, "
    "destination string, origin string"
)
LEGS = _schema(
    "operatingDate date, lineRef string, dataSource string, directionRef string, "
    "direction string, serviceJourneyId string, sequenceNr bigint, start_time timestamp, "
    "actual_duration int, planned_duration int, delay int, deviation int, to_stop string, "
    "from_stop string, to_lat double, to_lon double, from_lat double, from_lon double, "
    "air_distance_meters int"
)
LEG_STATS = _schema(
    "dataSource string, from_stop string, to_stop string, month date, hour int, "
    "hourly_quartile int, hourly_duration smallint, hourly_delay smallint, "
    "hourly_deviation smallint, mean_hourly_duration smallint, hourly_count bigint, "
    "monthly_duration smallint, monthly_quartile int, monthly_delay smallint, "
    "monthly_deviation smallint, mean_monthly_duration smallint, monthly_count bigint, "
    "air_distance_meters int, from_lat double, from_lon double, to_lat double, to_lon double"
)
DATASOURCES = _schema("dataSource string, dataSourceName string")
DATASOURCE_LINE = _schema("dataSource string, lineRef string")
STOP_LINE = _schema(
    "lineRef string, dataSource string, from_stop string, to_stop string"
)
#: What each day adds to the small tables: rows and latest names by source, and its stop pairs.
SOURCE_DAY = _schema(
    "operatingDate date, dataSource string, dataSourceName string, arrivals bigint"
)
LINE_DAY = _schema(
    "operatingDate date, lineRef string, dataSource string, from_stop string, to_stop string"
)
#: The direction of each route that the legs carry.
ROUTE_DIRECTION = _schema("dataSource string, lineRef string, origin string, destination string, direction string")
ARRIVALS_STATS = _schema("min_date date, max_date date, total_arrivals bigint")

#: Partition column of each partitioned table.
PARTITIONED_BY = {
    "arrivals": "operatingDate",
    "route_name": "operatingDate",
    "legs": "operatingDate",
    "leg_stats": "month",
    "source_day": "operatingDate",
    "line_day": "operatingDate",
}

#: Tables whose partitions are exchanged by manifests, so that readers never meet a gap.
VERSIONED = ("route_name", "legs", "leg_stats")

TABLES = {
    "arrivals": ARRIVALS,
    "quays": QUAYS,
    "stops": STOPS,
    "route_name": ROUTE_NAME,
    "route_direction": ROUTE_DIRECTION,
    "legs": LEGS,
    "leg_stats": LEG_STATS,
    "datasources": DATASOURCES,
    "datasource_line": DATASOURCE_LINE,
    "stop_line": STOP_LINE,
    "arrivals_stats": ARRIVALS_STATS,
    "source_day": SOURCE_DAY,
    "line_day": LINE_DAY,
}

JOURNEY = ["serviceJourneyId", "operatingDate"]
FLAGS = ["extraCall", "estimated", "journeyCancellation", "stopCancellation"]
