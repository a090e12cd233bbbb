"""Builders for hand-written journeys."""

from datetime import date, datetime, timedelta

from stopflow.schemas import ARRIVALS, LEGS

DAY = date(2024, 1, 3)  # a Wednesday
BASE = datetime(2024, 1, 3, 8)

STOPDATA = [  # quay, stop, lat, lon, name
    ("Q1", "S1", 63.40, 10.40, "One"),
    ("Q2", "S2", 63.41, 10.40, "Two"),
    ("Q3", "S3", 63.42, 10.40, "Three"),
    ("Q4a", "S4", 63.43, 10.40, "Four"),
    ("Q4b", "S4", 63.43, 10.40, "Four"),
    ("Q5", "S5", 63.44, 10.40, "Five"),
]


def stopdata(spark):
    return spark.createDataFrame(
        STOPDATA, "quay_id string, stop_id string, lat double, lon double, name string"
    )


def at(seconds):
    return None if seconds is None else BASE + timedelta(seconds=seconds)


def visit(nr, stop, due=None, came=None, **over):
    """A visit due at ``due`` seconds and made at ``came`` (defaults: every 300 s, on time)."""
    due = 300 * nr if due is None else due
    came = due if came is None else came
    row = dict(
        recordedAtTime=at(came), lineRef="X:Line:1", directionRef="Inbound", operatingDate=DAY,
        serviceJourneyId="J1", operatorRef="X", extraJourney=False, journeyCancellation=False,
        stopPointRef=stop, sequenceNr=nr, originName=None, destinationName=None, extraCall=False,
        stopCancellation=False, aimedArrivalTime=at(due), arrivalTime=at(came),
        aimedDepartureTime=at(due + 10), departureTime=at(came + 10), dataSource="X",
        dataSourceName="Operator X", estimated=False,
    )
    row.update(over)
    return row


def arrivals(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in ARRIVALS.fieldNames()) for r in rows], ARRIVALS)


def leg(start, actual, **over):
    row = dict(
        operatingDate=start.date(), lineRef="X:Line:1", dataSource="X", directionRef="Inbound",
        direction="Inbound", serviceJourneyId="J1", sequenceNr=1, start_time=start,
        actual_duration=actual, planned_duration=100, delay=10, deviation=actual - 100,
        to_stop="Two", from_stop="One", to_lat=63.41, to_lon=10.4, from_lat=63.40, from_lon=10.4,
        air_distance_meters=1000,
    )
    row.update(over)
    return row


def legs(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in LEGS.fieldNames()) for r in rows], LEGS)


def values(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


