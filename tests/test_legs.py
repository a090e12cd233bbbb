from datetime import date, datetime, timedelta

import pytest

from stopflow.operators.leg_stats import datasources, leg_stats
from stopflow.operators.legs import candidate_legs, legs
from stopflow.operators.routes import canonical_direction, route_names
from stopflow.operators.skew import NO_HOT, hot_groups
from stopflow.operators.visits import clean_arrivals
from stopflow.schemas import JOURNEY, LEG_STATS, LEGS

from . import cases
from .cases import arrivals, leg, stopdata, values, visit

WED = datetime(2024, 1, 3, 8)


@pytest.fixture(params=["window", "chunks"])
def build(request, spark):
    def run(rows):
        visits = arrivals(spark, rows)
        hot = NO_HOT if request.param == "window" else hot_groups(visits, JOURNEY, min_rows=1)
        clean = clean_arrivals(visits, stopdata(spark), hot=hot, chunk_rows=2)
        return legs(clean, canonical_direction(route_names(clean)), hot=hot, chunk_rows=2)

    return run


def test_leg_of_first_stop_starts_at_departure(build):
    first = visit(1, "Q1", 0, 0, arrivalTime=None, aimedArrivalTime=None)
    out = build([first, visit(2, "Q2", 300, 330)])
    row = out.first()
    assert out.columns == LEGS.fieldNames()
    assert (row.sequenceNr, row.from_stop, row.to_stop) == (1, "One", "Two")
    assert row.start_time == cases.at(10)
    assert (row.actual_duration, row.planned_duration, row.delay, row.deviation) == (320, 290, 30, 30)
    assert row.air_distance_meters == 1115  # 0.01 degrees of latitude at 63.4 north


def test_durations_round_half_to_even(build):
    half = cases.at(300) + timedelta(milliseconds=500)
    row = build([visit(1, "Q1", 0, 0), visit(2, "Q2", 300, 300, arrivalTime=half)]).first()
    assert (row.actual_duration, row.delay) == (300, 0)


def test_visit_by_stop_id_gives_one_leg_each_way(build):
    out = build([visit(1, "Q3"), visit(2, "S4"), visit(3, "Q5")])
    assert values(out, "from_stop", "to_stop") == [("Four", "Five"), ("Three", "Four")]


def test_leg_bridges_a_removed_visit(build):
    out = build([visit(1, "Q1"), visit(2, "nowhere"), visit(3, "Q3")])
    assert values(out, "from_stop", "to_stop", "sequenceNr") == [("One", "Three", 1)]


def test_same_place_is_no_leg(build):
    assert build([visit(1, "Q4a"), visit(2, "Q4b")]).count() == 0


@pytest.mark.parametrize("seconds,expected", [(16, 0), (17, 1)])
def test_speed_limit(build, seconds, expected):
    # 1115 m in 16 s is 250.9 km/h
    assert build([visit(1, "Q1", 0, 0), visit(2, "Q2", 20, seconds)]).count() == expected


def test_direction_is_the_first_one_seen(spark):
    def day(d, direction):
        shift = timedelta(days=d)
        rows = [visit(1, "Q1"), visit(2, "Q2")]
        for r in rows:
            r.update(operatingDate=r["operatingDate"] + shift, directionRef=direction)
        return rows

    visits = arrivals(spark, day(0, "Inbound") + day(1, "Outbound"))
    clean = clean_arrivals(visits, stopdata(spark), hot=NO_HOT)
    out = legs(clean, canonical_direction(route_names(clean)), hot=NO_HOT)
    assert values(out, "directionRef", "direction") == [("Inbound", "Inbound"), ("Outbound", "Inbound")]


def test_route_name_takes_the_most_common_pair(spark):
    rows = []
    for j, quays in enumerate((("Q1", "Q2"), ("Q1", "Q2"), ("Q1", "Q3"))):
        rows += [visit(i, q, serviceJourneyId=f"J{j}") for i, q in enumerate(quays, 1)]
    clean = clean_arrivals(arrivals(spark, rows), stopdata(spark), hot=NO_HOT)
    assert values(route_names(clean), "origin", "destination") == [("One", "Two")]


def test_visit_without_line_takes_no_part(spark):
    rows = [visit(1, "Q1"), visit(2, "Q2", lineRef=None), visit(3, "Q3")]
    clean = clean_arrivals(arrivals(spark, rows), stopdata(spark), hot=NO_HOT)
    assert values(candidate_legs(clean, NO_HOT), "from_stop", "to_stop") == [("One", "Three")]


def test_hourly_count_floor(spark):
    rows = [leg(WED, 100 + i) for i in range(20)] + [leg(WED, 200 + i, from_stop="A") for i in range(21)]
    out = leg_stats(cases.legs(spark, rows))
    assert out.columns == LEG_STATS.fieldNames()
    assert [f.dataType for f in out.schema] == [f.dataType for f in LEG_STATS]
    assert values(out, "from_stop", "hourly_count", "hourly_quartile", "hourly_duration") == [("A", 21, 215, 210)]


@pytest.mark.parametrize("metres,expected", [(50, 0), (51, 1)])
def test_distance_floor(spark, metres, expected):
    rows = [leg(WED, 100, air_distance_meters=metres) for _ in range(21)]
    assert leg_stats(cases.legs(spark, rows)).count() == expected


def test_weekend_depends_on_the_zone(spark):
    sunday_night = datetime(2024, 1, 7, 23, 30)
    rows = [leg(sunday_night, 100) for _ in range(21)]
    assert leg_stats(cases.legs(spark, rows)).count() == 0
    assert values(leg_stats(cases.legs(spark, rows), tz="Europe/Oslo"), "hour") == [(0,)]


def test_month_figures_cover_all_hours(spark):
    rows = [leg(WED, 100) for _ in range(21)] + [leg(WED + timedelta(hours=3), 500) for _ in range(9)]
    row = leg_stats(cases.legs(spark, rows), month=date(2024, 1, 15)).first()
    assert (row.hourly_count, row.monthly_count, row.mean_hourly_duration, row.mean_monthly_duration) == (21, 30, 100, 220)
    assert leg_stats(cases.legs(spark, rows), month=date(2024, 2, 1)).count() == 0


def test_latest_source_name(spark):
    rows = [visit(1, "Q1", dataSourceName="Old"), visit(1, "Q1", dataSourceName="New", operatingDate=date(2024, 1, 9)),
            visit(1, "Q1", dataSourceName=None, operatingDate=date(2024, 1, 10))]
    assert values(datasources(arrivals(spark, rows)), "dataSource", "dataSourceName") == [("X", "New")]
