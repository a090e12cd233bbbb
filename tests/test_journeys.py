from datetime import date, datetime

from pyspark.sql import functions as F

from stopflow.operators import delays, directions, journeys, leg_study

from . import cases
from .cases import arrivals, at, values, visit


def test_good_journeys_need_every_flag_known_and_clear(spark):
    rows = [visit(1, "Q1"), visit(2, "Q2"),
            visit(1, "Q1", serviceJourneyId="J2"), visit(2, "Q2", serviceJourneyId="J2", extraCall=True),
            visit(1, "Q1", serviceJourneyId="J3", estimated=None)]
    df = arrivals(spark, rows)
    assert values(journeys.selected_journeys(df), "serviceJourneyId") == [("J1",)]
    assert journeys.rejected_journey_count(df).first().rejected == 1
    assert journeys.journey_count(df).first().journeys == 3
    assert journeys.rejection_reasons(df).first().extraCall == 1


def test_every_later_visit_once(spark):
    rows = [visit(1, "Q1"), visit(2, "Q2", journeyCancellation=True),
            visit(3, "Q3", journeyCancellation=True), visit(4, "Q5", estimated=True),
            visit(1, "Q1", serviceJourneyId="J2")]
    out = journeys.after_cancellation(arrivals(spark, rows))
    assert values(out, "cancelled_nr", "sequenceNr", "estimated") == [(2, 3, False), (2, 4, True)]


def test_neighbours_of_cancelled_stops(spark):
    rows = [visit(i, "Q1", stopCancellation=i in (2, 5)) for i in range(1, 6)]
    rows.append(visit(1, "Q1", serviceJourneyId="alone", stopCancellation=True))
    out = journeys.cancellation_context(arrivals(spark, rows))
    assert values(out, "sequenceNr", "last_seen", "next_seen", "last_canceled") == [
        (2, None, 5, None), (5, 2, None, True)]


def test_stop_orders_and_their_ambiguity(spark):
    rows = []
    for j, quays in (("J1", "Q1 Q2 Q3"), ("J2", "Q1 Q2 Q3"), ("J3", "Q1 Q3")):
        rows += [visit(i, q, serviceJourneyId=j) for i, q in enumerate(quays.split(), 1)]
    df = arrivals(spark, rows)
    orders = journeys.stop_order(df)
    assert sorted(r.stops for r in orders.collect()) == [["Q1", "Q2", "Q3"], ["Q1", "Q3"]]
    assert values(journeys.variant_lengths(orders), "len") == [(2,), (3,)]
    assert journeys.ambiguous(orders).first()["count"] == 2
    assert values(journeys.route_endpoints(df), "origin", "destination") == [("Q1", "Q3")]
    places = journeys.canonical_ordering(df)
    assert values(places, "stopPointRef", "scheduleNr") == [("Q1", 1), ("Q2", 2), ("Q3", 3)]
    assert journeys.ordering_conflicts(places).first().conflicts == 0


def test_weekend_days_are_left_out(spark):
    rows = [visit(1, "Q1"), visit(1, "Q2", operatingDate=date(2024, 1, 6))]
    assert journeys.stop_order(arrivals(spark, rows), weekdays_only=True).count() == 1
    assert journeys.delay_quantiles(arrivals(spark, rows), weekdays_only=True).count() == 1


def test_quantiles_wide_and_long(spark):
    rows = [visit(1, "Q1", 0, 10 * i, serviceJourneyId=f"J{i}") for i in range(1, 11)]
    wide = journeys.delay_quantiles(arrivals(spark, rows))
    row = wide.first()
    assert (row.first_decile, row.first_quartile, row.median, row.last_quartile, row.last_decile) == (10, 30, 50, 80, 90)
    long = journeys.quantiles_long(wide, ["directionRef", "sequenceNr"])
    assert long.count() == 5 and ("median", 50.0) in values(long, "quantity", "delay")


def test_histogram_edges(spark):
    df = spark.createDataFrame([("f", float(v)) for v in (0, 1, 9, 10)], "f string, v double")
    out = delays.histogram(df, "v", ["f"], bins=5)
    assert values(out, "bin", "bin_start", "count") == [(0, 0.0, 2), (4, 8.0, 2)]
    flat = delays.histogram(df.where("v = 1"), "v", ["f"], bins=5)
    assert values(flat, "bin", "count") == [(0, 1)]


def test_missing_endpoints_round_half_to_even(spark):
    rows = [visit(i, "Q1", originName="x" if i > 1 else None, destinationName="y") for i in range(1, 9)]
    row = delays.missing_endpoints(arrivals(spark, rows)).first()
    assert (row.missing_origin, row.missing_destination) == (12, 0)  # 12.5 %


def named(spark, rows):
    df = arrivals(spark, rows)
    return df.withColumn("stopPointName", F.col("stopPointRef")).withColumn(
        "datedServiceJourneyId", F.concat("operatingDate", F.lit(":"), "serviceJourneyId"))


def test_self_join_needs_consecutive_numbers(spark):
    df = named(spark, [visit(1, "Q1", 0, 0), visit(2, "Q2", 300, 360), visit(4, "Q5", 900, 900)])
    out = leg_study.legs_by_selfjoin(df)
    assert values(out, "previous_stop", "stop", "planned_duration", "actual_duration", "deviation", "delay") == [
        ("Q1", "Q2", 300.0, 360.0, 60.0, 60.0)]


def test_sum_over_rows_counts_the_last_stop(spark):
    df = named(spark, [visit(1, "Q1", 0, 0), visit(2, "Q2", 100, 100)])
    row = delays.lead_gap_stats(df).first()
    assert (row.max_gap, row.min_gap, row.sum_over_rows) == (100.0, 100.0, 50.0)


def test_missing_geometry(spark):
    df = named(spark, [visit(1, "Q1"), visit(2, "lost"), visit(3, "Q2"), visit(4, "Q2")])
    quays = spark.createDataFrame([("Q1", 1.0, 2.0), ("Q2", 1.0, 2.0)],
                                  "id string, location_longitude double, location_latitude double")
    assert leg_study.missing_geometry_count(df, quays).first().missing == 1
    assert leg_study.missing_geometry(df, quays).first().stopPointRef == "lost"
    assert leg_study.missing_geometry_pct(df, quays).first().pct_missing == 25.0


def test_ranked_names_keep_ties(spark):
    when = datetime(2024, 1, 3, 8)
    rows = [cases.leg(when, 100, serviceJourneyId="J1"), cases.leg(when, 100, serviceJourneyId="J2", to_stop="Three")]
    out = directions.route_name_ranked(cases.legs(spark, rows))
    assert values(out, "origin", "destination", "count") == [("One", "Three", 1), ("One", "Two", 1)]


def test_time_of_local_day(spark):
    df = named(spark, [visit(1, "Q1", 0, 0)])
    assert delays.delay_by_time(df, "Q1", tz="Europe/Oslo").first().hour == 9
    assert at(0).hour == 8
