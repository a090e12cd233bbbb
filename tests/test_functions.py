from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stopflow import functions as X
from stopflow.functions.geo import with_geodesic


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_rounding_is_half_to_even(spark):
    row = one(spark, *[X.round_to(F.lit(v)).alias(f"c{i}") for i, v in enumerate((2.5, 3.5, -2.5, 2.51))])
    assert tuple(row) == (2, 4, -2, 3)


def test_seconds_are_fractional(spark):
    a, b = F.timestamp_micros(F.lit(2_500_000)), F.timestamp_micros(F.lit(1_000_000))
    assert one(spark, X.seconds_between(a, b).alias("s")).s == 1.5


@pytest.mark.parametrize("session", ["UTC", "America/New_York"])
def test_local_time_does_not_depend_on_the_session(spark, session):
    sunday_night = F.timestamp_seconds(F.lit(1704670200))  # 2024-01-07 23:30 UTC
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", session)
    try:
        row = one(
            spark,
            X.local_weekday(sunday_night).alias("utc"),
            X.local_weekday(sunday_night, "Europe/Oslo").alias("oslo"),
            X.local_hour(sunday_night).alias("h"),
            X.local_hour(sunday_night, "Europe/Oslo").alias("ho"),
            X.local_year(F.timestamp_seconds(F.lit(1704063600)), "Europe/Oslo").alias("y"),
        )
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert tuple(row) == (0, 1, 23, 0, 2024)


def test_geodesic_known_values(spark):
    rows = [
        (0.0, 0.0, 0.0, 0.0, 0.0),
        (60.0, 10.0, 60.0, 10.0, 0.0),
        (0.0, 0.0, 0.0, 1.0, 111319.49079),
        (0.0, 0.0, 1.0, 0.0, 110574.38856),
        # published example: Flinders Peak to Buninyong
        (-37.95103341666667, 144.42486788888888, -37.65282113888889, 143.92649552777777, 54972.271),
    ]
    df = spark.createDataFrame(rows, "from_lat double, from_lon double, to_lat double, to_lon double, want double")
    for r in with_geodesic(df, "m").collect():
        assert r.m == pytest.approx(r.want, abs=2e-3)


def test_geodesic_of_unknown_place_is_null(spark):
    df = spark.createDataFrame([(None, 1.0, 1.0, 1.0)], "from_lat double, from_lon double, to_lat double, to_lon double")
    assert with_geodesic(df, "m").first().m is None
    assert X.geodesic_meters(df).first().air_distance_meters is None


def test_geodesic_stage_stays_compilable(spark):
    """The JIT leaves methods above 8000 bytes interpreted, which is many times slower."""
    import contextlib
    import io
    import re

    base = spark.range(8).select(
        *[(F.rand(i) + 60).alias(c) for i, c in enumerate(("from_lat", "from_lon", "to_lat", "to_lon"))]
    )
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        X.geodesic_meters(base).explain("codegen")
    assert max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())) < 8000


def test_haversine(spark):
    d = X.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    assert one(spark, d.alias("d")).d == pytest.approx(6378.0 * 3.141592653589793 / 180)


def test_labels(spark):
    row = one(
        spark,
        X.line_number(F.lit("A:Line:2_14")).alias("a"),
        X.line_number(F.lit("A:Line:Express")).alias("b"),
        X.last_segment(F.lit("A:Line:2_14")).alias("c"),
        X.label_number(F.lit("2_14")).alias("d"),
        X.label_number(F.lit("Express")).alias("e"),
    )
    assert tuple(row) == (14, None, "2_14", 14, None)


def test_discrete_quantile_and_stats_struct(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 11)], "v double")
    row = df.agg(X.quantile_disc("v", 0.75, "int").alias("q"), X.stats_struct("v")).first()
    assert row.q == 8
    assert list(row.v_stats.percentiles) == [1.0, 3.0, 5.0, 8.0, 9.0]
    assert (row.v_stats.min, row.v_stats.max, row.v_stats.median) == (1.0, 10.0, 5.5)


def test_mean_band_of_single_value(spark):
    df = spark.createDataFrame([(5.0,)], "v double")
    row = df.agg(*X.mean_band(F.col("v"))).first()
    assert (row["mean"], row.low, row.n) == (5.0, None, 1)


def test_month_start_is_a_date(spark):
    day = F.to_date(F.lit("2024-02-17"))
    assert one(spark, X.month_start(day).alias("m")).m == datetime(2024, 2, 1).date()
