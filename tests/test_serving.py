from datetime import date

import pytest

from stopflow.operators import serving
from stopflow.schemas import LEG_STATS

from .cases import values

JAN, FEB = date(2024, 1, 1), date(2024, 2, 1)


def stat(month, mean, **over):
    row = dict(
        dataSource="X", from_stop="A", to_stop="B", month=month, hour=8, hourly_quartile=mean + 20,
        hourly_duration=mean, hourly_delay=5, hourly_deviation=1, mean_hourly_duration=mean,
        hourly_count=30, monthly_duration=100, monthly_quartile=110, monthly_delay=4,
        monthly_deviation=0, mean_monthly_duration=101, monthly_count=300,
        air_distance_meters=500, from_lat=60.0, from_lon=10.0, to_lat=61.0, to_lon=11.0,
    )
    row.update(over)
    return row


def stats(spark, *rows):
    return spark.createDataFrame([tuple(r[c] for c in LEG_STATS.fieldNames()) for r in rows], LEG_STATS)


def lines(spark, *rows):
    return spark.createDataFrame(list(rows), "lineRef string, dataSource string, from_stop string, to_stop string")


def test_comparison_figures(spark):
    df = stats(spark, stat(JAN, 100), stat(FEB, 130))
    row = serving.comparisons(df, lines(spark, ("L", "X", "A", "B")), JAN, FEB, 8).first()
    assert (row.net_change_seconds, row.net_change_proportion, row.net_change_pct) == (30, 13, 30)
    assert (row.cur_mean_hourly_duration, row.prev_mean_hourly_duration) == (130, 100)
    assert row.lat == pytest.approx(60.015)


def test_month_against_itself_is_empty(spark):
    df = stats(spark, stat(JAN, 100), stat(FEB, 130))
    assert serving.comparisons(df, lines(spark, ("L", "X", "A", "B")), FEB, date(2024, 2, 9), 8).count() == 0


def test_limit_applies_only_without_source(spark):
    pairs = [f"S{i}" for i in range(4)]
    rows = [stat(m, v + 10 * i, to_stop=p) for i, p in enumerate(pairs) for m, v in ((JAN, 100), (FEB, 150))]
    on = lines(spark, *[("L", "X", "A", p) for p in pairs])
    df = stats(spark, *rows)
    top = serving.comparisons(df, on, JAN, FEB, 8, limit=2)
    changes = [r.abs_net_change_proportion for r in top.collect()]
    assert changes == sorted(changes) and len(changes) == 2 and max(changes) == 20
    assert serving.comparisons(df, on, JAN, FEB, 8, limit=2, source="X").count() == 4
    assert serving.comparisons(df, on, JAN, FEB, 8, source="X", line="other").count() == 0


def test_leg_on_many_lines_is_shown_once(spark):
    df = stats(spark, stat(FEB, 100))
    on = lines(spark, ("L1", "X", "A", "B"), ("L2", "X", "A", "B"))
    assert serving.leg_view(df, on, FEB, 8, "X").count() == 1
    assert serving.leg_view(df, on, FEB, 8, "X", "L2").count() == 1
    assert serving.leg_view(df, on, FEB, 8, "X", "L3").count() == 0
    assert serving.leg_view(df, on.where("false"), FEB, 8, "X").count() == 0


def test_hot_spots_keep_the_highest_and_show_them_last(spark):
    df = stats(spark, *[stat(FEB, 100 + 50 * i, to_stop=f"S{i}") for i in range(5)], stat(JAN, 900))
    out = serving.hot_spots(df, date(2024, 2, 20), 8, limit=3).collect()
    assert [r.rush_intensity for r in out] == [2.2, 2.7, 3.2]
    assert out[-1].name == "A to S4"
    plan = serving.hot_spots(df, FEB, 8)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_lines_in_natural_order(spark):
    refs = ["X:Line:2_10", "X:Line:2_9", "X:Line:Express"]
    df = spark.createDataFrame([("X", r) for r in refs] + [("Y", "Y:Line:1")], "dataSource string, lineRef string")
    got = [r.label for r in serving.lines_for_datasource(df, "X").collect()]
    assert got == ["2_9", "2_10", "Express"]
    labels = spark.createDataFrame([("b",), ("3_2",), ("a",), ("1_10",)], "label string")
    assert [r.label for r in serving.natural_order(labels).collect()] == ["3_2", "1_10", "a", "b"]


def test_sources_leave_out_the_excluded(spark):
    df = spark.createDataFrame([("SOF", "a"), ("X", "z"), ("Y", "b")], "dataSource string, dataSourceName string")
    assert [r.dataSource for r in serving.datasources_by_name(df).collect()] == ["Y", "X"]
    assert serving.datasources_by_name(df, exclude=("Y", "X")).first().dataSource == "SOF"


@pytest.mark.parametrize("day,shown", [(date(2024, 2, 7), [JAN]), (date(2024, 2, 8), [JAN, FEB])])
def test_months_that_just_began_are_hidden(spark, day, shown):
    df = stats(spark, stat(JAN, 1), stat(FEB, 1))
    assert [r.month for r in serving.months(df, day).collect()] == shown
    assert serving.months(df).count() == 2


@pytest.mark.parametrize("day,stale", [(date(2024, 3, 3), False), (date(2024, 3, 4), True)])
def test_freshness(spark, day, stale):
    df = spark.createDataFrame([(JAN, date(2024, 2, 29), 7)], "min_date date, max_date date, total_arrivals bigint")
    assert serving.freshness(df, day).first().stale is stale


def test_totals(spark):
    one = spark.createDataFrame([(JAN, FEB, 7)], "min_date date, max_date date, total_arrivals bigint")
    row = serving.totals(stats(spark, stat(JAN, 1), stat(FEB, 1)), one).first()
    assert (row.leg_count, row.arrivals_count, row.aggregated_count, row.start, row.end) == (60, 7, 2, JAN, FEB)
    assert values(serving.total_arrivals(one), "total_arrivals") == [(7,)]
