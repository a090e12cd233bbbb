"""The number of tasks follows the rows, whatever ``spark.sql.shuffle.partitions`` says."""

import pytest
from pyspark.sql import functions as F

from stopflow.operators import journeys, leg_study, skew
from stopflow.operators.legs import LEG_INPUT, legs
from stopflow.operators.routes import canonical_direction, route_names
from stopflow.operators.visits import clean_arrivals

from .cases import values

STEPS = {
    "clean": lambda t, hot: clean_arrivals(t.arrivals, t.stopdata, hot=hot).select(*LEG_INPUT),
    "selected": lambda t, hot: journeys.of_selected(t.arrivals, hot=hot),
    "endpoints": lambda t, hot: journeys.route_endpoints(t.arrivals, hot=hot),
    "order": lambda t, hot: journeys.stop_order(t.arrivals, hot=hot),
    "study": lambda t, hot: leg_study.legs_by_selfjoin(t.arrivals, hot=hot),
    "positions": lambda t, hot: skew.with_positions(
        t.read("lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], ["l_linenumber"], hot=hot),
}


@pytest.mark.parametrize("name", STEPS)
def test_tasks_hold_a_bounded_number_of_rows(tables, monkeypatch, name):
    total = tables.read("lineitem").count()
    plain = STEPS[name](tables, skew.NO_HOT)
    monkeypatch.setattr(skew, "TASK_ROWS", 400)
    spread = STEPS[name](tables, skew.HotGroups(total=total))
    if name not in ("endpoints", "order"):
        sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) >= total // 400 and max(sizes) < 4 * 400
    assert values(spread, *spread.columns) == values(plain, *plain.columns)


def test_large_tables_tell_their_rows(tables):
    rows = tables.read("lineitem")
    assert skew.hot_groups(rows, ["l_orderkey"], 1000).total == rows.count()
    assert skew.hot_groups(rows, ["l_orderkey"]).total == 0


def test_legs_are_not_shuffled_for_their_directions(spark, tables):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        visits = tables.visits
        out = legs(visits, canonical_direction(route_names(visits)), hot=skew.NO_HOT)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert values(out, *out.columns) == values(tables.legs, *out.columns)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
