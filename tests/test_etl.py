from datetime import date

import pytest
from pyspark.sql import functions as F

from stopflow.plans import etl
from stopflow.schemas import TABLES
from stopflow.sources import ingest, tables as io
from stopflow.sources.testdata import Projected

from .cases import values

START, END = date(2024, 1, 29), date(2024, 2, 4)
OUTPUTS = ["route_name", "legs", "leg_stats", "datasources", "datasource_line", "stop_line"]


@pytest.fixture(scope="module")
def tables(spark):
    """Enough rows per day for the hourly statistics of a few days not to be empty."""
    return Projected(spark, "/root/testdata/sf0.01")


def fill(tables, root, start, end):
    ingest.ingest_dim(tables.stops, root, "stops")
    ingest.ingest_dim(tables.quays, root, "quays")
    return ingest.ingest_days(tables.arrivals, root, start, end)


def snapshot(spark, root):
    out = {n: values(io.read_table(spark, root, n), *TABLES[n].fieldNames()) for n in OUTPUTS}
    served = etl.serving_root(spark, root)
    for n in ("leg_stats", "datasources", "arrivals_stats"):
        out[f"serving/{n}"] = values(io.read_table(spark, served, n), *TABLES[n].fieldNames())
    return out


@pytest.fixture(scope="module")
def at_once(spark, tables, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("once"))
    fill(tables, root, START, END)
    done = etl.run(spark, root)
    assert len(done["days"]) == 6 and done["months"] == [date(2024, 1, 1), date(2024, 2, 1)]
    made = snapshot(spark, root)
    assert all(made.values())
    return root, made


def test_day_by_day_equals_one_run(spark, tables, at_once, tmp_path):
    root = str(tmp_path)
    fill(tables, root, START, date(2024, 2, 1))
    etl.run(spark, root, batch_days=2)
    assert fill(tables, root, START, END) == [date(2024, 2, d) for d in (1, 2, 3)]
    done = etl.run(spark, root, batch_days=2)
    assert done["days"] == [date(2024, 2, d) for d in (1, 2, 3)]
    assert snapshot(spark, root) == at_once[1]


def test_running_again_changes_nothing(spark, at_once):
    root, before = at_once
    versions = etl.serving_versions(spark, root)
    assert etl.run(spark, root) == {"days": [], "months": []}
    assert etl.serving_versions(spark, root) == versions  # nothing was published again
    assert snapshot(spark, root) == before
    io.mark(spark, f"{root}/{etl.UNPUBLISHED}")  # as if a run had broken off before publishing
    assert etl.run(spark, root) == {"days": [], "months": []}
    assert etl.serving_root(spark, root) > versions[-1]
    assert snapshot(spark, root) == before


def test_invalidate_redoes_everything_from_a_date(spark, at_once):
    root, before = at_once
    done = etl.run(spark, root, from_date=date(2024, 2, 2), invalidate=True)
    assert done["days"] == [date(2024, 2, 2), date(2024, 2, 3)]
    assert done["months"] == [date(2024, 2, 1)]
    assert snapshot(spark, root) == before


def test_plans(spark, at_once):
    root, _ = at_once
    assert io.dates(etl.plan_days(spark, root)) == []
    assert len(io.dates(etl.plan_days(spark, root, invalidate=True))) == 6
    assert io.dates(etl.plan_months(spark, root)) == [date(2024, 2, 1)]
    assert len(io.dates(etl.plan_months(spark, root, invalidate=True))) == 2


def test_days_without_rows_leave_nothing_behind(spark, tables, tmp_path):
    root, end = str(tmp_path), date(2024, 1, 31)
    fill(tables, root, START, end)
    etl.run(spark, root)
    assert io.partition_values(spark, root, "legs", "operatingDate") == [START, date(2024, 1, 30)]
    cancelled = io.read_days(spark, root, "arrivals", [START]).withColumn("journeyCancellation", F.lit(True))
    rows = spark.createDataFrame(cancelled.collect(), cancelled.schema)
    io.write_partitions(rows, f"{root}/arrivals", "operatingDate")
    done = etl.run(spark, root, invalidate=True)
    assert done["days"] == [START, date(2024, 1, 30)] and done["months"] == [date(2024, 1, 1)]
    for name in ("legs", "line_day", "route_name"):
        assert io.partition_values(spark, root, name, "operatingDate") == [date(2024, 1, 30)]


def test_zoneless_times_do_not_depend_on_the_session(spark):
    source = spark.sql(
        "select timestamp_ntz'2024-01-03 08:00:00' recordedAtTime, timestamp_ntz'2024-07-03 08:00:00.5' arrivalTime"
    )
    names = [f.name for f in TABLES["arrivals"] if f.name not in source.columns]
    source = source.select("*", *[F.lit(None).alias(n) for n in names])
    got = {}
    for zone in ("UTC", "Europe/Oslo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            for tz in ("UTC", "Europe/Oslo"):
                row = ingest.conform(source, "arrivals", tz).select(
                    F.unix_micros("recordedAtTime").alias("r"), F.unix_micros("arrivalTime").alias("a")
                ).first()
                got[zone, tz] = (row.r, row.a)
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got["UTC", "UTC"] == got["Europe/Oslo", "UTC"] == (1704268800000000, 1719993600500000)
    assert got["UTC", "Europe/Oslo"] == got["Europe/Oslo", "Europe/Oslo"] == (1704265200000000, 1719986400500000)


def test_missing_table_has_no_partitions(spark, tmp_path):
    assert io.dates(io.daily_partitions(spark, str(tmp_path), "legs")) == []
    assert io.dates(io.monthly_partitions(spark, str(tmp_path), "leg_stats", truncate=False)) == []
    assert io.dates(etl.plan_months(spark, str(tmp_path))) == []


def test_partition_filter_is_pruned(spark, at_once):
    plan = io.read_days(spark, at_once[0], "legs", [START])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(operatingDate" in plan or "PartitionFilters: [(operatingDate" in plan


def test_overwrite_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    days = spark.createDataFrame([("a", 1), ("b", 1)], "d string, v int")
    io.write_partitions(days, path, "d")
    io.write_partitions(spark.createDataFrame([("b", 2)], "d string, v int"), path, "d")
    assert values(spark.read.parquet(path), "d", "v") == [("a", 1), ("b", 2)]


def test_date_range_is_half_open(spark):
    assert io.dates(ingest.date_range(spark, date(2024, 2, 28), date(2024, 3, 1))) == [
        date(2024, 2, 28), date(2024, 2, 29)]
    assert io.dates(ingest.date_range(spark, START, START)) == []


def test_pages_cover_the_last_day(spark):
    src = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 1, 31),)], "operatingDate date")
    assert values(ingest.page_ranges(src), "start", "end") == [
        (date(2024, 1, 1), date(2024, 1, 31)), (date(2024, 1, 31), date(2024, 3, 1))]
    assert ingest.page_ranges(src.limit(0)).count() == 0


def test_append_ensure_and_csv(spark, tmp_path):
    path = str(tmp_path / "t")
    base = spark.createDataFrame([(1, "x")], "a int, b string")
    io.ensure_table(spark, path, lambda: base)
    io.ensure_table(spark, path, lambda: pytest.fail("built twice"))
    io.append_by_position(spark.createDataFrame([(2, "y")], "p bigint, q string"), spark, path)
    io.append_by_name(spark.createDataFrame([("z",)], "b string"), spark, path)
    assert values(spark.read.parquet(path), "a", "b") == [(1, "x"), (2, "y"), (None, "z")]
    csv = str(tmp_path / "csv")
    io.write_csv(base, csv)
    assert spark.read.text(csv).where(F.col("value") == "a;b").count() >= 1
    assert values(io.describe(base), "col_name", "data_type") == [("a", "int"), ("b", "string")]
