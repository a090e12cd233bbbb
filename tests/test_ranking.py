"""Positions without a global window, layout of files, and the bounds of broadcasts."""

import pytest
from pyspark.sql import functions as F

from stopflow.operators.ranking import file_ranges, may_hold, stored_positions, with_position
from stopflow.operators.skew import bounded_broadcast, planned_bytes
from stopflow.sources import tables as io


def test_positions_are_those_of_delivery(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 10).alias("k"))
    for ordered in (df.orderBy(F.desc("k"), "v"), df.orderBy("v").limit(17), df.repartition(5), df.limit(0)):
        got = with_position(ordered)
        assert got.columns == ["v", "k", "position"]
        rows = sorted(got.collect(), key=lambda r: r.position)
        assert [r.position for r in rows] == list(range(1, len(rows) + 1))
    rows = sorted(with_position(df.orderBy(F.desc("k"), "v")).collect(), key=lambda r: r.position)
    assert [(r.k, r.v) for r in rows] == sorted(((r.k, r.v) for r in rows), key=lambda x: (-x[0], x[1]))
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_stored_order_and_layout(spark, tmp_path):
    df = spark.range(300).select((F.col("id") * 77 % 300).alias("v"), (F.col("id") % 4).alias("h"))
    path = str(tmp_path / "sorted")
    io.write_sorted(df.repartition(6), path, ["h", "v"])
    rows = sorted(stored_positions(spark, path).collect(), key=lambda r: r.position)
    assert [(r.h, r.v) for r in rows] == sorted((r.h, r.v) for r in rows) and rows[-1].position == 300

    clustered, loose = str(tmp_path / "clustered"), str(tmp_path / "loose")
    io.write_clustered(df, clustered, ["h"], ["v"], files=8)
    df.repartition(8).write.parquet(loose)
    ranges, mixed = file_ranges(spark, clustered, ["h"]).cache(), file_ranges(spark, loose, ["h"]).cache()
    assert ranges.agg(F.sum("rows")).first()[0] == 300 and ranges.count() > 4
    assert ranges.where("overlaps").count() == 0
    assert mixed.where("overlaps").count() == mixed.count() - 1
    assert ranges.where(may_hold(h=F.lit(2))).count() <= 4 < mixed.where(may_hold(h=F.lit(2))).count()


def test_broadcast_is_bounded_by_rows_and_bytes_and_runs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def hint(df):
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()

    side = spark.range(50).select("id", F.repeat(F.lit("x"), 100).alias("text")).mapInArrow(counted, "id long, text string")
    other = side.join(spark.range(10), "id")
    assert planned_bytes(spark.range(10)) == 80
    small = bounded_broadcast(side.crossJoin(side.select(F.col("id").alias("b"))).where("id = b"), 60)
    before = seen.value
    assert hint(small) and spark.range(10).join(small, "id").count() == 10
    assert seen.value == before  # kept from the count
    assert hint(bounded_broadcast(spark.range(10), 10))  # by its planned size alone
    assert not hint(bounded_broadcast(spark.range(10), 9))
    wide = spark.range(400_000).select("id", F.repeat(F.lit("x"), 100).alias("text"), F.array("id").alias("a"))
    assert not hint(bounded_broadcast(wide, 1000)) and bounded_broadcast(wide, 1000) is wide
    assert not hint(bounded_broadcast(wide, 10**6, 10**6))
    assert hint(bounded_broadcast(wide, 10**6)) and other.count() == 10


def test_statistics_of_the_plan_are_upper_bounds(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert 0 < planned_bytes(stored) < planned_bytes(stored.crossJoin(stored.toDF("b")))
    with pytest.raises(Exception):
        bounded_broadcast(stored.select("missing"))
