"""Statistics and selections that read the fact once, and the ways around hot keys."""

import random
import re
from collections import Counter, defaultdict
from statistics import median

import pytest
from pyspark.sql import functions as F

from stopflow.operators import journeys, leg_stats, leg_study, routes
from stopflow.operators.histograms import disc, mean, middle, rolled_up, rows_behind, value_counts, with_shares
from stopflow.operators.skew import NO_HOT, hot_groups
from stopflow.schemas import JOURNEY

from .cases import values


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df):
    return len(re.findall(r"FileScan ", plan_of(df)))


def exchanges(df):
    return len(re.findall(r"Exchange (?:hash|range|Round|Single)", plan_of(df)))


@pytest.fixture(scope="module")
def stored(spark, tables, tmp_path_factory):
    """Visits, cleaned visits and legs as files."""
    root = str(tmp_path_factory.mktemp("fact"))
    for name, df in (("visits", tables.arrivals), ("legs", tables.legs)):
        df.write.parquet(f"{root}/{name}")
    return {n: spark.read.parquet(f"{root}/{n}") for n in ("visits", "legs")}


def test_histogram_figures_equal_plain_ones(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randrange(3), rng.choice([None, rng.randrange(-3, 4)]), 2) for _ in range(300)]
    rows += [("c", 0, None, 5), ("c", 1, None, 5)]
    df = spark.createDataFrame(rows, "k string, hour int, x int, y int")
    counts = value_counts(df, ["k", "hour"], ["x", "y"])
    assert counts.count() <= 3 * 3 * 9
    keys = ["k", "hour"]
    got = {
        (r.k, r.hour): tuple(r)[3:]
        for r in with_shares(rolled_up(counts, keys, "hour"), [*keys, "coarse"]).groupBy(*keys, "coarse").agg(
            middle("x"), mean("x"), disc("x", 0.75), disc("x", 0.1), rows_behind("x"), middle("y")
        ).collect()
    }
    groups = defaultdict(list)
    for k, hour, x, _ in rows:
        groups[k, hour].append(x)
        groups[k, None].append(x)
    want = {}
    for key, all_x in groups.items():
        xs = sorted(x for x in all_x if x is not None)
        at = lambda p: next(x for i, x in enumerate(xs, 1) if i >= p * len(xs)) if xs else None  # noqa: E731,B023
        want[key] = (median(xs) if xs else None, sum(xs) / len(xs) if xs else None, at(0.75), at(0.1), len(all_x))
    assert {k: v[:5] for k, v in got.items()} == {k: pytest.approx(v) for k, v in want.items()}


def test_leg_stats_reads_and_shuffles_the_legs_once(stored):
    plan = plan_of(leg_stats.leg_stats(stored["legs"]))
    assert plan.count("FileScan ") == 1
    # One exchange of rows counted map-side, one of the counts.
    assert len(re.findall(r"Exchange hash", plan)) == 2
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("make, raw_exchanges", [
    (lambda v: journeys.of_selected(v, hot=NO_HOT), 1),
    (lambda v: journeys.route_endpoints(v, hot=NO_HOT), 2),
    (lambda v: journeys.stop_order(v, hot=NO_HOT), 2),
    (lambda v: journeys.canonical_ordering(v, hot=NO_HOT), 2),
    (lambda v: journeys.delay_quantiles(v, hot=NO_HOT), 3),
    (lambda v: leg_study.legs_by_selfjoin(v, hot=NO_HOT), 1),
])
def test_visits_are_read_once(stored, make, raw_exchanges):
    """One exchange of visits; the others move distinct results or counts."""
    df = make(stored["visits"])
    assert scans(df) == 1
    assert exchanges(df) == raw_exchanges


def placeholder(spark, n=900, seed=2):
    """Visits of which a third share one journey."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "placeholder" if i % 3 == 0 else f"j{rng.randrange(60)}"
        rows.append((key, rng.randrange(1, 12), rng.choice([None, rng.randrange(5000)]), rng.random() < 0.1, f"S{rng.randrange(4)}"))
    rows += [(None, 1, 10, False, "S0"), (None, 2, 20, False, "S1"), ("j1", None, 5, False, "S2")]
    return spark.createDataFrame(
        rows, "datedServiceJourneyId string, sequenceNr bigint, t int, bad boolean, stop string"
    ).select(
        "datedServiceJourneyId", "sequenceNr", F.col("stop").alias("stopPointName"), F.col("stop").alias("stopPointRef"),
        F.lit("L").alias("lineRef"), F.timestamp_seconds("t").alias("arrivalTime"),
        F.timestamp_seconds(F.col("t") - 7).alias("aimedArrivalTime"), F.col("bad").alias("stopCancellation"),
        F.lit(False).alias("journeyCancellation"), F.lit(False).alias("extraCall"),
    )


def test_successors_of_repeated_numbers_and_hot_journeys(spark):
    df = placeholder(spark).cache()
    by_key = defaultdict(list)
    for r in df.collect():
        if r.arrivalTime is not None and r.datedServiceJourneyId is not None and r.sequenceNr is not None:
            by_key[r.datedServiceJourneyId, r.sequenceNr].append(r)
    want = Counter()
    for (key, nr), rows in list(by_key.items()):
        for now in rows:
            for before in by_key[key, nr - 1] if not now.stopCancellation else []:
                want[key, before.stopPointRef, now.stopPointRef, now.arrivalTime, (now.arrivalTime - before.arrivalTime).total_seconds()] += 1
    hot = hot_groups(df, ["datedServiceJourneyId"], 100)
    assert len(hot.hashes) == 1
    for how in ({"hot": NO_HOT}, {"hot": hot}, {"hot": hot, "salts": 3}):
        out = leg_study.legs_by_selfjoin(df, 10**9, 10**9, **how)
        got = Counter((r.datedServiceJourneyId, r.previous_stop, r.stop, r.time, float(r.actual_duration)) for r in out.collect())
        assert got == want


def test_salts_spread_a_hot_journey(spark):
    df = placeholder(spark, 3000)
    hot = hot_groups(df, ["datedServiceJourneyId"], 500)
    joined = leg_study.legs_by_selfjoin(df, 10**9, 10**9, hot=hot, salts=24)
    only = joined.where(F.col("datedServiceJourneyId") == "placeholder")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        sizes = sorted(r["count"] for r in only.groupBy(F.spark_partition_id()).count().collect())
    finally:
        for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(sizes) == 8 and sizes[-1] <= 2 * median(sizes)


def test_hot_journeys_are_selected_and_ordered_alike(spark, tables):
    df = tables.arrivals.withColumn(
        "serviceJourneyId", F.when(F.col("sequenceNr") > 0, F.when(
            F.xxhash64("serviceJourneyId") % 3 == 0, F.lit("all")).otherwise(F.col("serviceJourneyId")))
    ).where("NOT extraCall AND NOT estimated AND NOT stopCancellation AND NOT journeyCancellation OR serviceJourneyId <> 'all'")
    df = df.cache()
    hot = hot_groups(df, JOURNEY, 25)
    assert hot.hashes
    for run in (
        lambda h: journeys.of_selected(df, hot=h).select(*JOURNEY, "sequenceNr", "stopPointRef"),
        lambda h: journeys.route_endpoints(df, hot=h).select("lineRef", "directionRef"),
        lambda h: journeys.canonical_ordering(df, hot=h),
        lambda h: journeys.delay_quantiles(df, hot=h),
    ):
        plain, split = run(NO_HOT), run(hot)
        assert values(plain, *plain.columns) == values(split, *plain.columns)
    plain = journeys.stop_order(df, hot=NO_HOT)
    split = journeys.stop_order(df, hot=hot, chunk_rows=7)
    assert plain.columns == split.columns
    assert Counter((r.lineRef, r.directionRef, tuple(r.stops)) for r in plain.collect()) == Counter(
        (r.lineRef, r.directionRef, tuple(r.stops)) for r in split.collect())


def test_route_names_without_sorted_aggregates(tables):
    clean = tables.clean
    hot = hot_groups(clean, JOURNEY, 6)
    assert hot.hashes
    plain, split = routes.route_names(clean), routes.route_names(clean, hot)
    assert "SortAggregate" not in plan_of(plain)
    assert values(plain, *plain.columns) == values(split, *plain.columns)


