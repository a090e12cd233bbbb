"""Hot groups must give the same results as ordinary ones."""

import random

from pyspark.sql import functions as F

from stopflow.operators import skew
from stopflow.operators.delays import lead_gap_stats
from stopflow.operators.legs import candidate_legs
from stopflow.operators.skew import HotGroups, first_rows, hot_groups, split_hot, with_neighbours, with_positions
from stopflow.operators.visits import clean_arrivals
from stopflow.schemas import JOURNEY

from .cases import values


def numbered(spark, n=400, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = rnd.choice(["hot", "hot", "hot", None, f"k{rnd.randrange(20)}"])
        nr = rnd.choice([None, rnd.randrange(40)])
        rows.append((key, nr, i, rnd.choice([None, rnd.random()])))
    return spark.createDataFrame(rows, "k string, nr bigint, tie bigint, v double")


def test_neighbours_of_hot_and_cold_groups_match(spark):
    df = numbered(spark)
    hot = hot_groups(df, ["k"], min_rows=50)
    assert len(hot.hashes) == 2  # "hot" and NULL
    args = dict(keys=["k"], order=["nr", "tie"], prev=["v", "tie"], next=["v", "tie"])
    plain = with_neighbours(df, hot=skew.NO_HOT, **args)
    split = with_neighbours(df, hot=hot, chunk_rows=20, **args)
    assert split.columns == plain.columns
    assert values(plain, *plain.columns) == values(split, *plain.columns)


def test_neighbours_against_plain_python(spark):
    df = numbered(spark, 120, 5)
    groups = {}
    for r in df.collect():
        groups.setdefault(r.k, []).append(r)
    want = []
    for rows in groups.values():
        rows.sort(key=lambda r: (r.nr is None, r.nr or 0, r.tie))
        for i, r in enumerate(rows):
            want.append((r.tie, rows[i - 1].tie if i else None, rows[i + 1].tie if i + 1 < len(rows) else None))
    hot = hot_groups(df, ["k"], min_rows=1)
    got = with_neighbours(df, ["k"], ["nr", "tie"], ["tie"], ["tie"], hot=hot, chunk_rows=10)
    assert values(got, "tie", "prev_tie", "next_tie") == sorted(want, key=repr)


def test_positions_of_hot_and_cold_groups_match(spark):
    df = numbered(spark)
    hot = hot_groups(df, ["k"], min_rows=50)
    plain = with_positions(df, ["k"], ["nr", "tie"], hot=skew.NO_HOT)
    split = with_positions(df, ["k"], ["nr", "tie"], hot=hot, chunk_rows=20)
    assert split.dtypes == plain.dtypes
    assert values(split, *plain.columns) == values(plain, *plain.columns)


def test_one_order_value_for_a_whole_group(spark):
    df = spark.range(200).select(F.lit("k").alias("k"), F.lit(1).alias("nr"), "id")
    hot = hot_groups(df, ["k"], min_rows=1)
    out = with_neighbours(df, ["k"], ["nr"], ["id"], hot=hot, chunk_rows=20)
    seen = [r.prev_id for r in out.collect()]
    assert len(seen) == 200 and seen.count(None) == 1
    assert len({p for p in seen if p is not None}) == 199  # each row precedes one other


def test_cleaning_and_legs_by_chunks_match_windows_on_data(tables):
    a, s = tables.arrivals, tables.stopdata
    hot = hot_groups(a, JOURNEY, min_rows=5)  # part of the journeys
    assert 0 < len(hot.hashes) < a.select(*JOURNEY).distinct().count()
    chunked = clean_arrivals(a, s, hot=hot, chunk_rows=300)
    cols = tables.clean.columns
    assert values(chunked, *cols) == values(tables.clean, *cols)
    mine = candidate_legs(chunked, hot, chunk_rows=300)
    plain = candidate_legs(tables.clean, skew.NO_HOT)
    assert values(mine, *plain.columns) == values(plain, *plain.columns)


def test_lead_gaps_by_chunks(tables):
    hot = hot_groups(tables.arrivals, ["datedServiceJourneyId"], min_rows=6)
    assert hot
    assert lead_gap_stats(tables.arrivals, hot).first() == lead_gap_stats(tables.arrivals, skew.NO_HOT).first()


def test_small_tables_have_no_hot_groups(spark):
    assert not hot_groups(spark.range(100), ["id"])


def test_split_is_a_partition_of_the_rows(spark):
    df = numbered(spark)
    hot = hot_groups(df, ["k"], min_rows=50)
    cold, big = split_hot(df, ["k"], hot)
    assert cold.count() + big.count() == df.count()
    assert {r.k for r in big.select("k").distinct().collect()} == {"hot", None}
    assert split_hot(df, ["k"], HotGroups())[1] is None


def test_bounded_broadcast_checks_the_size(spark):
    small, large = spark.range(5), spark.range(50)
    joined = lambda side: spark.range(100).join(skew.bounded_broadcast(side, 10), "id")
    hint = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hint(joined(small)) and not hint(joined(large))


def test_first_rows_limits_each_task_before_the_shuffle(spark):
    df = numbered(spark).where("k is not null")
    out = first_rows(df, ["k"], [F.asc("tie")])
    want = df.groupBy("k").agg(F.min("tie"))
    assert values(out, "k", "tie") == values(want, *want.columns)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # partial and final
