"""Time the headline queries; prints one JSON line.

Raw visits and dimensions are first written as day-partitioned Parquet (not timed), as the
batch would find them. Each query then runs from those files, or from the tables the batch
made of them, once to warm up and then REPEATS times; the best time counts.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stopflow.operators import delays, journeys, leg_study, serving  # noqa: E402
from stopflow.operators.leg_stats import leg_stats  # noqa: E402
from stopflow.plans import etl  # noqa: E402
from stopflow.sources.tables import daily_partitions, dates, read_table  # noqa: E402
from stopflow.sources.testdata import Projected  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = 2


def sink(df: DataFrame) -> None:
    """Compute every row and column without keeping them."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("stopflow-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    source = Projected(spark, SF_DIR)
    root = tempfile.mkdtemp(prefix="stopflow-bench-")
    raw = f"{root}/raw_arrivals"
    source.arrivals.write.parquet(raw)
    for name, df in (("stops", source.stops), ("quays", source.quays)):
        df.write.parquet(f"{root}/{name}")
    visits = spark.read.parquet(raw)
    visits.select(*source.arrivals.columns).repartition(F.col("operatingDate")).write.partitionBy(
        "operatingDate"
    ).parquet(f"{root}/arrivals")

    days = dates(daily_partitions(spark, root, "arrivals"))
    quays = read_table(spark, root, "quays")
    feb, jan = date(2024, 2, 1), date(2024, 1, 1)
    legs_path = f"{root}/study"

    def batch() -> None:
        etl.build_legs(spark, root, days)

    def table(name: str) -> DataFrame:
        return read_table(spark, root, name)

    def served(name: str) -> DataFrame:
        return read_table(spark, etl.serving_root(spark, root), name)

    def study() -> DataFrame:
        return spark.read.parquet(legs_path)

    def distances() -> DataFrame:
        return spark.read.parquet(f"{root}/distances")

    runs = {
        "batch_visits_to_legs": batch,
        "leg_stats": lambda: sink(leg_stats(table("legs"))),
        "dimensions_and_publish": lambda: (
            etl.build_dimensions(spark, root),
            etl.build_leg_stats(spark, root, [jan, feb]),
            etl.publish(spark, root),
        ),
        "run_without_news": lambda: etl.run(spark, root),
        "hot_spots": lambda: serving.hot_spots(served("leg_stats"), feb, 7).collect(),
        "leg_view": lambda: serving.leg_view(
            served("leg_stats"), served("stop_line"), feb, 7, "AAA").collect(),
        "comparisons": lambda: serving.comparisons(
            served("leg_stats"), served("stop_line"), jan, feb, 7).collect(),
        "count_by_source": lambda: delays.count_by(visits, "dataSource").collect(),
        "count_by_hour": lambda: delays.count_by(
            visits, delays.local_hour(F.col("recordedAtTime")), "hour").collect(),
        "busiest_stops": lambda: delays.busiest_stops(visits).collect(),
        "lead_gap_stats": lambda: delays.lead_gap_stats(visits).collect(),
        "successor_self_join": lambda: leg_study.legs_by_selfjoin(visits)
        .write.mode("overwrite").parquet(legs_path),
        "pair_distances": lambda: leg_study.pair_distances(study(), quays)
        .write.mode("overwrite").parquet(f"{root}/distances"),
        "legs_with_distance": lambda: sink(leg_study.legs_with_distance(study(), distances())),
        "worst_legs": lambda: leg_study.worst_legs(study(), 100).collect(),
        "rush_factor": lambda: sink(leg_study.rush_factor(leg_study.legs_with_distance(study(), distances()))),
        "delay_quantiles": lambda: sink(journeys.delay_quantiles(visits)),
        "stop_order": lambda: sink(journeys.stop_order(visits)),
    }
    took: dict[str, float] = {}
    for name, run in runs.items():
        run()
        best = None
        for _ in range(REPEATS):
            started = time.perf_counter()
            run()
            spent = time.perf_counter() - started
            best = spent if best is None else min(best, spent)
        took[name] = round(best, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "rows": visits.count(),
        "sf": os.path.basename(SF_DIR.rstrip("/")),
        "cpus": int(CPUS),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
