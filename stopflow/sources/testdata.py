"""Projection of the order-line test tables onto the transit schemas (see FIXTURES.md)."""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.directions import route_name_ranked
from ..operators.journeys import selected_journeys
from ..operators.leg_stats import leg_stats, stop_lines
from ..operators.leg_study import legs_by_selfjoin, legs_with_distance, pair_distances
from ..operators.legs import LEG_INPUT, legs
from ..operators.routes import canonical_direction, route_names
from ..operators.skew import hot_groups, with_positions
from ..operators.visits import clean_arrivals, stop_dimension
from ..schemas import ARRIVALS, ARRIVALS_EXTRA, JOURNEY, QUAYS, STOPS

DAY = 86_400
FIRST_DAY = 19_723  # 2024-01-01 as days since the epoch


def arrivals(lineitem: DataFrame) -> DataFrame:
    """One stop visit per order line; an order is a journey."""
    key, part = F.col("l_orderkey"), F.col("l_partkey")
    line = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    base = with_positions(lineitem.select("l_orderkey", *line), ["l_orderkey"], line).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity",
        F.col("position").alias("seq"), F.col("group_size").alias("cnt"),
    )
    g = F.expr("l_orderkey div 60")
    even = lambda x: F.pmod(x, F.lit(2)) == 0
    day = F.lit(FIRST_DAY) + F.pmod(key, F.lit(60))
    aim = day * DAY + (7 + F.pmod(g, F.lit(2))) * 3600 + 300 * (F.col("seq") - 1)
    # Some stops are planned at the time of the stop before.
    aim = aim - F.when((F.col("seq") > 1) & (part % 16 == 3), 300).otherwise(0)
    late = 6 * F.col("l_quantity").cast("bigint") - 60 + F.when(part % 500 == 2, 8000).otherwise(0)
    k, p = F.col("l_suppkey") % 5, F.expr("(l_suppkey div 5) % 2")
    base = base.select(
        "*", g.alias("g"), day.alias("day"), aim.alias("aim"), (aim + late).alias("act"),
        k.alias("k"), p.alias("p"),
        F.when(key % 20 == 0, "SOF").when(key % 20 == 10, "BBB").otherwise("AAA").alias("src"),
    )
    ts = F.timestamp_seconds
    first, last = F.col("seq") == 1, F.col("seq") == F.col("cnt")
    journey = F.concat("src", F.lit(":ServiceJourney:"), key)
    named = key % 3 == 0
    date = F.date_from_unix_date(F.col("day").cast("int"))
    columns = {
        "recordedAtTime": ts(F.col("act") + 30),
        "lineRef": F.concat(
            "src", F.lit(":Line:"),
            F.when(F.col("g") % 7 == 6, "Express").otherwise(F.concat(F.lit("2_"), F.col("g") % 7)),
        ),
        "directionRef": F.when(
            even(F.col("g")) != (F.col("day") >= FIRST_DAY + 31), "Inbound"
        ).otherwise("Outbound"),
        "operatingDate": date,
        "serviceJourneyId": journey,
        "operatorRef": F.col("src"),
        "extraJourney": F.lit(False),
        "journeyCancellation": (key % 97 == 0) & (F.col("seq") >= 4),
        "stopPointRef": F.when(part % 200 == 1, "NSR:Quay:missing")
        .when(part % 10 == 0, F.concat(F.lit("NSR:StopPlace:"), F.col("k")))
        .otherwise(F.concat(F.lit("NSR:Quay:"), F.col("k"), F.lit("_"), F.col("p"))),
        "sequenceNr": F.col("seq"),
        "originName": F.when(named, "Stop 0"),
        "destinationName": F.when(named, "Stop 4"),
        "extraCall": key % 83 == 0,
        "stopCancellation": ((key % 61 == 5) & (F.col("seq") == 2))
        | ((key % 89 == 7) & F.col("seq").isin(2, 3, 5)),
        "aimedArrivalTime": F.when(~first, ts("aim")),
        "arrivalTime": F.when(~first, ts("act")),
        "aimedDepartureTime": F.when(~last, ts(F.col("aim") + 30)),
        "departureTime": F.when(~last, ts(F.col("act") + 30)),
        "dataSource": F.col("src"),
        "dataSourceName": F.concat(F.lit("Operator "), F.col("src")),
        "estimated": (key % 50 == 7) & (F.col("seq") >= 3),
        "vehicleMode": F.when(key % 4 == 0, "bus"),
        "stopPointName": F.concat(F.lit("Stop "), F.col("k")),
        "datedServiceJourneyId": F.concat(date.cast("string"), F.lit(":"), journey),
    }
    fields = [*ARRIVALS.fields, *ARRIVALS_EXTRA.fields]
    return base.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in fields])


def _filled(df: DataFrame, schema) -> DataFrame:
    """Select the schema's columns; those ``df`` lacks become NULL."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def stops(supplier: DataFrame) -> DataFrame:
    k = supplier.select((F.col("s_suppkey") % 5).alias("k")).distinct()
    return _filled(k.select(
        F.concat(F.lit("NSR:StopPlace:"), "k").alias("id"),
        F.concat(F.lit("Stop "), "k").alias("name"),
        F.when(F.col("k") != 3, 63.40 + 0.010 * F.col("k")).alias("location_latitude"),
        F.when(F.col("k") != 3, 10.35 + 0.013 * F.col("k")).alias("location_longitude"),
    ), STOPS)


def quays(supplier: DataFrame) -> DataFrame:
    kp = supplier.select(
        (F.col("s_suppkey") % 5).alias("k"), F.expr("(s_suppkey div 5) % 2").alias("p")
    ).distinct()
    return _filled(kp.select(
        F.concat(F.lit("NSR:Quay:"), "k", F.lit("_"), "p").alias("id"),
        F.concat(F.lit("NSR:StopPlace:"), "k").alias("stopPlaceRef"),
        F.concat(F.lit("Quay "), "k").alias("name"),
        (63.4001 + 0.010 * F.col("k")).alias("location_latitude"),
        (10.3501 + 0.013 * F.col("k")).alias("location_longitude"),
    ), QUAYS)


class Projected:
    """The tables of one test-data folder and everything derived from them, lazily.

    What the batch writes as tables is persisted here instead (spilling to disk), so that
    queries which share it do not compute it again.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    @staticmethod
    def _kept(df: DataFrame) -> DataFrame:
        return df.persist(StorageLevel.MEMORY_AND_DISK)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def arrivals(self) -> DataFrame:
        return arrivals(self.read("lineitem"))

    @cached_property
    def stops(self) -> DataFrame:
        return stops(self.read("supplier"))

    @cached_property
    def quays(self) -> DataFrame:
        return quays(self.read("supplier"))

    @cached_property
    def hot(self):
        return hot_groups(self.arrivals, JOURNEY)

    @cached_property
    def stopdata(self) -> DataFrame:
        return stop_dimension(self.stops, self.quays)

    @cached_property
    def clean(self) -> DataFrame:
        return clean_arrivals(self.arrivals, self.stopdata, hot=self.hot)

    @cached_property
    def visits(self) -> DataFrame:
        """What the batch keeps of the cleaned visits."""
        return self._kept(self.clean.select(*LEG_INPUT))

    @cached_property
    def route_names(self) -> DataFrame:
        return route_names(self.visits)

    @cached_property
    def canonical(self) -> DataFrame:
        return canonical_direction(self.route_names)

    @cached_property
    def legs(self) -> DataFrame:
        return self._kept(legs(self.visits, self.canonical, hot=self.hot))

    @cached_property
    def leg_stats(self) -> DataFrame:
        return self._kept(leg_stats(self.legs))

    @cached_property
    def stop_line(self) -> DataFrame:
        return stop_lines(self.legs)

    @cached_property
    def study(self) -> DataFrame:
        return self._kept(legs_by_selfjoin(self.arrivals))

    @cached_property
    def distances(self) -> DataFrame:
        return pair_distances(self.study, self.quays)

    @cached_property
    def far_study(self) -> DataFrame:
        return legs_with_distance(self.study, self.distances)

    @cached_property
    def selected(self) -> DataFrame:
        return selected_journeys(self.arrivals)

    @cached_property
    def ranked(self) -> DataFrame:
        return route_name_ranked(self.legs)
