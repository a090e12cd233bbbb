"""Incremental batch: visits -> route names -> legs -> statistics -> serving tables."""

from __future__ import annotations

import functools
from collections.abc import Iterable
from datetime import date

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.leg_stats import (
    arrivals_stats_by_day,
    datasource_lines,
    datasources,
    leg_stats,
    lines_by_day,
    served_datasources,
    sources_by_day,
    stop_lines,
)
from ..operators.legs import LEG_INPUT, candidate_legs, with_direction
from ..operators.routes import canonical_direction, route_names
from ..operators.skew import bounded_broadcast, hot_groups
from ..operators.visits import clean_arrivals, stop_dimension
from ..schemas import JOURNEY, TABLES
from ..sources.shared import names_in
from ..sources.tables import (
    date_frame,
    dates,
    drop_partitions,
    mark,
    months_of,
    partition_values,
    read_days,
    read_table,
    remove,
    save_partitions,
    table_path,
    write_clustered,
    write_table,
)

LEG_ORDER = ["from_stop", "lineRef"]


def plan_days(
    spark: SparkSession, root: str, from_date: date | None = None, invalidate: bool = False
) -> DataFrame:
    """Days that have arrivals but no legs yet (all of them with ``invalidate``)."""
    days = set(partition_values(spark, root, "arrivals", "operatingDate"))
    if not invalidate:
        days -= set(partition_values(spark, root, "legs", "operatingDate"))
    return date_frame(spark, sorted(d for d in days if from_date is None or d >= from_date))


def pending_months(spark: SparkSession, root: str) -> list[date]:
    """Months that a run has changed the legs of and not yet the statistics."""
    return [date.fromisoformat(n) for n in names_in(spark, table_path(root, PENDING))]


def plan_months(
    spark: SparkSession,
    root: str,
    from_date: date | None = None,
    invalidate: bool = False,
    built: Iterable[date] = (),
) -> DataFrame:
    """Months to (re)compute: those without statistics, always the newest one, whose data is still growing,
    and the months of the days in ``built``, also late days of a month long done."""
    available = months_of(partition_values(spark, root, "legs", "operatingDate"))
    need = set(available)
    if not invalidate:
        need -= set(partition_values(spark, root, "leg_stats", "month"))
        need |= {*available[-1:], *months_of(built), *pending_months(spark, root)}
    first = from_date.replace(day=1) if from_date is not None else date.min
    # A month whose last day is gone stays on the list, so that its statistics go too.
    return date_frame(spark, sorted(m for m in need if m >= first or m in set(months_of(built))), "month")


def build_legs(spark: SparkSession, root: str, days: list[date]) -> None:
    """Route names and legs of ``days`` in one go, and the directions of other days that change by them.

    The cleaned visits feed both, so they are persisted (to disk if need be; lost blocks
    are computed again). The route names are written first: the canonical direction comes
    from the whole history including these days. Both tables are exchanged in one step each: readers see the old rows
    of a day until the new ones are there, days that yield no rows any more leave none behind, and a run
    that breaks off loses nothing (days whose legs it has not exchanged are planned again).
    """
    for name in DAY_TABLES:
        drop_partitions(spark, root, name, days)
    arrivals = read_days(spark, root, "arrivals", days)
    stopdata = stop_dimension(read_table(spark, root, "stops"), read_table(spark, root, "quays"))
    hot = hot_groups(arrivals, JOURNEY)
    clean = clean_arrivals(arrivals, stopdata, hot=hot).select(*LEG_INPUT)
    clean = clean.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        save_partitions(route_names(clean, hot), root, "route_name", replaced=days)
        canonical = canonical_direction(read_table(spark, root, "route_name")).where(
            F.col("operatingDate").isin(days)
        )
        legs = with_direction(candidate_legs(clean, hot), bounded_broadcast(canonical))
        save_partitions(legs, root, "legs", sort=LEG_ORDER, replaced=days)
    finally:
        clean.unpersist()
    repair_directions(spark, root, days)


ROUTE_KEY = ["dataSource", "lineRef", "origin", "destination"]
DIRECTIONS = "route_direction"


def repair_directions(spark: SparkSession, root: str, built: Iterable[date]) -> list[date]:
    """Carry changed directions of routes to the days written before; returns these days.

    A late day may be the first of a route and turn its direction. The directions that the legs carry are kept as
    a small table; routes whose direction differs from it name the days to mend, and the legs of just those days
    are exchanged with the new direction (nothing else in them depends on it). The table is renewed last, so a
    run that breaks off before is made up for by the next.
    """
    path = table_path(root, DIRECTIONS)
    kept = ready_versions(spark, path)
    names = canonical_direction(read_table(spark, root, "route_name"))
    now = names.select(*ROUTE_KEY, "direction").distinct()
    stale: list[date] = []
    if kept:
        then = spark.read.schema(TABLES[DIRECTIONS]).parquet(kept[-1]).withColumnRenamed("direction", "_then")
        same = functools.reduce(lambda a, b: a & b, [names[c].eqNullSafe(then[c]) for c in ROUTE_KEY])
        known = names.join(then, same)
        turned = known.where(F.col("direction") != F.col("_then")).select(names.operatingDate).distinct()
        skip = set(built)
        stale = sorted(r[0] for r in turned.collect() if r[0] not in skip)
    if stale:
        legs = read_days(spark, root, "legs", stale).drop("direction")
        canonical = names.where(F.col("operatingDate").isin(stale))
        save_partitions(with_direction(legs, bounded_broadcast(canonical)), root, "legs", sort=LEG_ORDER, replaced=stale)
    if stale or not kept or now.exceptAll(spark.read.schema(TABLES[DIRECTIONS]).parquet(kept[-1])).limit(1).count():
        write_ready(spark, now.select(*TABLES[DIRECTIONS].fieldNames()), path)
    return stale


#: Small tables by day, from which the lookup tables are made.
DAY_TABLES = ("source_day", "line_day")


def build_days(spark: SparkSession, root: str) -> None:
    """Bring the tables by day up to date; days already there are not read again."""
    for name, source in (("source_day", "arrivals"), ("line_day", "legs")):
        there = set(partition_values(spark, root, source, "operatingDate"))
        have = set(partition_values(spark, root, name, "operatingDate"))
        drop_partitions(spark, root, name, have - there)
        if there <= have:
            continue
        rows = read_days(spark, root, source, sorted(there - have))
        make = sources_by_day if name == "source_day" else lines_by_day
        save_partitions(make(rows), root, name)


def build_dimensions(spark: SparkSession, root: str) -> None:
    build_days(spark, root)
    write_table(datasources(read_table(spark, root, "source_day")), root, "datasources")
    write_table(stop_lines(read_table(spark, root, "line_day")), root, "stop_line")
    write_table(datasource_lines(read_table(spark, root, "stop_line")), root, "datasource_line")


def build_leg_stats(spark: SparkSession, root: str, months: list[date], tz: str = "UTC") -> None:
    """Statistics of ``months``, exchanged with their old ones in one step."""
    if not months:
        return
    days = [d for d in partition_values(spark, root, "legs", "operatingDate")
            if d.replace(day=1) in set(months)]
    if days:
        stats = leg_stats(read_days(spark, root, "legs", days), tz=tz)
        save_partitions(stats, root, "leg_stats", replaced=months)
    else:
        drop_partitions(spark, root, "leg_stats", months)


SERVING = "serving"
READY = "_READY"


def ready_versions(spark: SparkSession, path: str) -> list[str]:
    """Complete folders below ``path``, the newest last."""
    return [f"{path}/{v}" for v in names_in(spark, path) if READY in names_in(spark, f"{path}/{v}")]


def next_version(spark: SparkSession, path: str) -> str:
    """An empty folder after the newest complete one."""
    before = ready_versions(spark, path)
    out = f"{path}/v{int(before[-1].rpartition('v')[2]) + 1 if before else 1:08d}"
    remove(spark, out)
    return out


def write_ready(spark: SparkSession, df: DataFrame, path: str) -> None:
    """``df`` as the newest complete folder below ``path``; the one before stays."""
    before, out = ready_versions(spark, path), next_version(spark, path)
    df.write.parquet(out)
    mark(spark, f"{out}/{READY}")
    for old in before[:-1]:
        remove(spark, old)


def serving_versions(spark: SparkSession, root: str) -> list[str]:
    """Folders of complete publications, the newest last."""
    return ready_versions(spark, table_path(root, SERVING))


def serving_root(spark: SparkSession, root: str) -> str:
    """Where the newest complete set of serving tables lies."""
    found = serving_versions(spark, root)
    if not found:
        raise FileNotFoundError(f"nothing has been published under {root}")
    return found[-1]


def publish(spark: SparkSession, root: str) -> str:
    """Write the small tables that queries read, the statistics clustered by month, hour
    and source so that a query for one of them skips the rest.

    They go into a folder of their own, which counts once its mark is made, the last step. Readers see one
    publication or the other, never a mixture; the one before stays for those still reading it.
    """
    before, out = serving_versions(spark, root), next_version(spark, table_path(root, SERVING))
    stats = read_table(spark, root, "leg_stats")
    write_clustered(
        stats, table_path(out, "leg_stats"), ["month", "hour", "dataSource"], ["from_stop", "to_stop"]
    )
    write_table(served_datasources(read_table(spark, root, "datasources"), stats), out, "datasources")
    write_table(read_table(spark, root, "datasource_line"), out, "datasource_line")
    write_table(read_table(spark, root, "stop_line"), out, "stop_line")
    write_table(arrivals_stats_by_day(read_table(spark, root, "source_day")), out, "arrivals_stats")
    mark(spark, f"{out}/{READY}")
    for old in before[:-1]:
        remove(spark, old)
    return out


UNPUBLISHED = "_unpublished"
#: Months whose legs have changed since their statistics were made, one empty folder each.
PENDING = "_pending_months"


def run(
    spark: SparkSession,
    root: str,
    from_date: date | None = None,
    invalidate: bool = False,
    batch_days: int | None = 31,
    tz: str = "UTC",
) -> dict[str, list[date]]:
    """Bring every derived table up to date; returns the days and months worked on.

    Days that come late are built like any others, and the statistics of their months again.
    With no new day and nothing left over from a run that broke off, only folders are
    listed. ``batch_days`` bounds how many days are held at once in a long back-fill (None: all).
    """
    days = dates(plan_days(spark, root, from_date, invalidate))
    note = table_path(root, UNPUBLISHED)
    if days:
        mark(spark, note)
        for month in months_of(days):
            mark(spark, f"{table_path(root, PENDING)}/{month.isoformat()}")
    size = batch_days or max(len(days), 1)
    for i in range(0, len(days), size):
        build_legs(spark, root, days[i : i + size])
    months = dates(plan_months(spark, root, from_date, invalidate, days))
    if not days and not invalidate:
        done = set(partition_values(spark, root, "leg_stats", "month"))
        months = [m for m in months if m not in done or m in pending_months(spark, root)]
        left_over = UNPUBLISHED in names_in(spark, root) or not serving_versions(spark, root)
        if not months and not left_over:
            return {"days": [], "months": []}
    mark(spark, note)
    if not days:
        repair_directions(spark, root, [])
    build_dimensions(spark, root)
    build_leg_stats(spark, root, months, tz)
    for month in months:
        remove(spark, f"{table_path(root, PENDING)}/{month.isoformat()}")
    publish(spark, root)
    remove(spark, note)
    return {"days": days, "months": months}
