"""Taking source data into the table root, a day or a page of days at a time."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..schemas import TABLES
from .tables import daily_partitions, dates, save_partitions, write_table


def date_range(spark: SparkSession, start: date, end: date) -> DataFrame:
    """The days from ``start`` up to but without ``end``."""
    if end <= start:
        return spark.createDataFrame([], "day date")
    bounds = spark.createDataFrame([(start, end)], "s date, e date")
    return bounds.select(F.explode(F.sequence("s", F.date_sub("e", 1))).alias("day"))


def missing_days(
    spark: SparkSession, root: str, name: str, start: date, end: date
) -> DataFrame:
    return date_range(spark, start, end).join(daily_partitions(spark, root, name), "day", "left_anti")


def _instant(column: Column, source_tz: str) -> Column:
    """The instant of a timestamp without a zone, read in ``source_tz``. Counted from a fixed
    moment, because a cast would use the session's zone."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), column)
    return F.to_utc_timestamp(F.timestamp_micros(micros), source_tz)


def conform(source: DataFrame, name: str, source_tz: str = "UTC") -> DataFrame:
    """Select a table's fixed columns, cast to its types. Timestamps without a zone are taken to
    be in ``source_tz``; the session's zone plays no part."""
    kinds = dict(source.dtypes)

    def cast(f: T.StructField) -> Column:
        column = F.col(f.name)
        if kinds.get(f.name) == "timestamp_ntz" and isinstance(f.dataType, T.TimestampType):
            column = _instant(column, source_tz)
        return column.cast(f.dataType).alias(f.name)

    return source.select(*[cast(f) for f in TABLES[name]])


def ingest_days(
    source: DataFrame, root: str, start: date, end: date, source_tz: str = "UTC"
) -> list[date]:
    """Add the days of [start, end) that are not there yet; returns the days looked for."""
    spark = source.sparkSession
    need = dates(missing_days(spark, root, "arrivals", start, end))
    if need:
        rows = conform(source, "arrivals", source_tz).where(F.col("operatingDate").isin(need))
        save_partitions(rows, root, "arrivals")
    return need


def ingest_dim(source: DataFrame, root: str, name: str, source_tz: str = "UTC") -> None:
    """Replace a dimension (``stops`` or ``quays``) by its current snapshot."""
    write_table(conform(source, name, source_tz), root, name)


def page_ranges(source: DataFrame, days: int = 30) -> DataFrame:
    """Half-open ranges of ``days`` days that cover every operating date of the source."""
    span = source.agg(F.min("operatingDate").alias("lo"), F.max("operatingDate").alias("hi"))
    step = F.make_dt_interval(F.lit(int(days)))
    return span.where("lo IS NOT NULL").select(
        F.explode(F.sequence("lo", "hi", step)).alias("start")
    ).select("start", F.date_add("start", days).alias("end"))


def ingest_paged(source: DataFrame, root: str, days: int = 30, source_tz: str = "UTC") -> int:
    """Take in everything, one page per write; repeating a page changes nothing."""
    pages = page_ranges(source, days).orderBy("start").collect()  # one row per page
    for page in pages:
        in_page = (F.col("operatingDate") >= F.lit(page.start)) & (F.col("operatingDate") < F.lit(page.end))
        save_partitions(conform(source, "arrivals", source_tz).where(in_page), root, "arrivals")
    return len(pages)


