"""Parquet tables under one root folder: reading, writing, partition lists."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import PARTITIONED_BY, TABLES, VERSIONED
from . import versions
from .shared import folder_at, names_in


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def _missing(error: AnalysisException) -> bool:
    return (error.getCondition() or "").startswith("PATH_NOT_FOUND")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A known table with its declared schema (no footer inference, partitions typed). Where the table has
    manifests, the partitions of the newest one."""
    path = table_path(root, name)
    held = versions.current(spark, path) if name in VERSIONED else None
    if held is not None:
        return versions.read(spark, path, TABLES[name], PARTITIONED_BY[name], held)
    return spark.read.schema(TABLES[name]).parquet(path)


def read_days(spark: SparkSession, root: str, name: str, days: Sequence[date]) -> DataFrame:
    """Only the given daily partitions; the list prunes at planning time."""
    path, wanted = table_path(root, name), {d.isoformat() for d in days}
    held = versions.current(spark, path) if name in VERSIONED else None
    if held is None:
        rows = read_table(spark, root, name)
    else:
        held = {v: n for v, n in held.items() if v in wanted}
        rows = versions.read(spark, path, TABLES[name], PARTITIONED_BY[name], held)
    return rows.where(F.col("operatingDate").isin(list(days)))


def read_if_present(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    try:
        return read_table(spark, root, name)
    except AnalysisException as error:
        if _missing(error):
            return None
        raise


def partition_values(spark: SparkSession, root: str, name: str, by: str) -> list[date]:
    """Partitions of a table by the names of its folders, or by its newest manifest: no data file is opened."""
    path = table_path(root, name)
    held = versions.current(spark, path) if name in VERSIONED else None
    if held is not None:
        return sorted(date.fromisoformat(v) for v in held)
    return sorted(
        date.fromisoformat(n.partition("=")[2])
        for n in names_in(spark, path)
        if n.startswith(f"{by}=") and not n.endswith("__HIVE_DEFAULT_PARTITION__")
    )


def drop_partitions(spark: SparkSession, root: str, name: str, values: Iterable[date]) -> None:
    """Remove whole partitions, those that are there."""
    path = table_path(root, name)
    if name in VERSIONED and versions.current(spark, path) is not None:
        number, _ = versions.staging(spark, path)
        versions.exchange(spark, path, PARTITIONED_BY[name], number, values)
        return
    for value in values:
        remove(spark, f"{path}/{PARTITIONED_BY[name]}={value.isoformat()}")


def mark(spark: SparkSession, path: str) -> None:
    """An empty folder as a note; making it is one step of the file system."""
    system, where = folder_at(spark, path)
    system.mkdirs(where)


def remove(spark: SparkSession, path: str) -> None:
    system, where = folder_at(spark, path)
    system.delete(where, True)


def daily_partitions(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The days of a table (column ``day``); none if the table does not exist."""
    return date_frame(spark, partition_values(spark, root, name, "operatingDate"))


def months_of(days: Iterable[date]) -> list[date]:
    return sorted({d.replace(day=1) for d in days})


def monthly_partitions(
    spark: SparkSession, root: str, name: str, truncate: bool = True
) -> DataFrame:
    """The months of a table; ``truncate`` takes them from its days."""
    if truncate:
        months = months_of(partition_values(spark, root, name, "operatingDate"))
    else:
        months = partition_values(spark, root, name, "month")
    return date_frame(spark, months, "month")


def write_partitions(
    df: DataFrame, path: str, by: str, sort: Sequence[str] = ()
) -> None:
    """Overwrite just the partitions that occur in ``df``.

    The rebalance hint gathers each partition's rows into few files, while adaptive
    execution still splits a partition that is much larger than the rest.
    """
    out = df.hint("rebalance", F.col(by))
    if sort:
        out = out.sortWithinPartitions(by, *sort)
    (
        out.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(by)
        .parquet(path)
    )


def save_partitions(
    df: DataFrame, root: str, name: str, sort: Sequence[str] = (), replaced: Iterable[date] = ()
) -> None:
    """Write the partitions of ``df`` in place of their old ones. Tables in VERSIONED change in one step (see
    ``versions``), in which those of ``replaced`` that have no rows any more go too."""
    rows, path, by = df.select(*TABLES[name].fieldNames()), table_path(root, name), PARTITIONED_BY[name]
    if name not in VERSIONED:
        write_partitions(rows, path, by, sort)
        return
    spark = df.sparkSession
    number, folder = versions.staging(spark, path)
    write_partitions(rows, folder, by, sort)
    versions.exchange(spark, path, by, number, replaced)


def write_table(df: DataFrame, root: str, name: str) -> None:
    df.select(*TABLES[name].fieldNames()).write.mode("overwrite").parquet(table_path(root, name))


def write_sorted(df: DataFrame, path: str, cols: Sequence[str]) -> None:
    """Globally sorted files: range partitions written in order."""
    df.orderBy(*cols).write.mode("overwrite").parquet(path)


def write_clustered(
    df: DataFrame, path: str, cols: Sequence[str], spread: Sequence[str] = (), files: int | None = None
) -> None:
    """Files clustered by ``cols``, so that readers skip row groups by their min/max. The
    ``spread`` columns only break up values of ``cols`` that fill more than one file. ``files`` fixes the number of
    files at most; by default adaptive execution sizes them."""
    count = () if files is None else (files,)
    df.repartitionByRange(*count, *cols, *spread).sortWithinPartitions(*cols, *spread).write.mode(
        "overwrite"
    ).parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ";", tz: str = "UTC") -> None:
    """Timestamps are printed in ``tz``, whatever the session's zone."""
    df.write.mode("overwrite").option("timeZone", tz).csv(path, header=True, sep=sep)


def ensure_table(spark: SparkSession, path: str, builder: Callable[[], DataFrame]) -> DataFrame:
    """Read the table at ``path``; build and write it first if there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if not _missing(error):
            raise
    builder().write.parquet(path)
    return spark.read.parquet(path)


def append_by_position(df: DataFrame, spark: SparkSession, path: str) -> None:
    target = spark.read.parquet(path).schema
    named = df.toDF(*target.fieldNames())
    named.select(*[F.col(f.name).cast(f.dataType) for f in target]).write.mode("append").parquet(path)


def append_by_name(df: DataFrame, spark: SparkSession, path: str) -> None:
    """Columns are matched by name; those ``df`` lacks become NULL."""
    target = spark.read.parquet(path).schema
    have = set(df.columns)
    df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in target
    ]).write.mode("append").parquet(path)


def describe(df: DataFrame) -> DataFrame:
    """Columns of a table with their types and how many rows hold a value, in one scan."""
    counts = df.agg(*[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(df.columns)])
    rows = [
        F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("col_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"), F.col(f"n{i}").alias("filled"),
        )
        for i, f in enumerate(df.schema)
    ]
    return counts.select(F.inline(F.array(*rows)))


def dates(frame: DataFrame) -> list[date]:
    """A partition list on the driver: one entry per day or month of the data."""
    return sorted(r[0] for r in frame.collect() if r[0] is not None)


def date_frame(spark: SparkSession, days: Iterable[date], name: str = "day") -> DataFrame:
    return spark.createDataFrame([(d,) for d in days], f"{name} date")
