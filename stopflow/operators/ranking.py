"""Positions of rows in an order, without a window over the whole table.

A global sort leaves its rows in ranges: partitions in order, rows in order inside. So a row's position is the number
of rows in the partitions (or files) before its own, plus its place there; only one count for each partition or file
meets on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .skew import use_checkpoint_dir

#: ``monotonically_increasing_id`` is partition << 33 | row.
ROW_BITS = 33


def _placed(rows: DataFrame, part: str, place: str, keep: list[str], name: str) -> DataFrame:
    """``keep`` and the position of each row from its ``part`` (in ascending order) and its ``place`` in it (from 0)."""
    sizes = sorted((r[0], r[1]) for r in rows.groupBy(part).count().collect())
    before, listed = 0, []
    for value, n in sizes:
        listed.append((value, before))
        before += n
    kind = rows.schema[part].dataType.simpleString()
    offsets = F.broadcast(rows.sparkSession.createDataFrame(listed, f"`{part}` {kind}, _before bigint"))
    return rows.join(offsets, part).select(*keep, (F.col("_before") + F.col(place) + 1).alias(name))


def with_position(df: DataFrame, name: str = "position") -> DataFrame:
    """Add the place (from 1) at which ``df`` delivers each row, as its own sorting left them. Checkpointed, so that
    places and rows belong together."""
    use_checkpoint_dir(df.sparkSession)
    held = df.withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    rows = held.withColumn("_part", F.shiftright("_id", ROW_BITS)).withColumn(
        "_place", F.col("_id").bitwiseAND((1 << ROW_BITS) - 1)
    )
    return _placed(rows, "_part", "_place", df.columns, name)


def stored_positions(spark: SparkSession, path: str, name: str = "position") -> DataFrame:
    """Rows of Parquet files with the place at which a reader that goes through the files by name meets them."""
    stored = spark.read.parquet(path)
    rows = stored.select("*", F.col("_metadata.file_name").alias("_part"), F.col("_metadata.row_index").alias("_place"))
    return _placed(rows, "_part", "_place", stored.columns, name)


def file_ranges(spark: SparkSession, path: str, cols: list[str]) -> DataFrame:
    """One row for each file of a table: ``file``, ``rows``, ``least`` and ``most`` (structs of ``cols``), and ``overlaps``,
    whether it begins before a file with a smaller least value has ended. Values of two files that share only their
    border do not overlap."""
    key = F.struct(*cols)
    files = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(key).alias("least"), F.max(key).alias("most")
    )
    # One row for each file, hence small.
    earlier = Window.orderBy("least", "most", "file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("overlaps", F.coalesce(F.max("most").over(earlier) > F.col("least"), F.lit(False)))


def may_hold(**values: Column) -> Column:
    """Whether a file of :func:`file_ranges` may hold a row with these values of its columns."""
    wanted = F.struct(*[v.alias(n) for n, v in values.items()])
    return (F.col("least") <= wanted) & (F.col("most") >= wanted)
