"""What the corpus operators share: input tables, shared scratch tables, digests."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: A word is a run of anything but these six characters (fixed by the contracts).
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under ``spark.checkpoint.dir``. Local sessions without that setting
    (tests) use the warehouse; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{root.rstrip('/')}/stopflow-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, with a cut lineage, and safe
    when executors are lost."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of ``text`` as an array, without empty ones."""
    return F.filter(F.split(text, WHITE_CLASS + "+"), lambda w: w != "")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_table(spark: SparkSession, rows: Sequence[Sequence], columns: str) -> DataFrame:
    """A table of a few rows that the driver holds (rules, settings), as a literal of the
    plan. ``columns`` is a schema string; values are JSON values."""
    names = [part.split()[0] for part in columns.split(",")]
    text = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    parsed = F.from_json(F.lit(text), f"array<struct<{columns.replace(' ', ':').replace(',:', ', ')}>>")
    return spark.range(1, numPartitions=1).select(F.inline(parsed))


def text_digest(column: str = "text") -> Column:
    return F.unhex(F.sha2(text_of(column).cast("binary"), 256))


def keep_rows(
    docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` listed in ``kept(id, digest)``, with all their columns. Rows come back by
    (id, text digest), which different documents do not share; of repeated rows one is taken."""
    listed = kept.select(F.col("id").alias("_keep_id"), F.col("digest").alias("_keep_digest"))
    marked = docs.select(
        F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"),
        F.col(f"`{id_col}`").alias("_id"), text_digest(f"`{text_col}`").alias("_digest"),
    )
    same = (F.col("_digest") == F.col("_keep_digest")) & F.col("_id").eqNullSafe(F.col("_keep_id"))
    once = Window.partitionBy("_digest", "_id").orderBy("_digest")
    return (
        marked.join(listed, same, "left_semi")
        .withColumn("_once", F.row_number().over(once))
        .filter("_once = 1")
        .select("_row.*")
    )
