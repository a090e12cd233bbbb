"""Partitioned tables whose partitions are exchanged in one step.

    table/version=00000007/operatingDate=2024-01-01/part-...    partitions as some run staged them
    table/_manifest/00000007                                     which version holds each partition

A run stages all partitions it makes in a version of its own and then writes the next manifest, one file that
appears at once. Readers take the newest manifest: they see all of an exchange or nothing of it, and never a
partition that is missing while it is made again. A run that breaks off leaves a version that no manifest names; the
next exchange removes it. What the newest two manifests name stays, for those who are still reading. One writer
at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .shared import folder_at, names_in

MANIFESTS = "_manifest"
KEPT = 2


def _folder_name(version: int) -> str:
    return f"version={version:08d}"


def _numbers(spark: SparkSession, table: str) -> list[int]:
    return sorted(int(n) for n in names_in(spark, f"{table}/{MANIFESTS}") if n.isdigit())


def _read(spark: SparkSession, table: str, number: int) -> dict[str, int]:
    system, where = folder_at(spark, f"{table}/{MANIFESTS}/{number:08d}")
    stream = system.open(where)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def current(spark: SparkSession, table: str) -> dict[str, int] | None:
    """Partition value -> version by the newest manifest; None if the table has none."""
    numbers = _numbers(spark, table)
    return _read(spark, table, numbers[-1]) if numbers else None


def staging(spark: SparkSession, table: str) -> tuple[int, str]:
    """A new version and its folder."""
    used = [int(n.partition("=")[2]) for n in names_in(spark, table) if n.startswith("version=")]
    number = max([0, *used, *_numbers(spark, table)]) + 1
    return number, f"{table}/{_folder_name(number)}"


def exchange(spark: SparkSession, table: str, by: str, version: int, replaced: Iterable[date] = ()) -> None:
    """From now on the partitions staged in ``version`` count, and those in ``replaced`` only if staged."""
    gone = {d.isoformat() for d in replaced}
    before = current(spark, table)
    if before is None:
        before = _adopt(spark, table, by)
    held = {v: n for v, n in before.items() if v not in gone}
    prefix = f"{by}="
    for name in names_in(spark, f"{table}/{_folder_name(version)}"):
        if name.startswith(prefix):
            held[name.removeprefix(prefix)] = version
    system, unfinished = folder_at(spark, f"{table}/{MANIFESTS}/.{version:08d}")
    stream = system.create(unfinished, True)
    try:
        stream.write(bytearray(json.dumps(held, sort_keys=True), "utf-8"))
    finally:
        stream.close()
    _, final = folder_at(spark, f"{table}/{MANIFESTS}/{version:08d}")
    if not system.rename(unfinished, final):
        raise OSError(f"manifest {version} of {table} could not be written")
    _clean(spark, table, by)


def _adopt(spark: SparkSession, table: str, by: str) -> dict[str, int]:
    """Partitions of a table from before it had manifests, moved into version 0 (once)."""
    plain = [n for n in names_in(spark, table) if n.startswith(f"{by}=")]
    for name in plain:
        system, old = folder_at(spark, f"{table}/{name}")
        _, new = folder_at(spark, f"{table}/{_folder_name(0)}/{name}")
        system.mkdirs(new.getParent())
        if not system.rename(old, new):
            raise OSError(f"{name} of {table} could not be moved")
    return {n.partition("=")[2]: 0 for n in plain}


def _clean(spark: SparkSession, table: str, by: str) -> None:
    """Remove what neither of the newest manifests names."""
    numbers = _numbers(spark, table)
    named = {(v, n) for k in numbers[-KEPT:] for v, n in _read(spark, table, k).items()}
    versions = {n for _, n in named}
    for old in numbers[:-KEPT]:
        for value, n in _read(spark, table, old).items():
            if (value, n) not in named:
                _remove(spark, f"{table}/{_folder_name(n)}/{by}={value}")
        _remove(spark, f"{table}/{MANIFESTS}/{old:08d}")
    for name in names_in(spark, table):
        if name.startswith("version=") and int(name.partition("=")[2]) not in versions:
            _remove(spark, f"{table}/{name}")


def _remove(spark: SparkSession, path: str) -> None:
    system, where = folder_at(spark, path)
    system.delete(where, True)


def read(spark: SparkSession, table: str, schema: StructType, by: str, held: dict[str, int]) -> DataFrame:
    """The partitions of a manifest."""
    if not held:
        return spark.createDataFrame([], schema)
    paths = [f"{table}/{_folder_name(n)}/{by}={v}" for v, n in sorted(held.items())]
    return spark.read.schema(schema).option("basePath", table).parquet(*paths).select(*schema.fieldNames())
